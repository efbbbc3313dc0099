"""Named queries of the sources' parsers and detail sections over messy rows made from `part`, with their SQL.

Raw rows are given as expressions that both engines read; what is expected is written out in SQL by the sources' rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import testbed
from ..operators import federate, sections
from ..boxes import Box
from ..sources import activecaptain, enc, lightlist, listing, notices, openseamap, ports, stations, structures
from .queries import SQL, query
from .text_queries import shown

_LAT = "case when k % 17 = 0 then 95e0 else 42e0 + (k * 7919 % 2001) / 1e5 end"
_LON = "case when k % 19 = 0 then null else -71e0 + (k * 104729 % 2002) / 1e5 end"
_PLACED = "lat between -90 and 90 and lon between -180 and 180"
#: A map link in SQL: five decimals of both coordinates, twice.
_URL = "'https://map.openseamap.org/?zoom=15&lat=' || printf('%.5f', lat) || '&lon=' || printf('%.5f', lon) || '&mlat=' || printf('%.5f', lat) || '&mlon=' || printf('%.5f', lon)"


def named(x: str) -> str:
    return f"nullif(trim({x}), '')"


def shortest(x: str) -> str:
    return f"case when {x} = floor({x}) then cast(cast({x} as bigint) as string) else cast({x} as string) end"


def day(ms: str) -> str:
    return f"case when {ms} > 0 then strftime(make_timestamp({ms} * 1000), '%Y-%m-%d') end"


class Raw:
    """Raw rows by column: an expression for both engines in each."""

    def __init__(self, **columns: str):
        self.columns = columns

    def sql(self) -> str:
        return "raw as (select p_partkey as k, " + ", ".join(f"{e} as {n}" for n, e in self.columns.items()) + " from (select p_partkey, p_partkey as k from part))"

    def rows(self, spark, sf_dir) -> DataFrame:
        part = testbed.spread(testbed.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k")), "k")
        return part.selectExpr("k", *(f"{e} as {n}" for n, e in self.columns.items()))


def compared(poi: DataFrame) -> DataFrame:
    """The columns that summaries are compared by."""
    micros = lambda c: F.floor(F.col(c) * 1e5 + 0.5).cast("long")
    return poi.select(
        "id", "type", "name", "source", shown(F.col("sk_icon")).alias("sk_icon"), "url", "attribution", micros("lat").alias("lat_e5"), micros("lon").alias("lon_e5"),
        shown(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ts"), F.coalesce(F.floor(F.col("clearance_m") * 1e3 + 0.5).cast("long"), F.lit(-1)).alias("clearance_mm"),
        F.coalesce(F.floor(F.col("rating") * 10 + 0.5).cast("long"), F.lit(-1)).alias("rating_10"), F.coalesce("review_count", F.lit(-1)).alias("reviews"),
    )


def summary_sql(source: str, attribution: str, where: str = "true", url: str = _URL, clearance: str = "null", rating: str = "null", reviews: str = "null", **columns: str) -> str:
    c = {"id": "id", "type": "type", "name": "name", "icon": "icon", "ts": "ts"} | columns
    return f"""select {c['id']} as id, {c['type']} as type, {c['name']} as name, '{source}' as source, {c['icon']} as sk_icon, {url} as url, '{attribution}' as attribution,
      cast(floor(lat * 1e5 + 0.5e0) as bigint) as lat_e5, cast(floor(lon * 1e5 + 0.5e0) as bigint) as lon_e5, coalesce({c['ts']}, '-') as ts,
      coalesce(cast(floor({clearance} * 1e3 + 0.5e0) as bigint), -1) as clearance_mm, coalesce(cast(floor({rating} * 1e1 + 0.5e0) as bigint), -1) as rating_10,
      coalesce(cast({reviews} as bigint), -1) as reviews from raw where ({where}) and {c['id']} is not null and {_PLACED}"""


def items(rows: DataFrame, ident: Column, made: Column) -> DataFrame:
    """Items of sections; measures in thousandths."""
    flat = rows.select(ident.alias("id"), F.posexplode(made).alias("at", "s")).select("id", "at", F.col("s.id").alias("section"), F.posexplode("s.items").alias("n", "i"))
    whole = F.floor(F.col("i.value").try_cast("double") * 1e3 + 0.5).cast("long").cast("string")
    value = F.when(F.col("i.kind") == "measure", F.coalesce(whole, F.col("i.value"))).otherwise(F.col("i.value"))
    return flat.select("id", "section", F.col("i.label").alias("label"), value.alias("value"), F.col("i.kind").alias("kind"), shown(F.col("i.unit")).alias("unit"))


def item_sql(ident: str, parts: list[tuple], source: str = "raw") -> str:
    """SQL of items; parts: (section, label, value, kind, unit) with SQL for the value and the unit."""
    selects = []
    for section, label, value, kind, unit in parts:
        shown_value = f"cast(cast(floor(({value}) * 1e3 + 0.5e0) as bigint) as string)" if kind == "measure" else f"cast({value} as string)"
        selects.append(f"select {ident} as id, '{section}' as section, {label if label.startswith('case') else repr(label)} as label, {shown_value} as value, '{kind}' as kind, coalesce({unit or 'null'}, '-') as unit from {source}")
    return "select * from (" + " union all ".join(selects) + ") where value <> ''"


# Light List

LIGHT = Raw(
    feature_id="cast(k as string)", LIGHT_LIST_NUMBER="case when k % 13 = 0 then null else k + (k % 2) * 5e-1 end",
    NAME="case k % 5 when 0 then null when 1 then '  ' else ' Aid ' || cast(k as string) end", DECIMAL_LATITUDE=_LAT, DECIMAL_LONGITUDE=_LON,
    VOLUME_NUMBER="case k % 11 when 0 then 'x' else cast(k % 7 + 1 as string) end", AID_TYPE="case k % 3 when 0 then 'Buoy' when 1 then '' end",
    AID_SUBTYPE="case k % 23 when 0 then 'Isolated  Danger mark' end", REMARK="case k % 29 when 0 then 'marks isolated danger here' when 1 then ' see chart ' end",
    INACTIVE="case k % 8 when 0 then ' TRUE ' when 1 then '1' when 2 then 'no' end", LIGHT_CHAR="case k % 4 when 0 then 'Fl W 4s' when 1 then 'Q' when 2 then 'Iso G 6s' end",
    LIGHT_NOM_RANGE="case when k % 6 <> 0 then cast(k % 20 as double) end", LIGHT_NOM_RANGE_UNIT="case k % 3 when 0 then 'NAUT MI' when 1 then 'STAT MI' else ' ' end",
    LIGHT_FOCAL_PLANE="cast(k % 90 as double)", LIGHT_FOCAL_PLANE_UNIT="case when k % 4 <> 1 then 'Feet' end", STRUCTURE_TYPE="case when k % 2 = 0 then ' Tower ' end",
    STRUCTURE_HEIGHT="case when k % 7 <> 0 then k % 50 + 5e-1 end", STRUCTURE_HEIGHT_UNIT="'FEET'", DAYMARK_SHAPE="case when k % 3 = 1 then 'Triangle' end",
    DAYMARK_COLOR="case when k % 3 = 2 then 'Red' end", SOUND_EMITTER_TYPE="case when k % 10 = 0 then 'Horn' end", RACON_MORSE_CHARACTER="case when k % 12 = 0 then 'K' end",
    MODIFIED_DATE="case when k % 9 = 0 then 0 else 1600000000000 + k * 86400000 end",
)
_LLNR = shortest("LIGHT_LIST_NUMBER")
_LISTED = "LIGHT_LIST_NUMBER is not null and k % 11 <> 0"


@query(
    "light_list_summaries",
    summary_sql(
        "usclightlist", "USCG Light List", _LISTED, id=_LLNR, type="'Navigational'",
        name=f"coalesce({named('NAME')}, 'Unnamed ' || coalesce({named('AID_TYPE')}, 'navigation aid'))",
        icon="case when k % 8 in (0, 1) then 'notice-to-mariners' when k % 23 = 0 or k % 29 = 0 then 'hazard' else 'navigation-structure' end",
        ts="case when MODIFIED_DATE > 0 then strftime(make_timestamp(MODIFIED_DATE * 1000), '%Y-%m-%d %H:%M:%S') end",
    ),
    LIGHT.sql().replace("DECIMAL_LATITUDE", "lat").replace("DECIMAL_LONGITUDE", "lon"),
)
def light_list_summaries(spark, sf_dir):
    return compared(lightlist.summaries(LIGHT.rows(spark, sf_dir)))


@query(
    "light_list_sections",
    item_sql(_LLNR, [
        ("light", "Character", "case k % 4 when 0 then 'flashing, white, 4 s period' when 1 then 'quick flashing' when 2 then 'isophase, green, 6 s period' end", "text", None),
        ("light", "Nominal range", "case when k % 3 <> 2 then LIGHT_NOM_RANGE end", "measure", "case k % 3 when 0 then 'NM' else 'mi' end"),
        ("light", "Focal plane", "case when k % 4 <> 1 then LIGHT_FOCAL_PLANE end", "measure", "'feet'"), ("structure", "Type", named("STRUCTURE_TYPE"), "text", None),
        ("structure", "Height", "STRUCTURE_HEIGHT", "measure", "'feet'"), ("daymark", "Color", "DAYMARK_COLOR", "text", None), ("daymark", "Shape", "DAYMARK_SHAPE", "text", None),
        ("signals", "Sound signal", "SOUND_EMITTER_TYPE", "text", None), ("signals", "RACON", "RACON_MORSE_CHARACTER", "text", None), ("remarks", "Remark", named("REMARK"), "note", None),
        ("source", "LLNR", _LLNR, "text", None), ("source", "Volume", "VOLUME_NUMBER", "text", None), ("source", "Last updated", day("MODIFIED_DATE"), "text", None),
        ("source", "Inactive", "case when k % 8 in (0, 1) then 'true' end", "flag", None),
    ], f"(select * from raw where {_LISTED})"),
    LIGHT.sql(),
)
def light_list_sections(spark, sf_dir):
    rows = lightlist.records(LIGHT.rows(spark, sf_dir))
    return items(rows, F.col("llnr"), sections.light_list_sections())


# Notices

_NOTICE = {
    "feature_id": "case when k % 16 = 0 then 'n' || cast(k as string) else cast(k as string) end", "DECIMAL_LATITUDE": f"case when k % 5 = 0 then null else {_LAT} end",
    "DECIMAL_LONGITUDE": f"case when k % 5 = 0 then null else {_LON} end", "p_lat": "43e0 + (k % 100) / 1e2", "p_lon": "-70e0 - (k % 100) / 1e2",
    "ESRI_OID": "case when k % 8 = 0 then null else k + 1e6 end", "ATU": "case when k % 3 = 0 then null else cast(k % 17 as double) end",
    "WATERWAY_NAME": "case k % 3 when 0 then ' Bay ' when 1 then '' end", "CREATE_DATE": "1500000000000 + k * 3600000",
}
HAZNAV = Raw(
    **_NOTICE, MSI_UID="case when k % 4 = 0 then null else cast(k as double) end", TITLE="case when k % 2 = 0 then ' Title ' || cast(k as string) || ' / more' end",
    MSI_GROUP="'g'", SUB_CATEGORY="case when k % 5 = 1 then 'Sub' end", TYPE="case when k % 7 = 2 then ' Wreck ' end",
    DESCRIPTION="case when k % 6 = 0 then null else 'line ' || cast(k as string) end", MODIFIED_DATE="case when k % 2 = 0 then 1600000000000 + k * 60000 end",
    BEGIN_DATE="case when k % 3 = 0 then 1610000000000 end", END_DATE="case when k % 3 = 1 then 1620000000000 end",
)
DISCREPANT = Raw(
    **_NOTICE, LNM_UID="case when k % 4 = 0 then null else cast(k as double) end", ATON_UID="case when k % 2 = 0 then k + 2e6 end", LLNR="case when k % 3 = 0 then k + 25e-2 end",
    ATON_GROUP="'g'", NAME="case when k % 5 = 0 then ' ' else 'Buoy ' || cast(k % 9 as string) end",
    DISCREP_STATUS="case k % 4 when 0 then 'LT EXT/OFF STA' when 1 then 'missing' when 2 then ' ' end", DISCREP_CORR_STATUS="case k % 3 when 0 then 'N/A' when 1 then 'Unreported yet' else 'Watching' end",
    TC_STATUS="case when k % 8 = 3 then 'RELOCATED' end", TC_CORR_STATUS="cast(null as string)", AID_TYPE="'t'", AID_SUBTYPE="'s'",
    COLOR="case k % 5 when 0 then 'G' when 1 then 'RGR' when 2 then 'odd' end", DESCRIPTION_TYPE="case k % 4 when 0 then 'DBN' when 1 then 'LB' end", BNM_NUM="case when k % 10 = 0 then 'B1' end",
)


def _coordinates(rows: DataFrame, missing: int = 25) -> DataFrame:
    return rows.withColumn("coordinates", F.when(F.col("k") % missing != 0, F.array("p_lon", "p_lat")))


def _notice_raw(raw: Raw) -> str:
    return raw.sql() + """, raw2 as (select *, coalesce(DECIMAL_LATITUDE, case when k % 25 <> 0 then p_lat end) as lat,
      coalesce(DECIMAL_LONGITUDE, case when k % 25 <> 0 then p_lon end) as lon from raw)"""


def _first_number(*columns: str) -> str:
    return f"coalesce({', '.join(shortest(c) for c in columns)}, case when k % 16 <> 0 then cast(k as string) end)"


_HAZNAV_ID = "'haznav_' || " + _first_number("MSI_UID", "ESRI_OID")
_DISCREPANT_ID = "'discfedaid_' || " + _first_number("LNM_UID", "ATON_UID", "ESRI_OID")
_WATER, _KIND, _SUB = named("WATERWAY_NAME"), named("TYPE"), named("SUB_CATEGORY")


@query(
    "notice_summaries",
    summary_sql(
        "uscglnm", "USCG Local Notice to Mariners", id=_HAZNAV_ID, type="'Hazard'", icon="'hazard'",
        name=f"coalesce({_WATER} || ': ' || {_KIND}, {_WATER} || ': ' || {_SUB}, {_KIND}, {_SUB}, case when k % 2 = 0 then 'Title ' || k end, 'Hazard to Navigation')",
        ts="strftime(make_timestamp(coalesce(MODIFIED_DATE, CREATE_DATE) * 1000), '%Y-%m-%d %H:%M:%S')",
    ).replace("from raw ", "from raw2 "), _notice_raw(HAZNAV),
)
def notice_summaries(spark, sf_dir):
    return compared(notices.summaries(_coordinates(HAZNAV.rows(spark, sf_dir)), "haznav"))


@query(
    "discrepancy_summaries",
    summary_sql(
        "uscglnm", "USCG Local Notice to Mariners", id=_DISCREPANT_ID, type="'Hazard'", icon="'hazard'", name=f"coalesce({named('NAME')}, 'Discrepant Federal Aid')",
        ts="strftime(make_timestamp(CREATE_DATE * 1000), '%Y-%m-%d %H:%M:%S')",
    ).replace("from raw ", "from raw2 "), _notice_raw(DISCREPANT),
)
def discrepancy_summaries(spark, sf_dir):
    return compared(notices.summaries(_coordinates(DISCREPANT.rows(spark, sf_dir)), "discfedaid"))


#: What the other layers' places are: kind, icon and name where they have none.
_OTHER_NOTICES = {"marcon": "Marine Construction", "bridge": "Bridge Notice", "misc": "Marine Safety Notice"}
_OTHER_DISCREPANCIES = {"discpriaid": ("Hazard", "hazard", "Discrepant Private Aid"), "tmpchange": ("Navigational", "notice-to-mariners", "Temporary Change")}


@query(
    "other_notice_summaries",
    " union all ".join(
        summary_sql(
            "uscglnm", "USCG Local Notice to Mariners", id=_HAZNAV_ID.replace("haznav", layer), type="'Navigational'", icon="'notice-to-mariners'",
            name=f"coalesce({_WATER} || ': ' || {_KIND}, {_WATER} || ': ' || {_SUB}, {_KIND}, {_SUB}, case when k % 2 = 0 then 'Title ' || k end, '{label}')",
            ts="strftime(make_timestamp(coalesce(MODIFIED_DATE, CREATE_DATE) * 1000), '%Y-%m-%d %H:%M:%S')",
        ).replace("from raw ", "from raw2 ") for layer, label in _OTHER_NOTICES.items()
    ), _notice_raw(HAZNAV),
)
def other_notice_summaries(spark, sf_dir):
    rows = _coordinates(HAZNAV.rows(spark, sf_dir))
    return reduce(DataFrame.unionByName, (compared(notices.summaries(rows, layer)) for layer in _OTHER_NOTICES))


@query(
    "other_discrepancy_summaries",
    " union all ".join(
        summary_sql(
            "uscglnm", "USCG Local Notice to Mariners", id=_DISCREPANT_ID.replace("discfedaid", layer), type=f"'{kind}'", icon=f"'{icon}'", name=f"coalesce({named('NAME')}, '{label}')",
            ts="strftime(make_timestamp(CREATE_DATE * 1000), '%Y-%m-%d %H:%M:%S')",
        ).replace("from raw ", "from raw2 ") for layer, (kind, icon, label) in _OTHER_DISCREPANCIES.items()
    ), _notice_raw(DISCREPANT),
)
def other_discrepancy_summaries(spark, sf_dir):
    rows = _coordinates(DISCREPANT.rows(spark, sf_dir))
    return reduce(DataFrame.unionByName, (compared(notices.summaries(rows, layer)) for layer in _OTHER_DISCREPANCIES))


@query(
    "notice_sections",
    item_sql("k", [
        ("notice", "Category", _SUB, "text", None), ("notice", "Type", _KIND, "text", None), ("notice", "Waterway", _WATER, "text", None),
        ("notice", "Effective from", day("BEGIN_DATE"), "text", None), ("notice", "Effective to", day("END_DATE"), "text", None),
        ("description", "Notice text", "DESCRIPTION", "note", None), ("source", "Notice", "'Hazard to Navigation'", "text", None),
        ("source", "Coast Guard District", "case when k % 3 <> 0 then k % 17 end", "text", None), ("source", "Updated", day("coalesce(MODIFIED_DATE, CREATE_DATE)"), "text", None),
    ]), HAZNAV.sql(),
)
def notice_sections(spark, sf_dir):
    return items(HAZNAV.rows(spark, sf_dir), F.col("k"), sections.notice_sections("haznav"))


@query(
    "discrepancy_sections",
    item_sql("k", [
        ("condition", "Status", "case k % 4 when 0 then 'light extinguished; off station' when 1 then 'missing' else case when k % 8 = 3 then 'relocated' end end", "text", None),
        ("condition", "Correction", "case when k % 3 = 2 then 'Watching' end", "text", None),
        ("condition", "Affected aid", "nullif(trim(case k % 5 when 0 then 'green' when 1 then 'red-green-red' when 2 then 'odd' else '' end || ' ' || case k % 4 when 0 then 'daybeacon' when 1 then 'lighted buoy' else '' end), '')", "text", None),
        ("condition", "Waterway", _WATER, "text", None), ("identity", "LLNR", shortest("LLNR"), "text", None), ("identity", "Broadcast Notice to Mariners", "BNM_NUM", "text", None),
        ("source", "Notice", "'Discrepant Federal Aid'", "text", None), ("source", "Coast Guard District", "case when k % 3 <> 0 then k % 17 end", "text", None),
        ("source", "Updated", day("CREATE_DATE"), "text", None),
    ]), DISCREPANT.sql(),
)
def discrepancy_sections(spark, sf_dir):
    return items(DISCREPANT.rows(spark, sf_dir), F.col("k"), sections.notice_sections("discfedaid"))


# Charts

CHART = Raw(
    feature_id="case when k % 3 = 0 then cast(k as string) when k % 3 = 1 then '0' || cast(k as string) end", OBJECTID="case when k % 5 <> 0 then cast(k + 7 as string) end",
    p_lat=_LAT, p_lon=_LON, CATWRK="case k % 5 when 0 then 'dangerous wreck' when 1 then 'Non-dangerous wreck' when 2 then 'showing mast' when 3 then ' ' end",
    CATOBS="cast(null as string)", OBJNAM="case when k % 4 = 0 then ' Old ' || cast(k as string) end", INFORM="case when k % 6 = 0 then 'see notes' end", DSNM="case when k % 2 = 0 then 'US5' end",
    QUASOU="case k % 4 when 0 then '6' when 1 then '1' when 2 then 'x' end", TECSOU="case k % 3 when 0 then '3' when 1 then '99' end",
    WATLEV="case k % 6 when 5 then null else cast(k % 6 as string) end", VALSOU="case when k % 3 <> 0 then (k % 200) / 1e1 end", SOUACC="case when k % 2 = 0 then 5e-1 end",
    SORDAT="case k % 5 when 0 then '202402' when 1 then '20230229' when 2 then '19991231' when 3 then '2024' end",
)
_CHART_REF = "coalesce(case when k % 3 = 0 then k end, case when k % 5 <> 0 then k + 7 end)"
_DANGER = "case k % 5 when 0 then 'true' when 1 then 'false' end"


@query(
    "chart_summaries",
    summary_sql(
        "noaaenc", "NOAA ENC", id=f"'wreck_' || {_CHART_REF}", type="'Hazard'", icon="'hazard'", name=f"coalesce({named('OBJNAM')}, 'Wreck')",
        ts="case k % 5 when 0 then '2024-02-01 00:00:00' when 2 then '1999-12-31 00:00:00' end",
    ), CHART.sql().replace("p_lat", "lat").replace("p_lon", "lon"),
)
def chart_summaries(spark, sf_dir):
    rows = CHART.rows(spark, sf_dir).withColumn("coordinates", F.array("p_lon", "p_lat"))
    return compared(enc.summaries(rows, "wreck"))


@query(
    "chart_sections",
    item_sql("k", [
        ("feature", "Dangerous", _DANGER, "flag", None), ("feature", "Name", named("OBJNAM"), "text", None), ("feature", "Category", "case when k % 5 = 2 then 'showing mast' end", "text", None),
        ("depth", "case when k % 4 = 0 then 'Least depth' else 'Depth' end", "VALSOU", "measure", "'m'"),
        ("depth", "Water level", "case k % 6 when 1 then 'partly submerged at high water' when 2 then 'always dry' when 3 then 'always submerged' when 4 then 'covers and uncovers' end", "text", None),
        ("depth", "Sounding accuracy", "case when VALSOU is not null then SOUACC end", "measure", "'m'"),
        ("quality", "Position quality", "case k % 4 when 0 then 'least depth known' when 1 then 'depth known' end", "text", None),
        ("quality", "Survey technique", "case k % 3 when 0 then 'found by multi-beam' end", "text", None), ("information", "Information", "INFORM", "note", None),
        ("source", "Dataset", "DSNM", "text", None), ("source", "Surveyed", "case k % 5 when 0 then '2024-02' when 2 then '1999-12-31' end", "text", None),
    ]), CHART.sql(),
)
def chart_sections(spark, sf_dir):
    return items(CHART.rows(spark, sf_dir), F.col("k"), sections.enc_sections("wreck"))


# Locks and dams

WORKS = Raw(
    feature_id="cast(null as string)", OBJECTID="case when k % 9 = 0 then '0' else cast(k as string) end", p_lat=_LAT, p_lon=_LON, PMSNAME="case when k % 4 = 0 then ' ' else ' Lock ' || cast(k as string) end",
    RIVER="case when k % 3 = 0 then 'Ohio' end", RIVERMI="case when k % 5 <> 0 then (k % 977) / 4e0 - 2e1 end", LENGTH="case when k % 2 = 0 then cast(k % 600 as double) end", WIDTH="1.1e2",
    LIFT="case when k % 7 = 0 then 2.55e1 end", GATETYPE="case when k % 3 = 1 then 'Miter' end", YEAROPEN="case when k % 4 <> 0 then 1.9e3 + k % 100 end", STATE="'OH'", NAME="case when k % 4 = 1 then 'Dam ' || cast(k as string) end",
    RIVER_OR_STREAM="case when k % 2 = 1 then 'Creek' end", CITY="case when k % 6 = 0 then 'Town' end", PRIMARY_PURPOSE="'Navigation'", PRIMARY_DAM_TYPE="case when k % 5 = 0 then 'Earth' end",
    DAM_HEIGHT="cast(k % 90 as double)", DAM_LENGTH="case when k % 2 = 0 then cast(k as double) end", YEAR_COMPLETED="case when k % 3 = 0 then 1.95e3 end", HAZARD_POTENTIAL="case when k % 8 = 0 then 'High' end",
    CONDITION_ASSESSMENT="case when k % 8 = 1 then 'Fair' end", PRIMARY_OWNER_TYPE="'Federal'",
)
_WORKS_REF = "case when k % 9 <> 0 then cast(k as string) end"


@query(
    "lock_summaries",
    summary_sql("usace", "US Army Corps of Engineers", id=f"'lock_' || {_WORKS_REF}", type="'Lock'", icon="'lock'", name=f"coalesce({named('PMSNAME')}, 'Lock')", ts="null"),
    WORKS.sql().replace("p_lat", "lat").replace("p_lon", "lon"),
)
def lock_summaries(spark, sf_dir):
    return compared(structures.summaries(WORKS.rows(spark, sf_dir).withColumn("coordinates", F.array("p_lon", "p_lat")), "lock"))


@query(
    "dam_summaries",
    summary_sql("usace", "US Army Corps of Engineers", id=f"'dam_' || {_WORKS_REF}", type="'Dam'", icon="'dam'", name=f"coalesce({named('NAME')}, 'Dam')", ts="null"),
    WORKS.sql().replace("p_lat", "lat").replace("p_lon", "lon"),
)
def dam_summaries(spark, sf_dir):
    return compared(structures.summaries(WORKS.rows(spark, sf_dir).withColumn("coordinates", F.array("p_lon", "p_lat")), "dam"))


def _feet(x: str) -> str:
    return f"{x} * 3048e-4"


_MILE = "cast(floor(abs(RIVERMI) * 1e1 + 0.5e0) as bigint)"


@query(
    "lock_sections",
    item_sql("k", [
        ("chamber", "Name", named("PMSNAME"), "text", None), ("chamber", "Length", _feet("LENGTH"), "measure", "'m'"), ("chamber", "Width", _feet("WIDTH"), "measure", "'m'"),
        ("chamber", "Lift", _feet("LIFT"), "measure", "'m'"), ("chamber", "Gate type", "GATETYPE", "text", None), ("location", "River", "RIVER", "text", None),
        ("location", "River mile", f"case when RIVERMI < 0 then '-' else '' end || ({_MILE} // 10) || '.' || ({_MILE} % 10)", "text", None), ("location", "State", "STATE", "text", None),
        ("source", "Opened", "cast(YEAROPEN as bigint)", "text", None),
    ]), WORKS.sql(),
)
def lock_sections(spark, sf_dir):
    return items(WORKS.rows(spark, sf_dir), F.col("k"), sections.structure_sections("lock"))


@query(
    "dam_sections",
    item_sql("k", [
        ("structure", "Name", "NAME", "text", None), ("structure", "Dam type", "PRIMARY_DAM_TYPE", "text", None), ("structure", "Height", _feet("DAM_HEIGHT"), "measure", "'m'"),
        ("structure", "Length", _feet("DAM_LENGTH"), "measure", "'m'"), ("structure", "Purpose", "PRIMARY_PURPOSE", "text", None), ("location", "River", "RIVER_OR_STREAM", "text", None),
        ("location", "City", "CITY", "text", None), ("location", "State", "STATE", "text", None), ("safety", "Hazard potential", "HAZARD_POTENTIAL", "text", None),
        ("safety", "Condition", "CONDITION_ASSESSMENT", "text", None), ("source", "Owner", "PRIMARY_OWNER_TYPE", "text", None), ("source", "Completed", "cast(YEAR_COMPLETED as bigint)", "text", None),
    ]), WORKS.sql(),
)
def dam_sections(spark, sf_dir):
    return items(WORKS.rows(spark, sf_dir), F.col("k"), sections.structure_sections("dam"))


# Stations and ports

STATION = Raw(
    id="case k % 6 when 0 then ' ' when 1 then 'A B' || cast(k as string) else cast(k as string) end", name="case when k % 5 <> 0 then ' Pier ' || cast(k as string) end", lat=_LAT, lng=_LON,
    state="case when k % 3 = 0 then 'MA' end", timezone="case when k % 2 = 0 then 'EST' end",
)
_STATION_REF = "case k % 6 when 0 then null when 1 then 'A B' || k else cast(k as string) end"
_STATION_PAGE = f"'https://tidesandcurrents.noaa.gov/stationhome.html?id=' || replace({_STATION_REF}, ' ', '%20')"


@query(
    "station_summaries",
    summary_sql(
        "noaacoops", "NOAA CO-OPS", id=f"'tide_' || {_STATION_REF}", type="'Navigational'", icon="'navigation-structure'", name=f"coalesce({named('name')}, 'Station ' || {_STATION_REF})", ts="null", url=_STATION_PAGE,
    ), STATION.sql().replace(" as lng", " as lon"),
)
def station_summaries(spark, sf_dir):
    return compared(stations.summaries(STATION.rows(spark, sf_dir), "tide"))


@query(
    "station_sections",
    item_sql("k", [
        ("station", "Station ID", _STATION_REF, "text", None), ("station", "Type", "'Tide station'", "text", None), ("station", "State", "state", "text", None),
        ("station", "Time zone", "timezone", "text", None), ("links", "Station page", _STATION_PAGE, "link", None),
    ]), STATION.sql(),
)
def station_sections(spark, sf_dir):
    return items(STATION.rows(spark, sf_dir), F.col("k"), sections.station_sections("tide"))


PORT = Raw(
    portNumber="case when k % 14 = 0 then null else cast(k as double) end", portName="case when k % 5 = 0 then ' ' else 'Port of ' || cast(k as string) end", alternateName="case when k % 3 = 0 then 'Old' end",
    countryName="case when k % 4 <> 0 then 'Land' end", xcoord=_LON, ycoord=_LAT, harborSize="case k % 5 when 0 then 'L' when 1 then 'm' when 2 then ' s ' when 3 then 'V' else 'q' end",
    shelter="case k % 6 when 0 then 'E' when 1 then 'g' when 2 then 'F' when 3 then 'P' when 4 then 'N' end", chDepth="case k % 4 when 0 then '7.5' when 1 then 'deep' when 2 then '0' end",
    maxVesselLength="case when k % 3 = 0 then ' 120 ' end", firstPortOfEntry="case k % 3 when 0 then 'Y' when 1 then 'n' else 'U' end",
    erTide="case when k % 2 = 0 then 'Y' else 'N' end", erSwell="case when k % 3 = 0 then 'y' end", erIce="case when k % 5 = 0 then 'Y' else 'U' end", erOther="case when k % 7 = 0 then ' Y ' end",
    suProvisions="case when k % 2 = 1 then 'Y' end", suWater="case when k % 3 = 1 then 'Y' else 'N' end", suFuel="case when k % 4 = 1 then 'Y' end", suDiesel="case when k % 5 = 1 then 'Y' end",
)


@query(
    "port_summaries",
    summary_sql("wpi", "World Port Index", id="cast(cast(portNumber as bigint) as string)", type="'Marina'", icon="'marina'", name=f"coalesce({named('portName')}, 'Port ' || k)", ts="null"),
    PORT.sql().replace("xcoord", "lon").replace("ycoord", "lat"),
)
def port_summaries(spark, sf_dir):
    return compared(ports.summaries(PORT.rows(spark, sf_dir)))


@query(
    "port_sections",
    item_sql("k", [
        ("harbor", "Size", "case k % 5 when 0 then 'Large' when 1 then 'Medium' when 2 then 'Small' when 3 then 'Very small' end", "text", None),
        ("harbor", "Shelter", "case k % 6 when 0 then 'Excellent' when 1 then 'Good' when 2 then 'Fair' when 3 then 'Poor' when 4 then 'None' end", "text", None),
        ("depths", "Channel depth", "case k % 4 when 0 then 75e-1 end", "measure", "'m'"), ("vessel", "Length", "case when k % 3 = 0 then 12e1 end", "measure", "'m'"),
        ("services", "First port of entry", "case k % 3 when 0 then 'true' when 1 then 'false' end", "flag", None),
    ]), PORT.sql(),
)
def port_sections(spark, sf_dir):
    return items(PORT.rows(spark, sf_dir), F.col("k"), sections.port_sections())


def _listed(*pairs: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"case when {c} then '{n}' end" for n, c in pairs) + "], lambda x: x is not null), ', ')"


@query(
    "port_lists",
    "select k, " + _listed(("Tide", "k % 2 = 0"), ("Swell", "k % 3 = 0"), ("Ice", "k % 5 = 0"), ("Other", "k % 7 = 0")) + " as restrictions, "
    + _listed(("Provisions", "k % 2 = 1"), ("Water", "k % 3 = 1"), ("Fuel oil", "k % 4 = 1"), ("Diesel", "k % 5 = 1"))
    + " as supplies, case when k % 5 = 0 then 'Port ' || k else 'Port of ' || k end || case when k % 3 = 0 then ' (Old)' else '' end || case when k % 4 <> 0 then ', Land' else '' end as display from raw where k % 14 <> 0",
    PORT.sql(),
)
def port_lists(spark, sf_dir):
    rows = PORT.rows(spark, sf_dir).where("portNumber is not null")
    name = F.coalesce(F.nullif(F.trim("portName"), F.lit("")), F.concat(F.lit("Port "), lightlist.number_text(F.col("portNumber"))))
    return rows.select(
        "k", F.array_join(ports.restrictions(), ", ").alias("restrictions"), F.array_join(ports.supplies(), ", ").alias("supplies"), ports.display_name(name).alias("display")
    )


# Seamarks

SEAMARK = Raw(
    kind="case k % 7 when 0 then 'way' when 1 then 'relation' when 2 then 'area' else 'node' end", id="case when k % 11 = 0 then -k else k end", lat=f"case when k % 7 = 0 then null else {_LAT} end",
    lon=f"case when k % 7 = 0 then null else {_LON} end", c_lat="415e-1 + (k % 50) / 1e2", c_lon="-70e0 - (k % 50) / 1e2", timestamp="case k % 3 when 0 then '2024-02-03T04:05:06Z' when 1 then 'soon' end",
    t_mark="case k % 8 when 0 then ' Bridge ' when 1 then 'rock' when 2 then 'light_minor' when 3 then 'buoy_isolated_danger' when 4 then 'odd' when 5 then ' ' when 6 then 'harbour' end",
    t_leisure="case when k % 3 = 0 then 'Marina' end", t_name="case k % 4 when 0 then ' N' || cast(k as string) when 1 then '' end", t_seaname="case when k % 5 = 0 then 'S' || cast(k as string) end",
    t_height="case k % 3 when 0 then 'none' when 1 then '3.5 m' end", t_clear="case k % 2 when 0 then '10 ft' else '4' end", t_char="case k % 3 when 0 then 'Fl(2)' when 1 then 'Q' end",
    t_colour="case when k % 2 = 0 then 'white_red' end", t_period="case k % 4 when 0 then '6' when 1 then 'long' end", t_cat="case when k % 3 = 1 then 'a_b' end", t_info="case when k % 6 = 0 then 'Info' end",
)
_TAGS = {
    "seamark:type": "t_mark", "leisure": "t_leisure", "name": "t_name", "seamark:name": "t_seaname", "maxheight": "t_height", "clearance": "t_clear", "seamark:light:character": "t_char",
    "seamark:light:colour": "t_colour", "seamark:light:period": "t_period", "seamark:information": "t_info", "seamark:light_minor:category": "t_cat",
}


def _elements(spark, sf_dir) -> DataFrame:
    pairs = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in _TAGS.items())), lambda p: p["value"].isNotNull())
    rows = SEAMARK.rows(spark, sf_dir)
    return rows.withColumns({"type": F.col("kind"), "center": F.struct(F.col("c_lat").alias("lat"), F.col("c_lon").alias("lon")), "tags": F.map_from_entries(pairs)})


_MARK = "case k % 8 when 0 then 'Bridge' when 1 then 'Hazard' when 2 then 'Navigational' when 3 then 'Navigational' when 4 then 'Unknown' when 6 then 'Marina' else case when k % 3 = 0 then 'Marina' else 'Unknown' end end"
_MARK_ICON = "case k % 8 when 0 then 'bridge' when 1 then 'hazard' when 2 then 'navigation-structure' when 3 then 'hazard' when 4 then 'notice-to-mariners' when 6 then 'marina' else case when k % 3 = 0 then 'marina' else 'notice-to-mariners' end end"


@query(
    "seamark_summaries",
    summary_sql(
        "openseamap", "OpenStreetMap contributors", id="case when k % 7 <> 2 and k % 11 <> 0 then kind || '_' || k end", type=_MARK, icon=_MARK_ICON,
        name=f"coalesce({named('t_name')}, t_seaname, 'Unnamed ' || lower({_MARK}))", ts="case when k % 3 = 0 then '2024-02-03 04:05:06' end", url="'https://www.openstreetmap.org/' || kind || '/' || k",
        clearance="case when k % 8 = 0 then case k % 3 when 1 then 35e-1 else case k % 2 when 0 then 3048e-3 else 4e0 end end end",
    ).replace("from raw ", "from raw2 "), SEAMARK.sql().replace(" as lat,", " as lat0,").replace(" as lon,", " as lon0,"), "raw2 as (select *, coalesce(lat0, c_lat) as lat, coalesce(lon0, c_lon) as lon from raw)",
)
def seamark_summaries(spark, sf_dir):
    return compared(openseamap.summaries(_elements(spark, sf_dir)))


@query(
    "seamark_sections",
    item_sql("k", [
        ("feature", "Category", "case when k % 8 = 2 and k % 3 = 1 then 'a b' end", "text", None), ("light", "Character", "case k % 3 when 0 then 'flashing (2)' when 1 then 'quick flashing' end", "text", None),
        ("light", "Colour", "case when k % 2 = 0 then 'white red' end", "text", None), ("light", "Period", "case when k % 4 = 0 then 6e0 end", "measure", "'s'"),
        ("light", "Period", "case when k % 4 = 1 then 'long' end", "text", None), ("notes", "Information", "t_info", "note", None),
    ]), SEAMARK.sql(),
)
def seamark_sections(spark, sf_dir):
    return items(_elements(spark, sf_dir), F.col("k"), sections.seamark_sections())


@query(
    "light_lines",
    """select k, coalesce(nullif(concat_ws(', ', case k % 3 when 0 then 'flashing (2)' when 1 then 'quick flashing' end, case when k % 2 = 0 then 'white red' end,
      case k % 4 when 0 then '6 s period' when 1 then 'long s period' end), ''), '-') as line from raw""", SEAMARK.sql(),
)
def light_lines(spark, sf_dir):
    return _elements(spark, sf_dir).select("k", shown(openseamap.light_line(F.col("tags"))).alias("line"))


# Community

COMMUNITY = Raw(
    id="case when k % 21 = 0 then null else cast(k as string) end", kind="case k % 6 when 0 then 'Marina' when 1 then 'Hazard' when 2 then 'BoatRamp' when 3 then 'Sauna' when 4 then null else 'Bridge' end",
    name="case k % 9 when 0 then '' when 1 then null else 'C' || cast(k as string) end", lat=_LAT, lon=_LON, stars="(k % 51) / 1e1", reviews="k % 4", copies="case k % 8 when 0 then null when 1 then 3 else 1 end",
)


@query(
    "community_summaries",
    summary_sql(
        "activecaptain", "ActiveCaptain community", "coalesce(copies, 1) <= 1 and kind is not null and name <> ''", type="kind", name="name", ts="null",
        icon="case kind when 'Marina' then 'marina' when 'Hazard' then 'hazard' when 'BoatRamp' then 'boatramp' when 'Bridge' then 'bridge' else 'notice-to-mariners' end",
        url="'https://activecaptain.garmin.com/pois/' || id", rating="case when reviews > 0 then stars end", reviews="nullif(reviews, 0)",
    ), COMMUNITY.sql(),
)
def community_summaries(spark, sf_dir):
    rows = COMMUNITY.rows(spark, sf_dir).select(
        "id", F.col("kind").alias("poiType"), "name", F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("mapLocation"),
        F.struct(F.col("stars").alias("averageRating"), F.col("reviews").alias("numberOfReviews")).alias("reviewSummary"), F.col("copies").alias("poiCount"),
    )
    return compared(activecaptain.summaries(rows))


DETAIL = Raw(
    poi="cast(k as string)", kind="case k % 3 when 0 then 'Marina' when 1 then 'Hazard' else 'BoatRamp' end", name="case when k % 10 = 0 then '' else 'P' || cast(k as string) end", lat=_LAT, lon=_LON,
    stars="4e0", reviews="k % 3", note="case k % 4 when 0 then 'Quiet' when 1 then '' end", free="case k % 3 when 0 then true when 1 then false end", total="cast(k % 5 as double)", loa="case when k % 2 = 0 then 6e1 end",
    diesel="case k % 4 when 0 then 'Yes' when 1 then 'No' when 2 then 'Nearby' else 'Unknown' end", ice="case when k % 5 = 0 then 'Yes' end", phone="case when k % 3 = 0 then '1 2' end",
    website="case k % 2 when 0 then 'javascript:x' else 'https://x.example/' || cast(k as string) end", current="case k % 3 when 0 then 'Unknown' when 1 then 'Strong' end", height="case when k % 4 = 0 then 1.2e1 else -1e0 end",
)


def _details(spark, sf_dir) -> DataFrame:
    """DETAIL's rows in the form of landed detail responses."""
    text = lambda c: f"to_json(named_struct({c}), map('ignoreNullFields', 'true'))"
    body = text(
        "'pointOfInterest', named_struct('id', poi, 'name', name, 'poiType', kind, 'mapLocation', named_struct('latitude', lat, 'longitude', lon), 'notes', array(named_struct('field', 'poiNotes', 'value', note))), "
        "'reviewSummary', named_struct('averageRating', stars, 'numberOfReviews', reviews), 'dockage', named_struct('isFree', free, 'total', total, 'loaMax', loa, 'distanceUnit', 'Foot', 'liveaboard', 'Unknown'), "
        "'fuel', named_struct('diesel', diesel), 'retail', named_struct('ice', ice), 'contact', named_struct('phone', phone, 'website', website), "
        "'navigation', named_struct('current', current, 'bridgeHeight', height, 'distanceUnit', 'Foot')"
    )
    landed = DETAIL.rows(spark, sf_dir).selectExpr("k", f"{body} as body")
    return landed.select("k", F.from_json("body", sections.community_schema()).alias("d")).select("k", "d.*")


_RATED = "k % 3 <> 1 and reviews > 0"


@query(
    "community_sections",
    item_sql("k", [
        ("review", "Average rating", f"case when {_RATED} then '4.0' end", "rating", None), ("review", "Reviews", f"case when {_RATED} then reviews end", "count", None),
        ("notes", "Notes", "note", "note", None), ("dockage", "Docks", "free", "flag", None), ("dockage", "Berths in total", "case when k % 5 > 0 then k % 5 end", "count", None),
        ("dockage", "Maximum LOA", "loa", "measure", "'Foot'"), ("contact", "Phone", "'tel:' || phone", "link", None), ("contact", "Website", "case when k % 2 = 1 then website end", "link", None),
        ("fuel", "Diesel", "case when k % 4 <> 3 then diesel end", "availability", None), ("retail", "Ice", "ice", "availability", None), ("navigation", "Current", "case when k % 3 = 1 then 'Strong' end", "text", None),
        ("navigation", "Bridge clearance", "case when k % 4 = 0 then 12e0 end", "measure", "'Foot'"),
    ]), DETAIL.sql(),
)
def community_sections(spark, sf_dir):
    return items(_details(spark, sf_dir), F.col("k"), sections.community_sections())


# Details by id


@query(
    "detail_by_id",
    f"""select 'activecaptain-' || poi as id, name as title from raw where k % 3 = 0 and name <> '' and {_PLACED}
      union all select 'noaacoops-tide_' || {_STATION_REF}, coalesce({named('sname')}, 'Station ' || {_STATION_REF}) from stations where k % 4 = 1 and k % 6 <> 0 and lat between -90 and 90 and lng is not null""",
    DETAIL.sql(), STATION.sql().replace("raw as", "stations as").replace("as name", "as sname"),
)
def detail_by_id(spark, sf_dir):
    details = [
        ("activecaptain", activecaptain.details(_details(spark, sf_dir)).select("id", F.col("pointOfInterest.name").alias("title"))),
        ("noaacoops", stations.summaries(STATION.rows(spark, sf_dir), "tide").select("id", F.col("name").alias("title"))),
    ]
    part = testbed.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    number = F.col("k").cast("string")
    asked = part.select(F.explode(F.array(
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("activecaptain-"), number)),
        F.when(F.col("k") % 4 == 1, F.concat(F.lit("noaacoops-tide_"), F.when(F.col("k") % 6 == 1, F.concat(F.lit("A B"), number)).otherwise(number))),
        F.concat(F.lit("unknown-"), number), number,
    )).alias("id")).where("id is not null")
    return federate.details_of(asked, details).select("id", "title")


#: Every offer as it is shown: section and label, in the order of the fields below.
_OFFER_LABELS = """('fuel', 'Diesel'), ('fuel', 'Ethanol free'), ('fuel', 'Unleaded'), ('fuel', 'Propane'), ('fuel', 'Electric charging'),
  ('amenities', 'Bar'), ('amenities', 'Cell reception'), ('amenities', 'Boat ramp'), ('amenities', 'Laundry'), ('amenities', 'Courtesy car'), ('amenities', 'Pets allowed'), ('amenities', 'Lodging'),
  ('amenities', 'Restrooms'), ('amenities', 'Restaurant'), ('amenities', 'Transportation'), ('amenities', 'Showers'), ('amenities', 'Water'), ('amenities', 'Rubbish disposal'), ('amenities', 'Wi-Fi'),
  ('services', 'Haul-out'), ('services', 'Pump-out'), ('services', 'General repair'), ('services', 'Mechanical repair'), ('services', 'Diesel engine repair'), ('services', 'Gas engine repair'),
  ('services', 'Electronics'), ('services', 'Sails and rigging'), ('services', 'Fiberglass'), ('services', 'Welding'), ('services', 'Propeller repair'), ('services', 'Canvas and upholstery'),
  ('services', 'Painting'), ('services', 'Bottom painting'), ('services', 'Wash and wax'), ('services', 'Marine HVAC'), ('services', 'Plumbing'), ('services', 'Carpentry'), ('services', 'Storage'),
  ('services', 'Charter'), ('services', 'Boat brokers'), ('services', 'Surveyors'), ('services', 'Towing'), ('services', 'Rescue and salvage'), ('services', 'Water taxi'),
  ('retail', 'Grocery'), ('retail', 'Ice'), ('retail', 'Fishing supplies'), ('retail', 'Marine supplies'), ('retail', 'Hardware'),
  ('business', 'Seasonal'), ('business', 'Open to public'), ('business', 'Cash accepted'), ('business', 'Cheques accepted'), ('business', 'Cards accepted'),
  ('mooring', 'Moorings available'), ('mooring', 'Dinghy dock'), ('mooring', 'Launch service'), ('mooring', 'Liveaboard'),
  ('dockage', 'Liveaboard'), ('dockage', 'Secure access'), ('dockage', 'Security patrol'), ('navigation', 'Fixed bridge')"""
_OFFER_FIELDS = """fuel.diesel fuel.ethanolFree fuel.gas fuel.propane fuel.electric
  amenity.bar amenity.cellReception amenity.boatRamp amenity.laundry amenity.courtesyCar amenity.pets amenity.lodging amenity.restroom amenity.restaurant amenity.transportation amenity.shower
  amenity.water amenity.trash amenity.wifi services.haulOut services.pumpOut services.repair services.mechanical services.repairDieselEngines services.repairGasEngines services.electronics
  services.sailsAndRigging services.fiberglass services.welding services.propellerRepair services.canvasAndUpholstery services.paint services.bottomPainting services.washAndWax
  services.marineHvac services.plumbing services.carpentry services.storage services.charter services.boatBrokers services.surveyors services.towing services.rescueAndSalvage services.waterTaxi
  retail.grocery retail.ice retail.fishingSupplies retail.marineRetail retail.hardware business.seasonal business.public business.cash business.check business.credit
  mooring.hasMoorings mooring.dinghy mooring.launch mooring.liveaboard dockage.liveaboard dockage.secureAccess dockage.securityPatrol navigation.fixedBridge""".split()
_ANSWERS = ("Yes", "No", "Nearby", "Unknown", "")


@query(
    "community_offers",
    f"""select p_partkey as id, section, label, {list(_ANSWERS)}[(p_partkey // {len(_OFFER_FIELDS)} % 5 + 1)::int] as value, 'availability' as kind, '-' as unit
      from part join (select *, row_number() over () - 1 as n from (values {_OFFER_LABELS}) t(section, label)) on n = p_partkey % {len(_OFFER_FIELDS)} where p_partkey // {len(_OFFER_FIELDS)} % 5 < 3""",
)
def community_offers(spark, sf_dir):
    """Every offer with every answer: three of them are shown."""
    k = F.col("p_partkey")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    n = len(_OFFER_FIELDS)
    section, field = (pick([x.split(".")[at] for x in _OFFER_FIELDS], k % n) for at in (0, 1))
    answer = pick(_ANSWERS, F.floor(k / n) % len(_ANSWERS))
    raw = F.concat(F.lit('{"'), section, F.lit('": {"'), field, F.lit('": "'), answer, F.lit('"}}'))
    rows = testbed.table(spark, sf_dir, "part").select(k.alias("k"), F.from_json(raw, sections.community_schema()).alias("d"))
    return items(rows.select("k", "d.*"), F.col("k"), sections.community_sections()).withColumnRenamed("k", "id")


_OPEN_KINDS = ("noaaenc-wreck_", "usace-lock_", "usace-dam_", "openseamap-node_", "openseamap-way_", "openseamap-relation_", "unknown-")


@query(
    "feature_detail_by_id",
    "select asked.id, name as title, lat_e5 from asked join found using (id)",
    *(f"{n}_rows as ({SQL[f'{n}_summaries']})" for n in ("chart", "lock", "dam", "seamark")),
    "asked as (select unnest([" + ", ".join(f"'{x}' || p_partkey" for x in _OPEN_KINDS) + "]) as id from part where p_partkey % 3 <> 1)",
    "found as (" + " union all ".join(f"select source || '-' || id as id, name, lat_e5 from {n}_rows" for n in ("chart", "lock", "dam", "seamark")) + ")",
)
def feature_detail_by_id(spark, sf_dir):
    """By id: charts, structures of both layers, and seamarks of all kinds of elements."""
    works = WORKS.rows(spark, sf_dir).withColumn("coordinates", F.array("p_lon", "p_lat"))
    charts = CHART.rows(spark, sf_dir).withColumn("coordinates", F.array("p_lon", "p_lat"))
    tables = [
        ("noaaenc", enc.summaries(charts, "wreck")), ("usace", structures.summaries(works, "lock")), ("usace", structures.summaries(works, "dam")),
        ("openseamap", openseamap.summaries(_elements(spark, sf_dir))),
    ]
    number = F.col("p_partkey").cast("string")
    asked = testbed.table(spark, sf_dir, "part").where("p_partkey % 3 <> 1").select(F.explode(F.array(*(F.concat(F.lit(x), number) for x in _OPEN_KINDS))).alias("id"))
    found = federate.details_of(asked, [(owner, t.select("id", F.col("name").alias("title"), "lat")) for owner, t in tables])
    return found.select("id", "title", F.floor(F.col("lat") * 1e5 + 0.5).cast("long").alias("lat_e5"))


# What each source lists in a box

_BOX = Box(42.002005, 42.016005, -70.998005, -70.985005)
_IN_BOX = "lat_e5 between 4200201 and 4201600 and lon_e5 between -7099800 and -7098501"
_NOT_BEFORE = "(ts = '-' or cast(substr(ts, 1, 4) as int) >= 2022)"


def _made(spark, sf_dir) -> dict[str, DataFrame]:
    """Summaries of each source."""
    placed = lambda raw: raw.rows(spark, sf_dir).withColumn("coordinates", F.array("p_lon", "p_lat"))
    community = COMMUNITY.rows(spark, sf_dir).select(
        "id", F.col("kind").alias("poiType"), "name", F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("mapLocation"),
        F.struct(F.col("stars").alias("averageRating"), F.col("reviews").alias("numberOfReviews")).alias("reviewSummary"), F.col("copies").alias("poiCount"),
    )
    return {
        "community": activecaptain.summaries(community), "seamark": openseamap.summaries(_elements(spark, sf_dir)), "chart": enc.summaries(placed(CHART), "wreck"),
        "lock": structures.summaries(placed(WORKS), "lock"), "light_list": lightlist.summaries(LIGHT.rows(spark, sf_dir)),
        "notice": notices.summaries(_coordinates(HAZNAV.rows(spark, sf_dir)), "haznav"), "station": stations.summaries(STATION.rows(spark, sf_dir), "tide"),
        "port": ports.summaries(PORT.rows(spark, sf_dir)),
    }


#: For each source: how it is asked, and the same in SQL.
_ASKED = {
    "community": ({"least_rating": 2.0}, "(type not in ('Marina', 'Anchorage', 'Business', 'BoatRamp') or rating_10 >= 20)"),
    "seamark": ({"kinds": ["Marina", "Bridge"], "year": 2022}, f"type in ('Marina', 'Bridge') and {_NOT_BEFORE}"),
    "chart": ({"year": 2022}, _NOT_BEFORE), "lock": ({"us_only": True}, "true"), "light_list": ({"us_only": True, "year": 2022}, _NOT_BEFORE),
    "notice": ({"kinds": ["Hazard"], "us_only": True}, "type = 'Hazard'"), "station": ({"us_only": True}, "true"), "port": ({"kinds": ["Marina", "Lock"]}, "type in ('Marina', 'Lock')"),
}


def _box_sql(name: str) -> str:
    return f"select id, type, source from ({SQL[name + '_summaries']}) where {_IN_BOX} and {_ASKED[name][1]}"


def _box_query(name: str) -> None:
    @query(f"{name}_in_box", _box_sql(name))
    def run(spark, sf_dir):
        return listing.listed(_made(spark, sf_dir)[name], _BOX, **_ASKED[name][0]).select("id", "type", "source")


for _name in _ASKED:
    _box_query(_name)


@query(
    "every_source_in_box",
    "select source || '-' || id as id, type, source from (" + " union all ".join(f"select * from ({_box_sql(n)})" for n in _ASKED) + ")",
)
def every_source_in_box(spark, sf_dir):
    """All sources' lists for one box, named by their source."""
    made = _made(spark, sf_dir)
    lists = [listing.listed(made[n], _BOX, **asked) for n, (asked, _) in _ASKED.items()]
    names = [activecaptain.SOURCE, openseamap.SOURCE, enc.SOURCE, structures.SOURCE, lightlist.SOURCE, notices.SOURCE, stations.SOURCE, ports.SOURCE]
    return federate.union_sources(list(zip(names, lists))).select("id", "type", "source")
