"""Named queries of the text, date, lookup, detail, status and store functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import testbed
from ..functions import dates, numbers, text
from ..operators import corridor, course, detail, fingerprints, status, store
from ..sources import openseamap
from .queries import CORRIDOR, DETAILS, LEGS, POI, ROUTE_SQL, _details, _found, poi, query, whole

CLEARANCES = ["10'6\"", "11 ft", "3.5 m", "4", "7 metres", "unknown", "", "0", " 12' ", "5.25", "-3", "8 feet", "1 000"]
#: What these come to, in millimetres; -1: no clearance.
CLEARANCE_MM = [3200, 3353, 3500, 4000, 7000, -1, -1, -1, 3658, 5250, -1, 2438, -1]
LINKS = ["https://a.example/x", "HTTP://b.example", "javascript:alert(1)", "mailto:x@y.example", "tel:+1", "/relative", "ftp://c.example", " https://d.example "]
LIGHTS = ["Fl W 4s", "Fl(2) R 6s", "Q", "Iso G 2S", "Oc Y", "Xx Q 5s", "F", "Mo(A) W 8s", "VQ(9) W", "LFl W 10s"]
ENDPOINTS = ["https://a.example/api", "http://u:p@b.example/x", "ftp://c.example", "not a url", " http://d.example:8080/q?x=1 ", "https:///nohost", "HTTPS://e.example"]
STATUSES = ["LT EXT/OFF STATION", "missing", "STRUCT DEST / TRLB", "/", "SOMETHING NEW", "Sinking/ ADRIFT", "RAC INOP", "OFF STA/HAZ NAV/TRUB"]
#: What the lights and statuses above read as, in their order.
LIGHT_PHRASES = [
    "flashing, white, 4 s period", "flashing (2), red, 6 s period", "quick flashing", "isophase, green, 2 s period", "occulting, yellow", "Xx, q, 5 s period", "fixed",
    "Morse (A), white, 8 s period", "very quick (9), white", "long flashing, white, 10 s period",
]
STATUS_TEXTS = [
    "light extinguished; off station", "missing", "structure destroyed; temporarily replaced by a lighted buoy", "", "SOMETHING NEW", "sinking; adrift", "RACON inoperative",
    "off station; hazard to navigation; temporarily replaced by an unlighted buoy",
]
FIELDS = ["poiNotes", "fuelDieselPrice", "name", "hasWiFi2Go", "ABCdef", "x1Y2"]
SURVEYS = ["202402", "20240229", "20230229", "19991231", "2024", "202413", "abc", "20240230", "198706"]
MARKS = ["rock", "harbour", "bridge", "lock_basin", "anchorage", "buoy_isolated_danger", "light_major", "nonsense", ""]


def listed(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def samples(values: list[str]) -> str:
    """SQL of (k, v): one of the values for each part."""
    return f"samples as (select p_partkey as k, {listed(values)}[(p_partkey % {len(values)} + 1)::int] as v from part)"


def sampled(spark, sf_dir, values: list[str]) -> DataFrame:
    k = F.col("p_partkey")
    chosen = F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    return testbed.table(spark, sf_dir, "part").select(k.alias("k"), chosen.alias("v"))


def shown(x: Column) -> Column:
    """Null as a text of its own, so that results compare alike everywhere."""
    return F.coalesce(x, F.lit("-"))


@query("parse_clearance_text", f"select k, {CLEARANCE_MM}[(k % {len(CLEARANCES)} + 1)::int] as mm from samples", samples(CLEARANCES))
def parse_clearance_text(spark, sf_dir):
    mm = numbers.scaled(text.clearance_m(F.col("v")), 1e3)
    return sampled(spark, sf_dir, CLEARANCES).select("k", F.coalesce(mm, F.lit(-1)).alias("mm"))


@query(
    "escape_html",
    """select page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) as digest from pages""",
)
def escape_html(spark, sf_dir):
    return testbed.table(spark, sf_dir, "pages").select("page_id", F.md5(text.escaped(F.col("html")).cast("binary")).alias("digest"))


@query(
    "safe_url",
    "select k, coalesce(case when lower(regexp_extract(trim(v), '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) in ('http', 'https', 'mailto', 'tel') then trim(v) end, '-') as url from samples",
    samples(LINKS),
)
def safe_url(spark, sf_dir):
    return sampled(spark, sf_dir, LINKS).select("k", shown(text.safe_link(F.col("v"))).alias("url"))


@query(
    "light_char",
    f"select k, {listed(LIGHT_PHRASES)}[(k % {len(LIGHT_PHRASES)} + 1)::int] as phrase from samples", samples(LIGHTS),
)
def light_char(spark, sf_dir):
    return sampled(spark, sf_dir, LIGHTS).select("k", text.light_phrase(F.col("v")).alias("phrase"))


@query(
    "status_tokens",
    f"select k, {listed(STATUS_TEXTS)}[(k % {len(STATUS_TEXTS)} + 1)::int] as phrase from samples", samples(STATUSES),
)
def status_tokens(spark, sf_dir):
    return sampled(spark, sf_dir, STATUSES).select("k", text.status_phrase(F.col("v")).alias("phrase"))


@query("humanize_field", r"select k, regexp_replace(v, '([a-z0-9])([A-Z])', '\1 \2', 'g') as label from samples", samples(FIELDS))
def humanize_field(spark, sf_dir):
    return sampled(spark, sf_dir, FIELDS).select("k", text.spaced_field(F.col("v")).alias("label"))


_IDS = ["plain-id_1", "with space", "a/b", "é", "x.y", "", "UPPER9"]


@query(
    "sanitize_id",
    "select k, case when regexp_matches(v, '^[A-Za-z0-9_-]+$') then v else 'escaped.' || case when v = '' then '_' else rtrim(translate(base64(encode(v)), '+/', '-_'), '=') end end as path_id from samples",
    samples(_IDS),
)
def sanitize_id(spark, sf_dir):
    return sampled(spark, sf_dir, _IDS).select("k", text.path_id(F.col("v")).alias("path_id"))


@query(
    "format_eta",
    """select event_id, case when s >= 0 and s < 60 then '<1 min' when m < 60 then m || ' min' else (m // 60) || ' h ' || (m % 60) || ' min' end as eta
      from (select event_id, s, cast(floor(s / 60e0 + 0.5e0) as bigint) as m from (select event_id, (event_id * 37 % 20000)::double as s from events))""",
)
def format_eta(spark, sf_dir):
    return testbed.table(spark, sf_dir, "events").select("event_id", text.eta_text((F.col("event_id") * 37 % 20000).cast("double")).alias("eta"))


# Seconds of the units, by the rule of 30 days a month and 12 months a year.
_UNITS = (("year", 12 * 30 * 86400), ("month", 30 * 86400), ("day", 86400), ("hour", 3600), ("minute", 60), ("second", 1))


def _relative_sql() -> str:
    units = _UNITS
    first = "case " + " ".join(f"when a >= {n} then {k}" for k, (_, n) in enumerate(units)) + f" else {len(units) - 1} end"
    steps = first
    sql = f"r0 as (select id, s, abs(s) as a from deltas), r1 as (select *, {steps} as u from r0)"
    for k in range(len(units) - 1, 0, -1):
        sql += f", r{len(units) + 1 - k} as (select * replace (case when u = {k} and floor(a / {units[k][1]}e0 + 0.5e0) * {units[k][1]} >= {units[k - 1][1]} then {k - 1} else u end as u) from r{len(units) - k})"
    return sql


_AS_OF = "2026-06-15 12:00:00"


@query(
    "relative_time",
    "select id, cast(floor(s / (case u " + " ".join(f"when {k} then {n}e0" for k, (_, n) in enumerate(_UNITS)) + " end) + 0.5e0) as bigint) as amount, case u "
    + " ".join(f"when {k} then '{n}'" for k, (n, _) in enumerate(_UNITS)) + f" end as unit from r{len(_UNITS)}",
    POI, f"deltas as (select id, cast(epoch(ts) - epoch(timestamp '{_AS_OF}') as bigint)::double / (seq % 5000 + 1) as s from poi where ts is not null)", _relative_sql(),
)
def relative_time(spark, sf_dir):
    seconds = (F.unix_timestamp("ts") - F.unix_timestamp(F.lit(_AS_OF).cast("timestamp"))).cast("double") / (F.col("seq") % 5000 + 1)
    rows = poi(spark, sf_dir).where("ts is not null").withColumn("r", dates.relative_units(seconds))
    return rows.select("id", F.col("r.amount").cast("long").alias("amount"), F.col("r.unit").alias("unit"))


@query(
    "sordat_parse",
    """select k, coalesce(strftime(try_strptime(case when regexp_matches(v, '^[0-9]{6}$') then v || '01' when regexp_matches(v, '^[0-9]{8}$') then v end, '%Y%m%d'), '%Y-%m-%d'), '-') as day from samples""",
    samples(SURVEYS),
)
def sordat_parse(spark, sf_dir):
    return sampled(spark, sf_dir, SURVEYS).select("k", shown(F.date_format(dates.survey_date(F.col("v")), "yyyy-MM-dd")).alias("day"))


@query("epoch_iso", "select event_id, coalesce(strftime(make_timestamp(nullif(greatest(event_id - 100, 0), 0) * 86400000), '%Y-%m-%dT%H:%M:%S'), '-') as iso from events")
def epoch_iso(spark, sf_dir):
    ms = (F.col("event_id") - 100) * 86_400
    return testbed.table(spark, sf_dir, "events").select("event_id", shown(F.date_format(dates.from_epoch_ms(ms), "yyyy-MM-dd'T'HH:mm:ss")).alias("iso"))


@query("stale_hazard", f"select id, coalesce(type = 'Hazard' and ts < timestamp '{_AS_OF}' - interval 2 years, false) as stale from poi", POI)
def stale_hazard(spark, sf_dir):
    return poi(spark, sf_dir).select("id", dates.is_stale(F.col("type"), F.col("ts"), F.lit(_AS_OF).cast("timestamp")).alias("stale"))


# Lookups


@query(
    "icon_lookup",
    "select id, case type when 'Hazard' then 'hazard' when 'Bridge' then 'bridge' when 'Lock' then 'lock' when 'Marina' then 'marina' when 'Anchorage' then 'anchorage' "
    "when 'Navigational' then 'navigation-structure' when 'Business' then 'business' end as icon from poi", POI,
)
def icon_lookup(spark, sf_dir):
    return poi(spark, sf_dir).select("id", detail.icon(F.col("type")).alias("icon"))


@query(
    "seamark_lookup",
    """select k, case v when 'rock' then 'Hazard' when 'harbour' then 'Marina' when 'bridge' then 'Bridge' when 'lock_basin' then 'Lock' when 'anchorage' then 'Anchorage'
        when 'buoy_isolated_danger' then 'Navigational' when 'light_major' then 'Navigational' when '' then case when k % 2 = 0 then 'Marina' else 'Unknown' end else 'Unknown' end as type,
      case v when 'rock' then 'hazard' when 'harbour' then 'marina' when 'bridge' then 'bridge' when 'lock_basin' then 'lock' when 'anchorage' then 'anchorage'
        when 'buoy_isolated_danger' then 'hazard' when 'light_major' then 'navigation-structure' when '' then case when k % 2 = 0 then 'marina' else 'notice-to-mariners' end
        else 'notice-to-mariners' end as icon from samples""",
    samples(MARKS),
)
def seamark_lookup(spark, sf_dir):
    leisure = F.when(F.col("k") % 2 == 0, F.lit("marina"))
    tags = F.map_from_arrays(F.array(F.lit("seamark:type"), F.lit("leisure")), F.array(F.col("v"), F.coalesce(leisure, F.lit("no"))))
    marking = openseamap.marking(tags)
    return sampled(spark, sf_dir, MARKS).select("k", marking["type"].alias("type"), marking["icon"].alias("icon"))


# Details and notes


@query(
    "sections_array",
    """select id, section, label, value from (
      select id, 'position' as section, 'Latitude' as label, cast(floor(lat * 1e4 + 0.5e0) as bigint)::varchar as value from poi
      union all select id, 'position', 'Longitude', cast(floor(lon * 1e4 + 0.5e0) as bigint)::varchar from poi
      union all select id, 'bridge', 'Vertical clearance', cast(floor(clearance_m * 1e1 + 0.5e0) as bigint)::varchar from poi where clearance_m is not null
      union all select id, 'reviews', 'Rating', cast(floor(rating * 1e1 + 0.5e0) as bigint)::varchar from poi where rating > 0
      union all select id, 'reviews', 'Reviews', review_count::varchar from poi where review_count > 0)""",
    POI,
)
def sections_array(spark, sf_dir):
    e4 = lambda c: numbers.scaled(F.col(c), 1e4).cast("string")
    e1 = lambda c: numbers.scaled(F.col(c), 10.0).cast("string")
    made = detail.sections([
        ("position", "Position", [detail.item("Latitude", e4("lat")), detail.item("Longitude", e4("lon"))]),
        ("bridge", "Bridge", [detail.item("Vertical clearance", e1("clearance_m"), "measure", "m")]),
        ("reviews", "Reviews", [
            detail.item("Rating", F.when(F.col("rating") > 0, e1("rating"))),
            detail.item("Reviews", F.when(F.col("review_count") > 0, F.col("review_count").cast("string"))),
        ]),
    ])
    rows = poi(spark, sf_dir).select("id", F.explode(made).alias("s")).select("id", F.col("s.id").alias("section"), F.explode("s.items").alias("i"))
    return rows.select("id", "section", F.col("i.label").alias("label"), F.col("i.value").alias("value"))


@query(
    "notes_json",
    "select id, name, 'https://chart.example/' || id as url, lat_e4, case when len(sources) > 1 then len(sources) else 0 end as n_sources from "
    "(select id, name, cast(floor(lat * 1e4 + 0.5e0) as bigint) as lat_e4, case when review_count > 10 then [source, 'other'] else [source] end as sources from poi)", POI,
)
def notes_json(spark, sf_dir):
    rows = poi(spark, sf_dir).withColumns({
        "sources": F.when(F.col("review_count") > 10, F.array("source", F.lit("other"))).otherwise(F.array("source")),
        "url": F.concat(F.lit("https://chart.example/"), F.col("id")),
    })
    note = detail.notes(rows).select("id", F.from_json("note", "name string, url string, position struct<latitude:double,longitude:double>, properties struct<sources:array<string>>").alias("n"))
    return note.select(
        "id", F.col("n.name").alias("name"), F.col("n.url").alias("url"), numbers.scaled(F.col("n.position.latitude"), 1e4).alias("lat_e4"),
        F.coalesce(F.size("n.properties.sources"), F.lit(0)).cast("long").alias("n_sources"),
    )


@query("property_path", "select event_id, coalesce(json_extract_string(props, '$.k'), '-') as k from events")
def property_path(spark, sf_dir):
    return testbed.table(spark, sf_dir, "events").select("event_id", shown(detail.property_of(F.col("props"), "k")).alias("k"))


@query(
    "property_types",
    """select event_id, case when event_id % 5 = 0 then -1 else event_id end as n, case when event_id % 5 = 0 then '-' else 't ' || event_id end as t,
      case when event_id % 5 = 0 then '-' else (event_id % 2 = 0)::varchar end as b, case when event_id % 5 = 0 then '-' else 'null' end as z,
      case when event_id % 5 = 0 then '-' else 'OBJECT' end as o, case when event_id % 5 = 0 then '-' else event_id::varchar end as second, '-' as missing from events""",
)
def property_types(spark, sf_dir):
    """Typed values of notes, names with dots among them; every fifth text is no JSON."""
    e = F.col("event_id").cast("string")
    even = F.when(F.col("event_id") % 2 == 0, "true").otherwise("false")
    note = F.concat(
        F.lit('{"a.b": {"n": '), e, F.lit(', "t": "t '), e, F.lit('", "z": null}, "a": {"b": '), even, F.lit(', "list": [1, "'), e, F.lit('"]}'),
        F.when(F.col("event_id") % 5 == 0, "").otherwise("}"),
    )
    read = testbed.table(spark, sf_dir, "events").select("event_id", detail.parsed(note).alias("v"))
    typed = lambda kind, *names: detail.typed_property(F.col("v"), list(names), kind)
    kind = lambda *names: shown(detail.property_kind(F.col("v"), list(names)))
    return read.select(
        "event_id", F.coalesce(typed("long", "a.b", "n"), F.lit(-1)).alias("n"), shown(typed("string", "a.b", "t")).alias("t"), shown(typed("boolean", "a", "b").cast("string")).alias("b"),
        kind("a.b", "z").alias("z"), kind("a.b").alias("o"), shown(typed("string", "a", "list", 1)).alias("second"), kind("a", "n").alias("missing"),
    )


# Status and stores


@query(
    "status_rollup",
    "select event_type as source, arg_max(case when event_id % 3 = 0 then 'unreachable' else 'reachable' end, event_id) as state, count(*) filter (event_id % 3 = 0) as errors from events group by 1",
)
def status_rollup(spark, sf_dir):
    log = testbed.table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("at"), (F.col("event_id") % 3 != 0).alias("ok"))
    return status.rollup(log)


@query("recent_errors_topk", "select event_id from events where event_id % 3 = 0 order by event_id desc limit 5")
def recent_errors_topk(spark, sf_dir):
    log = testbed.table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("at"), (F.col("event_id") % 3 != 0).alias("ok"))
    return status.recent_errors(log).select(F.col("at").alias("event_id"))


@query(
    "store_retention",
    f"select id from (select id, row_number() over (order by ts desc, id) as n from poi where ts >= timestamp '{_AS_OF}' - interval 3000 days) where n <= 200", POI,
)
def store_retention(spark, sf_dir):
    rows = poi(spark, sf_dir).select("id", "ts")
    return store.retained(rows, F.lit(_AS_OF).cast("timestamp"), 3000, 200).select("id")


@query(
    "store_diff",
    "select o_orderkey as id, case when o_orderkey % 10 = 1 then 'added' when o_orderkey % 10 = 2 then 'removed' else 'changed' end as change from orders where o_orderkey % 10 in (1, 2, 3)",
)
def store_diff(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = testbed.table(spark, sf_dir, "orders").select(k.alias("id"), "o_custkey")
    held, fresh = orders.where("id % 10 <> 1"), orders.where("id % 10 <> 2").withColumn("o_custkey", F.when(F.col("id") % 10 == 3, -1).otherwise(F.col("o_custkey")))
    return store.difference(held, fresh, ["id"])


# Courses


@query(
    "latest_route",
    "select vessel, route_id, version from (select user_id % 10 as vessel, arg_max(case when event_id % 11 <> 0 then event_type else 'none' end, event_id) as route_id, max(event_id) as version from events group by 1) where route_id <> 'none'",
)
def latest_route(spark, sf_dir):
    versions = testbed.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("vessel"), F.col("event_id").alias("version"), F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("route_id")
    )
    return course.latest_route(versions)


_KM = f"case when along_m >= 1000 then ({whole('along_m', '1e-2')} // 10) || '.' || ({whole('along_m', '1e-2')} % 10) || ' km' else {whole('along_m', '1e0')} || ' m' end"
_MIN = whole("along_m / 4e0", "1.6666666666666666e-2").replace("* 1.6666666666666666e-2", "/ 60e0")
_ETA = f"case when along_m / 4e0 < 60 then '<1 min' when {_MIN} < 60 then {_MIN} || ' min' else ({_MIN} // 60) || ' h ' || ({_MIN} % 60) || ' min' end"


@query(
    "route_messages",
    f"""select id, type || ' "' || 'Point ' || split_part(id, '-', 2) || '" is on the route ahead, ' || {_KM} || ' away, ETA ' || {_ETA}
      || case when type = 'Bridge' and c <= 9.5e0 then ': clearance ' || case when {whole('c', '1e1')} % 10 = 0 then ({whole('c', '1e1')} // 10)::varchar else ({whole('c', '1e1')} // 10) || '.' || ({whole('c', '1e1')} % 10) end
      || ' m is at or below your air draft 8.5 m (+1 m margin)' else '' end as message
      from (select found.*, coalesce(found.clearance_m, details.detail_clearance_m) as c from found left join details using (id))""",
    POI, ROUTE_SQL, LEGS, CORRIDOR, DETAILS,
)
def route_messages(spark, sf_dir):
    found = _found(spark, sf_dir, 4.0)
    low = corridor.too_low(found, _details(poi(spark, sf_dir)), 8.5, 1.0)
    return course.messages(found, low, 8.5, 1.0)


@query(
    "http_endpoint",
    "select k, coalesce(case when regexp_matches(trim(v), '^(?i)https?://[^/@\\s]+(/|$)') then trim(v) end, '-') as url from samples", samples(ENDPOINTS),
)
def http_endpoint(spark, sf_dir):
    return sampled(spark, sf_dir, ENDPOINTS).select("k", shown(text.http_endpoint(F.col("v"))).alias("url"))


@query(
    "refresh_rollup",
    "select o_orderpriority as source, cast(coalesce(sum(case when o_orderkey % 9 <> 4 then o_custkey end), 0) as bigint) as ingested, count(*) filter (o_orderkey % 9 = 4) as failures, coalesce(min(case when o_orderkey % 9 = 4 then o_orderkey end), -1) as first_failure from orders group by 1",
)
def refresh_rollup(spark, sf_dir):
    pages = testbed.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("page"), F.col("o_custkey").alias("rows"), (F.col("o_orderkey") % 9 != 4).alias("ok")
    )
    return status.refresh_rollup(pages).withColumn("first_failure", F.coalesce("first_failure", F.lit(-1)))


@query(
    "page_refresh",
    """select page, case when page % 5 = 0 then 'changed' when page % 7 = 3 then 'added' when page % 11 = 4 then 'refused' else 'unchanged' end as change
      from (select distinct l_orderkey % 60 as page from lineitem)""",
)
def page_refresh(spark, sf_dir):
    """A refresh of pages of order lines: some have another quantity, some are new, some come with an older version, and all others in another order."""
    page = (F.col("l_orderkey") % 60).cast("int")
    rows = testbed.table(spark, sf_dir, "lineitem").select(page.alias("page"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.lit(2).alias("version"))
    held = fingerprints.fingerprints(rows.where("page % 7 <> 3 or page % 5 = 0"), version="version")
    quantity = F.when((F.col("page") % 5 == 0) & (F.col("l_linenumber") == 1), F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    late = (F.col("page") % 11 == 4) & (F.col("page") % 5 != 0) & (F.col("page") % 7 != 3)
    fresh = rows.withColumns({"version": F.when(late, 1).otherwise(2), "l_quantity": F.when(late, F.col("l_quantity") * 2).otherwise(quantity)})
    shuffled = fresh.repartition("l_linenumber").select("version", "l_quantity", "l_partkey", "l_linenumber", "l_orderkey", "page")
    return fingerprints.changes(fingerprints.fingerprints(shuffled, version="version"), held)
