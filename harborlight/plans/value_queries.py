"""Named queries of values, dates, details and courses, over texts and numbers of the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import testbed
from ..functions import dates, numbers, text
from ..operators import alarms, corridor, course, federate, predicates, store
from ..sources import enc, lightlist, openseamap, stations
from .queries import CORRIDOR, FIXES, LEGS, POI, ROUTE_SQL, _found, hav, poi, query, whole
from .source_queries import STATION
from .text_queries import _AS_OF, shown

# Numbers


@query(
    "positive_capped", f"select event_id, {whole('least(case when v > 0 then v else 7e0 end, 5e1)', '1e2')} as cents from (select event_id, value - 3e1 as v from events)",
)
def positive_capped(spark, sf_dir):
    rows = testbed.table(spark, sf_dir, "events").select("event_id", (F.col("value") - 30).alias("v"))
    return rows.select("event_id", numbers.scaled(numbers.capped(F.col("v"), 50, 7), 100.0).alias("cents"))


@query(
    "display_lengths",
    """select p_partkey, cast(floor(feet * 1e2 + 0.5e0) as bigint) as feet_100, cast(floor(floor(feet * 3048e-4 * 1e4 + 0.5e0) / 1e4 * 1e4 + 0.5e0) as bigint) as metres_10000
      from (select p_partkey, floor(p_retailprice / 3048e-4 * 1e2 + 0.5e0) / 1e2 as feet from part)""",
)
def display_lengths(spark, sf_dir):
    feet = numbers.display_length(F.col("p_retailprice"), True)
    rows = testbed.table(spark, sf_dir, "part").select("p_partkey", feet.alias("feet"))
    return rows.select("p_partkey", numbers.scaled(F.col("feet"), 100.0).alias("feet_100"), numbers.scaled(numbers.stored_length(F.col("feet"), True), 1e4).alias("metres_10000"))


@query(
    "safe_integers",
    """select event_id, coalesce(case when regexp_matches(v, '^[1-9][0-9]{0,15}$') and v::hugeint <= 9007199254740991 then v::bigint end, -1) as n from
      (select event_id, case event_id % 4 when 0 then '0' || event_id when 1 then (9007199254740991 + (event_id % 9) - 4)::string when 2 then event_id::string else '-' || event_id end as v from events)""",
)
def safe_integers(spark, sf_dir):
    e = F.col("event_id")
    v = F.when(e % 4 == 0, F.concat(F.lit("0"), e)).when(e % 4 == 1, (F.lit(9007199254740991) + e % 9 - 4).cast("string")).when(e % 4 == 2, e.cast("string")).otherwise(F.concat(F.lit("-"), e))
    return testbed.table(spark, sf_dir, "events").select("event_id", F.coalesce(numbers.safe_positive_integer(v), F.lit(-1)).alias("n"))


@query(
    "rounded_and_clamped",
    "select event_id, cast(floor(value * 1e1 + 0.5e0) as bigint) as tenths, cast(floor(greatest(2e1, least(6e1, value)) * 1e3 + 0.5e0) as bigint) as clamped from events",
)
def rounded_and_clamped(spark, sf_dir):
    v = F.col("value")
    rounded = F.floor(numbers.round_half_up(v, 1) * 10 + 0.5).cast("long")
    return testbed.table(spark, sf_dir, "events").select("event_id", rounded.alias("tenths"), numbers.scaled(numbers.clamped(v, 20.0, 60.0, 30.0), 1e3).alias("clamped"))


@query(
    "heights_by_unit",
    """select p_partkey, coalesce(cast(floor(case when m > 0 then m end * 1e3 + 0.5e0) as bigint), -1) as mm from (select p_partkey, case p_partkey % 4
      when 0 then (p_size - 3) * 3048e-4 when 1 then cast(p_size - 3 as double) when 2 then null else (p_size - 3) * 3048e-4 end as m from part)""",
)
def heights_by_unit(spark, sf_dir):
    k = F.col("p_partkey") % 4
    unit = F.when(k == 0, " Feet ").when(k == 1, "METERS").when(k == 2, "Fathom").otherwise("ft")
    height = numbers.height_m((F.col("p_size") - 3).cast("double"), unit)
    return testbed.table(spark, sf_dir, "part").select("p_partkey", F.coalesce(numbers.scaled(height, 1e3), F.lit(-1)).alias("mm"))


# Texts


@query("route_ids", "select page_id, coalesce(list_filter(string_split(url, '/'), lambda p: len(p) > 0)[-1], '-') as route_id from pages")
def route_ids(spark, sf_dir):
    return testbed.table(spark, sf_dir, "pages").select("page_id", shown(text.route_id(F.col("url"))).alias("route_id"))


@query(
    "page_links",
    """select page_id, coalesce(case when lower(regexp_extract(trim(v), '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) in ('http', 'https', 'mailto', 'tel') then trim(v) end, '-') as url
      from (select page_id, case page_id % 4 when 0 then ' ' || url when 1 then upper(url) when 2 then 'ftp:' || url else substr(url, page_id % 9) end as v from pages)""",
)
def page_links(spark, sf_dir):
    k = F.col("page_id") % 4
    v = F.when(k == 0, F.concat(F.lit(" "), F.col("url"))).when(k == 1, F.upper("url")).when(k == 2, F.concat(F.lit("ftp:"), F.col("url")))
    v = v.otherwise(F.expr("substr(url, cast(page_id % 9 as int))"))
    return testbed.table(spark, sf_dir, "pages").select("page_id", shown(text.safe_link(v)).alias("url"))


@query(
    "document_ids",
    "select doc_id, case when regexp_matches(v, '^[A-Za-z0-9_-]+$') then v else 'escaped.' || case when v = '' then '_' else rtrim(translate(base64(encode(v)), '+/', '-_'), '=') end end as path_id "
    "from (select doc_id, substr(text, 1 + doc_id % 40, doc_id % 7) as v from documents where text is not null)",
)
def document_ids(spark, sf_dir):
    rows = testbed.table(spark, sf_dir, "documents").where("text is not null").selectExpr("doc_id", "substr(text, cast(1 + doc_id % 40 as int), cast(doc_id % 7 as int)) as v")
    return rows.select("doc_id", text.path_id(F.col("v")).alias("path_id"))


@query(
    "escaped_documents",
    """select doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) as digest,
      upper(substr(text, 1, 1)) || substr(text, 2, 20) as start, translate(substr(text, 1, 30), '_', ' ') as spaced from documents where text is not null and text <> ''""",
)
def escaped_documents(spark, sf_dir):
    t = F.col("text")
    return testbed.table(spark, sf_dir, "documents").where("text is not null and text <> ''").select(
        "doc_id", F.md5(text.escaped(t).cast("binary")).alias("digest"), F.substring(text.capital_first(t), 1, 21).alias("start"), text.spaced_enum(F.substring(t, 1, 30)).alias("spaced")
    )


@query(
    "distinct_endpoints",
    "select p_partkey, case when p_partkey % 3 = 0 then 'https://a.example/' || (p_partkey % 5) || ' http://b.example' else 'http://b.example https://a.example/' || (p_partkey % 5) end as urls from part",
)
def distinct_endpoints(spark, sf_dir):
    k = F.col("p_partkey")
    a, b = F.concat(F.lit(" https://a.example/"), k % 5), F.lit("http://b.example ")
    urls = F.when(k % 3 == 0, F.array(a, b, F.trim(a), F.lit("ftp://c.example"))).otherwise(F.array(F.lit(""), b, F.lit("http://u:p@d.example"), b, a))
    return testbed.table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.distinct_endpoints(urls), " ").alias("urls"))


# Dates

_PHRASE = """case when ts is null then 'an unknown time ago'
  when u = 'second' and n = 0 then 'now' when u = 'day' and n = -1 then 'yesterday' when u = 'day' and n = 1 then 'tomorrow'
  when u in ('month', 'year') and n = -1 then 'last ' || u when u in ('month', 'year') and n = 1 then 'next ' || u
  when n < 0 then abs(n) || ' ' || u || case when n = -1 then '' else 's' end || ' ago' else 'in ' || n || ' ' || u || case when n = 1 then '' else 's' end end"""
#: The largest unit that fits once rounding has spilled over, by the least span that is told in it.
_SPANS = (("year", 31104000, 30326400), ("month", 2592000, 2548800), ("day", 86400, 84600), ("hour", 3600, 3570), ("minute", 60, 60))
_UNIT = "case " + " ".join(f"when a >= {least}e0 then '{u}'" for u, _, least in _SPANS) + " else 'second' end"
_AMOUNT = "case u " + " ".join(f"when '{u}' then cast(floor(s / {n}e0 + 0.5e0) as bigint)" for u, n, _ in _SPANS) + " else cast(s as bigint) end"


@query(
    "ago_phrases",
    f"select event_id, {_PHRASE} as phrase from (select *, {_AMOUNT} as n from (select *, {_UNIT} as u from (select *, abs(s) as a from times)))",
    f"""times as (select event_id, ts, floor((epoch_ms(ts) - epoch_ms(timestamp '{_AS_OF}')) / 1e3 + 0.5e0) as s from (select event_id, case when event_id % 11 <> 0 then
      timestamp '{_AS_OF}' + to_seconds(cast(case event_id % 5 when 0 then event_id % 200 - 100 when 1 then (event_id % 90 - 45) * 3000 when 2 then (event_id % 101 - 50) * 86000
        when 3 then (event_id % 101 - 50) * 2600000 else (event_id % 11 - 5) * 31000000 end as bigint)) end as ts from events))""",
)
def ago_phrases(spark, sf_dir):
    shift = F.expr(
        "case event_id % 5 when 0 then event_id % 200 - 100 when 1 then (event_id % 90 - 45) * 3000 when 2 then (event_id % 101 - 50) * 86000 "
        "when 3 then (event_id % 101 - 50) * 2600000 else (event_id % 11 - 5) * 31000000 end"
    )
    as_of = F.lit(_AS_OF).cast("timestamp")
    ts = F.when(F.col("event_id") % 11 != 0, F.timestamp_seconds(F.unix_timestamp(as_of) + shift))
    return testbed.table(spark, sf_dir, "events").select("event_id", dates.ago_phrase(ts, as_of).alias("phrase"))


@query(
    "api_dates",
    """select event_id, case event_id % 5 when 0 then '-' else strftime(date_trunc('second', case when event_id % 5 = 2 then ts - interval 2 hours else ts end), '%Y-%m-%d %H:%M:%S') end as at from events""",
)
def api_dates(spark, sf_dir):
    k, iso = F.col("event_id") % 5, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(k == 0, F.lit("2024-01-01T:::")).when(k == 1, iso).when(k == 2, F.concat(iso, F.lit("+02:00"))).when(k == 3, F.concat(iso, F.lit(".250"))).otherwise(F.concat(iso, F.lit("Z")))
    return testbed.table(spark, sf_dir, "events").select("event_id", shown(F.date_format(dates.api_date(raw), "yyyy-MM-dd HH:mm:ss")).alias("at"))


# Selections


@query("required_types", "select id, type from poi where type in ('Marina', 'Business', 'Hazard', 'Bridge', 'Lock')", POI)
def required_types(spark, sf_dir):
    chosen = predicates.selected_kinds({"Marina": True, "Business": True, "Hazard": True})
    return poi(spark, sf_dir).where(predicates.of_kinds(F.col("type"), predicates.with_required(chosen, list(corridor.KINDS)))).select("id", "type")


@query(
    "enabled_stations", "select 'tide_' || case k % 6 when 1 then 'A B' || k else k::string end as id from raw where k % 6 <> 0 and lat between -90 and 90 and lng is not null", STATION.sql(),
)
def enabled_stations(spark, sf_dir):
    rows = STATION.rows(spark, sf_dir)
    both = stations.summaries(rows, "tide").unionByName(stations.summaries(rows, "current"))
    return stations.of_kinds(both, stations.enabled_kinds(True, False)).select("id")


@query(
    "us_source_gate",
    """select id, not (lat is null or (lat between 24e0 and 495e-1 and lon between -1255e-1 and -66e0)) as skipped from
      (select id, case when seq % 9 <> 0 then lat + (seq % 3) * 4e0 end as lat, lon from poi)""", POI,
)
def us_source_gate(spark, sf_dir):
    lat = F.when(F.col("seq") % 9 != 0, F.col("lat") + (F.col("seq") % 3) * 4.0)
    return poi(spark, sf_dir).select("id", predicates.outside_us_gate(lat, F.col("lon")).alias("skipped"))


@query("seamark_groups", "select k, k % 4 in (0, 1) or (k % 4 = 2 and k % 3 = 0) as wanted from (select p_partkey as k from part)")
def seamark_groups(spark, sf_dir):
    k = F.col("p_partkey")
    mark = F.element_at(F.array(*map(F.lit, ("rock", "wreck", "none", "bridge"))), (k % 4 + 1).cast("int"))
    leisure = F.when((k % 4 == 2) & (k % 3 == 0), F.lit("marina")).otherwise(F.lit("no"))
    tags = F.map_from_arrays(F.array(F.lit("seamark:type"), F.lit("leisure")), F.array(mark, leisure))
    return testbed.table(spark, sf_dir, "part").select(k.alias("k"), openseamap.of_groups(tags, ["rock", "wreck"], True).alias("wanted"))


@query(
    "layer_numbers",
    """select p_partkey as k, coalesce(case p_partkey % 4 when 0 then wreck when 1 then obstruction when 2 then rock end, -1) as number from part left join
      (values ('overview', 24, 21, 22, 0), ('general', 29, 26, 27, 1), ('coastal', 33, 30, 31, 2), ('approach', 39, 36, 37, 3), ('harbour', 36, 33, 34, 4), ('berthing', 21, 19, 20, 5)) t(band, wreck, obstruction, rock, n)
      on n = p_partkey % 7""",
)
def layer_numbers(spark, sf_dir):
    """The layer to ask for, by scale band and kind; there is no seventh band and no fourth kind."""
    k = F.col("p_partkey")
    of = lambda names: F.get(F.array(*map(F.lit, names)), (k % (len(names) + 1)).cast("int"))
    number = enc.layer_number(of(list(enc.BAND_LAYERS)), of(list(enc.LAYERS)))
    return testbed.table(spark, sf_dir, "part").select(k.alias("k"), F.coalesce(number.cast("int"), F.lit(-1)).alias("number"))


@query(
    "pinned_pages",
    """select p_partkey as k from part join (values ('D01', 10), ('D02', 4), ('D05', 9), ('D07', 15), ('D08', 10), ('D09', 5), ('D11', 2), ('D13', 3), ('D14', 1), ('D17', 2)) t(district, last)
      on district = 'D' || lpad((p_partkey % 19)::string, 2, '0') where p_partkey % 17 between 1 and last""",
)
def pinned_pages(spark, sf_dir):
    k = F.col("p_partkey")
    page = F.concat(F.lit("D"), F.lpad((k % 19).cast("string"), 2, "0"), F.lit("_"), (k % 17).cast("string"))
    return testbed.table(spark, sf_dir, "part").where(lightlist.pinned(page)).select(k.alias("k"))


# Details, routes and states


@query("corridor_order", "select id, cast(row_number() over (order by along_m, leg, seq) as int) as place from (select f.*, p.seq from found f join poi p using (id))", POI, ROUTE_SQL, LEGS, CORRIDOR)
def corridor_order(spark, sf_dir):
    return corridor.in_order(_found(spark, sf_dir)).select("id", "place")


_STATES = """loose as (select case when event_id % 17 <> 2 then vessel end as vessel, date_trunc('minute', ts) as ts, event_id, lat, sog from fixes),
states as (select * from loose where event_id % 4 <> 0), points as (select vessel, ts, event_id from loose where event_id % 4 = 0)"""


@query(
    "vessel_state_asof",
    f"select p.event_id, coalesce({whole('s.lat', '1e6')}, -1) as lat_e6, coalesce({whole('s.sog', '1e3')}, -1) as sog_e3 from points p asof left join "
    "(select vessel, ts, max_by(lat, event_id) as lat, max_by(sog, event_id) as sog from states group by vessel, ts) s on p.vessel = s.vessel and p.ts >= s.ts",
    FIXES, _STATES,
)
def vessel_state_asof(spark, sf_dir):
    """Points and states without a vessel, and many of one time: of those the last event counts."""
    vessel = F.when(F.col("event_id") % 17 != 2, F.col("vessel"))
    fixes = testbed.fixes(spark, sf_dir).withColumns({"vessel": vessel, "ts": F.date_trunc("minute", "ts")})
    found = alarms.as_of(fixes.where("event_id % 4 = 0").select("vessel", "ts", "event_id"), fixes.where("event_id % 4 <> 0"), ["lat", "sog"], ["event_id"])
    return found.select("event_id", F.coalesce(numbers.scaled(F.col("last_lat"), 1e6), F.lit(-1)).alias("lat_e6"), F.coalesce(numbers.scaled(F.col("last_sog"), 1e3), F.lit(-1)).alias("sog_e3"))


@query("effective_air_draft", f"select event_id, {whole('case when air_draft > 0 then air_draft else 42e-1 end', '1e1')} as draft_dm from fixes", FIXES)
def effective_air_draft(spark, sf_dir):
    draft = predicates.effective_air_draft(F.col("air_draft"), 4.2)
    return testbed.fixes(spark, sf_dir).select("event_id", numbers.scaled(draft, 10.0).alias("draft_dm"))


@query("scan_box", f"select id from poi where {hav('lat', 'lon', '42.01e0', '-70.99e0')} <= 2e3 and type = 'Hazard'", POI)
def scan_box(spark, sf_dir):
    """What lies within the scan radius of a fix: 2000 m for an alarm radius of 500 m."""
    here = spark.createDataFrame([(42.01, -70.99)], "lat double, lon double")
    hazards = poi(spark, sf_dir).where("type = 'Hazard'").select("id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    return alarms.within(here, hazards, alarms.scan_radius(500.0)).select("id")


@query(
    "waypoints_ahead",
    """select c.vessel, cast(p.at - least(greatest(coalesce(c.i, 0), 0), n - 1) as int) as seq, cast(p.lat as bigint) as lat, cast(p.lon as bigint) as lon from courses c
      join (select *, count(*) over (partition by route) as n from (select route, lat, lon, row_number() over (partition by route order by k) - 1 as at from stops where lat <= 90)) p
        on c.route = p.route and c.vessel % 2 = 0 and p.at >= least(greatest(coalesce(c.i, 0), 0), n - 1)
      union all
      select c.vessel, cast(p.at - least(greatest(coalesce(c.i, 0), 0), n - 1) as int), cast(p.lat as bigint), cast(p.lon as bigint) from courses c
      join (select *, count(*) over (partition by route) as n from (select route, lat, lon, row_number() over (partition by route order by k desc) - 1 as at from stops where lat <= 90)) p
        on c.route = p.route and c.vessel % 2 = 1 and p.at >= least(greatest(coalesce(c.i, 0), 0), n - 1)""",
    "courses as (select c_custkey as vessel, c_custkey % 40 as route, case c_custkey % 5 when 0 then null when 1 then -2 else c_custkey % 7 end as i from customer)",
    "stops as (select s_suppkey % 40 as route, s_suppkey as k, case when s_suppkey % 9 = 0 then 95 else s_suppkey % 80 end as lat, s_suppkey % 170 as lon from supplier)",
)
def waypoints_ahead(spark, sf_dir):
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    stops = testbed.table(spark, sf_dir, "supplier").select((s % 40).alias("route_id"), s.alias("k"), F.array((s % 170).cast("double"), F.when(s % 9 == 0, 95.0).otherwise(s % 80)).alias("c"))
    routes = stops.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("s")).select("route_id", F.col("s.c").alias("coordinates"))
    index = F.when(c % 5 == 0, F.lit(None)).when(c % 5 == 1, -2).otherwise(c % 7)
    courses = testbed.table(spark, sf_dir, "customer").select(c.alias("vessel"), (c % 40).alias("route_id"), (c % 2 == 1).alias("reverse"), index.alias("point_index"))
    return course.waypoints_ahead(testbed.spread(courses, "vessel"), routes).select("vessel", "seq", F.col("lat").cast("long").alias("lat"), F.col("lon").cast("long").alias("lon"))


@query("page_repairs", "select l_orderkey % 97 as page from lineitem group by 1 having (l_orderkey % 97) % 6 = 0 or (l_orderkey % 97) % 7 = 1")
def page_repairs(spark, sf_dir):
    rows = testbed.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 97).alias("page"))
    known = rows.groupBy("page").agg(F.count("*").alias("n_rows")).where("page % 6 <> 0").withColumn("n_rows", F.when(F.col("page") % 7 == 1, 0).otherwise(F.col("n_rows")))
    return store.disagreeing_pages(rows, known)


@query("record_counts", "select source, count(*) as records from poi group by source", POI)
def record_counts(spark, sf_dir):
    return store.record_counts(poi(spark, sf_dir), "source")


@query("once_per_route", "select id, source as owner, substr(id, strpos(id, '-') + 1) as raw_id from poi where source <> 'noaaenc'", POI)
def once_per_route(spark, sf_dir):
    base = poi(spark, sf_dir)
    tables = [(name, base.where(F.col("source") == name).select(F.split("id", "-")[1].alias("id"), F.split("id", "-")[1].alias("raw"))) for name in ("activecaptain", "openseamap")]
    return federate.details_of(base.select("id"), tables).select("id", "owner", F.col("raw").alias("raw_id"))
