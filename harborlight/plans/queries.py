"""Named queries over the driver's tables, each with the SQL that DuckDB runs for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import folders, testbed
from ..boxes import Box
from ..functions import dates, geo, numbers, text
from ..operators import alarms, corridor, dedupe, federate, predicates, throttle, zorder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str, *ctes: str):
    """Register a query and its SQL, which may use the named common table expressions."""

    def register(run: Query) -> Query:
        QUERIES[name] = run
        SQL[name] = (f"with {', '.join(ctes)} " if ctes else "") + sql
        return run

    return register


POI, FIXES = testbed.POI_SQL, testbed.FIXES_SQL
BOX = {"south": 42.004, "north": 42.013, "west": -70.996, "east": -70.985}
DEDUPE = ["openseamap", "noaaenc"]


def hav(a: str, b: str, c: str, d: str) -> str:
    """SQL of the distance between (a, b) and (c, d)."""
    h = (
        f"(power(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * "
        f"power(sin(radians(({d}) - ({b})) / 2), 2))"
    )
    return f"(12742000e0 * atan2(sqrt({h}), sqrt(greatest(0e0, 1e0 - {h}))))"


def bear(a: str, b: str, c: str, d: str) -> str:
    return (
        f"atan2(sin(radians(({d}) - ({b}))) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - "
        f"sin(radians({a})) * cos(radians({c})) * cos(radians(({d}) - ({b}))))"
    )


def whole(x: str, per: str) -> str:
    return f"cast(floor(({x}) * {per} + 0.5e0) as bigint)"


def poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testbed.poi(spark, sf_dir)


# Filters


@query("bbox_list", "select id, type, name from poi where lat between 42.004e0 and 42.013e0 and lon between -70.996e0 and -70.985e0", POI)
def bbox_list(spark, sf_dir):
    return poi(spark, sf_dir).where(geo.in_bbox(F.col("lat"), F.col("lon"), **BOX)).select("id", "type", "name")


def _spread(df: DataFrame) -> DataFrame:
    """Points spread over the whole globe."""
    return df.select("id", (F.col("seq") * 7919 % 17999 / 100.0 - 90).alias("lat"), (F.col("seq") * 104729 % 35999 / 100.0 - 180).alias("lon"))


SPREAD = "spread as (select id, (seq * 7919 % 17999) / 1e2 - 90 as lat, (seq * 104729 % 35999) / 1e2 - 180 as lon from poi)"


@query("bbox_wrap", "select id from spread where lat between -40e0 and 55e0 and (lon >= 160e0 or lon <= -150e0)", POI, SPREAD)
def bbox_wrap(spark, sf_dir):
    return _spread(poi(spark, sf_dir)).where(geo.in_bbox(F.col("lat"), F.col("lon"), -40.0, 55.0, 160.0, -150.0)).select("id")


@query(
    "us_waters_gate",
    """select id, (lat between 24e0 and 495e-1 and lon between -1255e-1 and -66e0) or (lat between 51e0 and 72e0 and lon between -180e0 and -129e0)
      or (lat between 51e0 and 56e0 and lon between 172e0 and 180e0) or (lat between 185e-1 and 23e0 and lon between -161e0 and -1545e-1)
      or (lat between 175e-1 and 187e-1 and lon between -675e-1 and -645e-1) or (lat between 13e0 and 21e0 and lon between 1445e-1 and 1465e-1) as inside from spread""", POI, SPREAD,
)
def us_waters_gate(spark, sf_dir):
    return _spread(poi(spark, sf_dir)).select("id", predicates.in_us_waters(F.col("lat"), F.col("lon")).alias("inside"))


@query("type_select", "select id, type from poi where type in ('Hazard', 'Lock', 'Marina')", POI)
def type_select(spark, sf_dir):
    kinds = predicates.selected_kinds({"Hazard": True, "Lock": True, "Marina": True, "Bridge": False})
    return poi(spark, sf_dir).where(predicates.of_kinds(F.col("type"), kinds)).select("id", "type")


@query("rating_filter", "select id, rating from poi where type not in ('Marina', 'Anchorage', 'Business', 'BoatRamp') or coalesce(rating >= 3, false)", POI)
def rating_filter(spark, sf_dir):
    return poi(spark, sf_dir).where(predicates.rated(F.col("type"), F.col("rating"), 3.0)).select("id", "rating")


@query("year_filter", "select id, coalesce(year(ts), 0)::int as y from poi where ts is null or year(ts) >= 2020", POI)
def year_filter(spark, sf_dir):
    return poi(spark, sf_dir).where(dates.in_or_after_year(F.col("ts"), 2020)).select("id", F.coalesce(F.year("ts"), F.lit(0)).alias("y"))


@query("valid_coords", "select id from (select id, lat * 2.1423e0 as a, lon * 2.5353e0 as b from poi) where a between -90 and 90 and b between -180 and 180", POI)
def valid_coords(spark, sf_dir):
    wide = poi(spark, sf_dir).select("id", (F.col("lat") * 2.1423).alias("a"), (F.col("lon") * 2.5353).alias("b"))
    return wide.where(predicates.valid_latitude(F.col("a")) & predicates.valid_longitude(F.col("b"))).select("id")


# Geometry


@query("haversine", f"select id, {whole(hav('lat', 'lon', '42.01e0', '-70.99e0'), '1e3')} as mm from poi", POI)
def haversine(spark, sf_dir):
    d = geo.haversine_m(F.col("lat"), F.col("lon"), F.lit(42.01), F.lit(-70.99))
    return poi(spark, sf_dir).select("id", numbers.scaled(d, 1e3).alias("mm"))


_PROJECTED = """
p1 as (select id, radians(lat) as p, radians(lon) as l, radians(seq % 360) as b, (seq % 5000 + 1) / 6371000e0 as d from spread),
p2 as (select *, asin(least(1e0, greatest(-1e0, sin(p) * cos(d) + cos(p) * sin(d) * cos(b)))) as q from p1),
p3 as (select id, degrees(q) as a, degrees(l + atan2(sin(b) * sin(d) * cos(p), cos(d) - sin(p) * sin(q))) as o from p2)"""
_SPREAD_SEQ = SPREAD.replace("select id,", "select id, seq,")


@query(
    "project_position",
    f"select id, {whole('a', '1e6')} as lat_e6, "
    f"{whole('case when o between -180 and 180 then o when o > 180 then o - 360 else o + 360 end', '1e6')} as lon_e6 from p3",
    POI, _SPREAD_SEQ, _PROJECTED,
)
def project_position(spark, sf_dir):
    base = poi(spark, sf_dir)
    spread = _spread(base).join(base.select("id", "seq"), "id")
    to = geo.projected(F.col("lat"), F.col("lon"), (F.col("seq") % 360).cast("double"), (F.col("seq") % 5000 + 1).cast("double"))
    return spread.withColumn("to", to).select("id", numbers.scaled(F.col("to.lat"), 1e6).alias("lat_e6"), numbers.scaled(F.col("to.lon"), 1e6).alias("lon_e6"))


def _corner(bearing: str, alias: str) -> str:
    d = "(500e0 * sqrt(2e0) / 6371000e0)"
    q = f"asin(sin(radians(lat)) * cos({d}) + cos(radians(lat)) * sin({d}) * cos(radians({bearing})))"
    o = f"degrees(radians(lon) + atan2(sin(radians({bearing})) * sin({d}) * cos(radians(lat)), cos({d}) - sin(radians(lat)) * sin({q})))"
    return f"{whole(f'degrees({q})', '1e6')} as lat_{alias}, {whole(o, '1e6')} as lon_{alias}"


@query("position_bbox", f"select id, {_corner('-45e0', 'nw')}, {_corner('135e0', 'se')} from poi", POI)
def position_bbox(spark, sf_dir):
    box = geo.enclosing_bbox(F.col("lat"), F.col("lon"), F.lit(500.0))
    e6 = lambda name, alias: numbers.scaled(F.col(f"box.{name}"), 1e6).alias(alias)
    return poi(spark, sf_dir).withColumn("box", box).select("id", e6("north", "lat_nw"), e6("west", "lon_nw"), e6("south", "lat_se"), e6("east", "lon_se"))


@query("bearing", f"select id, {whole('degrees(' + bear('42.01e0', '-70.99e0', 'lat', 'lon') + ')', '1e4')} as deg_e4 from poi", POI)
def bearing(spark, sf_dir):
    b = F.degrees(geo.bearing_rad(F.lit(42.01), F.lit(-70.99), F.col("lat"), F.col("lon")))
    return poi(spark, sf_dir).select("id", numbers.scaled(b, 1e4).alias("deg_e4"))


_TRACK = f"""
t1 as (select id, {hav('42.001e0', '-70.999e0', 'lat', 'lon')} / 6371000e0 as d,
  {bear('42.001e0', '-70.999e0', 'lat', 'lon')} - {bear('42.001e0', '-70.999e0', '42.018e0', '-70.982e0')} as t from poi),
t2 as (select *, asin(least(1e0, greatest(-1e0, sin(d) * sin(t)))) as x from t1)"""


@query(
    "track_projection",
    f"select id, {whole('x * 6371000e0', '1e1')} as cross_dm, "
    f"{whole('case when cos(t) >= 0 then 1 else -1 end * acos(least(1e0, greatest(-1e0, cos(d) / cos(x)))) * 6371000e0', '1e0')} as along_m from t2",
    POI, _TRACK,
)
def track_projection(spark, sf_dir):
    leg = geo.bearing_rad(F.lit(42.001), F.lit(-70.999), F.lit(42.018), F.lit(-70.982))
    on = geo.onto_leg(F.lit(42.001), F.lit(-70.999), leg, F.col("lat"), F.col("lon"))
    return poi(spark, sf_dir).withColumn("on", on).select("id", numbers.scaled(F.col("on.cross_m"), 1e1).alias("cross_dm"), numbers.scaled(F.col("on.along_m"), 1.0).alias("along_m"))


@query(
    "wrap_lon",
    f"select id, {whole('case when x between -180 and 180 then x when r = -180 and x > 0 then 180 else r end', '1e2')} as lon_e2 from "
    "(select *, case when x + 180 >= 0 then fmod(x + 180, 360) else fmod(fmod(x + 180, 360) + 360, 360) end - 180 as r from "
    "(select id, (seq % 1441 - 720)::double as x from poi))", POI,
)
def wrap_lon(spark, sf_dir):
    x = (F.col("seq") % 1441 - 720).cast("double")
    return poi(spark, sf_dir).select("id", numbers.scaled(geo.wrap_longitude(x), 1e2).alias("lon_e2"))


@query("lon_span", f"select id, {whole('case when e >= w then e - w else 360 - w + e end', '1e0')} as span from (select id, (seq % 361 - 180)::double as w, (seq * 7 % 361 - 180)::double as e from poi)", POI)
def lon_span(spark, sf_dir):
    w, e = (F.col("seq") % 361 - 180).cast("double"), (F.col("seq") * 7 % 361 - 180).cast("double")
    return poi(spark, sf_dir).select("id", numbers.scaled(geo.longitude_span(w, e), 1.0).alias("span"))


@query(
    "snap_tile",
    "select id, cast(floor(floor(lat * 1e7 + 0.5e0) / 1e6) as bigint) as south_10, cast(ceil(floor(lon * 1e7 + 0.5e0) / 1e6) as bigint) as east_10 from spread",
    POI, SPREAD,
)
def snap_tile(spark, sf_dir):
    return _spread(poi(spark, sf_dir)).select(
        "id", numbers.scaled(geo.snap_out(F.col("lat"), False), 10.0).alias("south_10"), numbers.scaled(geo.snap_out(F.col("lon"), True), 10.0).alias("east_10")
    )


@query("tile_key", "select id, cast(floor((lat + 90e0) * 10e0) as bigint) * 3600 + least(3599, cast(floor((lon + 180e0) * 10e0) as bigint)) as tile from spread", POI, SPREAD)
def tile_key(spark, sf_dir):
    return _spread(poi(spark, sf_dir)).select("id", geo.tile_key(F.col("lat"), F.col("lon")).alias("tile"))


_CURVE = "(select list_sum(list_transform(range(16), lambda b: (((c >> b) & 1) << (2 * b)) | (((r >> b) & 1) << (2 * b + 1)))))"


@query(
    "curve_key", "select id, cast(" + _CURVE + " as bigint) as key from (select id, least(65535, cast(floor((lon + 180e0) / 360e0 * 65536) as bigint)) as c, least(65535, cast(floor((lat + 90e0) / 180e0 * 65536) as bigint)) as r from spread)",
    POI, SPREAD,
)
def curve_key(spark, sf_dir):
    return _spread(poi(spark, sf_dir)).select("id", zorder.curve_key(F.col("lat"), F.col("lon")).alias("key"))


@query("curve_box", "select id from spread where lat between -20e0 and 35e0 and (lon >= 150e0 or lon <= -170e0)", POI, SPREAD)
def curve_box(spark, sf_dir):
    """A box over the antimeridian of a table that lies along the curve."""
    path = folders.scratch_path(spark, "curve")
    zorder.write(_spread(poi(spark, sf_dir)), path)
    return zorder.read(spark, path, Box(-20.0, 35.0, 150.0, -170.0)).select("id")


def _hull_sql(name: str, source: str, a: str, b: str) -> str:
    """SQL of the box around boxes a and b (columns a_s, a_n, a_w, a_e and so on) of each row, as h_s, h_n, h_w, h_e."""
    span = lambda x: f"(case when {x}_e >= {x}_w then {x}_e - {x}_w else 360 - {x}_w + {x}_e end)"
    wrap = lambda x: f"(case when {x} between -180 and 180 then {x} when fmod({x} + 540, 360) = 0 and {x} > 0 then 180 else fmod({x} + 540, 360) - 180 end)"
    tries = ", ".join(f"{{'o': {n}, 'lo': least({a}_w, {b}_w + {t}), 'hi': greatest({a}_w + {span(a)}, {b}_w + {t} + {span(b)})}}" for n, t in enumerate((-360, 0, 360)))
    return f"""{name}0 as (select *, list_sort(list_transform([{tries}], lambda t: {{'w': t.hi - t.lo, 'o': t.o, 'lo': t.lo, 'hi': t.hi}}))[1] as t,
      greatest({span(a)}, {span(b)}) as wide from {source}),
    {name} as (select * exclude (t, wide), least({a}_s, {b}_s) as {name}_s, greatest({a}_n, {b}_n) as {name}_n,
      case when greatest(wide, t.w) >= 360 then -180 when t.hi = t.lo and abs({wrap('t.lo')}) = 180 then 180 else {wrap('t.lo')} end as {name}_w,
      case when greatest(wide, t.w) >= 360 then 180 when t.hi = t.lo and abs({wrap('t.lo')}) = 180 then -180 else {wrap('t.hi')} end as {name}_e from {name}0)"""


_THREE = """three as (select *, lead(s, 1) over w as s2, lead(s, 2) over w as s3, lead(n, 1) over w as n2, lead(n, 2) over w as n3, lead(west, 1) over w as w2, lead(west, 2) over w as w3,
  lead(east, 1) over w as e2, lead(east, 2) over w as e3 from (select event_id, event_id // 3 as grp, (event_id * 37 % 120 - 60)::double as s, (event_id * 37 % 120 - 60 + event_id % 20)::double as n,
    (event_id * 101 % 1441 / 4e0 - 180) as west, case when event_id % 97 = 5 then null else (select case when x > 180 then x - 360 else x end from (select event_id * 101 % 1441 / 4e0 - 180 + event_id * 7 % 800 / 4e0 as x)) end as east
  from events) window w as (partition by grp order by event_id)),
rows3 as (select grp, s as a_s, n as a_n, west as a_w, east as a_e, s2 as b_s, n2 as b_n, w2 as b_w, e2 as b_e, s3 as c_s, n3 as c_n, w3 as c_w, e3 as c_e from three where event_id % 3 = 0 and s3 is not null)"""


@query(
    "joined_boxes",
    """select grp, case when bad then -1 else cast(hh_w * 4 + 720 as bigint) end as west_4, case when bad then -1 else cast(hh_e * 4 + 720 as bigint) end as east_4, case when bad then -1 else cast(hh_s + 90 as bigint) end as south_90,
      case when bad then -1 else cast(hh_n + 90 as bigint) end as north_90 from (select *, a_e is null or b_e is null or c_e is null as bad from hh)""",
    _THREE, _hull_sql("h", "rows3", "a", "b"), _hull_sql("hh", "h", "h", "c"),
)
def joined_boxes(spark, sf_dir):
    """The boxes of three askers as one, over the antimeridian where that is narrower; one without an edge leaves none."""
    e = F.col("event_id")
    west = e * 101 % 1441 / 4.0 - 180
    east = west + e * 7 % 800 / 4.0
    box = F.struct(
        (e * 37 % 120 - 60).cast("double").alias("south"), (e * 37 % 120 - 60 + e % 20).cast("double").alias("north"), west.alias("west"),
        F.when(e % 97 != 5, F.when(east > 180, east - 360).otherwise(east)).alias("east"),
    )
    asked = testbed.table(spark, sf_dir, "events").select(F.floor(e / 3).alias("grp"), F.struct(e, box.alias("box")).alias("x"))
    each = asked.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["box"]).alias("boxes")).where(F.size("boxes") == 3)
    hull = each.select("grp", geo.boxes_hull(F.col("boxes")).alias("h"))
    cell = lambda x: F.coalesce(x.cast("long"), F.lit(-1))
    return hull.select("grp", cell(F.col("h.west") * 4 + 720).alias("west_4"), cell(F.col("h.east") * 4 + 720).alias("east_4"), cell(F.col("h.south") + 90).alias("south_90"), cell(F.col("h.north") + 90).alias("north_90"))


# Federation


@query(
    "federate_union",
    "select 'supplier-' || s_suppkey as id, s_name as name, 0 as rank from supplier union all select 'customer-' || c_custkey, c_name, 1 from customer",
)
def federate_union(spark, sf_dir):
    a = testbed.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    b = testbed.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return federate.union_sources([("supplier", a), ("customer", b)]).select("id", "name", "rank")


@query(
    "feature_dedupe_by_id",
    "select event_id, coalesce(object_id, -1) as object_id from (select event_id, object_id, case when object_id is null then 1 else "
    "row_number() over (partition by object_id order by event_id) end as n from "
    "(select event_id, case when event_id % 10 <> 3 then event_id % 2000 end as object_id from events)) where n = 1",
)
def feature_dedupe_by_id(spark, sf_dir):
    e = F.col("event_id")
    rows = testbed.table(spark, sf_dir, "events").select("event_id", F.when(e % 10 != 3, e % 2000).alias("object_id"))
    return federate.first_by_key(rows, ["object_id"], [e]).select("event_id", F.coalesce("object_id", F.lit(-1)).alias("object_id"))


@query(
    "last_file_wins",
    "select l_orderkey as id, l_partkey as value from (select *, row_number() over (partition by l_orderkey order by l_suppkey desc, l_linenumber desc, l_partkey desc) as n from lineitem) where n = 1",
)
def last_file_wins(spark, sf_dir):
    rows = testbed.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("value"), "l_suppkey", "l_linenumber")
    return federate.last_by_key(rows, ["id"], [F.col("l_suppkey"), F.col("l_linenumber"), F.col("value")]).select("id", "value")


@query("prune_catalog", "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def prune_catalog(spark, sf_dir):
    catalogue = testbed.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return federate.keep_known(testbed.table(spark, sf_dir, "orders"), catalogue, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("id_route", "select id, split_part(id, '-', 1) as owner, substr(id, strpos(id, '-') + 1) as raw_id from poi", POI)
def id_route(spark, sf_dir):
    return federate.routed(poi(spark, sf_dir).select("id"))


# Merging


def _cells_sql(radius: str) -> str:
    return f"""
mean as (select avg(lat) as m from poi),
cells as (select poi.*, cast(floor(lon * (111320e0 * cos(radians(m))) / {radius}) as bigint) as cx,
  cast(floor(lat * 111320e0 / {radius}) as bigint) as cy from poi, mean)"""


def _match_sql(radius: str) -> str:
    return f"""
matches as (
  select p.seq, arg_min(b.seq, [b.cx, b.cy, b.seq]) as base_seq
  from cells p join cells b on b.source = 'activecaptain' and p.source <> 'activecaptain' and p.type = b.type
    and b.cx between p.cx - 1 and p.cx + 1 and b.cy between p.cy - 1 and p.cy + 1
  where {hav('p.lat', 'p.lon', 'b.lat', 'b.lon')} <= {radius}
  group by p.seq)"""


CELLS, MATCHES = _cells_sql("45.72e0"), _match_sql("45.72e0")


def _cells(spark, sf_dir, radii=None):
    return dedupe.with_cells(poi(spark, sf_dir), radii or dedupe.Radii())


@query("dedupe_base", "select seq, base_seq from matches", POI, CELLS, MATCHES)
def dedupe_base(spark, sf_dir):
    return dedupe.base_matches(_cells(spark, sf_dir), DEDUPE, dedupe.Radii())


@query(
    "dedupe_per_source_radius", "select seq, base_seq from matches", POI, _cells_sql("90e0"),
    _match_sql("case when p.source = 'openseamap' then 20e0 else 90e0 end"),
)
def dedupe_per_source_radius(spark, sf_dir):
    radii = dedupe.Radii({"openseamap": 20.0, "noaaenc": 90.0})
    return dedupe.base_matches(_cells(spark, sf_dir, radii), DEDUPE, radii)


_SAME = f"""
left_over as (select * from cells where source <> 'activecaptain' and seq not in (select seq from matches)),
links as (
  select a.seq, b.seq as earlier, b.cx, b.cy from left_over a join left_over b on a.source = b.source and a.type = b.type and b.seq < a.seq
    and b.cx between a.cx - 1 and a.cx + 1 and b.cy between a.cy - 1 and a.cy + 1
  where {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 45.72e0),
nodes as (select row_number() over (order by seq) as i, seq, list(earlier) as earlier from links group by seq),
walk(i, gone) as (
  select 0::bigint, []::bigint[] union all
  select n.i, case when len(list_filter(n.earlier, lambda x: not list_contains(w.gone, x))) > 0 then list_append(w.gone, n.seq) else w.gone end
  from walk w join nodes n on n.i = w.i + 1),
dropped as (select unnest(gone) as seq from (select gone from walk order by i desc limit 1))"""


@query("dedupe_same_source", "select seq from dropped", "recursive " + POI.strip(), CELLS, MATCHES, _SAME)
def dedupe_same_source(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    left = cells.where(F.col("source") != dedupe.BASE_SOURCE).join(dedupe.base_matches(cells, DEDUPE, dedupe.Radii()), "seq", "left_anti")
    return dedupe.greedy_dropped(dedupe.same_source_links(left, DEDUPE, dedupe.Radii()))


_FULL = """
folded as (
  select base_seq, source, min(seq) as seq, min(clearance_m) as low, arg_min(attribution, seq) as attribution
  from matches join poi using (seq) group by base_seq, source),
per_base as (
  select base_seq, list(source order by seq) as sources, list(attribution order by seq) as attributions, min(low) as low from folded group by base_seq),
into_kept as (
  select arg_min(earlier, [cx, cy, earlier]) as kept, seq from links where seq in (select seq from dropped) and earlier not in (select seq from dropped) group by seq),
lows as (select kept as seq, min(clearance_m) as low from into_kept join poi using (seq) group by kept),
final as (
  select p.seq, p.id, array_to_string(list_concat([p.source], coalesce(b.sources, [])), ',') as sources,
    array_to_string(list_concat([p.attribution], coalesce(b.attributions, [])), '; ') as attribution,
    case when b.low is null then p.clearance_m when p.clearance_m is null then b.low else least(p.clearance_m, b.low) end as clearance_m
  from poi p left join per_base b on b.base_seq = p.seq where p.source = 'activecaptain'
  union all
  select p.seq, p.id, p.source, p.attribution,
    case when l.low is null then p.clearance_m when p.clearance_m is null then l.low else least(p.clearance_m, l.low) end
  from left_over p left join lows l on l.seq = p.seq where p.seq not in (select seq from dropped))"""


def _merged(spark, sf_dir):
    return dedupe.merged(poi(spark, sf_dir), DEDUPE)


@query("dedupe_full", "select id, sources, attribution from final", "recursive " + POI.strip(), CELLS, MATCHES, _SAME, _FULL)
def dedupe_full(spark, sf_dir):
    return _merged(spark, sf_dir).select("id", F.array_join("sources", ",").alias("sources"), "attribution")


@query(
    "dedupe_base_sources", "select base_seq, cast(len(sources) as bigint) as n_more from per_base", "recursive " + POI.strip(), CELLS, MATCHES, _SAME, _FULL
)
def dedupe_base_sources(spark, sf_dir):
    rows = _merged(spark, sf_dir).where((F.col("source") == dedupe.BASE_SOURCE) & (F.size("sources") > 1))
    return rows.select(F.col("seq").alias("base_seq"), (F.size("sources") - 1).cast("long").alias("n_more"))


@query("dedupe_min_clearance", f"select id, {whole('clearance_m', '1e1')} as clearance_dm from final where clearance_m is not null", "recursive " + POI.strip(), CELLS, MATCHES, _SAME, _FULL)
def dedupe_min_clearance(spark, sf_dir):
    return _merged(spark, sf_dir).where("clearance_m is not null").select("id", numbers.scaled(F.col("clearance_m"), 10.0).alias("clearance_dm"))


# Routes

ROUTE_SQL = "points(seq, lat, lon) as (values " + ", ".join(f"({k}, {a}e0, {b}e0)" for k, (a, b) in enumerate(testbed.ROUTE)) + ")"
LEGS = f"""
ends as (select *, lead(lat) over (order by seq) as lat2, lead(lon) over (order by seq) as lon2 from points),
legs as (
  select *, coalesce(sum(len) over (order by seq rows between unbounded preceding and 1 preceding), 0) as before from
  (select *, {hav('lat', 'lon', 'lat2', 'lon2')} as len, {bear('lat', 'lon', 'lat2', 'lon2')} as dir from ends) where len > 0)"""
CORRIDOR = f"""
on1 as (
  select p.seq, p.id, p.type, p.clearance_m, l.seq as leg, len, before, {hav('l.lat', 'l.lon', 'p.lat', 'p.lon')} / 6371000e0 as d,
    {bear('l.lat', 'l.lon', 'p.lat', 'p.lon')} - dir as t
  from poi p, legs l where p.type in ('Hazard', 'Bridge', 'Lock')),
on2 as (select *, asin(least(1e0, greatest(-1e0, sin(d) * sin(t)))) as x from on1),
on3 as (
  select *, x * 6371000e0 as cross_m, case when cos(t) >= 0 then 1 else -1 end * acos(least(1e0, greatest(-1e0, cos(d) / cos(x)))) * 6371000e0 as along from on2),
found as (
  select id, type, clearance_m, leg, cross_m, before + along as along_m from on3 where abs(cross_m) <= 300e0 and along between 0 and len
  qualify row_number() over (partition by id order by abs(cross_m), before + along, leg) = 1)"""


def _legs(spark):
    return corridor.legs_of(corridor.route_points(spark, testbed.ROUTE))


def _found(spark, sf_dir, sog=None):
    return corridor.corridor(poi(spark, sf_dir), _legs(spark), 300.0, sog)


@query("route_legs", f"select cast(seq as int) as leg, {whole('len', '1e1')} as length_dm, {whole('before', '1e1')} as before_dm from legs", ROUTE_SQL, LEGS)
def route_legs(spark, sf_dir):
    return _legs(spark).select("leg", numbers.scaled(F.col("length_m"), 10.0).alias("length_dm"), numbers.scaled(F.col("before_m"), 10.0).alias("before_dm"))


@query(
    "corridor_scan", f"select id, cast(leg as int) as leg, {whole('cross_m', '1e1')} as cross_dm, {whole('along_m', '1e0')} as along from found",
    POI, ROUTE_SQL, LEGS, CORRIDOR,
)
def corridor_scan(spark, sf_dir):
    return _found(spark, sf_dir).select("id", "leg", numbers.scaled(F.col("cross_m"), 10.0).alias("cross_dm"), numbers.scaled(F.col("along_m"), 1.0).alias("along"))


@query("corridor_eta", f"select id, {whole('along_m / 4e0', '1e0')} as eta_s from found", POI, ROUTE_SQL, LEGS, CORRIDOR)
def corridor_eta(spark, sf_dir):
    return _found(spark, sf_dir, 4.0).select("id", numbers.scaled(F.col("eta_s"), 1.0).alias("eta_s"))


@query("lookahead_filter", "select id, type from found where along_m <= 1500e0", POI, ROUTE_SQL, LEGS, CORRIDOR)
def lookahead_filter(spark, sf_dir):
    return corridor.ahead(_found(spark, sf_dir), 1500.0).select("id", "type")


DETAILS = "details as (select id, (seq % 97) / 1e1 as detail_clearance_m from poi where type = 'Bridge' and source = 'activecaptain')"


def _details(base: DataFrame) -> DataFrame:
    chosen = base.where("type = 'Bridge' and source = 'activecaptain'")
    return chosen.select("id", (F.col("seq") % 97 / 10.0).alias("detail_clearance_m"))


@query(
    "too_low_bridges",
    f"select id, {whole('c', '1e1')} as clearance_dm from (select f.id, coalesce(f.clearance_m, d.detail_clearance_m) as c from found f left join details d using (id) where type = 'Bridge') where c <= 9.5e0",
    POI, ROUTE_SQL, LEGS, CORRIDOR, DETAILS,
)
def too_low_bridges(spark, sf_dir):
    rows = corridor.too_low(_found(spark, sf_dir), _details(poi(spark, sf_dir)), 8.5, 1.0)
    return rows.select("id", numbers.scaled(F.col("clearance_m"), 10.0).alias("clearance_dm"))


@query(
    "clearance_resolve",
    f"select id, {whole('coalesce(clearance_m, detail_clearance_m)', '1e1')} as clearance_dm from poi left join details using (id) where type = 'Bridge' and coalesce(clearance_m, detail_clearance_m) is not null",
    POI, DETAILS,
)
def clearance_resolve(spark, sf_dir):
    base = poi(spark, sf_dir)
    both = base.where("type = 'Bridge'").join(_details(base), "id", "left")
    known = F.coalesce("clearance_m", "detail_clearance_m")
    return both.where(known.isNotNull()).select("id", numbers.scaled(known, 10.0).alias("clearance_dm"))


# Alarms over recorded fixes

TICKS = "ticks as (select *, row_number() over (partition by vessel order by ts, event_id) as tick from fixes)"
AIR = "air as (select *, last_value(air_draft ignore nulls) over (partition by vessel order by tick) as draft from ticks)"


def _ticks(spark, sf_dir):
    return alarms.numbered(testbed.fixes(spark, sf_dir), ["ts", "event_id"])


def _with_air_draft(ticks: DataFrame) -> DataFrame:
    return alarms.filled_forward(ticks, "air_draft")


def _alarm_sql(source: str, kind: str, holds: str) -> str:
    return f"""
pairs as (select f.vessel, f.tick, p.id, {hav('f.lat', 'f.lon', 'p.lat', 'p.lon')} as d, ({holds}) as holds from {source} f, poi p where p.type = '{kind}'),
marks as (select *, case when not coalesce(holds, false) or d > 600e0 then 0 when d <= 500e0 then 1 end as mark from pairs),
states as (select *, coalesce(last_value(mark ignore nulls) over (partition by vessel, id order by tick), 0) as state from marks),
turns as (select *, lag(state, 1, 0) over (partition by vessel, id order by tick) as was from states)"""


TRANSITIONS = "select vessel, id, cast(tick as int) as tick, case when state = 1 then 'raise' else 'clear' end as event from turns where state <> was"


def _turns(df: DataFrame) -> DataFrame:
    return df.select("vessel", "id", F.col("tick").cast("int").alias("tick"), "event")


@query(
    "proximity_in_range",
    f"select f.event_id, p.id, {whole(hav('f.lat', 'f.lon', 'p.lat', 'p.lon'), '1e1')} as dm from fixes f, poi p where p.type = 'Hazard' and {hav('f.lat', 'f.lon', 'p.lat', 'p.lon')} <= 500e0",
    POI, FIXES,
)
def proximity_in_range(spark, sf_dir):
    hazards = poi(spark, sf_dir).where("type = 'Hazard'").select("id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    near = alarms.within(testbed.fixes(spark, sf_dir).select("event_id", "lat", "lon"), hazards, 500.0, ["event_id"])
    return near.select("event_id", "id", numbers.scaled(F.col("distance_m"), 10.0).alias("dm"))


@query("proximity_alarm_transitions", TRANSITIONS, POI, FIXES, TICKS, _alarm_sql("ticks", "Hazard", "true"))
def proximity_alarm_transitions(spark, sf_dir):
    return _turns(alarms.proximity(_ticks(spark, sf_dir), poi(spark, sf_dir)))


@query(
    "alarm_episodes",
    "select vessel, id, cast(tick as int) as raised, cast(coalesce(cleared, -1) as int) as cleared from (select *, lead(tick) over (partition by vessel, id order by tick) as cleared from turns where state <> was) where state = 1",
    POI, FIXES, TICKS, AIR, _alarm_sql("air", "Bridge", "p.clearance_m <= f.draft + 1e0"),
)
def alarm_episodes(spark, sf_dir):
    """Since when each alarm of a bridge holds, and until when."""
    low = poi(spark, sf_dir).where("type = 'Bridge' and clearance_m is not null").select("id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), "clearance_m")
    found = alarms.episodes(_with_air_draft(_ticks(spark, sf_dir)), low, alarms.RADIUS_M, 1.0)
    return found.select("vessel", "id", F.col("raised").cast("int").alias("raised"), F.coalesce("cleared", F.lit(-1)).cast("int").alias("cleared"))


@query("bridge_alarm_transitions", TRANSITIONS, POI, FIXES, TICKS, AIR, _alarm_sql("air", "Bridge", "p.clearance_m <= f.draft + 1e0"))
def bridge_alarm_transitions(spark, sf_dir):
    return _turns(alarms.bridges(_with_air_draft(_ticks(spark, sf_dir)), poi(spark, sf_dir), 1.0))


@query("air_draft_asof", f"select event_id, coalesce({whole('draft', '1e1')}, -1) as draft_dm from air", FIXES, TICKS, AIR)
def air_draft_asof(spark, sf_dir):
    return _with_air_draft(_ticks(spark, sf_dir)).select(
        "event_id", F.coalesce(numbers.scaled(F.col("air_draft"), 10.0), F.lit(-1)).alias("draft_dm")
    )


_MESSAGES = "messages as (select vessel, event_type as id, tick, cast(floor(floor(value) / 20) as bigint) as message from ticks join events using (event_id) where tick % 7 <> 3)"


@query(
    "route_alarm_changes",
    "select vessel, id, cast(tick as int) as tick, message from (select *, lag(tick) over w as t0, lag(message) over w as m0 from messages window w as (partition by vessel, id order by tick)) where t0 is null or t0 <> tick - 1 or m0 <> message",
    FIXES, TICKS, _MESSAGES,
)
def route_alarm_changes(spark, sf_dir):
    events = testbed.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("id"), F.floor(F.floor("value") / 20).cast("long").alias("message"))
    rows = _ticks(spark, sf_dir).join(events, "event_id").where("tick % 7 <> 3").select("vessel", "id", "tick", "message")
    return alarms.message_changes(rows).select("vessel", "id", F.col("tick").cast("int").alias("tick"), "message")


@query(
    "clear_stale",
    "select distinct vessel, id from (select user_id % 10 as vessel, event_type as id, user_id from events where event_id % 2 = 0) a where not exists (select 1 from events b where b.event_id % 50 = 1 and b.user_id % 10 = a.vessel and b.event_type = a.id)",
)
def clear_stale(spark, sf_dir):
    events = testbed.table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("vessel"), F.col("event_type").alias("id"), "event_id")
    active = events.where("event_id % 2 = 0").select("vessel", "id").distinct()
    return alarms.cleared(active, events.where("event_id % 50 = 1").select("vessel", "id"))


ROUGH_SQL = """rough as (
  select case when event_id % 17 <> 2 then vessel end as vessel, event_id, date_trunc('minute', ts) as ts,
    case when event_id % 11 <> 3 then case when event_id % 29 = 4 then 'nan'::double else lat end end as lat, case when event_id % 13 = 5 then 999 else lon end as lon
  from fixes
)"""


def _rough(spark, sf_dir):
    """Fixes without a vessel or a position, with positions that are none, and with many of one time."""
    e = F.col("event_id")
    return testbed.fixes(spark, sf_dir).select(
        F.when(e % 17 != 2, F.col("vessel")).alias("vessel"), "event_id", F.date_trunc("minute", "ts").alias("ts"),
        F.when(e % 11 != 3, F.when(e % 29 == 4, float("nan")).otherwise(F.col("lat"))).alias("lat"), F.when(e % 13 == 5, 999.0).otherwise(F.col("lon")).alias("lon"),
    )


@query(
    "tick_throttle", "select vessel, event_id from walk", "recursive " + FIXES.strip(), ROUGH_SQL,
    """ordered as (select *, row_number() over (partition by vessel order by ts, event_id) as n from rough
  where vessel is not null and lat between -90 and 90 and not isnan(lat) and lon between -180 and 180)""",
    f"""walk(vessel, n, event_id, t, lat, lon) as (
  select vessel, n, event_id, ts, lat, lon from ordered where n = 1
  union all
  select vessel, n, event_id, ts, lat, lon from (
    select o.vessel, o.n, o.event_id, o.ts, o.lat, o.lon, row_number() over (partition by o.vessel order by o.n) as k
    from walk w join ordered o on o.vessel = w.vessel and o.n > w.n
    where o.ts >= w.t + interval 60 seconds and {hav('w.lat', 'w.lon', 'o.lat', 'o.lon')} >= 100e0) where k = 1)""",
)
def tick_throttle(spark, sf_dir):
    return throttle.throttled(_rough(spark, sf_dir), order=["event_id"]).select("vessel", "event_id")
