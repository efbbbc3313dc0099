"""Points of interest along a route: legs, the corridor join, and bridges that are too low."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..folders import checkpointed
from ..functions.geo import EARTH_RADIUS_M, band_of, bearing_rad, boxes_hull, columns_of, enclosing_bbox, haversine_m, onto_leg, projected
from .predicates import blocks_vessel

KINDS = ("Hazard", "Bridge", "Lock")
LOOK_AHEAD_M = 18_520.0
#: A route is a plan of one voyage; a longer one is refused.
MAX_POINTS = 100_000
#: Pieces of a leg, the smallest cell, and cells of legs that are broadcast (about 100 bytes each); more are joined by a shuffle.
PIECES, LEAST_CELL_M, BROADCAST_CELLS = 512, 100.0, 1 << 19


def legs_of(points: DataFrame) -> DataFrame:
    """Legs of routes (route_id, seq, lat, lon): bearing, length, and the route's length before each. Empty legs go."""
    by_route = Window.partitionBy("route_id").orderBy("seq")
    legs = points.withColumns({"end_lat": F.lead("lat").over(by_route), "end_lon": F.lead("lon").over(by_route)})
    legs = legs.withColumn("length_m", haversine_m(F.col("lat"), F.col("lon"), F.col("end_lat"), F.col("end_lon")))
    legs = legs.where("length_m > 0")
    before = F.sum("length_m").over(by_route.rowsBetween(Window.unboundedPreceding, -1))
    return legs.select(
        "route_id", F.col("seq").alias("leg"), F.col("lat").alias("leg_lat"), F.col("lon").alias("leg_lon"),
        bearing_rad(F.col("lat"), F.col("lon"), F.col("end_lat"), F.col("end_lon")).alias("bearing"), "length_m",
        F.coalesce(before, F.lit(0.0)).alias("before_m"),
    )


def route_points(spark: SparkSession, waypoints, vessel: tuple[float, float] | None = None, route_id: str = "route") -> DataFrame:
    """A route's points in order, from the vessel's fix if there is one."""
    points = ([vessel] if vessel else []) + list(waypoints)
    if len(points) > MAX_POINTS:
        raise ValueError(f"a route has at most {MAX_POINTS} points")
    return spark.createDataFrame([(route_id, k, *p) for k, p in enumerate(points)], "route_id string, seq int, lat double, lon double")


def leg_cells(legs: DataFrame, half_width_m: float) -> DataFrame:
    """legs once for each cell (_level, _band, _cell) that the strip beside them touches.

    A leg is taken in at most PIECES pieces, each in cells about as large: of four half widths on legs that are not too long, and twice, four times, ...
    as large (a level up each) on longer ones. What is beside a piece is within half its length and half the width of its middle.
    """
    unit = max(4 * half_width_m, LEAST_CELL_M)
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.col("length_m") / (PIECES * unit)))).cast("int")
    cut = legs.withColumn("_level", level)
    n = F.greatest(F.lit(1), F.ceil(F.col("length_m") / (unit * F.pow(F.lit(2.0), F.col("_level")))).cast("int"))
    cut = cut.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    part = F.col("length_m") / F.col("_n")
    cut = cut.withColumn("_at", projected(F.col("leg_lat"), F.col("leg_lon"), F.degrees("bearing"), (F.col("_k") + 0.5) * part))
    cut = cut.withColumns({"_reach": F.degrees(F.least(F.lit(3.1), (part / 2 + half_width_m * 1.01) / EARTH_RADIUS_M)) + 1e-6, "_size": cell_degrees(half_width_m, F.col("_level"))})
    lat, lon, reach, size = F.col("_at.lat"), F.col("_at.lon"), F.col("_reach"), F.col("_size")
    cut = cut.withColumn("_band", F.explode(F.sequence(band_of(F.greatest(F.lit(-90.0), lat - reach), size), band_of(F.least(F.lit(90.0), lat + reach), size))))
    columns = columns_of(F.col("_band"), size)
    aside = F.when(F.abs(lat) + reach >= 89.9, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(reach)) / F.cos(F.radians(lat))))) + 1e-6)
    edge = lambda x: F.floor((x + 180.0) / 360.0 * columns).cast("long")
    cells = F.sequence(edge(lon - aside), F.least(edge(lon + aside), edge(lon - aside) + columns - 1))
    cut = cut.withColumn("_cell", F.explode(F.transform(cells, lambda c: F.pmod(c, columns))))
    return cut.select(*legs.columns, "_level", "_band", "_cell").dropDuplicates(["route_id", "leg", "_level", "_band", "_cell"])


def cell_degrees(half_width_m: float, level: Column) -> Column:
    return F.lit(math.degrees(max(4 * half_width_m, LEAST_CELL_M) / EARTH_RADIUS_M)) * F.pow(F.lit(2.0), level)


def in_order(found: DataFrame) -> DataFrame:
    """What lies on a route by how far along it is, equal ones by leg and input order: `place` counts from 1 for each route."""
    along = Window.partitionBy("route_id").orderBy("along_m", "leg", "seq")
    return found.withColumn("place", F.row_number().over(along)).orderBy("route_id", "place")


def candidates(poi: DataFrame, legs: DataFrame, half_width_m: float) -> DataFrame:
    """Pairs of a point and a leg that share a cell: all of the corridor, and few others."""
    if not half_width_m > 0 or math.isinf(half_width_m):
        legs = legs.where(F.lit(False))
    cells = checkpointed(leg_cells(legs, half_width_m if math.isfinite(half_width_m) else 0.0))
    sizes = cells.groupBy("_level").agg(F.count("*").alias("n")).collect()  # a row for each level
    levels = F.array(*(F.lit(r["_level"]) for r in sizes)) if sizes else F.array(F.lit(0))
    size = cell_degrees(half_width_m if math.isfinite(half_width_m) else 0.0, F.col("_level"))
    near = poi.select("*", F.explode(levels).alias("_level")).withColumn("_band", band_of(F.col("lat"), size))
    columns = columns_of(F.col("_band"), size)
    near = near.withColumn("_cell", F.pmod(F.floor((F.col("lon") + 180.0) / 360.0 * columns).cast("long"), columns))
    few = sum(r["n"] for r in sizes) <= BROADCAST_CELLS
    return near.join(F.broadcast(cells) if few else cells, ["_level", "_band", "_cell"]).drop("_level", "_band", "_cell")


def corridor(poi: DataFrame, legs: DataFrame, half_width_m: float, sog: float | None = None) -> DataFrame:
    """Points of the corridor's kinds beside a leg, each on the leg that passes nearest: along_m, cross_m and eta_s.

    Points without a position are beside none; a width that is not positive and finite finds none; of legs that pass equally near, the one
    along which the point comes first counts.
    """
    chosen = poi.where(F.col("type").isin(*KINDS)).select("id", "seq", "type", "name", "lat", "lon", "clearance_m")
    near = candidates(chosen, legs, half_width_m)
    near = near.withColumn("on", onto_leg(F.col("leg_lat"), F.col("leg_lon"), F.col("bearing"), F.col("lat"), F.col("lon")))
    inside = near.where((F.abs("on.cross_m") <= half_width_m) & F.col("on.along_m").between(0, F.col("length_m")))
    inside = inside.withColumns({"cross_m": F.col("on.cross_m"), "along_m": F.col("before_m") + F.col("on.along_m")})
    best = inside.groupBy("route_id", "id").agg(
        F.min_by(F.struct("seq", "type", "name", "lat", "lon", "clearance_m", "along_m", "cross_m", "leg"), F.struct(F.abs("cross_m"), "along_m", "leg")).alias("b")
    )
    eta = F.col("b.along_m") / sog if sog is not None and sog > 0 and not math.isinf(sog) else F.lit(None).cast("double")
    return best.select("route_id", "id", "b.*", eta.alias("eta_s"))


def fetch_boxes(points: DataFrame, half_width_m: float, look_ahead_m: float = LOOK_AHEAD_M) -> DataFrame:
    """(route_id, box): around the first look_ahead_m of each route (route_id, seq, lat, lon), with half_width_m about its points.

    The leg that goes past the look-ahead ends there. A route with a point that has no position has no box (null). A route's
    points, at most MAX_POINTS, are folded in one array.
    """
    by_route = Window.partitionBy("route_id").orderBy("seq")
    legs = points.withColumns({"_lat": F.lag("lat").over(by_route), "_lon": F.lag("lon").over(by_route)})
    legs = legs.withColumn("_length", haversine_m(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")))
    before = F.coalesce(F.sum("_length").over(by_route.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    legs = legs.withColumn("_left", F.lit(float(look_ahead_m)) - before).withColumn("_first", F.row_number().over(by_route) == 1).where("_first or _left > 0")
    cut = projected(F.col("_lat"), F.col("_lon"), F.degrees(bearing_rad(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))), F.col("_left"))
    legs = legs.withColumn("_at", F.when(F.col("_length") > F.col("_left"), cut).otherwise(F.struct("lat", "lon")))
    box = enclosing_bbox(F.col("_at.lat"), F.col("_at.lon"), F.lit(float(half_width_m)))
    edges = F.struct(*(box[n].alias(n) for n in ("south", "north", "west", "east")))
    made = legs.groupBy("route_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", edges.alias("box")))), lambda x: x["box"]).alias("boxes"))
    return made.select("route_id", boxes_hull(F.col("boxes")).alias("box"))


def ahead(found: DataFrame, look_ahead_m: float = LOOK_AHEAD_M) -> DataFrame:
    return found.where(F.col("along_m") <= look_ahead_m)


def too_low(found: DataFrame, details: DataFrame, air_draft_m: float, margin_m: float) -> DataFrame:
    """Bridges of the corridor that block the vessel; clearance from the summary, else from details (id, detail_clearance_m)."""
    bridges = found.where("type = 'Bridge'").join(details, "id", "left")
    bridges = bridges.withColumn("clearance_m", F.coalesce("clearance_m", "detail_clearance_m"))
    return bridges.where(blocks_vessel(F.col("clearance_m"), F.lit(float(air_draft_m)), margin_m))
