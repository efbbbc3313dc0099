"""Column expressions for positions on a sphere of 6 371 000 m radius. Angles in degrees unless named otherwise."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
#: Metres in a degree as the dedupe grid takes it (not that of the sphere above).
GRID_METRES_PER_DEGREE = 111_320.0
TILE_DEGREES = 0.1


def bound(x: Column, of: Callable[[Column], Column]) -> Column:
    """of(x) with x worked out once: as an expression it would be copied wherever `of` has it."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))


def wrap_longitude(lon: Column) -> Column:
    """Into [-180, 180]; both ends stay, and a positive input that wraps to the seam is 180. Null if not finite."""
    wrapped = F.pmod(lon + 180.0, F.lit(360.0)) - 180.0
    moved = F.when((wrapped == -180.0) & (lon > 0), F.lit(180.0)).otherwise(wrapped)
    finite = ~F.isnan(lon) & (F.abs(lon) < float("inf"))
    return F.when(finite, F.when(lon.between(-180.0, 180.0), lon).otherwise(moved))


def longitude_span(west: Column, east: Column) -> Column:
    return F.when(east >= west, east - west).otherwise(360.0 - west + east)


def projected(lat: Column, lon: Column, bearing: Column, distance_m: Column) -> Column:
    """The struct (lat, lon) reached from a position along a great circle."""
    p, b, d = F.radians(lat), F.radians(bearing), distance_m / EARTH_RADIUS_M
    new = F.asin(clamp(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b), -1.0, 1.0))
    turn = F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(new))
    return F.struct(F.degrees(new).alias("lat"), wrap_longitude(F.degrees(F.radians(lon) + turn)).alias("lon"))


def enclosing_bbox(lat: Column, lon: Column, distance_m: Column) -> Column:
    """The struct (north, south, east, west) around a circle; null for a bad position or distance."""
    corner = distance_m * math.sqrt(2)
    nw, se = projected(lat, lon, F.lit(-45.0), corner), projected(lat, lon, F.lit(135.0), corner)
    box = F.struct(
        F.least(F.lit(90.0), nw["lat"]).alias("north"), F.greatest(F.lit(-90.0), se["lat"]).alias("south"),
        se["lon"].alias("east"), nw["lon"].alias("west"),
    )
    sound = lat.between(-90, 90) & lon.between(-180, 180) & (distance_m >= 0) & (distance_m < float("inf"))
    return F.when(sound, box)


def bearing_rad(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))


def onto_leg(lat1: Column, lon1: Column, leg_bearing_rad: Column, lat: Column, lon: Column) -> Column:
    """The struct (cross_m, along_m) of a point on a leg from (lat1, lon1); cross is positive to the right."""
    away = haversine_m(lat1, lon1, lat, lon) / EARTH_RADIUS_M
    turn = bearing_rad(lat1, lon1, lat, lon) - leg_bearing_rad
    cross = F.asin(clamp(F.sin(away) * F.sin(turn), -1.0, 1.0))
    along = F.acos(clamp(F.cos(away) / F.cos(cross), -1.0, 1.0))
    return F.struct(
        (cross * EARTH_RADIUS_M).alias("cross_m"),
        (F.when(F.cos(turn) >= 0, along).otherwise(-along) * EARTH_RADIUS_M).alias("along_m"),
    )


def in_bbox(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    """Inclusive; west > east is a box over the antimeridian."""
    inside = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & inside


def snap_out(x: Column, up: bool) -> Column:
    """Outward to the 0.1 degree grid."""
    tenths = F.floor(x * 1e7 + 0.5) / 1e6
    return (F.ceil(tenths) if up else F.floor(tenths)) / 10.0


def tile_key(lat: Column, lon: Column) -> Column:
    """0.1 degree tile number; longitude 180 belongs to the last column."""
    row = F.floor((lat + 90.0) * 10.0)
    column = F.least(F.lit(3599), F.floor((lon + 180.0) * 10.0))
    return (row * 3600 + column).cast("long")


def grid_cells(lat: Column, lon: Column, mean_lat: Column, radius_m: float) -> tuple[Column, Column]:
    """Columns (cx, cy) of the dedupe grid, whose longitude scale is that of the mean latitude. Cells don't wrap."""
    scale = F.cos(F.radians(mean_lat)) * GRID_METRES_PER_DEGREE
    return F.floor(lon * scale / radius_m).cast("long"), F.floor(lat * GRID_METRES_PER_DEGREE / radius_m).cast("long")


def band_of(lat: Column, size_deg: float | Column) -> Column:
    """The band of latitude, of size_deg, counted from the south pole."""
    return F.floor((lat + 90.0) / size_deg).cast("long")


def columns_of(band: Column, size_deg: float | Column) -> Column:
    """Cells around a band: as many as keep a cell at least size_deg wide at the band's far edge."""
    edge = F.least(F.lit(89.999), F.greatest(F.abs(band * size_deg - 90.0), F.abs((band + 1) * size_deg - 90.0)))
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(edge)) / (size_deg * 1.02))).cast("long")


def finite_box(box: Column) -> Column:
    finite = F.lit(True)
    for name in ("south", "north", "west", "east"):
        finite &= box[name].isNotNull() & ~F.isnan(box[name]) & (F.abs(box[name]) < float("inf"))
    return finite


def box_hull(a: Column, b: Column) -> Column:
    """The narrowest box (struct south, north, west, east) around two; null where an edge is not finite.

    West over east is a box over the antimeridian, -180 to 180 the whole world, 180 to -180 the seam alone; of equally narrow ones the first counts,
    with b moved by -360, 0 and 360 degrees.
    """
    wide_a, wide_b = longitude_span(a["west"], a["east"]), longitude_span(b["west"], b["east"])

    def tried(turn: float) -> Column:
        low = F.least(a["west"], b["west"] + turn)
        high = F.greatest(a["west"] + wide_a, b["west"] + turn + wide_b)
        return F.struct((high - low).alias("wide"), low.alias("low"), high.alias("high"))

    def joined(tries: Column) -> Column:
        return bound(F.aggregate(tries, tries[0], lambda best, t: F.when(t["wide"] < best["wide"], t).otherwise(best)), placed)

    def placed(first: Column) -> Column:
        south, north = F.least(a["south"], b["south"]), F.greatest(a["north"], b["north"])
        box = lambda west, east: F.struct(south.alias("south"), north.alias("north"), west.alias("west"), east.alias("east"))
        world = F.greatest(wide_a, wide_b, first["wide"]) >= 360.0
        seam = (first["low"] == first["high"]) & (F.abs(wrap_longitude(first["low"])) == 180.0)
        return F.when(world, box(F.lit(-180.0), F.lit(180.0))).when(seam, box(F.lit(180.0), F.lit(-180.0))).otherwise(
            box(wrap_longitude(first["low"]), wrap_longitude(first["high"]))
        )

    return F.when(finite_box(a) & finite_box(b), bound(F.array(*(tried(t) for t in (-360.0, 0.0, 360.0))), joined))


def boxes_hull(boxes: Column) -> Column:
    """The boxes of an array joined one after another; null for an empty array, or where one has an edge that is not finite."""
    return F.when((F.size(boxes) > 0) & F.forall(boxes, finite_box), F.aggregate(F.slice(boxes, 2, F.size(boxes)), F.get(boxes, F.lit(0)), box_hull))
