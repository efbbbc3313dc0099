"""Boxes and routes as plain values: what a query's parameters are made of before Spark sees it."""

from __future__ import annotations

import dataclasses
import math

RADIUS_M = 6_371_000.0
MAX_SPAN_DEGREES = 20.0
MAX_DISTANCE_M = 1_000_000.0
LOOK_AHEAD_M = 18_520.0


@dataclasses.dataclass(frozen=True)
class Box:
    """West over east is a box over the antimeridian; -180 to 180 is the whole world, 180 to -180 the seam alone."""

    south: float
    north: float
    west: float
    east: float


def wrapped(lon: float) -> float:
    if -180 <= lon <= 180:
        return lon
    out = (lon + 180) % 360 - 180
    return 180.0 if out == -180 and lon > 0 else out


def span(west: float, east: float) -> float:
    return east - west if east >= west else 360 - west + east


def finite(raw) -> float | None:
    """A finite number or the number of a text that isn't blank."""
    if isinstance(raw, bool) or raw is None:
        return None
    try:
        value = float(raw.strip()) if isinstance(raw, str) else float(raw)
    except (TypeError, ValueError):
        return None
    return value if math.isfinite(value) else None


def position(raw) -> tuple[float, float] | None:
    """(lat, lon) of a mapping with latitude and longitude, or of a list that begins with longitude and latitude."""
    if isinstance(raw, dict):
        lat, lon = finite(raw.get("latitude")), finite(raw.get("longitude"))
    elif isinstance(raw, (list, tuple)) and len(raw) >= 2:
        lon, lat = finite(raw[0]), finite(raw[1])
    else:
        return None
    return (lat, lon) if lat is not None and lon is not None and -90 <= lat <= 90 and -180 <= lon <= 180 else None


def moved(lat: float, lon: float, bearing: float, metres: float) -> tuple[float, float]:
    p, b, d = math.radians(lat), math.radians(bearing), metres / RADIUS_M
    q = math.asin(max(-1.0, min(1.0, math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(b))))
    turn = math.atan2(math.sin(b) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(q))
    return math.degrees(q), wrapped(math.degrees(math.radians(lon) + turn))


def around(lat: float, lon: float, metres: float) -> Box:
    """The box around a circle."""
    if not (-90 <= lat <= 90 and -180 <= lon <= 180) or not math.isfinite(metres) or metres < 0:
        raise ValueError("a circle has a position on Earth and a radius of zero or more")
    nw, se = moved(lat, lon, -45, metres * math.sqrt(2)), moved(lat, lon, 135, metres * math.sqrt(2))
    return Box(max(-90.0, se[0]), min(90.0, nw[0]), nw[1], se[1])


def asked_for(query: dict) -> Box | None:
    """The box of a query: an explicit `bbox` (west, south, east, north) wins, else `position` and `distance`."""
    if "bbox" in query:
        raw = query["bbox"]
        if isinstance(raw, str):
            raw = "".join(c for c in raw if c not in "[]" and not c.isspace()).split(",")
        if not isinstance(raw, (list, tuple)) or len(raw) != 4:
            return None
        west, south, east, north = map(finite, raw)
        if None in (west, south, east, north) or not (-180 <= west <= 180 and -180 <= east <= 180 and -90 <= south <= north <= 90):
            return None
        return None if north - south > MAX_SPAN_DEGREES or span(west, east) > MAX_SPAN_DEGREES else Box(south, north, west, east)
    distance, centre = finite(query.get("distance")), position(query.get("position"))
    if distance is None or not 0 < distance <= MAX_DISTANCE_M or centre is None:
        return None
    return around(*centre, distance)


def parts(box: Box) -> list[Box]:
    """The box as one, or at the antimeridian as two, that don't wrap."""
    if box.west <= box.east:
        return [box]
    return [dataclasses.replace(box, east=180.0), dataclasses.replace(box, west=-180.0)]


def hull(a: Box, b: Box) -> Box:
    """The narrowest box around both; the order matters only where two are equally narrow."""
    if not all(map(math.isfinite, (*dataclasses.astuple(a), *dataclasses.astuple(b)))):
        raise ValueError("a box has finite edges")
    south, north = min(a.south, b.south), max(a.north, b.north)
    wa, wb = span(a.west, a.east), span(b.west, b.east)
    tries = [(min(a.west, b.west + k), max(a.west + wa, b.west + k + wb)) for k in (-360, 0, 360)]
    west, east = min(tries, key=lambda t: t[1] - t[0])
    if max(wa, wb, east - west) >= 360:
        return Box(south, north, -180.0, 180.0)
    if east == west and abs(wrapped(west)) == 180:
        return Box(south, north, 180.0, -180.0)
    return Box(south, north, wrapped(west), wrapped(east))


def clamped(box: Box, most: float = 2.0) -> Box:
    """A wide box cut to `most` degrees about its centre, on either axis."""

    def cut(low: float, high: float) -> tuple[float, float]:
        middle = (low + high) / 2
        return (low, high) if high - low <= most else (middle - most / 2, middle + most / 2)

    south, north = cut(box.south, box.north)
    width = span(box.west, box.east)
    west, east = (box.west, box.east) if width <= most else map(wrapped, cut(box.west, box.west + width))
    return Box(south, north, west, east)


def distance(a: tuple[float, float], b: tuple[float, float]) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * RADIUS_M * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


def bearing(a: tuple[float, float], b: tuple[float, float]) -> float:
    p, q, d = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    return math.degrees(math.atan2(math.sin(d) * math.cos(q), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(d)))


def along_route(points: list[tuple[float, float]], half_width_m: float, look_ahead_m: float = LOOK_AHEAD_M) -> Box | None:
    """The box of a route's first look_ahead_m, with half_width_m around each of its points."""
    box, left = None, look_ahead_m
    for k, point in enumerate(points):
        if k:
            leg = distance(points[k - 1], point)
            if leg > left:
                point = moved(*points[k - 1], bearing(points[k - 1], point), left)
            left -= min(leg, left)
        mine = around(*point, half_width_m)
        box = mine if box is None else hull(box, mine)
        if left <= 0:
            break
    return box


def waypoints(coordinates, reverse: bool = False, index=0) -> list[tuple[float, float]]:
    """The points still ahead on a route resource: usable [lon, lat, ...] entries in travel order, from a clamped index."""
    usable = [p for p in (position(list(c)) for c in coordinates or [] if isinstance(c, (list, tuple))) if p]
    if reverse:
        usable.reverse()
    number = finite(index)
    first = 0 if number is None or number < 0 else min(int(number), len(usable) - 1)
    return usable[max(0, first) :]
