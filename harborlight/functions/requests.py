"""Column expressions for what is asked: boxes from texts or from a position and a distance, their parts and limits.

A box is a struct (south, north, west, east); west over east is one over the antimeridian. What is no box is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..boxes import MAX_DISTANCE_M, MAX_SPAN_DEGREES
from .geo import bound, enclosing_bbox, longitude_span, wrap_longitude
from .numbers import finite

_EDGES = ("south", "north", "west", "east")


def number_of(text: Column) -> Column:
    """The finite number that a text is, null for others and for blank ones."""
    trimmed = F.trim(text)
    return finite(F.when(trimmed.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), trimmed.try_cast("double")))


def box_of(south: Column, north: Column, west: Column, east: Column) -> Column:
    return F.struct(*(x.cast("double").alias(n) for n, x in zip(_EDGES, (south, north, west, east))))


def explicit_box(text: Column) -> Column:
    """The box of `west, south, east, north`, with or without brackets: on Earth, and at most MAX_SPAN_DEGREES on a side."""
    def checked(v: Column) -> Column:
        west, south, east, north = (F.get(v, F.lit(k)) for k in range(4))
        sound = (F.size(v) == 4) & west.between(-180, 180) & east.between(-180, 180) & (south >= -90) & (north <= 90) & (south <= north)
        sound &= (north - south <= MAX_SPAN_DEGREES) & (longitude_span(west, east) <= MAX_SPAN_DEGREES)
        return F.when(F.coalesce(sound, F.lit(False)), box_of(south, north, west, east))

    return bound(F.transform(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ","), number_of), checked)


def asked_box(text: Column, lat: Column, lon: Column, distance_m: Column) -> Column:
    """The explicit box if there is a text, however bad; else the box around a position."""
    far = F.when((distance_m > 0) & (distance_m <= MAX_DISTANCE_M), distance_m)
    around = enclosing_bbox(finite(lat), finite(lon), far)
    near = bound(around, lambda b: F.when(b.isNotNull(), box_of(*(b[n] for n in _EDGES))))
    return F.when(text.isNotNull(), explicit_box(text)).otherwise(near)


def box_parts(box: Column) -> Column:
    """The box as an array of one, or of two at the antimeridian, that don't wrap; null for none."""
    def cut(b: Column) -> Column:
        halves = F.array(box_of(b["south"], b["north"], b["west"], F.lit(180.0)), box_of(b["south"], b["north"], F.lit(-180.0), b["east"]))
        return F.when(b["west"] <= b["east"], F.array(b)).when(b["west"] > b["east"], halves)

    return bound(box, cut)


def clamped_box(box: Column, most: float = 2.0) -> Column:
    """A wide box cut to `most` degrees about its middle, on either side."""
    def cut(b: Column) -> Column:
        width, height = longitude_span(b["west"], b["east"]), b["north"] - b["south"]
        lat, lon = (b["south"] + b["north"]) / 2, b["west"] + width / 2
        return F.when(
            b.isNotNull(),
            box_of(
                F.when(height <= most, b["south"]).otherwise(lat - most / 2), F.when(height <= most, b["north"]).otherwise(lat + most / 2),
                F.when(width <= most, b["west"]).otherwise(wrap_longitude(lon - most / 2)), F.when(width <= most, b["east"]).otherwise(wrap_longitude(lon + most / 2)),
            ),
        )

    return bound(box, cut)
