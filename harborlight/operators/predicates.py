"""Row filters on points of interest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geo import in_bbox
from ..functions.numbers import positive

# Envelopes of US waters (south, north, west, east).
US_WATERS = (
    (24.0, 49.5, -125.5, -66.0), (51.0, 72.0, -180.0, -129.0), (51.0, 56.0, 172.0, 180.0),
    (18.5, 23.0, -161.0, -154.5), (17.5, 18.7, -67.5, -64.5), (13.0, 21.0, 144.5, 146.5),
)
RATABLE = ("Marina", "Anchorage", "Business", "BoatRamp")
#: Kinds that can be selected, in their order; Unknown is none of them.
SELECTABLE = (
    "Anchorage", "BoatRamp", "Bridge", "Business", "Dam", "Ferry", "Hazard", "Inlet", "LocalKnowledge", "Lock", "Marina",
    "Navigational", "Airport",
)


def valid_latitude(lat: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & ~F.isnan(lat), F.lit(False))


def valid_longitude(lon: Column) -> Column:
    return F.coalesce(lon.between(-180, 180) & ~F.isnan(lon), F.lit(False))


def in_us_waters(lat: Column, lon: Column) -> Column:
    found = F.lit(False)
    for south, north, west, east in US_WATERS:
        found |= in_bbox(lat, lon, south, north, west, east)
    return found


def outside_us_gate(lat: Column, lon: Column) -> Column:
    """Whether a US source is skipped: only where the position is known and outside."""
    return F.coalesce(lat.isNotNull() & lon.isNotNull() & ~in_us_waters(lat, lon), F.lit(False))


def rated(kind: Column, rating: Column, least: float) -> Column:
    """Ratable kinds need the rating, and unrated ones of them go; other kinds pass. Off unless least is positive."""
    if not least > 0:
        return F.lit(True)
    return ~kind.isin(*RATABLE) | F.coalesce(rating >= least, F.lit(False))


def selected_kinds(flags: dict[str, bool]) -> list[str] | None:
    """Kinds whose flag is set; None if flags are given but none is set; all if no flag is given."""
    if not flags:
        return list(SELECTABLE)
    chosen = [k for k in SELECTABLE if flags.get(k)]
    return chosen or None


def of_kinds(kind: Column, kinds: list[str] | None) -> Column:
    return F.lit(False) if kinds is None else kind.isin(*kinds)


def blocks_vessel(clearance_m: Column, air_draft_m: Column, margin_m: float) -> Column:
    return F.coalesce(clearance_m <= air_draft_m + margin_m, F.lit(False))


def with_required(kinds: list[str] | None, required: list[str]) -> list[str]:
    """The selected kinds in their order, and those required that aren't among them."""
    return list(dict.fromkeys([*(kinds or []), *required]))


def effective_air_draft(measured: Column, configured: float | None = None) -> Column:
    """The measured air draft if it is positive and finite, else the configured one if that is."""
    return F.coalesce(positive(measured), positive(F.lit(configured).cast("double")))
