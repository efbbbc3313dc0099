"""Column expressions for numbers and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FEET_TO_METRES = 0.3048
SAFE_INTEGER = (1 << 53) - 1


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def positive(x: Column) -> Column:
    return F.when((x > 0) & ~F.isnan(x) & (x < float("inf")), x)


def safe_positive_integer(text: Column) -> Column:
    """Canonical digits of 1 to 2^53 - 1 as a long, else null."""
    value = F.when(text.rlike("^[1-9][0-9]{0,15}$"), text.try_cast("long"))
    return F.when(value <= SAFE_INTEGER, value)


def clamped(x: Column, low: float, high: float, default: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(finite(x), F.lit(default))))


def round_half_up(x: Column, digits: int) -> Column:
    """Halves go up, towards positive infinity, unlike round()."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def scaled(x: Column, per_unit: float) -> Column:
    """x in whole parts of a unit: what results are compared by."""
    return F.floor(x * per_unit + 0.5).cast("long")


def feet(x: Column) -> Column:
    return x * FEET_TO_METRES


def height_m(value: Column, unit: Column) -> Column:
    """A height by the name of its unit; an unknown unit gives null."""
    name = F.lower(F.trim(unit))
    return positive(
        F.when(name.isin("feet", "foot", "ft"), feet(value)).when(name.isin("meters", "meter", "metres", "metre", "m"), value)
    )


def s57_code(text: Column) -> Column:
    """A code of digits, 0 and up."""
    return F.when(F.trim(text).rlike("^[0-9]{1,9}$"), F.trim(text).try_cast("int"))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true"), F.lit(False))


def capped(x: Column, most: float, default: float) -> Column:
    """A positive number, cut at most; the default (cut as well) where it isn't one."""
    return F.least(F.coalesce(positive(x), F.lit(float(default))), F.lit(float(most)))


def display_length(metres: Column, imperial: bool) -> Column:
    """Metres as they are shown: in feet with two decimals, or unchanged."""
    return round_half_up(metres / FEET_TO_METRES, 2) if imperial else metres


def stored_length(shown: Column, imperial: bool) -> Column:
    """A length as shown, in metres; from feet with four decimals."""
    return round_half_up(shown * FEET_TO_METRES, 4) if imperial else shown
