"""Column expressions for dates. Sessions run in UTC; what depends on the present takes it as an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lookup

# Seconds of the units of relative times.
UNITS = (("year", 31_104_000), ("month", 2_592_000), ("day", 86_400), ("hour", 3_600), ("minute", 60), ("second", 1))


def from_epoch_ms(x: Column) -> Column:
    return F.when(x > 0, F.timestamp_millis(x))


def survey_date(x: Column) -> Column:
    """A date of YYYYMM or YYYYMMDD as a timestamp; a day that isn't in the calendar gives null."""
    text = F.trim(x)
    return F.when(text.rlike("^[0-9]{6}$"), F.try_to_timestamp(F.concat(text, F.lit("01")), F.lit("yyyyMMdd"))).when(
        text.rlike("^[0-9]{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd"))
    )


def in_or_after_year(ts: Column, year: int) -> Column:
    """Rows without a date pass; a year that isn't positive turns the filter off."""
    return F.lit(True) if year <= 0 else ts.isNull() | (F.year(ts) >= year)


def is_stale(kind: Column, ts: Column, as_of: Column) -> Column:
    """A hazard that was last changed over two calendar years ago."""
    return F.coalesce((kind == "Hazard") & (ts < as_of - F.expr("interval 2 years")), F.lit(False))


def relative_units(seconds: Column) -> Column:
    """The struct (amount, unit) of a time span: the largest unit that fits, after rounding has spilled over."""
    size = F.abs(seconds)
    # Whether the span is told in unit k or a larger one: it is as long, or rounding in the next smaller one makes it so.
    reach = [F.lit(True)] * len(UNITS)
    for k in reversed(range(len(UNITS) - 1)):
        length = UNITS[k + 1][1]
        reach[k] = (size >= UNITS[k][1]) | (reach[k + 1] & (F.floor(size / length + 0.5) * length >= UNITS[k][1]))
    amount, unit = F.lit(None).cast("long"), F.lit(None).cast("string")
    for k, (name, length) in reversed(list(enumerate(UNITS))):
        amount = F.when(reach[k], F.floor(seconds / length + 0.5)).otherwise(amount)
        unit = F.when(reach[k], F.lit(name)).otherwise(unit)
    return F.struct(amount.alias("amount"), unit.alias("unit"))


# English phrases for amounts that have one of their own.
PHRASES = {
    ("second", 0): "now", ("minute", 0): "this minute", ("hour", 0): "this hour", ("day", 0): "today", ("day", -1): "yesterday", ("day", 1): "tomorrow",
    ("month", 0): "this month", ("month", -1): "last month", ("month", 1): "next month", ("year", 0): "this year", ("year", -1): "last year", ("year", 1): "next year",
}


def api_date(text: Column) -> Column:
    """A timestamp of an ISO text; one without a zone is in UTC, and one that isn't a date is null."""
    zoneless = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?$")
    return F.try_to_timestamp(F.when(zoneless, F.concat(text, F.lit("Z"))).otherwise(text))


def ago_phrase(ts: Column, as_of: Column) -> Column:
    """`3 days ago`, `in 2 hours`, `yesterday`; a missing date is `an unknown time ago`."""

    def told(r: Column) -> Column:
        amount, unit = r["amount"].cast("long"), r["unit"]
        many = F.concat(F.abs(amount).cast("string"), F.lit(" "), unit, F.when(F.abs(amount) == 1, F.lit("")).otherwise(F.lit("s")))
        own = lookup({f"{name} {n}": phrase for (name, n), phrase in PHRASES.items()}, F.concat_ws(" ", unit, amount.cast("string")))
        return F.coalesce(own, F.when(amount < 0, F.concat(many, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), many)))

    seconds = F.floor((F.unix_millis(ts) - F.unix_millis(as_of)) / 1000 + 0.5).cast("double")
    # Through arrays of one, so that each step is worked out once and not wherever the next one names it.
    phrase = F.get(F.transform(F.transform(F.array(seconds), relative_units), told), F.lit(0))
    return F.when(ts.isNull(), F.lit("an unknown time ago")).otherwise(phrase)
