"""What a source lists for a query: its summaries in a box, by kind, year, rating and waters, as one plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..boxes import Box
from ..folders import checkpointed
from ..functions.dates import in_or_after_year
from ..functions.geo import in_bbox
from ..operators.predicates import of_kinds, outside_us_gate, rated


def listed(
    summaries: DataFrame, box: Box, kinds: list[str] | None = None, year: int = 0, least_rating: float = 0.0, us_only: bool = False, every_kind: bool = True
) -> DataFrame:
    """Summaries in the box. kinds: those asked for (none at all where every_kind is off); undated rows pass the year.

    us_only: a source of US waters lists nothing outside of them.
    """
    lat, lon = F.col("lat"), F.col("lon")
    conditions: list[Column] = [in_bbox(lat, lon, box.south, box.north, box.west, box.east), in_or_after_year(F.col("ts"), year), rated(F.col("type"), F.col("rating"), least_rating)]
    if kinds is not None or not every_kind:
        conditions.append(of_kinds(F.col("type"), kinds))
    if us_only:
        conditions.append(~outside_us_gate(lat, lon))
    return summaries.where(reduce(lambda a, b: a & b, conditions))


def fanned_out(layers: list[tuple[str, Callable[[], DataFrame]]]) -> tuple[DataFrame, dict[str, str]]:
    """The rows of all layers of a source that can be read, with `layer`, and what went wrong with the others.

    Each layer is read once and kept in the shared folder; if none can be read that is an error.
    """
    made, failed = [], {}
    for name, read in layers:
        try:
            made.append(checkpointed(read().withColumn("layer", F.lit(name))))
        except Exception as error:  # of the service or the file, whatever its kind
            failed[name] = str(error)
    if not made:
        raise ValueError(f"no layer can be read: {failed}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made), failed
