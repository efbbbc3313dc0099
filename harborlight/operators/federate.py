"""Union, naming and de-duplication by key of the sources' rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import local_id, namespace_of


def union_sources(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """All rows in registration order: `source` and `rank` are added, ids get the source's name before them."""
    named = [
        df.withColumns({"source": F.lit(name), "rank": F.lit(k), "id": F.concat_ws("-", F.lit(name), F.col("id").cast("string"))})
        for k, (name, df) in enumerate(sources)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def first_by_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; rows whose key is null all stay."""
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    whole = F.struct(*(F.col(c) for c in df.columns))
    # Combined before the shuffle, unlike a window: a key of many rows sends one for each task.
    first = df.where(~missing).groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(key))).agg(F.min_by(whole, F.struct(*order)).alias("_row"))
    return first.select("_row.*").union(df.where(missing))


def last_by_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in an order: of files read one after another, the later wins."""
    whole = F.struct(*(F.col(c) for c in df.columns))
    keys = (F.col(k).alias(f"_key{i}") for i, k in enumerate(key))
    return df.groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("_row")).select("_row.*")


def keep_known(df: DataFrame, catalogue: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is still in the catalogue."""
    return df.join(catalogue, key, "left_semi")


def routed(ids: DataFrame, column: str = "id") -> DataFrame:
    """ids with the source that owns each (before the first hyphen) and the id within it; others are dropped."""
    c = F.col(column)
    return ids.withColumns({"owner": namespace_of(c), "raw_id": local_id(c)}).where("owner is not null")


def details_of(ids: DataFrame, details: list[tuple[str, DataFrame]]) -> DataFrame:
    """The detail rows that ids name: each source's table (id within the source, ...) is asked for its own; others are dropped.

    A source may have several tables; without any there are no rows, of id and owner.
    """
    asked = routed(ids)
    if not details:
        return asked.select("id", "owner").where(F.lit(False))
    parts = []
    for owner, table in details:
        mine = asked.where(F.col("owner") == owner).select("id", "raw_id")
        parts.append(mine.join(table.withColumn("raw_id", F.col("id").cast("string")).drop("id"), "raw_id").drop("raw_id").withColumn("owner", F.lit(owner)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
