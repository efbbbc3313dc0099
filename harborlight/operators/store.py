"""Snapshot tables of the sources: retention, differences, and replacement by partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def retained(rows: DataFrame, as_of: Column, days: int, most: int) -> DataFrame:
    """Rows (id, ts, ...) of the last `days`, the newest `most` of them."""
    return rows.where(F.col("ts") >= as_of - F.make_dt_interval(F.lit(days))).orderBy(F.col("ts").desc(), "id").limit(most)


def difference(held: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """(key, change): added, removed and changed rows between two snapshots of the same columns."""
    others = [c for c in held.columns if c not in key]
    mark = lambda df, name: df.select(*key, F.struct(*others).alias(name))
    both = mark(held, "old").join(mark(fresh, "new"), key, "full")
    change = (
        F.when(F.col("old").isNull(), F.lit("added")).when(F.col("new").isNull(), F.lit("removed"))
        .when(~F.col("old").eqNullSafe(F.col("new")), F.lit("changed"))
    )
    return both.select(*key, change.alias("change")).where("change is not null")


def unchanged(held: DataFrame, fresh: DataFrame, key: list[str]) -> bool:
    return difference(held, fresh, key).isEmpty()


def replace_pages(rows: DataFrame, path: str, page: str = "page") -> None:
    """Write rows so that only the pages that they hold are replaced; other pages of the table stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(page).parquet(path)


def read_pages(spark: SparkSession, path: str, catalogue: DataFrame | None = None, page: str = "page") -> DataFrame:
    """The table's rows; with a catalogue of pages, only those still in it."""
    rows = spark.read.parquet(path)
    return rows if catalogue is None else rows.join(catalogue.select(page), page, "left_semi")


def in_tiles(rows: DataFrame, south: float, north: float, west: float, east: float) -> Column:
    """A condition on lat_cell and lon_cell (tenths of a degree) that prunes partitions for a box."""
    import math

    low, high = math.floor((south + 90) * 10), math.floor((north + 90) * 10)
    left, right = math.floor((west + 180) * 10), min(3599, math.floor((east + 180) * 10))
    columns = rows["lon_cell"].between(left, right) if west <= east else (rows["lon_cell"] >= left) | (rows["lon_cell"] <= right)
    return rows["lat_cell"].between(low, high) & columns


def disagreeing_pages(rows: DataFrame, metadata: DataFrame, page: str = "page") -> DataFrame:
    """Pages whose rows and metadata (page, n_rows, validator) disagree: their validators go, so that they are fetched anew.

    Missing on either side disagrees as well as another number of rows.
    """
    held = rows.groupBy(page).agg(F.count("*").alias("_held"))
    both = metadata.select(page, "n_rows").withColumn("_known", F.lit(True)).join(held, page, "full")
    return both.where(F.col("_known").isNull() | F.col("_held").isNull() | (F.col("n_rows") != F.col("_held"))).select(page)


def record_counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("records"))
