"""Source status from a log of fetches: source, at (its order), ok, and optionally message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(log: DataFrame) -> DataFrame:
    """For each source its latest state and how often it failed."""
    return log.groupBy("source").agg(
        F.max_by(F.when(F.col("ok"), F.lit("reachable")).otherwise(F.lit("unreachable")), "at").alias("state"), F.count_if(~F.col("ok")).alias("errors")
    )


def recent_errors(log: DataFrame, n: int = 5) -> DataFrame:
    return log.where(~F.col("ok")).orderBy(F.col("at").desc(), "source").limit(n)


def unreachable(log: DataFrame) -> DataFrame:
    return rollup(log).where("state = 'unreachable'").select("source")


def refresh_rollup(pages: DataFrame) -> DataFrame:
    """For each source what its refresh of pages (source, page, rows, ok) brought: rows, failures and the first that failed."""
    return pages.groupBy("source").agg(
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("rows"))), F.lit(0)).alias("ingested"), F.count_if(~F.col("ok")).alias("failures"),
        F.min(F.when(~F.col("ok"), F.col("page"))).alias("first_failure"),
    )
