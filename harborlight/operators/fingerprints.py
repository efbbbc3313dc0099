"""Pages of a snapshot table that are written only where their content is another.

A page's fingerprint is the number of its rows and two sums of row hashes: it adds up over tasks, does not depend on the order of
rows, and tells how often a row is there. Fingerprints are kept beside the pages in a small table, with the version that they came with, so a refresh
reads its own rows and that table, not the rows that are held.

Defined cases: a null page is a page of its own; a page that the refresh does not have stays; one with an older version than the held one is refused; without versions the
refresh counts; columns are taken by name in any order; a refresh that stopped between the rows and the fingerprints is made good by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..folders import checkpointed
from .store import replace_pages

MARKS = ("_rows", "_one", "_two")


def fingerprints(rows: DataFrame, page: str = "page", version: str | None = None) -> DataFrame:
    """(page, _rows, _one, _two, _version) of each page; version: a column of rows that is no part of their content."""
    content = sorted(c for c in rows.columns if c not in (page, version))
    # A hash skips nulls: where they are is hashed as well.
    values = [F.col(c) for c in content] + [F.col(c).isNull() for c in content]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *values).cast("decimal(20,0)")).cast("string")
    newest = F.max(version).cast("string") if version else F.lit(None).cast("string")
    return rows.groupBy(page).agg(F.count("*").alias("_rows"), total(1).alias("_one"), total(2).alias("_two"), newest.alias("_version"))


def _held(spark, path: str) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where) else None


def changes(fresh: DataFrame, held: DataFrame | None, page: str = "page", numeric: bool = True) -> DataFrame:
    """(page, change) of fresh fingerprints against held ones: added, changed, unchanged or refused. numeric: versions are numbers."""
    if held is None:
        return fresh.select(page, F.lit("added").alias("change"))
    version = lambda c: F.col(c).cast("decimal(38,10)") if numeric else F.col(c)
    old = held.select(F.col(page).cast(fresh.schema[page].dataType).alias("_page"), *(F.col(c).alias(f"{c}_held") for c in (*MARKS, "_version")))
    both = fresh.join(old, F.col(page).eqNullSafe(F.col("_page")), "left")
    same = F.lit(True)
    for c in MARKS:
        same &= F.col(c) == F.col(f"{c}_held")
    older = F.coalesce(version("_version") < version("_version_held"), F.lit(False))
    change = F.when(F.col("_rows_held").isNull(), "added").when(same, "unchanged").when(older, "refused").otherwise("changed")
    return both.select(page, change.alias("change"))


def refresh(rows: DataFrame, path: str, page: str = "page", version: str | None = None) -> DataFrame:
    """Write the pages of rows that are new or changed to the table at path; (page, change) of every page of rows."""
    spark = rows.sparkSession
    beside = f"{path}.fingerprints"
    fresh = checkpointed(fingerprints(rows, page, version))
    found = checkpointed(changes(fresh, _held(spark, beside), page, not version or dict(rows.dtypes)[version] != "string"))
    wanted = found.where(F.col("change").isin("added", "changed")).select(F.col(page).alias("_page"))
    chosen = lambda df: df.join(wanted, df[page].eqNullSafe(wanted["_page"]), "left_semi")
    if not wanted.isEmpty():
        replace_pages(chosen(rows), path, page)
        replace_pages(chosen(fresh), beside, page)
    return found
