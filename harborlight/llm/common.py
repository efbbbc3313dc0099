"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import checkpointed, clear_scratch, scratch_dir, scratch_path, shared_dir

__all__ = ["checkpointed", "clear_scratch", "join_by_shuffles", "limit_batches", "ordered", "read", "scratch_dir", "scratch_path", "shared_dir", "stored", "whole_runs"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Most bytes of an Arrow batch between the JVM and Python; Spark's own default is 64 MB, for input and output of each task.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def limit_batches(spark: SparkSession) -> None:
    """Lower the session's limit on Arrow batches to BATCH_BYTES, so that texts don't decide how much a task holds."""
    now = spark.conf.get(_BATCH_SETTING, None)
    if now is None or not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def join_by_shuffles(spark: SparkSession) -> None:
    """From now on the session doesn't turn shuffled joins into broadcast ones as it runs, whatever small side it meets.

    Each such side is gathered and held by the driver, and a job of many joins holds many. Tables that are known to be small
    before a query starts, or marked so, are still broadcast.
    """
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df, stored, with its place in the order of keys: `_at` rises with it, and `_part` is a range of places of one task's size.

    df should be cheap to read twice (stored), as ranges are found from a sample of it; keys that tie can't be parted.
    """
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    return stored(dealt, name).withColumn("_part", F.shiftright("_at", 33))


def whole_runs(batches, key: str, least_rows: int = 4096):
    """Arrow tables made of batches sorted by key, cut so that the rows of a key are never parted."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least_rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(key).to_numpy()
        start = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        if start:
            yield table.slice(0, start)
        rest = table.slice(start)
        held, rows = rest.to_batches(), rest.num_rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()
