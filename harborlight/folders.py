"""The folder that driver and executors share: tables kept between steps, and cutting of lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, on a local master only, a new one."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="harborlight-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """The application's own folder of intermediate tables in the shared folder."""
    return f"{shared_dir(spark)}/harborlight/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Checkpoint folders of this process's operators, by application.
_checkpoints: dict[str, list[str]] = {}


def clear_scratch(spark: SparkSession) -> None:
    """Delete the application's intermediate tables and checkpoints, once the results that read them are written."""
    for folder in [scratch_dir(spark), *_checkpoints.pop(spark.sparkContext.applicationId, [])]:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a frame that is used more than once, or inside a loop."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    written = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if written.isDefined():  # not where there are no partitions
        _checkpoints.setdefault(df.sparkSession.sparkContext.applicationId, []).append(written.get())
    return out
