"""A Spark data sink for notifications, in batches and streams: what is told reaches the folder once, whatever is tried again.

    register(spark)
    notifications(events, "notifications.hazards").write.format("notification_folder").mode("append").option("batch", "7").save(folder)
    notifications(stream, ...).writeStream.format("notification_folder").option("checkpointLocation", ...).start(folder)
    read(spark, folder)

Every task writes a file under a token of its own and gives the token as its commit message. Committing a batch writes one small file
with the tokens of the tasks that counted; a batch that has such a file already is not committed again. Only rows whose token is
listed are read, so that failed, repeated and speculative tasks leave nothing behind that is seen.

Defined cases: a null id or vessel gives a null path and is told all the same; without the option `batch` a batch write is one of its own; a batch without rows is
committed, and reads as nothing.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from ..functions.text import path_id

SCHEMA = "vessel string, path string, state string, message string, ts timestamp, since timestamp"


def notifications(events: DataFrame, prefix: str, state: str = "alert", cleared_message: Column | None = None) -> DataFrame:
    """Rows of SCHEMA for events (vessel, id, ts, event, since, message): raised and told anew with `state`, cleared as normal.

    A path is the prefix and the id, safe for a path; `since` is the episode's start in all three.
    """
    gone = F.col("event") == "clear"
    told = F.col("message") if cleared_message is None else F.when(gone, cleared_message).otherwise(F.col("message"))
    return events.select(
        F.col("vessel").cast("string").alias("vessel"), F.concat(F.lit(prefix.rstrip(".") + "."), path_id(F.col("id"))).alias("path"),
        F.when(gone, "normal").otherwise(state).alias("state"), told.alias("message"), "ts", "since",
    )


@dataclasses.dataclass
class Written(WriterCommitMessage):
    token: str
    rows: int


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


class FolderWriter:
    """What batch and stream writers share."""

    def __init__(self, folder: str, names: list[str]):
        self._folder, self._names = folder.rstrip("/"), names

    def write(self, rows) -> Written:
        files, folder = opened(self._folder)
        token, n = uuid.uuid4().hex, 0
        files.create_dir(f"{folder}/data", recursive=True)
        with files.open_output_stream(f"{folder}/data/{token}.json") as out:
            for row in rows:
                cells = {k: v.isoformat() if isinstance(v, dt.datetime) else v for k, v in zip(self._names, row)}
                out.write((json.dumps(cells | {"token": token}) + "\n").encode())
                n += 1
        return Written(token, n)

    def put(self, messages: list[Written | None], batch: str) -> None:
        files, folder = opened(self._folder)
        name = f"{folder}/commits/{batch}.json"
        files.create_dir(f"{folder}/commits", recursive=True)
        if files.get_file_info(name).type == fs.FileType.File:
            self.drop(messages)
            return
        lines = "".join(json.dumps({"batch": batch, "token": m.token}) + "\n" for m in messages if m and m.rows)
        temporary = f"{folder}/commits/_{uuid.uuid4().hex}"
        with files.open_output_stream(temporary) as out:
            out.write(lines.encode())
        files.move(temporary, name)

    def drop(self, messages: list[Written | None]) -> None:
        files, folder = opened(self._folder)
        for m in messages:
            if m and files.get_file_info(f"{folder}/data/{m.token}.json").type == fs.FileType.File:
                files.delete_file(f"{folder}/data/{m.token}.json")


class BatchWriter(FolderWriter, DataSourceWriter):
    def __init__(self, folder: str, names: list[str], batch: str):
        super().__init__(folder, names)
        self._batch = batch

    def commit(self, messages) -> None:
        self.put(messages, self._batch)

    def abort(self, messages) -> None:
        self.drop(messages)


class StreamWriter(FolderWriter, DataSourceStreamWriter):
    def commit(self, messages, batchId: int) -> None:
        self.put(messages, str(batchId))

    def abort(self, messages, batchId: int) -> None:
        self.drop(messages)


class NotificationFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notification_folder"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("notifications are appended")
        return BatchWriter(self.options["path"], schema.names, self.options.get("batch") or uuid.uuid4().hex)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return StreamWriter(self.options["path"], schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NotificationFolder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """batch, and the rows of SCHEMA that were committed."""
    files, there = opened(folder.rstrip("/"))
    if files.get_file_info(f"{there}/commits").type != fs.FileType.Directory:
        return spark.createDataFrame([], "batch string, " + SCHEMA)
    listed = spark.read.schema("batch string, token string").json(f"{folder}/commits")
    rows = spark.read.schema(SCHEMA + ", token string").json(f"{folder}/data")
    return rows.join(listed, "token").select("batch", *(c.split()[0] for c in SCHEMA.split(", ")))
