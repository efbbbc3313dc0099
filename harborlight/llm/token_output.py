"""Token-ID output: whole texts as integer-run-length-encoded ORC stripes, ordered by document id.

Form on disk: an ORC folder, one row for each document in ascending doc_id order within a file, files covering
disjoint id ranges in file order. Columns: part (file number), doc_id, local_start (ids before the document in
its file), n_tokens, ids (array<int>; ORC writes integers in run-length encoding version 2). Row indexes
are on and doc_id has a Bloom filter, so a reader prunes stripes and row groups by id, reads stripes in parallel,
and skips the ids column where only counts are asked for.

Defined cases: a null or empty text is a document of the end id alone; equal doc_ids keep one row each, ordered by
text; a null doc_id sorts first; a very long text is one row, whose ids one task holds; columns other than the named ones are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import limit_batches, read, scratch_path

ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
}
TOKEN_SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"


def encode_partition(vocabulary: str, end_id: int):
    """A mapInArrow function over (part, doc_id, text) rows in order."""

    def encode(batches):
        model = tokens.encoder(vocabulary)
        local = 0
        for batch in batches:
            for a, b, texts in tokens.text_slices(batch):
                lengths, blobs = [], []
                for ids in model.encode(texts):
                    blobs.append(ids)
                    blobs.append(end_id.to_bytes(4, "little"))
                    lengths.append(len(ids) // 4 + 1)
                ends, starts = [0], []
                for n in lengths:
                    starts.append(local + ends[-1])
                    ends.append(ends[-1] + n)
                local += ends[-1]
                values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(blobs))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("part").slice(a, b - a).cast(pa.int32()),
                        batch.column("doc_id").slice(a, b - a).cast(pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values),
                    ],
                    names=["part", "doc_id", "local_start", "n_tokens", "ids"],
                )

    return encode


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = tokens.END_OF_TEXT) -> None:
    """Encode docs (doc_id, text) and write them to path in the form described above."""
    limit_batches(docs.sparkSession)
    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .select(F.spark_partition_id().alias("part"), "doc_id", "text")
    )
    encode = encode_partition(vocabulary or tokens.vocabulary(), end_id)
    ordered.mapInArrow(encode, TOKEN_SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with start: ids of all documents before the row's, over all files."""
    rows = spark.read.schema(TOKEN_SCHEMA).orc(path)
    # One row for each file: the window over them is as small as the number of files.
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("local_start"))


def _crc_rows(batches):
    for batch in batches:
        ids = batch.column("ids")
        ends = ids.offsets.to_numpy()
        data = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends.tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_digest(rows: DataFrame) -> DataFrame:
    """For each document read back: where it starts, its ids' count, and their checksum."""
    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        _crc_rows, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-orc")
    write_tokens(read(spark, sf_dir, "documents"), path)
    return token_digest(read_tokens(spark, path))
