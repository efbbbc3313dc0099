"""Hard negatives by blocked dense products: for each anchor its best rows of the same label, then the best others in a window below each.

Anchors are taken in waves of at most WAVE rows, whose vectors are broadcast; a wave reads the table twice. Each task multiplies blocks
of anchors with blocks of rows in float64, where the integer products are exact below 2^53 (larger ones are worked out in
whole numbers), and keeps what is best so far: POSITIVES rows of the same label for each anchor, and, in the second pass,
NEGATIVES rows of other labels for each anchor and positive, within a share of the positive's score. Both states merge: what
tasks found is ranked again by anchor. A task holds one wave's state and one block of products, and gives a bounded number
of rows for each anchor whatever it reads; the work is anchors times rows, over all rows.

Defined cases: rows with a null label or vector, or with null or non-finite components, take no part; an empty vector scores 0
with other empty ones; vectors of different lengths aren't compared; a null id is no anchor and stands last among ties; rows that
share an id are rows of their own, told apart by their place in the table, and each positive has its own ranks; an anchor
without a positive, or a positive without a row in its window, gives no rows; other columns, whatever their names, are not
read; an empty table gives no rows. A score of over 64 bits is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import limit_batches, ordered, read, stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: Shares of a positive's score, in hundredths, between which a negative's score lies.
LOW, HIGH = 50, 95
#: Anchors that are broadcast at once (32 MB of 64 numbers each), and rows of a block of products.
WAVE = 1 << 16
BLOCK = 1024
#: float64 holds whole numbers exactly up to this.
EXACT = 2.0**53


def vectors_of(column: pa.Array | pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the rows of a list column that have it, and their components as whole numbers in float64."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.floor(np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64) * SCALE)
    sizes = np.diff(column.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes
    out = {}
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        out[dim] = (rows, values[starts[rows, None] + np.arange(dim)])
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products as int64: exact."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [np.frompyfunc(int, 1, 1)(x) for x in (a, b.T)]
    return np.dot(*whole).astype(np.int64).reshape(len(a), len(b))


class Best:
    """The k first rows of each slot by score, then id, then place in the table; merges block after block."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score = np.full((slots, k), np.iinfo(np.int64).min)
        self.id, self.row = np.zeros((slots, k), np.int64), np.zeros((slots, k), np.int64)
        self.unknown, self.used = np.zeros((slots, k), bool), np.zeros((slots, k), bool)

    def add(self, slots: np.ndarray, scores: np.ndarray, able: np.ndarray, ids: np.ndarray, unknown: np.ndarray, rows: np.ndarray) -> None:
        """scores: of some slots (distinct) with some rows; able: which of them count. No row comes twice."""
        able = able & (scores >= self.score[slots, -1:])
        if able.sum() > 8 * self.k * len(slots) and scores.shape[1] > self.k:
            # More than can stay: only those that reach the block's own k-th best.
            held = np.where(able, scores, np.iinfo(np.int64).min)
            able &= scores >= np.partition(held, -self.k, axis=1)[:, -self.k, None]
        i, j = np.nonzero(able)
        if not len(i):
            return
        old = self.used[slots]
        where = np.concatenate([i, np.nonzero(old)[0]])
        parts = [
            np.concatenate([new, kept[slots][old]])
            for new, kept in ((scores[i, j], self.score), (ids[j], self.id), (rows[j], self.row), (unknown[j], self.unknown))
        ]
        order = np.lexsort((parts[2], parts[1], parts[3], -parts[0], where))
        where = where[order]
        fresh = np.concatenate(([True], where[1:] != where[:-1]))
        starts = np.flatnonzero(fresh)
        rank = np.arange(len(where)) - starts[np.cumsum(fresh) - 1]
        stay = rank < self.k
        at, order = (slots[where[stay]], rank[stay]), order[stay]
        for kept, part in zip((self.score, self.id, self.row, self.unknown), parts):
            kept[at] = part[order]
        self.used[at] = True

    def batches(self, names: list[str], size: int = 65_536):
        slot, k = np.nonzero(self.used)
        for a in range(0, len(slot), size):
            at = (slot[a : a + size], k[a : a + size])
            columns = [pa.array(at[0]), pa.array(self.score[at]), pa.array(self.id[at], mask=self.unknown[at]), pa.array(self.row[at])]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def blocks(batch: pa.RecordBatch, anchors: dict):
    """Pairs of an anchors' block and a batch's block of the same length: (anchor places, scores, row places)."""
    for dim, (rows, values) in vectors_of(batch.column("embedding")).items():
        mine, theirs = anchors.get(dim, (np.zeros(0, int), None))
        for a in range(0, len(mine), BLOCK):
            for b in range(0, len(rows), BLOCK):
                yield mine[a : a + BLOCK], products(theirs[a : a + BLOCK], values[b : b + BLOCK]), rows[b : b + BLOCK]


def ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("vec_id")
    return np.asarray(column.fill_null(0)), np.asarray(column.is_null())


def positive_finder(wave):
    """A mapInArrow function over (row, vec_id, label, embedding): each anchor's best rows of its own label among a task's."""

    def find(batches):
        rows_, labels, anchors = wave.value
        best = Best(len(rows_), POSITIVES)
        by_label = {}  # anchors of a label, by length of their vectors
        for label in np.unique(labels).tolist():
            own = {dim: np.flatnonzero(labels[at] == label) for dim, (at, _) in anchors.items()}
            by_label[label] = {dim: (anchors[dim][0][k], anchors[dim][1][k]) for dim, k in own.items() if len(k)}
        for batch in batches:
            label = np.asarray(batch.column("label"))
            for one in np.unique(label).tolist():
                if not by_label.get(one):
                    continue
                part = batch.take(pa.array(np.flatnonzero(label == one)))
                (ids, unknown), row = ids_of(part), np.asarray(part.column("row"))
                for mine, scores, there in blocks(part, by_label[one]):
                    able = row[there] != rows_[mine, None]
                    best.add(mine, scores, able, ids[there], unknown[there], row[there])
        yield from best.batches(["slot", "score", "vec_id", "row"])

    return find


def negative_finder(wave):
    """A mapInArrow function over (row, vec_id, label, embedding): for each anchor and positive the best rows of other labels in its window."""

    def find(batches):
        labels, low, high, anchors = wave.value
        best = Best(labels.shape[0] * POSITIVES, NEGATIVES)
        for batch in batches:
            label = np.asarray(batch.column("label"))
            (ids, unknown), row = ids_of(batch), np.asarray(batch.column("row"))
            for mine, scores, there in blocks(batch, anchors):
                others = label[there] != labels[mine, None]
                for k in range(POSITIVES):
                    able = others & (scores <= high[mine, k, None]) & (scores >= low[mine, k, None])
                    best.add(mine * POSITIVES + k, scores, able, ids[there], unknown[there], row[there])
        yield from best.batches(["slot", "score", "vec_id", "row"])

    return find


FOUND = "slot long, score long, vec_id long, row long"


def ranked(found: DataFrame, most: int) -> DataFrame:
    """The first rows of each slot, with `rank` from 1."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def by_length(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    return vectors_of(table.column("embedding")) if table.num_rows else {}


def mine(vectors: DataFrame, every: int = 50, wave_rows: int = WAVE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors (vec_id, label, embedding).

    Anchors are the rows whose vec_id is divisible by `every`.
    """
    spark = vectors.sparkSession
    limit_batches(spark)
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    sound = vectors.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding"
    )
    rows = stored(sound, "mined-rows")
    anchors = ordered(rows.where(F.col("vec_id") % every == 0), ["vec_id", "row"], "mined-anchors")
    sizes = anchors.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    bases = sizes.select("_part", (F.col("_first") - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_base"))
    place = F.col("_at") - F.col("_base")
    anchors = stored(anchors.join(bases, "_part").select("row", "vec_id", "label", "embedding", F.expr(f"cast(_at - _base as bigint) div {wave_rows}").alias("wave"), place.alias("place")), "mined-waves")
    waves = anchors.agg(F.max("wave")).first()[0]
    made = None
    for n in range(0 if waves is None else waves + 1):
        wave = anchors.where(F.col("wave") == n)
        held = wave.orderBy("place").toArrow()  # at most wave_rows
        labels, lengths = np.asarray(held.column("label")), by_length(held)
        sent = spark.sparkContext.broadcast((np.asarray(held.column("row")), labels, lengths))
        found = stored(ranked(rows.mapInArrow(positive_finder(sent), FOUND), POSITIVES), "mined-positives")
        sent.destroy()  # what it was for is stored
        low, high = np.ones((len(labels), POSITIVES), np.int64), np.zeros((len(labels), POSITIVES), np.int64)
        best = found.select("slot", "rank", "score").toArrow()  # at most POSITIVES for each
        at = (np.asarray(best.column("slot")), np.asarray(best.column("rank")) - 1)
        scores = best.column("score").to_pylist()
        low[at], high[at] = [-(-LOW * s // 100) for s in scores], [HIGH * s // 100 for s in scores]
        sent = spark.sparkContext.broadcast((labels, low, high, lengths))
        negatives = ranked(rows.mapInArrow(negative_finder(sent), FOUND), NEGATIVES)
        negatives = negatives.select(
            F.expr(f"slot div {POSITIVES}").alias("anchor"), (F.col("slot") % POSITIVES + 1).alias("positive"), "rank",
            F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"),
        )
        positives = found.select(F.col("slot").alias("anchor"), F.col("rank").cast("long").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        names = wave.select((F.col("place") % wave_rows).alias("anchor"), F.col("vec_id").alias("anchor_id"))
        out = negatives.join(positives, ["anchor", "positive"]).join(names, "anchor").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
        )
        out = stored(out, "mined-negatives")
        sent.destroy()
        made = out if made is None else made.union(out)
    if made is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return made


def contract_label(vectors: DataFrame) -> DataFrame:
    """Every seventh id's label is the next one of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", moved.alias("label"), "embedding")


#: All products of anchors with all rows, ranked.
ORACLE_SQL = r"""
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda v: floor(256e0 * v::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM sound a JOIN sound b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 3
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(contract_label(read(spark, sf_dir, "embeddings")))
