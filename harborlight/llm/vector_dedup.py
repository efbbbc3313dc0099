"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks.

Equal vectors of a label become one class. Each class's unit vector is projected on Gaussian directions, shifted and
quantised; PROJECTIONS quantised values together are its bucket in one of TABLES tables. For unit vectors cosine 0.93 is
distance 0.374, where one value agrees with probability 0.85 (bucket width 2) and a pair meets in some table with
probability 0.999; unrelated vectors meet in a bucket with probability 1e-5. All pairs of a bucket are checked by exact
cosine in double precision, inside a task, in blocks of bounded size; a pair that meets in several tables counts in
the first. What leaves a block is, for each vector, its number of links and one edge of a spanning forest.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components, or whose label is null, links
with nothing; vectors of different lengths never link, long ones are hashed by directions of their length; repeated rows, and
rows that share a vec_id, count as vectors of their own, each with its links and the component of its vector; a null
vec_id links as any other but names no component, and is kept only where no row of the component has an id; other
columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import limit_batches, read, stored, whole_runs
from .components import connected_components, forest

COSINE = 0.93
PROJECTIONS = 16
TABLES = 88
WIDTH = 2.0
SEED = 20_240_607
#: Rows of one side of a block: a bucket of more is dealt into all pairs of such parts.
BLOCK_ROWS = 1024
#: Buckets up to this size are checked together, by comparing each row with the next ones.
SMALL = 24


def matrix(column) -> np.ndarray:
    """Rows of a list column, scaled by their largest component, in double precision; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(sizes.max(initial=1))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out / np.abs(out).max(axis=1, keepdims=True)


def signer(projections: int, tables: int, width: float, seed: int):
    """A mapInArrow function: (rep, kind, dim, embedding) to (rep, kind, signature), a bucket number for each table."""

    def sign(batches):
        plans: dict[int, tuple] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                if dim not in plans:
                    rng = np.random.RandomState(seed + dim)
                    plans[dim] = (
                        rng.standard_normal((dim, tables * projections)),
                        rng.uniform(0, width, tables * projections),
                        rng.randint(1, 1 << 31, projections).astype(np.int64) * 2 + 1,
                    )
                directions, shifts, mixers = plans[dim]
                part = batch.take(pa.array(rows))
                x = matrix(part.column("embedding"))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for a in range(0, len(x), 2048):
                    cells = np.floor((x[a : a + 2048] @ directions + shifts) / width).astype(np.int64)
                    buckets = (cells.reshape(-1, tables, projections) * mixers).sum(axis=2)
                    buckets = (buckets ^ (buckets >> 29)).astype(np.int32)
                    ends = np.arange(len(buckets) + 1, dtype=np.int32) * tables
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("rep").slice(a, len(buckets)),
                            part.column("kind").slice(a, len(buckets)),
                            pa.ListArray.from_arrays(pa.array(ends), pa.array(buckets.ravel())),
                        ],
                        names=["rep", "kind", "signature"],
                    )

    return sign


def near_pairs(x: np.ndarray, keys: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs i < j of equal key (keys are in runs) with cosine of at least least."""
    norms = np.linalg.norm(x, axis=1)
    bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(bounds)
    left, right = [], []
    run_end = np.repeat(bounds[1:], sizes)
    small = np.repeat(sizes <= SMALL, sizes)
    for step in range(1, min(SMALL, int(sizes.max(initial=1)))):
        i = np.flatnonzero(small[: len(x) - step] & (np.arange(len(x) - step) + step < run_end[: len(x) - step]))
        if not len(i):
            break
        for a in range(0, len(i), 65_536):
            k = i[a : a + 65_536]
            cosine = np.einsum("ij,ij->i", x[k], x[k + step]) / (norms[k] * norms[k + step])
            k = k[cosine >= least]
            left.append(k)
            right.append(k + step)
    for a, b in zip(bounds[:-1][sizes > SMALL], bounds[1:][sizes > SMALL]):
        for top in range(a, b, 1024):
            end = min(top + 1024, b)
            cosine = (x[top:end] @ x[top:b].T) / (norms[top:end, None] * norms[None, top:b])
            i, j = np.nonzero(np.triu(cosine >= least, 1))
            left.append(i + top)
            right.append(j + top)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def checker(least: float):
    """A mapInArrow function over blocks: links and one forest edge for each class that has a near one there."""

    def check(batches):
        for table in whole_runs(batches, "block"):
            keys = table.column("block").to_numpy()
            x = matrix(table.column("embedding"))
            i, j = near_pairs(x, keys, least)
            if not len(i):
                continue
            tables, sides = table.column("table").to_numpy(), table.column("side").to_numpy()
            across = table.column("across").to_numpy()
            signature = np.asarray(table.column("signature").combine_chunks().flatten()).reshape(len(keys), -1)
            fresh = ~(across[i] & (sides[i] == sides[j]))  # a block of two parts has only the pairs between them
            for a in range(0, len(i), 65_536):
                s = slice(a, a + 65_536)
                met = signature[i[s]] == signature[j[s]]
                fresh[s] &= met.argmax(axis=1) == tables[i[s]]
            i, j = i[fresh], j[fresh]
            weight = table.column("copies").to_numpy()
            links = np.bincount(i, weight[j], len(keys)) + np.bincount(j, weight[i], len(keys))
            rows = np.flatnonzero(links)
            rep = table.column("rep").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[rows]), pa.array(rep[forest(len(keys), i, j)[rows]]), pa.array(links[rows].astype(np.int64))],
                names=["rep", "root", "links"],
            )

    return check


def near_vectors(
    vectors: DataFrame,
    cosine: float = COSINE,
    projections: int = PROJECTIONS,
    tables: int = TABLES,
    width: float = WIDTH,
    seed: int = SEED,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label)."""
    limit_batches(vectors.sparkSession)
    finite = F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label").withColumn(
        "sound", F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    )
    sound = rows.where("sound")
    # A class is a label with a vector; its number, given once and stored, names it: vec_ids may be null or repeated.
    classes = stored(
        sound.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .withColumn("rep", F.monotonically_increasing_id()),
        "vector-classes",
    )
    dim = F.size("embedding")
    signed = stored(
        classes.select("rep", F.xxhash64("label", dim).alias("kind"), dim.alias("dim"), "embedding").mapInArrow(
            signer(projections, tables, width, seed), "rep long, kind long, signature array<int>"
        ),
        "vector-signatures",
    )
    keys = (
        signed.select("rep", "kind", F.posexplode("signature").alias("table", "bucket"))
        .select("rep", "table", F.xxhash64("kind", "table", "bucket").alias("bucket"))
    )
    shared = keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / block_rows).cast("int")
    members = keys.join(shared, "bucket").withColumn("parts", parts)
    members = members.withColumn("side", F.pmod(F.xxhash64("rep", "bucket"), F.col("parts")).cast("int"))
    # A bucket of p parts is p * (p + 1) / 2 blocks: each part alone, and each two of them.
    others = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.struct(F.least("side", o).alias("low"), F.greatest("side", o).alias("high")),
    )
    blocks = members.select("rep", "table", "side", "bucket", F.explode(others).alias("pair")).select(
        "rep", "table", "side", (F.col("pair.low") != F.col("pair.high")).alias("across"),
        F.xxhash64("bucket", "pair.low", "pair.high").alias("block"),
    )
    payload = classes.select("rep", "embedding", "copies").join(signed.drop("kind"), "rep")
    found = stored(
        blocks.join(payload, "rep")
        .repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(checker(cosine), "rep long, root long, links long"),
        "vector-links",
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    placed = classes.join(links, "rep", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.withColumn("component", F.coalesce("component", "rep"))
    names = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    # Stored, so that the join with all rows is one whose hot partitions Spark can split.
    result = stored(
        placed.join(names, "component").select(
            "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
        ),
        "vector-results",
    )
    linked = sound.select("vec_id", "label", "embedding").join(result, ["label", "embedding"])
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.select("vec_id", "n_links", "component_id").union(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )


#: All pairs of a label, and what each vector reaches over links.
ORACLE_SQL = r"""
WITH RECURSIVE sound AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
    AND len(list_filter(embedding, lambda v: v <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM sound a JOIN sound b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
),
reached AS (
  SELECT vec_id AS node, vec_id AS other FROM embeddings
  UNION
  SELECT r.node, l.b FROM reached r JOIN links l ON r.other = l.a
),
components AS (SELECT node, min(other) AS component_id FROM reached GROUP BY node),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN components c ON c.node = e.vec_id LEFT JOIN degrees d ON d.a = e.vec_id
"""


def op1_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
