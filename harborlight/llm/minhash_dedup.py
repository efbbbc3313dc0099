"""Near-duplicate documents by SetSketch registers, verified on full shingle sets.

A document's set holds its distinct five-word shingles. Documents of equal sets are one class. A class's sketch has
REGISTERS values: for each of as many hash functions the least hash of the set, read as an exponential variable and
rounded to a power of BASE (its exponent, cut to 16 bits). Such registers merge by maximum and are equal with about
the sets' Jaccard similarity. ROWS registers make a band; classes that agree in a band share a bucket. For a pair of
similarity 0.75 all 40 bands of 4 fail together with probability 3e-7.

Buckets are worked off without listing their pairs. First each class is compared with the smallest class of its
buckets: the joint likelihood of the two sketches estimates the similarity, the best estimate of each class is verified
on the full sets, and verified links give components. Then, only in buckets that still hold several components, all
pairs across components are estimated inside tasks, in blocks of bounded size; rows with a pair that may reach the
threshold (LEAST_ESTIMATE is nearly five standard deviations below it) come once more with their full sets, and
every such pair is verified there, by bit sets over the block's shared shingles. Of the links of a block only a
spanning forest leaves it; no list of pairs is ever made.

Defined cases: a null or empty text, or one without words, has an empty set and links with nothing; rows that share a
doc_id are one document, linked by any of its texts, and each has the size of its own text's set; equal texts are copies of a class and share
a component; a null doc_id is in no component but its own; a very long text's set is held by one task at a time, at 8
bytes a shingle; other columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_shuffles, limit_batches, read, stored, whole_runs
from .components import connected_components, forest
from .shingles import mixed, shingle_sets
from .tokens import text_slices

SIMILARITY = (75, 100)
REGISTERS = 160
ROWS = 4
BASE = 1.001
SEED = 77
LEAST_ESTIMATE = 0.59
#: Fewest equal registers of a pair that is estimated: eight standard deviations below those of similarity 0.75.
LEAST_EQUAL = 75
#: Rows, and shingles, of one side of a block: a bucket of more is dealt into all pairs of such parts.
BLOCK_ROWS = 512
BLOCK_SHINGLES = 1 << 20


def sketch_parameters(registers: int = REGISTERS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    values = mixed(np.arange(1, 2 * registers + 1, dtype=np.uint64) * np.uint64(seed * 2 + 1))
    return values[:registers].astype(np.uint32), values[registers:].astype(np.uint32) | np.uint32(1)


def sketch(hashes: np.ndarray, parameters: tuple[np.ndarray, np.ndarray], base: float = BASE) -> np.ndarray:
    """The registers of a set of 64-bit hashes (not empty)."""
    flips, factors = parameters
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(flips), 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(short), 512):
        x = (short[a : a + 512, None] ^ flips) * factors
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        np.minimum(least, x.min(axis=0), out=least)
    waiting = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(waiting) / np.log(base)) + 700, 0, 65_535).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, base: float = BASE) -> np.ndarray:
    """Joint maximum-likelihood similarity of pairs of sketches (rows) of sets of known sizes."""
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - larger - smaller
    u = (na / (na + nb))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    j = np.linspace(0, 1, 201)[None, :] * top
    share = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (base - 1) / base) / np.log(base)
    more, less = share(u - v * j), share(v - u * j)
    likelihood = larger[:, None] * np.log(more) + smaller[:, None] * np.log(less)
    likelihood += equal[:, None] * np.log(np.maximum(1 - more - less, 1e-12))
    return np.take_along_axis(j, likelihood.argmax(axis=1)[:, None], 1)[:, 0]


def _sketch_rows(batches):
    parameters = sketch_parameters()
    for batch in batches:
        ids = batch.column("doc_id")
        for a, b, texts in text_slices(batch):
            sets = shingle_sets(texts)
            digests = [_digest(s) if len(s) else None for s in sets]
            registers = [sketch(s, parameters).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(a, b - a).cast(pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(registers, pa.binary()),
                ],
                names=["doc_id", "digest", "n_shingles", "registers"],
            )


def _band_rows(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.frombuffer(b"".join(batch.column("registers").to_pylist()), dtype=np.int64).reshape(batch.num_rows, -1)
        ends = np.arange(batch.num_rows + 1, dtype=np.int32) * keys.shape[1]
        yield pa.RecordBatch.from_arrays(
            [batch.column("rep"), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))], names=["rep", "bands"]
        )


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), -1)


def _estimate_rows(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            guess = estimate(
                _registers(part.column("ra")), _registers(part.column("rb")),
                part.column("na").to_numpy().astype(float), part.column("nb").to_numpy().astype(float),
            )
            keep = pa.array(guess >= LEAST_ESTIMATE)
            yield pa.RecordBatch.from_arrays(
                [part.column("a").filter(keep), part.column("b").filter(keep), pa.array(guess).filter(keep)],
                names=["a", "b", "estimate"],
            )


def open_pairs(table: pa.Table):
    """(i, j) row arrays: a block's pairs across components whose estimate allows a link, each in its first band only."""
    keys = table.column("block").to_numpy()
    bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    registers = _registers(table.column("registers").combine_chunks())
    n = table.column("n_shingles").to_numpy().astype(float)
    component, band = table.column("component").to_numpy(), table.column("band").to_numpy()
    side, across = table.column("side").to_numpy(), table.column("across").to_numpy()
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        for i in range(a, b - 1):
            j = np.arange(i + 1, b)
            ratio = np.minimum(n[i], n[j]) / np.maximum(n[i], n[j])
            fits = (component[j] != component[i]) & (ratio * SIMILARITY[1] >= SIMILARITY[0])
            if across[i]:
                fits &= side[j] != side[i]
            j = j[fits]
            if not len(j):
                continue
            same = registers[j] == registers[i]
            enough = same.sum(axis=1) >= LEAST_EQUAL
            j, same = j[enough], same[enough]
            if not len(j):
                continue
            j = j[same.reshape(len(j), -1, ROWS).all(axis=2).argmax(axis=1) == band[i]]
            if not len(j):
                continue
            guess = estimate(np.broadcast_to(registers[i], registers[j].shape), registers[j], np.full(len(j), n[i]), n[j])
            j = j[guess >= LEAST_ESTIMATE]
            if len(j):
                yield np.full(len(j), i), j


def _open_rows(batches):
    """The rows of blocks that have an open pair."""
    for table in whole_runs(batches, "block"):
        has = np.zeros(table.num_rows, dtype=bool)
        for i, j in open_pairs(table):
            has[i] = has[j] = True
        if has.any():
            yield from table.select(["block", "rep", "component", "band", "side", "across"]).filter(pa.array(has)).to_batches()


def shared_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets, by bit sets over the elements that more than one set holds."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements, place, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.cumsum(counts > 1) - 1
    shared = counts[place] > 1
    owner, column = owner[shared], rank[place[shared]]
    out = np.zeros(len(i), dtype=np.int64)
    for first in range(0, int(rank[-1]) + 1 if len(rank) else 0, 1 << 16):
        mine = (column >= first) & (column < first + (1 << 16))
        width = min(int(rank[-1]) + 1 - first, 1 << 16)
        bits = np.zeros((len(sets), -(-width // 8)), dtype=np.uint8)
        c = column[mine] - first
        np.bitwise_or.at(bits, (owner[mine], c >> 3), np.left_shift(np.uint8(1), (c & 7).astype(np.uint8)))
        for a in range(0, len(i), 4096):
            both = bits[i[a : a + 4096]] & bits[j[a : a + 4096]]
            out[a : a + 4096] += np.bitwise_count(both).sum(axis=1, dtype=np.int64)
    return out


def _link_rows(batches):
    """A spanning forest of the verified links of each block."""
    part, whole = SIMILARITY
    for table in whole_runs(batches, "block", least_rows=512):
        pairs = list(open_pairs(table))
        if not pairs:
            continue
        i, j = (np.concatenate(x) for x in zip(*pairs))
        rows, place = np.unique(np.concatenate((i, j)), return_inverse=True)
        column = table.column("shingles").combine_chunks()
        sets = [np.frombuffer(column[k].as_buffer(), dtype=np.uint64) for k in rows.tolist()]
        common = shared_counts(sets, place[: len(i)], place[len(i) :])
        n = table.column("n_shingles").to_numpy()
        linked = whole * common >= part * (n[i] + n[j] - common)
        root = forest(table.num_rows, i[linked], j[linked])
        rep = table.column("rep").to_numpy()
        moved = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(rep[root[moved]]), pa.array(rep[moved])], names=["a", "b"])


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _set_rows(batches):
    """Full sets of rows (rep, digest, text) whose text has the digest; of a doc_id's other texts there is none."""
    for batch in batches:
        for a, b, texts in text_slices(batch):
            wanted = batch.column("digest").slice(a, b - a).to_pylist()
            sets = [s.tobytes() if _digest(s) == d else None for s, d in zip(shingle_sets(texts), wanted)]
            blobs = pa.array(sets, pa.binary())
            mask = blobs.is_valid()
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep").slice(a, b - a).filter(mask), blobs.filter(mask)], names=["rep", "shingles"]
            )


def _verify_rows(batches):
    part, whole = SIMILARITY
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("sa"), batch.column("sb")):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            common = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(whole * common >= part * (len(x) + len(y) - common))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])


def _with_sides(pairs: DataFrame, table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """pairs (a, b, ...) with columns of table (rep, ...) for both ends; columns: name to short name."""
    for end in ("a", "b"):
        side = table.select(F.col("rep").alias(end), *(F.col(c).alias(short + end) for c, short in columns.items()))
        pairs = pairs.join(side, end)
    return pairs


def document_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketched documents (doc_id, digest, n_shingles, registers), and each distinct set once (rep, its number; doc, its least doc_id; ...).

    Also links (a, b) between the sets of a doc_id that has several texts.
    """
    sketched = stored(
        docs.select("doc_id", "text").mapInArrow(
            _sketch_rows, "doc_id long, digest binary, n_shingles long, registers binary"
        ),
        "sketches",
    )
    named = sketched.where("digest is not null and doc_id is not null")
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("doc"))
    # A repeated doc_id may stand for several sets, so sets have numbers of their own, given once and stored.
    rows = named.select(F.col("doc_id").alias("doc"), "digest", "n_shingles", "registers")
    classes = firsts.join(rows, ["doc", "digest"]).dropDuplicates(["digest"]).withColumn("rep", F.monotonically_increasing_id())
    classes = stored(classes, "classes")
    several = named.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("doc_id")
    own = named.select("doc_id", "digest").join(several, "doc_id").join(classes.select("digest", "rep"), "digest")
    own = own.select("doc_id", F.col("rep").alias("b"))
    own = own.join(own.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").select("a", "b")
    return sketched, classes, stored(own, "own-links")


def near_documents(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    limit_batches(docs.sparkSession)
    join_by_shuffles(docs.sparkSession)
    sketched, classes, own_links = document_classes(docs)
    keys = (
        classes.select("rep", "registers")
        .mapInArrow(_band_rows, "rep long, bands array<long>")
        .select("rep", F.posexplode("bands").alias("band", "value"))
        .select("rep", "band", F.xxhash64("band", "value").alias("bucket"))
    )
    shared = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("centre")).where("n > 1")
    members = stored(keys.join(shared, "bucket"), "bucket-members")
    sketches = classes.select("rep", "registers", "n_shingles")

    stars = members.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    guessed = _with_sides(stars, sketches, {"registers": "r", "n_shingles": "n"}).select("a", "b", "ra", "rb", "na", "nb")
    guessed = guessed.mapInArrow(_estimate_rows, "a long, b long, estimate double")
    best = guessed.groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a")).select("a", "b")

    # The full sets of the classes that share any bucket: the only ones that can link.
    touched = members.select("rep").distinct().join(classes.select("rep", F.col("doc").alias("doc_id"), "digest"), "rep")
    sets = stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(touched, "doc_id")
        .select("rep", "digest", "text")
        .mapInArrow(_set_rows, "rep long, shingles binary"),
        "shingle-sets",
    )

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        full = _with_sides(pairs, sets, {"shingles": "s"}).select("a", "b", "sa", "sb")
        return stored(full.mapInArrow(_verify_rows, "a long, b long"), name)

    links = verified(best, "first-links").union(own_links)
    components = connected_components(links)
    sketches_placed = sketches.join(components.withColumnRenamed("node", "rep"), "rep", "left").select(
        "rep", "registers", "n_shingles", F.coalesce("component", "rep").alias("component")
    )
    placed = members.join(sketches_placed.drop("registers"), "rep")
    several = (
        placed.groupBy("bucket")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum("n_shingles").alias("shingles"))
        .where("low <> high")
        .select("bucket", "shingles")
    )
    open_members = placed.join(several, "bucket").withColumn(
        "parts", F.ceil(F.greatest(F.col("n") / block_rows, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    )
    open_members = open_members.withColumn("side", F.pmod(F.xxhash64("rep", "bucket"), F.col("parts")).cast("int"))
    # A bucket of p parts is p * (p + 1) / 2 blocks: each part alone, and each two of them.
    others = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.struct(F.least("side", o).alias("low"), F.greatest("side", o).alias("high")),
    )
    blocks = open_members.select("rep", "component", "band", "side", "bucket", F.explode(others).alias("pair")).select(
        "rep", "component", "band", "side", (F.col("pair.low") != F.col("pair.high")).alias("across"),
        F.xxhash64("bucket", "pair.low", "pair.high").alias("block"),
    )

    def by_block(rows: DataFrame) -> DataFrame:
        return rows.repartition("block").sortWithinPartitions("block")

    kinds = "block long, rep long, component long, band int, side int, across boolean"
    flagged = stored(by_block(blocks.join(sketches, "rep")).mapInArrow(_open_rows, kinds), "open-rows")
    loaded = by_block(flagged.join(sketches.join(sets, "rep"), "rep"))
    more = stored(loaded.mapInArrow(_link_rows, "a long, b long"), "more-links")
    # What the first links reach is one step away by now, so few rounds are left.
    components = connected_components(components.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    by_class = classes.select("digest", "rep", "doc").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    by_class = by_class.select("digest", "doc", F.coalesce("component", "rep").alias("number"))
    names = by_class.groupBy("number").agg(F.min("doc").alias("component"))
    # Stored, so that the join with all documents is one whose hot partitions Spark can split.
    by_class = stored(by_class.join(names, "number").select("digest", "component"), "class-components")
    every = sketched.select("doc_id", "digest", "n_shingles").join(by_class, "digest", "left")
    every = every.withColumn("component", F.when(F.col("doc_id").isNotNull(), F.col("component")))
    return every.select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        (F.coalesce("component", "doc_id") == F.col("doc_id")).alias("kept"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one of the smallest doc_id; columns as they are.

    Rows without a doc_id stay; of rows that are equal in doc_id and text one stays.
    """
    away = near_documents(docs).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]  # docs may have columns of the added names
    plain = docs.toDF(*names)
    doc_id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    left = plain.join(away, F.col(doc_id) == F.col("gone"), "left_anti").withColumn("text_hash", F.xxhash64(text))
    return left.dropDuplicates([doc_id, "text_hash"]).select(*names).toDF(*docs.columns)


#: All pairs of sets that share a shingle, and what each document reaches over links.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
placed AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM words),
runs AS (
  SELECT doc_id, n, place,
    concat_ws(' ', word, lead(word, 1) OVER d, lead(word, 2) OVER d, lead(word, 3) OVER d, lead(word, 4) OVER d) AS shingle
  FROM placed WINDOW d AS (PARTITION BY doc_id ORDER BY place)
),
sets AS MATERIALIZED (
  SELECT doc_id, list_sort(list(DISTINCT hash(shingle))) AS s FROM runs WHERE place <= greatest(n - 4, 1) GROUP BY doc_id
),
firsts AS MATERIALIZED (SELECT min(doc_id) AS rep, s FROM sets GROUP BY s),
shingles AS MATERIALIZED (SELECT rep, len(s) AS n, unnest(s) AS shingle FROM firsts),
links AS MATERIALIZED (
  SELECT a.rep AS a, b.rep AS b
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.rep <> b.rep
    AND 100 * a.n >= 75 * b.n AND 100 * b.n >= 75 * a.n
  GROUP BY a.rep, b.rep, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
reached AS (
  SELECT rep AS node, rep AS other FROM firsts
  UNION
  SELECT r.node, l.b FROM reached r JOIN links l ON r.other = l.a
),
components AS (SELECT node, min(other) AS component_id FROM reached GROUP BY node)
SELECT d.doc_id, coalesce(len(s.s), 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
  coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sets s USING (doc_id) LEFT JOIN firsts f ON s.s = f.s LEFT JOIN components c ON c.node = f.rep
"""


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(read(spark, sf_dir, "documents"))
