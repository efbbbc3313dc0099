"""Removal of byte strings of LENGTH bytes that start anywhere else, by interval expansion on a Burrows-Wheeler transform.

Co-location. Every window of LENGTH bytes picks its leftmost least hash of GRAM bytes, its anchor; equal windows pick equal
anchors at equal offsets. The windows that pick one anchor are a run, and the run's bytes are a segment; each window of
a document lies in one segment only. Segments meet by the hash of their anchor's bytes; an anchor that occurs once
drops out. Segments equal in all bytes repeat each other, so all their windows are covered at once, and one stands
for all of them in what follows.

Expansion. The remaining distinct segments of a group are worked on together, many groups at a time: their suffixes are
sorted to the depth that matters, and from the transform all intervals of strings are extended backwards, breadth
first, one byte a level. The level at which an interval's right bound is first met is the common prefix there, so
common prefixes come out by increasing value; at level LENGTH the expansion stops, and the bounds not met by
then have common prefixes of LENGTH or more: those suffixes start a repeated string.

Large groups (over GROUP_BYTES) are split before that: a segment is cut into its earlier and its later windows, and
each part moves to the group of the bytes that all its windows share. Equal parts merge, parts with a core of their own
drop out, and the rest is split again, down to single windows, which are equal or not. Nothing is left out.

Defined cases: a null text counts as empty; texts shorter than LENGTH keep all bytes; equal rows repeat each other;
a null doc_id stays null; very long texts are worked on in stretches of PLACES windows, with the same anchors as in one; other
columns are not read; an empty table gives no rows. Spans may cut UTF-8 characters, so what is kept is binary; the column
text has it without the characters that were cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import limit_batches, read, stored, whole_runs
from .shingles import _powers, mixed
from .tokens import text_slices

LENGTH = 400
GRAM = 48
#: Bytes of the segments of one group that a task takes at once; larger groups are split.
GROUP_BYTES = 2 << 20
#: Bytes of segments worked on together in a task.
BATCH_BYTES = 1 << 18
#: Bits of a place within a stretch of hashes, and how many windows a stretch has.
PLACE_BITS = 28
PLACES = 1 << 27
#: Rounds of halving after which every segment is a single window: more than any run of LENGTH - GRAM + 1 windows needs.
MOST_ROUNDS = 24


def _gram_hashes(running: np.ndarray, down: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of `size` bytes from prefix sums of weighted bytes."""
    return mixed((running[size:] - running[:-size]) * down[: len(running) - size])


def least_places(hashes: np.ndarray, window: int) -> np.ndarray:
    """The place of the leftmost least hash of each window of so many hashes, by their highest 64 - PLACE_BITS bits."""
    low = np.uint64(PLACE_BITS)
    out = np.empty(len(hashes) - window + 1, dtype=np.int64)
    for at in range(0, len(out), PLACES):
        part = hashes[at : at + PLACES + window - 1]
        # Cut hashes with their places in the stretch behind them.
        keys = (part >> low) << low | np.arange(len(part), dtype=np.uint64)
        blocks = np.full(-(-len(part) // window) * window, np.uint64(0xFFFFFFFFFFFFFFFF))
        blocks[: len(part)] = keys
        blocks = blocks.reshape(-1, window)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        last = len(part) - window + 1
        least = np.minimum(behind[:last], ahead[window - 1 : window - 1 + last]) & np.uint64((1 << PLACE_BITS) - 1)
        out[at : at + last] = least.astype(np.int64) + at
    return out


def anchored_segments(blobs: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Arrays over all anchors of all texts: text number, first and last window start, anchor (in the text), and hashes.

    The hashes are those of the anchor's bytes and of the segment, its anchor's offset and its width.
    """
    window = length - gram + 1  # hashes in a window
    data = np.frombuffer(b"".join(blobs), dtype=np.uint8)
    sizes = np.array([len(b) for b in blobs])
    ends = np.cumsum(sizes)
    if not (sizes >= length).any():
        return [np.zeros(0, dtype=t) for t in (int, int, int, int, np.uint64, np.uint64)]
    up, down = _powers(1 << max(20, len(data).bit_length()))
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])))
    hashes = _gram_hashes(running, down, gram)
    least = least_places(hashes, window)
    starts = np.arange(len(least))
    owner = np.searchsorted(ends, starts, side="right")
    inside = starts + length <= ends[owner]
    starts, owner, anchor = starts[inside], owner[inside], least[inside]
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))))
    final = np.append(first[1:], len(starts)) - 1
    owner, low, high, anchor = owner[first], starts[first], starts[final], anchor[first]
    whole = (running[high + length] - running[low]) * down[low]
    whole = mixed(whole ^ mixed((high - low).astype(np.uint64) * np.uint64(4096) + (anchor - low).astype(np.uint64)))
    base = (ends - sizes)[owner]
    return [owner, low - base, high - base, anchor - base, hashes[anchor], whole]


def _anchor_rows(batches):
    for batch in batches:
        for a, _, texts in text_slices(batch):
            owner, low, high, anchor, group, whole = anchored_segments([t.encode() for t in texts])
            rows = pa.array(owner + a)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(rows), batch.column("row").take(rows), pa.array(low.astype(np.int32)),
                    pa.array(high.astype(np.int32)), pa.array(anchor.astype(np.int32)), pa.array(group.view(np.int64)), pa.array(whole.view(np.int64)),
                ],
                names=["id", "row", "low", "high", "anchor", "group", "whole"],
            )


def suffix_order(text: np.ndarray, symbols: int, depth: int) -> np.ndarray:
    """Suffixes of a text of symbols below `symbols` sorted to depth at least."""
    n = len(text)
    reach = int(62 / np.log2(symbols + 1))
    key = np.zeros(n, dtype=np.int64)
    padded = np.concatenate((text + 1, np.zeros(reach, np.int64)))
    for k in range(reach):
        key = key * (symbols + 1) + padded[k : k + n]
    order = np.argsort(key)
    key = key[order]
    # A suffix's rank is the first row of those that equal it so far; only rows that equal a neighbour are sorted again.
    rank = np.empty(n, dtype=np.int64)
    rows = np.arange(n)
    while True:
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[order[rows]] = rows[np.flatnonzero(new)][np.cumsum(new) - 1]
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if reach >= depth or not len(tied):
            return order
        rows = rows[tied]
        suffixes = order[rows]
        behind = suffixes + reach
        key = rank[suffixes] * (n + 2) + np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        sort = np.argsort(key)
        order[rows], key = suffixes[sort], key[sort]
        reach *= 2


def repeated_starts(segments: list[bytes], length: int = LENGTH) -> np.ndarray:
    """For all bytes of the segments, laid end to end, whether a string of `length` bytes in another place starts there."""
    parts = [np.frombuffer(s, dtype=np.uint8) for s in segments]
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes + 1) - 1
    n = int(ends[-1]) + 1
    stops = len(parts)
    text = np.empty(n, dtype=np.int64)  # each segment ends in a stop of its own, below all bytes
    held = np.ones(n, dtype=bool)
    held[ends] = False
    text[ends] = np.arange(stops)
    text[held] = np.concatenate(parts).astype(np.int64) + stops
    order = suffix_order(text, stops + 256, length)
    before = text[order - 1]  # the transform; the suffix at 0 is preceded by the last stop
    # Where a row's suffix goes when the byte before it is put in front: rows of a byte keep their order.
    by_byte = np.argsort(before, kind="stable").astype(np.int32)
    moved = np.empty(n, dtype=np.int32)
    moved[by_byte] = np.arange(n, dtype=np.int32)
    # The rows with the same byte before them next above and below; a stop, which nothing crosses, is its own.
    usable = before >= stops
    same = before[by_byte[1:]] == before[by_byte[:-1]]
    above, below = np.full(n, -1, dtype=np.int32), np.full(n, n, dtype=np.int32)
    above[by_byte[1:][same]] = by_byte[:-1][same]
    below[by_byte[:-1][same]] = by_byte[1:][same]
    above[~usable], below[~usable] = n, -1
    met = np.zeros(n + 1, dtype=bool)  # bounds whose common prefix is known to be shorter than length
    met[[0, n]] = True
    low, high = np.array([0], dtype=np.int32), np.array([n], dtype=np.int32)
    for level in range(length):
        if not len(low):
            break
        size = high - low
        single = size == 1
        at = low[single]
        at = moved[at[usable[at]]]
        new_low, new_high = [at], [at + 1]
        low, high, size = low[~single], high[~single], size[~single]
        if len(low):
            first = np.cumsum(size, dtype=np.int32) - size
            place = np.repeat(low - first, size)
            place += np.arange(len(place), dtype=np.int32)
            # An extension's rows are neighbours: it begins and ends at the interval's first and last row of its byte.
            new_low.append(np.sort(moved[place[above[place] < np.repeat(low, size)]]))
            new_high.append(np.sort(moved[place[below[place] >= np.repeat(high, size)]]) + 1)
        if level == 0:  # the stops' own strings
            new_low.append(np.arange(stops, dtype=np.int32))
            new_high.append(np.arange(1, stops + 1, dtype=np.int32))
        low, high = np.concatenate(new_low), np.concatenate(new_high)
        fresh = ~met[high]
        low, high = low[fresh], high[fresh]
        met[high] = True
    long = ~met[1:n] if n > 1 else np.zeros(0, bool)
    starts = np.zeros(n, dtype=bool)
    starts[order[1:][long]] = True
    starts[order[:-1][long]] = True
    return starts[held]


def covered_runs(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs (first, end) covered by strings of `length` bytes at the given starting places (ascending)."""
    if not len(starts):
        return starts, starts
    breaks = np.flatnonzero(starts[1:] > starts[:-1] + length)
    first = np.concatenate((starts[:1], starts[breaks + 1]))
    end = np.concatenate((starts[breaks], starts[-1:])) + length
    return first, end


def _repeat_rows(batches):
    """Covered runs of the segments of each group (rows sorted by group)."""
    for table in whole_runs(batches, "group", least_rows=1024):
        segments = table.column("bytes").to_pylist()
        groups = table.column("group").to_numpy()
        low = table.column("low").to_numpy()
        sizes = np.cumsum([len(s) for s in segments])
        bounds = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1], [True])))
        out: list[list] = [[], [], []]
        a = 0
        while a < len(segments):
            base = sizes[a - 1] if a else 0
            fitting = bounds[(bounds > a) & (sizes[np.maximum(bounds, 1) - 1] - base <= BATCH_BYTES)]
            b = int(fitting[-1]) if len(fitting) else int(bounds[bounds > a][0])
            found = np.flatnonzero(repeated_starts(segments[a:b]))
            owner = np.searchsorted(sizes[a:b] - base, found, side="right") + a
            for k in np.unique(owner).tolist():
                here = found[owner == k] - (sizes[k] - len(segments[k]) - base)
                for first, end in zip(*covered_runs(here, LENGTH)):
                    out[0].append(k)
                    out[1].append(int(low[k] + first))
                    out[2].append(int(low[k] + end))
            a = b
        rows = pa.array(out[0], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [table.column("id").combine_chunks().take(rows), table.column("row").combine_chunks().take(rows), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())],
            names=["id", "row", "first", "end"],
        )


def _cut_rows(batches):
    """Bytes of the wanted segments of each document."""
    kept = ["group", "whole", "low", "high", "anchor", "copies"]
    for batch in batches:
        for at in range(batch.num_rows):
            text = (batch.column("text")[at].as_py() or "").encode()
            wanted = batch.column("wanted")[at].as_py()
            for a in range(0, len(wanted), 2000):
                part = wanted[a : a + 2000]
                columns = [pa.array([w[k] for w in part], batch.column("wanted").type.value_type.field(k).type) for k in kept]
                cut = pa.array([text[w["low"] : w["high"] + LENGTH] for w in part], pa.binary())
                ids = batch.column("id").take(pa.array([at] * len(part)))
                rows = batch.column("row").take(pa.array([at] * len(part)))
                yield pa.RecordBatch.from_arrays([ids, rows, *columns, cut], names=["id", "row", *kept, "bytes"])


def _kept_rows(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            kept, spans, sizes, left = [], [], [], []
            for text, runs in zip(part.column("text").to_pylist(), part.column("runs").to_pylist()):
                data = (text or "").encode()
                merged: list[list[int]] = []
                for first, end in sorted((r["first"], r["end"]) for r in runs or []):
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([first, end])
                edges = [0, *(x for run in merged for x in run), len(data)]
                parts = [data[x:y] for x, y in zip(edges[::2], edges[1::2])]
                kept.append(b"".join(parts))
                left.append(None if text is None else "".join(p.decode(errors="ignore") for p in parts))
                spans.append([{"first": x, "end": y} for x, y in merged])
                sizes.append(len(data))
            kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(left, pa.string())],
                names=["doc_id", "n_bytes", "spans", "kept", "text"],
            )


def remove_repeats(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs, first to end, of bytes), kept (bytes that are left) and text for each row of docs.

    text is what is left as text: a character of which a removed run took a part is gone; null where the text was.
    """
    limit_batches(docs.sparkSession)
    rows = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("doc_id", "text").alias("row"), "text"
    )
    anchors = stored(
        rows.select("id", "row", "text").mapInArrow(
            _anchor_rows, "id long, row long, low int, high int, anchor int, group long, whole long"
        ),
        "anchors",
    )
    # Keys to join by are stored first: a join of two plain shuffles is one whose hot partitions Spark can split.
    often = stored(anchors.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group"), "anchor-groups")
    hits = stored(anchors.join(often, "group"), "anchor-hits")
    copies = F.count("*").alias("copies")
    kinds = stored(hits.groupBy("group", "whole").agg(copies, F.min(F.struct("id", "row", "low", "high", "anchor")).alias("one")), "segments")
    repeated = kinds.where("copies > 1").select("group", "whole")
    covered = hits.join(repeated, ["group", "whole"], "left_semi").select(
        "id", "row", F.col("low").alias("first"), (F.col("high") + LENGTH).alias("end")
    )
    mixed_groups = kinds.groupBy("group").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a <> b")
    mixed_groups = stored(mixed_groups.select("group"), "mixed-groups")
    wanted = (
        kinds.join(mixed_groups, "group")
        .groupBy("one.id", "one.row")
        .agg(F.collect_list(F.struct("group", "whole", "one.low", "one.high", "one.anchor", "copies")).alias("wanted"))
    )  # segments of one document
    segments = stored(
        rows.select("id", "row", "text").join(wanted, ["id", "row"]).mapInArrow(
            _cut_rows,
            "id long, row long, group long, whole long, low int, high int, anchor int, copies long, bytes binary",
        ),
        "segment-bytes",
    )
    runs = [covered]
    for _ in range(MOST_ROUNDS):
        sized = segments.groupBy("group").agg(F.sum(F.octet_length("bytes")).alias("size"))
        large = stored(sized.where(F.col("size") > group_bytes).select("group"), "large-groups")
        none_large = large.isEmpty()
        small = segments if none_large else segments.join(large, "group", "left_anti")
        found = (
            small.select("id", "row", "low", "group", "bytes").repartition("group").sortWithinPartitions("group")
            .mapInArrow(_repeat_rows, "id long, row long, first int, end int")
        )
        runs.append(stored(found, "repeats"))
        if none_large:
            break
        segments, more = _split(segments.join(large, "group", "left_semi"))
        runs.append(more)
    else:
        raise RuntimeError(f"segments larger than {group_bytes} bytes are left after {MOST_ROUNDS} rounds")
    every = runs[0]
    for other in runs[1:]:
        every = every.union(other)
    by_row = every.groupBy("id", "row").agg(F.collect_set(F.struct("first", "end")).alias("runs"))  # of one document
    kinds = rows.select(
        "doc_id", F.lit(0).cast("long").alias("n_bytes"), F.expr("cast(null as array<struct<first:int,end:int>>)").alias("spans"),
        F.expr("cast(null as binary)").alias("kept"), F.expr("cast(null as string)").alias("text"),
    ).schema
    return rows.join(by_row, ["id", "row"], "left").select("doc_id", "text", "runs").mapInArrow(_kept_rows, kinds)


def _split(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Halves of segments, grouped by the bytes that all their windows share; and the runs of those that are equal.

    Which half a window is in depends on its place to the anchor only, so equal windows stay together.
    """
    # The windows of a group's halves: places from the anchor back, the middle of those that the group has.
    reach = segments.groupBy("group").agg(F.max(F.col("anchor") - F.col("low")).alias("far"), F.min(F.col("anchor") - F.col("high")).alias("near"))
    middle = segments.join(reach, "group").withColumn("cut", F.col("anchor") - F.floor((F.col("far") + F.col("near")) / 2).cast("int"))

    def part(low, high, side: int):
        # Windows from low to high; the group's windows of this side reach from `outer` to `inner` before the anchor.
        outer = F.col("far") if side == 0 else F.col("anchor") - F.col("cut")
        inner = F.col("anchor") - F.col("cut") + 1 if side == 0 else F.col("near")
        core_from, core_to = F.col("anchor") - inner, F.col("anchor") - outer + LENGTH
        core = F.substring("bytes", core_from - F.col("low") + 1, core_to - core_from)
        return F.struct(
            low.alias("low"), high.alias("high"), F.xxhash64("group", F.lit(side), core).alias("group"),
            F.substring("bytes", low - F.col("low") + 1, high - low + LENGTH).alias("bytes"),
        )

    halves = F.array(part(F.col("low"), F.least(F.col("high"), F.col("cut") - 1), 0), part(F.greatest(F.col("low"), F.col("cut")), F.col("high"), 1))
    pieces = (
        middle.select("id", "row", "anchor", "copies", F.explode(halves).alias("h"))
        .where("h.low <= h.high")
        .select("id", "row", "anchor", "copies", "h.low", "h.high", F.col("h.group").alias("group"), F.col("h.bytes").alias("bytes"))
        .withColumn("whole", F.xxhash64("bytes", F.col("anchor") - F.col("low")))
    )
    pieces = stored(pieces, "segment-halves")
    kinds = pieces.groupBy("group", "whole").agg(
        F.sum("copies").alias("copies"), F.count("*").alias("n"), F.min(F.struct("id", "row", "low")).alias("one")
    )
    equal = pieces.join(kinds.where("n > 1").select("group", "whole"), ["group", "whole"], "left_semi")
    runs = equal.select("id", "row", F.col("low").alias("first"), (F.col("high") + LENGTH).alias("end"))
    several = kinds.groupBy("group").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a <> b").select("group")
    ones = kinds.join(several, "group").select("group", "whole", "one.*", F.col("copies").alias("all"))
    left = pieces.join(ones, ["group", "whole", "id", "row", "low"]).drop("copies").withColumnRenamed("all", "copies")
    return stored(left.dropDuplicates(["group", "whole"]), "split-segments"), runs


#: Digests of all windows, taken from blocks of the text in hex.
ORACLE_SQL = r"""
WITH bytes AS MATERIALIZED (SELECT doc_id, text IS NULL AS missing, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS MATERIALIZED (
  SELECT doc_id, a, substr(h, 2 * a + 1, 1600) AS block
  FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 399, 0), 400)) AS a FROM bytes)
),
starts AS MATERIALIZED (
  SELECT doc_id, a + k AS i, md5(substr(block, 2 * k + 1, 800)) AS digest
  FROM (SELECT doc_id, a, block, unnest(range(0, least(len(block) // 2 - 399, 400))) AS k FROM blocks)
),
repeated AS (SELECT digest FROM starts GROUP BY digest HAVING count(*) > 1),
hits AS MATERIALIZED (SELECT doc_id, i FROM starts SEMI JOIN repeated USING (digest)),
marked AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, true) AS fresh FROM hits
),
runs AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, run, min(i) AS first, max(i) + 400 AS past FROM runs GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, run, coalesce(lag(past) OVER (PARTITION BY doc_id ORDER BY run), 0) AS a, first AS b, past,
    lead(first) OVER (PARTITION BY doc_id ORDER BY run) AS next
  FROM spans
),
parts AS (
  SELECT p.doc_id, run, past - b AS size, substr(h, 2 * a + 1, 2 * (b - a)) AS left_of,
    CASE WHEN next IS NULL THEN substr(h, 2 * past + 1) ELSE '' END AS right_of
  FROM pieces p JOIN bytes USING (doc_id)
),
-- Characters that were cut: bytes 80 to BF at a part's start, and a first byte with too few behind it at its end.
whole AS (
  SELECT *, regexp_replace(regexp_replace(left_of, '^([89AB][0-9A-F])+', ''),
      '^((?:[0-9A-F]{2})*?)(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-9A-F](?:[89AB][0-9A-F]){0,2})$', '\1') AS left_text,
    regexp_replace(right_of, '^([89AB][0-9A-F])+', '') AS right_text
  FROM parts
),
kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(size) AS n_removed, string_agg(left_of || right_of, '' ORDER BY run) AS rest,
    string_agg(left_text || right_text, '' ORDER BY run) AS rest_text
  FROM whole GROUP BY doc_id
)
SELECT b.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256,
  CASE WHEN NOT missing THEN decode(unhex(coalesce(rest_text, h))) END AS text
FROM bytes b LEFT JOIN kept k USING (doc_id)
"""


def op5_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["first"]).cast("long")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "text",
    )
