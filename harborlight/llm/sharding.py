"""Minimax contiguous shards: groups of equal texts in the order of their digests, cut into N runs whose largest is as small as can be.

The capacity is found by binary search: a greedy walk fills shard after shard up to it and sees whether N are enough. The walk
looks up running sums of group sizes in one array of marks, each the end of a block of groups, by binary search; the
array holds at most a few times MARKS entries at any number of groups. Where blocks hold several groups, two walks bound the
capacity from below and above, and only the blocks that walks between the two bounds can touch are parted into finer ones,
at most half as large, until both bounds meet: the capacity is exact (what is open grows with the square of N: MARKS suits some
hundred shards). Then the cuts are made: each at the mark that leaves the shards behind it nearest to even,
among those that keep every shard within the capacity.

Running sums, places in a shard and the walks are DataFrame and array functions only; texts are digested where they are read and never shuffled
for the plan. A group of copies of any size is one row of the plan, and its rows are numbered in parts.

Defined cases: a null text has no bytes and is one group with empty texts; rows of a group are ordered by doc_id, nulls
first, repeated ids in parts; a group larger than an even share gets a shard of its own or with few others, and the shards are then uneven by need; with
fewer groups than shards the last shards are empty; other columns, whatever their names, pass through; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ordered, read, stored

SHARDS = 16
#: Marks that one look at the groups makes, at most two for each unit of size.
MARKS = 1 << 16
#: Rows of a repeated (text, doc_id) that are numbered together.
PART_ROWS = 4096

#: The last mark at or before a place, by binary search over `ends`.
_AT = "aggregate(bits, 0, (i, b) -> if(i + b < size(ends) and ends[i + b] <= {0}, i + b, i))"


def _smallest(reached: str) -> str:
    """The least capacity between `least` and `most` whose walk reaches the end; reached: the walk's last place by capacity m."""
    return f"""aggregate(sequence(1, 62), named_struct('lo', least, 'hi', most), (c, i) -> transform(array(c.lo + (c.hi - c.lo) div 2),
      m -> if(c.lo >= c.hi, c, if({reached} >= total, named_struct('lo', c.lo, 'hi', m), named_struct('lo', m + 1, 'hi', c.hi))))[0]).lo"""


def _step(place: str, capacity: str) -> str:
    """The end of a shard that begins at a place, as far as marks tell: no further than this it ends."""
    return f"ends[{_AT.format(f'{place} + {capacity}')}]"


def _far_step(place: str, capacity: str) -> str:
    """The same, as far as it may reach where groups inside a block aren't known."""
    return f"""transform(array({_AT.format(f'{place} + {capacity}')}),
      j -> if(j + 1 >= size(ends) or single[j], ends[j], least({place} + {capacity}, ends[j + 1] - 1)))[0]"""


def _walk(step, capacity: str, shards: int) -> str:
    return f"aggregate(sequence(1, {shards}), 0L, (p, k) -> {step('p', capacity)})"


def _places(step, capacity: str, shards: int) -> str:
    """Where shards begin."""
    return f"aggregate(filter(sequence(1, {shards}), k -> k < {shards}), array(0L), (ps, k) -> concat(ps, array({step('element_at(ps, -1)', capacity)})))"


def _inside(windows: list[tuple[int, int]]) -> Column:
    return F.exists(F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in windows)), lambda w: (F.col("start") >= w.a) & (F.col("start") < w.b))


def _merged(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _marks(groups: DataFrame, units: list[tuple[list[tuple[int, int]], int]], shards: int) -> DataFrame:
    """One row with `ends` (0 and the ends of blocks), `single` (whether a block is one group), and what walks need.

    units: windows of starts (none: all) and the size of a block there; the last that holds a group counts. A group as large as that is its own block.
    """
    level, unit = F.lit(0), F.lit(1).cast("long")
    for n, (windows, size) in enumerate(units):
        here = _inside(windows) if windows else F.lit(True)
        level, unit = F.when(here, n).otherwise(level), F.when(here, F.lit(size).cast("long")).otherwise(unit)
    placed = groups.select("start", "size", level.alias("level"), unit.alias("unit"))
    block = placed.groupBy("level", F.expr("start div unit").alias("slot"), (F.col("size") >= F.col("unit")).alias("large"))
    block = block.agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"), F.count("*").alias("n"), F.max("size").alias("most"))
    row = block.agg(F.array_sort(F.collect_list(F.struct("end", (F.col("n") == 1).alias("single")))).alias("b"), F.max("end").alias("total"), F.max("most").alias("largest"))
    bits = F.expr("transform(sequence(0, 30), k -> cast(shiftright(1073741824, k) as int))")
    share = F.expr(f"cast((total + {shards - 1}) div {shards} as bigint)")
    return row.select(
        F.concat(F.array(F.lit(0).cast("long")), F.col("b.end")).alias("ends"), F.col("b.single").alias("single"), "total", bits.alias("bits"),
        F.greatest(share, F.col("largest")).alias("least"), (share + F.col("largest")).alias("most"),
    )


def capacity_and_cuts(groups: DataFrame, shards: int = SHARDS, marks: int = MARKS) -> tuple[int, list[int]]:
    """The smallest capacity, and the places of the N - 1 cuts, over groups (start, size): each begins where the one before ends."""
    n, total = groups.agg(F.count("*"), F.max(F.col("start") + F.col("size"))).first()
    if not n:
        return 0, [0] * (shards - 1)
    units: list[tuple[list[tuple[int, int]], int]] = [([], 1 if n <= marks else -(-total // marks))]
    while True:
        found = _marks(groups, units, shards).withColumns({
            "high": F.expr(_smallest(_walk(_step, "m", shards))), "low": F.expr(_smallest(_walk(_far_step, "m", shards))),
        })
        windows = F.expr(f"""zip_with({_places(_step, 'low', shards)}, {_places(_far_step, 'high', shards)},
          (u, v) -> named_struct('a', ends[{_AT.format('u + low')}], 'b', ends[least(size(ends) - 1, {_AT.format('v + high')} + 1)]))""")
        # Where a shard must begin, at the earliest, for those behind it to suffice; then the cuts from the front.
        earliest = f"""aggregate(filter(sequence(1, {shards}), k -> k < {shards}), array(total), (ls, k) -> concat(array(transform(array(ls[0] - high),
          x -> if(x <= 0, 0L, transform(array({_AT.format('x')}), j -> if(ends[j] = x, x, ends[j + 1]))[0]))[0]), ls))"""
        even = f"""transform(array(c + (total - c) div ({shards} - k + 1)), e -> transform(array({_AT.format('e')}),
          j -> if(e - ends[j] <= ends[j + 1] - e, ends[j], ends[j + 1]))[0])[0]"""
        cut = f"if(c >= total, total, least(greatest({even}, earliest[k - 1], ends[{_AT.format('c')} + 1]), {_step('c', 'high')}))"
        cuts = f"aggregate(filter(sequence(1, {shards}), k -> k < {shards}), array(0L), (cs, k) -> concat(cs, transform(array(element_at(cs, -1)), c -> {cut})))"
        found = found.withColumn("windows", windows).withColumn("earliest", F.expr(earliest)).withColumn("cuts", F.expr(cuts))
        row = found.select("low", "high", "windows", "cuts").first()
        if row.low == row.high:
            return row.high, row.cuts[1:]
        open_ = _merged([(w.a, w.b) for w in row.windows if w.a < w.b])
        units.append((open_, max(1, min(-(-sum(b - a for a, b in open_) // marks), units[-1][1] // 2))))


def planned(keyed: DataFrame, shards: int, marks: int) -> DataFrame:
    """(digest, doc_id, copies, shard, first slot) of the rows of keyed (digest, doc_id, size), one for each pair of the first two."""
    cells = stored(keyed.groupBy("digest", "doc_id").agg(F.count("*").alias("copies"), F.sum("size").alias("bytes")), "shard-cells")
    at = ordered(cells, ["digest", "doc_id"], "shard-order")
    sums = at.groupBy("_part").agg(F.sum("copies").alias("_rows"), F.sum("bytes").alias("_bytes"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    base = sums.select("_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_rows", "_bytes")))
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c, b: (F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(b)).alias(f"{c}_before")
    running = stored(at.join(base, "_part").select("digest", "doc_id", "copies", "bytes", upto("copies", "_rows"), upto("bytes", "_bytes")), "shard-sums")
    groups = stored(running.groupBy("digest").agg(F.min("bytes_before").alias("start"), F.sum("bytes").alias("size")).drop("digest"), "shard-groups")
    _, cuts = capacity_and_cuts(groups, shards, marks)
    cut = F.array(*(F.lit(c).cast("long") for c in cuts)) if cuts else F.expr("cast(array() as array<bigint>)")
    cells = running.withColumn("shard", F.size(F.filter(cut, lambda c: c <= F.col("bytes_before"))))
    first = cells.groupBy("shard").agg(F.min("copies_before").alias("_first"))  # one row for each shard
    return cells.join(F.broadcast(first), "shard").select("digest", "doc_id", "copies", "shard", (F.col("copies_before") - F.col("_first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, carry: list[str] | None = None, marks: int = MARKS) -> DataFrame:
    """docs' columns `carry` (default: all) with _size, _crc32, _shard and _slot, a row's place in its shard from 0.

    Column names of docs are free; those of the result that begin with `_` stand last.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    carry = docs.columns if carry is None else carry
    names = [f"c{i}" for i in range(len(carry))]
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = stored(
        docs.select(
            *(F.col(c).alias(n) for c, n in zip(carry, names)), "doc_id", F.unhex(F.sha2(text, 256)).alias("digest"),
            (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc32"), F.monotonically_increasing_id().alias("_row"),
        ),
        "shard-keys",
    )
    plan = planned(keyed, shards, marks).withColumnRenamed("digest", "_digest").withColumnRenamed("doc_id", "_id")
    same = (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    placed = stored(keyed.join(plan, same).drop("_digest", "_id"), "shard-rows")
    out = [*names, "size", "crc32", "shard"]
    single = placed.where("copies = 1").select(*out, "slot")
    # Rows that share text and id are dealt into parts, and numbered inside them.
    part = F.pmod(F.xxhash64("_row"), F.ceil(F.col("copies") / PART_ROWS).cast("long"))
    again = placed.where("copies > 1").withColumn("part", part)
    cell = ["digest", "doc_id", "part"]
    counts = again.groupBy(*cell).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("digest", "doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(c).alias(f"_{c}") for c in cell), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("_row")) - 1
    here = (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("part") == F.col("_part"))
    again = again.withColumn("rank", rank).join(starts, here).select(*out, (F.col("slot") + F.col("_before") + F.col("rank")).alias("slot"))
    return single.union(again).toDF(*carry, "_size", "_crc32", "_shard", "_slot")


#: The same search over a list of running sums, one state a step; checksums by table, a byte a step.
ORACLE_SQL = r"""
WITH RECURSIVE crc(c, v, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL
  SELECT c, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc WHERE k < 8
),
crc_table AS (SELECT list(v ORDER BY c) AS t FROM crc WHERE k = 8),
rows_ AS (
  SELECT doc_id, sha256(coalesce(text, '')) AS digest, coalesce(octet_length(encode(text)), 0) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
      lambda h: ('0x' || h)::BIGINT)), lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, crc_table
),
groups AS (SELECT digest, sum(size)::BIGINT AS size FROM rows_ GROUP BY digest),
sums AS (SELECT digest, sum(size) OVER (ORDER BY digest)::BIGINT AS e, size FROM groups),
marks AS (SELECT list(e ORDER BY e) AS ends, max(e) AS total, max(size) AS largest FROM sums),
search AS (  -- lo and hi bound the capacity; the walk by their middle is at place p after k shards
  SELECT greatest((total + 15) // 16, largest) AS lo, (total + 15) // 16 + largest AS hi, 0::BIGINT AS p, 0 AS k FROM marks
  UNION ALL
  SELECT CASE WHEN k = 16 AND p < total THEN (lo + hi) // 2 + 1 ELSE lo END, CASE WHEN p = total THEN (lo + hi) // 2 ELSE hi END,
    CASE WHEN k = 16 OR p = total THEN 0 ELSE coalesce(list_max(list_filter(ends, lambda e: e <= p + (lo + hi) // 2)), 0) END,
    CASE WHEN k = 16 OR p = total THEN 0 ELSE k + 1 END
  FROM search, marks WHERE lo < hi
),
capacity AS (SELECT min(hi) AS c FROM search),
earliest AS (
  SELECT 16 AS k, total AS p FROM marks
  UNION ALL
  SELECT k - 1, CASE WHEN p - c <= 0 THEN 0 ELSE list_min(list_filter(ends, lambda e: e >= p - c)) END
  FROM earliest, capacity, marks WHERE k > 1
),
early AS (SELECT list(p ORDER BY k) AS es FROM earliest),
cuts AS (
  SELECT 0 AS k, 0::BIGINT AS p
  UNION ALL
  SELECT k + 1, CASE WHEN p = total THEN total ELSE least(
    greatest(
      CASE WHEN p + (total - p) // (16 - k) - coalesce(list_max(list_filter(ends, lambda e: e <= p + (total - p) // (16 - k))), 0)
          <= list_min(list_filter(ends, lambda e: e > p + (total - p) // (16 - k))) - (p + (total - p) // (16 - k))
        THEN coalesce(list_max(list_filter(ends, lambda e: e <= p + (total - p) // (16 - k))), 0)
        ELSE list_min(list_filter(ends, lambda e: e > p + (total - p) // (16 - k))) END,
      es[k + 1], list_min(list_filter(ends, lambda e: e > p))),
    list_max(list_filter(ends, lambda e: e <= p + c))) END
  FROM cuts, capacity, marks, early WHERE k < 15
),
cut_list AS (SELECT list(p) FILTER (k > 0) AS ps FROM cuts)
SELECT doc_id, r.size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY digest, doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard
FROM rows_ r JOIN (SELECT digest, len(list_filter(ps, lambda p: p <= e - size))::INT AS shard FROM sums, cut_list) USING (digest)
"""


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = shard_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return made.select(
        "doc_id", F.col("_size").alias("size"), F.col("_crc32").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
