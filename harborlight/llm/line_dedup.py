"""Line dedup: a line goes if an earlier one equals it or lies within one edit of it. DataFrame functions only.

Lines are the text's parts between line ends; their key is the line lower-cased, white space collapsed and trimmed.
Blank lines are never compared and stay. Equal keys become one distinct line with its earliest place (doc_id,
then line number). Two distinct keys, of whatever length, are near if one insertion, deletion or substitution turns one into
the other:

1. Of two strings one edit apart, the first half or the second half agrees (the halves' lengths are those of the
   rounded). Only lines that share such a half with another are looked at further; no near pair is lost.
2. Deletion neighbourhood: each of those emits itself and all its variants with one character deleted, as hashed keys.
3. Equal variants are joined by aggregation, not by listing pairs: with the position of the deletion as part of the key,
   lines of a group differ by one substitution at most, so the earliest of a group is near to all others; and
   a whole line that equals a variant is one deletion from each line that emitted it.
4. The earliest neighbour found is checked on the lines themselves: distinct lines are one edit apart exactly if deleting
   a character of one, or at one place of both, makes them equal; that takes time in proportion to their length.

A line that has an earlier line within one edit is dropped, whether or not that one is kept.

Line texts are not shuffled before step 2: steps before it work on hashes, and the candidates' texts are picked out of
the documents by a bitmap of fixed size (FILTER_BITS) over their hashes; a full bitmap only lets more lines through to
the exact join behind it. Hashes of variants meet by chance at times; step 4 sorts those out.

Defined cases: a null text stays null and an empty one stays empty; rows of equal doc_id and text count as one document
and get the same result; a null doc_id comes first; very long lines cost time in proportion to their length, as do documents
of very many lines; further columns, whatever their names, pass through; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_by_shuffles, read, stored

#: Bits of the broadcast bitmap, as words of 64: at most 2^18 rows, whatever the input's size.
FILTER_BITS = 1 << 24
#: Characters of a block of the variants' hash.
BLOCK = 32


def line_key(line: Column) -> Column:
    odd = F.lit(False)
    for white in ("  ", "\t", "\r", "\f", "\x0b"):
        odd |= F.contains(line, F.lit(white))
    return F.trim(F.lower(F.when(odd, F.regexp_replace(line, "\\s+", " ")).otherwise(line)))


def placed_lines(docs: DataFrame) -> DataFrame:
    """The non-blank lines of docs (id, row, text): id, row, line_no, key, and two hashes of the key."""
    return (
        docs.select("id", "row", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
        .select("id", "row", "line_no", line_key(F.col("line")).alias("key"))
        .where("key <> ''")
        .select("*", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))
    )


def half_keys(key: Column, chars: Column) -> Column:
    """Hashes of the halves that a line shares with every line one edit away; even for first, odd for second halves.

    A half has half the characters, rounded down so that lengths 4n to 4n+3 agree; at 4n the shorter neighbour's too.
    """

    def of(half: Column) -> list[Column]:
        first = F.shiftleft(F.xxhash64(half, F.substring(key, F.lit(1), half)), 1)
        second = F.shiftleft(F.xxhash64(half, F.substring(key, chars - half + 1, half)), 1) + 1
        return [first, second]

    half = F.floor(chars / 4).cast("int") * 2
    return F.when(chars % 4 == 0, F.array(*of(half), *of(half - 2))).otherwise(F.array(*of(half)))


def candidate_lines(docs: DataFrame, hashed: DataFrame) -> DataFrame:
    """The distinct long lines (h1, h2, key) that share a half with another: first and second tell which.

    nth numbers them in the order of their earliest places.
    """
    halves = hashed.where("halves is not null").select("h1", F.explode("halves").alias("half"))
    met = halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high")
    # Stored, so that the join with all halves is one whose hot partitions Spark can split.
    met = stored(met.select("half"), "line-halves")
    odd = F.pmod("half", F.lit(2)) == 1
    candidates = stored(
        halves.join(met, "half", "left_semi")
        .groupBy("h1")
        .agg(F.bool_or(~odd).alias("first"), F.bool_or(odd).alias("second")),
        "line-candidates",
    )
    # A bit for each candidate's hash, in words of 64.
    word = F.pmod(F.shiftright("h1", 6), F.lit(FILTER_BITS // 64))
    words = candidates.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(h1, 64) as int))")).alias("bits"))
    lines = placed_lines(docs).withColumn("word", word)
    likely = lines.join(F.broadcast(words), "word").where(F.expr("shiftrightunsigned(bits, cast(pmod(h1, 64) as int)) & 1L = 1L"))
    distinct = (
        likely.join(candidates, "h1")
        .groupBy("h1", "h2", "first", "second")
        .agg(F.min(F.struct("id", "row", "line_no")).alias("place"), F.min("key").alias("key"))
        .orderBy("place")
    )
    return stored(distinct.withColumn("nth", F.monotonically_increasing_id()).drop("place"), "candidate-lines")


def block_hash(number: Column, block: Column) -> Column:
    """40 bits for a block and its number; 0 for an empty one. Sums of them name strings of any length."""
    return F.when(block == "", 0).otherwise(F.shiftrightunsigned(F.xxhash64(number, block), 24))


def variants_of(lines: DataFrame) -> DataFrame:
    """(nth, cut, variant) for lines (nth, key, first, second): cut 0 is the line, cut n the line without character n.

    A string's hash is the sum over its blocks of BLOCK characters. Without one character, the blocks before it stay, its own
    is put together anew, and those behind it are the line's blocks one character further on: all variants of a line
    take time in proportion to its length.
    """
    number = F.col("number")
    line = Window.partitionBy("nth").orderBy("number")
    # A line is cut into its blocks once; each gets the first character of the next one behind it.
    cut_up = F.regexp_extract_all("key", F.lit(f"(?s).{{1,{BLOCK}}}"), 0)
    blocks = lines.select("nth", "first", "second", F.length("key").alias("chars"), F.posexplode(cut_up).alias("number", "block"))
    following = F.coalesce(F.substring(F.lead("block").over(line), 1, 1), F.lit(""))
    blocks = blocks.select("nth", "first", "second", "chars", "number", F.concat("block", following).alias("piece"))
    here = block_hash(number, F.substring("piece", F.lit(1), F.lit(BLOCK)))
    shifted = block_hash(number, F.substring("piece", F.lit(2), F.lit(BLOCK)))
    ahead, upto, every = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("nth")
    # What is behind a block is the whole less what is up to it: a frame that ends with the line would be summed anew for each row.
    blocks = blocks.select(
        "*", F.coalesce(F.sum(here).over(ahead), F.lit(0)).alias("before"), (F.sum(shifted).over(every) - F.sum(shifted).over(upto)).alias("after"),
        here.alias("own"), F.max("number").over(every).alias("last"),
    )
    # An edit lies behind a shared first half, or before a shared second one.
    half = F.floor(F.col("chars") / 4).cast("int") * 2
    cuts = F.filter(
        F.sequence(number * BLOCK + 1, F.least(F.col("chars"), (number + 1) * BLOCK)),
        lambda c: (F.col("first") & (c > half - 2)) | (F.col("second") & (c <= F.col("chars") - half + 2)),
    )
    cut = F.col("cut")
    at = cut - number * BLOCK
    without = F.concat(F.substring("piece", F.lit(1), at - 1), F.substring("piece", at + 1, F.lit(BLOCK + 1)))
    deleted = blocks.select("*", F.explode(cuts).alias("cut")).select(
        "nth", "cut", F.xxhash64(F.col("before") + block_hash(number, without) + F.col("after"), F.col("chars") - 1).alias("variant")
    )
    whole = blocks.where("number = last").select("nth", F.lit(0).alias("cut"), F.xxhash64(F.col("before") + F.col("own"), "chars").alias("variant"))
    return deleted.union(whole)


def without(key: Column, cut: Column) -> Column:
    """The line without its character number cut; 0: the whole line."""
    return F.when(cut == 0, key).otherwise(F.concat(F.substring(key, F.lit(1), cut - 1), F.substring(key, cut + 1, F.length(key))))


def earlier_neighbours(lines: DataFrame) -> DataFrame:
    """(h1, h2) of each line (h1, h2, key, nth, first, second) that has an earlier one within one edit."""
    variants = variants_of(lines)
    met = stored(
        variants.groupBy("variant").agg(F.min("nth").alias("low"), F.max("nth").alias("high")).where("low <> high").select("variant"),
        "met-variants",
    )
    shared = stored(variants.join(met, "variant"), "shared-variants")
    deleted, whole = shared.where("cut > 0"), shared.where("cut = 0").select("variant", F.col("nth").alias("whole"))
    # Substitutions: lines that become equal by deleting the same position; the earliest is near to all others.
    same = deleted.groupBy("variant", "cut").agg(F.min("nth").alias("near"))
    substituted = deleted.join(same, ["variant", "cut"]).where("near < nth").select("nth", "near", "cut", F.col("cut").alias("near_cut"))
    # Insertions and deletions: a whole line equal to a variant of a longer one.
    longer = deleted.groupBy("variant").agg(F.min(F.struct("nth", "cut")).alias("long")).join(whole, "variant")
    shortened = longer.where("long.nth < whole").select(F.col("whole").alias("nth"), "long.nth", F.lit(0).alias("cut"), "long.cut")
    lengthened = deleted.join(whole, "variant").where("whole < nth").select("nth", "whole", "cut", F.lit(0))
    # Of the places whose deletion makes a pair equal, one is enough.
    pairs = substituted.union(shortened).union(lengthened).groupBy("nth", "near").agg(F.min(F.struct("cut", "near_cut")).alias("at"))
    near = lines.select(F.col("nth").alias("near"), F.col("key").alias("near_key"))
    checked = pairs.join(lines.select("nth", "h1", "h2", "key"), "nth").join(near, "near")
    equal = without(F.col("key"), F.col("at.cut")) == without(F.col("near_key"), F.col("at.near_cut"))
    return checked.where(equal).select("h1", "h2").distinct()


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and any others) without repeated lines in text, and the columns n_lines and n_dropped."""
    join_by_shuffles(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    doc_id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    # A row's name in joins: never null, and rows that share an id stay apart unless their texts are equal.
    rows = plain.withColumn("id", F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))).withColumn("row", F.xxhash64(doc_id, text))
    texts = rows.select("id", "row", F.col(text).alias("text"))

    lines = placed_lines(texts).withColumn("halves", half_keys(F.col("key"), F.length("key")))
    hashed = stored(lines.drop("key"), "line-hashes")
    near = earlier_neighbours(candidate_lines(texts, hashed)).withColumn("near", F.lit(True))
    groups = hashed.groupBy("h1", "h2").agg(F.min(F.struct("id", "row", "line_no")).alias("first"), F.count("*").alias("n"))
    # Stored, so that the join with all lines is one whose hot partitions Spark can split.
    verdicts = stored(groups.join(near, ["h1", "h2"], "left").where("n > 1 or near"), "line-verdicts")
    dropped = (
        hashed.join(verdicts, ["h1", "h2"])
        .where("coalesce(near, false) or first <> struct(id, row, line_no)")
        .groupBy("id", "row")
        .agg(F.collect_set("line_no").alias("dropped"))  # of one document
    )
    parts = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("dropped"))
    remaining = F.when(F.col("dropped").isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get("parts", i)), "\n"))
    out = [remaining if n == text else F.col(n) for n in names]
    counts = [F.when(F.col(text).isNull(), 0).otherwise(F.size("parts")), F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped"))]
    joined = rows.join(dropped, ["id", "row"], "left").withColumn("parts", parts)
    return joined.select(*out, *counts).toDF(*docs.columns, "n_lines", "n_dropped")


def keep_first_lines(docs: DataFrame) -> DataFrame:
    """docs without repeated lines; a document of which no words are left goes. Columns as they are."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # docs may have columns of the added names
    text = F.col(names[docs.columns.index("text")])
    left = drop_repeated_lines(docs).toDF(*names, "lines", "dropped")
    return left.where((F.col("dropped") == 0) | text.rlike(r"\S")).select(*names).toDF(*docs.columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = r"""
with raw as (
  select doc_id, idx as line_no, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) as key
  from (select doc_id, unnest(string_split(text, chr(10))) as line,
               unnest(range(len(string_split(text, chr(10))))) as idx from documents)
), lines as (select * from raw where key <> ''),
firsts as (
  select key, length(key) as chars, min(doc_id * 1000000 + line_no) as place from lines group by key
), halves as (
  select key, place, chars, 'a' || left(key, h) as half from (select *, chars // 4 * 2 as h from firsts)
  union all select key, place, chars, 'b' || right(key, h) from (select *, chars // 4 * 2 as h from firsts)
  union all select key, place, chars, 'a' || left(key, h) from (select *, chars // 4 * 2 - 2 as h from firsts where chars % 4 = 0)
  union all select key, place, chars, 'b' || right(key, h) from (select *, chars // 4 * 2 - 2 as h from firsts where chars % 4 = 0)
), near as (
  select distinct a.key from halves a join halves b on a.half = b.half
  -- levenshtein counts bytes, of which a character has up to four: it only narrows down what is compared by characters.
  where b.place < a.place and abs(a.chars - b.chars) <= 1 and levenshtein(a.key, b.key) <= 4 and len(list_filter(
    range(1, greatest(a.chars, b.chars) + 1), lambda c:
      case when a.chars = b.chars then left(a.key, c - 1) || substr(a.key, c + 1) = left(b.key, c - 1) || substr(b.key, c + 1)
        when a.chars > b.chars then left(a.key, c - 1) || substr(a.key, c + 1) = b.key
        else left(b.key, c - 1) || substr(b.key, c + 1) = a.key end)) > 0
), dropped as (
  select l.doc_id, l.line_no from lines l join firsts f using (key)
  where l.doc_id * 1000000 + l.line_no <> f.place or l.key in (select key from near)
)
select d.doc_id,
       case when k.doc_id is null then d.text else coalesce(array_to_string(
         list_transform(list_filter(range(len(string_split(d.text, chr(10)))), lambda i: not list_contains(k.gone, i)),
                        lambda i: string_split(d.text, chr(10))[i + 1]), chr(10)), '') end as text,
       len(string_split(d.text, chr(10)))::int as n_lines,
       coalesce(len(k.gone), 0)::int as n_dropped
from documents d left join (select doc_id, list(line_no) as gone from dropped group by doc_id) k using (doc_id)
"""
