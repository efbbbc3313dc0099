"""A Merkle manifest of documents: a tree of digests for each language, one above them, and a proof for each row.

Leaves are ordered by doc_id in each tree. Every RUN nodes that follow one another become one digest, level by level, until one
node remains. That is done in blocks of BLOCK leaves: a block is one row with an ordered array of digests, and array functions
(sequence, transform, slice, aggregate) collapse all levels inside it without a shuffle; the blocks' roots are the leaves of the
next round. Going back down, each block gets the siblings on the way from its root up, and its rows fold theirs on top of these. Texts
are read once and never shuffled.

Defined cases: a null in any column is written `-` and differs from an empty text; a null language is a tree of its own, the first;
null doc_ids come first; rows that share a doc_id are ordered by their leaves, equal rows stand next to one another; a
language with one row has its leaf as subroot, one language alone has its subroot as root; other columns are not read,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ordered, read, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 8
#: Levels that a block collapses, and so the leaves that it holds.
LEVELS = 3
BLOCK = RUN**LEVELS


def leaf(values: list[Column]) -> Column:
    """The digest of a row: each value with its length in bytes before it, `-` for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def numbered(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """nodes (tree, ...) with `pos`, from 0 in each tree by order, and `n`, the number of the tree's nodes."""
    at = ordered(nodes, ["tree", *order], name)
    counts = at.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("tree", "_part", (F.col("_first") - before).alias("_base"), F.sum("_n").over(tree).alias("n"))
    return at.join(starts, ["tree", "_part"]).withColumn("pos", F.col("_at") - F.col("_base")).drop("_at", "_part", "_base")


#: A level above an array of digests; the number of levels over n nodes; all levels of a block, the lowest first.
_ABOVE = f"transform(sequence(0, cast((size({{0}}) - 1) div {RUN} as int)), r -> sha2(array_join(slice({{0}}, {RUN} * r + 1, {RUN}), ''), 256))"
_HEIGHT = f"size(filter(sequence(0, 20), k -> shiftleft(1L, {RUN.bit_length() - 1} * k) < n))"
_LEVELS = f"""aggregate(filter(sequence(1, {LEVELS}), k -> k <= height), array(items.hash),
  (levels, k) -> concat(levels, array({_ABOVE.format('element_at(levels, -1)')})))"""
#: The siblings of a block's item i at each of its levels, those before it and those after it.
_SIBLINGS = f"""transform(filter(sequence(0, {LEVELS - 1}), l -> l < height), l -> transform(
  array(cast(shiftright(i, {RUN.bit_length() - 1} * l) as int)), at -> named_struct(
    'left', array_join(slice(levels[l], at - at % {RUN} + 1, at % {RUN}), ''),
    'right', array_join(slice(levels[l], at + 2, {RUN - 1} - at % {RUN}), '')))[0])"""


def blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """Rows (tree, block, n, height, items, levels) of numbered nodes (tree, pos, n, hash, payload)."""
    item = F.struct("pos", "hash", *payload)
    made = nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"), "n").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return made.withColumn("height", F.expr(_HEIGHT)).withColumn("levels", F.expr(_LEVELS))


def build(nodes: DataFrame, payload: list[str], name: str) -> list[DataFrame]:
    """Rounds of blocks, stored: the first over the nodes themselves, each next one over the roots of those before."""
    rounds = [stored(blocks(nodes, payload), name)]
    while (rounds[-1].agg(F.max("height")).first()[0] or 0) > LEVELS:
        below = rounds[-1].where(F.col("height") > LEVELS)
        up = below.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), _root().alias("hash"))
        rounds.append(stored(blocks(up, []), name))
    return rounds


def _root() -> Column:
    return F.expr("element_at(element_at(levels, -1), 1)")


def roots(rounds: list[DataFrame]) -> DataFrame:
    """(tree, root) of every tree."""
    found = [r.where(F.col("height") <= LEVELS).select("tree", _root().alias("root")) for r in rounds]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def with_paths(rounds: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """The first round's blocks with `path`, the siblings from the block's root up, and above's other columns.

    above: (tree, path, ...), what lies over each tree's root; None where nothing does.
    """
    carried = [c for c in above.columns if c not in ("tree", "path")] if above is not None else []
    nothing = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    upper = None
    for level in reversed(rounds):
        placed = level.where(F.col("height") <= LEVELS)
        placed = placed.withColumn("path", nothing) if above is None else placed.join(above, "tree")
        if upper is not None:
            placed = placed.unionByName(level.where(F.col("height") > LEVELS).join(upper, ["tree", "block"]))
        if level is not rounds[0]:
            inner = F.expr(f"transform(sequence(0, size(items) - 1), i -> named_struct('block', items[i].pos, 'path', concat({_SIBLINGS}, path)))")
            upper = stored(placed.select("tree", *carried, F.inline(inner)), "merkle-paths")
    return placed


def proofs(leaves: DataFrame, payload: list[str]) -> DataFrame:
    """payload, leaf, subroot, root, proof_sha256, folded_root and verified of each of leaves (tree, hash, other, payload).

    other: the leaf that is held against the manifest instead of its own, null for its own. Trees go by their names. payload's
    names are its caller's own; those used here begin with `_` or are those of the columns above.
    """
    named = [f"p{i}" for i in range(len(payload))]
    renamed = leaves.select("tree", "hash", "other", *(F.col(c).alias(n) for c, n in zip(payload, named)))
    kept = stored(renamed.withColumn("_row", F.monotonically_increasing_id()), "merkle-leaves")
    own = build(numbered(kept, [*named[:1], "hash", "_row"], "merkle-order"), ["other", *named], "merkle-blocks")
    heads = stored(roots(own), "merkle-subroots")
    over = heads.select(F.lit("").alias("tree"), F.col("root").alias("hash"), F.col("tree").alias("owner"))
    top = build(numbered(over, ["owner"], "merkle-top-order"), ["owner"], "merkle-top")
    root = roots(top).first()
    way = with_paths(top, None)
    inner = F.expr(f"transform(sequence(0, size(items) - 1), i -> named_struct('tree', items[i].owner, 'path', concat({_SIBLINGS}, path), 'subroot', items[i].hash))")
    above = stored(way.select(F.inline(inner)), "merkle-above")
    # A block's leaves, each with its whole way up, and what folds along it.
    ways = F.expr(f"transform(sequence(0, size(items) - 1), i -> named_struct('item', items[i], 'way', concat({_SIBLINGS}, path)))")
    folded = F.expr(f"""transform(ways, w -> named_struct({', '.join(f"'{n}', w.item.{n}" for n in named)}, 'leaf', w.item.hash,
      'proof_sha256', sha2(aggregate(w.way, '', (s, x) -> concat(s, x.left, x.right)), 256),
      'folded_root', aggregate(w.way, coalesce(w.item.other, w.item.hash), (h, x) -> sha2(concat(x.left, h, x.right), 256))))""")
    rows = with_paths(own, above).select("subroot", ways.alias("ways")).select("subroot", F.inline(folded))
    return rows.select(
        *(F.col(n).alias(c) for c, n in zip(payload, named)), "leaf", "subroot", F.lit(root[1] if root else None).cast("string").alias("root"),
        "proof_sha256", "folded_root",
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def tree_of(lang: Column) -> Column:
    """A name of each language's tree that sorts as languages do, null first."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def manifest(docs: DataFrame, text: Column | None = None, where: Column | None = None) -> DataFrame:
    """proofs of docs (FIELDS, ...); rows for which `where` holds are held against the manifest with another text."""
    own = [F.col(c) for c in FIELDS]
    other = F.lit(None).cast("string") if text is None else F.when(F.lit(True) if where is None else where, leaf([*own[:-1], text]))
    return proofs(docs.select("doc_id", tree_of(F.col("lang")).alias("tree"), leaf(own).alias("hash"), other.alias("other")), ["doc_id"])


ORACLE_SQL = r"""
WITH RECURSIVE crc(c, v, k) AS (  -- the table of CRC-32
  SELECT i, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL
  SELECT c, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc WHERE k < 8
),
crc_table AS (SELECT list(v ORDER BY c) AS t FROM crc WHERE k = 8),
docs AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1),
      lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
    lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) % 3 = 0 AS tampered
  FROM documents, crc_table
),
parts AS (
  SELECT doc_id, lang, tampered, row_number() OVER () AS row,
    concat(coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
      coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-')) AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small
  FROM docs
),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, row,
    sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN tampered THEN sha256(head || coalesce(octet_length(encode(small)) || ':' || small, '-')) END AS other
  FROM parts
),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS pos FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS hash FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM nodes) WHERE n > 1 GROUP BY tree, level, pos // 8
),
subroots AS (SELECT tree, arg_max(hash, level) AS subroot FROM nodes GROUP BY tree),
above AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY tree) - 1 AS pos, subroot AS hash FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS n FROM above) WHERE n > 1 GROUP BY level, pos // 8
),
root AS (SELECT arg_max(hash, level) AS root FROM above),
numbered AS (SELECT *, row_number() OVER (ORDER BY tree) - 1 AS top_pos FROM subroots),
steps AS (  -- the siblings of each node, before and after it
  SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8
  WHERE a.level < (SELECT max(level) FROM nodes c WHERE c.tree = a.tree) GROUP BY a.tree, a.level, a.pos
),
top_steps AS (
  SELECT a.level, a.pos, coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM above a JOIN above b ON a.level = b.level AND a.pos // 8 = b.pos // 8
  WHERE a.level < (SELECT max(level) FROM above) GROUP BY a.level, a.pos
),
way AS (
  SELECT p.tree, p.row, s.level, s.l, s.r FROM placed p JOIN steps s ON s.tree = p.tree AND s.pos = p.pos // (8 ** s.level)::BIGINT
  UNION ALL
  SELECT p.tree, p.row, 100 + s.level, s.l, s.r
  FROM placed p JOIN numbered n USING (tree) JOIN top_steps s ON s.pos = n.top_pos // (8 ** s.level)::BIGINT
),
ways AS (SELECT row, list({'l': l, 'h': '', 'r': r} ORDER BY level) AS ss, string_agg(l || r, '' ORDER BY level) AS siblings FROM way GROUP BY row)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256,
  list_reduce(list_prepend({'l': '', 'h': coalesce(other, leaf), 'r': ''}, coalesce(ss, [])),
    lambda a, x: {'l': '', 'h': sha256(x.l || a.h || x.r), 'r': ''}).h AS folded_root,
  list_reduce(list_prepend({'l': '', 'h': coalesce(other, leaf), 'r': ''}, coalesce(ss, [])),
    lambda a, x: {'l': '', 'h': sha256(x.l || a.h || x.r), 'r': ''}).h = root AS verified
FROM placed JOIN subroots USING (tree) CROSS JOIN root LEFT JOIN ways USING (row)
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document, by the checksum of its id, is held against the manifest with its A-Z lower-cased."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    return manifest(read(spark, sf_dir, "documents"), F.translate("text", capitals, capitals.lower()), tampered)
