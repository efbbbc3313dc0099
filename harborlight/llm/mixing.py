"""Mixing sources to target weights over a tree of domains, languages and sources.

The token budget goes down the tree: at each node it is shared among the children by weight. No child gets more than
its subtree holds (its tokens times MAX_EPOCHS); what a full child can't take goes to its siblings by their weights, and
only what all siblings together can't take is left to the levels above, as their own share was cut by the same rule.
A leaf (domain, language, source) then gives whole epochs while its budget lasts, and of the next epoch the
documents that come first in that epoch's seeded order, as many as fit the rest of the budget: a token prefix.

The prefix is found without sorting a leaf: token sums by bucket of the order's hash, running sums over at most 4096
buckets of a leaf, and a window over the one bucket where the budget ends. What comes out for each leaf is one hash
value, so the selection is a filter on the documents: their texts are read once, and shuffled only where leaves are too many
for a broadcast. The tree is worked on as tables, level by level; the driver holds none of it.

Defined cases: null languages and sources are leaves of their own, apart from empty ones; a source without a number is of domain `d0`; a text
without words has no tokens and goes with the documents around it, but a leaf without any token gives nothing; rows
that share a doc_id within a leaf are taken together; a child of weight 0 gets nothing and counts as no room; very long texts are
only counted, never moved; further columns, whatever their names, pass through; an empty table gives no rows.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stored

DOMAIN_WEIGHTS = {"d0": 0.4, "d1": 0.3, "d2": 0.2, "d3": 0.1}
LANGUAGE_WEIGHTS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
#: The budget as a share of all tokens, and how often a document may be given.
BUDGET_SHARE = 0.8
MAX_EPOCHS = 2
SEED = 4242
KEY_BITS = 60
BUCKET_BITS = 12
LEVELS = ("_domain", "_lang", "_source")
_NULL = "\x01"


@dataclasses.dataclass(frozen=True)
class Mix:
    """Weights of children by name at the three levels; a child without one has weight 1 (sources: all equal)."""

    domains: dict[str, float] = dataclasses.field(default_factory=lambda: dict(DOMAIN_WEIGHTS))
    languages: dict[str, float] = dataclasses.field(default_factory=lambda: dict(LANGUAGE_WEIGHTS))
    sources: dict[str, float] = dataclasses.field(default_factory=dict)
    budget_share: float = BUDGET_SHARE
    max_epochs: int = MAX_EPOCHS
    seed: int = SEED


def weight_of(level: str, weights: dict[str, float]) -> Column:
    """A child's weight by its name, 1 where none is given."""
    out = F.lit(1.0)
    for name, weight in weights.items():
        out = F.when(F.col(level) == named(F.lit(name)), F.lit(float(weight))).otherwise(out)
    return out


def shared_out(children: DataFrame, parents: list[str], level: str) -> DataFrame:
    """children (parents' columns, level, weight, room, amount of their parent) with `given`: the parent's amount by weight.

    None gets more than its room; what is over goes to those with room left by their weights. Children fill up in the order of
    their room for a unit of weight, so the full ones are the first in that order.
    """
    order = Window.partitionBy(*parents).orderBy(F.col("room") / F.col("weight"), level)
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parents)
    taken, passed = (F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("room", "weight"))
    open_ = children.where("weight > 0 and room > 0").withColumns({"taken": taken, "passed": passed, "all": F.sum("weight").over(every)})
    full = F.col("room") / F.col("weight") <= (F.col("amount") - F.col("taken")) / (F.col("all") - F.col("passed"))
    open_ = open_.withColumn("full", full)
    rest = F.col("amount") - F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(every), F.lit(0.0))
    share = F.col("weight") * rest / F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    return open_.select(*parents, level, F.when(F.col("full"), F.col("room")).otherwise(share).alias("given"))


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves (levels, tokens) with `budget`, whole tokens for each; the tree's levels are tables, of whatever size."""
    by_level = dict(zip(LEVELS, (mix.domains, mix.languages, mix.sources)))
    # What leaves can take; those below a child of weight 0 can take nothing, so nothing is left with them.
    able = F.col("tokens").cast("double") * mix.max_epochs
    for level, weights in by_level.items():
        able = F.when(weight_of(level, weights) > 0, able).otherwise(0.0)
    leaves = leaves.withColumn("able", able)
    given = leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * mix.budget_share).alias("amount"))
    parents: list[str] = []
    for level, weights in by_level.items():
        children = leaves.groupBy(*parents, level).agg(F.sum("able").alias("room")).withColumn("weight", weight_of(level, weights))
        children = children.join(given, parents) if parents else children.crossJoin(given)  # one row
        given = shared_out(children, parents, level).withColumnRenamed("given", "amount")
        parents.append(level)
    budget = F.floor(F.coalesce("amount", F.lit(0.0)) + 1e-6).cast("long")
    return leaves.drop("able").join(given, parents, "left").select(*parents, "tokens", budget.alias("budget"))


def domain_of(source: Column) -> Column:
    """The documents carry no domain: sources are dealt to four by the number in their name."""
    number = F.coalesce(F.regexp_extract(source, "([0-9]{1,9})", 1).try_cast("long"), F.lit(0))
    return F.concat(F.lit("d"), F.pmod(number, F.lit(4)).cast("string"))


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("\\S+")), F.lit(0)).cast("long")


def order_key(epoch: Column | int, seed: int) -> Column:
    """A document's place in an epoch's order: from 0 up, spread evenly over KEY_BITS bits of an MD5 digest."""
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    named = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, KEY_BITS // 4), 16, 10).cast("long")


def named(value: Column) -> Column:
    """The name of a leaf's language or source: itself, and a mark for null, which is put before names that begin with it."""
    return F.when(value.isNull(), _NULL).when(F.startswith(value, F.lit(_NULL)), F.concat(F.lit(_NULL), value)).otherwise(value)


def with_leaves(docs: DataFrame) -> DataFrame:
    return docs.select(
        "*", domain_of(F.col("source")).alias("_domain"), named(F.col("lang")).alias("_lang"), named(F.col("source")).alias("_source"),
    )


def leaf_plan(docs: DataFrame, mix: Mix) -> DataFrame:
    """For each leaf: whole epochs to give (_epochs), and the last order key to give of the next one (_last, -1: none)."""
    counted = stored(
        with_leaves(docs.select("doc_id", "lang", "source", "text")).select("doc_id", *LEVELS, token_count(F.col("text")).alias("tokens")),
        "leaf-tokens",
    )
    totals = stored(counted.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "leaves")
    rest = F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).alias("_rest")
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long").alias("_epochs")
    # Stored, so that Spark knows the tables' sizes: few leaves are broadcast, many are joined by shuffles.
    leaves = stored(leaf_budgets(totals, mix).select(*LEVELS, epochs, rest), "leaf-budgets")
    keyed = counted.join(leaves.where("_rest > 0"), list(LEVELS)).withColumn("key", order_key(F.col("_epochs"), mix.seed))
    bucket = F.shiftright("key", KEY_BITS - BUCKET_BITS)
    sums = keyed.groupBy(*LEVELS, "_rest", bucket.alias("bucket")).agg(F.sum("tokens").alias("sum"), F.max("key").alias("high"))
    running = Window.partitionBy(*LEVELS).orderBy("bucket")
    sums = stored(sums.withColumn("before", F.sum("sum").over(running) - F.col("sum")), "leaf-buckets")
    inside = sums.where("before + sum <= _rest").groupBy(*LEVELS).agg(F.max("high").alias("whole"))
    edge = sums.where("before <= _rest and before + sum > _rest").select(*LEVELS, "bucket", "before")
    within = Window.partitionBy(*LEVELS).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    partial = (
        keyed.withColumn("bucket", bucket).join(edge, [*LEVELS, "bucket"])
        .withColumn("upto", F.col("before") + F.sum("tokens").over(within))
        .where("upto <= _rest").groupBy(*LEVELS).agg(F.max("key").alias("part"))
    )
    last = F.greatest(F.coalesce("whole", F.lit(-1)), F.coalesce("part", F.lit(-1)))
    return (
        leaves.join(inside, list(LEVELS), "left").join(partial, list(LEVELS), "left")
        .select(*LEVELS, "_epochs", F.when(F.col("_rest") > 0, last).otherwise(-1).alias("_last"))
    )


def mix_documents(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """The rows of docs, once for each epoch in which they are given, with the columns _domain and _epoch."""
    return _mixed(docs, mix or Mix()).toDF(*docs.columns, "_domain", "_epoch")


def keep_mixed(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    made = _mixed(docs, mix or Mix())
    return made.select(*made.columns[: len(docs.columns)]).toDF(*docs.columns)


def _mixed(docs: DataFrame, mix: Mix) -> DataFrame:
    """As mix_documents, with docs' columns as c0, c1, ...: they may have any of the names used here."""
    plan = stored(leaf_plan(docs, mix), "leaf-plan")
    names = [f"c{i}" for i in range(len(docs.columns))]
    read = ("doc_id", "lang", "source")
    copies = [F.col(names[docs.columns.index(c)]).alias(c) for c in read]
    chosen = with_leaves(docs.toDF(*names).select("*", *copies)).join(plan, list(LEVELS))
    times = F.col("_epochs") + F.when(order_key(F.col("_epochs"), mix.seed) <= F.col("_last"), 1).otherwise(0)
    epochs = chosen.withColumn("_times", times).where("_times > 0")
    epochs = epochs.withColumn("_epoch", F.explode(F.sequence(F.lit(0), (F.col("_times") - 1).cast("int"))))
    return epochs.select(*names, "_domain", "_epoch")


#: The same rule in closed form: at each level children fill up in the order of their room for a weight.
ORACLE_SQL = r"""
WITH counted AS (
  SELECT doc_id, lang, source, CASE WHEN lang IS NULL THEN chr(1) WHEN starts_with(lang, chr(1)) THEN chr(1) || lang ELSE lang END AS l,
    CASE WHEN source IS NULL THEN chr(1) WHEN starts_with(source, chr(1)) THEN chr(1) || source ELSE source END AS s,
    'd' || (coalesce(try_cast(regexp_extract(source, '([0-9]{1,9})', 1) AS BIGINT), 0) % 4) AS domain,
    coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0)::BIGINT AS n_tokens
  FROM documents
),
leaves AS (SELECT domain, l, s, sum(n_tokens)::BIGINT AS tokens FROM counted GROUP BY domain, l, s),
-- A level: children by room for their weight; those before the first that its share does not fill are full.
level1 AS (
  SELECT domain, 2e0 * sum(tokens) AS room,
    CASE domain WHEN 'd0' THEN 0.4e0 WHEN 'd1' THEN 0.3e0 WHEN 'd2' THEN 0.2e0 WHEN 'd3' THEN 0.1e0 ELSE 1e0 END AS w,
    0.8e0 * (SELECT sum(tokens) FROM leaves) AS amount
  FROM leaves GROUP BY domain
),
order1 AS (
  SELECT *, coalesce(sum(room) OVER before, 0) AS rooms, coalesce(sum(w) OVER before, 0) AS ws, sum(w) OVER () AS all_w
  FROM level1 WINDOW before AS (ORDER BY room / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
full1 AS (SELECT *, room / w <= (amount - rooms) / (all_w - ws) AS is_full FROM order1),
given1 AS (
  SELECT domain, CASE WHEN is_full THEN room ELSE w * (amount - coalesce(sum(room) FILTER (is_full) OVER (), 0))
    / sum(w) FILTER (NOT is_full) OVER () END AS given
  FROM full1
),
level2 AS (
  SELECT domain, l, 2e0 * sum(tokens) AS room,
    CASE l WHEN 'en' THEN 0.5e0 WHEN 'de' THEN 0.2e0 WHEN 'fr' THEN 0.2e0 WHEN 'es' THEN 0.1e0 ELSE 1e0 END AS w,
    any_value(given) AS amount
  FROM leaves JOIN given1 USING (domain) GROUP BY domain, l
),
order2 AS (
  SELECT *, coalesce(sum(room) OVER before, 0) AS rooms, coalesce(sum(w) OVER before, 0) AS ws,
    sum(w) OVER (PARTITION BY domain) AS all_w
  FROM level2
  WINDOW before AS (PARTITION BY domain ORDER BY room / w, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
full2 AS (SELECT *, room / w <= (amount - rooms) / (all_w - ws) AS is_full FROM order2),
given2 AS (
  SELECT domain, l, CASE WHEN is_full THEN room
    ELSE w * (amount - coalesce(sum(room) FILTER (is_full) OVER (PARTITION BY domain), 0))
      / sum(w) FILTER (NOT is_full) OVER (PARTITION BY domain) END AS given
  FROM full2
),
order3 AS (
  SELECT domain, l, s, tokens, 2e0 * tokens AS room, given AS amount,
    coalesce(sum(2e0 * tokens) OVER before, 0) AS rooms,
    count(*) OVER (PARTITION BY domain, l) - count(*) OVER before AS others
  FROM leaves JOIN given2 USING (domain, l)
  WINDOW before AS (PARTITION BY domain, l ORDER BY tokens, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
full3 AS (SELECT *, room <= (amount - rooms) / others AS is_full FROM order3),
budgets AS (
  SELECT domain, l, s, tokens, floor(1e-6 + CASE WHEN is_full THEN room
    ELSE (amount - coalesce(sum(room) FILTER (is_full) OVER (PARTITION BY domain, l), 0))
      / count(*) FILTER (NOT is_full) OVER (PARTITION BY domain, l) END)::BIGINT AS budget
  FROM full3
),
plan AS (
  SELECT domain, l, s, budget // tokens AS epochs, budget % tokens AS rest FROM budgets WHERE tokens > 0
),
keyed AS (
  SELECT c.*, epochs, rest,
    ('0x' || substr(md5(concat_ws(':', '4242', epochs, coalesce(doc_id::VARCHAR, ''))), 1, 15))::BIGINT AS key
  FROM counted c JOIN plan USING (domain, l, s)
),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, l, s ORDER BY key) AS upto FROM keyed),
times AS (SELECT *, epochs + (rest > 0 AND upto <= rest)::BIGINT AS n FROM summed)
SELECT doc_id, unnest(range(0, n))::INT AS epoch, domain, lang, source, n_tokens FROM times
"""


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select(
        "doc_id", F.col("_epoch").alias("epoch"), F.col("_domain").alias("domain"), "lang", "source",
        token_count(F.col("text")).alias("n_tokens"),
    )
