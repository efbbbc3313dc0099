import random

import pytest
from pyspark.sql import functions as F

from harborlight.llm import mixing


def share_out(amount: float, weights: list[float], room: list[float]) -> list[float]:
    """amount by weight; none gets more than its room, and what is over goes to those with room left by their weights."""
    given = [0.0] * len(weights)
    open_ = [i for i in range(len(weights)) if weights[i] > 0 and room[i] > 0]
    while open_ and amount > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if given[i] + amount * weights[i] / total >= room[i]]
        if not full:
            for i in open_:
                given[i] += amount * weights[i] / total
            break
        for i in full:
            amount -= room[i] - given[i]
            given[i] = room[i]
        # The others' shares of what is left are worked out anew from the start, so that weights hold among them.
        amount += sum(given[i] for i in open_ if i not in full)
        for i in open_:
            if i not in full:
                given[i] = 0.0
        open_ = [i for i in open_ if i not in full]
    return given


def leaf_budgets(tokens: dict[tuple[str, str, str], int], mix: mixing.Mix) -> dict[tuple[str, str, str], int]:
    """Whole tokens for each leaf (domain, language, source) with its tokens."""
    by_level = (mix.domains, mix.languages, mix.sources)
    # What leaves can take; those below a child of weight 0 can take nothing, so nothing is left with them.
    weighted = lambda leaf: all(by_level[k].get(leaf[k], 1.0) > 0 for k in range(3))
    able = {leaf: mix.max_epochs * n if weighted(leaf) else 0 for leaf, n in tokens.items()}

    def down(leaves: list[tuple], level: int, amount: float) -> dict[tuple, int]:
        if level == 3:
            return {leaves[0]: int(amount + 1e-6)}
        children: dict[str, list[tuple]] = {}
        for leaf in leaves:
            children.setdefault(leaf[level], []).append(leaf)
        names = sorted(children)
        room = [float(sum(able[x] for x in children[n])) for n in names]
        parts = share_out(amount, [by_level[level].get(n, 1.0) for n in names], room)
        out: dict[tuple, int] = {}
        for name, part in zip(names, parts):
            out |= down(children[name], level + 1, part)
        return out

    return down(sorted(tokens), 0, mix.budget_share * sum(tokens.values())) if tokens else {}


def test_share_out_respects_room_and_weights():
    assert share_out(100, [1, 1], [30, 200]) == [30, 70]
    assert share_out(100, [3, 1], [1000, 1000]) == [75, 25]
    assert share_out(500, [1, 1], [30, 200]) == [30, 200]
    assert share_out(90, [1, 1, 1], [10, 100, 100]) == [10, 40, 40]
    assert share_out(10, [0, 1], [100, 100]) == [0, 10]


def test_shortage_goes_to_siblings_before_ancestors():
    tokens = {("a", "en", "s1"): 10, ("a", "en", "s2"): 1000, ("b", "en", "s3"): 1000}
    mix = mixing.Mix(domains={"a": 1, "b": 1}, languages={}, budget_share=400 / 2010, max_epochs=1)
    budgets = leaf_budgets(tokens, mix)
    assert budgets == {("a", "en", "s1"): 10, ("a", "en", "s2"): 190, ("b", "en", "s3"): 200}


def test_children_of_weight_zero_leave_their_share_to_others():
    """At each level: what can't be given below a child of weight 0 goes to siblings, then to ancestors' other children."""
    even = {"a": 1, "b": 1}
    tokens = {("a", "x", "s"): 1000, ("a", "y", "s"): 10, ("b", "x", "s"): 1000, ("b", "y", "s"): 1000}
    mix = mixing.Mix(domains=even, languages={"x": 0, "y": 1}, budget_share=1000 / 3010, max_epochs=1)
    assert leaf_budgets(tokens, mix) == {("a", "x", "s"): 0, ("a", "y", "s"): 10, ("b", "x", "s"): 0, ("b", "y", "s"): 990}
    tokens = {("a", "x", "s0"): 500, ("a", "x", "s1"): 20, ("a", "z", "s1"): 500, ("b", "x", "s1"): 500}
    mix = mixing.Mix(domains=even, languages={}, sources={"s0": 0}, budget_share=600 / 1520, max_epochs=1)
    assert leaf_budgets(tokens, mix) == {("a", "x", "s0"): 0, ("a", "x", "s1"): 20, ("a", "z", "s1"): 280, ("b", "x", "s1"): 300}
    mix = mixing.Mix(domains={"a": 0, "b": 2}, languages={}, budget_share=900 / 1520, max_epochs=1)
    assert leaf_budgets(tokens, mix) == {("a", "x", "s0"): 0, ("a", "x", "s1"): 0, ("a", "z", "s1"): 0, ("b", "x", "s1"): 500}
    mix = mixing.Mix(domains={"a": 0, "b": 0}, languages={})
    assert set(leaf_budgets(tokens, mix).values()) == {0}


def test_columns_of_the_names_used_within(spark):
    names = ["_domain", "_lang", "_source", "_epochs", "_last", "_times", "_epoch", "_rest", "key", "bucket", "c0", "tokens", "upto"]
    rows = [(i, "w " * (i % 7), "en" if i % 2 else None, f"src{i % 3}") for i in range(80)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = plain.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names}).select("key", "_lang", *plain.columns, *[n for n in names if n not in ("key", "_lang")])
    kept = mixing.keep_mixed(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert sorted(r.doc_id for r in found) == sorted(r.doc_id for r in mixing.keep_mixed(plain).collect())
    assert all(r[n] == f"{n}{r.doc_id}" for r in found for n in names)
    assert mixing.mix_documents(docs).columns == [*docs.columns, "_domain", "_epoch"]


def test_sql_with_other_weights(spark, monkeypatch):
    import duckdb

    sql = mixing.ORACLE_SQL
    for old, new in (("'d0' THEN 0.4e0 WHEN 'd1' THEN 0.3e0", "'d0' THEN 0.05e0 WHEN 'd1' THEN 3e0"), ("'en' THEN 0.5e0 WHEN 'de' THEN 0.2e0", "'en' THEN 0.1e0 WHEN 'de' THEN 4e0"), ("4242", "99")):
        assert old in sql
        sql = sql.replace(old, new)
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    mix = mixing.Mix(domains={"d0": 0.05, "d1": 3, "d2": 0.2, "d3": 0.1}, languages={"en": 0.1, "de": 4, "fr": 0.2, "es": 0.1}, seed=99)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((r.doc_id, r._epoch) for r in mixing.mix_documents(docs, mix).select("doc_id", "_epoch").collect())
    assert got == sorted((r[0], r[1]) for r in con.execute(f"select doc_id, epoch from ({sql})").fetchall())


@pytest.mark.parametrize("seed", range(3))
def test_budgets_of_tables_equal_those_of_a_walk_down_the_tree(spark, seed):
    """Trees with empty leaves, weights of 0 and budgets from too little to too much."""
    rng = random.Random(seed)
    name = lambda x: {f"{x}{k}": rng.choice([0, 0.3, 1, 5]) for k in range(3)}
    mix = mixing.Mix(domains=name("d"), languages=name("l"), sources=name("s"), budget_share=rng.choice([0.05, 0.5, 0.9, 3.0]), max_epochs=rng.choice([1, 2]))
    tokens = {(f"d{rng.randrange(4)}", f"l{rng.randrange(4)}", f"s{rng.randrange(8)}"): rng.choice([0, 1, 10, 100, 1000]) for _ in range(60)}
    leaves = spark.createDataFrame([(*k, n) for k, n in tokens.items()], "_domain string, _lang string, _source string, tokens long")
    got = {(r[0], r[1], r[2]): r.budget for r in mixing.leaf_budgets(leaves, mix).collect()}
    want = leaf_budgets(tokens, mix)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1 for k in want) and sum(want.values()) > 0
    assert sum(got[k] == want[k] for k in want) > 0.95 * len(want)


def brute(rows, mix, spark):
    keys = {
        (r.doc_id, r.epoch): r.key
        for e in range(mix.max_epochs + 1)
        for r in spark.createDataFrame([(x[0],) for x in rows] or [(0,)], "doc_id long").distinct()
        .select("doc_id", F.lit(e).alias("epoch"), mixing.order_key(e, mix.seed).alias("key")).collect()
    }
    leaves = {}
    for doc_id, text, lang, source in rows:
        digits = "".join(c for c in (source or "") if c.isdigit())
        leaf = (f"d{int(digits or 0) % 4}", lang or "", source or "")
        leaves.setdefault(leaf, []).append((doc_id, len((text or "").split())))
    budgets = leaf_budgets({k: sum(n for _, n in v) for k, v in leaves.items()}, mix)
    out = []
    for leaf, docs in leaves.items():
        total = sum(n for _, n in docs)
        if not total:
            continue
        epochs, rest = divmod(budgets[leaf], total)
        out += [(d, e, leaf[0]) for e in range(epochs) for d, _ in docs]
        if rest:
            by_key = {}
            for d, n in docs:
                by_key.setdefault(keys[d, epochs], []).append((d, n))
            for key in sorted(by_key):
                rest -= sum(n for _, n in by_key[key])
                if rest < 0:
                    break
                out += [(d, epochs, leaf[0]) for d, _ in by_key[key]]
    return sorted(out)


@pytest.mark.parametrize("budget_share", [0.3, 0.8, 1.7])
def test_mixing_against_brute_force(spark, budget_share):
    rng = random.Random(3)
    rows = [
        (i if i % 50 else 7, None if i % 97 == 0 else "w " * rng.randint(0, 40), rng.choice(["en", "en", "de", "fr", None]),
         rng.choice(["src0"] * 6 + ["src1", "src2", "src7", None, "x"]))
        for i in range(600)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("_epochs_", F.lit(1))
    mix = mixing.Mix(budget_share=budget_share)
    got = mixing.mix_documents(docs, mix).select("doc_id", "_epoch", "_domain").collect()
    assert sorted(map(tuple, got)) == brute(rows, mix, spark)
    assert mixing.keep_mixed(docs, mix).columns == docs.columns


def test_mixing_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mixing.mix_documents(docs).count() == 0


def test_null_and_empty_names_are_leaves_of_their_own(spark):
    rows = [(k, "a b c", lang, source) for k, (lang, source) in enumerate((x, y) for x in (None, "", "\x01", "en") for y in (None, "", "\x01", "s"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert mixing.leaf_plan(docs, mixing.Mix()).count() == 16
    assert mixing.mix_documents(docs, mixing.Mix(budget_share=2.0)).count() == 32
