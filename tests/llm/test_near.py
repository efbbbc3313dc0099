import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborlight.llm import line_dedup, minhash_dedup, shingles, vector_dedup
from harborlight.llm.components import connected_components


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_connected_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)] + [(7, 7)]
    links += [(1000, 1000 + i) for i in range(1, 300)]
    rng.shuffle(links)
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups({x for pair in links for x in pair}, links)
    assert found == {n: c for n, c in want.items() if n != c}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block_rows", [8, 1024])
def test_vectors_against_brute_force(spark, block_rows):
    rng = np.random.RandomState(3)
    base = rng.standard_normal((12, 16))
    rows = []
    for i in range(260):
        v = base[i % 12] + rng.standard_normal(16) * rng.choice([0.05, 0.2, 1.0]) if i % 3 else rng.standard_normal(16)
        rows.append((i * 3, [float(np.float32(x)) for x in v], int(rng.randint(0, 2))))
    rows += [(1000 + i, rows[1][1], rows[1][2]) for i in range(40)]
    odd = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None] * 16, 1), (2004, rows[1][1], None),
           (2005, [], 1), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1))
    got = {r.vec_id: r for r in vector_dedup.near_vectors(frame, block_rows=block_rows).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows]
    want = groups(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    assert near.sum() > 1500
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[k].sum(), want[i], want[i] == i)
    for i in (2000, 2001, 2002, 2003, 2004, 2005):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[2006].n_links == 1 and got[2007].component_id == 2006


def test_repeated_and_null_vector_ids(spark):
    """Rows of one vec_id, with different vectors and with the same one, each have their own links."""
    rng = np.random.RandomState(8)
    a, b = rng.standard_normal((2, 16))
    near = lambda v: [float(x) for x in v + rng.standard_normal(16) * 0.02]
    rows = [(1, near(a), 0), (1, near(b), 0), (2, near(a), 0), (3, near(b), 0), (4, near(b), 0), (None, near(a), 0), (None, [9.0] + [0.0] * 15, 0)]
    rows += [(5, rows[2][1], 0), (5, rows[2][1], 0)]
    names = {n: F.lit(1) for n in ("rep", "kind", "least", "block", "table", "component_id", "n_links", "dim")}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns(names)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(frame).collect()), key=str)
    # The vectors near a: 1, 2, null, 5, 5; those near b: 1, 3, 4.
    want = [(1, 4, 1, True), (2, 4, 1, False), (None, 4, 1, False), (5, 4, 1, False), (5, 4, 1, False)]
    want += [(1, 2, 1, True), (3, 2, 1, False), (4, 2, 1, False), (None, 0, None, True)]
    assert got == sorted(want, key=str)


def test_recall_by_cosine():
    """Pairs met by the tables, over pairs of three cosines at 64 dimensions."""
    rng = np.random.RandomState(2)
    import pyarrow as pa

    sign = vector_dedup.signer(vector_dedup.PROJECTIONS, vector_dedup.TABLES, vector_dedup.WIDTH, vector_dedup.SEED)
    for cosine, least in ((0.93, 0.99), (0.95, 0.999), (0.98, 0.9999)):
        x = rng.standard_normal((3000, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.standard_normal((3000, 64))
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y *= np.sqrt(1 - cosine**2) / np.linalg.norm(y, axis=1, keepdims=True)
        y += cosine * x
        both = np.concatenate((x, y)).astype(np.float64)
        batch = pa.RecordBatch.from_pydict({"rep": list(range(6000)), "kind": [0] * 6000, "dim": [64] * 6000, "embedding": list(both)})
        parts = [b.column("signature") for b in sign([batch])]
        signature = np.concatenate([np.asarray(p.flatten()) for p in parts]).reshape(6000, -1)
        assert (signature[:3000] == signature[3000:]).any(axis=1).mean() >= least


def test_no_vectors(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_dedup.near_vectors(frame).count() == 0


def word_sets(text):
    import re

    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_shingle_sets():
    texts = [None, "", " \t\n", "A b", "a B", "É a b c d e", "a b c d e f a b c d e f", "x\x0by", "a\xa0b"]
    sets = shingles.shingle_sets(texts)
    assert [len(s) for s in sets] == [len(word_sets(t)) for t in texts]
    assert np.array_equal(sets[3], sets[4]) and not np.array_equal(sets[3], sets[7])


def test_sketch_estimates_and_merges():
    rng = np.random.RandomState(1)
    parameters = minhash_dedup.sketch_parameters()
    for common in (0, 300, 900):
        x = rng.randint(0, 2**63, 1000).astype(np.uint64)
        y = np.concatenate((x[:common], rng.randint(0, 2**63, 1000 - common).astype(np.uint64)))
        a, b = (minhash_dedup.sketch(s, parameters) for s in (x, y))
        guess = minhash_dedup.estimate(a[None], b[None], np.array([1000.0]), np.array([1000.0]))[0]
        assert abs(guess - common / (2000 - common)) < 0.13
        assert np.array_equal(np.maximum(a, b), minhash_dedup.sketch(np.concatenate((x, y)), parameters))


@pytest.mark.parametrize("block_rows", [6, 2048])
def test_documents_against_brute_force(spark, block_rows):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("xyz")
    base = [[word() for _ in range(rng.choice([4, 12, 60, 150]))] for _ in range(14)]
    docs = []
    for i in range(330):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = word()
        docs.append((i * 2, " ".join(words) if i % 11 else " ".join(base[0]).upper()))
    docs += [(1001, None), (1003, ""), (1005, " \n "), (1007, "one"), (1009, "One")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rep", F.lit("x"))
    got = {r.doc_id: r for r in minhash_dedup.near_documents(frame, block_rows=block_rows).collect()}
    sets = {i: word_sets(t) for i, t in docs}
    ids = sorted(sets)
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    want = groups(ids, links)
    assert len(links) > 500
    for i in ids:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), want[i], want[i] == i)
    kept = minhash_dedup.keep_one(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == set(want.values())


def test_sizes_and_names_where_ids_repeat(spark):
    """Two texts of one id, of very different sizes, each near to texts of other ids."""
    rng = random.Random(2)
    long = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    short = [f"v{rng.randrange(10**6)}" for _ in range(40)]
    changed = lambda words, k: " ".join(words[:k] + ["new"] + words[k + 1 :])
    rows = [(7, " ".join(long)), (7, " ".join(short)), (8, changed(long, 100)), (9, changed(short, 38)), (3, " ".join(long[:150])), (7, " ".join(short))]
    names = {n: F.lit(1) for n in ("rep", "digest", "doc", "component", "gone", "text_hash", "_text_hash", "c0", "block")}
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns(names)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_documents(frame).collect())
    assert got == [(3, 146, 3, True), (7, 36, 7, True), (7, 36, 7, True), (7, 296, 7, True), (8, 296, 7, False), (9, 36, 7, False)]
    kept = minhash_dedup.keep_one(frame)
    assert kept.columns == frame.columns and sorted((r.doc_id, len(r.text.split())) for r in kept.collect()) == [(3, 150), (7, 40), (7, 300)]


def test_repeated_ids_and_no_documents(spark):
    text = "a b c d e f g h i j"
    frame = spark.createDataFrame([(1, text), (1, text), (2, "other words here entirely"), (2, text), (None, text)], "doc_id long, text string")
    rows = minhash_dedup.near_documents(frame).collect()
    assert len(rows) == 5 and {r.component_id for r in rows if r.doc_id is not None} == {1}
    assert sorted((r.doc_id or 0, r.text) for r in minhash_dedup.keep_one(frame).collect()) == [(0, text), (1, text)]
    assert minhash_dedup.near_documents(frame.limit(0)).count() == 0


def test_no_shuffled_join_is_broadcast_as_it_runs(spark):
    words = [f"w{k % 97}" for k in range(400)]
    texts = [" ".join(words[k % 7 :]) + f"\nline {k % 5} of text number {k}" for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in zip(settings, ("-1", "10m")):
            spark.conf.set(name, value)
        for made in (minhash_dedup.keep_one(docs), line_dedup.keep_first_lines(docs)):
            made.collect()
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
