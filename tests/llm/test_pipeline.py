import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from harborlight.llm import language_id, line_dedup, minhash_dedup, mixing, packing, queries, tokens

from . import test_line_dedup, test_mixing, test_models, test_near

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        counts.append(docs.count())
    assert counts[0] >= counts[1] > 0.9 * counts[0]
    texts = {(r.doc_id): r.text for r in docs.collect()}
    assert docs.count() >= len(texts) > 0
    pieces = packing.pack(docs).collect()
    assert {r.doc_id for r in pieces} == set(texts)
    again = corpus_pipeline.run(spark, SMALL).collect()
    assert {(r.doc_id, r.doc_tokens) for r in again} == {(r.doc_id, r.doc_tokens) for r in pieces}
    assert sum(r.length for r in again) == sum(r.length for r in pieces)


def test_near_copies_after_line_dedup(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    lines = line_dedup.keep_first_lines(docs)
    kept = minhash_dedup.keep_one(lines).select("doc_id")
    groups = minhash_dedup.near_documents(lines)
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in groups.collect()}


def test_mixing_stage_follows_the_budgets(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    given = sum(r.n for r in mixing.keep_mixed(docs).select(mixing.token_count(F.col("text")).alias("n")).collect())
    total = sum(r.n for r in docs.select(mixing.token_count(F.col("text")).alias("n")).collect())
    assert 0.7 * mixing.BUDGET_SHARE * total < given <= mixing.BUDGET_SHARE * total


def test_one_query_for_each_operator():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)


def corpus():
    """Two languages, texts without letters, nulls, lines that many texts share, near copies and repeated rows."""
    rng = random.Random(12)
    rows, shared = [], [test_models.prose("xx", rng, 8), test_models.prose("yy", rng, 9)]
    for i in range(220):
        lang = rng.choice(["xx", "yy"])
        lines = [test_models.prose(lang, rng, rng.choice([6, 20, 50])) for _ in range(rng.randint(1, 3))]
        if i % 4 == 0:
            lines.insert(rng.randrange(len(lines) + 1), shared[lang == "yy"])
        rows.append((i, "\n".join(lines), lang if i % 9 else None, rng.choice(["src0", "src0", "src1", "src2", None])))
    for i in range(30):
        words = rows[i][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((300 + i, " ".join(words).replace("\n", " "), *rows[i][2:]))
    rows += [(400, None, "xx", "src1"), (401, "", None, None), (402, "12 34 !!", "yy", "src2"), (403, rows[5][1], "xx", "src1"), (None, "the ing er and ou", "xx", "src1")]
    return rows


def brute(rows, model, spark):
    """(doc_id, tokens) of the pieces' documents with how often, by plain Python for each stage."""
    left = []
    for doc_id, text, lang, source in rows:
        if any(c.isalpha() for c in text or ""):
            chance = test_models.plain_language(model, text)
            if max(chance) >= model.reject_below:
                left.append((doc_id, text, lang, source))
    first = -1  # a null doc_id comes first
    texts = test_line_dedup.brute([(first if d is None else d, t) for d, t, _, _ in left])
    left = [(d, texts[first if d is None else d], lang, s) for d, t, lang, s in left]
    left = [r for r in left if r[1].strip()]
    sets = {r[0]: test_near.word_sets(r[1]) for r in left if r[0] is not None}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    names = test_near.groups(ids, links)
    left = [r for r in left if r[0] is None or names[r[0]] == r[0]]
    given = Counter(d for d, _, _ in test_mixing.brute([(d, t, lang, s) for d, t, lang, s in left if d is not None], mixing.Mix(), spark))
    library = tokens.Encoder(tokens.vocabulary())._model
    size = {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t, _, _ in left}
    return Counter({(d, size[d]): n for d, n in given.items()})


def test_the_pipeline_against_plain_python(spark, tmp_path):
    rows = [r for r in corpus() if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    model = language_id.fit(spark.read.parquet(str(tmp_path / "documents.parquet")), language_id.learnable())
    want = brute(rows, model, spark)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(want.values()) > 100
    assert Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0) == want
    assert sum(r.length for r in pieces) == sum(n * size for (_, size), n in want.items())
    filled = Counter()
    for r in pieces:
        filled[r.sequence_id] += r.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in filled.values())


def test_stages_on_nulls_repeated_rows_and_clashing_names(spark):
    rows = [*corpus(), corpus()[3], corpus()[3]]
    names = ["_text_hash", "_epoch", "_last", "_domain", "row", "id", "h1", "c0", "pred", "lang_pred", "tokens", "dropped", "lines", "rep", "component"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names}).select("rep", *[c for c in docs.columns + names if c != "rep"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        found = out.collect()
        assert 0 < len(found) and all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for r in found for n in names), name
        docs = spark.createDataFrame(found, docs.schema)
    assert packing.pack(docs).count() > 0


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
