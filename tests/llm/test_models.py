import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborlight.llm import language_id, quality

SYLLABLES = {"xx": ["the", "ing", "er", "and", "ou"], "yy": ["che", "sch", "ein", "ung", "keit"], "zz": ["ción", "que", "ll", "ado", "mente"]}


def prose(lang, rng, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words)) + "."


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(6)
    rows = []
    for i in range(700):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, prose(lang, rng, rng.choice([1, 3, 20, 120])), lang))
    return rows


def test_language_accuracy_on_held_out_rows(spark, labelled):
    odd = [(9001, None, "xx"), (9002, "", None), (9003, "12 345 !!", "yy"), (9004, "é", None), (9005, "x", "zz")]
    docs = spark.createDataFrame(labelled + odd, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash"))
    model = language_id.fit(docs, language_id.learnable())
    assert model.languages == sorted(SYLLABLES)
    got = {r.doc_id: r for r in language_id.identify(docs.select("doc_id", "text"), model).collect()}
    held = [(i, lang) for i, _, lang in labelled if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.97
    for i in (9001, 9002, 9003):
        assert (got[i].lang_pred, got[i].lang_score, got[i].lang_rejected) == ("und", 0.0, True)
    assert all(0 <= r.lang_score <= 1 and r.lang_pred in {*SYLLABLES, "und"} for r in got.values())
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {9001, 9002, 9003} and len(ids & {i for i, _, _ in labelled}) > 0.98 * len(labelled)


def test_language_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs, language_id.learnable())
    assert [r.lang_pred for r in language_id.identify(docs, model).collect()] == ["und"]
    assert language_id.keep_identified(docs.limit(0)).count() == 0


def language_model(rows):
    return language_id.train([(language_id.examples(t, i), lang, i % 5 == 0) for i, t, lang in rows])


def plain_language(model, text):
    """Probabilities by a loop over the runs of 2, 3 and 4 bytes that begin at each byte."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c for c in text)
    data = f" {lower} ".encode()
    total = [0.0] * len(model.languages)
    for at in range(len(data)):
        for size in (2, 3, 4):
            run = (data + b"    ")[at : at + size]
            value = run[0]
            for k, byte in enumerate(run[1:], 1):
                value = (value * 0x01000193 + byte + k) % 2**32
            x = (value ^ (value >> 15)) * 0x85EBCA6B % 2**32
            bucket = ((x >> 13) ^ x) % 2**15
            for lang in range(len(total)):
                total[lang] += float(model.table[bucket, lang]) / (3 * len(data))
    z = [a + float(b) for a, b in zip(total, model.bias)]
    e = [math.exp(v - max(z)) for v in z]
    return [v / sum(e) for v in e]


def test_language_against_a_plain_sum(labelled):
    model = language_model(labelled[:150])
    for text in ["a", "É x", "THE ing\tand\nou", labelled[160][1], labelled[161][1] * 3]:
        assert np.allclose(language_id.scores(model, [text])[0], plain_language(model, text), atol=1e-6)


def test_language_learns_from_the_end_of_long_texts(spark):
    """What tells the languages apart stands behind 30,000 characters that they share."""
    rng = random.Random(9)
    rows = [(i, "abc def " * 4000 + prose(lang, rng, 3000), lang) for i, lang in enumerate(["xx", "yy"] * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.lit(True))
    assert [model.languages[k] for k in language_id.scores(model, [prose("xx", rng, 50), prose("yy", rng, 50)]).argmax(axis=1)] == ["xx", "yy"]


def test_language_training_rows_of_one_id_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_EXAMPLES", 10)
    docs = spark.createDataFrame([(7, "the ing and", "xx")] * 50 + [(8, "che sch ein", "yy")], "doc_id long, text string, lang string")
    assert language_id.fit(docs, F.lit(True)).languages


def test_scores_of_a_batch_are_those_of_each_text(labelled):
    model = language_model(labelled[:150])
    texts = [t for _, t, _ in labelled[150:180]] + ["", "a"]
    assert np.allclose(language_id.scores(model, texts), np.concatenate([language_id.scores(model, [t]) for t in texts]))


def junk(rng, n):
    kind = rng.randrange(3)
    words = prose("xx", rng, n).split()
    return "!! ".join(w.upper() for w in words) if kind == 0 else " | ".join(words) if kind == 1 else "*** ".join(words)


def test_quality_accuracy_on_held_out_rows(spark):
    rng = random.Random(7)
    rows = [(i, prose("xx", rng, rng.randint(5, 200)) if i % 3 else junk(rng, rng.randint(5, 200)), int(i % 3 > 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (9002, "")], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(9001, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels.where(~quality.held_out()))
    got = {r.doc_id: r.score for r in quality.score_documents(docs, model).collect()}
    held = [(got[i], q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100 and np.mean([(s >= quality.THRESHOLD) == q for s, q in held]) > 0.95
    assert len(got) == 602 and all(0 <= s <= 1 for s in got.values())


def test_quality_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.score_documents(docs, quality.fit(docs, labels)).collect()} == {1.0}
    assert {r.score for r in quality.score_documents(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}


def plain_quality(model, data):
    """The score by loops over filters, positions and chunks."""
    p = {k: v.astype(float) for k, v in model.parameters.items()}
    size = quality.CHUNK * quality.STRIDE
    chunks = max(1, -(-(len(data) - 4) // size))
    data = data + bytes(chunks * size + 4)
    left = max(1, -(-(len(data) - (chunks * size + 4) - 4) // 4))
    tops, means, weights = [], [], []
    for c in range(chunks):
        used = min(quality.CHUNK, left - c * quality.CHUNK)
        act = []
        for at in range(used):
            x = np.concatenate([p["embedding"][b] for b in data[c * size + 4 * at : c * size + 4 * at + 8]])
            first, second = p["filters"][:, : quality.FILTERS], p["filters"][:, quality.FILTERS :]
            act.append(np.maximum(0, x[:32] @ first + x[32:] @ second + p["bias"]))
        tops.append(np.max(act, axis=0))
        means.append(np.mean(act, axis=0))
        weights.append(used)
    average = np.average(means, axis=0, weights=weights)
    x = np.concatenate([np.max(tops, axis=0), 4 * average, 4 * np.max(means, axis=0), [np.log1p(sum(weights)) / 4]])
    z = np.tanh(x @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"][0] + model.shift
    return 1 / (1 + math.exp(-z))


def test_quality_against_plain_loops():
    rng = random.Random(4)
    rows = [(prose("xx", rng, 60).encode(), 1) for _ in range(40)] + [(junk(rng, 60).encode(), 0) for _ in range(40)]
    model = quality.train(rows, 0.4)
    for data in (b"", b"a", b"abcd", b"abcdefgh!", rows[0][0][:512], rows[0][0][:516], rows[1][0] * 7, rows[50][0] * 5):
        assert quality.scores(model, [data])[0] == pytest.approx(plain_quality(model, data), abs=1e-5)


def test_quality_learns_from_long_texts(spark):
    """Labelled texts differ in their second half only."""
    rng = random.Random(10)
    shared = prose("xx", rng, 700)
    text = lambda good: shared + (prose("xx", rng, 700) if good else junk(rng, 700))
    docs = spark.createDataFrame([(i, text(i % 2)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    found = quality.scores(model, [text(k % 2).encode() for k in range(20)])
    assert np.mean([(s >= 0.5) == k % 2 for k, s in enumerate(found)]) > 0.9


def test_quality_learns_from_the_last_bytes(spark, monkeypatch):
    """The only signal is the last 10 bytes of 100 KB texts."""
    monkeypatch.setattr(quality, "LEAST_STEPS", 100)
    monkeypatch.setattr(quality, "EPOCHS", 1)
    monkeypatch.setattr(quality, "BATCH", 2)
    shared = ("the same words again and again, " * 4000)[:100_000]
    text = lambda good: shared[:-10] + ("?" * 10 if good else "%" * 10)
    docs = spark.createDataFrame([(i, text(i % 2)) for i in range(40)], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))
    low, high = quality.scores(model, [text(0).encode(), text(1).encode()])
    assert low < 0.2 and high > 0.8


def test_quality_sample_is_bounded_by_rows_only(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 300)
    seen = []
    monkeypatch.setattr(quality, "train", lambda rows, share: seen.extend(rows))
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(40)] + [(90, "y" * 5000)], "doc_id long, text string")
    quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))
    assert sorted((len(t), q) for t, q in seen) == [(100, 0)] * 3 + [(100, 1)] * 3
    seen.clear()
    quality.fit(docs, spark.createDataFrame([(90, 1)], "doc_id long, quality int"))
    assert [len(t) for t, _ in seen] == [5000]


def test_quality_gradients_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.RandomState(1)
    rows = [(bytes(rng.randint(32, 120, n).astype(np.uint8)), k % 2) for k, n in enumerate((1, 9, 700, 9000, 2500, 40))]
    p = quality.train(rows * 10, 0.5).parameters
    blobs, target = [b for b, _ in rows], np.array([q for _, q in rows], np.float32)
    whole = quality._gradients(p, blobs, target)
    monkeypatch.setattr(quality, "PIECE", 3)
    parts = quality._gradients(p, blobs, target)
    assert all(np.allclose(whole[k], parts[k], rtol=1e-3, atol=1e-6) for k in whole)


def test_models_on_empty_tables_repeated_rows_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(quality, "LEAST_STEPS", 20)
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "x" * 200_000)], "doc_id long, text string").withColumns(
        {n: F.lit(1) for n in ("score", "place", "quality", "chunks", "seed", "lang", "lang_pred", "c0")}
    )
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, quality int").withColumn("place", F.lit(0))
    scored = quality.score_documents(docs, quality.fit(docs, labels)).collect()
    assert len(scored) == 3 and len({r.score for r in scored if r.doc_id == 1}) == 1
    model = quality.fit(docs.limit(0), labels)
    assert quality.score_documents(docs.limit(0), model).count() == 0 and quality.fit(docs, labels.limit(0)).parameters is None
    kept = language_id.keep_identified(docs.withColumn("lang", F.lit("xx")))
    assert kept.columns == docs.columns and kept.count() <= 3


def test_quality_gradients():
    rng = np.random.RandomState(0)
    blobs = [bytes(rng.randint(32, 120, n).astype(np.uint8)) for n in (1, 9, 700, 1500)]
    model = quality.train([(b, i % 2) for i, b in enumerate(blobs)] * 30 + [(bytes([k]) * 60, k % 2) for k in range(40, 120)], 0.5)
    p = {k: v.astype(np.float64) for k, v in model.parameters.items()}
    target = np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        data, counts, used = quality.layout(blobs)
        top, mean = quality.pooled(quality.responses(p, data), used)
        z = quality.logits(p, quality.features(top, mean, counts, used))[0]
        return float(np.mean(np.logaddexp(0, z) - target * z))

    g = quality._gradients(p, blobs, target)
    for name in p:
        for _ in range(4):
            at = tuple(rng.randint(0, n) for n in p[name].shape)
            value, step = p[name][at], 1e-6
            p[name][at] = value + step
            up = loss()
            p[name][at] = value - step
            down = loss()
            p[name][at] = value
            assert abs((up - down) / (2 * step) - g[name][at]) < 2e-3 + 0.05 * abs(g[name][at])


def test_long_documents_score_like_their_chunks():
    rng = random.Random(3)
    rows = [(prose("xx", rng, 60).encode(), 1) for _ in range(40)] + [(junk(rng, 60).encode(), 0) for _ in range(40)]
    model = quality.train(rows, 0.5)
    long = prose("xx", rng, 20_000).encode()
    assert quality.scores(model, [long])[0] == pytest.approx(quality.scores(model, [rows[0][0], long])[1])
