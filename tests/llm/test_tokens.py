import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from harborlight.llm import packing, token_output, tokens

WORDS = ["the", "Été", "don't", "'ll", "it's", "re'", "1", "2024", ".", "!!", "--", "_x", "ß", "×", "÷", "日本", "\x00", "²", "<|endoftext|>"]
GAPS = [" ", "  ", "\n", "\r\n", "\t", " \n ", "\xa0", "", ""]


@pytest.fixture(scope="module")
def model():
    return tokens.Encoder(tokens.vocabulary())


def plain(model, text):
    return np.array(model._model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from(GAPS)).map("".join), max_size=30).map("".join), st.text(max_size=60))
def test_same_ids_as_the_library(a, b):
    model = tokens.encoder(tokens.vocabulary())
    assert model.encode([a, b, a + b, ""]) == [plain(model, x) for x in (a, b, a + b, "")]


def test_long_texts_and_a_full_table(model, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice(WORDS[:12]) + rng.choice(GAPS[:6]) for _ in range(800)) for _ in range(6)] + ["x" * 5000]
    monkeypatch.setattr(tokens, "_LONGEST", 300)
    monkeypatch.setattr(tokens, "TABLE_ENTRIES", 20)
    for _ in range(2):
        for text in texts:
            assert model.encode([text]) == [plain(model, text)]


def test_pretokens_whose_hashes_meet(monkeypatch):
    """With a hash of 128 values nearly all pre-tokens share one with another; ids stay those of the library."""
    monkeypatch.setattr(tokens, "mixed", lambda x: x % np.uint64(251))
    model = tokens.Encoder(tokens.vocabulary())
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(40)) for _ in range(30)]
    for _ in range(2):
        assert model.encode(texts) == [plain(model, t) for t in texts]


def test_vocabularies_with_other_rules():
    """Where a file states other rules than those known here, the library encodes alone."""
    import json
    from pathlib import Path

    seen = 0
    for path in sorted(Path(tokens.vocabulary()).parent.glob("*.json")):
        if "pre_tokenizer" not in json.loads(path.read_text()):
            continue
        model = tokens.Encoder(str(path))
        texts = ["It's 12 o'clock,  isn't it?", "Été \n\n x", ""]
        assert model.encode(texts) == [plain(model, t) for t in texts]
        seen += 1
    assert seen


DOCS = [(5, "one two three"), (2, None), (9, ""), (7, "word " * 3000), (1, "é\n\n x"), (5, "one two three"), (5, "zz"), (None, "no id")]


def test_orc_round_trip(spark, tmp_path, model):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    path = str(tmp_path / "orc")
    token_output.write_tokens(docs, path)
    rows = token_output.token_digest(token_output.read_tokens(spark, path)).collect()
    order = sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for doc_id, text in order:
        ids = plain(model, text or "") + bytes(4)
        want.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_orc_prunes_by_document(spark, tmp_path):
    docs = spark.range(5000).selectExpr("id as doc_id", "concat('text number ', id) as text")
    path = str(tmp_path / "orc")
    token_output.write_tokens(docs, path)
    rows = spark.read.schema(token_output.TOKEN_SCHEMA).orc(path).where("doc_id = 77").select("doc_id", "n_tokens")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 1 and "EqualTo(doc_id,77)" in plan and "ids" not in plan.split("ReadSchema")[1]


def scanned(df):
    """Rows that the scan gives for a frame, after stripes and row groups were left out."""
    df.collect()

    def scans(plan):
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            yield from scans(plan.executedPlan())
        if plan.nodeName().startswith("Scan"):
            yield plan.metrics().apply("numOutputRows").value()
        for k in range(plan.children().size()):
            yield from scans(plan.children().apply(k))

    return sum(scans(df._jdf.queryExecution().executedPlan()))


def test_orc_reads_few_rows_for_an_id_and_none_for_one_that_is_absent(spark, tmp_path):
    """Statistics of stripes and row groups leave one row group of 1000 rows; its Bloom filter tells absent ids within its range."""
    path = str(tmp_path / "orc")
    token_output.write_tokens(spark.range(20_000).selectExpr("2 * id as doc_id", "concat('text number ', id) as text"), path)
    rows = spark.read.schema(token_output.TOKEN_SCHEMA).orc(path)
    for doc_id in (0, 77_0, 24_690, 39_998):
        df = rows.where(F.col("doc_id") == doc_id).select("doc_id", "n_tokens")
        assert df.count() == 1 and scanned(df) <= 1000
    absent = [scanned(rows.where(F.col("doc_id") == doc_id).select("doc_id")) for doc_id in range(1001, 39_000, 2000)]
    assert sum(n > 0 for n in absent) <= 3 and max(absent) <= 1000
    assert scanned(rows.where("doc_id between 10000 and 11000").select("doc_id", "n_tokens")) <= 3000
    assert scanned(rows.where("doc_id = -5").select("doc_id")) == 0


def test_orc_of_an_empty_table(spark, tmp_path):
    token_output.write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "orc"))
    assert token_output.read_tokens(spark, str(tmp_path / "orc")).count() == 0


def check_pieces(rows, docs, model):
    """Every id lies in one piece; sequences are gapless and padded by little."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        filled = sum(p.length for p in pieces)
        assert 0 < filled <= 2048
        padding += 0 if filled & (filled - 1) == 0 else 2048 - filled
    assert padding == 0
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text in docs.items():
        ids = plain(model, text or "") + (1).to_bytes(4, "little")
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert p.start == at and p.doc_tokens == len(ids) // 4
            assert p.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + p.length)])
            at += p.length
        assert at == len(ids) // 4


def test_packing(spark, model):
    rng = random.Random(2)
    docs = {i: None if i == 3 else "word and " * rng.choice([0, 1, 30, 300, 700, 1023, 1024, 3000]) for i in range(200)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    rows = packing.pack(frame).collect()
    check_pieces(rows, docs, model)


def test_packing_repeated_rows_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sum(r.length for r in packing.pack(frame).collect()) == 8
    assert packing.pack(frame.limit(0)).count() == 0


def test_best_level_is_the_least_sum_of_squares():
    rng = np.random.RandomState(0)
    packer = packing.Packer(0, length=16)
    for _ in range(200):
        count = rng.randint(0, 4, 17) * (rng.rand(17) < 0.5)
        count[0] = count[16] = 0
        packer._count = count.astype(np.int64)
        size = rng.randint(1, 16)

        def after(level):
            c = count.copy()
            if level:
                c[level] -= 1
            if level + size < 16:
                c[level + size] += 1
            return int((c**2).sum())

        fits = [h for h in range(17 - size) if h == 0 or count[h]]
        assert after(packer.best_level(size)) == min(map(after, fits))


def test_many_open_windows_are_closed(model):
    packer = packing.Packer(0, open_windows=8)
    for doc in range(100):
        packer.add(doc, bytes(4 * 1500))
    packer.close()
    rows = packer.pieces()
    assert sum(r[2] for r in rows) == 150_000 and not packer.pieces()
