import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborlight.llm import suffix_dedup


def covered(blobs, length):
    counts = Counter(b[i : i + length] for b in blobs for i in range(len(b) - length + 1))
    masks = []
    for b in blobs:
        mask = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                mask[i : i + length] = True
        masks.append(mask)
    return masks


@pytest.mark.parametrize("seed", range(6))
def test_interval_expansion_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        letters = rng.choice([b"a", b"ab", b"abcdefgh"])
        base = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3)]
        blobs = [
            b"".join(rng.choice(base)[rng.randint(0, 9) : rng.randint(10, 60)] for _ in range(rng.randint(0, 4))) + bytes(rng.choice(letters) for _ in range(rng.randint(1, 9)))
            for _ in range(rng.randint(1, 6))
        ]
        length = rng.choice([5, 9, 20])
        found = suffix_dedup.repeated_starts(blobs, length)
        counts = Counter(b[i : i + length] for b in blobs for i in range(len(b) - length + 1))
        assert found.tolist() == [counts[b[i : i + length]] > 1 and i + length <= len(b) for b in blobs for i in range(len(b))]


def test_expansion_sorts_what_is_open_only(monkeypatch):
    rng = random.Random(8)
    passage = bytes(rng.randrange(256) for _ in range(600))
    segments = [bytes(rng.randrange(256) for _ in range(5000)) for _ in range(4)]
    segments += [segments[0][:70] + passage, passage + segments[1][:70]]
    n = sum(len(s) + 1 for s in segments)
    handed = []
    for name in ("sort", "argsort"):
        plain = getattr(np, name)
        monkeypatch.setattr(np, name, lambda a, plain=plain, **how: handed.append(len(a)) or plain(a, **how))
    found = np.split(suffix_dedup.repeated_starts(segments, 400), np.cumsum([len(s) for s in segments])[:-1])
    assert [int(f.sum()) for f in found] == [0, 0, 0, 0, 201, 201] and found[4][70:271].all() and found[5][:201].all()
    assert sum(handed) < 6 * n  # suffixes, their transform and the bounds of intervals (4.6); 10.3 when each round sorted all suffixes again


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (70, 90, 120, 200)]
    docs = []
    for i in range(90):
        parts = [text(rng.randint(0, 60))]
        if i % 2:
            passage = rng.choice(passages)
            cut = rng.randint(0, 60)
            parts += [passage[cut:], text(rng.randint(0, 60))]
        docs.append((i, "".join(parts)))
    docs += [(200, None), (201, ""), (202, "z" * 399), (203, "z" * 1000), (204, "ab" * 700), (205, docs[0][1]), (206, docs[0][1]), (206, docs[0][1])]
    docs += [(300 + i, text(3) + passages[3] + text(3)) for i in range(60)]
    return docs


@pytest.mark.parametrize("group_bytes", [3000, 1 << 21])
def test_documents_against_brute_force(spark, group_bytes):
    docs = corpus(2)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("group", F.lit(1)).repartition(3)
    rows = suffix_dedup.remove_repeats(frame, group_bytes=group_bytes).collect()
    blobs = [(t or "").encode() for _, t in docs]
    want = []
    for (doc_id, _), blob, mask in zip(docs, blobs, covered(blobs, 400)):
        kept = np.frombuffer(blob, dtype=np.uint8)[~mask].tobytes()
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(int), [0]))))
        want.append((doc_id, len(blob), list(zip(edges[::2].tolist(), edges[1::2].tolist())), kept))
    assert sum(len(w[2]) for w in want) > 80
    got = [(r.doc_id, r.n_bytes, [(s.first, s.end) for s in r.spans], bytes(r.kept)) for r in rows]
    assert sorted(got) == sorted(want)


def test_anchors_of_texts_in_several_stretches(monkeypatch):
    rng = np.random.RandomState(1)
    blobs = [bytes(rng.randint(97, 100, n).astype(np.uint8)) for n in (5000, 120, 9000)]
    whole = suffix_dedup.anchored_segments(blobs, 60, 12)
    monkeypatch.setattr(suffix_dedup, "PLACES", 700)
    for a, b in zip(whole, suffix_dedup.anchored_segments(blobs, 60, 12)):
        assert np.array_equal(a, b)


def test_rounds_that_do_not_end_raise(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_ROUNDS", 1)
    frame = spark.createDataFrame(corpus(2), "doc_id long, text string")
    with pytest.raises(RuntimeError):
        suffix_dedup.remove_repeats(frame, group_bytes=3000).collect()


def test_several_arrow_batches_in_a_partition(spark):
    """Batches of a few kilobytes cut a partition's rows anywhere."""
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    docs = corpus(5)
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4096")
        rows = suffix_dedup.remove_repeats(frame, group_bytes=5000).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch") if before is None else spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
    blobs = [(t or "").encode() for _, t in docs]
    want = sorted((d, int(m.sum())) for (d, _), m in zip(docs, covered(blobs, 400)))
    assert sorted((r.doc_id, sum(s.end - s.first for s in r.spans)) for r in rows) == want


def test_text_is_what_is_left_without_cut_characters(spark):
    """Repeats that begin and end within characters of two and four bytes."""
    shared = "é😀" * 90
    frame = spark.createDataFrame([(1, "ab" + shared + "cd"), (2, "\u0129" + shared + "\u00aa!"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame).collect()}
    assert rows[1].text == "abcd" and rows[2].text == "\u0129\u00aa!" and rows[3].text is None and rows[3].n_bytes == 0
    for r in rows.values():
        assert bytes(r.kept).decode(errors="ignore") == (r.text or "")


def test_an_empty_table_and_null_ids(spark):
    frame = spark.createDataFrame([(None, "q" * 500), (None, "short")], "doc_id long, text string")
    rows = {bytes(r.kept): r.doc_id for r in suffix_dedup.remove_repeats(frame).collect()}
    assert rows == {b"": None, b"short": None}
    assert suffix_dedup.remove_repeats(frame.limit(0)).count() == 0
