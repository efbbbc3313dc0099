"""Mined negatives against a loop over all rows, with whole numbers."""

import math
import random

import numpy as np
import pytest

from harborlight.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<double>"


def by_hand(rows):
    sound = []
    for at, (i, label, v) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            sound.append((i, label, [math.floor(256 * x) for x in v], at))
    out = []
    for i, label, v, at in sound:
        if i is None or i % 50:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for j, other, w, there in sound if there != at and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for score, j, _ in [s for s in scored if s[2] == label][:5]:
            window = [s for s in scored if s[2] != label and 50 * score <= 100 * s[0] <= 95 * score]
            out += [(i, j, rank, k, score, s) for rank, (s, k, _) in enumerate(window[:3], 1)]
    return sorted(out, key=str)


def found(spark, rows, **more):
    return sorted(map(tuple, hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), **more).collect()), key=str)


def vectors(rng, n, dim=6):
    return [(i, rng.randint(0, 3), [rng.gauss(0.4, 0.5) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("wave", [3, 1 << 16])
def test_against_a_loop(spark, monkeypatch, wave):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    rng = random.Random(11)
    rows = vectors(rng, 420)
    rng.shuffle(rows)
    assert found(spark, rows, wave_rows=wave) == by_hand(rows) != []


def test_ties_nulls_and_repeated_ids(spark):
    rng = random.Random(2)
    # Few different vectors: most scores tie.
    rows = [(i, rng.randint(0, 2), [float(rng.randint(0, 2)) for _ in range(3)]) for i in range(200)]
    rows += [(None, 1, [1.0, 2.0, 1.0]), (300, None, [1.0, 1.0, 1.0]), (350, 1, None), (400, 1, [1.0, None, 1.0]), (450, 2, [1.0, float("nan"), 1.0]), (500, 2, [float("inf"), 1.0, 1.0])]
    rows += [(550, 1, []), (600, 1, [2.0, 1.0]), (601, 1, [2.0, 1.0]), (602, 2, [1.0, 1.0])]
    assert found(spark, rows) == by_hand(rows) != []
    again = [(100, 1, [1.0, 1.0, 1.0])] * 3 + [(7, 2, [1.0, 1.0, 0.0])] * 4
    assert found(spark, again) == by_hand(again) != []


def test_large_components_stay_exact(spark):
    rng = random.Random(9)
    rows = [(i, i // 10 % 2, [float(rng.randint(1, 1 << 21)) + 0.5 for _ in range(4)]) for i in range(0, 400, 10)]
    got = found(spark, rows)
    assert got == by_hand(rows) != [] and max(r[4] for r in got) > 1 << 53


def test_empty_tables_one_label_and_other_columns(spark):
    assert found(spark, []) == []
    assert found(spark, [(50, 1, [1.0]), (51, 1, [1.0])]) == []
    rows = vectors(random.Random(1), 120)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", row int, wave string")
    assert sorted(map(tuple, hard_negatives.mine(frame).collect()), key=str) == by_hand(rows)


def test_blocks_in_any_order_merge_to_the_same(spark):
    rng = np.random.default_rng(4)
    scores, ids = rng.integers(0, 30, (7, 300)), rng.permutation(300)
    whole, parts = hard_negatives.Best(7, 5), hard_negatives.Best(7, 5)
    sound = rng.random((7, 300)) < 0.8
    none = np.zeros(300, bool)
    whole.add(np.arange(7), scores, sound, ids, none, ids)
    for part in np.array_split(rng.permutation(300), 9):
        parts.add(np.arange(7), scores[:, part], sound[:, part], ids[part], none[part], ids[part])
    for slot in range(7):
        want = sorted((-s, i) for s, i, ok in zip(scores[slot], ids, sound[slot]) if ok)[:5]
        for best in (whole, parts):
            assert list(zip((-best.score[slot]).tolist(), best.id[slot].tolist())) == want
