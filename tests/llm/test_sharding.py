"""Shards against brute force: the least capacity, rows whole and numbered without gaps, copies together."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from harborlight.llm import sharding


def least_capacity(sizes, shards):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, used, left = (lo + hi) // 2, 1, (lo + hi) // 2
        for s in sizes:
            if s > left:
                used, left = used + 1, mid
            left -= s
        lo, hi = (lo, mid) if used <= shards else (mid + 1, hi)
    return lo


def parts_of(sizes, cuts):
    at = [0, *cuts, sum(sizes)]
    return [b - a for a, b in zip(at, at[1:])]


def starts_of(sizes):
    out, at = [], 0
    for s in sizes:
        out.append((at, s))
        at += s
    return out


@pytest.mark.parametrize("marks", [4, 16, 1 << 16])
@pytest.mark.parametrize("kind", ["even", "wide", "hot", "few", "ones"])
def test_capacity_is_the_least_and_cuts_keep_to_it(spark, kind, marks):
    rng = random.Random(kind)
    sizes = {
        "even": [rng.randint(90, 110) for _ in range(400)],
        "wide": [int(1 + 10 ** rng.uniform(0, 4)) for _ in range(400)],
        "hot": [rng.randint(1, 50) for _ in range(150)] + [5000] + [rng.randint(1, 50) for _ in range(150)],
        "few": [3, 1, 7],
        "ones": [1] * 100,
    }[kind]
    groups = spark.createDataFrame(starts_of(sizes), "start long, size long")
    capacity, cuts = sharding.capacity_and_cuts(groups, 7, marks)
    assert capacity == least_capacity(sizes, 7)
    ends = {a + s for a, s in starts_of(sizes)}
    assert set(cuts) <= ends and cuts == sorted(cuts) and len(cuts) == 6
    parts = parts_of(sizes, cuts)
    assert max(parts) == capacity and (min(parts) > 0 or kind == "few" or marks < 1000)  # few marks: few places to cut
    if kind == "even" and marks > 16:
        assert max(parts) - min(parts) <= 2 * max(sizes)


def check(got, rows, shards):
    """got: (doc_id, size, crc, shard, slot) against rows (doc_id, text)."""
    clean = [(i, t or "") for i, t in rows]
    assert sorted((g[:3] for g in got), key=str) == sorted(((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in clean), key=str)
    slots, totals = defaultdict(list), defaultdict(int)
    for _, size, _, shard, slot in got:
        slots[shard].append(slot)
        totals[shard] += size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(shards))
    groups = defaultdict(int)
    for _, t in clean:
        groups[hashlib.sha256(t.encode()).hexdigest()] += len(t.encode()) + 1
    assert max(totals.values()) == least_capacity([groups[k] for k in sorted(groups)], shards)
    where = defaultdict(set)
    for (_, _, crc, shard, _) in got:
        where[crc].add(shard)
    assert all(len(v) == 1 for v in where.values())


def sharded(spark, rows, shards=16, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return list(map(tuple, sharding.shard_documents(docs, shards, **more).select("doc_id", "_size", "_crc32", "_shard", "_slot").collect()))


def test_documents_with_copies_nulls_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 5)
    rng = random.Random(5)
    rows = [(i, f"text {rng.randint(0, 300)} " * rng.randint(1, 9)) for i in range(500)]
    rows += [(7, "the same row")] * 60 + [(i, "a hot text") for i in range(900, 1100)] + [(None, None)] * 9 + [(None, ""), (3, ""), (None, "x"), (1, "y" * 200_000)]
    got = sharded(spark, rows, marks=64)
    check(got, rows, 16)
    again = sharded(spark, rows[::-1], marks=64)
    assert sorted(got, key=str) == sorted(again, key=str)


def test_few_rows_one_shard_and_none(spark):
    rows = [(1, "a"), (2, "bb"), (3, "a")]
    check(sharded(spark, rows), rows, 16)
    check(sharded(spark, rows, shards=1), rows, 1)
    assert sharded(spark, []) == []
    with pytest.raises(ValueError):
        sharded(spark, rows, shards=0)


def test_other_columns_pass_whatever_their_names(spark):
    docs = spark.createDataFrame([(1, "a", 5, "p"), (2, "b", 6, "q")], "doc_id long, text string, shard int, digest string")
    got = sharding.shard_documents(docs, 2)
    assert got.columns == ["doc_id", "text", "shard", "digest", "_size", "_crc32", "_shard", "_slot"]
    assert sorted(r[:4] for r in got.collect()) == [(1, "a", 5, "p"), (2, "b", 6, "q")]


def test_no_python_on_the_way(spark):
    plan = sharding.shard_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "MapInArrow", "ExistingRDD"))
