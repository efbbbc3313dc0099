import random
import re

from pyspark.sql import functions as F

from harborlight.llm import line_dedup


def distance_is_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    s = 0
    while s < min(len(a), len(b)) - p and a[-1 - s] == b[-1 - s]:
        s += 1
    return p + s >= max(len(a), len(b)) - 1


def brute(docs):
    """docs: (doc_id, text), distinct ids."""
    places = []
    for doc_id, text in docs:
        for n, line in enumerate((text or "").split("\n") if text is not None else []):
            key = re.sub(r"\s+", " ", line).lower().strip(" ")
            if key:
                places.append((doc_id, n, key))
    places.sort(key=lambda x: x[:2])
    first = {}
    for doc_id, n, key in places:
        first.setdefault(key, (doc_id, n))
    near = {k for k, at in first.items() if any(other < at and distance_is_one(k, o) for o, other in first.items())}
    gone = {(d, n) for d, n, k in places if first[k] != (d, n) or k in near}
    return {
        d: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in docs
    }


def edited(line, rng):
    k = rng.randrange(len(line) + 1)
    kind = rng.randrange(3)
    c = rng.choice("abé ")
    return line[:k] + c + line[k:] if kind == 0 else line[:k] + line[k + 1 :] if kind == 1 else line[:k] + c + line[k + 1 :]


def test_against_brute_force(spark):
    rng = random.Random(8)
    pool = ["".join(rng.choice("ab cdé") for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 12, 15, 16, 17, 20, 31, 32, 33, 64, 65, 90]))) for _ in range(25)]
    for _ in range(120):
        pool.append(edited(rng.choice(pool), rng))
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 4)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "\n\n"), (203, "  AB  cd\tab cd ab cd "), (204, "ab cd ab cd ab cd")]
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = line_dedup.drop_repeated_lines(frame).collect()
    want = brute(docs)
    assert {r.doc_id: r.text for r in rows} == want
    assert sum(r.n_dropped for r in rows) > 100


def test_groups_of_many_near_lines(spark):
    docs = [(i, f"the page number {i:04d} of this very long book\nother text {i * 7919} here and {i * 104729}") for i in range(300)]
    rows = line_dedup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in rows} == brute(docs)


def test_names_nulls_and_repeated_rows(spark):
    docs = spark.createDataFrame(
        [(None, "same line of some length", 1), (1, "same line of some length", 2), (5, "x y z", 3), (5, "x y z", 3)],
        "doc_id long, text string, row int",
    ).withColumn("id", F.lit("kept")).withColumn("h1", F.lit(0))
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    texts = sorted((r.doc_id or -1, r.text, r.id) for r in out.collect())
    assert texts == [(-1, "same line of some length", "kept"), (1, "", "kept"), (5, "x y z", "kept"), (5, "x y z", "kept")]
    kept = line_dedup.keep_first_lines(docs)
    assert kept.columns == docs.columns and kept.count() == 3


def test_very_long_lines_and_very_many_lines(spark):
    """A line of 400,000 characters, one edit of it, and a document of 60,000 lines, half of them repeated."""
    rng = random.Random(5)
    line = "".join(rng.choice("abcdé ") for _ in range(400_000))
    many = [f"line number {i * 7919 % 30_000} with {i * 7919 % 30_000 * 31} in it" for i in range(60_000)]
    docs = [(1, line), (2, line[:200_000] + "X" + line[200_001:]), (3, "\n".join(many)), (4, line[:-5] + "other")]
    rows = {r.doc_id: r for r in line_dedup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[1].text == line and rows[2].text == "" and rows[4].n_dropped == 0
    assert rows[3].n_lines == 60_000 and rows[3].n_dropped >= 30_000 and rows[3].text.startswith(many[0])


def test_blocks_are_of_characters(spark):
    base = "".join(chr(0x1F600 + i % 60) if i % 3 else "é" for i in range(100))
    docs = [(1, base), (2, base[:40] + base[41:]), (3, base[:70] + "zz" + base[70:]), (4, "x" + base[1:])]
    rows = line_dedup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in rows} == brute(docs) == {1: base, 2: "", 3: docs[2][1], 4: ""}


def test_an_empty_table(spark):
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
