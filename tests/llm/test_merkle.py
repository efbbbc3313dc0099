"""The manifest against the rules in plain Python."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from harborlight.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def way(levels, at):
    for nodes in levels[:-1]:
        run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
        yield run[: at % 8], run[at % 8 + 1 :]
        at //= 8


def by_hand(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    for rows in trees.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
    built = {k: levels_of([leaf_of(*r) for r in trees[k]]) for k in order}
    top = levels_of([built[k][-1][0] for k in order])
    out = []
    for i, k in enumerate(order):
        for j, row in enumerate(trees[k]):
            steps = [*way(built[k], j), *way(top, i)]
            doc_id, text = row[:2]
            changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None
            small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if changed else text
            folded = leaf_of(doc_id, small, *row[2:])
            for left, right in steps:
                folded = h(*left, folded, *right)
            root = top[-1][0]
            siblings = [x for left, right in steps for x in left + right]
            out.append((doc_id, leaf_of(*row), built[k][-1][0], root, h(*siblings), folded, folded == root))
    return sorted(out, key=str)


def found(spark, tmp_path, rows, schema=SCHEMA):
    path = str(tmp_path / f"t{len(rows)}")
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    return sorted(map(tuple, merkle.op12_merkle_manifest(spark, path).collect()), key=str)


def test_trees_of_all_depths(spark, tmp_path):
    rng = random.Random(3)
    sizes = {"en": 1300, "de": 513, "fr": 512, "es": 65, "Ünï": 8, "": 9, None: 7, "xx": 1}
    sizes |= {f"z{i}": 1 for i in range(6)}
    rows = [(i, f"Text {rng.random()} É", k, rng.choice(["a", None, ""]), rng.choice([i, None])) for k, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    assert found(spark, tmp_path, rows) == by_hand(rows)


def test_more_levels_than_two_rounds_hold(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 8)
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "_LEVELS", merkle._LEVELS.replace("sequence(1, 3)", "sequence(1, 1)"))
    monkeypatch.setattr(merkle, "_SIBLINGS", merkle._SIBLINGS.replace("sequence(0, 2)", "sequence(0, 0)"))
    rows = [(i, f"Word {i}", "en" if i % 3 else None, "s", 5) for i in range(700)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), F.lower("text"), F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(rows)


def test_nulls_repeated_rows_one_row_and_long_texts(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "", "en", "", 0), (5, "A" * 3_000_000, "en", "s", 1), (5, "b", "en", "s", 1), (5, "b", "en", "s", 1), (-3, "Q", "de", "s", 2)]
    assert found(spark, tmp_path, rows) == by_hand(rows)
    rows = [(9, "Alone", "en", "s", 5)]
    (one,) = found(spark, tmp_path, rows)
    assert [one] == by_hand(rows) and one[1] == one[2] == one[3]


def test_empty_table_and_other_columns(spark, tmp_path):
    assert found(spark, tmp_path, []) == []
    rows = [(1, "Aa", "en", "s", 2), (2, "Bb", "en", "s", 2)]
    extra = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", leaf int, tree int, root int")
    got = merkle.manifest(extra, F.lower("text"), F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(rows)


def test_a_changed_row_is_found(spark):
    docs = spark.createDataFrame([(i, f"Word {i}", "en", "s", 6) for i in range(50)], SCHEMA)
    got = merkle.manifest(docs, F.concat("text", F.lit("!")), F.col("doc_id") == 17).where("not verified").select("doc_id").collect()
    assert [r[0] for r in got] == [17]
