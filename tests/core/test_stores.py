"""Tables along the curve, pages with fingerprints, hulls of many boxes, typed properties and counts in one pass."""

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from harborlight import boxes
from harborlight.boxes import Box
from harborlight.functions import geo
from harborlight.operators import corridor, fingerprints, zorder
from harborlight.sources import common


def key_of(lat, lon):
    row, column = min(65535, int((lat + 90) / 180 * 65536)), min(65535, int((lon + 180) / 360 * 65536))
    return sum(((column >> k & 1) << 2 * k) | ((row >> k & 1) << 2 * k + 1) for k in range(16))


BOXES = [Box(42.0, 42.3, -71.2, -70.9), Box(-5, 5, 178, -178), Box(-90, 90, -180, 180), Box(89.5, 90, 10, 20), Box(3, 3, 4, 4), Box(-1, 1, 180, -180)]


@pytest.mark.parametrize("box", BOXES)
def test_intervals_hold_the_box(box):
    rng = random.Random(1)
    found = zorder.intervals(box)
    assert len(found) <= zorder.INTERVALS and all(a <= b for a, b in found) and all(b[0] > a[1] + 1 for a, b in zip(found, found[1:]))
    for _ in range(300):
        lat, lon = rng.uniform(box.south, box.north), boxes.wrapped(box.west + rng.random() * boxes.span(box.west, box.east))
        assert any(a <= key_of(lat, lon) <= b for a, b in found)
    area = (box.north - box.south) / 180 * boxes.span(box.west, box.east) / 360
    assert sum(b - a + 1 for a, b in found) / 2**32 <= 2.5 * area + 0.001


def test_tables_along_the_curve(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, rng.uniform(-90, 90), rng.choice([rng.uniform(-180, 180), rng.uniform(179, 180), -180.0, 180.0])) for k in range(40_000)]
    frame = spark.createDataFrame(rows + [(-1, None, 0.0), (-2, 95.0, 0.0), (-3, float("nan"), 1.0)], "id long, lat double, lon double")
    keys = frame.select("id", zorder.curve_key(F.col("lat"), F.col("lon")).alias("k")).where("id between 0 and 500").collect()
    assert all(r.k == key_of(*rows[r.id][1:]) for r in keys)
    path = str(tmp_path / "places")
    zorder.write(frame, path, row_group_bytes=16 << 10)
    assert spark.read.parquet(path).count() == 40_000
    for box in BOXES[:2] + [Box(10, 11, 20, 22)]:
        got = zorder.read(spark, path, box)
        found = {r.id for r in got.collect()}
        inside = lambda lat, lon: box.south <= lat <= box.north and (box.west <= lon <= box.east if box.west <= box.east else lon >= box.west or lon <= box.east)
        assert found == {k for k, lat, lon in rows if inside(lat, lon)}
        assert scanned(got) < 12_000, box


def scanned(df):
    """Rows that the scan of a collected frame gave, after row groups were left out."""
    def scans(plan):
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            yield from scans(plan.executedPlan())
        if name.startswith("Scan"):
            yield plan.metrics().apply("numOutputRows").value()
        for k in range(plan.children().size()):
            yield from scans(plan.children().apply(k))

    return sum(scans(df._jdf.queryExecution().executedPlan()))


def test_only_other_pages_are_written(spark, tmp_path):
    path = str(tmp_path / "pages")
    make = lambda rows: spark.createDataFrame(rows, "id long, name string, page string, version long")
    first = [(k, f"n{k}", p, 1) for p in ("a", "b", "c") for k in range(5)] + [(9, None, "a", 1), (9, None, "a", 1)]
    told = lambda df: {r.page: r.change for r in df.collect()}
    assert told(fingerprints.refresh(make(first), path, version="version")) == {"a": "added", "b": "added", "c": "added"}
    held = lambda: sorted((tuple(r) for r in spark.read.parquet(path).select("page", "id", "name", "version").collect()), key=str)
    files = lambda: {f.name for f in (tmp_path / "pages").rglob("*.parquet")}
    before = files()
    assert set(told(fingerprints.refresh(make(first[::-1]).repartition(3), path, version="version")).values()) == {"unchanged"} and files() == before
    once = [r for r in first if r[0] != 9] + [(9, None, "a", 2)]  # one row of two equal ones, at a later version
    older = [(k, "x", "b", 0) for k in range(5)] + [(1, "d", "d", 0)]
    assert told(fingerprints.refresh(make([r for r in once if r[2] == "a"] + older), path, version="version")) == {"a": "changed", "b": "refused", "d": "added"}
    assert held() == sorted([(p, k, n, v) for k, n, p, v in once + [(1, "d", "d", 0)]], key=str)
    assert told(fingerprints.refresh(make([]), path)) == {}


def test_nulls_in_other_columns_are_other_pages(spark):
    frame = spark.createDataFrame([("a", None, 1), ("b", 1, None)], "page string, x int, y int")
    one, two = fingerprints.fingerprints(frame).collect()
    assert (one["_one"], one["_two"]) != (two["_one"], two["_two"])


def test_hulls_equal_the_fold(spark):
    rng = random.Random(7)
    some = lambda: Box(*sorted((rng.uniform(-90, 90), rng.uniform(-90, 90))), boxes.wrapped(x := rng.choice([170.0, -180.0, 180.0, 0.0, -75.0]) + rng.choice([0, 0, 7.5])), boxes.wrapped(x + rng.choice([0.0, 10.0, 100.0, 200.0])))
    rows = [(k, [dataclasses.astuple(some()) for _ in range(rng.randint(1, 5))]) for k in range(300)]
    rows += [(1000, []), (1001, [(0.0, 1.0, float("nan"), 2.0)] * 2), (1002, [(0.0, 1.0, None, 2.0)] * 2)]
    frame = spark.createDataFrame(rows, "k int, boxes array<struct<south: double, north: double, west: double, east: double>>")
    got = {r.k: r.hull for r in frame.select("k", geo.boxes_hull(F.col("boxes")).alias("hull")).collect()}
    for k, parts in rows[:300]:
        want = Box(*parts[0])
        for part in parts[1:]:
            want = boxes.hull(want, Box(*part))
        assert tuple(got[k]) == pytest.approx(dataclasses.astuple(want)), (k, parts)
    assert got[1000] is got[1001] is got[1002] is None


def test_fetch_boxes_of_many_routes(spark):
    rng = random.Random(5)
    routes = {f"r{k}": [(rng.uniform(-60, 60), boxes.wrapped(179.9 + rng.uniform(-0.3, 0.3)))] for k in range(40)}
    for points in routes.values():
        for _ in range(rng.randint(0, 6)):
            step = rng.choice([0.0, 0.02, 0.2])
            points.append((points[-1][0] + rng.uniform(-step, step), boxes.wrapped(points[-1][1] + rng.uniform(-step, step))))
    frame = spark.createDataFrame([(r, k, *p) for r, points in routes.items() for k, p in enumerate(points)] + [("bad", 0, None, 1.0)], "route_id string, seq int, lat double, lon double")
    got = {r.route_id: r.box for r in corridor.fetch_boxes(frame, 500.0, 20_000.0).collect()}
    for name, points in routes.items():
        assert tuple(got[name]) == pytest.approx(dataclasses.astuple(boxes.along_route(points, 500.0, 20_000.0)), abs=1e-7)
    assert got["bad"] is None


def test_rows_are_counted_as_they_pass(spark):
    jobs = spark.sparkContext.statusTracker()
    raw = spark.range(1000)
    spark.sparkContext.setJobGroup("counted", "")
    made, told = common.counted(raw, lambda df: df.where("id % 4 <> 0"))
    assert len(made.collect()) == 750 and told() == {"rows": 1000, "rejected": 250}
    assert len(jobs.getJobIdsForGroup("counted")) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_properties_by_type(spark):
    from harborlight.operators import detail

    note = '{"properties": {"a.b": {"it\'s": 7, "x y": 2.5, "z": null, "o": {}, "l": [1, "two"]}, "a": {"b": "other"}}, "t": true}'
    row = spark.createDataFrame([(note,), ("no json",), (None,)], "note string").select(detail.parsed(F.col("note")).alias("v"))
    typed = lambda kind, *names: [r[0] for r in row.select(detail.typed_property(F.col("v"), list(names), kind)).collect()]
    kinds = lambda *names: row.select(detail.property_kind(F.col("v"), list(names))).first()[0]
    assert typed("long", "properties", "a.b", "it's") == [7, None, None] and typed("string", "properties", "a", "b")[0] == "other"
    assert typed("double", "properties", "a.b", "x y")[0] == 2.5 and typed("string", "properties", "a.b", "l", 1)[0] == "two" and typed("boolean", "t")[0] is True
    assert typed("long", "t")[0] in (1, None) and typed("long", "properties")[0] is None
    assert [kinds("properties", "a.b", x) for x in ("it's", "x y", "z", "o", "l", "none")] == ["BIGINT", "DECIMAL", "null", "OBJECT", "ARRAY", None]
