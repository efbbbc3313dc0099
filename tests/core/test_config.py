from harborlight import config
from harborlight.operators import course


def test_bounds():
    got = config.normalised({"alarm_radius_m": 5e6, "minimum_year": 1800.9, "minimum_rating": "4", "dedupe_radius_m": float("nan"), "clearance_margin_m": -3, "x": 1})
    assert got["alarm_radius_m"] == 100_000 and got["minimum_year"] == 1900 and got["minimum_rating"] == 0
    assert got["dedupe_radius_m"] == 45.72 and got["clearance_margin_m"] == 0 and "x" not in got
    assert config.normalised({"minimum_year": 0.5})["minimum_year"] == 0


def test_newest_route_version(spark):
    rows = [(1, 1, "a"), (1, 3, None), (1, 2, "b"), (2, 1, "c"), (2, 2, "d")]
    got = course.latest_route(spark.createDataFrame(rows, "vessel long, version long, route_id string"))
    assert [(r.vessel, r.route_id, r.version) for r in got.collect()] == [(2, "d", 2)]


def test_checkpoints_are_cleared_with_the_scratch_folder(spark):
    import os

    from harborlight import folders

    folder = folders.shared_dir(spark).removeprefix("file:")
    there = lambda: {f"{d}/{x}" for d, names, _ in os.walk(folder) for x in names if x.startswith("rdd-")}
    folders.clear_scratch(spark)
    before = there()
    df = folders.checkpointed(spark.range(10))
    assert df.count() == 10 and len(there() - before) == 1
    folders.clear_scratch(spark)
    assert there() == before
