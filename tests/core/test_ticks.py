"""One tick for all alarms: the same events however fixes fall into batches, equal to the batch operators; failures and repeats."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from harborlight import boxes
from harborlight.operators import alarms, throttle
from harborlight.streaming import ticks as streaming

START = dt.datetime(2026, 1, 1)
FIXES = "vessel long, ts timestamp, lat double, lon double, air_draft double, sog double"
EVENTS = ("contributor", "vessel", "id", "ts", "event", "since", "message")


@pytest.fixture(scope="module")
def recorded(spark):
    rng, rows = random.Random(6), []
    for vessel, lon in ((1, -71.0), (2, 179.999)):
        lat = 42.0
        for k in range(60):
            lat, lon = lat + rng.uniform(-0.002, 0.002), boxes.wrapped(lon + rng.uniform(-0.002, 0.002))
            rows.append((vessel, START + dt.timedelta(seconds=40 * k), lat if k % 11 != 5 else None, lon, rng.choice([None, None, 3.0, 6.0]), 5.0))
    places = [
        (i, f"p{i}", ("Hazard", "Bridge", "Lock")[i % 3], f"n{i}", 42.0 + rng.uniform(-0.012, 0.012), boxes.wrapped(x + rng.uniform(-0.012, 0.012)), float(3 + i % 6))
        for i, x in enumerate([-71.0, 179.999] * 45)
    ]
    return rows, spark.createDataFrame(places, "seq long, id string, type string, name string, lat double, lon double, clearance_m double").cache()


def contributors(spark):
    line = [(42.0, -71.02), (42.0, -70.98)]
    routes = [(1, START + dt.timedelta(minutes=5), [{"lat": a, "lon": b} for a, b in line]), (1, START + dt.timedelta(minutes=25), None)]
    frame = spark.createDataFrame(routes, "vessel long, ts timestamp, points array<struct<lat: double, lon: double>>")
    return [streaming.Proximity(300.0), streaming.Bridges(1.0, 300.0), streaming.RouteAhead(frame, 200.0, 1500.0)]


def events_of(spark, ticks):
    return sorted((tuple(r[c] for c in EVENTS) for r in ticks.events(spark).collect()), key=str)


def run(spark, rows, places, folder, cuts, **more):
    ticks = streaming.Ticks(str(folder), contributors(spark), more.pop("reader", streaming.table_reader(places)), **more)
    bounds = [0, *cuts, len(rows)]
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    for batch, (a, b) in enumerate(zip(bounds, bounds[1:])):
        ticks.step(spark.createDataFrame(ordered[a:b], FIXES), batch)
    return ticks


@pytest.fixture(scope="module")
def told(spark, recorded, tmp_path_factory):
    """The events of all fixes as one batch."""
    return events_of(spark, run(spark, *recorded, tmp_path_factory.mktemp("whole"), []))


def test_batches_do_not_matter_and_equal_the_operators(spark, recorded, told, tmp_path):
    (rows, places), whole = recorded, told
    fixes = alarms.filled_forward(alarms.numbered(spark.createDataFrame(rows, FIXES).where("lat is not null"), ["ts"]), "air_draft")
    went = throttle.throttled(fixes.drop("tick", "stretch"))
    numbered = alarms.numbered(went, ["ts"])
    at = {(r.vessel, r.tick): r.ts for r in numbered.collect()}
    for name, made in (("proximity", alarms.proximity(numbered, places, 300.0)), ("bridges", alarms.bridges(numbered, places, 1.0, 300.0))):
        want = {(r.vessel, r.id, at[r.vessel, r.tick], r.event) for r in made.collect()}
        assert {e[1:5] for e in whole if e[0] == name} == want and len(want) > 5
    route = [e for e in whole if e[0] == "route"]
    assert {e[4] for e in route} == {"raise", "refresh", "clear"} and all(e[1] == 1 for e in route)
    last = max(route, key=lambda e: e[3])
    assert last[4] == "clear" and last[3] >= START + dt.timedelta(minutes=25)  # the route has ended


def test_a_batch_that_runs_again_changes_nothing(spark, recorded, told, tmp_path):
    rows, places = recorded
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    ticks = run(spark, rows, places, tmp_path, [50])
    before = events_of(spark, ticks)
    assert before == told
    ticks.step(spark.createDataFrame(ordered[50:], FIXES), 1)
    assert events_of(spark, ticks) == before and len(before) > 20
    ticks.step(spark.createDataFrame(ordered[:50], FIXES), 2)  # all too late
    ticks.step(spark.createDataFrame([], FIXES), 3)
    assert events_of(spark, ticks) == before


def test_a_failed_read_leaves_alarms_as_they_are(spark, recorded, tmp_path):
    rows, places = recorded
    calls = []

    def reader(asked):
        calls.append(asked)
        if len(calls) == 2:
            raise OSError("offline")
        return streaming.table_reader(places)(asked)

    ticks = run(spark, rows, places, tmp_path, [40, 80], reader=reader)
    assert len(calls) == 3 and spark.read.parquet(f"{tmp_path}/events/batch=1").count() == 0
    state = lambda k: spark.read.parquet(f"{tmp_path}/state/{k}/alarms")
    held = {(e.contributor, e.vessel, e.id): e.event for e in ticks.events(spark).where("batch = 0 and event <> 'refresh'").orderBy("ts").collect()}
    assert {(r.contributor, r.vessel, r.id) for r in state(1).collect()} == {k for k, event in held.items() if event == "raise"} != set()
    assert all(box.north - box.south < 1 for asked in calls for box in asked) and len(calls[0]) == 2
    assert ticks.events(spark).where("batch = 2").count() > 0


def test_a_failing_contributor_keeps_its_alarms_only(spark, recorded, tmp_path, monkeypatch):
    rows, places = recorded
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    ticks = streaming.Ticks(str(tmp_path), contributors(spark), streaming.table_reader(places))
    ticks.step(spark.createDataFrame(ordered[:60], FIXES), 0)
    held = lambda k, name: sorted(r.id for r in spark.read.parquet(f"{tmp_path}/state/{k}/alarms").where(F.col("contributor") == name).collect())
    before = held(0, "bridges")

    def broken(*_):
        raise ValueError("no")

    monkeypatch.setattr(streaming.Bridges, "found", broken)
    ticks.step(spark.createDataFrame(ordered[60:], FIXES), 1)
    assert held(1, "bridges") == before
    told = {r.contributor for r in ticks.events(spark).where("batch = 1").collect()}
    assert "proximity" in told and "bridges" not in told


def test_as_a_stream(spark, recorded, told, tmp_path):
    rows, places = recorded
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    for k in range(2):
        spark.createDataFrame(ordered[k * 60 : k * 60 + 60], FIXES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/fixes")
    stream = spark.readStream.schema(FIXES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/fixes")
    ticks = streaming.Ticks(f"{tmp_path}/out", contributors(spark), streaming.table_reader(places))
    q = streaming.start(stream, ticks, f"{tmp_path}/checkpoint")
    q.awaitTermination(200)
    assert q.exception() is None
    assert events_of(spark, ticks) == told


def test_boxes_hold_their_circles(spark):
    rng = random.Random(1)
    circles = [(rng.choice([42.0, 89.97, -60.0]) + rng.uniform(-0.02, 0.02), boxes.wrapped(180 + rng.uniform(-0.5, 0.5)), 2000.0) for _ in range(40)]
    found = streaming.joined_boxes(spark.createDataFrame(circles, "lat double, lon double, reach_m double"))
    inside = lambda lat, lon, b: b.south <= lat <= b.north and (b.west <= lon <= b.east if b.west <= b.east else lon >= b.west or lon <= b.east)
    for lat, lon, reach in circles:
        for turn in range(0, 360, 30):
            at = boxes.moved(lat, lon, turn, reach * 0.999)
            assert any(inside(*at, b) for b in found)
    assert len(found) <= 8 and streaming.joined_boxes(spark.createDataFrame([], "lat double, lon double, reach_m double")) == []
