"""Alarms and pairs as they come from blocks: rows by place, parts, steps and windows, against loops over all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from harborlight import boxes
from harborlight.operators import alarms
from tests.core.test_operators import METRE, _dense, machine


@pytest.fixture
def from_python(monkeypatch):
    """Frames that mapInArrow gave, in order."""
    from pyspark.sql.classic.dataframe import DataFrame

    frames, real = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda *args: frames.append(real(*args)) or frames[-1])
    return frames


@pytest.mark.parametrize("of", ["episodes", "transitions"])
def test_runs_come_from_python_by_place(spark, from_python, of):
    """A row for each place, however many runs it has."""
    found = getattr(alarms, of)(*_dense(spark, 1000, 300), 500.0)
    assert found.count() == 300 * (500 if of == "episodes" else 999)  # the last run still holds
    assert sum(df.count() for df in from_python) <= 2 * 300


def test_long_runs_over_stretches_equal_the_state_machine(spark, monkeypatch):
    """Runs longer than the window that is looked at first, and than a stretch."""
    monkeypatch.setattr(alarms, "STRETCH", 40)
    monkeypatch.setattr(alarms, "WINDOW", 2)
    rng = random.Random(6)
    walk, here = [], 0.0
    for _ in range(400):
        here += rng.uniform(-130, 130) - here / 60
        walk.append((42 + here * METRE, -71.0, rng.choice([5.0] * 30 + [1.0])))
    places = [(f"h{k}", 42 + rng.uniform(-1500, 1500) * METRE, -71.0, rng.choice([2.0, 4.0, 6.0])) for k in range(40)]
    ticks = spark.createDataFrame([(1, k, *at) for k, at in enumerate(walk, 1)], "vessel long, tick int, lat double, lon double, air_draft double")
    put = spark.createDataFrame(places, "id string, p_lat double, p_lon double, clearance_m double")
    for margin in (None, 1.5):
        want = {(i, *turn) for i, lat, lon, c in places for turn in machine([boxes.distance(at[:2], (lat, lon)) if margin is None or c <= at[2] + margin else None for at in walk], 500)}
        got = [(r.id, r.tick, r.event) for r in alarms.transitions(ticks, put, 500.0, margin).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 60


@pytest.mark.parametrize("margin", [None, 1.0])
def test_parts_of_blocks_and_steps_equal_all_pairs(monkeypatch, margin):
    """Parts of a few places and steps of a few pairs, with positions and levels that are NaN; places at exactly the radius and next to it."""
    monkeypatch.setattr(alarms, "PART", 5)
    monkeypatch.setattr(alarms, "PAIRS", 64)
    rng = np.random.default_rng(5)
    tick = np.flatnonzero(rng.random(400) < 0.7)
    at = {"tick": tick, "lat": 42 + rng.uniform(-0.01, 0.01, len(tick)), "lon": -71 + rng.uniform(-0.012, 0.012, len(tick)), "level": rng.choice([1.0, 4.0, np.nan], len(tick))}
    there = {"p_lat": 42 + rng.uniform(-0.01, 0.01, 70), "p_lon": -71 + rng.uniform(-0.012, 0.012, 70), "level": rng.choice([0.0, 3.0, 5.0, 9.0, np.nan], 70)}
    at["lat"][::9] = np.nan
    there["p_lat"][3] = np.nan
    there["p_lat"][20:40] = at["lat"][1] + 500 * METRE * (1 + np.arange(-10, 10) * 1e-9)
    there["p_lon"][20:40] = at["lon"][1]
    ticks, places = (pa.StructArray.from_arrays([pa.array(x) for x in of.values()], names=list(of)) for of in (at, there))
    apart = alarms.Distances(there["p_lat"], there["p_lon"], at["lat"], at["lon"])
    metres = np.array([apart.exact(np.full(len(tick), k), np.arange(len(tick))) for k in range(70)])
    runs = alarms.Runs(500.0, 600.0, margin)
    held = runs.ticks(0, 0, ticks)
    spots, low, sound = runs.places(places, held[2])
    got = sorted(tuple(int(x) for x in run) for some in runs.of(held, spots, low, np.flatnonzero(sound)) for run in zip(*some))
    want = []
    for k in range(70):
        holds = (metres[k] <= 600) & (True if margin is None else there["level"][k] <= at["level"] + margin)
        starts = [n for n in np.flatnonzero(holds) if n == 0 or not holds[n - 1] or tick[n - 1] != tick[n] - 1]
        for n in starts:
            end = n
            while end + 1 < len(tick) and holds[end + 1] and tick[end + 1] == tick[end] + 1:
                end += 1
            close = np.flatnonzero(metres[k][n : end + 1] <= 500)
            want.append((k, int(tick[n]), int(tick[end]), int(tick[n + close[0]]) if len(close) else -1))
    assert got == sorted(want) and len(want) > 300


def test_pairs_come_from_python_by_place(spark, from_python):
    track, put = _dense(spark, 4000, 50)
    near = alarms.within(track, put, 500.0, ["tick"])
    assert near.columns == ["tick", "id", "p_lat", "p_lon", "distance_m"] and near.count() == 2000 * 50
    assert from_python[-1].count() <= 50 * alarms.DEALS


def test_distances_of_pairs_equal_the_haversine():
    rng = np.random.default_rng(7)
    for centre, spread in ((42.0, 0.005), (42.0, 0.5), (89.9, 0.09), (0.0, 90.0)):
        lat, lon, o_lat, o_lon = (c + rng.uniform(-spread, spread, 500) for c in (centre, 179.0, centre, 179.0))
        apart = alarms.Distances(lat, lon, o_lat, o_lon)
        here, there = (alarms.Points(pa.StructArray.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]), "a", "b") for a, b in ((lat, lon), (o_lat, o_lon)))
        every = np.arange(500)
        assert np.abs(here.metres(every, there, every) - apart.exact(every, every)).max() < 1e-7
