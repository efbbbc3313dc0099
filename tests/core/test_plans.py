import datetime as dt

import pytest

from harborlight import boxes, testbed
from harborlight.plans import queries, text_queries  # noqa: F401  (registers its queries)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small tables of the driver's form."""
    folder = str(tmp_path_factory.mktemp("tables"))
    start = dt.datetime(2024, 1, 1)
    for name, key, n in (("part", "p_partkey", 700), ("customer", "c_custkey", 200), ("supplier", "s_suppkey", 30)):
        spark.createDataFrame([(k,) for k in range(1, n + 1)], f"{key} long").write.parquet(f"{folder}/{name}.parquet")
    events = [(k, k * 7 % 40, start + dt.timedelta(seconds=k), float(k % 50)) for k in range(1, 201)]
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp, value double").write.parquet(f"{folder}/events.parquet")
    return folder


def test_proximity_pairs_of_all_fixes(spark, tables):
    fixes = [(r.event_id, r.lat, r.lon) for r in testbed.fixes(spark, tables).collect()]
    hazards = [(r.id, r.lat, r.lon) for r in testbed.poi(spark, tables).where("type = 'Hazard'").collect()]
    apart = {(f[0], h[0]): boxes.distance(f[1:], h[1:]) for f in fixes for h in hazards}
    want = {pair for pair, d in apart.items() if d <= 500}
    rows = queries.QUERIES["proximity_in_range"](spark, tables).collect()
    got = {(r.event_id, r.id): r.dm for r in rows}
    assert len(rows) == len(got) and set(got) == want
    assert all(abs(dm - apart[pair] * 10) < 0.51 for pair, dm in got.items())
    assert len({event for event, _ in want if event % 20}) > 150


def test_route_messages_use_clearances_of_details(spark, tables):
    told = {r.id: r.message for r in queries.QUERIES["route_messages"](spark, tables).collect()}
    places = {r.id: r for r in testbed.poi(spark, tables).collect() if r.id in told}
    clause, from_details = " m is at or below your air draft 8.5 m (+1 m margin)", 0
    for i, message in told.items():
        p = places[i]
        clearance = p.clearance_m
        if clearance is None and p.type == "Bridge" and p.source == "activecaptain":
            clearance = p.seq % 97 / 10
            from_details += clearance <= 9.5
        if p.type == "Bridge" and clearance is not None and clearance <= 9.5:
            assert message.endswith(f": clearance {clearance:g}{clause}")
        else:
            assert clause not in message
    assert from_details > 3 and any(p.type == "Bridge" and p.clearance_m is None and p.source != "activecaptain" for p in places.values())
