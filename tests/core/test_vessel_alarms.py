"""Alarms from two inputs as a stream, against the batch operators on the same rows; expiry by timers."""

import datetime as dt
import random

from pyspark.sql import functions as F

from harborlight.operators import alarms
from harborlight.streaming import alarms as streaming
from tests.core.test_streaming import run

START = dt.datetime(2026, 1, 1)


def landed(spark, rows, folder, files=3):
    """rows in order of time, in so many files; those of one time are in one."""
    times = sorted({r[1] for r in rows})
    size = -(-len(times) // files)
    for k in range(files):
        mine = set(times[k * size : (k + 1) * size])
        part = spark.createDataFrame([r for r in rows if r[1] in mine], streaming.ROWS)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/rows")
    return spark.readStream.schema(streaming.ROWS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/rows")


def in_order(df):
    """As rows to be written; of one vessel and time drafts and versions come first."""
    return [tuple(r) for r in sorted(df.collect(), key=lambda r: (r.ts, r.kind in ("near", "told")))]


def test_bridges_equal_batch(spark, tmp_path):
    rng, fixes, drafts = random.Random(4), [], []
    for vessel in (1, 2):
        lat, lon = 42.0, -71.0
        for k in range(70):
            lat, lon = lat + rng.uniform(-0.002, 0.002), lon + rng.uniform(-0.002, 0.002)
            fixes.append((vessel, START + dt.timedelta(seconds=40 * k), lat, lon))
            if k % 9 == 4:
                drafts.append((vessel, START + dt.timedelta(seconds=40 * k - rng.choice([0, 20])), rng.choice([3.0, 6.0, 9.0])))
    fixes = spark.createDataFrame(fixes, "vessel long, ts timestamp, lat double, lon double")
    drafts = spark.createDataFrame(drafts, "vessel long, ts timestamp, value double")
    bridges = spark.createDataFrame(
        [(f"b{i}", 42.0 + (i % 5 - 2) * 0.003, -71.0 + (i // 5 - 2) * 0.003, float(3 + i % 6)) for i in range(25)], "id string, lat double, lon double, clearance_m double"
    )
    ticks = alarms.numbered(alarms.as_of(fixes, drafts, ["value"]).withColumnRenamed("last_value", "air_draft"), ["ts"])
    by_tick = {(r.vessel, r.tick): r.ts for r in ticks.collect()}
    want = {(r.vessel, r.id, by_tick[r.vessel, r.tick], r.event) for r in alarms.bridges(ticks, bridges.withColumn("type", F.lit("Bridge")), 1.0, 300.0).collect()}
    put = bridges.select("id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), "clearance_m")
    near = streaming.near_stream(fixes, put, 300.0, ("clearance_m",))
    both = streaming.rows_of("near", near).union(streaming.rows_of("draft", drafts))
    got = run(spark, streaming.vessel_alarm_stream(landed(spark, in_order(both), tmp_path), 300.0, 1.0), str(tmp_path), "bridge_alarms")
    assert {(r.vessel, r.id, r.ts, r.event) for r in got} == want and len(want) > 20


def test_route_messages_equal_batch_and_a_null_version_clears(spark, tmp_path):
    rng = random.Random(8)
    at = lambda k: START + dt.timedelta(seconds=60 * k)
    messages = [(v, k, f"p{i}", rng.choice(["near", "nearer"])) for v in (1, 2) for k in range(1, 40) for i in range(6) if rng.random() < 0.7]
    changes = alarms.message_changes(spark.createDataFrame(messages, "vessel long, tick int, id string, message string"))
    want = {(r.vessel, r.id, at(r.tick), r.message) for r in changes.collect()}
    told = spark.createDataFrame([(v, at(k), i, m) for v, k, i, m in messages] + [(v, at(k), None, None) for v in (1, 2) for k in range(1, 40)], "vessel long, ts timestamp, id string, message string")
    versions = spark.createDataFrame([(1, at(0), "r"), (2, at(0), "r"), (1, at(39) + dt.timedelta(seconds=5), None)], "vessel long, ts timestamp, version string")
    both = streaming.rows_of("told", told).union(streaming.rows_of("version", versions))
    got = run(spark, streaming.vessel_alarm_stream(landed(spark, in_order(both), tmp_path)), str(tmp_path), "route_alarms")
    assert {(r.vessel, r.id, r.ts, r.message) for r in got if r.event != "clear"} == want and len(want) > 60
    gone = {(r.vessel, r.id) for r in got if r.event == "clear" and r.ts == at(39) + dt.timedelta(seconds=5)}
    assert gone == {(1, i) for v, k, i, _ in messages if v == 1 and k == 39} != set()


def test_nothing_without_a_draft_or_a_version(spark, tmp_path):
    rows = [(1, START, "near", "b", 10.0, 1.0, None, None, None), (1, START, "told", "p", None, None, "m", None, None)]
    assert run(spark, streaming.vessel_alarm_stream(landed(spark, rows, tmp_path, 1)), str(tmp_path), "nothing") == []


def test_state_expires(spark, tmp_path):
    hour = dt.timedelta(hours=1)
    rows = [(1, START, "draft", None, None, None, None, 5.0, None), (1, START, "near", "b", 10.0, 1.0, None, None, None)]
    rows += [(2, START + 3 * hour, "draft", None, None, None, None, 5.0, None), (2, START + 6 * hour, "draft", None, None, None, None, 5.0, None)]
    rows += [(1, START + 7 * hour, "near", "b", 10.0, 1.0, None, None, None), (2, START + 7 * hour, "near", "b", 10.0, 1.0, None, None, None)]
    got = run(spark, streaming.vessel_alarm_stream(landed(spark, rows, tmp_path), expire_s=3600), str(tmp_path), "expiring")
    assert sorted((r.vessel, r.ts, r.event) for r in got) == [(1, START, "raise"), (1, START + hour, "clear"), (2, START + 7 * hour, "raise")]
