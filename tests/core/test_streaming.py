import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from harborlight.operators import alarms, throttle
from harborlight.streaming import alarms as streaming

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture()
def recorded(spark, tmp_path):
    rng = random.Random(4)
    start, rows = dt.datetime(2026, 1, 1), []
    for vessel in (1, 2):
        lat, lon = 42.0, -71.0
        for k in range(60):
            lat, lon = lat + rng.uniform(-0.002, 0.002), lon + rng.uniform(-0.002, 0.002)
            rows.append((vessel, start + dt.timedelta(seconds=40 * k), lat, lon))
    frame = spark.createDataFrame(rows, "vessel long, ts timestamp, lat double, lon double")
    for k in range(3):  # three files, in order of time
        part = frame.where(F.unix_timestamp("ts").between(*(F.unix_timestamp(F.lit(start)) + 800 * (k + e) - (e) for e in (0, 1))))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "fixes"))
    return frame, str(tmp_path)


def run(spark, stream, folder, name):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    if q.exception():
        raise q.exception()
    return spark.table(name).collect()


def source(spark, frame, folder):
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/fixes")


def test_throttle_stream_equals_batch(spark, recorded):
    frame, folder = recorded
    got = run(spark, streaming.throttled_stream(source(spark, frame, folder)), folder, "ticks")
    want = throttle.throttled(frame).collect()
    assert sorted((r.vessel, r.ts) for r in got) == sorted((r.vessel, r.ts) for r in want) and len(want) > 20


def test_alarm_stream_equals_batch(spark, recorded):
    frame, folder = recorded
    places = spark.createDataFrame([(f"h{i}", 42.0 + (i % 5 - 2) * 0.003, -71.0 + (i // 5 - 2) * 0.003) for i in range(25)], "id string, lat double, lon double")
    ticks = alarms.numbered(frame, ["ts"])
    poi = places.withColumn("type", F.lit("Hazard"))
    by_tick = {(r.vessel, r.tick): r.ts for r in ticks.collect()}
    want = {(r.vessel, r.id, by_tick[r.vessel, r.tick], r.event) for r in alarms.proximity(ticks, poi, 300.0).collect()}
    static = places.select("id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    near = streaming.near_stream(source(spark, frame, folder), static, 300.0)
    got = run(spark, streaming.alarm_stream(near, 300.0), folder, "alarms")
    assert {(r.vessel, r.id, r.ts, r.event) for r in got} == want and len(want) > 20
