import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from harborlight.streaming import notifications

AT = dt.datetime(2026, 1, 1)
EVENTS = "vessel long, id string, ts timestamp, event string, since timestamp, message string"
ROWS = [(1, f"p {k}" if k % 2 else f"p{k}", AT + dt.timedelta(seconds=k), ("raise", "refresh", "clear")[k % 3], AT, f"m{k}") for k in range(12)]


def shown(spark, folder):
    return sorted(map(tuple, notifications.read(spark, str(folder)).collect()), key=str)


def test_rows_of_notifications(spark):
    got = {r.message: r for r in notifications.notifications(spark.createDataFrame(ROWS, EVENTS), "notifications.hazards", cleared_message=F.concat(F.col("id"), F.lit(" is passed"))).collect()}
    assert got["m0"].path == "notifications.hazards.p0" and got["m1"].path.startswith("notifications.hazards.escaped.")
    assert got["m0"].state == got["m1"].state == "alert" and got["p2 is passed"].state == "normal" and all(r.since == AT for r in got.values())


def test_batches_are_written_once(spark, tmp_path):
    notifications.register(spark)
    rows = notifications.notifications(spark.createDataFrame(ROWS, EVENTS).repartition(3), "n")
    assert shown(spark, tmp_path) == []
    for batch in ("1", "1", "2"):
        rows.write.format("notification_folder").mode("append").option("batch", batch).save(str(tmp_path))
    got = shown(spark, tmp_path)
    assert [r[0] for r in got] == ["1"] * 12 + ["2"] * 12 and [r[1:] for r in got[:12]] == sorted(map(tuple, rows.collect()), key=str)
    rows.limit(0).write.format("notification_folder").mode("append").save(str(tmp_path))
    assert shown(spark, tmp_path) == got


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    notifications.register(spark)

    def broken(text):
        if text == "m7":
            raise ValueError("no")
        return text

    rows = notifications.notifications(spark.createDataFrame(ROWS, EVENTS).repartition(4), "n")
    with pytest.raises(Exception, match="no"):
        rows.withColumn("message", F.udf(broken, StringType())("message")).write.format("notification_folder").mode("append").option("batch", "1").save(str(tmp_path))
    assert shown(spark, tmp_path) == []
    rows.write.format("notification_folder").mode("append").option("batch", "1").save(str(tmp_path))
    assert len(shown(spark, tmp_path)) == 12


def test_a_repeated_batch_of_a_stream_adds_none(tmp_path):
    writer = notifications.StreamWriter(str(tmp_path), ["vessel", "ts"])
    first = [writer.write(iter([("1", AT)])), writer.write(iter([]))]
    writer.commit(first, 3)
    writer.commit([writer.write(iter([("1", AT)]))], 3)  # the query restarted before it knew
    assert len(list((tmp_path / "data").iterdir())) == 2 and len(list((tmp_path / "commits").iterdir())) == 1


def test_stream(spark, tmp_path):
    notifications.register(spark)
    for k in range(2):
        spark.createDataFrame(ROWS[k * 6 : k * 6 + 6], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    for _ in range(2):  # started again, it has nothing new to tell
        q = notifications.notifications(stream, "n").writeStream.format("notification_folder").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination(120)
        assert q.exception() is None
    got = shown(spark, tmp_path / "out")
    assert {r[0] for r in got} == {"0", "1"} and sorted(r[4] for r in got) == sorted(r[5] for r in ROWS)
