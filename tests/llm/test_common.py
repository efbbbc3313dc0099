import os

from harborlight.llm import common


def test_stored_tables_are_in_the_shared_folder_and_can_be_cleared(spark):
    df = common.stored(spark.range(5), "numbers")
    folder = common.scratch_dir(spark).removeprefix("file:")
    assert df.count() == 5 and os.listdir(folder) and folder.startswith(common.shared_dir(spark).removeprefix("file:"))
    common.clear_scratch(spark)
    assert not os.path.exists(folder)


def test_runs_of_a_key_stay_whole():
    import pyarrow as pa

    keys = [1, 1, 2, 2, 2, 3, 4, 4, 5, 5, 5, 5, 5, 5]
    batches = [pa.RecordBatch.from_pydict({"k": keys[i : i + 3]}) for i in range(0, len(keys), 3)]
    parts = [t.column("k").to_pylist() for t in common.whole_runs(batches, "k", least_rows=4)]
    assert sum(parts, []) == keys and len(parts) > 1
    assert all(not set(a) & set(b) for a, b in zip(parts, parts[1:]))
    assert list(common.whole_runs([], "k")) == []
