"""Streams of several micro-batches against the batch forms."""

import pytest
from conftest import DATA

from sessionloom.operators import memory
from sessionloom.session import shared_folder
from sessionloom.streaming import windows


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The table events in three files, in the order of time."""
    folder = tmp_path_factory.mktemp("parts")
    e = spark.read.parquet(f"{DATA}/events.parquet")
    for i in range(3):
        e.filter(f"event_id % 3 = {i}").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    e.filter("event_id < 100").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")  # delivered again
    return str(folder)


def test_complete_windows_of_several_batches(spark, parts, rows):
    got = windows.drained(windows.tumbling(windows.events(spark, parts, 1)), "complete")
    every = spark.read.parquet(f"{parts}/events.parquet")
    assert got.agg({"n": "sum"}).first()[0] == every.count()
    assert got.select("start", "event_type").distinct().count() == got.count()


def test_each_event_once_over_batches(spark, parts):
    got = windows.drained(windows.deduplicated(windows.events(spark, parts, 1), "event_id", late="3650 days").select("event_id"))
    assert got.count() == got.distinct().count() == spark.read.parquet(f"{DATA}/events.parquet").count() < spark.read.parquet(f"{parts}/events.parquet").count()


def test_memory_of_late_turns(spark, tmp_path, rows):
    schema = "session_id string, turn int, value string"
    data = [("s", t, v) for t, v in ((1, "a"), (2, "b"), (3, "a"), (4, None), (5, "a"), (6, "c"), (9, "a"))] + [("t", 1, "x"), ("t", 2, None)]
    for part in (data[::3], data[1::3], data[2::3]):  # turns come back to front between the files
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "v"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "v"))
    got = windows.drained(memory.stream(stream), "update", ["session_id"])
    assert rows(got) == rows(memory.remembered(spark.createDataFrame(data, schema))) != []
    with pytest.raises(ValueError):
        windows.drained(stream, "update")
    (tmp_path / "none").mkdir()
    empty = spark.readStream.schema(schema).parquet(str(tmp_path / "none"))
    assert windows.drained(empty).isEmpty() and windows.drained(memory.stream(empty), "update", ["session_id"]).isEmpty()


def test_no_local_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda name, default=None: default)})

    with pytest.raises(RuntimeError):
        shared_folder(Session())
