import pandas as pd
from conftest import DATA

from sessionloom.operators import codecs, memory
from sessionloom.plans import texts
from sessionloom.streaming import windows


def test_fold_by_hand():
    hot, durable = {}, {}
    memory.fold(hot, durable, [(1, ["a", "b", "a"]), (2, ["a"]), (3, ["a"]), (9, [])])
    assert hot == {"a": [5, 3]} and durable == {"a": [6, 3]}
    memory.fold(hot, durable, [(t, [f"v{t}{i:02}" for i in range(50)]) for t in (10,)])
    assert len(hot) == memory.CAP


def test_batch_and_stream_agree(spark, rows):
    assert rows(texts.memory_decay(spark, DATA)) == rows(texts.stream_memory(spark, DATA)) != []


def test_memory_with_nulls_and_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        data = [("s", 3, "a"), ("s", 1, "a"), ("s", 2, "b"), ("t", 1, None), (None, 1, "x"), ("u", None, "x")]
        got = {(r.session_id, r.value): r.score for r in memory.remembered(spark.createDataFrame(data, "session_id string, turn int, value string")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {("s", "a"): 3, ("s", "b"): 1}
    assert memory.remembered(spark.createDataFrame([], "session_id string, turn int, value string")).isEmpty()


def test_stream_windows(spark):
    stream = windows.events(spark, DATA)
    total = spark.read.parquet(f"{DATA}/events.parquet").count()
    closed = windows.drained(windows.tumbling(stream))
    assert 0 < closed.agg({"n": "sum"}).first()[0] <= total
    sessions = windows.drained(windows.sessions(windows.events(spark, DATA)))
    assert sessions.filter("`end` <= start").isEmpty() and 0 < sessions.agg({"n": "sum"}).first()[0] <= total


def test_codecs_are_never_longer_and_keep_what_matters():
    cases = {
        "search": "\n".join(f"src/a{i % 2}.py:{i}: value = {i}" + "x" * 90 for i in range(60)),
        "diff": "diff --git a/x b/x\n@@ -1,3 +1,3 @@\n context line that stays\n-old\n+new\n other context",
        "test_report": "tests/a.py::t1 PASSED\ntests/a.py::t2 FAILED\nE   assert 1 == 2\n" + "tests/a.py::t PASSED\n" * 40 + "== 41 passed, 1 failed ==",
        "log": "".join(f"2026-01-01T00:00:{i:02}Z INFO step {i}\n" for i in range(50)) + "2026-01-01T00:01:00Z ERROR broken",
        "listing": "".join(f"-rw-r--r-- me us {i} dir/file{i}.py\n" for i in range(40)),
        "json": '{"a": [' + ",".join(map(str, range(100))) + '], "b": "' + "x" * 500 + '"}',
        "traceback": 'Traceback (most recent call last):\n  File "/usr/lib/python3/x.py", line 1\n    hidden()\n  File "own.py", line 2\n    shown()\nValueError: no',
        "code": "def f(a):\n" + "    x = 1\n" * 30 + "class G:\n    pass",
        "text": "same start of line 1\n" + "".join(f"same start of line {i}\n" for i in range(9)) + "other",
    }
    assert set(cases) == set(codecs.REGISTRY)
    for kind, text in cases.items():
        short = codecs.compress(text, kind)
        assert len(short) < len(text), kind
        assert codecs.compress("", kind) == "" and codecs.compress(None, kind) is None and len(codecs.compress("x", kind)) <= 1
    assert "assert 1 == 2" in codecs.compress(cases["test_report"], "test_report") and "ERROR broken" in codecs.compress(cases["log"], "log")
    assert "hidden" not in codecs.compress(cases["traceback"], "traceback") and "shown" in codecs.compress(cases["traceback"], "traceback")
    long = "line\n" * 1000
    assert codecs.truncate(long).startswith("line\n") and len(codecs.truncate(long)) < 1400 and codecs.truncate("x" * 1800) == "x" * 1800


def test_unified_diff():
    got = codecs.unified.func(pd.Series(["a\nb", None]), pd.Series(["a\nc", "x"]))
    assert "-b" in got[0] and "+c" in got[0] and got[1] is None
