import datetime as dt

from sessionloom.operators import folds

EVENTS = "session_id string, turn int, pos int, family string, path string, query string, command string, raw string, recorded_at timestamp"


def test_cache_with_expiry(spark):
    at = lambda m: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)
    rows = [("s", t, 0, "file_read", "a", None, None, raw, at(m)) for t, m, raw in [(1, 0, "x"), (2, 20, "x"), (3, 45, "x"), (4, 50, "y"), (5, 51, "x"), (6, 90, "x"), (7, 91, None)]]
    rows += [("s", t, 0, "command", None, None, "git log", raw, at(t)) for t, raw in [(11, "x"), (12, "y"), (13, "y")]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = [(r.turn, r.outcome) for r in folds.cache_outcomes(spark.createDataFrame(rows, EVENTS)).orderBy("turn").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(1, "stored"), (2, "unchanged"), (3, "unchanged"), (4, "changed"), (5, "unchanged"), (6, "expired"), (11, "stored"), (12, "changed"), (13, "unchanged")]
    assert folds.cache_outcomes(spark.createDataFrame([], EVENTS)).isEmpty()


def test_cooldown(spark):
    df = spark.createDataFrame([("s", "h", t) for t in (1, 2, 4, 5, 6, 9)] + [("s", "i", 2), (None, None, 3), ("s", "h", None)], "session_id string, hint string, turn int")
    got = sorted((r.hint or "", r.turn or 0, r.given) for r in folds.cooled(df).collect())
    assert got == [("", 3, True), ("h", 0, False), ("h", 1, True), ("h", 2, False), ("h", 4, False), ("h", 5, True), ("h", 6, False), ("h", 9, True), ("i", 2, True)]
