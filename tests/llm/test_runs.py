import datetime as dt
import random

from sessionloom.llm import runs

TURNS = "session_id string, turn_index int, workspace_root string, recorded_at timestamp, tool_uses array<struct<type: string, id: string, name: string, input: map<string,string>>>, value string, part string"
START = dt.datetime(2026, 1, 1)


def turn(session, index, *uses, root="/w"):
    at = START + dt.timedelta(seconds=index) if index is not None else None
    return session, index, root, at, [u and ("tool_use", "i", u[0], u[1]) for u in uses], "clash", "clash"


def families(spark):
    return spark.createDataFrame([("read_file", "read"), ("view_file", "read"), ("edit", "edit"), (None, "x")], "tool_name string, family string")


def spans(df):
    return sorted((r.session_id, r.first_turn, r.first_pos, r.last_turn, r.last_pos, r.n_uses, r.seconds) for r in df.collect())


def test_spellings_breaks_and_duration(spark):
    p = lambda x: {"path": x}
    rows = [
        turn("s", 1, ("read_file", p("a/b.py")), ("ViewFile", p("./a//b.py ")), ("READ-FILE", p("file:///w/a/x/../b.py"))),
        turn("s", 4), turn("s", 9, ("view_file", {"file_path": "a\\b.py"})), turn("s", 9, ("view_file", {"file_path": "a\\b.py"})),
        turn("s", 10, ("edit", p("a/b.py")), (None, p("a/b.py")), ("edit", p("a/b.py")), ("edit", p(" ")), ("edit", p("a/b.py")), None, ("edit", p("a/b.py"))),
        turn("s", 11, ("edit", p("/w/a/b.py"))), turn("s", 12, ("unlisted", p("q")), ("Unlisted", p("q"))), turn("s", 13, ("edit", None)), turn(None, 1, ("edit", p("a"))), turn("s", None, ("edit", p("a"))),
    ]
    df = spark.createDataFrame(rows, TURNS)
    assert spans(runs.runs(df, families(spark))) == [("s", 1, 0, 9, 0, 4, 8.0), ("s", 10, 6, 11, 0, 2, 1.0), ("s", 12, 0, 12, 1, 2, 0.0)]
    assert runs.runs(df.limit(0), families(spark)).isEmpty() and runs.runs(df, families(spark).limit(0)).count() == 2


def test_any_stretch_gives_the_same_runs(spark):
    random.seed(3)
    rows = [turn(s, 3 * i, *[("edit", {"path": random.choice("ab")}) if random.random() < 0.9 else None for _ in range(random.randint(0, 3))]) for s in ("hot", "cold") for i in range(60 if s == "hot" else 5)]
    df = spark.createDataFrame(rows, TURNS)
    expected = []
    for s in ("cold", "hot"):
        events = [(r[1], k, u and u[3]["path"]) for r in rows if r[0] == s for k, u in enumerate(r[4])]
        i = 0
        while i < len(events):
            j = i
            while j + 1 < len(events) and events[j + 1][2] == events[i][2] is not None:
                j += 1
            if j > i:
                expected.append((s, *events[i][:2], *events[j][:2], j - i + 1))
            i = j + 1
    for stretch in (1, 4, 7, 10_000):
        assert [x[:6] for x in spans(runs.runs(df, families(spark), stretch=stretch))] == sorted(expected)
