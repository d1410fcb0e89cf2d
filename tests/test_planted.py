"""Cases that the test tables don't have, planted."""

from sessionloom.functions import commands as C
from sessionloom.functions import text as T
from sessionloom.operators import conversation, evidence, requests

EVENTS = "session_id string, turn int, pos int, family string, path string, raw string"
BLOCKS = "rec_key string, msg_pos int, block_pos int, sub_pos int, call_msg_pos int, call_block_pos int, role string, type string, id string, tool_use_id string, name string, body string"


def test_copies_of_files(spark, rows):
    text = "x" * 300
    e = spark.createDataFrame([("s", 1, 0, "file_read", "a.py", text), ("s", 2, 0, "file_read", "/tmp/a.py", text), ("s", 3, 0, "file_read", "a.py", text), ("s", 4, 0, "file_read", "b.py", "short"), ("t", 1, 0, "file_read", "/tmp/a.py", text), ("s", 5, 0, "file_read", None, text), ("s", 6, 0, "file_read", "c.py", None)], EVENTS)
    assert rows(evidence.aliases(e)) == [("s", 2, 0, "/tmp/a.py", "a.py")]
    assert evidence.aliases(e.limit(0)).isEmpty()


def blocks(spark, *spec):
    return spark.createDataFrame([("r", m, b, -1, c, d, role, kind, i, t, None, body) for m, b, c, d, role, kind, i, t, body in spec], BLOCKS)


def test_blocks_that_move_and_thinking_that_changes(spark, rows):
    b = blocks(spark, (0, 0, -1, -1, "assistant", "tool_use", "u1", None, None), (0, 1, -1, -1, "assistant", "text", None, None, "hm"), (0, 2, -1, -1, "assistant", "thinking", None, None, "why"), (1, 0, 0, 0, "user", "tool_result", None, "u1", "ok"))
    assert rows(evidence.reordered(b)) == [("r", 0, 0, 2), ("r", 0, 1, 0), ("r", 0, 2, 1)]
    assert rows(conversation.mutated(b, b)) == []
    changed = b.withColumn("body", T.F.when(b["type"] == "thinking", "else").otherwise(b["body"]))
    assert conversation.mutated(b, changed).count() == 1 and conversation.mutated(b, b.filter("type <> 'thinking'")).count() == 1
    risky = blocks(spark, (0, 0, -1, -1, "assistant", "tool_use", "u1", None, None), (0, 1, -1, -1, "assistant", "thinking", None, None, "t"), (0, 2, -1, -1, "assistant", "tool_use", "u2", None, None), (1, 0, -1, -1, "user", "text", None, None, "x"), (1, 1, 0, 0, "user", "tool_result", None, "u1", "ok"))
    r = conversation.shape_risks(risky).first()
    assert (r.incomplete_next_result, r.text_before_result, r.thinking_between_uses, r.missing_next_result) == (1, 1, 1, 0)
    codes = conversation.validated(risky).first().codes
    assert codes == "first_message_not_user,incomplete_next_result,text_before_result"


def test_shell_commands(spark):
    cases = {
        "cat a/b.py": ("a/b.py", None, None), "env X=1 head -n 5 'a b.txt'": ("a b.txt", None, None), "sed -n 1,9p x.go": ("x.go", None, None), "cat a | wc": (None, None, None), "grep -rn \"two words\" src/": (None, "two words", None),
        "git log -3": (None, None, "git_log"), "uv run python -m stat x": (None, None, "stat"), "rm -rf x": (None, None, None), "": (None, None, None), None: (None, None, None), "cat a b": (None, None, None),
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = {r.c: (r.p, r.q, r.m) for r in df.select("c", C.read_path(df["c"]).alias("p"), C.search(df["c"])["query"].alias("q"), C.probe(df["c"]).alias("m")).collect()}
    assert got == cases
    kept = {r.c for r in df.unionByName(spark.createDataFrame([("pytest -q",), ("find . -delete",), ("git status",), ("git push",), ("sed -n 2p f",), ("sed -i s/a/b/ f",)], "c string")).filter(C.cacheable(T.F.col("c")).isNotNull()).collect()}
    assert {"pytest -q", "git status", "sed -n 2p f", "git log -3"} <= kept and not {"find . -delete", "git push", "sed -i s/a/b/ f", "rm -rf x", "cat a | wc"} & kept


def test_texts(spark):
    rows = [("/a//b/./c/../d/", "/a/b/d"), ("x/../../y", "../y"), ("../../z", "../../z"), ("a\\b", "a/b"), (" plain.py ", "plain.py"), ("/../x", "/x"), (".", ""), (None, None)]
    df = spark.createDataFrame(rows, "p string, want string")
    assert [(r.p, r.got) for r in df.select("p", T.normal_path(df["p"]).alias("got")).collect()] == rows
    one = spark.createDataFrame([('{"b": 1, "a": {"d": 2, "c": 3}}', {"api_key": "abc", "q": "bearer abcdef"}), ("no json", None)], "j string, m map<string,string>")
    got = one.select(requests.canonical_json(one["j"]).alias("j"), T.masked_members(one["m"]).alias("m")).collect()
    assert [r.j for r in got] == ['{"a":{"c":3,"d":2},"b":1}', "no json"] and got[0].m == {"api_key": "<redacted>", "q": "Bearer <redacted>"} and got[1].m is None
    lines = spark.createDataFrame([("a\n\n",), ("a\n",), ("a",), ("a\r\nb\r",), ("",)], "t string")
    assert [r[0] for r in lines.select(T.lines(lines["t"])).collect()] == [["a", ""], ["a"], ["a"], ["a", "b"], [""]]


def test_graphs(spark, rows):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("a", "c"), ("x", "x"), (None, "q")], "a string, b string")
    assert rows(requests.graph_metrics(edges)) == [("a", 0, 0), ("b", 1, 1), ("c", 2, 2)]
    import pytest

    with pytest.raises(ValueError):
        requests.graph_metrics(spark.createDataFrame([("s", "a"), ("a", "b"), ("b", "a")], "a string, b string"), 4)
