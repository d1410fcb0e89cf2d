import json

from sessionloom.operators import codecs, outputs

CASES = {
    "grep_context": "src/a.py-10-before this\nsrc/a.py:11:hit here\nsrc/a.py-12-after it\nsrc/a.py-40-far away\nsrc/a.py-41-and more\n",
    "git_log": "".join(f"commit {'ab' * 20}\nAuthor: x\nDate:   y\n\n    Subject {i}\n\n" for i in range(4)).replace("Author: x\nDate:   y\n\n", "") + "abcdef1 One line\n",
    "grep": "".join(f"src/file{i % 3}.py:{i}: value = {i}\n" for i in range(70)),
    "find": "".join(f"/work/project/src/module{i % 9}/file{i}.py\n" for i in range(300)),
    "install": "".join(f"Collecting package{i}\n" for i in range(30)) + "Successfully installed 30\n",
    "ps": "USER PID %CPU COMMAND\n" + "".join(f"me {i} 0.0 /usr/libexec/thing{i}\n" for i in range(20)) + "me 99 1.0 python own.py\n",
    "env": "HOME=/home/x\nPATH=/bin\nAPI_TOKEN=supersecretvalue\n" + "".join(f"OTHER_{i}=abc{i}\n" for i in range(20)),
    "search_results": json.dumps([{"path": f"a{i}.py", "line": i, "text": "found it"} for i in range(9)]),
    "stack_trace": "Error: x\n" + "".join(f"    at fn{i} (/app/node_modules/lib/i.js:{i}:2)\n" for i in range(6)) + "    at own (/app/src/own.js:3:1)\n",
    "json": json.dumps({"a": [{"b": i, "c": "x" * 80} for i in range(40)]}), "diff": "diff --git a/x b/x\n@@ -1,3 +1,3 @@\n a long line of context that stays\n-old\n+new\n another line of context\n",
    "test_report": "tests/a.py::t1 PASSED\ntests/a.py::t2 FAILED\nE   assert 1 == 2\n" + "tests/a.py::t PASSED\n" * 40 + "== 41 passed, 1 failed ==\n", "listing": "".join(f"-rw-r--r-- me us {i} dir/file{i}.py\n" for i in range(40)),
    "log": "".join(f"2026-01-01T00:00:{i:02}Z INFO step {i}\n" for i in range(50)), "code": "def f(a):\n" + "    return a\n" * 9, "repetitive": "".join(f"progress bar {i}\n" for i in range(9)), "raw": "just some words\nof no kind\n", "empty": "  ",
}


def test_kinds_and_forms(spark):
    df = spark.createDataFrame([(k, t) for k, t in CASES.items()] + [("null", None)], "k string, t string")
    got = {r.k: r.kind for r in df.select("k", outputs.kind(df["t"]).alias("kind")).collect()}
    assert got == {k: k for k in CASES} | {"null": "empty"}
    for k, t in CASES.items():
        short, tight = outputs.shortened(t, k), outputs.shortened(t, k, True)
        assert len(short) <= len(t) and len(tight) <= len(short)
    assert outputs.shortened(None, "grep") is None and outputs.shortened("x", None) == "x" and outputs.shortened("", "ps") == ""


def test_nothing_that_matters_is_lost():
    s = outputs.shortened
    assert "supersecretvalue" not in s(CASES["env"], "env") and "HOME=/home/x" in s(CASES["env"], "env")
    assert "own.js" in s(CASES["stack_trace"], "stack_trace") and "(6 library frames)" in s(CASES["stack_trace"], "stack_trace")
    assert "own.py" in s(CASES["ps"], "ps") and "... 20 more" in s(CASES["ps"], "ps")
    assert "*" in outputs.grep_context(CASES["grep_context"]) and " ..." in outputs.grep_context(CASES["grep_context"])
    assert "Subject 3" in outputs.git_log(CASES["git_log"]) and outputs.git_log(CASES["git_log"]).startswith("5 commits")
    form = outputs.find(CASES["find"])
    paths = {f"{d}/{n}" for line in form.splitlines()[1:] for d, names in [line.split("/: ")] for n in names.split(" ")}
    assert paths == set(CASES["find"].split())
    assert "failed" in outputs.install("Collecting a\nCollecting b\nerror: no wheel\nlast") and "last" in outputs.install("Collecting a\nerror: no\nlast")
    assert "more" in codecs.search(CASES["grep"]) and "70 hits" in codecs.search(CASES["grep"])
    assert "... 9 more lines" not in s(CASES["grep"], "grep") and "more lines" in s(CASES["grep"], "grep", True)


def test_outline():
    text = codecs.outline({"a": [1, 2, {"b": None}], "c": {}, "d": "x" * 100, "e": []})
    assert text.splitlines() == ["a[]: int x2 1", "a[].b: null x1 null", "c: object x1", 'd: str x1 "' + "x" * 39 + "~", "e: array x1"]
    assert codecs.outline({str(i): i for i in range(1000)}, 100).splitlines()[-1].startswith("... 99")
    assert codecs.outline(5) == ".: int x1 5"
