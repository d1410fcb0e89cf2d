import datetime as dt
import json

from sessionloom.operators import drift

FILES = "file_id string, stream string, file_seq int, written_at timestamp, fmt string, header string, extra string, readable string, entries string"
LINES = "file_id string, line_no int, arrived_at timestamp, raw string, name string, kind string"


def frames(spark, files, lines):
    f = spark.createDataFrame([(i, s, q, None, fmt, h, "x", "x", "x") for i, s, q, fmt, h in files], FILES)
    return f, spark.createDataFrame([(i, n, None, raw, "x", "x") for i, n, raw in lines], LINES)


def test_changes_across_formats(spark, rows):
    files = [("a1", "a", 1, "jsonl", None), ("a2", "a", 2, "semi", "session_id;BASELINE_PROMPT_TOKENS"), ("a3", "a", 5, "kv", None), ("a4", "a", 9, "jsonl", None), ("b1", "b", 1, "kv", None)]
    lines = [
        ("a1", 1, '{"session_id":"s","bpt":10}'), ("a1", 1, '{"session_id":"s","bpt":10}'), ("a1", 2, '{"session_id":"t","bpt":null}'), ("a1", 3, '{"session_id":"u","bp'),
        ("a2", 1, "s;12.5"), ("a2", 2, "t;"), ("a2", 3, "damaged"),
        ("a3", 1, "session_id:s|hht:4"), ("a3", 2, "session_id:t|hht:~5"), ("a3", 3, "session_id:u|hht:7 tok"), ("a3", 4, "broken"), ("a3", 5, None),
        ("a4", 1, '{"stats":{"hht":"7"},"Reacquisition Cost Tokens":3}'),
        ("b1", 1, "rct:1"), ("zz", 1, "no such file"),
    ]
    f, r = frames(spark, files, lines)
    assert rows(drift.changes(f, r)) == [
        ("a2", "baseline_prompt_tokens", "renamed"), ("a2", "baseline_prompt_tokens", "retyped"),
        ("a3", "baseline_prompt_tokens", "removed"), ("a3", "hot_hint_tokens_added", "added"),
        ("a4", "hot_hint_tokens_added", "renamed"), ("a4", "reacquisition_cost_tokens", "added"),
    ]
    spans = {(r.field, r.name): (r.first_seq, r.last_seq, r.open) for r in drift.lifespans(f, r).filter("stream='a'").collect()}
    assert spans["hot_hint_tokens_added", "stats.hht"] == (9, 9, True) and spans["baseline_prompt_tokens", "bpt"] == (1, 1, False)


def test_one_table_with_generated_casts(spark):
    f, r = frames(
        spark,
        [("a", "s", 1, "semi", "session_id;date;Baseline Prompt Tokens;cost_usd;note"), ("b", "s", 2, "jsonl", None)],
        [("a", 1, "x;2026-01-02;~1,234;0.5;hm"), ("a", 2, "y;junk;77 tok;?;"), ("a", 3, "short"), ("b", 1, json.dumps({"session_id": "z", "bpt": 12.0, "prompt": {"baseline": None}}))],
    )
    t = {(r.file_id, r.line_no): r for r in drift.unified(f, r).collect()}
    one = t["a", 1]
    assert (one.session_id, one.date, one.baseline_prompt_tokens, one.cost_usd, one.others) == ("x", dt.date(2026, 1, 2), 1234, 0.5, {"note": "hm"})
    assert (t["a", 2].baseline_prompt_tokens, t["a", 2].date, t["a", 2].cost_usd) == (77, None, None)
    assert t["a", 3].damaged and t["a", 3].damaged_raw == "short"
    assert t["b", 1].baseline_prompt_tokens == 12


def test_empty_tables_and_long_lines(spark):
    f, r = frames(spark, [], [])
    assert drift.changes(f, r).columns == ["file_id", "field", "change"] and drift.changes(f, r).isEmpty()
    assert drift.unified(f, r).isEmpty() and drift.lifespans(f, r).isEmpty()
    f, r = frames(spark, [("a", "s", 1, "kv", None), ("b", "s", 2, "kv", None)], [("a", 1, "|".join(f"k{i}:{i}" for i in range(5000))), ("b", 1, "bpt:" + "9" * 10_000)])
    assert [tuple(x) for x in drift.changes(f, r).collect()] == [("b", "baseline_prompt_tokens", "added")]


def test_values_under_unknown_names_are_kept(spark, rows):
    f, r = frames(spark, [("a", "s", 1, "jsonl", None)], [("a", 1, json.dumps({"session_id": "z", "New Name": 1, "new_name": "2", "a": {"b": {"c": {"d": {"e": 5}}}}}))])
    got = sorted((x.name, x.kind, x.value) for x in drift.others(f, r).collect())
    assert got == [("New Name", "whole", "1"), ("a.b.c.d.e", "whole", "5"), ("new_name", "text", "2")]


def test_members_at_any_depth(spark, rows):
    deep = {"bpt": 5}
    for k in "fedcba":
        deep = {k: deep}
    f, r = frames(spark, [("a", "s", 1, "jsonl", None), ("b", "s", 2, "jsonl", None)], [("a", 1, '{"session_id":"z"}'), ("b", 1, json.dumps({"session_id": "z", "baseline": {"prompt": {"tokens": 1}}} | deep))])
    assert ("a.b.c.d.e.f.bpt", "whole", "5") in [(x.name, x.kind, x.value) for x in drift.others(f, r).collect()]
    assert rows(drift.changes(f, r)) == [("b", "baseline_prompt_tokens", "added")]
