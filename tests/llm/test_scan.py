"""The scan for JSON objects in texts, and the families of runs."""

import json
import random
import time

import pytest

from sessionloom.llm import formatting, runs


def parts(text):
    return [p if isinstance(p, str) else {} for p in formatting.pieces(text)]


def test_objects_within_texts():
    assert parts('ab {"x":1,"y":{"z":2}} tail {"q":') == ["ab ", {}, ' tail {"q":']
    assert parts('{"a":{"b":1},"c":[{"d":2},{"e":3') == ['{"a":', {}, ',"c":[', {}, ',{"e":3']
    assert parts('x{y{"k":1}z') == ["x{y", {}, "z"] and parts("{}") == [{}] and parts("") == []
    assert parts('{"a": "{}", bad') == ['{"a": "{}", bad']
    broken = '{"a": {"b": 1}, "c": "x {y} z\x01 ... {\\"q\\"} \n", "d": {"e": 2}}'
    assert {} in parts(broken)


@pytest.mark.parametrize("unit", ['{"a":', '{"a":[', '{"a":{"b":1},"c":', '[{"x":"', '{"a":"{', "{ ", '{"a":1,', "{", '{"a":"\\"{'])
def test_linear_in_the_length(unit):
    took = []
    for n in (100_000, 1_000_000):
        start = time.process_time()
        list(formatting.pieces(unit * (n // len(unit))))
        took.append(time.process_time() - start)
    assert took[1] < 30 * max(took[0], 0.1)


def test_order_of_members_in_broken_objects():
    r = random.Random(1)
    for _ in range(50):
        inner = {f"k{i}": {"a": r.random(), "b": [r.random(), {"c": "x" * 30, "d": 1}]} for i in range(3)}
        turned = {k: dict(reversed(v.items())) for k, v in inner.items()}
        one, two = (json.dumps(list(x.values()))[:-1] + ', {"open": [' for x in (inner, turned))
        assert formatting.fingerprint(one)[0] == formatting.fingerprint(two)[0] and formatting.same(one, two)


def test_any_number_of_families(spark):
    turns = spark.createDataFrame(
        [("s", i, "/r", None, [("tool_use", f"u{i}", name, {"path": "a.py"})]) for i, name in enumerate(["T77", "other 20001", "x", "x"])],
        "session_id string, turn_index int, workspace_root string, recorded_at timestamp, tool_uses array<struct<type string, id string, name string, input map<string,string>>>",
    )
    families = spark.range(30_000).selectExpr("concat('t', id) tool_name", "concat('f', id % 100) family").unionByName(spark.createDataFrame([("other 20001", "f77")], "tool_name string, family string"))
    got = [tuple(x)[:5] for x in runs.runs(turns, families).collect()]
    assert sorted(got) == [("s", 0, 0, 1, 0), ("s", 2, 0, 3, 0)]
