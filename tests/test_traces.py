import difflib
import json
import random

import pytest

from sessionloom.operators import traces


def block(**change):
    b = {
        "envelope": {"trace_version": traces.VERSION, "block_id": "b", "session_id": "s", "turn": 1, "step": 1, "direction": "request", "payload_digest": "draft-uncomputed"},
        "observation": {"class": "file", "key": "k", "action": "store", "result": "ok"},
        "content": {"exact": True, "hash": "sha256:" + "0" * 64, "size_bytes": 3, "resolver_uri": "local:x"}, "audit": {"resolver_state": "available_local", "expectation": "accept_exact"},
    }
    for path, value in change.items():
        section, name = path.split("__")
        b[section][name] = value
    return b


CASES = [
    ({}, "warn", "draft_payload_digest_uncomputed"), ({"envelope__turn": -1}, "fail", "invalid_turn,out_of_order_trace_block"), ({"content__exact": False}, "fail", "accept_exact_requires_exact_local_content"), ({"observation__result": "error"}, "fail", "missing_reason"),
    ({"audit__resolver_state": "resolvable_remote", "audit__expectation": "accept_reference", "observation__action": "reference"}, "warn", "draft_payload_digest_uncomputed,resolvable_remote"),
    ({"observation__action": "delta", "audit__expectation": "accept_delta"}, "fail", "missing_or_invalid_base_hash,missing_or_invalid_delta_hash,missing_or_invalid_delta_uri,missing_or_invalid_delta_algorithm"),
    ({"observation__action": "summary_reference", "audit__expectation": "accept_non_exact_reference"}, "fail", "non_exact_reference_marked_exact,accept_non_exact_requires_non_exact_reference"), ({"envelope__payload_digest": "sha256:" + "a" * 64}, "pass", ""),
]


def test_verdicts(spark):
    lines = [("f", i, json.dumps(block(envelope__block_id=f"b{i}", envelope__step=i) | {} if not c else block(**({"envelope__block_id": f"b{i}", "envelope__step": i} | c)))) for i, (c, _, _) in enumerate(CASES)]
    lines += [("f", 90, "{broken"), ("f", 91, "[1]"), ("f", 92, '{"block": 3}'), ("f", 93, json.dumps({"block": block(envelope__block_id="b0", envelope__step=0)})), ("f", 94, "  "), ("f", 95, None)]
    got = {r.line_no: (r.status, r.codes) for r in traces.audited(spark.createDataFrame(lines, "source string, line_no int, line string")).collect()}
    for i, (_, status, codes) in enumerate(CASES):
        assert got[i] == (status, codes), i
    assert got[90] == ("fail", "invalid_jsonl_line") and got[91] == ("fail", "jsonl_line_not_object") and got[92] == ("fail", "missing_or_invalid_block")
    assert got[93] == ("fail", "duplicate_block_id,out_of_order_trace_block") and 94 not in got and 95 not in got


def test_digest_and_replay():
    one = json.dumps(block())
    assert traces.digest(one) == traces.digest(json.dumps(dict(reversed(block().items())))) != traces.digest(json.dumps(block(content__size_bytes=4)))
    assert traces.digest("{") is None and traces.digest(None) is None and traces.digest("{}") is None
    r = random.Random(3)
    for _ in range(200):
        a = [r.choice("abc") for _ in range(r.randint(0, 12))]
        b = [x for x in a if r.random() < 0.7] + [r.choice("xyz") for _ in range(r.randint(0, 3))]
        d = "\n".join(difflib.unified_diff("\n".join(a).split("\n"), "\n".join(b).split("\n"), lineterm="", n=r.randint(0, 3)))
        assert traces.replayed("\n".join(a), d) == "\n".join(b)
    with pytest.raises(ValueError):
        traces.replayed("a\nb", "@@ -1,1 +1,1 @@\n-x\n+y")
