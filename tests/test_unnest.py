import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sessionloom.operators import messages, unnest

USE = {"type": "tool_use", "id": "t1", "name": "read", "input": {"path": "a", "range": {"offset": 1, "globs": ["x"]}}}
JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from("abc"), x, max_size=3), max_leaves=12)


def rebuilt(found):
    """The value that triples came from."""
    root = {}
    for path, at, value in found:
        node, key, at = root, "", list(at)
        for step in path.replace("[]", ".[]").strip(".").split(".") if path else []:
            node = node.setdefault(key, {})
            key = at.pop(0) if step == "[]" else step
        node[key] = [] if value is unnest.EMPTY_LIST else {} if value == unnest.EMPTY_OBJECT else value

    def solid(x):
        if not isinstance(x, dict) or not x:
            return x
        return [solid(x[i]) for i in sorted(x)] if all(isinstance(k, int) for k in x) else {k: solid(v) for k, v in x.items()}

    return solid(root[""])


@given(JSON)
def test_triples_hold_the_whole_value(value):
    assert rebuilt(unnest.triples({"r": value})) == {"r": value}


@pytest.mark.parametrize(
    "payload, expected",
    [
        ('{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": null}, {"role": "user", "content": ""}, {"role": "user", "content": []}]}', [(0, 0, -1, -1, -1)]),
        ('{"role": "user", "content": "bare"}', [(0, 0, -1, -1, -1)]),
        (json.dumps(json.dumps({"messages": [{"role": "user", "content": "text of JSON"}]})), [(0, 0, -1, -1, -1)]),
        (json.dumps({"event": "x", "messages": [{"role": "assistant", "content": [{"type": "text", "text": "a"}, USE]}, {"role": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "a"}, {"type": "image"}]}]}),
         [(0, 0, -1, -1, -1), (0, 1, -1, -1, -1), (1, 0, -1, 0, 1), (1, 0, 0, 0, 1), (1, 0, 1, 0, 1)]),
        (json.dumps({"messages": [{"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "early"}, USE, {"type": "tool_result", "tool_use_id": "t1", "content": ["s"]}]}]}),
         [(0, 0, -1, -1, -1), (0, 1, -1, -1, -1), (0, 2, -1, 0, 1), (0, 2, 0, 0, 1)]),
        ('{"messages": [{"role": "tool_result", "tool_use_id": "none", "content": ""}]}', [(0, 0, -1, -1, -1)]),
        ('{"messages": [{"role"', []), ("", []), (None, []), ("[1]", []), ("7", []), ("[" * 100_000, []),
    ],
)
def test_blocks_of_a_payload(spark, rows, payload, expected):
    df = spark.createDataFrame([(1, payload, "x")], "record_id bigint, payload string, blocks string")
    got = rows(unnest.payload_blocks(df, bodies=False).select("msg_pos", "block_pos", "sub_pos", "call_msg_pos", "call_block_pos"))
    assert got == sorted(expected, key=repr)


def test_redelivered_and_null_keys(spark):
    one, other = '{"role":"user","content":"a"}', '{ "role": "user", "content": "\\u0061" }'
    df = spark.createDataFrame([(1, one), (1, other), (1, "{damaged"), (None, one), (None, one), (2, "{damaged")], "record_id bigint, payload string")
    assert sorted(str(r.rec_key) for r in unnest.payload_blocks(df).collect()) == ["1", "None", "None"]
    assert [tuple(r) for r in unnest.damaged(df).collect()] == [(2, "{damaged")]
    assert unnest.payload_blocks(df.limit(0)).isEmpty()


TURNS = "session_id string, turn_index int, tool_uses array<struct<type: string, id: string, name: string, input: map<string,string>>>, tool_results array<struct<tool_use_id: string, content: string>>, uses string"


def test_blocks_of_turns(spark, rows):
    use = lambda i: ("tool_use", i, "read", {"path": "x"})
    turn = ("s", 1, [use("a"), None, use("b"), use("a")], [("b", "x"), ("zz", None), (None, "y"), ("a", "z"), None], "clash")
    df = spark.createDataFrame([turn, turn, ("s", 2, None, None, ""), ("s", 3, [], [("a", "")], None)], TURNS)
    got = rows(unnest.turn_blocks(df))
    calls = {r[:3]: r[4:] for r in got}
    assert len(got) == 4 + 5 + 1
    assert [calls["s/1", 1, i] for i in range(5)] == [(0, 2), (-1, -1), (-1, -1), (0, 3), (-1, -1)] and calls["s/3", 1, 0] == (-1, -1)
    assert unnest.turn_blocks(df.limit(0)).isEmpty()


def test_result_contents(spark, rows):
    payload = json.dumps({"messages": [{"role": "user", "content": [{"type": "tool_result", "tool_use_id": "r1", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}]}, {"role": "tool_result", "tool_use_id": "r2", "content": "c"}]})
    turns = spark.createDataFrame([("s", 1, [], [("r3", "d"), (None, "e")], None)], TURNS)
    records = spark.createDataFrame([(1, payload)], "record_id bigint, payload string")
    assert rows(unnest.tool_results(turns, records)) == [("r1", "a\nb"), ("r2", "c"), ("r3", "d")]


def test_whole_tables(spark, rows):
    """Messages without blocks, members of inputs at any depth, contents, and the same of recorded turns."""
    call = {"type": "tool_use", "id": "t1", "name": "read", "input": {"path": "a", "range": {"offset": 1, "globs": ["x", []]}, "none": None}}
    result = {"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": [{"type": "text", "text": "a"}, {"type": "image", "source": {"data": "i"}}]}
    payload = json.dumps({"messages": [{"role": "user", "content": ""}, {"role": "assistant", "content": None}, {"role": "assistant", "content": [call]}, {"role": "user", "content": [result]}, {"role": "user", "content": []}, {"role": "tool_result", "tool_use_id": "t2", "content": "c", "seen": 1}]})
    records = spark.createDataFrame([(1, payload), (1, payload), (2, "{damaged")], "record_id bigint, payload string")
    assert rows(unnest.payload_messages(records)) == [
        ("1", 0, "user", None, "string", 0), ("1", 1, "assistant", None, "null", 0), ("1", 2, "assistant", None, "array", 1), ("1", 3, "user", None, "array", 1), ("1", 4, "user", None, "array", 0), ("1", 5, "tool_result", "t2", "string", 1)
    ]
    assert rows(unnest.payload_members(records)) == sorted([
        ("1", 2, 0, -1, "input.path", [], "string", "a"), ("1", 2, 0, -1, "input.range.offset", [], "number", "1"), ("1", 2, 0, -1, "input.range.globs[]", [0], "string", "x"), ("1", 2, 0, -1, "input.range.globs[]", [1], "array", None),
        ("1", 2, 0, -1, "input.none", [], "null", None), ("1", 3, 0, -1, "is_error", [], "boolean", "true"), ("1", 3, 0, 1, "source.data", [], "string", "i"), ("1", 5, -1, -1, "seen", [], "number", "1"),
    ], key=repr)
    assert rows(unnest.payload_contents(records)) == [("1", 3, 0, 2, 0, "t1", "a"), ("1", 5, 0, -1, -1, "t2", "c")]

    use = lambda i, x: ("tool_use", i, "read", x)
    turn = ("s", 1, [use("a", {"path": "x", "n": None}), None, use("b", {})], [("b", "text")], "")
    turns = spark.createDataFrame([turn, turn, ("s", 2, None, [], "")], TURNS)
    assert rows(unnest.turn_messages(turns)) == [("s/1", 0, "assistant", None, "array", 3), ("s/1", 1, "user", None, "array", 1), ("s/2", 0, "assistant", None, "null", 0), ("s/2", 1, "user", None, "array", 0)]
    assert rows(unnest.turn_members(turns)) == sorted([("s/1", 0, 0, -1, "input.path", [], "string", "x"), ("s/1", 0, 0, -1, "input.n", [], "null", None), ("s/1", 0, 2, -1, "input", [], "object", None)], key=repr)
    blocks = rows(unnest.turn_blocks(turns, bodies=True))
    assert blocks[0] == ("s/1", 0, 0, -1, -1, -1, "assistant", "tool_use", "a", None, "read", None) and blocks[-1] == ("s/1", 1, 0, -1, 0, 2, "user", "tool_result", None, "b", None, "text") and len(blocks) == 4


def test_messages_without_blocks_count(spark, rows):
    """They are rows of their own, the next message of a call, authored and cuts when they are a user's."""
    said = lambda role, content: {"role": role, "content": content}
    answer = said("user", [{"type": "tool_result", "tool_use_id": "t1", "content": "x"}])
    payload = json.dumps({"messages": [said("user", ""), said("assistant", [USE]), said("assistant", None), answer, said("user", []), said("assistant", "a"), said("user", None), said("user", "b")]})
    blocks = unnest.payload_blocks(spark.createDataFrame([(1, payload)], "record_id bigint, payload string"), messages=True)
    assert [(r.msg_pos, r.n_blocks) for r in messages.messages(blocks).orderBy("msg_pos").collect()] == [(0, 0), (1, 1), (2, 0), (3, 1), (4, 0), (5, 1), (6, 0), (7, 1)]
    assert [r.turn for r in messages.user_turns(messages.messages(blocks)).orderBy("msg_pos").collect()] == [1, 1, 1, 1, 2, 2, 3, 4]
    assert [(r.next_role, r.n_answers, r.answered_next) for r in messages.timeline(blocks).collect()] == [("assistant", 1, False)]
    assert rows(messages.cuts(blocks)) == [("1", 4)] and rows(messages.chunks(blocks)) == [("1", 0, 0, 5, 3), ("1", 1, 6, 6, 0), ("1", 2, 7, 7, 1)]
    assert rows(messages.merged_roles(blocks).select("role", "first_pos", "last_pos")) == sorted([("assistant", 1, 1), ("user", 3, 3), ("assistant", 5, 5), ("user", 7, 7)], key=repr)


@pytest.mark.parametrize("frequent", [0, 3, 64])
def test_similar_texts_against_brute_force(spark, rows, frequent):
    import random
    import re

    r = random.Random(3)
    words = ["a", "of", "the", "x_1", "src/a", *(f"w{i}" for i in range(20))]
    texts = [(r.choice("kl"), f"{i:03}", " ".join(r.choice(words[: r.choice((3, 8, 25))]) for _ in range(r.choice((1, 2, 4, 9, 20))))) for i in range(150)]
    texts += [("k", "n1", None), ("k", "n2", "?!"), (None, "n3", "of the"), ("k", "n4", "Of THE!"), ("k", "n5", "the, of")]
    sets = {i: (k, set(re.sub(r"[^a-z0-9_/]", " ", t.lower()).split())) for k, i, t in texts if k and t}
    want = [(k, i, j, len(a & b) / len(a | b)) for i, (k, a) in sets.items() for j, (m, b) in sets.items() if i < j and k == m and a and b and len(a & b) / len(a | b) >= 0.25]
    got = rows(messages.similar_texts(spark.createDataFrame(texts, "key string, id string, text string"), frequent=frequent))
    assert got == sorted(want, key=repr) and ("k", "n4", "n5", 1.0) in got


@pytest.mark.parametrize("texts, words, frequent", [(16, 10_000, 64), (16, 10_000, 0), (1000, 60, 64), (1000, 60, 0)])
def test_a_large_session_is_matched_part_by_part(spark, rows, monkeypatch, texts, words, frequent):
    """Two words that all texts of a session share: each pair is found once, in a unit of at most two parts."""
    from sessionloom.operators import similar

    sets = {("hot", f"h{i:03}"): {"re", "run", f"a{i % 40}", f"b{i}"} for i in range(150)} | {(f"s{i % 9}", f"s{i:02}"): {"re", f"a{i % 3}"} for i in range(40)}
    sets |= {("hot", f"l{i}"): {"re", *(f"c{k}" for k in range(10 * i))} for i in range(9)}
    want = [(k, i, j, len(a & b) / len(a | b)) for (k, i), a in sets.items() for (m, j), b in sets.items() if k == m and i < j and len(a & b) / len(a | b) >= 0.25]
    df = spark.createDataFrame([(k, i, sorted(w)) for (k, i), w in sets.items()], "key string, id string, w array<string>")
    sizes, units = [], similar._units
    monkeypatch.setattr(similar, "_units", lambda dealt, n: sizes.extend(r["count"] for r in dealt.filter("b >= 0").groupBy("owner", "a", "b").count().collect()) or units(dealt, n))
    assert rows(similar.pairs(df, 0.25, frequent, texts, words)) == sorted(want, key=repr)
    assert len(sizes) > 10 and max(sizes) < 100
    monkeypatch.setattr(similar, "STEP", 50)
    monkeypatch.setattr(similar, "ROWS", 7)
    assert len(list(similar._matches(df.filter("key = 'hot'").selectExpr("*", "0 as side").toArrow(), 0.25, frequent))) > 9
    assert sum(b.num_rows for b in similar._matches(df.selectExpr("*", "0 as side").toArrow(), 0.25, frequent)) == len(want)
