from hypothesis import given
from hypothesis import strategies as st

from sessionloom.llm import formatting as f

PAD = " and so on" * 9
JSON = st.recursive(st.none() | st.booleans() | st.integers(0, 99) | st.text("abé1 ", max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("abc", min_size=1, max_size=2), x, max_size=3), max_leaves=8)


def shuffled(value, random):
    if isinstance(value, dict):
        items = [(k, shuffled(v, random)) for k, v in value.items()]
        random.shuffle(items)
        return dict(items)
    return [shuffled(v, random) for v in value] if isinstance(value, list) else value


@given(JSON, st.randoms(use_true_random=False))
def test_member_order_space_case(value, random):
    import json

    a = "log: " + json.dumps({"k": value, "m": 1}, indent=2)
    b = "LOG " + json.dumps(shuffled({"k": value, "m": 1}, random)).upper()
    assert f.fingerprint(a)[0] == f.fingerprint(b)[0] and f.same(a, b)


def test_what_is_no_copy():
    assert f.fingerprint('{"a": [1, 2]}')[0] != f.fingerprint('{"a": [2, 1]}')[0]
    assert f.fingerprint('{"a": {"b": 1, "c": 2}}')[0] != f.fingerprint('{"a": {"b": 2, "c": 1}}')[0]
    assert not f.same('x {"a": 1, "b": 2}', 'x {"a": 2, "b": 1}') and f.same("A-b c", "ab_C!")
    assert f.fingerprint("?!") == (0, 0)
    assert f.fingerprint("{" * 200_000 + "a")[0] == f.fingerprint("a")[1]


def results(spark, texts):
    return spark.createDataFrame([(f"t{i}", t, "x") for i, t in enumerate(texts)], "tool_use_id string, content string, member string")


def test_copies(spark, rows):
    same = ['{"a": 1, "b": {"c": 2, "d": [3]}}' + PAD, '{"b":{"d":[3],"c":2},"a":1} AND SO ON' + PAD[10:], "{'a': 1, 'b': {'c': 2, 'd': [3]}}" + PAD]
    texts = [*same, "other" + PAD, None, "", "short", "!" * 100, "?" * 100, "long " * 50_000, "LONG\n" * 50_000, same[0]]
    df = results(spark, texts)
    df = df.unionByName(df.limit(2))
    assert rows(f.copies(df)) == [("t0", "t1"), ("t0", "t11"), ("t0", "t2"), ("t10", "t9")]
    assert f.copies(df.limit(0)).isEmpty()


def test_forms_with_one_fingerprint_but_other_fields_are_split(spark):
    a, b = '{"a": 1}' + PAD, '{"a": 2}' + PAD
    prints = spark.createDataFrame([("t0", b"m", b"s", b"f0"), ("t1", b"m", b"s", b"f1")], "tool_use_id string, member binary, straight binary, form binary")
    assert len({bytes(r.member) for r in f.verified(prints, results(spark, [a, b])).collect()}) == 2
