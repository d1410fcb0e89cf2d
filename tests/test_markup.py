import random

from hypothesis import given, settings
from hypothesis import strategies as st

from sessionloom.operators import markup as M

names = st.from_regex(r"[a-z_][a-z0-9_]{0,6}", fullmatch=True)
leaves = st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"), max_size=30)
values = st.recursive(leaves, lambda v: st.lists(v, max_size=4) | st.dictionaries(names, v, max_size=4), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(names, values, max_size=5))
def test_json_comes_back(value):
    nodes = M.parse(M.write(M.from_json(value)))
    assert len(nodes) == 1 and M.to_json(nodes[0]) == value


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200), st.integers(1, 7))
def test_never_fails_and_streams_alike(text, step):
    p = M.Parser()
    pieces = [n for k in range(0, len(text), step) for n in p.feed(text[k : k + step])] + p.flush()
    assert pieces == M.parse(text)


def test_grammar():
    text = '@repo main lang:py stars:5\n  @func run [name|type] async:true\n    a | int\n    b | "x y"\n    > does it\n    note: two words\n  @msg role:user\n    |#t1>\n@not a node\n  > nor text\n    |#t1\nloose'
    repo, *more = M.parse(text)
    func, msg = repo.children
    assert (repo.label, repo.attrs) == ("main", {"lang": "py", "stars": 5}) and (func.label, func.heads, func.rows) == ("run", ["name", "type"], [["a", "int"], ["b", '"x y"']])
    assert func.attrs == {"async": True, "note": "two words"} and func.lines == ["does it"] and msg.lines == ["@not a node", "  > nor text"]
    assert M.parse(M.write([repo])) == [repo]
    assert M.calls_in('@Tool grep path:a\ntext {"name": "read", "input": {"path": "b"}}') == [("grep", {"path": "a"}), ("read", {"path": "b"})]
    assert M.parse(None) == [] and M.parse("") == []


def test_xml_and_tables():
    assert M.from_xml(M.to_xml({"a": "x < y & z", "b": "", "bad name": "q", "c": None})) == {"a": "x < y & z", "b": ""}
    assert M.from_xml("<r><a>&boom;</a></r>") == {"a": "&boom;"} and M.from_xml(M.to_xml({})) == {}
    rows = [["1", "a|b", "two\nlines"], ["2", "", "x"]]
    assert M.from_table(M.to_table(["id", "v", "w"], rows)) == [dict(zip(["id", "v", "w"], r)) for r in rows] and M.from_table("no table") == []


def test_changes_make_the_new_skeleton():
    r = random.Random(5)
    for _ in range(100):
        a, b = ("\n".join(f"{r.choice(['def', 'class'])} n{r.randint(0, 6)}(x{r.randint(0, 2)}):" for _ in range(r.randint(0, 8))) for _ in range(2))
        assert M.applied(M.skeleton(a), M.difference(M.skeleton(a), M.skeleton(b))) == M.skeleton(b)
