import random
import re
from itertools import combinations

import numpy as np
import pytest

from sessionloom.llm import components, neardup
from sessionloom.llm.words import shingle_sets


def sets(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return set(zip(w, w[1:], w[2:]))


def brute(texts, least=80, threshold=0.7):
    long = {k: t for k, t in texts.items() if t is not None and len(t) >= least}
    root = {k: k for k in long}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    s = {k: sets(t) for k, t in long.items()}
    for a, b in combinations(long, 2):
        both = len(s[a] | s[b])
        if long[a] == long[b] or (both and len(s[a] & s[b]) / both >= threshold):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted((find(k), k) for k in long if find(k) != k)


def texts(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(r.randint(2, 7)))
    out = []
    for _ in range(12):
        base = [word() for _ in range(r.randint(20, 120))]
        for _ in range(r.randint(1, 6)):
            copy = base[:]
            for _ in range(r.randint(0, len(base) // 10)):
                copy[r.randrange(len(copy))] = word()
            out.append(r.choice([" ", "_", ", "]).join(copy).replace("é", r.choice("éÉ")))
    return out + [None, "", "one two", "!" * 90, "!" * 90, "?" * 90, "w " * 40, "W " * 50, "tall " * 40_000, "long story short " * 3000]


@pytest.mark.parametrize("small", [48, 2])
def test_groups_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)
    t = {f"t{i:03}": x for i, x in enumerate(texts())}
    df = spark.createDataFrame([(k, x, 0) for k, x in t.items()], "tool_use_id string, content string, node int")
    assert sorted(tuple(r) for r in neardup.groups(df.unionByName(df.limit(5))).collect()) == brute(t)


def test_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_ROWS", 3)
    monkeypatch.setattr(neardup, "SAMPLE", 1)
    t = {f"t{i:03}": x for i, x in enumerate(texts(6))}
    df = spark.createDataFrame(list(t.items()), "tool_use_id string, content string")
    assert sorted(tuple(r) for r in neardup.groups(df).collect()) == brute(t)


def test_every_pair_within_the_radius_shares_a_mask():
    rng = np.random.default_rng(0)
    for _ in range(500):
        equal = rng.choice(neardup.SYMBOLS, neardup.BLOCKS + 1, replace=False)
        assert any(i in equal and j in equal for i, j in neardup.masks())


def test_sets_are_those_of_the_words():
    t = [x or "" for x in texts()]
    hashes, counts = shingle_sets(t)
    assert counts.tolist() == [len(sets(x)) for x in t]
    ends = np.cumsum(counts)
    for a, b in [(0, 1), (3, 4), (0, 9)]:
        x, y = (set(hashes[ends[k] - counts[k] : ends[k]].tolist()) for k in (a, b))
        assert len(x & y) == len(sets(t[a]) & sets(t[b]))


def test_empty_and_components(spark):
    assert neardup.groups(spark.createDataFrame([], "tool_use_id string, content string")).isEmpty()
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 102), (102, 101), (7, 7)], "a bigint, b bigint")
    got = dict(tuple(r) for r in components.components(chain).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_no_task_holds_a_whole_bucket(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART", 16)
    rng = np.random.default_rng(5)
    vectors = rng.integers(0, 3, (200, neardup.SYMBOLS))
    classes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "node bigint, vector array<int>")
    roots = spark.createDataFrame([(i, i // 4 * 4 if i >= 80 else 0) for i in range(200)], "node bigint, root bigint")
    crowded = spark.createDataFrame([("k", i) for i in range(200)], "key string, node bigint")
    root = {i: i // 4 * 4 if i >= 80 else 0 for i in range(200)}
    want = [(i, j) for i in range(200) for j in range(i + 1, 200) if root[i] != root[j] and (vectors[i] == vectors[j]).sum() > neardup.BLOCKS]
    seen, group = [], type(crowded).groupBy

    def counted(df, *keys):
        if "asks" in df.columns or "main" in df.columns and "vector" in df.columns:
            seen.extend(r["count"] for r in group(df, *keys).count().collect())
        return group(df, *keys)

    monkeypatch.setattr(type(crowded), "groupBy", counted)
    assert sorted(tuple(r) for r in neardup._across(crowded, roots, classes).collect()) == want
    assert seen and max(seen) < 100
