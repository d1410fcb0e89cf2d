import random

import numpy as np
import pytest

from sessionloom.llm import fmindex, spans
from sessionloom.llm.words import points


def brute(texts, documents, least):
    held = {}
    for t, d in zip(texts, documents):
        for i in range(len(t) - least + 1):
            held.setdefault(t[i : i + least], set()).add(d)
    out = []
    for k, t in enumerate(texts):
        on = np.zeros(len(t) + 2, int)
        for i in range(len(t) - least + 1):
            if len(held[t[i : i + least]]) > 1:
                on[i + 1 : i + least + 1] = 1
        edge = np.flatnonzero(np.diff(on))
        out += [(k, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(60))
def test_index_against_brute_force(seed, monkeypatch):
    r = random.Random(seed)
    least, probe, letters = r.choice([4, 8, 12]), r.choice([1, 2, 3]), r.choice(["ab", "abcd", "abcdefghij\U0001f600é"])
    monkeypatch.setattr(fmindex, "LANE", r.choice([1, 5, 1500]))
    pool = ["".join(r.choice(letters) for _ in range(r.randint(1, 40))) for _ in range(4)]
    texts = ["".join(r.choice(pool)[r.randint(0, 3) :] if r.random() < 0.6 else "".join(r.choice(letters) for _ in range(9)) for _ in range(r.randint(1, 6))) for _ in range(r.randint(2, 9))]
    texts = [t for t in texts if t]
    documents = np.array([r.randint(0, 4) for _ in texts])
    assert sorted(fmindex.shared_stretches([points(t) for t in texts], documents, least, probe)) == brute(texts, documents, least)


def contents(seed=1):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcdefgh é\n") for _ in range(n))
    shared = [word(n) for n in (239, 240, 300, 900, 2500)]
    boiler = word(500)
    texts = [word(r.randint(0, 300)) + r.choice(shared)[r.randint(0, 30) :] + word(r.randint(0, 300)) + (boiler if i % 3 == 0 else "") for i in range(40)]
    return [*texts, None, "", "x" * 239, "x" * 1000, "x" * 240, texts[0], word(10_000) + shared[4], shared[4] * 2]


@pytest.mark.parametrize("shard", [spans.SHARD, 3000])
def test_spans_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(spans, "SHARD", shard)  # small: labels fall back to anchors, and anchors to counted stretches
    texts = contents()
    df = spark.createDataFrame([(f"t{i}", t, 1) for i, t in enumerate(texts)], "tool_use_id string, content string, node int")
    df = df.unionByName(df.limit(3))
    usable = [(i, t) for i, t in enumerate(texts) if t]
    expected = sorted((f"t{usable[k][0]}", a, b) for k, a, b in brute([t for _, t in usable], [i for i, _ in usable], 240))
    assert sorted(tuple(r) for r in spans.spans(df).collect()) == expected
    shares = {r.tool_use_id: r for r in spans.shares(df, spans.spans(df)).collect()}
    assert shares["t41"].share == 0 and shares["t0"].n_chars == len(texts[0]) and shares["t45"].share == 1


def test_empty(spark):
    df = spark.createDataFrame([], "tool_use_id string, content string")
    assert spans.spans(df).columns == ["tool_use_id", "span_start", "span_end"] and spans.spans(df).isEmpty()
