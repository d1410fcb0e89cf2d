import random
from collections import defaultdict

import pytest

from sessionloom.llm import mixing, packing, tokens

CAPS = "window_name string, capacity_tokens int, n_tokens int"


def test_tokens(spark):
    text = ["Hello world, it's 3 o'clock.\n\n  é日本", None, "", "a" * 20_000]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(text)], "doc_id bigint, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in tokens.sizes(df, "doc_id").collect()}
    assert got == {i: tokens.count(t) for i, t in enumerate(text)} and got[1] == got[2] == 0
    assert tokens.encoder().decode(tokens.encoder().encode_ordinary(text[0])) == text[0]


@pytest.mark.parametrize("capacity", [7, 10, 64])
def test_sum_of_squares_rule(capacity):
    r = random.Random(capacity)
    sizes = [r.randint(1, capacity) for _ in range(400)]
    level, count = {}, defaultdict(int)
    for size, window in zip(sizes, packing.pack(sizes, capacity).tolist()):
        squares = lambda c: sum(n * n for h, n in c.items() if 0 < h < capacity)

        def after(h):
            c = count.copy()
            if h:
                c[h] -= 1
            c[h + size] += 1
            return squares(c)

        best = min(after(h) for h in range(capacity - size + 1) if h == 0 or count[h])
        h = level.get(window, 0)
        assert h + size <= capacity and after(h) == best
        if h:
            count[h] -= 1
        level[window] = h + size
        count[h + size] += 1


@pytest.mark.parametrize("shard", [packing.SHARD, 50])
def test_windows(spark, shard):
    r = random.Random(1)
    sizes = [(i, r.choice([r.randint(1, 40), r.randint(1, 300)]), "x") for i in range(400)] + [(900, 0, "x"), (901, None, "x"), (902, 100, "x"), (3, 5, "x")]
    sizes[-1] = (3, sizes[3][1], "x")
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint, piece string")
    caps = spark.createDataFrame([("a", 100, 1), ("b", 1000, 1), ("c", None, 1)], CAPS)
    got = packing.windows(df, caps, shard).collect()
    want = {i: n for i, n, _ in sizes if n}
    for name, capacity in (("a", 100), ("b", 1000)):
        pieces, fill = defaultdict(list), defaultdict(int)
        for x in got:
            if x.window_name == name:
                pieces[x.doc_id].append((x.first_token, x.n_tokens))
                fill[x.window] += x.n_tokens
        assert {i: sum(n for _, n in p) for i, p in pieces.items()} == want and max(fill.values()) <= capacity
        for i, p in pieces.items():
            assert sorted(p) == [(a, min(capacity, want[i] - a)) for a in range(0, want[i], capacity)]
        assert sum(fill.values()) / (len(fill) * capacity) > (0.95 if shard > 50 else 0.9)
    summary = {x.window_name: x for x in packing.unused(packing.windows(df, caps, shard), caps).collect()}
    assert summary["a"].n_tokens == sum(want.values()) and summary["a"].unused_tokens >= 0
    assert packing.windows(df.limit(0), caps).isEmpty() and packing.windows(df, caps.limit(0)).isEmpty()
    with pytest.raises(ValueError):
        packing.windows(df, spark.createDataFrame([("z", 0, 1)], CAPS))


DOCS, TARGETS = "doc_id bigint, source string, text_key string, n_tokens bigint, pattern string", "source string, target_share double, max_repeats int, tokens int"


def test_mix_reaches_shares_within_allowances(spark):
    r = random.Random(2)
    docs = [(i, r.choices("abc", (6, 3, 1))[0], f"k{i % 1900}", 5 + (i % 1900) % 30, "x") for i in range(2000)] + [(9000, None, "n", 4, "x"), (9001, "a", None, 0, "x"), (9002, "z", "zz", 9, "x")]
    df = spark.createDataFrame(docs, DOCS)
    targets = spark.createDataFrame([("a", 0.4, 1, 0), ("b", 0.3, 2, 0), ("c", 0.3, 4, 0), ("unused", 0.0, 1, 0), ("null", None, None, 0)], TARGETS)
    mixed = mixing.mix(df, targets)
    rows = mixed.collect()
    assert {(x.source, x.doc_id): x.n_uses for x in rows} == {(x.source, x.doc_id): x.n_uses for x in mixing.mix(df, targets).collect()}
    by_text, key = defaultdict(list), {d[0]: d for d in docs}
    for x in rows:
        assert key[x.doc_id][1] == x.source
        by_text[key[x.doc_id][2]].append(x)
    allowed, member = {"a": 1, "b": 2, "c": 4}, defaultdict(set)
    for d in docs:
        member[d[2]].add(d[1])
    for k, used in by_text.items():
        assert sum(x.n_uses for x in used) <= min(allowed[s] for s in member[k])
    shares = {x.source: x for x in mixing.shares(mixed, targets).collect()}
    for s, share in (("a", 0.4), ("b", 0.3), ("c", 0.3)):
        assert abs(shares[s].reached_share - share) < 0.02
    assert shares["unused"].tokens == 0
    total = sum(x.tokens for x in shares.values())
    assert abs(sum(x.n_tokens * x.n_uses for x in mixing.mix(df, targets, size=total // 2).collect()) - total // 2) < 120


def test_flow():
    tokens_, targets = {("a",): 100, ("a", "b"): 50, ("b",): 20}, {"a": (0.5, 1), "b": (0.5, 3)}
    assert mixing.reachable(tokens_, targets, 10_000) == 211
    sent, flow = mixing.route(tokens_, targets, 120)
    assert sent == 120 and flow[("a",), "a"] == 60 and flow[("b",), "b"] + flow[("a", "b"), "b"] == 60 and flow[("b",), "b"] <= 20 and flow[("a", "b"), "b"] <= 50
    assert mixing.reachable({("a",): 10}, targets, 100) <= 1


def test_empty_mix(spark):
    df, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1, 0)], TARGETS)
    assert mixing.mix(df, targets).isEmpty() and mixing.mix(df, targets.limit(0)).isEmpty()
    assert mixing.shares(mixing.mix(df, targets), targets).first().tokens == 0


def test_capacities_that_would_be_lost(spark):
    sizes = spark.createDataFrame([(1, 5)], "doc_id bigint, n_tokens int")
    with pytest.raises(ValueError, match="two capacities"):
        packing.windows(sizes, spark.createDataFrame([("a", 10, 0), ("a", 20, 0)], CAPS))
    with pytest.raises(ValueError, match="more than 1000"):
        packing.windows(sizes, spark.createDataFrame([(f"w{i}", 10, 0) for i in range(1001)], CAPS))
    twice = spark.createDataFrame([("a", 10, 0), ("a", 10, 1)], CAPS)
    assert packing.unused(packing.windows(sizes, twice), twice).count() == 1


def test_short_sources_hold_nothing_up(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "ab"[i % 2], f"k{i}", 10, "x") for i in range(200)] + [(500, "few", "f", 10, "x")], DOCS)
    targets = spark.createDataFrame([("a", 0.49, 1, 0), ("b", 0.4, 1, 0), ("absent", 0.02, 3, 0), ("few", 0.09, 2, 0)], TARGETS)
    shares = {x.source: x for x in mixing.shares(mixing.mix(docs, targets), targets).collect()}
    assert shares["absent"].tokens == 0 and shares["few"].tokens == 20 and shares["few"].most_uses == 2
    assert shares["a"].tokens >= 980 and abs(shares["a"].tokens / shares["b"].tokens - 49 / 40) < 0.03
    # more combinations of sources than the flow takes: the others count for their first source
    both = docs.unionByName(spark.createDataFrame([(1000 + i, s, f"k{i}", 10, "x") for i, s in ((0, "b"), (2, "few"), (4, "absent"))], DOCS))
    monkeypatch.setattr(mixing, "PATTERNS", 4)
    again = mixing.mix(both, targets).collect()
    assert sum(x.n_tokens * x.n_uses for x in again) > 1800 and len({(x.source, x.doc_id) for x in again}) == len(again)
    with pytest.raises(ValueError):
        mixing.mix(docs, targets.unionByName(spark.createDataFrame([("a", 0.1, 1, 0)], TARGETS)))


def test_combinations_beyond_those_broadcast_keep_all_their_sources(spark, monkeypatch):
    r = random.Random(4)
    docs = [(i, s, f"k{i // 10}", 20 + i // 10 % 7, "x") for i in range(0, 3000, 10) for s in r.sample("abcdef", r.randint(1, 4))]
    docs = spark.createDataFrame([(n, *d[1:]) for n, d in enumerate(docs)], DOCS)
    targets = spark.createDataFrame([(s, 1 / 6, 2, 0) for s in "abcdef"], TARGETS)
    mixed = lambda: sorted(tuple(x) for x in mixing.mix(docs, targets).collect())
    want = mixed()
    few = spark.createDataFrame([(i, "ab"[i % 2], f"k{i}", 100, "x") for i in range(100)] + [(200 + i, s, f"m{i % 9}", 30, "x") for i, s in enumerate("ab" * 9)] + [(400, "a", "z", 9, "x"), (401, "z", "z", 9, "x")], DOCS)
    monkeypatch.setattr(mixing, "PATTERNS", 3)
    # more targets and far more combinations than are broadcast
    assert mixed() == want and len({x[0] for x in want}) == 6
    # z's only text is in the rarest combination
    got = mixing.mix(few, spark.createDataFrame([("a", 0.5, 1, 0), ("b", 0.49, 1, 0), ("z", 0.01, 1, 0)], TARGETS)).collect()
    assert [(x.doc_id, x.n_uses) for x in got if x.source == "z"] == [(401, 1)]


def test_flow_takes_any_number_of_combinations():
    """Against the best of all ways to give each pattern's tokens to its sources."""
    import itertools

    r = random.Random(6)
    for _ in range(30):
        targets = {s: (1 / 3, r.randint(1, 2)) for s in "abc"}
        tokens_ = {p: r.randint(1, 3) for p in (("a",), ("a", "b"), ("b", "c"), ("a", "b", "c")) if r.random() < 0.8}
        quota, best = mixing.asked(targets, 9), (0, 0)
        uses = {p: n * min(targets[s][1] for s in p) for p, n in tokens_.items()}
        ways = [[w for w in itertools.product(range(4), repeat=len(p)) if sum(w) <= uses[p]] for p in tokens_]
        for way in itertools.product(*ways):
            got = dict.fromkeys("abc", 0)
            for p, w in zip(tokens_, way):
                for s, n in zip(p, w):
                    got[s] += n
            if all(got[s] <= quota[s] for s in got):
                best = max(best, (sum(got.values()), -sum(max(0, sum(w) - n) for n, w in zip(tokens_.values(), way))))
        sent, flow = mixing.route(tokens_, targets, 9)
        used = defaultdict(int)
        for (p, s), n in flow.items():
            used[p] += n
        assert (sent, -sum(max(0, n - tokens_[p]) for p, n in used.items())) == best
