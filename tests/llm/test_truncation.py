import random

from sessionloom.llm import truncation as t

DOCS = "doc_id bigint, text string, source string, chars string, own double"


def corpus(n=1500, seed=4):
    """Notes of whole sentences; those of source `cut` longer than 300 characters are cut there, some elsewhere in transfer."""
    r = random.Random(seed)
    names = ["".join(r.choice("aeioubdgklmnrst") for _ in range(r.randint(4, 9))) for _ in range(150)]
    forms = ["The {} of {} was read again after the turn had ended.", "When {} restarts, the window is rebuilt from {} and the rest stays as it was!", "Did {} ever reach the end of {} before the others came?", "Nobody saw that {} keeps its own copy next to {}."]
    rows, truth = [], set()
    for i in range(n):
        lines = [" ".join(r.choice(forms).format(r.choice(names), r.choice(names)) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 4))]
        if i % 5 == 0:
            lines.append("\n".join(f"- {r.choice(names)} {r.choice(names)} ({r.randint(1, 99)})" for _ in range(3)))
        text, source = "\n\n".join(lines), "cut" if i % 2 else "whole"
        if source == "cut" and len(text) > 300:
            truth |= {i} if text[299] not in ".!?)" and text[300] != "\n" else set()
            text = text[:300]
        elif i % 10 == 4:
            text = text[: r.randint(40, len(text) - 10)]
            truth |= {i} if text[-1] not in ".!?)\n" and len(text.split("\n")[-1]) > 4 else set()
        rows.append((i, text, source, "x", 0.0))
    return rows, truth


def test_found_and_rates(spark):
    rows, truth = corpus()
    repeats = [(5000 + i, rows[i][1], "other", "x", 0.0) for i in sorted(truth)[:20]]
    df = spark.createDataFrame([*rows, *repeats, (9000, None, "cut", "x", 0.0), (9001, "", "cut", "x", 0.0), (9002, "  \n", None, "x", 0.0), (9003, "word " * 60_000 + "end.", "whole", "x", 0.0)], DOCS)
    limits = {r.source: r.chars for r in t.limits(df.select("doc_id", "text", "source")).collect()}
    assert 300 in limits["cut"] and 300 not in limits.get("whole", [])
    found = {r.doc_id for r in t.truncated(df).collect()}
    mine = {i for i in found if i < 5000}
    assert len(mine & truth) / len(truth) > 0.9 and len(mine & truth) / len(mine) > 0.9
    assert {5000 + i for i in sorted(truth)[:20] if i in found} == {i for i in found if 5000 <= i < 9000} and not found & {9000, 9001, 9002, 9003}
    rates = {r.source: r for r in t.rates(df).collect()}
    assert rates["cut"].rate > 0.5 > rates["whole"].rate and sum(r.n_docs for r in rates.values()) == df.count()


def test_held_out_accuracy():
    rows, _ = corpus(1200, 8)
    whole = [(r[1], [300], [300]) for r in rows if r[2] == "whole"]
    model, random_ = t.fit(whole[:400]), random.Random(1)
    made = [(model.score(x, [300], [300]), y) for text, c, o in whole[400:] for x, y, _, _ in t.examples(text, c, o, random_)]
    right = sum((p >= 0.5) == y for p, y in made)
    assert right / len(made) > 0.93


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert t.truncated(df).isEmpty() and t.rates(df).isEmpty()
    assert t.truncated(spark.createDataFrame([(1, None, None, "x", 0.0)], DOCS)).isEmpty()


def test_long_last_lines_and_many_limits(spark):
    words = t.Vocabulary([])
    hashed = lambda x: t.crc32(x.encode()) & ((1 << t.BITS) - 1)
    found = t.features("intro\n\n- (" + "word " * 1000 + "word", None, None, words)
    assert hashed("b|list") in found and hashed("p|list|1|0") in found
    lengths = [500 + 200 * i for i in range(40)]
    rows = [(100 * i + k, f"{i}-{k} ".ljust(n, "x"), "many", "x", 0.0) for i, n in enumerate(lengths) for k in range(8)]
    assert sorted(t.limits(spark.createDataFrame(rows, DOCS)).first().chars) == lengths
