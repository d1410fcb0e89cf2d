"""Windows in parts against windows over whole keys."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sessionloom.operators import stretches


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(4)
    rows = [(k, t, p, r.choice("abc"), r.choice([None, r.randint(0, 9)])) for k in ("x", "y", None) for t in sorted(r.sample(range(60), 25)) for p in range(r.randint(1, 3))]
    return spark.createDataFrame(rows, "k string, turn int, pos int, v string, n int")


@pytest.mark.parametrize("stretch", [1, 3, 7, 1000])
def test_against_whole_windows(data, rows, stretch):
    line = W.partitionBy("k").orderBy("turn", "pos")
    parted = stretches.parted(data, "turn", stretch)
    got = stretches.ahead(parted, "k", ("turn", "pos"), ("v",), 2).select("k", "turn", "pos", F.col("next")[0]["v"], F.col("next")[1]["v"])
    # a null key is one key like the others
    assert rows(got) == rows(data.select("k", "turn", "pos", F.lead("v").over(line), F.lead("v", 2).over(line)))
    got = stretches.numbered(parted, "k", ("turn", "pos"), "i").select("k", "turn", "pos", "i")
    assert rows(got) == rows(data.select("k", "turn", "pos", F.row_number().over(line)))
    got = stretches.carried(parted, "k", ("turn", "pos"), "m", F.max("n"), F.max("n"), "max").select("k", "turn", "pos", "m")
    assert rows(got) == rows(data.select("k", "turn", "pos", F.max("n").over(line.rowsBetween(W.unboundedPreceding, -1))))


@pytest.mark.parametrize("cells", [1, 2, 64])
def test_ranks(spark, rows, cells):
    r = random.Random(1)
    values = [("a", r.choice([1.0, 1.0, 2.5, 7.0, r.random() * 9])) for _ in range(200)] + [("b", 3.0)] * 5 + [("c", None), (None, 2.0), (None, 1.0)]
    df = spark.createDataFrame(values, "g string, v double")
    got = rows(stretches.at_ranks(df, "g", "v", [F.lit(0), F.floor(F.col("n") / 2), F.col("n") - 1], cells))
    want = []
    for g in ("a", "b", None):
        x = sorted(v for k, v in values if k == g)
        want.append((g, len(x), x[0], x[len(x) // 2], x[-1]))
    assert got == sorted(want, key=repr)
    assert stretches.at_ranks(df.limit(0), "g", "v", [F.lit(0)]).isEmpty()
