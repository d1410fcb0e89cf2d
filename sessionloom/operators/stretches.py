"""Windows over a whole key in parts, so that no task sorts a key that holds a large share of all rows.

A part is a stretch of the order, named by a column `part` that grows with it. Windows run within (key, part); what
crosses a border is carried by tables of one row, or of a few, for each part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

STRETCH = 4096


def parted(df: DataFrame, by: str | Column, stretch: int = STRETCH) -> DataFrame:
    """df with its part: stretches of a number, here of a turn or of the order of arrival."""
    return df.withColumn("part", F.floor((F.col(by) if isinstance(by, str) else by) / stretch))


def ahead(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], k: int) -> DataFrame:
    """df with `next`: an array of k structs of `columns`, of the next rows of the key in order, null beyond its last.

    The first k rows of each part are also those that follow on the part before it; they join it as further rows.
    """
    row = F.struct(*columns)
    own = W.partitionBy(key, "part").orderBy(*order)
    heads = df.select(key, "part", *order, row.alias("row")).withColumn("n", F.row_number().over(own)).filter(F.col("n") <= k)
    line = W.partitionBy(key).orderBy("part", *order)
    follow = heads.withColumn("rows", F.array(F.col("row"), *[F.lead("row", i).over(line) for i in range(1, k)])).filter("n = 1")
    follow = follow.withColumn("to", F.lag("part").over(line)).filter("to is not null").select(key, F.col("to").alias("part"), F.posexplode("rows").alias("extra", "row")).filter("row is not null")
    dtypes = dict(df.dtypes)
    more = follow.select(*[F.col(c) if c in (key, "part") else F.lit(None).cast(t).alias(c) for c, t in dtypes.items()], "extra", "row")
    every = df.withColumn("extra", F.lit(-1)).withColumn("row", row).unionByName(more)
    within = W.partitionBy(key, "part").orderBy("extra", *order)
    return every.withColumn("next", F.array(*[F.lead("row", i).over(within) for i in range(1, k + 1)])).filter("extra < 0").drop("extra", "row")


def carried(df: DataFrame, key: str, order: Sequence[str], name: str, local: Column, total: Column, merge: str) -> DataFrame:
    """df with a running aggregate over the rows of the key before each, by order.

    local is the aggregate over the rows before it in its part, total the one over a part, merge (sum or max) joins them.
    """
    own, upto = W.partitionBy(key, "part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1), W.partitionBy(key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = df.groupBy(key, "part").agg(total.alias("t")).withColumn("earlier", getattr(F, merge)("t").over(upto)).select(F.col(key).alias("_of"), F.col("part").alias("_part"), "earlier")
    both = df.withColumn("inside", local.over(own)).join(parts, F.col(key).eqNullSafe(F.col("_of")) & F.col("part").eqNullSafe(F.col("_part")), "left").drop("_of", "_part")
    joined = F.greatest("inside", "earlier") if merge == "max" else F.coalesce("inside", F.lit(0)) + F.coalesce("earlier", F.lit(0))
    return both.withColumn(name, joined).drop("inside", "earlier")


def numbered(df: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """df with each row's number within its key, from 1."""
    return carried(df, key, order, name, F.count(F.lit(1)), F.count(F.lit(1)), "sum").withColumn(name, F.col(name) + 1)


def at_ranks(df: DataFrame, group: str, value: str, ranks: Sequence[Column], cells: int = 1024) -> DataFrame:
    """(group, n, v0, v1, ...): the values at the ranks (expressions over n, from 0) of each group's values in order.

    Values are counted in `cells` cells between a group's least and greatest; only the cells that hold a rank are
    counted by value, so that neither a group nor its distinct values meet in one task.
    """
    v = df.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    ends = v.groupBy(F.col("g").alias("eg")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    cell = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(cells - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells))).otherwise(F.lit(0)).cast("int")
    placed = v.join(ends, F.col("g").eqNullSafe(F.col("eg"))).select("g", "v", "n", cell.alias("cell"))
    upto = W.partitionBy("g").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)  # at most `cells` rows of a group
    cells_ = placed.groupBy("g", "cell").agg(F.count("*").alias("m"), F.first("n").alias("n")).withColumn("before", F.coalesce(F.sum("m").over(upto), F.lit(0)))
    wanted = cells_.select("*", F.posexplode(F.array(*ranks)).alias("which", "rank")).filter("rank >= before and rank < before + m").select("g", "cell", "which", "rank", "before", "n")
    here = placed.select("g", "cell", "v").join(wanted.withColumnsRenamed({"g": "wg", "cell": "wc"}), F.col("g").eqNullSafe(F.col("wg")) & (F.col("cell") == F.col("wc"))).groupBy("g", "n", "which", "rank", "before", "v").agg(F.count("*").alias("m"))
    sofar = F.sum("m").over(W.partitionBy("g", "which").orderBy("v"))
    hit = here.withColumn("end", F.col("before") + sofar).groupBy("g", "n", "which").agg(F.min(F.when(F.col("end") > F.col("rank"), F.col("v"))).alias("v"))
    picked = [F.max(F.when(F.col("which") == i, F.col("v"))).alias(f"v{i}") for i in range(len(ranks))]
    return hit.groupBy("g", "n").agg(*picked).withColumnRenamed("g", group)
