"""Connected components of a set of links, without a driver-side or one-task step.

Alternates the large-star and small-star operations of Kiveris et al., "Connected Components in MapReduce and Beyond"
(2014): each step moves the neighbours of a node to their smallest neighbour, by a partially aggregated minimum and a
join. The number of rounds grows with the logarithm of the number of nodes; links are cut by checkpoint each round. It
ends when the links are stars, which is looked up in the links themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node of its component. Loops are ignored."""
    links = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while not _starred(links):
        both = _each(links, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _each(large.join(low, "u"), ("v", "m"), ("u", "m"))
        links = cut(small.filter("u <> v").distinct())
    return _each(links, ("u", "v"), ("v", "v")).toDF("node", "root").distinct()


def _starred(links: DataFrame) -> bool:
    """Whether every node has one link downwards at most, to a node that has none: then nothing would change any more."""
    sides = links.select(F.inline(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("in")))))
    return sides.groupBy("n").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 or (out = 1 and in = 1)").isEmpty()


def _each(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """A row (u, v) of each pair of columns of each row, in one pass."""
    return rows.select(F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])).alias("e")).select("e.u", "e.v")
