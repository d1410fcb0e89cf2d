"""Texts packed into windows of a fixed capacity, sized in tokens.

Method: sum-of-squares online packing (Csirik, Johnson, Kenyon, Orlin, Shor, Weber 2006). The level array counts the
partially filled windows of each fill level; an item goes to the level where the sum of the squared counts ends least,
a new window being level 0. Items come in the order of a hash, in shards of about `SHARD` items, each packed in one
task; what the shards leave in windows filled to under `LOOSE` of the capacity is packed once more, in fewer shards.

Cases. Only texts above the capacity are split, into full windows and a rest that is packed like any item. Null and
empty texts have no tokens and are in no window. Redelivered rows (equal doc_id) count once; equal texts under other
ids are items of their own. Ties between levels go to the fullest. An empty table, or no capacities, gives no rows; a
capacity below 1, a window_name with two capacities and more than `CAPACITIES` capacities are errors; equal rows of
capacities count once. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

SHARD, LOOSE, CAPACITIES = 40_000, 0.93, 1_000


def pack(sizes: Sequence[int], capacity: int) -> np.ndarray:
    """The window number of each item; sizes are from 1 to capacity."""
    count = np.zeros(capacity + 1)
    count[0], count[capacity] = 0.5, -0.5  # a new window, and a full one, in one formula with the others
    usable = np.full(capacity + 1, -np.inf)
    usable[0] = 0.5
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), np.int64)
    made = 0
    for k, s in enumerate(sizes):
        change = count[s:] - usable[: capacity + 1 - s]
        level = capacity - s - int(np.argmin(change[::-1]))
        if level:
            window = open_[level].pop()
            count[level] -= 1
            usable[level] = count[level] or -np.inf
        else:
            window, made = made, made + 1
        out[k] = window
        level += s
        if level < capacity:
            open_[level].append(window)
            count[level] += 1
            usable[level] = count[level]
    return out


def _packed(items: DataFrame, name: str, shards: int) -> DataFrame:
    """items with their window, named by shard; each shard is one group of about SHARD items."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id", "piece"], kind="stable")
        pdf["window"] = [f"{name}{pdf['shard'].iloc[0]}-{w}" for w in pack(pdf["n_tokens"].tolist(), int(pdf["capacity"].iloc[0]))]
        return pdf.drop(columns=["shard"])

    keyed = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(name)), F.lit(shards)))
    schema = ", ".join(f"{k} {t}" for k, t in items.dtypes) + ", window string"
    return keyed.groupBy("window_name", "shard").applyInPandas(run, schema)


def windows(sizes: DataFrame, capacities: DataFrame, shard: int = SHARD) -> DataFrame:
    """(window_name, window, doc_id, piece, first_token, n_tokens) of each item, from (doc_id, n_tokens) and (window_name, capacity_tokens)."""
    rows = capacities.select("window_name", "capacity_tokens").filter("capacity_tokens is not null").distinct().limit(CAPACITIES + 1).collect()
    if len(rows) > CAPACITIES:
        raise ValueError(f"more than {CAPACITIES} capacities")
    limits = {r[0]: int(r[1]) for r in rows}
    if len(limits) < len(rows):
        raise ValueError("a window_name has two capacities")
    if any(c < 1 for c in limits.values()):
        raise ValueError("a window holds at least one token")
    names = F.array(*[F.struct(F.lit(n).alias("window_name"), F.lit(c).alias("capacity")) for n, c in sorted(limits.items())]) if limits else F.expr("cast(array() as array<struct<window_name: string, capacity: int>>)")
    once = sizes.filter("n_tokens > 0").dropDuplicates(["doc_id"])
    every = once.select("doc_id", "n_tokens", F.inline(names))
    pieces = every.select(
        "window_name", "capacity", "doc_id", F.xxhash64("doc_id").alias("order"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_tokens") - 1) / F.col("capacity")))).alias("piece"), F.col("n_tokens").alias("total")
    )
    first = F.col("piece") * F.col("capacity")
    items = cut(pieces.select("window_name", "capacity", "doc_id", "order", "piece", first.alias("first_token"), F.least(F.col("capacity").cast("bigint"), F.col("total") - first).alias("n_tokens")))
    full = items.filter("n_tokens = capacity").withColumn("window", F.concat_ws("-", F.lit("f"), "doc_id", "piece"))
    rest = items.filter("n_tokens < capacity")
    n = rest.count() // max(1, len(limits))
    packed = cut(_packed(rest, "a", n // shard + 1))
    if n > shard:
        fill = packed.groupBy("window_name", "window").agg((F.sum("n_tokens") / F.first("capacity")).alias("fill")).filter(F.col("fill") < LOOSE).drop("fill")
        loose = packed.join(fill, ["window_name", "window"], "left_semi").drop("window")
        m = loose.count() // max(1, len(limits))
        packed = packed.join(fill, ["window_name", "window"], "left_anti").unionByName(_packed(loose, "b", m // shard + 1))
    return full.unionByName(packed).select("window_name", "window", "doc_id", "piece", "first_token", "n_tokens")


def unused(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """For each capacity: windows, tokens, unused tokens and their share."""
    each = packed.groupBy("window_name", "window").agg(F.sum("n_tokens").alias("n"))
    total = each.groupBy("window_name").agg(F.count("*").alias("n_windows"), F.sum("n").alias("n_tokens"), F.max("n").alias("most_tokens")).join(capacities.select("window_name", "capacity_tokens").distinct(), "window_name")
    space = F.col("n_windows") * F.col("capacity_tokens")
    return total.select("window_name", "n_windows", "n_tokens", "most_tokens", (space - F.col("n_tokens")).alias("unused_tokens"), ((space - F.col("n_tokens")) / space).alias("unused_share"))
