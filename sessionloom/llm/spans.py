"""Long exact spans that contents share, found with compressed full-text indexes of shards.

A character is shared when it lies in a stretch of `least` characters that stands verbatim in another content too.
Every such stretch holds an anchor, the least hash of its `probe`-character windows (winnowing; Schleimer, Wilkerson,
Aiken 2003), and all contents with the stretch hold the same one. So only the surroundings of anchors that two
contents have, at most `least` characters to either side, can hold shared characters; these regions are sharded by
anchor, so that both sides of every shared stretch meet in a shard. Each shard gets an FM-index (`fmindex`), its
regions are streamed through it by backward search, and matching statistics of `least` or more are reported.

Anchors of one neighbourhood get one label, the smallest of two rounds of exchange between contents and anchors, so
that a region is sent once and not once per anchor; any labels give the same result. Labels with more than a shard of
text fall back to their single anchors; an anchor that still has more, a passage that a large part of all contents
holds, is resolved without gathering: the hashes of all its stretches are counted with partial aggregation.

Cases. Redelivered results count once. Nulls and contents shorter than `least` have no spans. A content that several results have in equal form is
shared as a whole. A stretch that repeats within one content only is not shared. Spans that touch are one span.
Positions count code points from 0. Very long contents are processed whole, in overlapping lanes. Empty tables give
no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut
from .fmindex import shared_stretches
from .neardup import parted
from .semijoin import sifted
from .words import chunks, mix, points, powers

LEAST, PROBE = 240, 32
SHARD = 1_500_000


def _gram_hashes(code: np.ndarray, k: int) -> np.ndarray:
    """The hash of each window of k code points."""
    n = code.size - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * powers(code.size), dtype=np.uint64)])
    return mix((prefix[k:] - prefix[:-k]) * powers(n, inverse=True))


def _slide(x: np.ndarray, w: int, best: np.ufunc, fill: int) -> np.ndarray:
    """best over each window of w values: prefix and suffix runs within blocks of w."""
    n = x.size - w + 1
    padded = np.concatenate([x, np.full(-x.size % w, fill, x.dtype)]).reshape(-1, w)
    forth = best.accumulate(padded, axis=1).ravel()
    back = best.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[:n], forth[w - 1 : w - 1 + n])


def anchors(texts: list[str], least: int = LEAST, probe: int = PROBE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, count per text) of the anchors: each run of `least` characters of a text holds one."""
    sizes = np.array([len(t) for t in texts])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    h, w = _gram_hashes(points("".join(texts)), probe), least - probe + 1
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(len(texts), np.int64))
    if h.size < w:
        return none
    low = _slide(h, w, np.minimum, 2**64 - 1)
    inside = np.zeros(h.size + 1, np.int32)
    ok = sizes >= least
    np.add.at(inside, begin[ok], 1)
    np.add.at(inside, (begin + sizes - least + 1)[ok], -1)
    low[np.cumsum(inside)[: low.size] == 0] = 0
    low = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero((_slide(low, w, np.maximum, 0)[: h.size] == h) & (h != 0))
    text = np.searchsorted(begin + sizes, at, side="right")
    return h[at], (at - begin[text]).astype(np.int32), np.bincount(text, minlength=len(texts))


_PRINTS = "tool_use_id string, node bigint, node2 bigint, size int, anchors array<bigint>, positions array<int>"


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for a, b in chunks(texts):
            part = texts[a:b]
            h, at, count = anchors(part)
            node = np.frombuffer(b"".join(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in part), np.int64).reshape(-1, 2)
            ends = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (h.view(np.int64), at)]
            yield pa.RecordBatch.from_arrays([ids[a:b], *(pa.array(node[:, k].copy()) for k in (0, 1)), pa.array([len(t) for t in part], pa.int32()), *lists], names=["tool_use_id", "node", "node2", "size", "anchors", "positions"])


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Content and its labelled anchor positions -> the text around each label's anchors."""
    for batch in batches:
        out: list[tuple[int, int, int, str]] = []
        for node, text, marks in zip(*(batch.column(i).to_pylist() for i in range(3))):
            by: dict[int, list[int]] = {}
            for m in marks:
                by.setdefault(m["label"], []).append(m["pos"])
            for label, found in by.items():
                start = end = -1
                for pos in sorted(found):
                    a, b = max(0, pos + PROBE - LEAST), min(len(text), pos + LEAST)
                    if a > end:
                        if end > 0:
                            out.append((label, node, start, text[start:end]))
                        start = a
                    end = b
                out.append((label, node, start, text[start:end]))
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["label", "node", "start", "region"])


def _shard(table: pa.Table) -> pa.Table:
    nodes, starts = table.column("node").to_numpy(), table.column("start").to_numpy()
    texts = [points(t) for t in table.column("region").to_pylist()]
    _, owner = np.unique(nodes, return_inverse=True)
    found = shared_stretches(texts, owner, LEAST, PROBE)
    k, a, b = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    return pa.table({"node": pa.array(nodes[k], pa.int64()), "start": pa.array(starts[k] + a, pa.int64()), "end": pa.array(starts[k] + b, pa.int64())})


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Content and positions of crowded anchors -> the hash of each stretch around them, to be counted."""
    for batch in batches:
        for node, text, marks in zip(*(batch.column(i).to_pylist() for i in range(3))):
            h = _gram_hashes(points(text), LEAST)
            at = np.unique(np.concatenate([np.arange(max(0, m["pos"] + PROBE - LEAST), min(m["pos"] + 1, h.size)) for m in marks]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(at.size, node, np.int64)), pa.array(h[at].view(np.int64)), pa.array(at)], names=["node", "stretch", "start"])


def _labelled(shared: DataFrame, rounds: int = 2) -> DataFrame:
    """shared (anchor, node, pos) with a label per anchor: the smallest anchor near it, by rounds of exchange."""
    marks = shared.select("anchor", "node").distinct()
    label = marks.select("anchor", "node", F.col("anchor").alias("label"))
    for _ in range(rounds):
        node = label.groupBy("node").agg(F.min("label").alias("label"))
        anchor = marks.join(node, "node").groupBy("anchor").agg(F.min("label").alias("label"))
        label = marks.join(anchor, "anchor")
    return shared.join(label.select("anchor", "label").distinct(), "anchor")


def spans(results: DataFrame) -> DataFrame:
    """(tool_use_id, span_start, span_end) of the maximal shared stretches, from (tool_use_id, content)."""
    spark = results.sparkSession
    long = results.select("tool_use_id", "content").filter((F.length("content") >= LEAST) & F.col("tool_use_id").isNotNull())
    prints = parted(cut(long.mapInArrow(_prints, _PRINTS)))
    nodes = prints.groupBy("node").agg(F.min("tool_use_id").alias("tool_use_id"), F.max("tool_use_id").alias("last_id"), F.first("size").alias("size"), F.first("anchors").alias("anchors"), F.first("positions").alias("positions"))
    marks = nodes.select("node", F.inline(F.arrays_zip(F.col("anchors").alias("anchor"), F.col("positions").alias("pos"))))
    marks = marks.toDF("node", "anchor", "pos")
    common = marks.groupBy("anchor").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("anchor")
    shared = cut(marks.join(common, "anchor"))
    labelled = cut(_labelled(shared))

    width = 2 * LEAST - PROBE
    extent = lambda *key: labelled.groupBy("node", *key).agg(F.least(F.count("*") * width, F.max("pos") - F.min("pos") + width).alias("chars")).groupBy(*key).agg(F.sum("chars").alias("chars"))
    wide = extent("label").filter(F.col("chars") > SHARD).select("label", F.lit(True).alias("wide"))
    single = labelled.join(wide, "label", "left").withColumn("label", F.when(F.col("wide"), F.col("anchor")).otherwise(F.col("label"))).drop("wide")
    crowd = labelled.join(wide, "label", "left_semi").groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") * width > SHARD).select("anchor", F.lit(True).alias("crowded"))
    single = cut(single.join(crowd, "anchor", "left").select("node", "label", "pos", F.coalesce("crowded", F.lit(False)).alias("crowded")))
    total, crowded = single.agg(F.sum(F.when(~F.col("crowded"), width)), F.coalesce(F.max("crowded"), F.lit(False))).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((total or 0) * 0.6 / SHARD) + 1)

    where = single.groupBy("node", "crowded").agg(F.collect_list(F.struct("label", "pos")).alias("marks"))
    first = nodes.select("node", "tool_use_id")
    wanted = cut(where.join(first, "node"))
    texts = wanted.join(sifted(long, wanted, "tool_use_id", ["content"]), "tool_use_id").dropDuplicates(["node", "crowded"]).select("node", "content", "marks", "crowded")
    regions = texts.filter("not crowded").drop("crowded").mapInArrow(_regions, "label bigint, node bigint, start int, region string")
    found = regions.withColumn("shard", F.pmod(F.xxhash64("label"), F.lit(shards))).groupBy("shard").applyInArrow(lambda t: _shard(t), "node bigint, start bigint, end bigint")
    if crowded:
        every = texts.filter("crowded").drop("crowded").mapInArrow(_stretches, "node bigint, stretch bigint, start bigint")
        twice = every.groupBy("stretch").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("stretch")
        found = found.unionByName(every.join(twice, "stretch").select("node", "start", (F.col("start") + LEAST).alias("end")))
    copied = nodes.filter("tool_use_id <> last_id")
    found = found.join(copied, "node", "left_anti").unionByName(copied.select("node", F.lit(0).cast("bigint").alias("start"), F.col("size").cast("bigint").alias("end")))
    return prints.select("tool_use_id", "node").distinct().join(merged(found), "node").select("tool_use_id", F.col("start").cast("int").alias("span_start"), F.col("end").cast("int").alias("span_end"))


def merged(found: DataFrame) -> DataFrame:
    """Intervals (node, start, end) united where they overlap or touch."""
    at = W.partitionBy("node").orderBy("start", "end")
    before = F.max("end").over(at.rowsBetween(W.unboundedPreceding, -1))
    new = found.withColumn("new", F.when(before >= F.col("start"), 0).otherwise(1))
    return new.withColumn("k", F.sum("new").over(at.rowsBetween(W.unboundedPreceding, 0))).groupBy("node", "k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("k")


def shares(results: DataFrame, found: DataFrame) -> DataFrame:
    """For each result its length, its shared characters and their share, 0 where nothing is shared."""
    sizes = results.groupBy("tool_use_id").agg(F.max(F.length("content")).alias("n_chars"))
    shared = found.groupBy("tool_use_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count("*").alias("n_spans"))
    filled = sizes.join(shared, "tool_use_id", "left").na.fill(0, ["shared_chars", "n_spans", "n_chars"])
    return filled.withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))
