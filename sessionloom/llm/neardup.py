"""Near-duplicates: groups of contents whose sets of word sequences have a similarity of at least a threshold.

Method: covering locality-sensitive hashing. A set becomes a vector of `SYMBOLS` minwise symbols of 32 bits; the masks
cover whole symbols and are structured as a Turan design: symbols stand in `BLOCKS` blocks, and each mask shows two
symbols of one block. Of any BLOCKS + 1 equal symbols two share a block, so every pair of vectors that differ in at
most SYMBOLS - BLOCKS - 1 = 23 of 32 symbols surely collides in some table. A pair of similarity 0.7 differs in more than
23 symbols with a probability of 2e-7 (0.8: 1e-11); applied to the sets themselves, the radius would be some tens of
bits and the number of masks for a sure collision exponential in it, which is why vectors are covered.

Candidates are verified exactly, on the sets. Equal sets are one class before anything is hashed, by a partially
aggregated key, so copies never meet in pairs. In a table's bucket of up to `SMALL` classes all pairs are candidates,
in larger ones the smallest class with each other one, and, in a second round, each class outside the bucket's
largest group with the classes of other groups: no link between different groups is lost and buckets stay linear
where they hold one family. A bucket that a sample shows to be hot is never sent to one task; its members get the
smallest class from a broadcast of at most `HOT_KEYS` keys.

Cases. Redelivered results count once. Nulls and contents of under `least` characters are in no group. Contents with
fewer than three words have no sequences and are grouped only with equal contents. Very long texts are hashed
whole. keep_id is the smallest id of a group. Empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut, release
from .components import components
from .semijoin import sifted
from .words import chunks, mix, shingle_sets

SYMBOLS, BLOCKS = 32, 8
LEAST, WORDS, THRESHOLD = 80, 3, 0.7
SMALL, BLOCK, PART = 48, 512, 8_192
HOT_KEYS, HOT_ROWS, SAMPLE = 10_000, 200_000, 64


def masks(symbols: int = SYMBOLS, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """The pairs of symbols that the masks show: all pairs within each block."""
    size = symbols // blocks
    return [(b * size + i, b * size + j) for b in range(blocks) for i in range(size) for j in range(i + 1, size)]


_SEEDS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sketches(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minwise vectors (rows of SYMBOLS 32-bit symbols) and two 64-bit hashes of each set; counts must be positive."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    vectors = np.empty((len(counts), SYMBOLS), np.uint32)
    for i, seed in enumerate(_SEEDS):
        x = hashes * seed
        x ^= x >> np.uint64(29)
        x *= seed
        vectors[:, i] = np.minimum.reduceat(x >> np.uint64(8), starts).astype(np.uint64) & np.uint64(0xFFFFFFFF)
    whole = np.stack([np.add.reduceat(mix(hashes + np.uint64(s)), starts) for s in (0, 1)], axis=1)
    return vectors, whole


_PRINTS = "tool_use_id string, node bigint, node2 bigint, vector array<int>"


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for a, b in chunks(texts):
            hashes, counts = shingle_sets(texts[a:b], WORDS)
            whole = np.zeros((b - a, 2), np.int64)
            vectors = np.zeros((b - a, SYMBOLS), np.int32)
            some = np.flatnonzero(counts)
            if some.size:
                v, w = sketches(hashes, counts[some])
                vectors[some], whole[some] = v.view(np.int32), w.view(np.int64)
            for i in np.flatnonzero(counts == 0):
                whole[i] = np.frombuffer(blake2b(texts[a + i].encode("utf-8", "surrogatepass"), digest_size=16).digest(), np.int64)
            ends = np.concatenate([[0], np.cumsum(np.where(counts > 0, SYMBOLS, 0))]).astype(np.int32)
            vector = pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors[some].ravel()))
            yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(whole[:, 0].copy()), pa.array(whole[:, 1].copy()), vector], names=["tool_use_id", "node", "node2", "vector"])


_SETS = "tool_use_id string, shingles array<int>"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for a, b in chunks(texts):
            hashes, counts = shingle_sets(texts[a:b], WORDS)
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids[a:b], pa.ListArray.from_arrays(pa.array(ends), pa.array((hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))], names=["tool_use_id", "shingles"])


def parted(prints: DataFrame) -> DataFrame:
    """prints, where sets that share a node but not their second hash take that for their node: a node is one set by 128 bits."""
    clash = prints.groupBy("node").agg(F.min("node2").alias("a"), F.max("node2").alias("b")).filter("a <> b").select("node", F.lit(True).alias("clash"))
    if clash.isEmpty():
        return prints
    return cut(prints.join(clash, "node", "left").withColumn("node", F.when(F.col("clash"), F.col("node2")).otherwise(F.col("node"))).drop("clash"))


def _signatures(classes: DataFrame) -> DataFrame:
    """(key, node): the masked vector of each class in each table."""
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("vector")[i], F.col("vector")[j]) for t, (i, j) in enumerate(masks())])
    return classes.filter("size(vector) > 0").select(F.explode(keys).alias("key"), "node")


def _hot(classes: DataFrame) -> DataFrame | None:
    """(key, first) of the buckets that a sample of the classes shows to be hot, or None; at most HOT_KEYS."""
    sample = _signatures(classes.filter(F.pmod("node", F.lit(SAMPLE)) == 0)).groupBy("key").agg(F.count("*").alias("n"))
    keys = [r.key for r in sample.filter(F.col("n") * SAMPLE > HOT_ROWS).orderBy(F.desc("n")).limit(HOT_KEYS).collect()]
    if not keys:
        return None
    hot = classes.sparkSession.createDataFrame([(k,) for k in keys], "key bigint")
    return cut(_signatures(classes).join(F.broadcast(hot), "key").groupBy("key").agg(F.min("node").alias("first")))


def buckets(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(key, node, n, first) of the buckets with two classes or more, and the hot ones apart."""
    signatures, hot = _signatures(classes), _hot(classes)
    if hot is not None:
        signatures = signatures.join(F.broadcast(hot.select("key")), "key", "left_anti")
    own = W.partitionBy("key")
    return signatures.select("key", "node", F.count("*").over(own).alias("n"), F.min("node").over(own).alias("first")).filter("n > 1"), hot


def _pairs(found: DataFrame) -> DataFrame:
    """(a, b, crowd): all pairs of small buckets, those with the first class in crowded ones, with their key; one pass over the buckets."""
    crowded = F.col("n") > SMALL
    rows = found.groupBy("key", "first", crowded.alias("crowded"), F.when(crowded, F.col("node")).alias("alone")).agg(F.sort_array(F.collect_list("node")).alias("m"))
    within = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    star = F.filter(F.transform("m", lambda y: F.struct(F.col("first").alias("a"), y.alias("b"))), lambda p: p["a"] != p["b"])
    return rows.select(F.explode(F.when(F.col("crowded"), star).otherwise(within)).alias("p"), F.when(F.col("crowded"), F.col("key")).alias("crowd")).select("p.a", "p.b", "crowd")


def _verified(pairs: DataFrame, classes: DataFrame, contents: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: first within the covered radius, then exactly."""
    vectors = classes.select("node", "vector")
    close = (
        pairs.join(vectors.withColumnsRenamed({"node": "a", "vector": "va"}), "a")
        .join(vectors.withColumnsRenamed({"node": "b", "vector": "vb"}), "b")
        .filter(F.size(F.filter(F.zip_with("va", "vb", lambda x, y: x == y), lambda e: e)) > BLOCKS)
        .select("a", "b")
    )
    close = cut(close)
    nodes = close.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = cut(nodes.join(classes.select("node", "tool_use_id"), "node"))
    sets = sifted(contents, ids, "tool_use_id", ["content"], _sets, _SETS).join(ids, "tool_use_id").select("node", "shingles").dropDuplicates(["node"])
    sets = cut(sets)
    both = close.join(sets.withColumnsRenamed({"node": "a", "shingles": "sa"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "sb"}), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(common >= threshold * (F.size("sa") + F.size("sb") - common) - 1e-9).select("a", "b")


def groups(results: DataFrame, threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """(keep_id, member_id) of near-duplicate contents, from (tool_use_id, content)."""
    long = results.select("tool_use_id", "content").filter((F.length("content") >= least) & F.col("tool_use_id").isNotNull())
    prints = parted(cut(long.mapInArrow(_prints, _PRINTS)))
    ids = prints.select("tool_use_id", "node").dropDuplicates(["tool_use_id"])
    classes = cut(prints.groupBy("node").agg(F.min("tool_use_id").alias("tool_use_id"), F.first("vector").alias("vector")))
    found, hot = buckets(classes)
    pairs = _pairs(found)
    if hot is not None:
        star = _signatures(classes).join(F.broadcast(hot), "key").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"), F.col("key").alias("crowd"))
        pairs = pairs.unionByName(star)
    # collect_set: a pair meets at most once in each table
    pairs = cut(pairs.groupBy("a", "b").agg(F.collect_set("crowd").alias("crowds")))
    release(results.sparkSession)
    links = cut(_verified(pairs.select("a", "b"), classes, long, threshold))
    release(results.sparkSession)
    roots = components(links)
    crowded = pairs.filter("size(crowds) > 0")
    if not crowded.isEmpty():
        members = crowded.select(F.explode("crowds").alias("key"), "a", "b").select("key", F.explode(F.array("a", "b")).alias("node")).distinct()
        across = cut(_across(members, roots, classes))
        if not across.isEmpty():
            roots = components(links.unionByName(_verified(across, classes, long, threshold)))
    label = ids.join(roots, ids["node"] == roots["node"], "left").select("tool_use_id", F.coalesce("root", ids["node"]).alias("root"))
    kept = label.groupBy("root").agg(F.min("tool_use_id").alias("keep_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return label.join(kept, "root").filter("tool_use_id <> keep_id").select("keep_id", F.col("tool_use_id").alias("member_id"))


def _across(crowded: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """Of each crowded bucket, the pairs within the covered radius between different groups.

    The members outside a bucket's largest group are compared, in blocks, with the members of other groups; only
    pairs within the radius leave the task. A task compares one part of them with one part of all members, about `PART`
    rows of each, so that none holds a whole bucket.
    """
    labelled = crowded.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = labelled.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("groups")).filter("groups > 1")
    parts = sizes.join(main.select("key", "main"), "key").groupBy("key").agg(F.first("main").alias("main"), F.ceil(F.sum("n") / PART).cast("int").alias("parts"), F.ceil(F.sum(F.when(F.col("root") != F.col("main"), F.col("n"))) / PART).cast("int").alias("asking"))
    rows = _tasks(labelled.join(parts, "key")).join(classes.select("node", "vector"), "node")

    def near(table: pa.Table) -> pa.Table:
        node, root, asks = (table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "root", "asks"))
        vectors = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, SYMBOLS)
        asking, members, found = np.flatnonzero(asks), np.flatnonzero(~asks), []
        for k in range(0, asking.size, BLOCK):
            part = asking[k : k + BLOCK]
            same = np.zeros((part.size, members.size), np.int8)
            for t in range(SYMBOLS):
                same += vectors[part, t][:, None] == vectors[members, t][None, :]
            x, y = np.nonzero((same > BLOCKS) & (root[part][:, None] != root[members][None, :]))
            found.append(np.stack([node[part[x]], node[members[y]]]))
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return rows.groupBy("key", "ask", "part").applyInArrow(near, "a bigint, b bigint").distinct()


def _tasks(labelled: DataFrame) -> DataFrame:
    """The rows of each task (key, ask, part): once as asking ones for every part of the members, once as members for every part of the asking."""
    part = lambda n: F.pmod(F.xxhash64("node"), n.cast("bigint")).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asking = labelled.filter("root <> main").select("key", "node", "root", F.lit(True).alias("asks"), part(F.col("asking")).alias("ask"), upto(F.col("parts")).alias("part"))
    members = labelled.select("key", "node", "root", F.lit(False).alias("asks"), part(F.col("parts")).alias("part"), upto(F.col("asking")).alias("ask"))
    return asking.unionByName(members)
