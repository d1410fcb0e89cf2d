"""Pairs of texts of one key by the words they share.

Texts are dealt into units that one task holds: small keys together, the parts of a large key with each other, so that
each pair of a key meets in exactly one unit and no task holds a whole large key. Within a unit the common words of all
pairs are counted over the words' lists of texts; a pair that shares nothing costs nothing. Where that would take more
than `frequent` times the candidates of a prefix filter, the candidates alone are counted: words stand in order of
rarity within the unit, and a pair whose first common word is at places i and j of sets of a and b words shares at most
min(a - i, b - j). No pair is lost. Rows leave a unit in batches, as its pairs may be as many as the square of its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

TEXTS, WORDS, ROWS, STEP, TASKS, KEYS = 4096, 400_000, 50_000, 1 << 22, 2000, 10_000
_PAIRS = "key string, left_id string, right_id string, similarity double"


def _ranges(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low[0], low[0] + 1 ... of n[0] numbers, then those of low[1], and so on."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if ends.size else 0) + np.repeat(low - ends + n, n)


def _runs(n: np.ndarray, cells: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts that make at most STEP rows and `cells` texts, or are one text."""
    ends, at = np.cumsum(n), 0
    while at < n.size:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right"))
        yield at, (at := max(at + 1, min(upto, at + cells)))


class _Unit:
    """Texts of a unit in order of size, and the words that several of them have, in order of rarity."""

    def __init__(self, owner: np.ndarray, word: np.ndarray, sizes: np.ndarray, side: np.ndarray, least: float):
        """owner, word: the words of each text, without those of other keys in common; sizes in ascending order."""
        n = sizes.size
        word, count = np.unique(word, return_inverse=True, return_counts=True)[1:]
        rank = np.empty(count.size, np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(count.size)
        order = np.lexsort((rank[word], owner))
        self.owner, self.rank, shared = owner[order], rank[word][order], count[word][order] > 1
        first = np.cumsum(sizes) - sizes
        self.left = ((first + sizes)[self.owner] - np.arange(owner.size))[shared]
        self.owner, self.rank = self.owner[shared], self.rank[shared]
        self.n, self.words, self.sizes, self.side, self.least = n, count.size, sizes, side, least
        self.members = np.sort(self.owner * self.words + self.rank)

    def pairs(self, x_side: int, y_side: int, frequent: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(x, y, common words) of texts x < y of these sides that may be similar; -1 stands for both sides."""
        of = lambda side: np.ones(self.owner.size, bool) if side < 0 else self.side[self.owner] == side
        mine, lists = np.flatnonzero(of(x_side)), np.flatnonzero(of(y_side))
        codes = self.rank[lists] * self.n + self.owner[lists]
        by = np.argsort(codes, kind="stable")
        codes, lists = codes[by], lists[by]
        x, a, left, base = self.owner[mine], self.sizes[self.owner[mine]], self.left[mine], self.rank[mine] * self.n
        share = self.least / (1 + self.least)
        low, whole = np.searchsorted(codes, base + x, "right"), np.searchsorted(self.sizes, a / self.least + 1e-6, "right")
        # a partner of b words needs (a + b) * share common ones, and from this place on `left` are left
        able = np.minimum(whole, np.searchsorted(self.sizes, left / share - a + 1e-6, "right"))
        every, some = (np.maximum(np.searchsorted(codes, base + to, "left") - low, 0) for to in (whole, able))
        starts = np.searchsorted(x, np.arange(self.n + 1), "left")
        sums = lambda n: np.diff(np.concatenate([[0], np.cumsum(n)])[starts])
        full = sums(every) <= frequent * sums(some)
        for counted, n in ((True, every), (False, some)):
            n = np.where(full[x] == counted, n, 0)
            for i, j in _runs(sums(n), max(1, STEP // max(1, self.n))):
                e = slice(starts[i], starts[j])
                found = _ranges(low[e], n[e])
                if not found.size:
                    continue
                cell = np.repeat((x[e] - i) * self.n, n[e]) + codes[found] % self.n
                if not counted:
                    b = self.sizes[cell % self.n]
                    cell = cell[self.left[lists[found]] >= (np.repeat(a[e], n[e]) + b) * share - 1e-6]
                if cell.size * 8 < (j - i) * self.n:
                    cell, common = np.unique(cell, return_counts=True)
                else:
                    common = np.bincount(cell)
                    cell = np.flatnonzero(common)
                    common = common[cell]
                p, q = cell // self.n + i, cell % self.n
                for k in range(0, p.size, ROWS):
                    r, s = p[k : k + ROWS], q[k : k + ROWS]
                    yield r, s, common[k : k + ROWS] if counted else self._common(r, s)

    def _common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Common words of each pair, by looking up those of p among those of q."""
        first = np.searchsorted(self.owner, np.arange(self.n + 1), "left")
        n, got = np.diff(first)[p], np.zeros(p.size, np.int64)
        for i, j in _runs(n, ROWS):
            asked = np.repeat(q[i:j] * self.words, n[i:j]) + self.rank[_ranges(first[p[i:j]], n[i:j])]
            at = np.minimum(np.searchsorted(self.members, asked), self.members.size - 1)
            got[i:j] = np.bincount(np.repeat(np.arange(j - i), n[i:j]), self.members[at] == asked, minlength=j - i)
        return got


def _matches(table: pa.Table, least: float, frequent: float) -> Iterator[pa.RecordBatch]:
    table = table.combine_chunks()
    sizes = pc.list_value_length(table.column("w")).to_numpy().astype(np.int64)
    order = np.argsort(sizes, kind="stable")
    table, sizes = table.take(pa.array(order)).combine_chunks(), sizes[order]
    key, ids, side = table.column("key").combine_chunks(), table.column("id").combine_chunks(), table.column("side").to_numpy()
    words = pc.list_flatten(table.column("w")).combine_chunks().dictionary_encode()
    words, keys = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words, key.dictionary_encode()
    number = np.empty(len(ids), np.int64)
    number[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    owner = np.repeat(np.arange(sizes.size), sizes)
    word = words.indices.to_numpy().astype(np.int64) + keys.indices.to_numpy().astype(np.int64)[owner] * len(words.dictionary)
    unit = _Unit(owner, word, sizes, side, least)
    for x_side, y_side in ((0, 1), (1, 0)) if side.any() else ((-1, -1),):
        for p, q, common in unit.pairs(x_side, y_side, frequent):
            similarity = common / (sizes[p] + sizes[q] - common)
            good = similarity >= least
            p, q = np.where(number[p] < number[q], p, q)[good], np.where(number[p] < number[q], q, p)[good]
            if p.size:
                yield pa.RecordBatch.from_arrays([key.take(pa.array(p)), ids.take(pa.array(p)), ids.take(pa.array(q)), pa.array(similarity[good])], ["key", "left_id", "right_id", "similarity"])


def pairs(sets: DataFrame, least: float, frequent: float = 64, texts: int = TEXTS, words: int = WORDS) -> DataFrame:
    """(key, left_id, right_id, similarity) of sets of one key whose Jaccard similarity is `least` or more, left_id < right_id.

    Inputs are (key string, id string, w array<string>): ids are unique, w is a set that isn't empty. A unit has two
    parts of about `texts` sets, or of `words` words, at most.
    """
    sets = cut(sets.select("key", "id", "w"))
    keys = cut(sets.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / texts), F.ceil(F.sum(F.size("w")) / words)).cast("int").alias("parts"), F.count("*").alias("n"), F.sum(F.size("w")).alias("n_words")))
    small = keys.filter("parts = 1").agg(F.sum("n").alias("n"), F.sum("n_words").alias("words")).first()
    shared = max(1, -(-(small.n or 0) // texts), -(-(small.words or 0) // words))
    large = keys.filter("parts > 1").select("key", "parts")
    dealing = large.agg(F.sum(F.col("parts").cast("bigint") * (F.col("parts") + 1) / 2).alias("units"), F.count("*").alias("n")).first()
    units, large = shared + int(dealing.units or 0), F.broadcast(large) if dealing.n <= KEYS else large
    dealt = sets.join(large, "key", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("bigint")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    bucket = F.pmod(F.xxhash64("key"), F.lit(shared)).cast("string")
    dealt = dealt.select(
        F.when(F.col("parts").isNull(), bucket).otherwise(F.concat(F.lit("/"), "key")).alias("owner"), F.coalesce(F.least("part", "other"), F.lit(-1)).alias("a"), F.greatest("part", "other").alias("b"),
        (F.coalesce(F.col("part") > F.col("other"), F.lit(False))).cast("int").alias("side"), "key", "id", "w",
    )
    return _units(dealt, units).groupBy("owner", "a", "b").applyInArrow(_matcher(least, frequent), _PAIRS)


def _units(dealt: DataFrame, units: int) -> DataFrame:
    # a number of its own: adaptive plans would put units together by the bytes that they read, which say nothing of their pairs
    tasks = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(TASKS, units))
    return dealt.repartition(tasks, "owner", "a", "b")


def _matcher(least: float, frequent: float):  # type: ignore[no-untyped-def]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _matches(pa.Table.from_batches(batches), least, frequent)

    return run
