"""Texts mixed by source to target shares of all tokens, no text used more often than allowed.

Method: min-cost flow over membership patterns. Equal texts under several sources are one text that belongs to all of
them; texts are aggregated by the set of their sources, the pattern. Tokens flow from patterns, in layers whose cost
rises with each further use, to the sources' quotas: the cheapest flow repeats as little as possible. Texts are then
chosen by a seeded order: a pattern's texts, repeated, lie along an axis of tokens, its flow to each source is a
stretch of that axis, and a text is used by the source in whose stretch it begins.

The flow takes every pattern there is, however many, and is solved in the driver, which holds a row for each pattern and
for each source with a target: both are bounded by the sources and their combinations that the texts have. The stretches
of the `PATTERNS` patterns with most tokens are broadcast, those of any others joined. Running totals come from
`BUCKETS` partial sums of each pattern.

Short sources. The mix is the largest, up to the asked size, at which every source fills its quota. Sources that would
hold it under `SHORT` of the asked size, those that can't fill their share of that much, give all they can instead and
fall short of their share, which `shares` reports; the others keep their quotas.

Cases. A text in sources with different allowances may be used as often as the least of them allows. Texts of sources
without a target (or whose target is null or 0), null and empty texts are not used. Redelivered rows (equal doc_id)
count once. The mix has `size` tokens, by default as many as the corpus, or fewer where the shares can't be reached
with more. A source with a target and no text is short: the others are mixed without it. A source with several targets
is an error. An empty table gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut

PATTERNS, BUCKETS, SEED, SHORT = 20_000, 4096, 11, 0.5
_FLOW = "pattern string, source string, flow_from bigint, flow_to bigint, tokens bigint"


class _Supply(NamedTuple):
    """Patterns and targets as arrays. source: of each pattern its sources, those of pattern i from first[i] on."""

    names: list[str]
    share: list[float]
    allowed: np.ndarray
    tokens: np.ndarray
    first: np.ndarray
    source: np.ndarray


Targets = Mapping[str, tuple[float, int]]
Tokens = Mapping[tuple[str, ...], int] | _Supply


def _supply(tokens: Tokens, targets: Targets) -> _Supply:
    if isinstance(tokens, _Supply):
        return tokens
    patterns, names = sorted(tokens), sorted(targets)
    number = {s: i for i, s in enumerate(names)}
    first = np.cumsum([0, *map(len, patterns)])
    return _Supply(names, [targets[s][0] for s in names], np.array([targets[s][1] for s in names], np.int64), np.array([tokens[p] for p in patterns], np.int64), first, np.array([number[s] for p in patterns for s in p], np.int64))


def _take(free: np.ndarray, amount: int) -> np.ndarray:
    """`amount` from the first of what is free."""
    free = np.minimum(free, amount)
    return np.clip(amount - (np.cumsum(free) - free), 0, free)


class _Flow:
    """Flow from patterns to sources by augmenting paths over the sources: tokens of all patterns in a path move at once.

    A path leads from patterns with free tokens to a source, on to sources that share a pattern whose tokens the source
    before can give, and ends at a source that isn't filled. Costs lie on uses of a text alone, so letting patterns be
    used once as far as that goes, then twice and so on, is the cheapest of the largest flows.
    """

    def __init__(self, supply: _Supply, quota: np.ndarray):
        self.source, self.tokens, width = supply.source, supply.tokens, np.diff(supply.first)
        self.pattern = np.repeat(np.arange(width.size), width)
        self.by = np.lexsort((self.pattern, width[self.pattern], self.source))  # patterns of few sources first
        self.at = np.searchsorted(self.source[self.by], np.arange(quota.size + 1))
        uses = np.minimum.reduceat(supply.allowed[self.source], supply.first[:-1]) if width.size else np.zeros(0, np.int64)
        self.uses = np.minimum(uses, int(quota.sum()) // np.maximum(self.tokens, 1) + 1)
        self.sent, self.used, self.room = np.zeros(self.source.size, np.int64), np.zeros(width.size, np.int64), quota.copy()

    def solve(self, cheapest: bool = True) -> "_Flow":
        """The largest flow, at the least number of repeats unless any will do."""
        last, most = int(self.uses.max(initial=0)), self.tokens * self.uses
        for k in range(1, last + 1) if cheapest else [last]:
            self._fill(np.minimum(self.tokens * k, most))
            if k < last and not self._open(most)[0].size:
                break
        return self

    def short(self) -> np.ndarray:
        """Sources that aren't filled or whose tokens those could use: of a largest flow, a least cut."""
        inside = self.room > 0
        while True:
            touched = np.zeros(self.tokens.size, bool)
            touched[self.pattern[inside[self.source]]] = True
            more = inside.copy()
            more[self.source[touched[self.pattern] & (self.sent > 0)]] = True
            if (more == inside).all():
                return inside
            inside = more

    def _fill(self, most: np.ndarray) -> None:
        while True:
            ends, before = self._open(most)
            if not ends.size:
                return
            for s in ends.tolist():
                self._augment(most, s, before)

    def _open(self, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the nearest sources with room that free tokens can reach, the source before each on its way or -1)."""
        before, seen = np.full(self.room.size, -1), np.zeros(self.room.size, bool)
        if not self.room.any():
            return np.zeros(0, np.int64), before
        known = self.used < most
        seen[self.source[known[self.pattern]]] = True
        edge = seen.copy()
        while edge.any():
            if (ends := np.flatnonzero(edge & (self.room > 0))).size:
                return ends, before
            giving = np.flatnonzero(edge[self.source] & (self.sent > 0) & ~known[self.pattern])
            via = np.full(self.tokens.size, -1)
            via[self.pattern[giving]] = self.source[giving]
            known |= via >= 0
            met = np.flatnonzero((via[self.pattern] >= 0) & ~seen[self.source])
            edge = np.zeros(self.room.size, bool)
            before[self.source[met]], edge[self.source[met]] = via[self.pattern[met]], True
            seen |= edge
        return np.zeros(0, np.int64), before

    def _of(self, source: int) -> np.ndarray:
        return self.by[self.at[source] : self.at[source + 1]]

    def _augment(self, most: np.ndarray, end: int, before: np.ndarray) -> None:
        amount, moves, at = int(self.room[end]), [], end
        while before[at] >= 0 and amount:
            to, giving = self._of(at), self._of(at := int(before[at]))
            giving = giving[self.sent[giving] > 0]
            _, i, j = np.intersect1d(self.pattern[giving], self.pattern[to], assume_unique=True, return_indices=True)
            moves.append((giving[i], to[j]))
            amount = min(amount, int(self.sent[giving[i]].sum()))
        start = self._of(at)
        free = np.minimum((most - self.used)[self.pattern[start]], amount)
        amount = min(amount, int(free.sum()))
        if amount:
            part = _take(free, amount)
            self.sent[start] += part
            self.used[self.pattern[start]] += part
            for giving, to in moves:
                part = _take(self.sent[giving], amount)
                self.sent[giving] -= part
                self.sent[to] += part
            self.room[end] -= amount


def asked(targets: Targets, size: int, limits: Mapping[str, int] | None = None) -> dict[str, int]:
    """Each source's quota of a mix of a size, at most its limit."""
    return {s: min(int(share * size), (limits or {}).get(s, size)) for s, (share, _) in targets.items()}


def _flow(supply: _Supply, targets: Targets, size: int, limits: Mapping[str, int] | None = None, cheapest: bool = True) -> _Flow:
    quota = asked(targets, size, limits)
    return _Flow(supply, np.array([quota[s] for s in supply.names], np.int64)).solve(cheapest)


def route(tokens: Tokens, targets: Targets, size: int, limits: Mapping[str, int] | None = None) -> tuple[int, dict[tuple[tuple[str, ...], str], int]]:
    """(tokens sent, flow by pattern and source) for the quotas of a mix of a size; targets: share and allowance by source."""
    supply = _supply(tokens, targets)
    flow = _flow(supply, targets, size, limits)
    at = np.flatnonzero(flow.sent)
    names = lambda i: tuple(supply.names[s] for s in supply.source[supply.first[i] : supply.first[i + 1]])
    return int(flow.sent.sum()), {(names(flow.pattern[e]), supply.names[supply.source[e]]): int(flow.sent[e]) for e in at}


def reachable(tokens: Tokens, targets: Targets, most: int, limits: Mapping[str, int] | None = None) -> int:
    """The largest size up to `most` at which every quota can be filled.

    The sources of a cut can't have more together than they got: the largest size at which they ask no more is the next
    to try.
    """
    supply, size = _supply(tokens, targets), most
    while size:
        flow = _flow(supply, targets, size, limits, cheapest=False)
        if not flow.room.any():
            return size
        cut_ = np.flatnonzero(flow.short())
        part, got = {supply.names[s]: targets[supply.names[s]] for s in cut_}, int(flow.sent[flow.short()[flow.source]].sum())
        low, high = 0, size
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if sum(asked(part, middle, limits).values()) <= got else (low, middle)
        size = low
    return 0


def short(tokens: Tokens, targets: Targets, most: int, least: float = SHORT) -> dict[str, int]:
    """What each source gives that can't fill its share of least * most; the others aren't named."""
    supply = _supply(tokens, targets)
    room = _flow(supply, targets, int(least * most)).room
    quota = asked(targets, int(least * most))
    return {supply.names[s]: quota[supply.names[s]] - int(room[s]) for s in np.flatnonzero(room)}


def mix(documents: DataFrame, targets: DataFrame, size: int | None = None, seed: int = SEED) -> DataFrame:
    """(source, doc_id, n_tokens, n_uses) of the mix, from (doc_id, source, text_key, n_tokens) and (source, target_share, max_repeats).

    One row for each text and source that uses it; doc_id is the smallest id of the text in that source.
    """
    spark = documents.sparkSession
    wanted = targets.filter("source is not null and target_share > 0 and max_repeats > 0").select("source", "target_share", "max_repeats").distinct()
    rows = wanted.collect()
    goal = {r[0]: (float(r[1]), int(r[2])) for r in rows}
    if len(goal) < len(rows):
        raise ValueError("several targets of one source")
    names = wanted.select("source")
    names = F.broadcast(names) if len(goal) <= PATTERNS else names
    known = documents.filter("n_tokens > 0").join(names, "source").select("doc_id", "source", "text_key", "n_tokens").dropDuplicates(["doc_id"])
    own = known.groupBy("text_key", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    texts = own.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("source", "doc_id"))).alias("in"), F.max("n_tokens").alias("n_tokens"))
    texts = texts.withColumn("pattern", F.array_join("in.source", "\x1f")).withColumn("h", F.xxhash64("text_key", F.lit(seed)))
    texts = cut(texts.withColumn("bucket", F.pmod("h", F.lit(BUCKETS))))
    sums = texts.groupBy("pattern").agg(F.sum("n_tokens").alias("n")).toArrow()
    parts = texts.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("n"))
    patterns, supply = _collected(sums, goal)
    most = int(supply.tokens.sum()) if size is None else size
    limits = short(supply, goal, most) if patterns else {}
    total = reachable(supply, goal, most, limits) if patterns else 0
    main, rest = _plan(patterns, supply, _flow(supply, goal, total, limits))
    plan = F.broadcast(spark.createDataFrame(main, _FLOW))  # at most PATTERNS times the sources of a pattern
    before = W.partitionBy("pattern").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select("pattern", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inner = W.partitionBy("pattern", "bucket").orderBy("h", "text_key").rowsBetween(W.unboundedPreceding, -1)
    placed = texts.join(offsets, ["pattern", "bucket"]).withColumn("start", F.col("offset") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    used = placed.join(plan, "pattern")
    if rest.num_rows:
        used = used.unionByName(placed.join(spark.createDataFrame(rest), "pattern"))
    # uses k with flow_from <= start + k * tokens < flow_to
    laps = lambda edge: F.greatest(F.lit(0), F.ceil((F.col(edge) - F.col("start")) / F.col("tokens")))
    uses = (laps("flow_to") - laps("flow_from")).cast("int")
    mine = F.element_at(F.filter("in", lambda e: e["source"] == F.col("source")), 1)["doc_id"]
    return used.select("source", mine.alias("doc_id"), "n_tokens", uses.alias("n_uses")).filter("n_uses > 0")


def _collected(sums: pa.Table, goal: Targets) -> tuple[list[str], _Supply]:
    """The patterns in order, and their tokens and sources."""
    order = pc.sort_indices(sums.column("pattern")) if sums.num_rows else pa.array([], pa.int64())
    sums = sums.take(order)
    patterns = sums.column("pattern").to_pylist()
    bare = _supply({}, goal)
    number = {s: i for i, s in enumerate(bare.names)}
    members = [[number[s] for s in p.split("\x1f")] for p in patterns]
    source = np.fromiter((s for m in members for s in m), np.int64)
    return patterns, bare._replace(tokens=sums.column("n").to_numpy().astype(np.int64), first=np.cumsum([0, *map(len, members)]), source=source)


def _plan(patterns: list[str], supply: _Supply, flow: _Flow) -> tuple[list[tuple], pa.Table]:
    """Each flow's stretch of its pattern's axis: those of the PATTERNS patterns with most tokens, and the others'."""
    upto = np.cumsum(flow.sent)
    start = upto - flow.sent
    start -= np.repeat(start[supply.first[:-1]] if patterns else start, np.diff(supply.first))
    top = np.zeros(len(patterns), bool)
    top[np.argsort(-supply.tokens, kind="stable")[:PATTERNS]] = True
    at = lambda e: (flow.pattern[e], supply.source[e], start[e], (start + flow.sent)[e], supply.tokens[flow.pattern[e]])
    big, rest = (at(np.flatnonzero((flow.sent > 0) & (top[flow.pattern] == t))) for t in (True, False))
    main = [(patterns[p], supply.names[s], *x) for p, s, *x in zip(*(c.tolist() for c in big))]
    columns = [pa.array([patterns[p] for p in rest[0]], pa.string()), pa.array([supply.names[s] for s in rest[1]], pa.string()), *map(pa.array, rest[2:])]
    return main, pa.table(columns, ["pattern", "source", "flow_from", "flow_to", "tokens"])


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source its target, the tokens and share really reached, texts used and the most uses of one."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("tokens"), F.count("*").alias("n_texts"), F.max("n_uses").alias("most_uses"))
    all_ = F.sum("tokens").over(W.partitionBy())  # one row per source
    filled = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").na.fill(0, ["tokens", "n_texts", "most_uses"])
    return filled.withColumn("reached_share", F.when(all_ > 0, F.col("tokens") / all_))
