"""Per-session memory: values that gain score when they come up and lose it turn by turn; the same fold in batch and stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

GAIN, LOSS, PROMOTE, CAP = 2, 1, 6, 32
SCHEMA = "session_id string, bucket string, value string, score int, last_turn int"


def fold(state: dict[str, list[int]], durable: dict[str, list[int]], turns: Iterable[tuple[int, list[str]]]) -> None:
    """Take turns in order: values of a turn gain, others lose; at PROMOTE a value becomes durable; at 0 it is forgotten; at most CAP stay."""
    for turn, values in turns:
        for v in set(values):
            kept = state.setdefault(v, [0, turn])
            kept[0], kept[1] = kept[0] + GAIN, turn
            if kept[0] >= PROMOTE:
                durable[v] = [kept[0], turn]
        for v in [v for v in state if v not in values]:
            state[v][0] -= LOSS
            if state[v][0] <= 0:
                del state[v]
        for v in sorted(state, key=lambda v: (-state[v][0], -state[v][1], v))[CAP:]:
            del state[v]


def rows(session: str, state: dict[str, list[int]], durable: dict[str, list[int]]) -> pd.DataFrame:
    out = [(session, b, v, s, t) for b, held in (("hot", state), ("durable", durable)) for v, (s, t) in sorted(held.items())]
    return pd.DataFrame(out, columns=["session_id", "bucket", "value", "score", "last_turn"])


def remembered(values: DataFrame) -> DataFrame:
    """Final memory of each session from (session_id, turn, value).

    Rows pass through the fold in order, sorted by Spark within partitions of whole sessions: a task holds one turn
    and one session's bounded memory, never a session's rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session = turn = None
        held: tuple[dict[str, list[int]], dict[str, list[int]]] = ({}, {})
        waiting: list[str] = []
        for batch in batches:
            for s, t, v in zip(batch["session_id"], batch["turn"], batch["value"]):
                if (s, t) != (session, turn) and turn is not None:
                    fold(*held, [(turn, waiting)])
                    waiting = []
                    if s != session:
                        yield rows(session, *held)
                        held = ({}, {})
                session, turn = s, int(t)
                if isinstance(v, str):
                    waiting.append(v)
        if turn is not None:
            fold(*held, [(turn, waiting)])
            yield rows(session, *held)

    ordered = values.select("session_id", "turn", "value").filter("session_id is not null and turn is not null").repartition("session_id").sortWithinPartitions("session_id", "turn")
    return ordered.mapInPandas(run, SCHEMA)


def stream(values: DataFrame, reorder: int = 64) -> DataFrame:
    """The same over a stream of (session_id, turn, value); each batch gives the whole memory of the sessions it has rows of.

    A session's last `reorder` turns wait in its state, so that turns which arrive later than a higher one are still
    folded in order and the result is that of the batch form; one that comes later than that is folded when it comes.
    """

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else ([],) * 8
        hot, durable = ({k: [s, t] for k, s, t in zip(*x)} for x in (old[:3], old[3:6]))
        waiting: dict[int, list[str]] = {}
        for turn, value in zip(old[6], old[7]):
            waiting.setdefault(turn, []).extend([value] if value else [])
        for pdf in batches:
            for turn, value in zip(pdf["turn"], pdf["value"]):
                waiting.setdefault(int(turn), []).extend([value] if isinstance(value, str) and value else [])
        ripe = [t for t in sorted(waiting) if t <= max(waiting) - reorder]
        fold(hot, durable, [(t, waiting.pop(t)) for t in ripe])
        pairs = [(t, v) for t, vs in waiting.items() for v in (vs or [""])]  # "": a turn without values
        state.update((*([f(k, v) for k, v in held.items()] for held in (hot, durable) for f in (lambda k, v: k, lambda k, v: v[0], lambda k, v: v[1])), [t for t, _ in pairs], [v for _, v in pairs]))
        fold(hot, durable, sorted(waiting.items()))
        yield rows(key[0], hot, durable)

    kept = "hv array<string>, hs array<int>, ht array<int>, dv array<string>, ds array<int>, dt array<int>, wt array<int>, wv array<string>"
    usable = values.select("session_id", "turn", "value").filter("session_id is not null and turn is not null")
    return usable.groupBy("session_id").applyInPandasWithState(run, SCHEMA, kept, "update", "NoTimeout")
