"""Folds over rows in order, for results that depend on earlier decisions and so on more than a window can see.

Spark sorts; a task passes its rows on one by one and holds one key's small state, so a key may have any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .events import with_target

Step = Callable[[dict[str, Any], dict[str, Any]], dict[str, Any]]


def folded(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, schema: str) -> DataFrame:
    """Each row with the columns that step(state, row) returns; state is a dict that starts empty for each key.

    schema lists the result's columns: df's own and the new ones. Null keys are keys like others.
    """
    own, names = df.columns, [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: Any = None
        state: dict[str, Any] = {}
        for batch in batches:
            out = []
            for values in zip(*(batch[c] for c in own)):
                row = {c: None if v is None or v is pd.NA or v != v else v for c, v in zip(own, values)}
                now = tuple(row[k] for k in keys)
                if now != key:
                    key, state = now, {}
                out.append(row | step(state, row))
            yield pd.DataFrame(out, columns=names).astype(object)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def cache_outcomes(events: DataFrame, seconds: int = 1800) -> DataFrame:
    """Outcomes of a result cache with expiry per session and target.

    The clock starts anew at each store and each equal hit; a changed result is compared with the stored base, which
    stays, except for commands, whose base is replaced.
    """

    def step(state: dict[str, Any], row: dict[str, Any]) -> dict[str, Any]:
        at = row["at"] or 0.0
        if "base" not in state:
            outcome = "stored"
        elif at - state["at"] > seconds:
            outcome = "expired"
        elif state["base"] == row["h"]:
            outcome = "unchanged"
        else:
            outcome = "changed"
        if outcome in ("stored", "expired") or (outcome == "changed" and row["family"] == "command"):
            state.update(base=row["h"], at=at)
        elif outcome == "unchanged":
            state["at"] = at
        return {"outcome": outcome}

    e = with_target(events).filter("raw is not null and family is not null")
    rows = e.select("session_id", "target", "turn", "pos", "family", T.digest(F.col("raw")).alias("h"), (F.unix_micros(F.col("recorded_at").cast("timestamp")) / 1e6).alias("at"))
    return folded(rows, ["session_id", "target"], ["turn", "pos"], step, "session_id string, target string, turn int, pos int, family string, h string, at double, outcome string").drop("h", "at")


def cooled(hints: DataFrame, turns: int = 3) -> DataFrame:
    """Hints (session_id, hint, turn) with whether each is given: not within `turns` turns of when it was last given."""

    def step(state: dict[str, Any], row: dict[str, Any]) -> dict[str, Any]:
        given = row["turn"] is not None and ("last" not in state or row["turn"] - state["last"] > turns)
        if given:
            state["last"] = row["turn"]
        return {"given": given}

    return folded(hints.select("session_id", "hint", "turn"), ["session_id", "hint"], ["turn"], step, "session_id string, hint string, turn int, given boolean")
