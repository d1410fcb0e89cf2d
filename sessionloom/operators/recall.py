"""What a session remembers by field: scores with their own loss and promotion, facts that replace each other, aliases, tiers, states.

The folds take a session's rows in order (`folds.folded` or sorted batches) and hold its bounded memory only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from .folds import folded

# What an untouched field loses a turn, the score at which its values become durable, and how many it holds.
LOSS = {"goal": 0, "facts": 0, "constraints": 0, "cmds": 2, "tests": 2, "next": 2}
PROMOTED = {"goal": 2, "edited": 2, "constraints": 2, "files": 3, "facts": 3, "blockers": 3, "errs": 4}
HELD = {"files": 12, "cmds": 8, "errs": 6, "facts": 16, "questions": 6}
SINGLE, DIRECT, OLD, CAP = ("goal", "next"), ("facts", "errs", "questions"), 5, 64


def values(events: DataFrame) -> DataFrame:
    """(session_id, turn, field, value): files read, files edited, commands, queries as questions, first errors, what files are known to hold."""
    first_error = F.get(F.filter(T.lines(F.col("raw")), T.has_error), F.lit(0))
    fact = F.when(F.col("family") == "file_read", F.concat(F.col("path"), F.lit(":"), T.digest(F.col("raw"), 8)))
    fields = F.array(
        F.struct(F.when(F.col("family") == "edit", "edited").otherwise("files").alias("field"), F.col("path").alias("value")), F.struct(F.lit("cmds").alias("field"), T.command_family(F.col("command")).alias("value")),
        F.struct(F.lit("questions").alias("field"), F.col("query").alias("value")), F.struct(F.lit("errs").alias("field"), F.substring(F.trim(first_error), 1, 60).alias("value")), F.struct(F.lit("facts").alias("field"), fact.alias("value")),
    )
    return events.select("session_id", "turn", "pos", F.posexplode(fields).alias("part", "v")).select("session_id", "turn", "pos", "part", "v.*").filter("value is not null")


Bucket = dict[tuple[str, str], list[int]]


def remember(hot: Bucket, durable: Bucket, turn: int, said: list[tuple[str, str]]) -> None:
    """One turn: what is said gains, fields without a word lose, questions age out, strong values become durable, the rest is trimmed."""
    for field, value in said:
        for bucket, gain in ((hot, 2), (durable, 1 if field in DIRECT else 0)):
            if not gain:
                continue
            key = value.split(":", 1)[0]
            for old in [k for k in bucket if k[0] == field and k[1] != value and (field in SINGLE or (field == "facts" and ":" in value and k[1].split(":", 1)[0] == key))]:
                del bucket[old]  # a field with one value, or another value of the same fact
            held = bucket.setdefault((field, value), [0, turn])
            held[0], held[1] = held[0] + gain, turn
    touched = {f for f, _ in said}
    for bucket, half in ((hot, False), (durable, True)):
        for (field, value), held in list(bucket.items()):
            rate = LOSS.get(field, 1)
            rate = max(1, rate // 2) if half and rate else rate
            if field not in touched and rate:
                held[0] = 0 if field == "questions" and turn - held[1] > OLD else held[0] - rate
            if held[0] <= 0:
                del bucket[field, value]
    for (field, value), held in hot.items():
        if held[0] >= PROMOTED.get(field, 1 << 30) and (field, value) not in durable:
            durable[field, value] = [1, turn]
    for bucket in (hot, durable):
        order = sorted(bucket, key=lambda k: (-bucket[k][0], -bucket[k][1], k))
        count: dict[str, int] = {}
        for n, k in enumerate(order):
            count[k[0]] = count.get(k[0], 0) + 1
            if count[k[0]] > HELD.get(k[0], CAP) or n >= CAP:
                del bucket[k]


SCHEMA = "session_id string, bucket string, field string, value string, score int, last_turn int"


def memories(said: DataFrame) -> DataFrame:
    """The final memory of each session, hot and durable, from (session_id, turn, pos, part, field, value)."""

    def rows(session: str, hot: Bucket, durable: Bucket) -> pd.DataFrame:
        return pd.DataFrame([(session, b, f, v, s, t) for b, held in (("hot", hot), ("durable", durable)) for (f, v), (s, t) in sorted(held.items())], columns=["session_id", "bucket", "field", "value", "score", "last_turn"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session: Any = None
        turn, waiting, hot, durable = None, [], {}, {}
        for batch in batches:
            for s, t, f, v in zip(batch["session_id"], batch["turn"], batch["field"], batch["value"]):
                if (s, t) != (session, turn) and turn is not None:
                    remember(hot, durable, turn, waiting)
                    waiting = []
                    if s != session:
                        yield rows(session, hot, durable)
                        hot, durable = {}, {}
                session, turn = s, int(t)
                waiting.append((f, v))
        if turn is not None:
            remember(hot, durable, turn, waiting)
            yield rows(session, hot, durable)

    usable = said.filter("session_id is not null and turn is not null").select("session_id", "turn", "pos", "part", "field", "value")
    return usable.repartition("session_id").sortWithinPartitions("session_id", "turn", "pos", "part").mapInPandas(run, SCHEMA)


def aliases(said: DataFrame, most: int = 52) -> DataFrame:
    """Each value with the alias it gets: *A to *Z, then *A1 on, where that is shorter; beyond `most` the lowest score gives its alias up."""

    def step(state: dict[str, Any], row: dict[str, Any]) -> dict[str, Any]:
        held, value = state.setdefault("held", {}), row["value"]
        if value in held:
            held[value][1] += 1
            return {"alias": held[value][0], "evicted": None}
        n = state.get("next", 0)
        name = f"*{chr(65 + n % 26)}{n // 26 or ''}"
        if len(value) <= len(name):
            return {"alias": value, "evicted": None}
        state["next"], held[value], gone = n + 1, [name, 1], None
        if len(held) > most:
            gone = min(held, key=lambda v: held[v][1])
            del held[gone]
        return {"alias": name, "evicted": gone}

    rows = said.select("session_id", "turn", "pos", "part", "value")
    return folded(rows, ["session_id"], ["turn", "pos", "part"], step, "session_id string, turn int, pos int, part int, value string, alias string, evicted string")


# Turns after which a cold fact is shown again, by stage.
REFRESH = {1: 5, 2: 25}


def tiers(facts: DataFrame, archive: int = 4, permanent: int = 6) -> DataFrame:
    """Facts (session_id, turn, key, value) by tier after each mention: heat grows with mentions, cold after `archive` turns without, permanent at `permanent`.

    A permanent fact that is said otherwise loses its place and keeps its heat; stage 1 facts come up again after 5
    turns, later ones after 25.
    """

    def step(state: dict[str, Any], row: dict[str, Any]) -> dict[str, Any]:
        turn, age = row["turn"], row["turn"] - state.get("last", row["turn"])
        changed = "value" in state and state["value"] != row["value"]
        stage = state.get("stage", 0)
        if stage == 3 and changed and state["heat"] < 2 * permanent:
            stage = 0
        refreshed = 0 < stage < 3 and turn >= state.get("due", 0)
        heat = state.get("heat", 0) + 1
        if heat >= permanent and not changed:
            stage = 3
        elif stage == 0 and age >= archive:
            stage = 1
        elif stage == 1 and age > REFRESH[2]:
            stage = 2
        state.update(last=turn, value=row["value"], heat=heat, stage=stage, due=turn + REFRESH.get(stage, 0))
        return {"heat": heat, "stage": stage, "tier": "permanent" if stage == 3 else "hot" if stage == 0 else "cold", "changed": changed, "refreshed": refreshed}

    return folded(facts.select("session_id", "turn", "key", "value"), ["session_id", "key"], ["turn", "value"], step, "session_id string, turn int, key string, value string, heat int, stage int, tier string, changed boolean, refreshed boolean")


def states(said: DataFrame, k: int = 3) -> DataFrame:
    """A state line for each turn of a session: of each field the values of the turn, the k first by name, fields by name."""
    top = said.select("session_id", "turn", "field", "value").distinct()
    ranked = top.withColumn("r", F.row_number().over(W.partitionBy("session_id", "turn", "field").orderBy("value"))).filter(F.col("r") <= k)
    per = ranked.groupBy("session_id", "turn", "field").agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias("v"))
    return per.groupBy("session_id", "turn").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "v")))).alias("state"))


def deltas(lines: DataFrame) -> DataFrame:
    """What of each state must be sent after the one before it: nothing when equal, all at first or when facts appear, else the changed fields."""
    line = W.partitionBy("session_id").orderBy("turn")
    s = lines.withColumn("old", F.lag("state").over(line))
    changed = F.map_filter("state", lambda k, v: ~v.eqNullSafe(F.element_at("old", k)))
    gone = F.size(F.array_except(F.map_keys("old"), F.map_keys("state"))) > 0
    how = F.when(F.col("old").isNull(), "full").when((F.size(changed) == 0) & ~gone, "suppress").when(F.map_contains_key("state", F.lit("facts")) & ~F.map_contains_key("old", F.lit("facts")), "full").otherwise("delta")
    sent = F.when(how == "full", F.col("state")).when(how == "delta", changed)
    text = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws(":", e["key"], e["value"])), "|")
    return s.select("session_id", "turn", how.alias("how"), text(F.col("state")).alias("line"), F.coalesce(text(sent), F.lit("")).alias("sent"))


def moves(lines: DataFrame) -> DataFrame:
    """How many values each turn's state has more and fewer than the one before it, by set differences."""
    items = F.flatten(F.transform(F.map_entries("state"), lambda e: F.transform(F.split(e["value"], ","), lambda v: F.concat_ws(":", e["key"], v))))
    s = lines.select("session_id", "turn", items.alias("now")).withColumn("old", F.coalesce(F.lag("now").over(W.partitionBy("session_id").orderBy("turn")), F.array().cast("array<string>")))
    return s.select("session_id", "turn", F.size(F.array_except("now", "old")).alias("promoted"), F.size(F.array_except("old", "now")).alias("demoted"))


def episodes(events: DataFrame, keep: int = 8, shown: int = 3) -> DataFrame:
    """The last episodes of each session: a turn's goal, its first target, and whether it ended in an error, as one line of the last three."""
    turn = events.filter("raw is not null").groupBy("session_id", "turn").agg(F.min_by(F.coalesce("path", "query", "command", "tool"), "pos").alias("goal"), F.max(T.has_error(F.col("raw"))).alias("failed"), F.max_by(F.substring(F.regexp_replace("raw", r"\s+", " "), 1, 32), "pos").alias("learned"))
    last = turn.withColumn("r", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("turn")))).filter(F.col("r") <= keep)
    item = F.concat_ws(":", F.substring("goal", 1, 24), F.when(F.col("failed"), "F").otherwise("S"), "learned")
    parts = F.array_sort(F.collect_list(F.when(F.col("r") <= shown, F.struct((-F.col("r")).alias("o"), item.alias("t")))))
    return last.groupBy("session_id").agg(F.count("*").alias("n_episodes"), F.count_if("failed").alias("n_failed"), F.array_join(F.transform(parts, lambda x: x["t"]), "|").alias("line"))


def snapshots(events: DataFrame) -> DataFrame:
    """Facts of the results: symbols that searches show with their file and line, sections of long files, frames of tracebacks."""
    raw = F.col("raw")
    at = lambda kind, found: F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("fact")))
    symbols = F.when(F.col("family") == "search", F.regexp_extract_all(raw, F.lit(r"(?m)^([^:\s][^:\n]*:[0-9]+:\s*(?:class|def|async def)\s+\w+)")))
    sections = F.when((F.col("family") == "file_read") & (F.size(T.lines(raw)) >= 20), F.regexp_extract_all(raw, F.lit(r"(?m)^((?:class|def|async def)\s+\w+)")))
    frames = F.regexp_extract_all(raw, F.lit(r'File "([^"]+", line [0-9]+)'))
    every = F.concat(*[F.coalesce(at(k, f), F.expr("cast(array() as array<struct<kind: string, fact: string>>)")) for k, f in (("symbol", symbols), ("section", sections), ("frame", frames))])
    return events.filter("raw is not null").select("session_id", "turn", "pos", F.inline(F.array_distinct(every))).groupBy("session_id", "kind", "fact").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))
