"""Roll-ups of the savings ledger: latest line per session, model/session/lifetime totals, recent and trend views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .stretches import at_ranks, carried, numbered

COUNTERS = ("tokens", "turns", "baseline_prompt_tokens", "prepared_prompt_tokens", "saved_prompt_tokens", "hot_hint_tokens_added", "reacquisition_cost_tokens")


def latest(lines: DataFrame) -> DataFrame:
    """The last line of each session and stream, by file and line; damaged lines and lines without a session are left out."""
    rows = lines.filter("not damaged and session_id is not null")
    keep = [c for c in rows.columns if c not in ("stream", "session_id", "others", "damaged", "damaged_raw")]
    last = rows.groupBy("stream", "session_id").agg(F.max_by(F.struct(*keep), F.struct("file_seq", "line_no", "file_id")).alias("l"))
    return last.select("stream", "session_id", "l.*")


def rollup(sessions: DataFrame) -> DataFrame:
    """Totals by stream and model, by stream, and over all, in one pass; level counts the keys that are summed over."""
    total = [F.sum(c).alias(c) for c in COUNTERS]
    return sessions.rollup("stream", "model").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n_sessions"), *total)


def saved(sessions: DataFrame) -> DataFrame:
    """Per session the net saving: what was saved less what hints and reacquisition cost, and its share of the baseline."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    net = zero("saved_prompt_tokens") - zero("hot_hint_tokens_added") - zero("reacquisition_cost_tokens")
    return sessions.select("stream", "session_id", "date", net.alias("net_saved"), F.try_divide(net * 100.0, F.col("baseline_prompt_tokens")).alias("net_pct"))


def recent(sessions: DataFrame, n: int = 5) -> DataFrame:
    """Per stream, its last n sessions summed, beside their first and last date."""
    at = F.row_number().over(W.partitionBy("stream").orderBy(F.desc("date"), F.desc("file_seq"), F.desc("line_no"), F.desc("session_id")))
    return sessions.withColumn("at", at).filter(F.col("at") <= n).groupBy("stream").agg(F.count("*").alias("n_sessions"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), *[F.sum(c).alias(c) for c in COUNTERS])


_LINE = ("date", "file_seq", "line_no", "session_id")


def _monthly(sessions: DataFrame) -> DataFrame:
    """Sessions in parts of a month each, for windows over whole streams."""
    return sessions.withColumn("part", F.year("date") * 12 + F.month("date"))


def trend(sessions: DataFrame) -> DataFrame:
    """Per stream, the mean saved tokens, its slope against the session's number and the change from first to last."""
    s = sessions.filter("saved_prompt_tokens is not null and date is not null").select("stream", *_LINE, F.col("saved_prompt_tokens").cast("double").alias("y"))
    s = numbered(_monthly(s), "stream", _LINE, "i")
    out = s.groupBy("stream").agg(F.count("*").alias("n_sessions"), F.avg("y").alias("mean"), F.regr_slope("y", F.col("i").cast("double")).alias("slope"), F.min_by("y", "i").alias("first"), F.max_by("y", "i").alias("last"))
    return out.withColumn("direction", F.when(F.col("last") > F.col("first"), "up").when(F.col("last") < F.col("first"), "down").otherwise("flat"))


def peak(sessions: DataFrame) -> DataFrame:
    """Per stream the highest share saved so far at any of its sessions: running sums, then a running maximum."""
    s = _monthly(sessions.filter("saved_prompt_tokens is not null and baseline_prompt_tokens is not null and date is not null").select("stream", *_LINE, "saved_prompt_tokens", "baseline_prompt_tokens"))
    for name in ("saved_prompt_tokens", "baseline_prompt_tokens"):
        s = carried(s, "stream", _LINE, f"upto_{name}", F.sum(name), F.sum(name), "sum").withColumn(f"upto_{name}", F.col(f"upto_{name}") + F.col(name))
    pct = F.try_divide(100.0 * F.col("upto_saved_prompt_tokens"), F.col("upto_baseline_prompt_tokens"))
    return s.groupBy("stream").agg(F.max(pct).alias("peak_pct"), F.count("*").alias("n_sessions"))


def nearest_rank(df: DataFrame, group: str, value: str, p: float = 0.95) -> DataFrame:
    """The value at index round((n - 1) * p), half to even, without interpolation; no group is sorted as a whole."""
    return at_ranks(df, group, value, [F.bround((F.col("n") - 1) * F.lit(p)).cast("bigint")]).select(group, F.col("v0").alias("value"), "n")


def lanes(runs: DataFrame) -> DataFrame:
    """Runs (lane, task, value, success): rates, median, and the mean of the tasks' population variances."""
    task = runs.groupBy("lane", "task").agg(F.count("*").alias("n"), F.count_if("success").alias("ok"), F.var_pop("value").alias("var"), F.count_distinct("success").alias("outcomes"))
    per = task.groupBy("lane").agg(F.sum("n").alias("n_runs"), (F.sum("ok") / F.sum("n")).alias("success_rate"), F.avg(F.when(F.col("n") > 1, F.col("var"))).alias("mean_variance"), F.count_if(F.col("outcomes") == 1).alias("n_stable"))
    middle = at_ranks(runs, "lane", "value", [F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)])
    return per.join(middle.select("lane", ((F.col("v0") + F.col("v1")) / 2).alias("median")), "lane")


def paired(runs: DataFrame, base: str, candidate: str) -> DataFrame:
    """Means of two lanes side by side per task, with their difference and the better one (the smaller)."""
    side = lambda lane, name: runs.filter(F.col("lane") == lane).groupBy("task").agg(F.avg("value").alias(name))
    both = side(base, "base").join(side(candidate, "candidate"), "task")
    return both.withColumn("delta", F.col("candidate") - F.col("base")).withColumn("winner", F.when(F.col("delta") < 0, "candidate").when(F.col("delta") > 0, "base").otherwise("tie"))
