"""Summaries of sessions, streams, captures and fixtures, and what of a session is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from .events import once, repeats, with_target
from .stretches import at_ranks



def _zero(c: str):  # type: ignore[no-untyped-def]
    return F.coalesce(c, F.lit(0))


def _pct(part, whole):  # type: ignore[no-untyped-def]
    return F.bround(F.when(whole > 0, part * 100.0 / whole).otherwise(0.0), 1)


def session_summary(sessions: DataFrame) -> DataFrame:
    """Per session what was saved, net of hints and reacquisition, with shares to one decimal."""
    gross = _zero("saved_prompt_tokens") + _zero("reacquisition_tokens_avoided_estimate") - _zero("hot_hint_tokens_added")
    s = sessions.withColumn("gross", gross).withColumn("net", gross - _zero("reacquisition_cost_tokens")).withColumn("baseline", _zero("baseline_prompt_tokens"))
    return s.select(
        "stream", "session_id", "date", _zero("turns").alias("turns"), "baseline", _zero("prepared_prompt_tokens").alias("prepared"), F.col("gross").alias("saved"), "net", _pct(F.col("gross"), F.col("baseline")).alias("saved_pct"), _pct(F.col("net"), F.col("baseline")).alias("net_pct"),
        _zero("reacquisition_count").alias("reacquisitions"), _zero("invisible_pressure").alias("pressure"), (F.col("baseline") - _zero("prepared_prompt_tokens") == _zero("saved_prompt_tokens")).alias("adds_up"),
    )


def lifetime(sessions: DataFrame) -> DataFrame:
    """Totals per stream over its sessions, each once: those of its last file, still in flight, win over what was persisted of them before."""
    last = sessions.groupBy("stream").agg(F.max("file_seq").alias("last"))
    s = sessions.join(last, "stream").withColumn("in_flight", F.col("file_seq") == F.col("last"))
    return s.groupBy("stream").agg(F.count("*").alias("n_sessions"), F.count_if("in_flight").alias("n_in_flight"), *[F.sum(_zero(c)).alias(c) for c in ("tokens", "turns", "baseline_prompt_tokens", "saved_prompt_tokens")], F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def since(sessions: DataFrame, days: int = 30) -> DataFrame:
    """Per stream the sessions of its last `days` days."""
    newest = sessions.groupBy("stream").agg(F.max("date").alias("newest"))
    kept = sessions.join(newest, "stream").filter(F.date_diff("newest", "date") < days)
    return kept.groupBy("stream").agg(F.count("*").alias("n_sessions"), F.sum("saved_prompt_tokens").alias("saved"), F.min("date").alias("first_date"))


def trends(summary: DataFrame, recent: int = 5) -> DataFrame:
    """Per stream over its last `recent` sessions: means and slopes of four figures, and the direction from first to last."""
    order = W.partitionBy("stream").orderBy(F.desc("date"), F.desc("session_id"))
    s = summary.filter("date is not null").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= recent)
    x, figures = -F.col("r").cast("double"), ("saved_pct", "pressure", "saved", "reacquisitions")
    out = s.groupBy("stream").agg(
        F.count("*").alias("n"), *[F.bround(F.avg(c), 1).alias(f"avg_{c}") for c in figures], *[F.round(F.coalesce(F.regr_slope(F.col(c).cast("double"), x), F.lit(0.0)), 2).alias(f"slope_{c}") for c in figures],
        F.max_by("saved_pct", "r").alias("s0"), F.min_by("saved_pct", "r").alias("s1"), F.max_by("pressure", "r").alias("p0"), F.min_by("pressure", "r").alias("p1"),
    )
    direction = F.when((F.col("n") > 1) & (F.col("s1") > F.col("s0")) & (F.col("p1") <= F.col("p0")), "improving").when((F.col("n") > 1) & ((F.col("s1") < F.col("s0")) | (F.col("p1") > F.col("p0"))), "regressing").otherwise("flat")
    return out.withColumn("direction", direction).drop("s0", "s1", "p0", "p1")


def models(sessions: DataFrame) -> DataFrame:
    """Per stream and model the least, median and most tokens, and whether the model is the stream's most used (ties: the later name) and its cheapest by median."""
    s = sessions.filter("model is not null and tokens is not null").withColumn("g", F.concat_ws("\x1f", "stream", "model"))
    middle = at_ranks(s.withColumn("v", F.col("tokens").cast("double")), "g", "v", [F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)]).select("g", ((F.col("v0") + F.col("v1")) / 2).alias("median"))
    per = s.groupBy("g", "stream", "model").agg(F.count("*").alias("n"), F.min("tokens").alias("least"), F.max("tokens").alias("most")).join(middle, "g").drop("g")
    best = per.groupBy("stream").agg(F.max_by("model", F.struct("n", "model")).alias("dominant"), F.min_by("model", F.struct("median", "model")).alias("cheapest"))
    return per.join(best, "stream").select("stream", "model", "n", "least", "median", "most", (F.col("model") == F.col("dominant")).alias("dominant"), (F.col("model") == F.col("cheapest")).alias("cheapest"))


def benchmark(summary: DataFrame) -> DataFrame:
    """Per stream mean and 95th percentile, by nearest rank, of the share saved, and sums of what went wrong."""
    p95 = at_ranks(summary, "stream", "saved_pct", [F.bround((F.col("n") - 1) * F.lit(0.95)).cast("bigint")]).select("stream", F.col("v0").alias("p95_saved_pct"))
    per = summary.groupBy("stream").agg(F.count("*").alias("n"), F.avg("saved_pct").alias("mean_saved_pct"), F.sum("reacquisitions").alias("reacquisitions"), F.sum("pressure").alias("pressure"), F.count_if(F.col("net") < 0).alias("n_losses"), F.count_if(~F.col("adds_up")).alias("n_odd"))
    return per.join(p95, "stream")


def captures(records: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """Sessions of captured events ({"event", "model", "messages"}): requests, messages, models and the most frequent one."""
    doc = F.try_parse_json(payload)
    get = lambda path, kind: F.try_variant_get(doc, path, kind)
    once_ = records.groupBy(key).agg(F.max_by(F.struct("session_id", payload), F.struct(F.try_parse_json(payload).isNotNull(), F.col(payload))).alias("r")).select(key, "r.*")
    e = once_.select("session_id", get("$.event", "string").alias("event"), get("$.model", "string").alias("model"), F.size(get("$.messages", "array<variant>")).alias("n_messages")).filter("event is not null")
    per = e.groupBy("session_id", "model").agg(F.count("*").alias("n"), F.sum("n_messages").alias("n_messages"))
    return per.groupBy("session_id").agg(F.sum("n").alias("n_events"), F.sum("n_messages").alias("n_messages"), F.count("model").alias("n_models"), F.max_by("model", F.struct("n", "model")).alias("dominant"))


def candidates(captured: DataFrame) -> DataFrame:
    """Captured sessions by their dominant model: score 2n + models beyond the first, ranked."""
    per = captured.groupBy("dominant").agg(F.count("*").alias("n_sessions"), F.sum("n_events").alias("n_events"), F.max("n_models").alias("n_models"))
    order = W.orderBy(F.desc("score"), F.desc("n_events"), "dominant")  # a row per model
    return per.withColumn("score", 2 * F.col("n_sessions") + F.col("n_models") - 1).withColumn("rank", F.row_number().over(order))


def evidence_by_signal(turns: DataFrame) -> DataFrame:
    """For each signal the sessions and turns it came up in, its sum, and the models it came up with."""
    t = once(turns.select("session_id", "turn_index", "ingest_id", "model", "input_behavior_signals"))
    e = t.select("session_id", "model", F.explode("input_behavior_signals").alias("signal", "value"))
    return e.groupBy("signal").agg(F.count("*").alias("n_turns"), F.count_distinct("session_id").alias("n_sessions"), F.sum("value").alias("total"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))


def stress_summary(turns: DataFrame, events: DataFrame) -> DataFrame:
    """Counters of each session: turns, calls by family, results missing and failing, where it failed first, and how long it ran."""
    t = once(turns.select("session_id", "turn_index", "ingest_id", "recorded_at", "request_messages", "input_saved_tokens"))
    per = t.groupBy("session_id").agg(F.count("*").alias("n_turns"), F.max("request_messages").alias("most_messages"), F.sum("input_saved_tokens").alias("saved_tokens"), (F.unix_micros(F.max("recorded_at").cast("timestamp")) - F.unix_micros(F.min("recorded_at").cast("timestamp"))).alias("micros"))
    failed = T.has_error(F.col("raw"))
    fam = lambda f: F.count_if(F.col("family") == f)
    e = with_target(events)
    did = e.groupBy("session_id").agg(
        F.count("*").alias("n_uses"), fam("file_read").alias("n_reads"), fam("search").alias("n_searches"), fam("edit").alias("n_edits"), fam("command").alias("n_commands"), F.count_if(F.col("raw").isNull()).alias("n_missing"), F.count_if(failed).alias("n_failed"),
        F.min(F.when(failed, F.col("turn"))).alias("first_failure"), F.min_by("target", F.when(failed, F.struct("turn", "pos"))).alias("first_failed_target"), F.round(F.try_divide(F.count("*") * F.count_distinct("tool"), F.sum(T.token_estimate(F.col("raw")))), 4).alias("depth"),
    )
    return per.join(did, "session_id", "left")


def usage(turns: DataFrame) -> DataFrame:
    """Tokens of each turn by part, and its largest part."""
    t = once(turns.select("session_id", "turn_index", "ingest_id", "model", "prompt", "tool_uses", "tool_results"))
    total = lambda column, field: F.aggregate(F.coalesce(F.transform(column, field), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    inputs = total("tool_uses", lambda u: F.aggregate(F.coalesce(F.map_values(u["input"]), F.array().cast("array<string>")), F.lit(0).cast("bigint"), lambda a, v: a + F.floor(F.coalesce(F.length(v), F.lit(0)) / 4)))
    parts = t.select("session_id", F.col("turn_index").alias("turn"), "model", T.token_estimate(F.col("prompt")).alias("prompt_tokens"), inputs.alias("input_tokens"), total("tool_results", lambda r: T.token_estimate(r["content"])).alias("result_tokens"))
    largest = F.when((F.col("result_tokens") >= F.col("input_tokens")) & (F.col("result_tokens") >= F.col("prompt_tokens")), "results").when(F.col("input_tokens") >= F.col("prompt_tokens"), "inputs").otherwise("prompt")
    return parts.withColumn("total", F.col("prompt_tokens") + F.col("input_tokens") + F.col("result_tokens")).withColumn("largest", largest)


def bloat(used: DataFrame) -> DataFrame:
    """Each session's tokens by part, with shares and ranks: what its requests carry."""
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"{p}_tokens").alias("n")) for p in ("prompt", "input", "result")])
    per = used.select("session_id", F.inline(parts)).groupBy("session_id", "part").agg(F.sum("n").alias("n_tokens"))
    own = W.partitionBy("session_id")  # three rows
    return per.select("session_id", "part", "n_tokens", F.coalesce(F.try_divide(F.col("n_tokens") * 100.0, F.sum("n_tokens").over(own)), F.lit(0.0)).alias("pct"), F.row_number().over(own.orderBy(F.desc("n_tokens"), "part")).alias("rank"))


def fixture_metrics(blocks: DataFrame, records: DataFrame, meta: DataFrame) -> DataFrame:
    """Per fixture: records, results and their tokens, what their exact repeats within a record would save, against the least share asked of it."""
    owner = records.select(F.col("record_id").cast("string").alias("rec_key"), "fixture").distinct()
    r = blocks.filter("sub_pos = -1 and type = 'tool_result' and body is not null").select("rec_key", T.digest(F.col("body")).alias("h"), T.token_estimate(F.col("body")).alias("n"))
    each = r.groupBy("rec_key", "h").agg(F.count("*").alias("m"), F.first("n").alias("n")).groupBy("rec_key").agg(F.sum("m").alias("n_results"), F.sum(F.col("m") * F.col("n")).alias("before"), F.sum("n").alias("after"))
    per = each.join(owner, "rec_key").groupBy("fixture").agg(F.count("*").alias("n_records"), F.sum("n_results").alias("n_results"), F.sum("before").alias("before"), F.sum("after").alias("after"))
    both = per.join(meta.select("fixture", "min_savings_pct", F.coalesce("usage_weight", F.lit(1.0)).alias("weight")), "fixture", "left")
    return both.withColumn("saved_pct", F.when(F.col("before") > 0, (F.col("before") - F.col("after")) * 100.0 / F.col("before")).otherwise(0.0))


def weighted(metrics: DataFrame) -> DataFrame:
    """The fixtures' share saved by their weights."""
    return metrics.agg(F.count("*").alias("n_fixtures"), F.sum("weight").alias("weight"), F.try_divide(F.sum(F.col("weight") * F.col("saved_pct")), F.sum("weight")).alias("saved_pct"))


def duplicates(families: DataFrame, fields: DataFrame) -> DataFrame:
    """Names of the small tables that come up more than once, or in more than one family."""
    tools = families.groupBy(T.tool_name(F.col("tool_name")).alias("name")).agg(F.count("*").alias("n"), F.count_distinct("family").alias("n_groups")).withColumn("catalog", F.lit("tools"))
    keys = fields.select(F.explode(F.array("field", "short_key")).alias("name"), "unit").filter("name is not null").groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("unit").alias("n_groups")).withColumn("catalog", F.lit("fields"))
    per = tools.unionByName(keys)
    return per.groupBy("catalog").agg(F.count("*").alias("n_names"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.count_if(F.col("n_groups") > 1).alias("n_ambiguous"))


# ---- what is hot ------------------------------------------------------------------------------------------------


def hot_hints(events: DataFrame, k: int = 2) -> DataFrame:
    """The k hints of each session: its hot targets by how stuck they are, how recent, and what their last result cost."""
    r = repeats(events).filter("hot").select("session_id", "turn", "pos", "family", "target", "n_stuck")
    cost = events.select("session_id", "turn", "pos", T.token_estimate(F.col("raw")).alias("cost"))
    at = F.struct("turn", "pos")
    per = r.join(cost, ["session_id", "turn", "pos"]).groupBy("session_id", "family", "target").agg(F.max_by("n_stuck", at).alias("stuck"), F.max("turn").alias("last_seen"), F.max_by("cost", at).alias("avoided"))
    rank = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("stuck"), F.desc("last_seen"), F.desc("avoided"), "target"))
    return per.withColumn("rank", rank).filter(F.col("rank") <= k)


def advisories(events: DataFrame) -> DataFrame:
    """The first advice for each session: that a hot target brings nothing new, else that a directory is read over and over."""
    stale = repeats(events).filter("hot and same").groupBy("session_id").agg(F.min_by("target", F.struct("turn", "pos")).alias("about")).select("session_id", F.lit(0).alias("priority"), F.lit("nothing_new").alias("advice"), "about")
    from .events import neighbourhoods

    thrash = neighbourhoods(events).filter("n_busiest >= 3").groupBy("session_id").agg(F.min("parent").alias("about")).select("session_id", F.lit(1).alias("priority"), F.lit("directory_thrash").alias("advice"), "about")
    both = stale.unionByName(thrash)
    return both.groupBy("session_id").agg(F.min(F.struct("priority", "advice", "about")).alias("a")).select("session_id", "a.advice", "a.about")


def warm_ups(events: DataFrame, k: int = 3) -> DataFrame:
    """For the file each session read last, the k other files of its directory it read most recently."""
    e = events.filter("family = 'file_read' and path is not null").withColumn("parent", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    last = e.groupBy("session_id").agg(F.max_by(F.struct("path", "parent"), F.struct("turn", "pos")).alias("l")).select("session_id", F.col("l.path").alias("path"), F.col("l.parent").alias("parent"))
    others = e.groupBy("session_id", "parent", F.col("path").alias("neighbour")).agg(F.max(F.struct("turn", "pos")).alias("at"))
    near = others.join(last, ["session_id", "parent"]).filter("neighbour <> path")
    rank = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("at"), "neighbour"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("session_id", "path", "neighbour", "rank")


def hot_files(events: DataFrame, k: int = 5) -> DataFrame:
    """The k hottest files of each session: a read weighs 1, an edit 3."""
    e = events.filter("family in ('file_read', 'edit') and path is not null")
    per = e.groupBy("session_id", "path").agg(F.sum(F.when(F.col("family") == "edit", 3).otherwise(1)).alias("heat"))
    return per.withColumn("rank", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("heat"), "path"))).filter(F.col("rank") <= k)


def file_candidates(events: DataFrame, k: int = 5) -> DataFrame:
    """The files of each session by how many of its search words and of the words of its failing results they share."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) > 3))
    said = events.select("session_id", F.concat_ws(" ", "query", "command").alias("t")).filter("t <> ''").select("session_id", F.explode(words("t")).alias("w")).distinct()
    files = events.filter("family in ('file_read', 'edit') and path is not null").select("session_id", "path").distinct().select("session_id", "path", F.explode(words("path")).alias("w"))
    score = files.join(said, ["session_id", "w"]).groupBy("session_id", "path").agg(F.count("*").alias("score"))
    return score.withColumn("rank", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("score"), "path"))).filter(F.col("rank") <= k)
