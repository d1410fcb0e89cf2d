"""Requests as they were and as they became, what prompts ask for, and what a session's behaviour shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from .events import once, with_target
from .evidence import quarantined

# Beginnings of lines that set a goal, words of lines that limit it.
GOALS, TASKS, LIMITS = r"task:|goal:|requirement:|implement |add ", r"should|must|need to|implement", r"avoid|don't|do not|never|only"


def fingerprints(blocks: DataFrame) -> DataFrame:
    """The shape of each record without its texts: messages, blocks by type, roles in order, characters and their digest."""
    b = blocks.filter("sub_pos = -1")
    is_ = lambda t: F.count_if(F.col("type") == t)
    order = F.array_sort(F.collect_list(F.struct("msg_pos", "block_pos", F.coalesce("role", F.lit("-")).alias("role"), F.coalesce("type", F.lit("-")).alias("type"))))
    per = b.groupBy("rec_key").agg(F.count_distinct("msg_pos").alias("n_messages"), F.count_if(F.col("block_pos") >= 0).alias("n_blocks"), is_("tool_use").alias("n_uses"), is_("tool_result").alias("n_results"), F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("n_chars"), order.alias("o"))
    return per.select("rec_key", "n_messages", "n_blocks", "n_uses", "n_results", "n_chars", T.digest(F.array_join(F.transform("o", lambda x: F.concat_ws("/", x["role"], x["type"])), " ")).alias("topology"))


def fingerprint_diff(blocks: DataFrame) -> DataFrame:
    """Records whose fingerprint changes when their broken exchanges are dropped, with the differences; these are the signals of a rewrite."""
    bad = quarantined(blocks).select("rec_key", "msg_pos", "block_pos")
    before, after = fingerprints(blocks), fingerprints(blocks.join(bad, ["rec_key", "msg_pos", "block_pos"], "left_anti"))
    both = before.join(after.select("rec_key", *[F.col(c).alias(f"new_{c}") for c in after.columns[1:]]), "rec_key", "left")
    changed = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"new_{c}")), c) for c in ("n_messages", "n_blocks", "n_uses", "n_results", "topology")]))
    return both.select("rec_key", F.array_join(changed, ",").alias("changed"), (F.col("n_blocks") - F.coalesce("new_n_blocks", F.lit(0))).alias("n_dropped"), (F.col("n_chars") - F.coalesce("new_n_chars", F.lit(0))).alias("n_chars_dropped")).filter("changed <> ''")


def prompt_outline(documents: DataFrame, goals: int = 2, files: int = 3, limits: int = 2, n: int = 60) -> DataFrame:
    """Each text as goals, files and constraints, cut to n characters each; without any the first line of more than 10."""
    full = F.filter(F.transform(T.lines(F.col("text")), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith(">>>"))
    goal = lambda x: F.lower(x).rlike(GOALS) | (x.rlike(r"^([-*] |1\. )") & F.lower(x).rlike(TASKS))
    d = documents.filter("text is not null").select("doc_id", full.alias("full"))
    first = lambda c, k: F.transform(F.slice(c, 1, k), lambda x: F.substring(x, 1, n))
    d = d.select("doc_id", "full", first(F.filter("full", goal), goals).alias("goals"), F.slice(T.named_files(F.array_join("full", "\n")), 1, files).alias("files"), first(F.filter("full", lambda x: F.lower(x).rlike(LIMITS)), limits).alias("limits"))
    part = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ",")))
    said = F.concat_ws("|", part("goal:", F.col("goals")), part("files:", F.col("files")), part("constraints:", F.col("limits")))
    fallback = F.concat(F.lit("goal:"), F.coalesce(F.substring(F.get(F.filter("full", lambda x: F.length(x) > 10), F.lit(0)), 1, 100), F.lit("")))
    return d.select("doc_id", F.when(said == "", fallback).otherwise(said).alias("outline"))


def behaviour(events: DataFrame) -> DataFrame:
    """Signals of each session in long form: repeated reads, searches and commands with what they cost, repeated calls, errors that come back, workarounds."""
    e = with_target(events).filter("family is not null").select("session_id", "turn", "pos", "tool", "family", "target", "command", T.digest(F.col("raw")).alias("h"), T.token_estimate(F.col("raw")).alias("cost"), F.get(F.filter(T.lines(F.col("raw")), T.has_error), F.lit(0)).alias("blocker"))
    line = W.partitionBy("session_id", "target").orderBy("turn", "pos")
    e = e.withColumn("again", F.row_number().over(line) > 1).withColumn("same", F.coalesce(F.col("h") == F.lag("h").over(line), F.lit(False))).withColumn("nth_blocker", F.row_number().over(W.partitionBy("session_id", "blocker").orderBy("turn", "pos")))
    of = lambda f: (F.col("family") == f) & F.col("again")
    rows = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("signal"), v.cast("bigint").alias("value"))) for n, c, v in (
        ("repeat_file_read", of("file_read"), F.lit(1)), ("repeat_search", of("search"), F.lit(1)), ("repeat_command", of("command") & F.col("same"), F.lit(1)), ("reacquisition_cost_tokens", (of("file_read") | of("search")) & (F.col("cost") > 0), F.col("cost")),
        ("blocker_rediscovery", F.col("blocker").isNotNull() & (F.col("nth_blocker") == 2), F.lit(1)), ("workaround", F.coalesce(F.col("command").rlike(r"python3? -c|2>&1"), F.lit(False)), F.lit(1)), ("error_seen", F.col("blocker").isNotNull(), F.lit(1)),
    )]))
    return e.select("session_id", F.inline(rows)).groupBy("session_id", "signal").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


def latest_outcomes(events: DataFrame) -> DataFrame:
    """Per session and target the last outcome; failures before a later success are stale."""
    e = with_target(events).filter("raw is not null and family is not null").withColumn("failed", T.has_error(F.col("raw")))
    at = F.struct("turn", "pos")
    per = e.groupBy("session_id", "target").agg(F.max_by("failed", at).alias("failed"), F.count_if("failed").alias("n_failures"), F.count("*").alias("n"))
    return per.select("session_id", "target", F.when(F.col("failed"), "fail").otherwise("pass").alias("outcome"), "n", F.when(F.col("failed"), 0).otherwise(F.col("n_failures")).alias("n_stale"))


def signal_changes(turns: DataFrame) -> DataFrame:
    """How each turn's signals differ from those of the turn before: names with their old and new value, in order."""
    t = once(turns.select("session_id", "turn_index", "ingest_id", "input_behavior_signals")).select("session_id", F.col("turn_index").alias("turn"), F.coalesce("input_behavior_signals", F.expr("cast(map() as map<string,int>)")).alias("m"))
    t = t.withColumn("old", F.coalesce(F.lag("m").over(W.partitionBy("session_id").orderBy("turn")), F.expr("cast(map() as map<string,int>)")))
    diff = F.map_zip_with("old", "m", lambda k, a, b: F.struct(a.alias("a"), b.alias("b")))
    kept = F.array_sort(F.filter(F.map_entries(diff), lambda e: ~e["value"]["a"].eqNullSafe(e["value"]["b"])))
    show = lambda v: F.coalesce(v.cast("string"), F.lit("-"))
    return t.select("session_id", "turn", F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit(":"), show(e["value"]["a"]), F.lit(">"), show(e["value"]["b"]))), ",").alias("changes")).filter("changes <> ''")


def coverage(records: DataFrame, meta: DataFrame) -> DataFrame:
    """Fixtures that have records against those that have thresholds: covered, without thresholds, without records."""
    held = records.groupBy("fixture").agg(F.count_distinct("record_id").alias("n_records"))
    known = meta.select("fixture", F.lit(True).alias("known"), F.col("min_savings_pct").isNotNull().alias("required"))
    both = held.join(known, "fixture", "full")
    status = F.when(F.col("known").isNull(), "no_thresholds").when(F.col("n_records").isNull(), "no_records").when(F.col("required"), "required").otherwise("exploratory")
    return both.select("fixture", F.coalesce("n_records", F.lit(0)).alias("n_records"), status.alias("status"))


def graph_metrics(edges: DataFrame, most: int = 64) -> DataFrame:
    """(node, n_in, depth) of a graph (a, b): edges into each node and the longest way to it from a node without any; nodes only on cycles have none.

    Levels are joined one after the other, at most `most`; a longer way, or one around a cycle, raises.
    """
    e = edges.filter("a is not null and b is not null and a <> b").select("a", "b").distinct()
    indegree = e.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n_in"))
    level = e.select(F.col("a").alias("node")).distinct().join(indegree, "node", "left_anti").withColumn("depth", F.lit(0))
    seen = level
    for depth in range(1, most + 1):
        level = level.join(e, level["node"] == e["a"]).select(F.col("b").alias("node")).distinct().withColumn("depth", F.lit(depth))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    else:
        raise ValueError(f"a way of more than {most} edges, or a cycle")
    return seen.groupBy("node").agg(F.max("depth").alias("depth")).join(indegree, "node", "full").select("node", F.coalesce("n_in", F.lit(0)).alias("n_in"), "depth")


def registry(events: DataFrame, families: DataFrame) -> DataFrame:
    """Each tool's operations: how many, failed, without a result, first and last turn, and whether the catalog has it."""
    per = events.filter("tool is not null").groupBy("tool").agg(F.count("*").alias("n"), F.count_if(T.has_error(F.col("raw"))).alias("n_failed"), F.count_if(F.col("raw").isNull()).alias("n_missing"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count_distinct("session_id").alias("n_sessions"))
    known = families.select(T.tool_name(F.col("tool_name")).alias("tool"), F.lit(True).alias("registered")).distinct()
    return per.join(known, "tool", "left").withColumn("registered", F.coalesce("registered", F.lit(False)))


# ---- expressions of instructions --------------------------------------------------------------------------------


def number(op: str, a: Column, b: Column) -> Column:
    """add, sub, mul and div of two numbers; div rounds down, and by zero gives null."""
    return {"add": a + b, "sub": a - b, "mul": a * b, "div": F.floor(F.try_divide(a, b))}[op]


def listed(op: str, items: Column, argument: str | int | None = None) -> Column:
    """identity, len, reverse, unique, sort, get (from 0), join and filter (those that aren't blank) of a list."""
    return {
        "identity": lambda: items, "len": lambda: F.size(items), "reverse": lambda: F.reverse(items), "unique": lambda: F.array_distinct(items), "sort": lambda: F.array_sort(items),
        "get": lambda: F.get(items, F.lit(argument)), "join": lambda: F.array_join(items, str(argument)), "filter": lambda: F.filter(items, lambda x: x.isNotNull() & (x != "")),
    }[op]()


def instruction_values(turns: DataFrame) -> DataFrame:
    """The list and number operations over each turn's tool names and counts."""
    t = once(turns.select("session_id", "turn_index", "ingest_id", "request_messages", F.transform("tool_uses", lambda u: F.coalesce(u["name"], F.lit(""))).alias("names")))
    full = listed("filter", F.col("names"))
    n, m = F.coalesce(F.col("request_messages"), F.lit(0)).cast("bigint"), F.size("names").cast("bigint")
    return t.select(
        "session_id", F.col("turn_index").alias("turn"), listed("join", listed("reverse", full), ",").alias("reversed"), listed("join", listed("sort", listed("unique", full)), ",").alias("sorted"), listed("get", F.col("names"), 1).alias("second"), listed("len", full).alias("n"),
        *[number(op, n, m).alias(op) for op in ("add", "sub", "mul", "div")],
    )


def canonical_json(text: Column) -> Column:
    """A JSON text with its members in the order of their names and without blanks; other texts as they are."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def summaries(events: DataFrame, n: int = 120) -> DataFrame:
    """Each result in short, by family: a file's definitions, a search's hits and files, a command's first error or last line."""
    raw = F.col("raw")
    full = F.filter(T.lines(raw), lambda x: F.trim(x) != "")
    defs = F.filter(full, lambda x: x.rlike(r"^\s*(class|def|async def) "))
    hits = F.filter(full, lambda x: x.rlike(r"^[^\s:]+:[0-9]+:"))
    files = F.size(F.array_distinct(F.transform(hits, lambda x: F.substring_index(x, ":", 1))))
    text = (
        F.when(F.col("family") == "file_read", T.joined_within(F.when(F.size(defs) > 0, defs).otherwise(F.slice(full, 1, 3)), n))
        .when(F.col("family") == "search", F.concat_ws(" ", F.size(hits).cast("string"), F.lit("hits in"), files.cast("string"), F.lit("files")))
        .otherwise(F.substring(F.trim(F.coalesce(F.get(F.filter(full, T.has_error), F.lit(0)), F.try_element_at(full, F.lit(-1)), F.lit(""))), 1, n))
    )
    return events.filter("raw is not null and family is not null").select("session_id", "turn", "pos", "family", text.alias("summary"))


def prompt_checks(documents: DataFrame, large: int = 2000, paths: int = 6) -> DataFrame:
    """Texts taken as system prompts: too large ones, and what their outline would lose: too much of them, or files they name."""
    d = documents.filter("text is not null").join(prompt_outline(documents), "doc_id")
    n, m = F.length("text"), F.length("outline")
    lost = F.filter(F.slice(T.named_files(F.col("text")), 1, paths), lambda x: ~F.contains(F.col("outline"), x))
    reason = F.when((n >= large) & (m < F.greatest(F.lit(500), F.floor(n * 0.25))), "overcompressed").when(F.size(lost) > 0, "missing_required_path").otherwise("")
    return d.select("doc_id", (n > large).alias("bloated"), reason.alias("degraded"), F.size(lost).alias("n_lost_paths"))


# What a prompt says that asks for reading only, for no answer yet, for an answer, for a final plan.
INTENTS = {"read_only": r"read-only|do not (edit|change)", "no_answer": r"do not answer|no answer", "wants_answer": r"answer|explain|summari[sz]e|\?\s*$", "finalises": r"final (plan|answer)|finish|conclude", "audit": r"audit|review|investigat"}


def turn_intents(blocks: DataFrame) -> DataFrame:
    """What the last text a user wrote in each record asks for."""
    said = blocks.filter("role = 'user' and type = 'text' and sub_pos = -1 and body is not null")
    last = said.groupBy("rec_key").agg(F.max_by(F.lower("body"), F.struct("msg_pos", "block_pos")).alias("t"))
    return last.select("rec_key", *[F.col("t").rlike(p).alias(k) for k, p in INTENTS.items()])


def session_flags(events: DataFrame, keep: int = 2, recent: int = 6) -> DataFrame:
    """Per session the turns to keep whole (three at least while it is young), whether its first turn reads broadly, and whether what it read twice still stands in its last turns."""
    e = with_target(events).filter("family is not null")
    ends = e.groupBy("session_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.count_distinct("turn").alias("n_turns"))
    files = e.filter("family = 'file_read'")
    broad = files.join(ends, "session_id").filter("turn = first").groupBy("session_id").agg(F.count_distinct("path").alias("n_first"))
    need = files.groupBy("session_id", "target").agg(F.count("*").alias("n"), F.max("turn").alias("seen")).filter("n > 1").join(ends.select("session_id", "last"), "session_id")
    lost = need.groupBy("session_id").agg(F.count("*").alias("n_required"), F.count_if(F.col("seen") <= F.col("last") - recent).alias("n_lost"))
    out = ends.join(broad, "session_id", "left").join(lost, "session_id", "left").na.fill(0, ["n_first", "n_required", "n_lost"])
    return out.select("session_id", "n_turns", F.when(F.col("n_turns") < 3, max(keep, 3)).otherwise(keep).alias("keep_turns"), (F.col("n_first") >= 2).alias("broad_start"), "n_required", "n_lost", (F.col("n_lost") == 0).alias("faithful"))


def telemetry(events: DataFrame) -> DataFrame:
    """Events as lines of JSON: type, time, request, payload; works on batches and streams."""
    block = F.struct("event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.col("event_id").alias("request_id"), F.struct("user_id", "value").alias("payload"))
    return events.select(F.to_json(block).alias("line"))
