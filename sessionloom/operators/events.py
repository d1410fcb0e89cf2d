"""Tool events of recorded turns, and what follows from their order within a session.

`turns` are rows (session_id, turn_index, ...) with tool_uses and tool_results as in TESTDATA.md. Every operator takes
redelivered turns once and orders events by (turn, pos), a total order; windows run per session and key, so that a
session's rows meet in one task only where the order of the whole session matters.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from .stretches import STRETCH, ahead, carried, numbered, parted


def once(turns: DataFrame) -> DataFrame:
    """Each turn once, the delivery with the smallest ingest_id."""
    columns = [c for c in turns.columns if c not in ("session_id", "turn_index")]
    kept = turns.groupBy("session_id", "turn_index").agg(F.min_by(F.struct(*columns), "ingest_id").alias("t"))
    return kept.select("session_id", "turn_index", "t.*")


def tool_events(turns: DataFrame) -> DataFrame:
    """One row per tool use with its arguments and the text of its result; uses and results are paired inside the row they share, without a join."""
    u = F.col("u")
    args = F.coalesce(u["input"], F.expr("cast(map() as map<string,string>)"))
    rows = once(turns.select("session_id", "turn_index", "ingest_id", "workspace_root", "model", "recorded_at", "tool_uses", "tool_results")).select(
        "session_id", F.col("turn_index").alias("turn"), "workspace_root", "model", "recorded_at", "tool_results", F.posexplode("tool_uses").alias("pos", "u")
    )
    result = F.filter("tool_results", lambda r: r["tool_use_id"] == u["id"])
    return rows.select(
        "session_id", "turn", "pos", "model", "recorded_at", u["id"].alias("tool_use_id"), T.tool_name(u["name"]).alias("tool"), T.family(u["name"]).alias("family"),
        T.plain_path(T.path_argument(args), F.col("workspace_root")).alias("path"), T.query_argument(args).alias("query"), T.command_argument(args).alias("command"),
        args["offset"].try_cast("int").alias("offset"), args["limit"].try_cast("int").alias("n_lines"), "workspace_root",
        F.when(F.size(result) > 0, result[0]["content"]).alias("raw"), args.alias("args"),
    )


def target(family: Column, path: Column, query: Column, command: Column) -> Column:
    """What an event is about: a file, a search in a place, or a program."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return (
        F.when(family.isin("file_read", "edit"), F.concat(F.lit("file|"), blank(path)))
        .when(family == "search", F.concat_ws("|", F.lit("search"), blank(query), blank(path)))
        .when(family == "command", F.concat(F.lit("command|"), blank(T.command_family(command))))
        .otherwise(F.concat(F.lit("other|"), blank(path)))
    )


def with_target(events: DataFrame) -> DataFrame:
    return events.withColumn("target", target(F.col("family"), F.col("path"), F.col("query"), F.col("command")))


def repeats(events: DataFrame, hot: int = 6, stuck: int = 8) -> DataFrame:
    """Events with how often their target came up within the last `hot` and `stuck` turns, and whether the result stayed the same."""
    e = with_target(events).filter("family is not null")
    near = W.partitionBy("session_id", "target").orderBy("turn")
    line = W.partitionBy("session_id", "target").orderBy("turn", "pos")
    digest = T.digest(F.col("raw"))
    same = F.coalesce(F.col("digest") == F.lag("digest").over(line), F.lit(False))
    e = e.withColumn("digest", digest).withColumn("n_hot", F.count("*").over(near.rangeBetween(1 - hot, 0))).withColumn("n_stuck", F.count("*").over(near.rangeBetween(1 - stuck, 0)))
    e = e.withColumn("same", same).withColumn("n_same", F.sum(F.col("same").cast("int")).over(line.rowsBetween(W.unboundedPreceding, 0)))
    is_hot = (F.col("n_hot") >= 2) & ((F.col("family") != "file_read") | (F.col("n_same") >= 1))
    return e.select("session_id", "turn", "pos", "family", "target", "n_hot", "n_stuck", "same", "n_same", is_hot.alias("hot"), (F.col("n_stuck") >= 3).alias("stuck"))


def novelty(events: DataFrame) -> DataFrame:
    """Per session: events, distinct targets and events that bring nothing new, their target and result having been seen."""
    e = with_target(events).filter("family is not null").withColumn("key", F.concat_ws("|", "target", F.coalesce(T.digest(F.col("raw")), F.lit(""))))
    seen = F.row_number().over(W.partitionBy("session_id", "key").orderBy("turn", "pos")) > 1
    return e.withColumn("seen", seen).groupBy("session_id").agg(F.count("*").alias("n_events"), F.count_distinct("target").alias("n_targets"), F.sum(F.col("seen").cast("int")).alias("n_seen_before"))


def loops(events: DataFrame, length: int = 3, stretch: int = STRETCH) -> DataFrame:
    """Events that make their tool's and target's `length`-th use in a row."""
    e = with_target(events).filter("family is not null").withColumn("key", F.concat_ws("|", "tool", "target")).select("session_id", "turn", "pos", "tool", "target", "key")
    e = ahead(parted(e, "turn", stretch), "session_id", ("turn", "pos"), ("turn", "pos", "tool", "target", "key"), length - 1)
    found = e.filter(F.forall("next", lambda x: F.coalesce(x["key"] == F.col("key"), F.lit(False)))).select("session_id", F.col("next")[length - 2].alias("x"))
    return found.select("session_id", "x.turn", "x.pos", "x.tool", "x.target")


def recently_edited(events: DataFrame, steps: int = 2) -> DataFrame:
    """Reads of a file that was edited at most `steps` turns before."""
    e = events.filter("family in ('file_read','edit') and path is not null")
    line = W.partitionBy("session_id", "path").orderBy("turn", "pos").rowsBetween(W.unboundedPreceding, -1)
    e = e.withColumn("edited", F.last(F.when(F.col("family") == "edit", F.col("turn")), ignorenulls=True).over(line))
    return e.filter((F.col("family") == "file_read") & (F.col("turn") - F.col("edited") <= steps)).select("session_id", "turn", "pos", "path", "edited")


def neighbourhoods(events: DataFrame, within: int = 6, least: int = 3) -> DataFrame:
    """Directories of which at least `least` files were read, with their busiest stretch of `within` turns."""
    e = events.filter("family = 'file_read' and instr(path, '/') > 0").withColumn("parent", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    near = W.partitionBy("session_id", "parent").orderBy("turn").rangeBetween(1 - within, 0)
    e = e.withColumn("n", F.count("*").over(near))
    return e.groupBy("session_id", "parent").agg(F.count_distinct("path").alias("n_files"), F.max("n").alias("n_busiest"), F.count("*").alias("n_reads")).filter(F.col("n_files") >= least)


def dedup_opportunities(events: DataFrame) -> DataFrame:
    """Each result with its nearest earlier observation: of the same identity, the same canonical text, or from another tool.

    Three as-of look-ups, each a lag over its own key; what could have been saved is the estimate of the text's tokens.
    """
    e = with_target(events).filter("raw is not null and family is not null")
    identity, h, c = F.concat_ws("|", "family", "target"), T.digest(F.col("raw")), T.digest(T.canonical(F.col("raw"), F.col("workspace_root")))
    e = e.select("session_id", "turn", "pos", "tool", "family", "target", identity.alias("identity"), h.alias("h"), c.alias("c"), T.token_estimate(F.col("raw")).alias("n_tokens"))  # no text goes on
    before = lambda value, *key: F.lag(value).over(W.partitionBy("session_id", *key).orderBy("turn", "pos"))
    e = e.withColumn("last_h", before("h", "identity")).withColumn("last_c", before("c", "identity")).withColumn("same_raw", before("tool", "h")).withColumn("same_canonical", before("tool", "c"))
    kind = (
        F.when(F.col("last_h") == F.col("h"), "same_identity")
        .when(F.col("last_c") == F.col("c"), "canonical")
        .when(F.col("same_raw") == F.col("tool"), "alias")
        .when(F.col("same_raw").isNotNull(), "cross_tool")
        .when(F.col("same_canonical").isNotNull(), "cross_canonical")
        .when(F.col("last_h").isNotNull(), "changed")
        .otherwise("first_seen")
    )
    return e.select("session_id", "turn", "pos", "tool", "family", "target", kind.alias("repeat_class"), "n_tokens")


def dedup_summary(opportunities: DataFrame) -> DataFrame:
    """Per family and repeat class: results, tokens, and the tokens of repeats."""
    repeat = F.col("repeat_class").isin("same_identity", "canonical", "alias", "cross_tool", "cross_canonical")
    return opportunities.groupBy("family", "repeat_class").agg(F.count("*").alias("n_results"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.when(repeat, F.col("n_tokens")).otherwise(0)).alias("headroom"))


def hot_targets(opportunities: DataFrame, k: int = 10) -> DataFrame:
    """The k targets with the most repeated tokens; a top-k report."""
    repeat = opportunities.filter(~F.col("repeat_class").isin("first_seen", "changed"))
    per = repeat.groupBy("target").agg(F.sum("n_tokens").alias("headroom"), F.count("*").alias("n_repeats"))
    return per.orderBy(F.desc("headroom"), F.desc("n_repeats"), "target").limit(k)


def new_lines(events: DataFrame) -> DataFrame:
    """For each search result the lines no earlier result of the same search had, and whether leaving the others out is shorter."""
    e = with_target(events).filter("family = 'search' and raw is not null")
    parts = e.select("session_id", "turn", "pos", "target", "raw", F.posexplode(T.lines(F.col("raw"))).alias("line_no", "line"))
    first = F.row_number().over(W.partitionBy("session_id", "target", "line").orderBy("turn", "pos", "line_no")) == 1
    seen = parts.withColumn("fresh", first)
    return seen.groupBy("session_id", "turn", "pos").agg(
        F.count("*").alias("n_lines"), F.sum(F.col("fresh").cast("int")).alias("n_new"), F.sum(F.when(F.col("fresh"), F.length("line") + 1).otherwise(0)).alias("new_chars"), F.first(F.length("raw")).alias("n_chars")
    ).withColumn("shorter", F.col("new_chars") < F.col("n_chars"))


def range_overlap(events: DataFrame) -> DataFrame:
    """For each ranged read the lines that earlier reads of the file in the session already covered.

    A fold over the reads in order, whose state is the union of a file's ranges as disjoint intervals.
    """
    from .folds import folded

    def step(state: dict[str, list[int]], row: dict[str, int]) -> dict[str, int]:
        begins, ends = state.setdefault("begins", []), state.setdefault("ends", [])
        a, b = row["a"], row["b"]
        i, j = bisect_left(ends, a), bisect_right(begins, b)  # the intervals that touch [a, b)
        covered = sum(max(0, min(b, y) - max(a, x)) for x, y in zip(begins[i:j], ends[i:j]))
        if i < j:
            begins[i:j], ends[i:j] = [min(a, begins[i])], [max(b, ends[j - 1])]
        else:
            begins.insert(i, a)
            ends.insert(i, b)
        return {"n_lines": b - a, "n_covered": covered}

    e = events.filter("family = 'file_read' and path is not null and offset is not null and n_lines > 0").select("session_id", "turn", "pos", "path", F.col("offset").alias("a"), (F.col("offset") + F.col("n_lines")).alias("b"))
    rows = folded(e, ["session_id", "path"], ["turn", "pos"], step, "session_id string, turn int, pos int, path string, a int, b int, n_lines int, n_covered int")
    return rows.drop("a", "b")


def cached(events: DataFrame) -> DataFrame:
    """Outcomes of a result cache without expiry, per target: stored, unchanged, changed against the stored base."""
    e = with_target(events).filter("raw is not null and family in ('file_read','search')").withColumn("h", T.digest(F.col("raw")))
    base = F.first("h").over(W.partitionBy("session_id", "target").orderBy("turn", "pos").rowsBetween(W.unboundedPreceding, 0))
    at = F.row_number().over(W.partitionBy("session_id", "target").orderBy("turn", "pos"))
    e = e.withColumn("outcome", F.when(at == 1, "stored").when(base == F.col("h"), "unchanged").otherwise("changed"))
    return e.groupBy("family", "outcome").agg(F.count("*").alias("n_results"), F.sum(T.token_estimate(F.col("raw"))).alias("n_tokens"))


def signals(turns: DataFrame) -> DataFrame:
    """Behaviour signals in long form: one row per turn and signal."""
    return once(turns.select("session_id", "turn_index", "ingest_id", "model", "input_behavior_signals")).select("session_id", F.col("turn_index").alias("turn"), "model", F.explode("input_behavior_signals").alias("signal", "value"))


def signal_totals(turns: DataFrame) -> DataFrame:
    return signals(turns).groupBy("session_id", "signal").agg(F.sum("value").alias("total"), F.count("*").alias("n_turns"), F.max("value").alias("most"))


def retention(turns: DataFrame, heavy: int = 200) -> DataFrame:
    """Per session: results, their characters and tokens, and the heavy ones."""
    r = once(turns.select("session_id", "turn_index", "ingest_id", "tool_results")).select("session_id", F.explode("tool_results").alias("r")).withColumn("n", T.token_estimate(F.col("r.content")))
    return r.groupBy("session_id").agg(F.count("*").alias("n_results"), F.sum(F.coalesce(F.length("r.content"), F.lit(0))).alias("n_chars"), F.sum("n").alias("n_tokens"), F.count_if(F.col("n") >= heavy).alias("n_heavy"))


def pairing(turns: DataFrame) -> DataFrame:
    """Per turn: calls issued, answered, missing, answers to no call; arrays, so no join."""
    t = once(turns.select("session_id", "turn_index", "ingest_id", F.col("tool_uses.id").alias("uses"), F.col("tool_results.tool_use_id").alias("results")))
    missing, unknown = F.array_except("uses", "results"), F.array_except("results", "uses")
    return t.select("session_id", F.col("turn_index").alias("turn"), F.size("uses").alias("n_calls"), F.size(F.array_intersect("uses", "results")).alias("n_answered"), F.size(missing).alias("n_missing"), F.size(unknown).alias("n_unknown")).filter("n_missing > 0 or n_unknown > 0")


def ngrams(events: DataFrame, sizes: tuple[int, ...] = (2, 3), least: int = 3) -> DataFrame:
    """Frequent sequences of tools: each n-gram of a session's events, its count and sessions; those inside an equally frequent longer one are left out."""
    e = ahead(parted(events.filter("tool is not null").select("session_id", "turn", "pos", "tool"), "turn"), "session_id", ("turn", "pos"), ("tool",), max(sizes) - 1)
    following = e.select("session_id", F.concat(F.array("tool"), F.col("next.tool")).alias("tools"))
    grams = following.select("session_id", F.explode(F.array(*[F.slice("tools", 1, n) for n in sizes])).alias("gram")).filter(F.forall("gram", lambda x: x.isNotNull()))
    counted = grams.withColumn("gram", F.array_join("gram", " > ")).groupBy("gram").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("n_sessions")).filter(F.col("n") >= least).withColumn("size", F.size(F.split("gram", " > ")))
    parts = counted.select(F.col("n").alias("m"), F.explode(F.array(F.regexp_extract("gram", "^(.*) > [^>]*$", 1), F.regexp_extract("gram", "^[^>]* > (.*)$", 1))).alias("gram"))
    inside = parts.groupBy("gram").agg(F.max("m").alias("m"))
    return counted.join(inside, "gram", "left").filter(F.coalesce(F.col("m") < F.col("n"), F.lit(True))).drop("m")


def highest_before(turns: DataFrame) -> DataFrame:
    """turns with the highest turn number of the session's rows that arrived before."""
    return carried(parted(turns, "ingest_id", 1 << 16), "session_id", ("ingest_id",), "highest", F.max("turn_index"), F.max("turn_index"), "max").drop("part")


def out_of_order(turns: DataFrame) -> DataFrame:
    """Turns that were recorded later in a session than a turn of a higher number, by order of arrival."""
    seen = highest_before(turns.select("session_id", "turn_index", "ingest_id"))
    return seen.filter("turn_index < highest").select("session_id", F.col("turn_index").alias("turn"), "ingest_id", "highest")


def top_values(events: DataFrame, k: int = 3) -> DataFrame:
    """A session's history in short: per field the k values with the highest sum of recency weights, ties by value."""
    e = events.filter("family is not null")
    command = T.command_family(F.col("command"))
    e = numbered(parted(e.select("session_id", "turn", "pos", "path", command.alias("command"), "query"), "turn"), "session_id", ("turn", "pos"), "weight")
    fields = F.array(F.struct(F.lit("file").alias("field"), F.col("path").alias("value")), F.struct(F.lit("command").alias("field"), F.col("command").alias("value")), F.struct(F.lit("query").alias("field"), F.col("query").alias("value")))
    long = e.select("session_id", "weight", F.inline(fields)).filter("value is not null")
    scored = long.groupBy("session_id", "field", "value").agg(F.sum("weight").alias("score"))
    rank = F.row_number().over(W.partitionBy("session_id", "field").orderBy(F.desc("score"), "value"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def state_line(top: DataFrame) -> DataFrame:
    """The short history as one line per session."""
    per = top.groupBy("session_id", "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]), ",").alias("values"))
    return per.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "field", "values"))), "|").alias("line"))
