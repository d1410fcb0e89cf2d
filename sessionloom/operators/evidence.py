"""What a session has seen of its files, and repairs of its messages; keys and windows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from .events import with_target


def ledger(events: DataFrame) -> DataFrame:
    """Per session and file: reads, the first whole read, the form last seen, and whether an edit came after the last read."""
    e = events.filter("family in ('file_read', 'edit') and path is not null")
    form = F.when(F.col("family") == "edit", None).when(F.col("offset").isNull(), "whole").otherwise("part")
    at = F.struct("turn", "pos")
    e = e.withColumn("form", form).withColumn("at", at)
    per = e.groupBy("session_id", "path").agg(
        F.count_if(F.col("family") == "file_read").alias("n_reads"), F.min(F.when(F.col("form") == "whole", F.col("turn"))).alias("first_whole_turn"),
        F.max_by("form", F.when(F.col("form").isNotNull(), F.col("at"))).alias("last_form"), F.max(F.when(F.col("family") == "edit", F.col("at"))).alias("edited"), F.max(F.when(F.col("family") == "file_read", F.col("at"))).alias("read"),
    )
    return per.select("session_id", "path", "n_reads", "first_whole_turn", "last_form", F.coalesce(F.col("edited") > F.col("read"), F.col("edited").isNotNull()).alias("stale"))


def blind_edits(events: DataFrame) -> DataFrame:
    """Edits of files that were last seen in part, or not at all, in their session: an as-of look-up by window."""
    e = events.filter("family in ('file_read', 'edit') and path is not null")
    line = W.partitionBy("session_id", "path").orderBy("turn", "pos").rowsBetween(W.unboundedPreceding, -1)
    e = e.withColumn("seen", F.last(F.when(F.col("family") == "file_read", F.when(F.col("offset").isNull(), "whole").otherwise("part")), ignorenulls=True).over(line))
    return e.filter("family = 'edit' and (seen is null or seen = 'part')").select("session_id", "turn", "pos", "path", F.coalesce("seen", F.lit("never")).alias("seen"))


def aliases(events: DataFrame, least: int = 200) -> DataFrame:
    """Reads whose text an earlier read of another path in the session gave: the first such path is the original."""
    e = events.filter(f"family = 'file_read' and path is not null and length(raw) >= {least}").withColumn("h", T.digest(F.col("raw")))
    first = F.first("path").over(W.partitionBy("session_id", "h").orderBy("turn", "pos"))
    return e.withColumn("original", first).filter("original <> path").select("session_id", "turn", "pos", "path", "original")


def skeleton_diff(events: DataFrame) -> DataFrame:
    """Signatures that a file's last read in a session has more, less or otherwise than its first: a full outer join by name."""
    e = events.filter("family = 'file_read' and path is not null and raw is not null")
    ends = e.groupBy("session_id", "path").agg(F.min_by("raw", F.struct("turn", "pos")).alias("a"), F.max_by("raw", F.struct("turn", "pos")).alias("b"), F.count("*").alias("n")).filter("n > 1 and a <> b")

    def named(text: str, side: str) -> DataFrame:
        found = ends.select("session_id", "path", F.explode(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*((?:def|class)[ \t]+[A-Za-z_][A-Za-z0-9_]*[^\n]*)"))).alias("line"))
        return found.select("session_id", "path", F.regexp_extract("line", r"^(?:def|class)[ \t]+([A-Za-z_][A-Za-z0-9_]*)", 1).alias("name"), "line").groupBy("session_id", "path", "name").agg(F.min("line").alias(side))

    both = named("a", "old").join(named("b", "new"), ["session_id", "path", "name"], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.withColumn("change", change).filter("change is not null").select("session_id", "path", "name", "change")


def safe_ids(blocks: DataFrame, pattern: str = "^[a-zA-Z0-9_-]{1,16}$") -> DataFrame:
    """Ids a provider would refuse, with the id that replaces them in calls and results alike: derived from the id, so no join is needed."""
    ids = blocks.filter("sub_pos = -1").select("rec_key", F.coalesce("id", "tool_use_id").alias("old"), "type").filter(f"old is not null and not (old rlike '{pattern}')")
    return ids.groupBy("rec_key", "old").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("type") == "tool_use").alias("n_calls")).withColumn("new", F.concat(F.lit("id_"), T.digest(F.col("old"), 12)))


def quarantined(blocks: DataFrame) -> DataFrame:
    """Blocks to drop so that every call has its result and every result its call."""
    b = blocks.filter("sub_pos = -1")
    answered = b.filter("type = 'tool_result' and call_msg_pos >= 0").select("rec_key", F.col("call_msg_pos").alias("msg_pos"), F.col("call_block_pos").alias("block_pos")).distinct()
    calls = b.filter("type = 'tool_use'").select("rec_key", "msg_pos", "block_pos").join(answered, ["rec_key", "msg_pos", "block_pos"], "left_anti").withColumn("reason", F.lit("unanswered"))
    return calls.unionByName(b.filter("type = 'tool_result' and call_msg_pos < 0").select("rec_key", "msg_pos", "block_pos", F.lit("no_call").alias("reason")))


def reordered(blocks: DataFrame) -> DataFrame:
    """New positions where an assistant's calls come after its other blocks, each in their order; only blocks that move."""
    b = blocks.filter("sub_pos = -1 and role = 'assistant'").select("rec_key", "msg_pos", "block_pos", "type")
    order = W.partitionBy("rec_key", "msg_pos").orderBy((F.col("type") == "tool_use").cast("int"), "block_pos")
    return b.withColumn("new_pos", F.row_number().over(order) - 1).filter("new_pos <> block_pos").select("rec_key", "msg_pos", "block_pos", "new_pos")


def structural_lines(events: DataFrame, k: int = 5) -> DataFrame:
    """The k most telling lines of each read, in file order: definitions, then errors, then imports; a per-text top-k."""
    lines = events.filter("family = 'file_read' and raw is not null").select("session_id", "turn", "pos", F.posexplode(T.lines(F.col("raw"))).alias("line_no", "line"))
    score = F.when(F.col("line").rlike(r"^\s*(def|class) "), 3).when(F.lower("line").rlike("error|raise|fail"), 2).when(F.col("line").rlike("^(import|from) "), 1).otherwise(0)
    rank = F.row_number().over(W.partitionBy("session_id", "turn", "pos").orderBy(F.desc("score"), "line_no"))
    return lines.withColumn("score", score).filter("score > 0").withColumn("rank", rank).filter(F.col("rank") <= k).select("session_id", "turn", "pos", "line_no", "score")


def pointers(events: DataFrame, most: int = 60) -> DataFrame:
    """Words worth an alias: (tokens - 2) * count - tokens > 2, the `most` best; a top-k report."""
    words = events.filter("raw is not null").select(F.explode(F.regexp_extract_all("raw", F.lit("([A-Za-z0-9_./-]{12,})"))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).withColumn("tokens", F.floor(F.length("word") / 4))
    profit = (F.col("tokens") - 2) * F.col("n") - F.col("tokens")
    return counted.withColumn("profit", profit).filter("profit > 2").orderBy(F.desc("profit"), "word").limit(most)


def prompt_words(turns: DataFrame, least: int = 2) -> DataFrame:
    """How often prompts begin with a word, by model: counts of prompts that aren't null."""
    first = F.lower(F.regexp_extract("prompt", r"^\s*(\S+)", 1))
    return turns.filter("prompt is not null").groupBy("model", first.alias("word")).agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("n_sessions")).filter(F.col("n") >= least)


def unchanged_targets(events: DataFrame) -> DataFrame:
    """Per target over all sessions: results, distinct results, and sessions; what is stable can be kept across sessions."""
    e = with_target(events).filter("raw is not null and family is not null").withColumn("h", T.digest(F.col("raw")))
    return e.groupBy("target").agg(F.count("*").alias("n_results"), F.count_distinct("h").alias("n_forms"), F.count_distinct("session_id").alias("n_sessions")).filter("n_results > 1")
