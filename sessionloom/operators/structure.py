"""Structure of texts as node tables, and audits of event traces; Column expressions and windows per document only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from .events import highest_before


def markdown_nodes(documents: DataFrame) -> DataFrame:
    """One row per line that isn't blank: kind, level, whether fenced, and the line of the heading it stands under."""
    lines = documents.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line")).filter(F.trim("line") != "")
    upto = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    fence = F.col("line").startswith("```")
    lines = lines.withColumn("fenced", F.coalesce(F.sum(fence.cast("int")).over(upto), F.lit(0)) % 2 == 1)
    kind = F.when(fence, "fence").when(F.col("fenced"), "code").when(F.col("line").rlike("^#{1,6} "), "heading").when(F.col("line").rlike(r"^\s*[-*+] "), "item").when(F.col("line").rlike(r"^\|.*\|$"), "row").otherwise("text")
    level = F.when(kind == "heading", F.length(F.regexp_extract("line", "^(#+)", 1))).when(kind == "item", F.length(F.regexp_extract("line", r"^(\s*)", 1))).otherwise(0)
    nodes = lines.withColumn("kind", kind).withColumn("level", level)
    return nodes.withColumn("parent", F.last(F.when(F.col("kind") == "heading", F.col("line_no")), ignorenulls=True).over(upto)).select("doc_id", "line_no", "kind", "level", "fenced", "parent")


def signatures(documents: DataFrame) -> DataFrame:
    """Functions and classes defined in the texts' code: name, kind, indentation, number of parameters."""
    lines = documents.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))
    found = lines.withColumn("kind", F.regexp_extract("line", r"^\s*(def|class)\s+[A-Za-z_]\w*", 1)).filter("kind <> ''")
    parameters = F.regexp_extract("line", r"\(([^)]*)\)", 1)
    return found.select("doc_id", "line_no", "kind", F.regexp_extract("line", r"(?:def|class)\s+([A-Za-z_]\w*)", 1).alias("name"), F.length(F.regexp_extract("line", r"^(\s*)", 1)).alias("indent"), F.when(F.trim(parameters) == "", 0).otherwise(F.size(F.split(parameters, ","))).alias("n_parameters"))


def trace_audit(turns: DataFrame) -> DataFrame:
    """Findings per recorded row: delivered again, out of order, lacking fields; one row per row and code."""
    by_key = W.partitionBy("session_id", "turn_index").orderBy("ingest_id")
    t = turns.select("ingest_id", "session_id", "turn_index", "prompt", "workspace_id", "model", F.size("tool_uses").alias("u"), "recorded_at")
    t = highest_before(t.withColumn("nth", F.row_number().over(by_key)))
    codes = F.array_compact(
        F.array(
            F.when(F.col("nth") > 1, "duplicate"), F.when(F.col("turn_index") < F.col("highest"), "out_of_order"), F.when(F.col("prompt").isNull(), "missing_prompt"),
            F.when(F.col("workspace_id").isNull(), "missing_workspace"), F.when(F.col("model").isNull(), "missing_model"), F.when(F.col("u") == 0, "no_tool_use"),
        )
    )
    return t.select("ingest_id", "session_id", F.explode(codes).alias("code"))


def shared_lines(documents: DataFrame, least: int = 20) -> DataFrame:
    """Lines that stand in several sources, with the number of sources and texts; an intersection by key, not by pairs."""
    lines = documents.select("doc_id", "source", F.explode(F.array_distinct(T.lines(F.col("text")))).alias("line")).filter(F.length("line") >= least)
    return lines.groupBy("line").agg(F.count_distinct("source").alias("n_sources"), F.count("*").alias("n_texts")).filter("n_sources > 1")


def redacted(documents: DataFrame) -> DataFrame:
    """Texts in which something had to be masked, with the masked text's digest."""
    d = documents.select("doc_id", "text", T.redact(F.col("text")).alias("masked")).filter("masked <> text")
    return d.select("doc_id", T.digest(F.col("masked")).alias("digest"), (F.length("text") - F.length("masked")).alias("n_masked"))
