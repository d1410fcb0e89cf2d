"""Queries over trace blocks, and their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import traces as R
from ..sources import table
from .sessions import _BASE


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """The emitted blocks of all events, and as foreign lines those of the savings files."""
    own = R.emitted(E.tool_events(table(spark, d, "stress_turns"))).select(F.col("session_id").alias("source"), (F.col("turn") * 1000 + F.col("pos")).alias("line_no"), "line")
    other = table(spark, d, "savings_records").groupBy("file_id", "line_no").agg(F.min("raw").alias("line")).select(F.col("file_id").alias("source"), "line_no", "line")
    return own.unionByName(other)


QUERIES = {
    "trace_lines": lambda spark, d: R.emitted(E.tool_events(table(spark, d, "stress_turns"))),
    "trace_verdicts": lambda spark, d: R.audited(_lines(spark, d)),
    "trace_digests": lambda spark, d: R.emitted(E.tool_events(table(spark, d, "stress_turns"))).select("session_id", "turn", "pos", R.digests("line").alias("digest")),
    "trace_delta_audit": lambda spark, d: R.delta_audit(E.tool_events(table(spark, d, "stress_turns"))),
}

_TR = """
k0 AS (SELECT *, coalesce(path, query, program) AS ky, sha256(raw) AS hh, octet_length(encode(raw)) AS sz FROM x),
k1 AS (SELECT *, lag(hh) OVER (PARTITION BY session_id, family, ky ORDER BY turn, pos) AS old FROM k0),
k2 AS (SELECT *, CASE WHEN hh IS NULL THEN 'fallback' WHEN old IS NULL THEN 'store' WHEN old = hh THEN 'reference' ELSE 'delta' END AS act, CASE WHEN family IN ('file_read', 'edit') THEN 'file' WHEN family = 'search' THEN 'search' WHEN family IS NOT NULL THEN 'tool' END AS cls,
  regexp_matches(lower(raw), '{err}') AS failed FROM k1)
""".replace("{err}", "|".join(__import__("sessionloom.functions.text", fromlist=["ERROR_MARKS"]).ERROR_MARKS))
ORACLES = {
    "trace_verdicts": f"""WITH {_BASE}, {_TR} SELECT session_id AS source, turn * 1000 + pos AS line_no, session_id || '/' || turn || '/' || pos AS block_id, CASE WHEN codes <> '' THEN 'fail' ELSE 'warn' END AS status, CASE WHEN codes <> '' THEN codes ELSE concat_ws(',', 'draft_payload_digest_uncomputed', CASE act WHEN 'fallback' THEN 'unresolvable_fallback_required' WHEN 'reference' THEN 'resolvable_remote' END) END AS codes
        FROM (SELECT *, concat_ws(',', CASE WHEN cls IS NULL THEN 'invalid_class' END, CASE WHEN coalesce(ky, '') = '' THEN 'invalid_key' END, CASE WHEN failed AND hh IS NOT NULL THEN 'missing_reason' END, CASE WHEN act IN ('store', 'delta') AND tool_use_id IS NULL THEN 'available_local_missing_resolver' END) AS codes FROM k2)
        UNION ALL SELECT file_id, line_no, NULL, 'fail', CASE WHEN NOT json_valid(line) THEN 'invalid_jsonl_line' WHEN json_type(line::json) <> 'OBJECT' THEN 'jsonl_line_not_object' ELSE 'missing_section:envelope,missing_section:observation,missing_section:content,missing_section:audit' END
        FROM (SELECT file_id, line_no, min(raw) AS line FROM savings_records GROUP BY ALL) WHERE line IS NOT NULL AND trim(line, ' ') <> ''""",
}
