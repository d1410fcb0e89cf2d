"""Queries of the subpackage: (spark, folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import unnest
from ..plans.message_sql import BLOCKS, RESULTS
from ..sources import table
from . import formatting, mixing, neardup, packing, runs, spans, tokens, truncation


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_runs(spark, d).select("session_id", "first_turn", "first_pos", "last_turn", "last_pos")


def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.runs(table(spark, d, "stress_turns"), table(spark, d, "tool_families"))


def results(spark: SparkSession, d: str) -> DataFrame:
    """(tool_use_id, content) of all tool results of both tables."""
    return unnest.tool_results(table(spark, d, "stress_turns"), table(spark, d, "replay_records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting.copies(results(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(results(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.spans(results(spark, d))


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.shares(results(spark, d), spans.spans(results(spark, d)))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(table(spark, d, "documents"))


def p7_windows(spark: SparkSession, d: str) -> DataFrame:
    """The contents of the windows, for every capacity."""
    return packing.windows(tokens.sizes(table(spark, d, "documents"), "doc_id"), table(spark, d, "context_windows"))


def p7_unused(spark: SparkSession, d: str) -> DataFrame:
    return packing.unused(p7_windows(spark, d), table(spark, d, "context_windows"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "documents").withColumn("text_key", F.md5("text"))
    return mixing.mix(tokens.sizes(keyed, "doc_id", "source", "text_key"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p8_mix(spark, d), table(spark, d, "mix_targets"))


QUERIES = {"p7_windows": p7_windows, "p7_unused": p7_unused, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_rates": p9_rates, "p4_found": p4_found, "p4_shares": p4_shares, "p6_found": p6_found, "p5_found": p5_found, "p3_found": p3_found, "p3_runs": p3_runs}
_FAMILY = "regexp_replace(lower(regexp_replace(trim({}), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+', '_', 'g')"
_RUNS = f"""WITH t AS (SELECT * FROM stress_turns QUALIFY row_number() OVER (PARTITION BY session_id, turn_index ORDER BY ingest_id) = 1),
u AS (SELECT session_id, turn_index AS turn, recorded_at AS tm, workspace_root, unnest(tool_uses) AS u, unnest(range(len(tool_uses)))::INT AS pos FROM t),
p AS (SELECT *, u.name AS name, regexp_replace(replace(trim(coalesce(u.input['path'], u.input['file_path'])), '\\', '/'), '^file://', '') AS p FROM u),
q AS (SELECT *, CASE WHEN starts_with(p, '/') THEN p ELSE workspace_root || '/' || p END AS q FROM p),
v AS (SELECT session_id, turn, pos, tm, CASE WHEN name IS NOT NULL AND p <> '' THEN coalesce(family, 'x' || {_FAMILY.format('name')}) || ' ' || regexp_replace(regexp_replace(regexp_replace(q, '/+', '/', 'g'), '/(\\./)+', '/', 'g'), '[^/]+/\\.\\./', '', 'g') END AS v
  FROM q LEFT JOIN tool_families ON {_FAMILY.format('tool_name')} = {_FAMILY.format('name')}),
i AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn, pos) - row_number() OVER (PARTITION BY session_id, v ORDER BY turn, pos) AS i FROM v),
r AS (SELECT session_id, min((turn, pos)) AS a, max((turn, pos)) AS b, count(*) AS n_uses, min(tm) AS started_at, max(tm) AS ended_at FROM i WHERE v IS NOT NULL GROUP BY session_id, v, i HAVING count(*) > 1)
SELECT session_id, a[1] AS first_turn, a[2] AS first_pos, b[1] AS last_turn, b[2] AS last_pos"""
# Brute force over all pairs of texts that share a word sequence, and over all stretches of 240 characters.
_SAME_WORDS = f"""WITH {BLOCKS}, {RESULTS}, w AS (SELECT tool_use_id, content, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS w FROM rs WHERE length(content) >= 80),
c AS (SELECT list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s, tool_use_id, content FROM w),
k AS (SELECT min(tool_use_id) AS id, any_value(s) AS s, list(tool_use_id) AS ids FROM c GROUP BY CASE WHEN len(s) > 0 THEN array_to_string(list_sort(s), chr(10)) ELSE chr(0) || content END),
t AS (SELECT id, len(s) AS n, unnest(s) AS g FROM k),
p AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS m FROM t a JOIN t b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id HAVING count(*) >= 0.7 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT * FROM (WITH RECURSIVE x(a, b) AS (SELECT a, b FROM e UNION SELECT x.a, e.b FROM x JOIN e ON x.b = e.a) SELECT a, b FROM x)),
g AS (SELECT k.id, least(k.id, coalesce(min(r.b), k.id)) AS root FROM k LEFT JOIN r ON r.a = k.id GROUP BY k.id)
SELECT root AS keep_id, m AS member_id FROM (SELECT root, unnest(ids) AS m FROM k JOIN g USING (id)) WHERE m <> root"""
_STRETCHES = f"""WITH {BLOCKS}, {RESULTS}, d AS (SELECT tool_use_id, content FROM rs WHERE length(content) >= 240),
q AS (SELECT tool_use_id, i, hash(substr(content, i + 1, 240)) AS h FROM (SELECT tool_use_id, content, unnest(range(length(content) - 239)) AS i FROM d)),
y AS (SELECT h FROM q GROUP BY h HAVING min(tool_use_id) <> max(tool_use_id)),
z AS (SELECT tool_use_id, i, lag(i) OVER (PARTITION BY tool_use_id ORDER BY i) AS o FROM q JOIN y USING (h)),
v AS (SELECT *, sum(CASE WHEN o IS NULL OR i - o > 240 THEN 1 ELSE 0 END) OVER (PARTITION BY tool_use_id ORDER BY i) AS k FROM z)
SELECT tool_use_id, min(i)::INT AS span_start, (max(i) + 240)::INT AS span_end FROM v GROUP BY tool_use_id, k"""
ORACLES: dict[str, str] = {
    "p4_found": _STRETCHES,
    "p6_found": _SAME_WORDS,
    "p3_found": f"{_RUNS} FROM r",
    "p3_runs": f"{_RUNS}, n_uses, started_at, ended_at, (epoch_us(ended_at) - epoch_us(started_at)) / 1e6 AS seconds FROM r",
}
