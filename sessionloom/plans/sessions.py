"""Queries over recorded turns and their SQL forms for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import events as E
from ..sources import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return E.tool_events(table(spark, d, "stress_turns"))


def _of_events(f, *a):  # type: ignore[no-untyped-def]
    return lambda spark, d: f(_events(spark, d), *a)


def _of_turns(f):  # type: ignore[no-untyped-def]
    return lambda spark, d: f(table(spark, d, "stress_turns"))


def tool_events(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return e.select("session_id", "turn", "pos", "tool_use_id", "tool", "family", "path", "query", T.command_family(F.col("command")).alias("program"), F.length("raw").alias("n_chars"))


def content_kinds(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("kind", T.content_kind(F.col("raw")))
    return e.groupBy("kind").agg(F.count("*").alias("n"), F.sum(T.token_estimate(F.col("raw"))).alias("n_tokens"), F.count_if(T.has_error(F.col("raw"))).alias("n_errors"))


def canonical_groups(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).filter("raw is not null")
    c = T.digest(T.canonical(F.col("raw"), F.col("workspace_root")))
    return e.groupBy(c.alias("digest")).agg(F.count("*").alias("n"), F.count_distinct("raw").alias("n_forms")).filter("n > 1")


QUERIES = {
    "tool_events": tool_events,
    "repeat_windows": _of_events(E.repeats),
    "novelty_missing": _of_events(E.novelty),
    "loop_events": _of_events(E.loops),
    "recently_edited_reads": _of_events(E.recently_edited),
    "directory_heat": _of_events(E.neighbourhoods),
    "dedup_opportunities": _of_events(E.dedup_opportunities),
    "dedup_source_summary": lambda spark, d: E.dedup_summary(E.dedup_opportunities(_events(spark, d))),
    "hot_targets": lambda spark, d: E.hot_targets(E.dedup_opportunities(_events(spark, d))),
    "overlap_new_lines": _of_events(E.new_lines),
    "range_overlap": _of_events(E.range_overlap),
    "result_cache_outcomes": _of_events(E.cached),
    "signal_totals": _of_turns(E.signal_totals),
    "tool_result_retention": _of_turns(E.retention),
    "pairing_risks": _of_turns(E.pairing),
    "ngram_patterns": _of_events(E.ngrams),
    "sequence_order": _of_turns(E.out_of_order),
    "history_topk": _of_events(E.top_values),
    "history_state_line": lambda spark, d: E.state_line(E.top_values(_events(spark, d))),
    "content_kinds": content_kinds,
    "canonical_groups": canonical_groups,
}

_FAMILY = " ".join(f"WHEN tool IN ({', '.join(repr(n) for n in names)}) THEN '{f}'" for f, names in T.FAMILIES.items())
_CANONICAL = "regexp_replace(raw, '\\r\\n?', chr(10), 'g')"
for _p, _tag in T.VOLATILE:
    _CANONICAL = f"regexp_replace({_CANONICAL}, '{_p}', '{_tag}', 'g')"
_CANONICAL = f"CASE WHEN coalesce(workspace_root, '') <> '' THEN replace({_CANONICAL}, workspace_root, '$CWD') ELSE {_CANONICAL} END"
_CANONICAL = f"regexp_replace(regexp_replace({_CANONICAL}, '[ \\t]+', ' ', 'g'), '(?m) +$', '', 'g')"

_BASE = f"""
t AS (SELECT * FROM stress_turns QUALIFY row_number() OVER (PARTITION BY session_id, turn_index ORDER BY ingest_id) = 1),
u0 AS (SELECT session_id, turn_index AS turn, workspace_root, tool_results, unnest(tool_uses) AS u, unnest(range(len(tool_uses)))::INT AS pos FROM t),
u1 AS (SELECT *, regexp_replace(lower(regexp_replace(trim(u.name), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+', '_', 'g') AS tool,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(coalesce(u.input['path'], u.input['file_path'], u.input['search_path'])), '\\\\', '/', 'g'), '^file://', ''), '/+', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g'), '[^/]+/\\.\\./', '', 'g') AS p0,
  coalesce(u.input['query'], u.input['pattern']) AS query,
  nullif(regexp_extract(regexp_replace(regexp_replace(regexp_replace(trim(coalesce(u.input['command'], u.input['cmd'])), '^(?:env\\s+|sudo\\s+|[A-Za-z_][A-Za-z0-9_]*=\\S*\\s+)+', ''), '^uv\\s+run\\s+', ''), '^python3?\\s+-m\\s+', ''), '^(?:\\S*/)?([^\\s/]+)', 1), '') AS program,
  coalesce(u.input['command'], u.input['cmd']) AS command, u.input AS args, list_filter(tool_results, lambda r: r.tool_use_id = u.id)[1].content AS raw FROM u0),
e AS (SELECT session_id, turn, pos, workspace_root, u.id AS tool_use_id, tool, CASE WHEN tool IS NULL THEN NULL {_FAMILY} ELSE 'other' END AS family,
  CASE WHEN starts_with(p0, workspace_root || '/') THEN substr(p0, length(workspace_root) + 2) ELSE p0 END AS path, query, program, raw, command, args,
  try_cast(u.input['offset'] AS INT) AS a, try_cast(u.input['limit'] AS INT) AS n_lines FROM u1),
x AS (SELECT *, CASE WHEN family IN ('file_read', 'edit') THEN 'file|' || coalesce(path, '') WHEN family = 'search' THEN 'search|' || coalesce(query, '') || '|' || coalesce(path, '')
  WHEN family = 'command' THEN 'command|' || coalesce(program, '') ELSE 'other|' || coalesce(path, '') END AS target, left(sha256(raw), 16) AS h, floor(coalesce(length(raw), 0) / 4)::BIGINT AS n_tokens FROM e)
"""
_OPPORTUNITIES = f"""
o0 AS (SELECT *, family || '|' || target AS identity, left(sha256({_CANONICAL}), 16) AS c FROM x WHERE raw IS NOT NULL AND family IS NOT NULL),
o1 AS (SELECT *, lag(h) OVER (PARTITION BY session_id, identity ORDER BY turn, pos) AS lh, lag(c) OVER (PARTITION BY session_id, identity ORDER BY turn, pos) AS lc,
  lag(tool) OVER (PARTITION BY session_id, h ORDER BY turn, pos) AS sr, lag(tool) OVER (PARTITION BY session_id, c ORDER BY turn, pos) AS sc FROM o0),
o AS (SELECT session_id, turn, pos, tool, family, target, CASE WHEN lh = h THEN 'same_identity' WHEN lc = c THEN 'canonical' WHEN sr = tool THEN 'alias' WHEN sr IS NOT NULL THEN 'cross_tool'
  WHEN sc IS NOT NULL THEN 'cross_canonical' WHEN lh IS NOT NULL THEN 'changed' ELSE 'first_seen' END AS repeat_class, n_tokens FROM o1)
"""
_SPLIT = "string_split(regexp_replace(regexp_replace(raw, '\\r\\n?', chr(10), 'g'), '\\n$', ''), chr(10))"


def _sql(body: str, *more: str) -> str:
    return f"WITH {', '.join([_BASE, *more])} {body}"


_TOP = """
w AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn, pos) AS weight FROM x WHERE family IS NOT NULL),
l AS (SELECT session_id, 'file' AS field, path AS value, weight FROM w UNION ALL SELECT session_id, 'command', program, weight FROM w UNION ALL SELECT session_id, 'query', query, weight FROM w),
s AS (SELECT session_id, field, value, sum(weight)::BIGINT AS score FROM l WHERE value IS NOT NULL GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY session_id, field ORDER BY score DESC, value)::INT AS rank FROM s QUALIFY rank <= 3)
"""
_SHARE = lambda p: f"len(list_filter(f, lambda v: regexp_matches(v, '{p}'))) / greatest(len(f), 1)"

ORACLES = {
    "tool_events": _sql("SELECT session_id, turn, pos, tool_use_id, tool, family, path, query, program, length(raw)::INT AS n_chars FROM e"),
    "repeat_windows": _sql(
        """SELECT session_id, turn, pos, family, target, n_hot, n_stuck, same, n_same, (n_hot >= 2 AND (family <> 'file_read' OR n_same >= 1)) AS hot, n_stuck >= 3 AS stuck FROM (
        SELECT *, sum(same::INT) OVER (PARTITION BY session_id, target ORDER BY turn, pos)::BIGINT AS n_same FROM (
        SELECT *, count(*) OVER (PARTITION BY session_id, target ORDER BY turn RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n_hot, count(*) OVER (PARTITION BY session_id, target ORDER BY turn RANGE BETWEEN 7 PRECEDING AND CURRENT ROW) AS n_stuck,
        coalesce(h = lag(h) OVER (PARTITION BY session_id, target ORDER BY turn, pos), false) AS same FROM x WHERE family IS NOT NULL))"""
    ),
    "novelty_missing": _sql(
        """SELECT session_id, count(*) AS n_events, count(DISTINCT target) AS n_targets, sum(seen::INT)::BIGINT AS n_seen_before FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id, target || '|' || coalesce(h, '') ORDER BY turn, pos) > 1 AS seen FROM x WHERE family IS NOT NULL) GROUP BY session_id"""
    ),
    "loop_events": _sql(
        """SELECT session_id, turn, pos, tool, target FROM (SELECT *, tool || '|' || target AS k FROM x WHERE family IS NOT NULL)
        QUALIFY k = lag(k) OVER (PARTITION BY session_id ORDER BY turn, pos) AND k = lag(k, 2) OVER (PARTITION BY session_id ORDER BY turn, pos)"""
    ),
    "recently_edited_reads": _sql(
        """SELECT session_id, turn, pos, path, edited FROM (SELECT *, last_value(CASE WHEN family = 'edit' THEN turn END IGNORE NULLS) OVER (PARTITION BY session_id, path ORDER BY turn, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edited
        FROM x WHERE family IN ('file_read', 'edit') AND path IS NOT NULL) WHERE family = 'file_read' AND turn - edited <= 2"""
    ),
    "directory_heat": _sql(
        """SELECT session_id, parent, count(DISTINCT path) AS n_files, max(n) AS n_busiest, count(*) AS n_reads FROM (SELECT *, count(*) OVER (PARTITION BY session_id, parent ORDER BY turn RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n FROM (
        SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent FROM x WHERE family = 'file_read' AND contains(path, '/'))) GROUP BY ALL HAVING count(DISTINCT path) >= 3"""
    ),
    "dedup_opportunities": _sql("SELECT * FROM o", _OPPORTUNITIES),
    "dedup_source_summary": _sql(
        "SELECT family, repeat_class, count(*) AS n_results, sum(n_tokens)::BIGINT AS n_tokens, sum(CASE WHEN repeat_class IN ('first_seen', 'changed') THEN 0 ELSE n_tokens END)::BIGINT AS headroom FROM o GROUP BY ALL", _OPPORTUNITIES
    ),
    "hot_targets": _sql("SELECT target, sum(n_tokens)::BIGINT AS headroom, count(*) AS n_repeats FROM o WHERE repeat_class NOT IN ('first_seen', 'changed') GROUP BY target ORDER BY headroom DESC, n_repeats DESC, target LIMIT 10", _OPPORTUNITIES),
    "overlap_new_lines": _sql(
        f"""SELECT session_id, turn, pos, count(*) AS n_lines, sum(fresh::INT)::BIGINT AS n_new, sum(CASE WHEN fresh THEN length(line) + 1 ELSE 0 END)::BIGINT AS new_chars, any_value(length(raw))::INT AS n_chars,
        sum(CASE WHEN fresh THEN length(line) + 1 ELSE 0 END) < any_value(length(raw)) AS shorter FROM (SELECT *, row_number() OVER (PARTITION BY session_id, target, line ORDER BY turn, pos, line_no) = 1 AS fresh FROM (
        SELECT session_id, turn, pos, target, raw, unnest({_SPLIT}) AS line, unnest(range(len({_SPLIT}))) AS line_no FROM x WHERE family = 'search' AND raw IS NOT NULL)) GROUP BY session_id, turn, pos"""
    ),
    "range_overlap": _sql(
        """SELECT session_id, turn, pos, path, b - a AS n_lines, count(c.v)::INT AS n_covered FROM (SELECT r.session_id, r.turn, r.pos, r.path, r.a, r.b, v.v FROM r, unnest(range(r.a, r.b)) AS v(v)
        WHERE EXISTS (SELECT 1 FROM r q WHERE q.session_id = r.session_id AND q.path = r.path AND (q.turn, q.pos) < (r.turn, r.pos) AND v.v >= q.a AND v.v < q.b)) c RIGHT JOIN r USING (session_id, turn, pos, path, a, b) GROUP BY ALL""",
        "r AS (SELECT session_id, turn, pos, path, a, a + n_lines AS b FROM x WHERE family = 'file_read' AND path IS NOT NULL AND a IS NOT NULL AND n_lines > 0)",
    ),
    "result_cache_outcomes": _sql(
        """SELECT family, outcome, count(*) AS n_results, sum(n_tokens)::BIGINT AS n_tokens FROM (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 'stored' WHEN first_value(h) OVER w = h THEN 'unchanged' ELSE 'changed' END AS outcome
        FROM x WHERE raw IS NOT NULL AND family IN ('file_read', 'search') WINDOW w AS (PARTITION BY session_id, target ORDER BY turn, pos)) GROUP BY ALL"""
    ),
    "signal_totals": _sql(
        """SELECT session_id, signal, sum(value)::BIGINT AS total, count(*) AS n_turns, max(value) AS most FROM (SELECT session_id, unnest(map_keys(input_behavior_signals)) AS signal, unnest(map_values(input_behavior_signals)) AS value FROM t) GROUP BY ALL"""
    ),
    "tool_result_retention": _sql(
        """SELECT session_id, count(*) AS n_results, sum(coalesce(length(r.content), 0))::BIGINT AS n_chars, sum(floor(coalesce(length(r.content), 0) / 4))::BIGINT AS n_tokens, count(*) FILTER (floor(coalesce(length(r.content), 0) / 4) >= 200) AS n_heavy
        FROM (SELECT session_id, unnest(tool_results) AS r FROM t) GROUP BY session_id"""
    ),
    "pairing_risks": _sql(
        """SELECT * FROM (SELECT session_id, turn_index AS turn, len(a)::INT AS n_calls, len(list_intersect(a, b))::INT AS n_answered, len(list_filter(list_distinct(a), lambda i: NOT list_contains(b, i)))::INT AS n_missing, len(list_filter(list_distinct(b), lambda i: NOT list_contains(a, i)))::INT AS n_unknown
        FROM (SELECT session_id, turn_index, list_transform(tool_uses, lambda v: v.id) AS a, list_transform(tool_results, lambda v: v.tool_use_id) AS b FROM t)) WHERE n_missing > 0 OR n_unknown > 0"""
    ),
    "ngram_patterns": _sql(
        """SELECT gram, n, n_sessions, size FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.size = c.size + 1 AND d.n >= c.n AND (starts_with(d.gram, c.gram || ' > ') OR ends_with(d.gram, ' > ' || c.gram)))""",
        """g AS (SELECT session_id, tool, lead(tool) OVER w AS b, lead(tool, 2) OVER w AS c FROM x WHERE tool IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY turn, pos)),
        c AS (SELECT gram, count(*) AS n, count(DISTINCT session_id) AS n_sessions, size FROM (SELECT session_id, tool || ' > ' || b AS gram, 2 AS size FROM g WHERE b IS NOT NULL UNION ALL SELECT session_id, tool || ' > ' || b || ' > ' || c, 3 FROM g WHERE c IS NOT NULL) GROUP BY gram, size HAVING count(*) >= 3)""",
    ),
    "sequence_order": "SELECT session_id, turn, ingest_id, highest FROM (SELECT session_id, turn_index AS turn, ingest_id, max(turn_index) OVER (PARTITION BY session_id ORDER BY ingest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM stress_turns) WHERE turn < highest",
    "history_topk": _sql("SELECT * FROM top", _TOP),
    "history_state_line": _sql("SELECT session_id, string_agg(field || ':' || v, '|' ORDER BY field || ':' || v) AS line FROM (SELECT session_id, field, string_agg(value, ',' ORDER BY rank) AS v FROM top GROUP BY ALL) GROUP BY session_id", _TOP),
    "content_kinds": _sql(
        f"""SELECT kind, count(*) AS n, sum(n_tokens)::BIGINT AS n_tokens, count(*) FILTER (regexp_matches(lower(raw), '{'|'.join(T.ERROR_MARKS)}')) AS n_errors FROM (SELECT *, CASE WHEN raw IS NULL OR trim(raw) = '' THEN 'empty'
        WHEN regexp_matches(raw, '(?m)^Traceback \\(most recent call last\\)') THEN 'traceback' WHEN regexp_matches(raw, '(?m)^diff --git |^@@ -[0-9]+') THEN 'diff'
        WHEN regexp_matches(raw, '(?m)^(=+ .*(passed|failed).*=+|FAILED \\S+|\\S+\\.py::\\S+)') THEN 'test_report' WHEN regexp_matches(raw, '^\\s*[\\[{{]') AND json_valid(raw) THEN 'json'
        WHEN {_SHARE('^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.]+Z? +[A-Z]+ ')} >= 0.5 THEN 'log' WHEN {_SHARE('^[^\\s:]+\\.[A-Za-z0-9]+:[0-9]+:')} >= 0.7 THEN 'search' WHEN {_SHARE('^[-dl][rwx-]{9} ')} >= 0.5 THEN 'listing'
        WHEN {_SHARE('^\\s*(def |class |import |from .* import |return |raise |assert |for |if |with |#)')} >= 0.3 THEN 'code' ELSE 'text' END AS kind
        FROM (SELECT raw, n_tokens, list_filter({_SPLIT}, lambda v: trim(v) <> '') AS f FROM x)) GROUP BY kind"""
    ),
    "canonical_groups": _sql(f"SELECT left(sha256({_CANONICAL}), 16) AS digest, count(*) AS n, count(DISTINCT raw) AS n_forms FROM x WHERE raw IS NOT NULL GROUP BY 1 HAVING count(*) > 1"),
}
