"""Queries over requests, prompts and behaviour, and their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import events as E
from ..operators import recall, unnest
from ..operators import requests as R
from ..sources import table
from ..streaming import windows
from .evidence import ORACLES as _EVIDENCE
from .identities import q
from .message_sql import BLOCKS
from .sessions import _BASE, _SPLIT
from .texts import _LINES


def _events(f):  # type: ignore[no-untyped-def]
    return lambda spark, d: f(E.tool_events(table(spark, d, "stress_turns")))


def _blocks(f):  # type: ignore[no-untyped-def]
    return lambda spark, d: f(unnest.payload_blocks(table(spark, d, "replay_records"), messages=True))


def path_graph(spark: SparkSession, d: str) -> DataFrame:
    """The tree of the directories that calls name: depth and number of ways into each."""
    p = E.tool_events(table(spark, d, "stress_turns")).filter("path is not null and instr(path, '/') > 1").select("path").distinct()
    parts = F.split("path", "/")
    pairs = p.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("a"), F.array_join(F.slice(parts, F.lit(1), i + 1), "/").alias("b")))).alias("e")).select("e.*")
    return R.graph_metrics(pairs)


def wire_lines(spark: SparkSession, d: str) -> DataFrame:
    """State lines in their shorter wire form."""
    s = recall.deltas(recall.states(recall.values(E.tool_events(table(spark, d, "stress_turns"))))).filter("how <> 'suppress'")
    line = T.wire_shortened(F.concat(F.lit(">>> t:1|"), F.regexp_replace("line", r"[|\n]+(?![a-z_]+:)", " ")))
    return s.select("session_id", "turn", F.length(line).alias("n_chars"), T.has_markup(line).alias("markup"))


def stream_telemetry(spark: SparkSession, d: str) -> DataFrame:
    """The events written as lines by a stream and read again, counted by type and user."""
    lines = windows.drained(R.telemetry(windows.events(spark, d)))
    e = lines.select(F.from_json("line", "event_type string, timestamp string, request_id bigint, payload struct<user_id: bigint, value: double>").alias("e")).select("e.*")
    return e.groupBy("event_type", F.col("payload.user_id").alias("user_id")).agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("request_id").alias("last_id"))


QUERIES = {
    "prompt_checks": lambda spark, d: R.prompt_checks(table(spark, d, "documents")),
    "turn_intents": _blocks(R.turn_intents),
    "session_flags": _events(R.session_flags),
    "stream_telemetry": stream_telemetry,
    "request_fingerprints": _blocks(R.fingerprints),
    "fingerprint_diff": _blocks(R.fingerprint_diff),
    "prompt_outline": lambda spark, d: R.prompt_outline(table(spark, d, "documents")),
    "behaviour_signals": _events(R.behaviour),
    "latest_outcomes": _events(R.latest_outcomes),
    "signal_changes": lambda spark, d: R.signal_changes(table(spark, d, "stress_turns")),
    "fixture_coverage": lambda spark, d: R.coverage(table(spark, d, "replay_records"), table(spark, d, "replay_meta")),
    "path_graph": path_graph,
    "tool_registry": lambda spark, d: R.registry(E.tool_events(table(spark, d, "stress_turns")), table(spark, d, "tool_families")),
    "instruction_values": lambda spark, d: R.instruction_values(table(spark, d, "stress_turns")),
    "content_summaries": _events(R.summaries),
    "wire_lines": wire_lines,
}

_ERR = "|".join(T.ERROR_MARKS)


def _sql(body: str, *more: str) -> str:
    return f"WITH {', '.join([_BASE, *more])} {body}"


_FP = "SELECT m1.rec_key, count(DISTINCT m1.msg_pos) AS n_messages, count(b.block_pos) AS n_blocks, count(*) FILTER (b.type = 'tool_use') AS n_uses, count(*) FILTER (b.type = 'tool_result') AS n_results, coalesce(sum(length(b.body)), 0)::BIGINT AS n_chars, left(sha256(string_agg(t, ' ' ORDER BY m1.msg_pos, bp)), 16) AS topology"
_JOINED = "{}(SELECT m1.*, r.block_pos AS bp, r.t FROM m1 JOIN (SELECT rec_key, msg_pos, block_pos, coalesce(role, '-') || '/' || coalesce(type, '-') AS t FROM {} UNION ALL SELECT rec_key, msg_pos, -1, coalesce(role, '-') || '/-' FROM m1) r USING (rec_key, msg_pos)) m1 LEFT JOIN {} b ON b.rec_key = m1.rec_key AND b.msg_pos = m1.msg_pos AND b.block_pos = m1.bp GROUP BY m1.rec_key"
_Q = "qd AS (" + _EVIDENCE["quarantined_blocks"].split(f"WITH {BLOCKS}", 1)[1].strip() + ")"
_KEPT = "kp AS (SELECT * FROM b0 WHERE NOT EXISTS (SELECT 1 FROM qd WHERE qd.rec_key = b0.rec_key AND qd.msg_pos = b0.msg_pos AND qd.block_pos = b0.block_pos))"
_FULL = f"list_filter(list_transform({_LINES}, lambda v: trim(v, ' ')), lambda v: v <> '' AND NOT starts_with(v, '>>>'))"
_WITHIN = "(SELECT coalesce(string_agg(v, ' | ' ORDER BY i), '') FROM (SELECT *, sum(length(v) + CASE WHEN n > 1 THEN 3 ELSE 0 END) OVER (ORDER BY i) AS upto FROM (SELECT *, row_number() OVER (ORDER BY i) AS n FROM (SELECT trim(t, ' ') AS v, i FROM (SELECT unnest(f3) AS t, unnest(range(len(f3))) AS i)) WHERE v <> '')) WHERE upto <= 120)"
_NAMES = "list_filter(nm, lambda v: v <> '')"
_INTENTS = ", ".join(f"regexp_matches(t, {q(p)}) AS {k}" for k, p in R.INTENTS.items())
ORACLES = {
    "request_fingerprints": f"WITH {BLOCKS} {_FP} FROM {_JOINED.format('', 'bl', 'bl')}",
    "fingerprint_diff": f"""WITH {BLOCKS}, {_Q}, {_KEPT}, fa AS ({_FP} FROM {_JOINED.format('', 'bl', 'bl')}), fb AS ({_FP} FROM {_JOINED.format('', 'kp', 'kp')})
        SELECT * FROM (SELECT rec_key, concat_ws(',', CASE WHEN fa.n_messages IS DISTINCT FROM fb.n_messages THEN 'n_messages' END, CASE WHEN fa.n_blocks IS DISTINCT FROM fb.n_blocks THEN 'n_blocks' END, CASE WHEN fa.n_uses IS DISTINCT FROM fb.n_uses THEN 'n_uses' END, CASE WHEN fa.n_results IS DISTINCT FROM fb.n_results THEN 'n_results' END, CASE WHEN fa.topology IS DISTINCT FROM fb.topology THEN 'topology' END) AS changed,
        fa.n_blocks - coalesce(fb.n_blocks, 0) AS n_dropped, fa.n_chars - coalesce(fb.n_chars, 0) AS n_chars_dropped FROM fa LEFT JOIN fb USING (rec_key)) WHERE changed <> ''""",
    "prompt_outline": f"""SELECT doc_id, CASE WHEN o = '' THEN 'goal:' || coalesce(left(list_filter(f, lambda v: length(v) > 10)[1], 100), '') ELSE o END AS outline FROM (SELECT *, concat_ws('|', CASE WHEN len(g) > 0 THEN 'goal:' || array_to_string(list_transform(list_slice(g, 1, 2), lambda v: left(v, 60)), ',') END, CASE WHEN len(fs) > 0 THEN 'files:' || (SELECT string_agg(v, ',' ORDER BY i) FROM (SELECT v, i FROM (SELECT v, min(i) AS i FROM (SELECT unnest(fs) AS v, unnest(range(len(fs))) AS i) GROUP BY v) ORDER BY i LIMIT 3)) END,
        CASE WHEN len(l) > 0 THEN 'constraints:' || array_to_string(list_transform(list_slice(l, 1, 2), lambda v: left(v, 60)), ',') END) AS o FROM (SELECT doc_id, f, list_filter(f, lambda v: regexp_matches(lower(v), {q(R.GOALS)}) OR (regexp_matches(v, '^([-*] |1\\. )') AND regexp_matches(lower(v), {q(R.TASKS)}))) AS g, list_filter(f, lambda v: regexp_matches(lower(v), {q(R.LIMITS)})) AS l,
        regexp_extract_all(array_to_string(f, chr(10)), {q('([A-Za-z0-9_./-]+' + chr(92) + '.(?:' + T.NAMED + '))' + chr(92) + 'b')}, 1) AS fs FROM (SELECT doc_id, {_FULL} AS f FROM documents WHERE text IS NOT NULL)))""",
    "behaviour_signals": _sql(
        """SELECT session_id, s.n AS signal, sum(s.v)::BIGINT AS total, count(*) AS n FROM (SELECT session_id, unnest(list_filter([CASE WHEN family = 'file_read' AND again THEN {'n': 'repeat_file_read', 'v': 1::BIGINT} END, CASE WHEN family = 'search' AND again THEN {'n': 'repeat_search', 'v': 1::BIGINT} END, CASE WHEN family = 'command' AND again AND same THEN {'n': 'repeat_command', 'v': 1::BIGINT} END,
        CASE WHEN family IN ('file_read', 'search') AND again AND n_tokens > 0 THEN {'n': 'reacquisition_cost_tokens', 'v': n_tokens} END, CASE WHEN bl IS NOT NULL AND nb = 2 THEN {'n': 'blocker_rediscovery', 'v': 1::BIGINT} END, CASE WHEN coalesce(regexp_matches(command, 'python3? -c|2>&1'), false) THEN {'n': 'workaround', 'v': 1::BIGINT} END, CASE WHEN bl IS NOT NULL THEN {'n': 'error_seen', 'v': 1::BIGINT} END], lambda v: v IS NOT NULL)) AS s
        FROM (SELECT *, row_number() OVER w > 1 AS again, coalesce(h = lag(h) OVER w, false) AS same, row_number() OVER (PARTITION BY session_id, bl ORDER BY turn, pos) AS nb FROM (SELECT *, list_filter({split}, lambda v: regexp_matches(lower(v), '{err}'))[1] AS bl FROM x WHERE family IS NOT NULL) WINDOW w AS (PARTITION BY session_id, target ORDER BY turn, pos))) GROUP BY ALL""".replace("{split}", _SPLIT).replace("{err}", _ERR)
    ),
    "latest_outcomes": _sql(f"SELECT session_id, target, CASE WHEN f THEN 'fail' ELSE 'pass' END AS outcome, n, CASE WHEN f THEN 0 ELSE nf END AS n_stale FROM (SELECT session_id, target, arg_max(failed, (turn, pos)) AS f, count(*) FILTER (failed) AS nf, count(*) AS n FROM (SELECT *, regexp_matches(lower(raw), '{_ERR}') AS failed FROM x WHERE raw IS NOT NULL AND family IS NOT NULL) GROUP BY ALL)"),
    "signal_changes": _sql(
        """SELECT session_id, turn, changes FROM (SELECT session_id, turn, array_to_string(list_transform(list_filter(list_sort(list_distinct(list_concat(map_keys(m), map_keys(o)))), lambda k: m[k] IS DISTINCT FROM o[k]), lambda k: k || ':' || coalesce(o[k]::VARCHAR, '-') || '>' || coalesce(m[k]::VARCHAR, '-')), ',') AS changes
        FROM (SELECT session_id, turn, m, coalesce(lag(m) OVER (PARTITION BY session_id ORDER BY turn), MAP {}) AS o FROM (SELECT session_id, turn_index AS turn, coalesce(input_behavior_signals, MAP {}) AS m FROM t))) WHERE changes <> ''"""
    ),
    "fixture_coverage": "SELECT fixture, coalesce(n, 0) AS n_records, CASE WHEN k IS NULL THEN 'no_thresholds' WHEN n IS NULL THEN 'no_records' WHEN r THEN 'required' ELSE 'exploratory' END AS status FROM (SELECT fixture, count(DISTINCT record_id) AS n FROM replay_records GROUP BY 1) FULL JOIN (SELECT fixture, true AS k, min_savings_pct IS NOT NULL AS r FROM replay_meta) USING (fixture)",
    "path_graph": _sql(
        """SELECT node, max(i) AS n_in, max(dp) AS depth FROM (SELECT array_to_string(list_slice(p, 1, k), '/') AS node, CASE WHEN k > 1 THEN 1 ELSE 0 END AS i, (k - 1)::INT AS dp FROM (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT DISTINCT string_split(path, '/') AS p FROM x WHERE strpos(path, '/') > 1))) GROUP BY node"""
    ),
    "tool_registry": _sql(
        f"""SELECT p.*, f.tool IS NOT NULL AS registered FROM (SELECT tool, count(*) AS n, count(*) FILTER (regexp_matches(lower(raw), '{_ERR}')) AS n_failed, count(*) FILTER (raw IS NULL) AS n_missing, min(turn) AS first_turn, max(turn) AS last_turn, count(DISTINCT session_id) AS n_sessions FROM x WHERE tool IS NOT NULL GROUP BY 1) p
        LEFT JOIN (SELECT DISTINCT regexp_replace(lower(regexp_replace(trim(tool_name), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+', '_', 'g') AS tool FROM tool_families) f ON f.tool = p.tool"""
    ),
    "instruction_values": _sql(
        f"""SELECT session_id, turn, array_to_string(list_reverse({_NAMES}), ',') AS reversed, array_to_string(list_sort(list_distinct({_NAMES})), ',') AS sorted, nm[2] AS second, len({_NAMES})::INT AS n, a + b AS add, a - b AS sub, a * b AS mul, CASE WHEN b <> 0 THEN floor(a / b)::BIGINT END AS div
        FROM (SELECT session_id, turn_index AS turn, list_transform(tool_uses, lambda u: coalesce(u.name, '')) AS nm, coalesce(request_messages, 0)::BIGINT AS a, len(tool_uses)::BIGINT AS b FROM t)"""
    ),
    "content_summaries": _sql(
        f"""SELECT session_id, turn, pos, family, CASE family WHEN 'file_read' THEN {_WITHIN} WHEN 'search' THEN len(hits) || ' hits in ' || len(list_distinct(list_transform(hits, lambda v: string_split(v, ':')[1]))) || ' files' ELSE left(trim(coalesce(list_filter(f, lambda v: regexp_matches(lower(v), '{_ERR}'))[1], f[-1], ''), ' '), 120) END AS summary
        FROM (SELECT *, CASE WHEN len(df) > 0 THEN df ELSE list_slice(f, 1, 3) END AS f3 FROM (SELECT *, list_filter(f, lambda v: regexp_matches(v, '^\\s*(class|def|async def) ')) AS df, list_filter(f, lambda v: regexp_matches(v, '^[^\\s:]+:[0-9]+:')) AS hits FROM (SELECT *, list_filter({_SPLIT}, lambda v: trim(v, ' ') <> '') AS f FROM x WHERE raw IS NOT NULL AND family IS NOT NULL)))"""
    ),
}

_OUTLINE = ORACLES["prompt_outline"]
ORACLES |= {
    "prompt_checks": f"""SELECT doc_id, length(text) > 2000 AS bloated, CASE WHEN length(text) >= 2000 AND length(outline) < greatest(500, floor(length(text) * 0.25)) THEN 'overcompressed' WHEN len(lost) > 0 THEN 'missing_required_path' ELSE '' END AS degraded, len(lost)::INT AS n_lost_paths FROM (SELECT *, (SELECT coalesce(list(v), []) FROM (SELECT v FROM (SELECT v, min(i) AS i FROM (SELECT unnest(fs) AS v, unnest(range(len(fs))) AS i) GROUP BY v) ORDER BY i LIMIT 6) WHERE NOT contains(outline, v)) AS lost
        FROM (SELECT doc_id, text, outline, regexp_extract_all(text, {q('([A-Za-z0-9_./-]+' + chr(92) + '.(?:' + T.NAMED + '))' + chr(92) + 'b')}, 1) AS fs FROM documents JOIN ({_OUTLINE}) USING (doc_id) WHERE text IS NOT NULL))""",
    "turn_intents": f"WITH {BLOCKS} SELECT rec_key, {_INTENTS} FROM (SELECT rec_key, arg_max(lower(body), (msg_pos, block_pos)) AS t FROM bl WHERE role = 'user' AND type = 'text' AND body IS NOT NULL GROUP BY 1)",
    "session_flags": _sql(
        """SELECT session_id, n_turns, CASE WHEN n_turns < 3 THEN 3 ELSE 2 END AS keep_turns, coalesce(nf, 0) >= 2 AS broad_start, coalesce(nr, 0) AS n_required, coalesce(nl, 0) AS n_lost, coalesce(nl, 0) = 0 AS faithful FROM (SELECT session_id, min(turn) AS a, max(turn) AS z, count(DISTINCT turn) AS n_turns FROM x WHERE family IS NOT NULL GROUP BY 1) e
        LEFT JOIN (SELECT session_id, count(DISTINCT path) AS nf FROM (SELECT *, min(turn) FILTER (family IS NOT NULL) OVER (PARTITION BY session_id) AS t0 FROM x) WHERE family = 'file_read' AND turn = t0 GROUP BY 1) f USING (session_id)
        LEFT JOIN (SELECT session_id, count(*) AS nr, count(*) FILTER (seen <= z - 6) AS nl FROM (SELECT session_id, target, count(*) AS n, max(turn) AS seen FROM x WHERE family = 'file_read' GROUP BY ALL HAVING count(*) > 1) JOIN (SELECT session_id, max(turn) FILTER (family IS NOT NULL) AS z FROM x GROUP BY 1) USING (session_id) GROUP BY 1) g USING (session_id)"""
    ),
    "stream_telemetry": "SELECT event_type, user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') AS first, max(event_id) AS last_id FROM events GROUP BY ALL",
}
