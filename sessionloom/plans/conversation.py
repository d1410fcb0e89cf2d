"""Queries over whole conversations, and their SQL forms."""

from __future__ import annotations

from ..functions import text as T
from ..operators import conversation as C
from ..operators import unnest
from ..sources import table
from .identities import q
from .message_sql import BLOCKS


def _blocks(f):  # type: ignore[no-untyped-def]
    return lambda spark, d: f(unnest.payload_blocks(table(spark, d, "replay_records"), messages=True))


QUERIES = {
    "message_texts": _blocks(C.texts),
    "assistant_texts": _blocks(C.assistant_texts),
    "prose_drift": _blocks(C.drift),
    "cut_reasons": _blocks(C.cut_reasons),
    "shape_risks": _blocks(C.shape_risks),
    "strict_codes": _blocks(C.validated),
    "safe_suffix": _blocks(C.safe_suffix),
    "recovery_floor": _blocks(C.recovery_floor),
    "pruned_results": _blocks(C.pruned),
    "protected_thinking": _blocks(C.protected),
    "split_messages": _blocks(C.split_mixed),
    "provider_messages": _blocks(C.provider_messages),
    "labelled_fields": _blocks(C.labelled),
    "error_snippets": _blocks(C.error_snippets),
    "marker_counts": lambda spark, d: C.marker_counts(table(spark, d, "replay_records"), "signature"),
}


def lines(c: str) -> str:
    return f"string_split(regexp_replace(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), '\\n$', ''), chr(10))"


_ERR = "|".join(T.ERROR_MARKS)
_N = ", ".join(f"len(list_filter({lines('text')}, lambda v: regexp_matches(v, {q(p)})))::INT AS n_{k}" for k, p in C.LINES.items())
_TX = "tx AS (SELECT rec_key, msg_pos, any_value(role) AS role, string_agg(body, ' ' ORDER BY block_pos, sub_pos) AS text FROM bs WHERE body IS NOT NULL AND (type IN ('text', 'tool_result') OR sub_pos >= 0) GROUP BY ALL)"
_ME = """
me AS (SELECT m1.rec_key, m1.msg_pos, m1.role, count(b.block_pos) AS n_blocks, count(*) FILTER (b.type = 'tool_use') AS n_uses, count(*) FILTER (b.type = 'tool_result') AS n_results FROM m1 LEFT JOIN bl b USING (rec_key, msg_pos) GROUP BY ALL),
ut AS (SELECT *, coalesce(role = 'user' AND (n_results < n_blocks OR n_blocks = 0), false) AS authored FROM me)
"""
_SHAPES = """
sp AS (SELECT m1.rec_key, m1.msg_pos, m1.role, count(*) FILTER (b.type = 'tool_use') AS n_uses, count(*) FILTER (b.type = 'tool_result' AND call_msg_pos = msg_pos - 1) AS n_answers, count(DISTINCT CASE WHEN b.type = 'tool_result' AND call_msg_pos = msg_pos - 1 AND call_msg_pos >= 0 THEN call_block_pos END) AS n_answered,
  count(*) FILTER (b.type = 'tool_result' AND call_msg_pos < 0) AS n_unknown, count(*) FILTER (b.type = 'tool_result' AND call_msg_pos >= 0 AND call_msg_pos < msg_pos - 1) AS n_late, min(block_pos) FILTER (b.type = 'text') AS x0, max(block_pos) FILTER (b.type = 'text') AS x1, max(block_pos) FILTER (b.type = 'tool_result') AS r1,
  min(block_pos) FILTER (b.type = 'tool_use') AS u0, max(block_pos) FILTER (b.type = 'tool_use') AS u1, min(block_pos) FILTER (b.type = 'thinking') AS t0, max(block_pos) FILTER (b.type = 'thinking') AS t1 FROM m1 LEFT JOIN b0 b USING (rec_key, msg_pos) GROUP BY ALL),
s2 AS (SELECT *, role = 'assistant' AND n_uses > 0 AS calls, role IN ('user', 'tool_result') AS usr, coalesce(lead(n_answers) OVER w, 0) AS na, coalesce(lead(n_answered) OVER w, 0) AS nd FROM sp WINDOW w AS (PARTITION BY rec_key ORDER BY msg_pos)),
rk AS (SELECT rec_key, count(*) FILTER (calls AND na = 0) AS missing_next_result, count(*) FILTER (calls AND na > 0 AND nd < n_uses) AS incomplete_next_result, count(*) FILTER (usr AND n_unknown > 0) AS unknown_result, count(*) FILTER (usr AND n_late > 0) AS late_result, count(*) FILTER (usr AND x0 < r1) AS text_before_result,
  count(*) FILTER (calls AND n_uses > 1 AND t1 > u0 AND t0 < u1) AS thinking_between_uses, count(*) FILTER (calls AND n_uses >= 3) AS large_batch, count(*) FILTER (calls AND x1 > u0) AS text_after_use FROM s2 GROUP BY rec_key)
"""


def _sql(body: str, *parts: str) -> str:
    return f"WITH {', '.join([BLOCKS, *parts])} {body}"


_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda v: v <> ''))::INT"
ORACLES = {
    "message_texts": _sql(f"SELECT rec_key, msg_pos, role, length(text)::INT AS n_chars, left(sha256(text), 16) AS digest, len(list_distinct(regexp_extract_all(text, {q('([A-Za-z0-9_./-]+' + chr(92) + '.(?:' + T.NAMED + '))' + chr(92) + 'b')}, 1)))::INT AS n_files, {_N} FROM tx", _TX),
    "assistant_texts": _sql("SELECT rec_key, msg_pos, length(t)::INT AS n_chars, left(sha256(t), 16) AS digest FROM (SELECT rec_key, msg_pos, string_agg(trim(body, ' '), chr(10) ORDER BY block_pos) AS t FROM bs WHERE role = 'assistant' AND type = 'text' AND sub_pos = -1 AND trim(body, ' ') <> '' GROUP BY ALL)"),
    "prose_drift": _sql(
        f"""SELECT * FROM (SELECT rec_key, msg_pos, {_WORDS} AS n_words, len(list_filter({lines('text')}, lambda v: regexp_matches(v, '^\\s*[-*+] ')))::INT AS n_bullets, concat_ws(',', CASE WHEN regexp_matches(text, {q(C.FILLER)}) AND {_WORDS} > 10 THEN 'filler' END, CASE WHEN {_WORDS} > 40 THEN 'long' END,
        CASE WHEN len(list_filter({lines('text')}, lambda v: regexp_matches(v, '^\\s*[-*+] '))) >= 2 THEN 'list' END, CASE WHEN regexp_matches(text, '(?m)^#{{1,6}} ') THEN 'headers' END) AS reasons FROM tx WHERE role = 'assistant' AND NOT (length(text) >= 10 AND regexp_matches(text, {q(T.WIRE)}))) WHERE reasons <> ''""", _TX
    ),
    "cut_reasons": _sql("SELECT rec_key, msg_pos, reason = 'eligible' AS eligible, reason FROM (SELECT *, CASE WHEN role = 'tool_result' THEN 'top_level_tool_result' WHEN role IS DISTINCT FROM 'user' THEN 'non_user' WHEN n_results > 0 AND n_results < n_blocks THEN 'user_contains_tool_result_block' ELSE 'eligible' END AS reason FROM me)", _ME),
    "shape_risks": _sql("SELECT * FROM rk WHERE missing_next_result + incomplete_next_result + unknown_result + late_result + text_before_result + thinking_between_uses + large_batch + text_after_use > 0", _SHAPES),
    "strict_codes": _sql(
        """SELECT * FROM (SELECT rec_key, array_to_string(list_sort(list_filter([CASE WHEN fr IS DISTINCT FROM 'user' THEN 'first_message_not_user' END, CASE WHEN odd > 0 THEN 'invalid_role' END, CASE WHEN missing_next_result > 0 THEN 'missing_next_result' END, CASE WHEN incomplete_next_result > 0 THEN 'incomplete_next_result' END,
        CASE WHEN unknown_result > 0 THEN 'unknown_result' END, CASE WHEN late_result > 0 THEN 'late_result' END, CASE WHEN text_before_result > 0 THEN 'text_before_result' END], lambda v: v IS NOT NULL)), ',') AS codes
        FROM (SELECT rec_key, arg_min(role, msg_pos) AS fr, count(*) FILTER (NOT coalesce(role IN ('user', 'assistant', 'tool_result', 'system'), false)) AS odd FROM m1 GROUP BY 1) JOIN rk USING (rec_key)) WHERE codes <> ''""", _SHAPES
    ),
    "safe_suffix": _sql(
        """SELECT rec_key, s[2] AS start, s[1] = 1 AS fallback FROM (SELECT rec_key, min((k, msg_pos)) AS s FROM (SELECT *, CASE WHEN authored AND n_results = 0 THEN 0 WHEN role = 'user' AND n_results > 0 THEN 1 END AS k FROM ut) p WHERE k IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM b0 WHERE b0.rec_key = p.rec_key AND type = 'tool_result' AND call_msg_pos >= 0 AND call_msg_pos < p.msg_pos AND b0.msg_pos >= p.msg_pos) AND EXISTS (SELECT 1 FROM bl WHERE bl.rec_key = p.rec_key AND type = 'tool_use' AND bl.msg_pos >= p.msg_pos)
        AND NOT EXISTS (SELECT 1 FROM bl u WHERE u.rec_key = p.rec_key AND u.type = 'tool_use' AND u.msg_pos >= p.msg_pos AND NOT EXISTS (SELECT 1 FROM b0 r WHERE r.rec_key = u.rec_key AND r.type = 'tool_result' AND r.call_msg_pos = u.msg_pos AND r.call_block_pos = u.block_pos)) GROUP BY rec_key)""", _ME
    ),
    "recovery_floor": _sql(
        """SELECT p.rec_key, prompt, calls, min(b0.msg_pos) AS answer FROM (SELECT rec_key, max(msg_pos) FILTER (authored) AS prompt, max(msg_pos) FILTER (role = 'assistant' AND n_uses > 0) AS calls FROM ut GROUP BY 1) p
        LEFT JOIN b0 ON b0.rec_key = p.rec_key AND b0.type = 'tool_result' AND b0.call_msg_pos = p.calls AND b0.msg_pos > p.calls GROUP BY ALL""", _ME
    ),
    "pruned_results": _sql(f"SELECT b0.rec_key, b0.msg_pos, block_pos, length(body)::INT AS n_chars FROM b0 JOIN (SELECT rec_key, max(msg_pos) AS l FROM ut WHERE authored GROUP BY 1) USING (rec_key) WHERE type = 'tool_result' AND body IS NOT NULL AND msg_pos < l AND NOT regexp_matches(lower(body), '{_ERR}')", _ME),
    "protected_thinking": _sql("SELECT rec_key, msg_pos, left(sha256(t), 16) AS digest, n_blocks FROM (SELECT rec_key, msg_pos, string_agg(coalesce(body, ''), chr(10) ORDER BY block_pos) AS t, count(*) AS n_blocks FROM b0 WHERE type = 'thinking' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY rec_key ORDER BY msg_pos DESC) = 1"),
    "split_messages": _sql(
        """SELECT rec_key, msg_pos, block_pos, part, (row_number() OVER (PARTITION BY rec_key, msg_pos, part ORDER BY block_pos) - 1)::INT AS new_pos FROM (SELECT *, CASE WHEN type = 'tool_result' THEN 0 ELSE 1 END AS part, count(*) FILTER (type = 'tool_result') OVER (PARTITION BY rec_key, msg_pos) AS n, count(*) OVER (PARTITION BY rec_key, msg_pos) AS a FROM bl WHERE role = 'user') WHERE n > 0 AND n < a"""
    ),
    "provider_messages": _sql(
        """SELECT rec_key, (row_number() OVER (PARTITION BY rec_key ORDER BY msg_pos, part < 0, part) - 1)::INT AS seq, role, tool_call_id, n_calls, n_chars FROM (SELECT rec_key, msg_pos, block_pos AS part, 'tool' AS role, tool_use_id AS tool_call_id, 0 AS n_calls, length(body)::INT AS n_chars FROM bl WHERE type = 'tool_result'
        UNION ALL SELECT rec_key, msg_pos, -1, any_value(role), NULL, count(*) FILTER (type = 'tool_use'), sum(CASE WHEN type = 'text' THEN length(body) END)::INT FROM bl WHERE type <> 'tool_result' GROUP BY rec_key, msg_pos)"""
    ),
    "labelled_fields": _sql(
        f"""SELECT rec_key, label, arg_max(value, (msg_pos, block_pos, i)) AS value, count(*) AS n FROM (SELECT rec_key, msg_pos, block_pos, i, lower(regexp_extract(line, '^\\s*[-*]?\\s*([A-Za-z][A-Za-z _-]{{1,30}}):', 1)) AS label, left(trim(regexp_extract(line, ':\\s+(\\S.*)$', 1), ' '), 96) AS value
        FROM (SELECT rec_key, msg_pos, block_pos, unnest({lines('body')}) AS line, unnest(range(len({lines('body')}))) AS i FROM b0 WHERE role = 'assistant' AND type = 'text' AND body IS NOT NULL) WHERE regexp_matches(line, '^\\s*[-*]?\\s*[A-Za-z][A-Za-z _-]{{1,30}}:\\s+\\S')) WHERE NOT regexp_matches(lower(value), '^(n/a|none|tbd|todo|unknown|\\.\\.\\.|<.*>)$') GROUP BY ALL"""
    ),
    "error_snippets": _sql(
        f"""SELECT DISTINCT rec_key, left(trim(line, ' '), 80) AS snippet FROM (SELECT rec_key, unnest({lines('body')}) AS line FROM bs JOIN (SELECT rec_key, max(msg_pos) AS e FROM m1 GROUP BY 1) USING (rec_key) WHERE body IS NOT NULL AND msg_pos > e - 2) WHERE regexp_matches(lower(line), '{_ERR}')"""
    ),
    "marker_counts": "SELECT record_id, n FROM (SELECT record_id, len(regexp_extract_all(p, '\"signature\"'))::INT AS n FROM (SELECT record_id, min(payload) AS p FROM replay_records GROUP BY 1)) WHERE n > 0",
}
