"""SQL forms, for DuckDB, of the queries over replayed messages."""

from __future__ import annotations

BLOCKS = """
pj AS (SELECT record_id, CASE WHEN json_type(payload::json) = 'VARCHAR' THEN payload::json->>'$' ELSE payload END AS p FROM (SELECT * FROM replay_records WHERE json_valid(payload))),
ms AS (SELECT record_id, CASE WHEN json_type(p, '$.messages') = 'ARRAY' THEN json_extract(p, '$.messages') ELSE json_array(p::json) END AS m FROM pj
  WHERE json_valid(p) AND json_type(p::json) = 'OBJECT' AND (json_type(p, '$.messages') = 'ARRAY' OR json_exists(p, '$.role') OR json_exists(p, '$.content')) QUALIFY row_number() OVER (PARTITION BY record_id) = 1),
mm AS (SELECT record_id::VARCHAR AS rec_key, unnest(json_extract(m, '$[*]')) AS msg, unnest(range(json_array_length(m)::BIGINT))::INT AS msg_pos FROM ms),
m1 AS (SELECT rec_key, msg_pos, msg->>'$.role' AS role, msg, json_extract(msg, '$.content') AS c, json_type(msg, '$.content') AS ct FROM mm),
bl AS (SELECT rec_key, msg_pos, 0 AS block_pos, role, 'tool_result' AS type, NULL AS id, msg->>'$.tool_use_id' AS tool_use_id, NULL AS name, CASE WHEN ct = 'VARCHAR' THEN c->>'$' END AS body, c AS content FROM m1 WHERE role = 'tool_result'
  UNION ALL SELECT rec_key, msg_pos, 0, role, 'text', NULL, NULL, NULL, c->>'$', NULL FROM m1 WHERE role IS DISTINCT FROM 'tool_result' AND ct = 'VARCHAR' AND (c->>'$') <> ''
  UNION ALL SELECT rec_key, msg_pos, block_pos, role, b->>'$.type', b->>'$.id', b->>'$.tool_use_id', b->>'$.name', CASE WHEN json_exists(b, '$.text') THEN b->>'$.text' WHEN json_exists(b, '$.thinking') THEN b->>'$.thinking' WHEN json_type(b, '$.content') = 'VARCHAR' THEN b->>'$.content' END, json_extract(b, '$.content')
    FROM (SELECT rec_key, msg_pos, role, unnest(json_extract(c, '$[*]')) AS b, unnest(range(json_array_length(c)::BIGINT))::INT AS block_pos FROM m1 WHERE role IS DISTINCT FROM 'tool_result' AND ct = 'ARRAY')),
cl AS (SELECT r.rec_key, r.msg_pos, r.block_pos, arg_max(u.msg_pos, (u.msg_pos, u.block_pos)) AS cm, arg_max(u.block_pos, (u.msg_pos, u.block_pos)) AS cb FROM bl r JOIN bl u ON u.rec_key = r.rec_key AND u.type = 'tool_use' AND r.type = 'tool_result' AND u.id = r.tool_use_id
  AND (u.msg_pos, u.block_pos) < (r.msg_pos, r.block_pos) GROUP BY ALL),
b0 AS (SELECT bl.*, -1 AS sub_pos, coalesce(cm, -1) AS call_msg_pos, coalesce(cb, -1) AS call_block_pos FROM bl LEFT JOIN cl USING (rec_key, msg_pos, block_pos)),
bs AS (SELECT rec_key, msg_pos, block_pos, sub_pos, call_msg_pos, call_block_pos, role, type, id, tool_use_id, name, body FROM b0
  UNION ALL SELECT rec_key, msg_pos, block_pos, sub_pos, call_msg_pos, call_block_pos, role, i->>'$.type', i->>'$.id', i->>'$.tool_use_id', i->>'$.name', CASE WHEN json_exists(i, '$.text') THEN i->>'$.text' END
    FROM (SELECT *  EXCLUDE (sub_pos), unnest(json_extract(content, '$[*]')) AS i, unnest(range(json_array_length(content)::BIGINT))::INT AS sub_pos FROM b0 WHERE type = 'tool_result' AND json_type(content) = 'ARRAY'))
"""
# All tool results, each once.
RESULTS = """ri AS (SELECT rec_key, msg_pos, block_pos, string_agg(body, chr(10) ORDER BY sub_pos) AS t FROM bs WHERE sub_pos >= 0 AND type = 'text' AND body IS NOT NULL GROUP BY ALL),
rb AS (SELECT b0.rec_key, b0.msg_pos, b0.block_pos, call_msg_pos, call_block_pos, tool_use_id, CASE json_type(content) WHEN 'VARCHAR' THEN content->>'$' WHEN 'ARRAY' THEN CASE WHEN json_array_length(content) = 0 THEN '' ELSE t END END AS content FROM b0 LEFT JOIN ri USING (rec_key, msg_pos, block_pos) WHERE b0.type = 'tool_result'),
rs AS (SELECT DISTINCT tool_use_id, content FROM (SELECT tool_use_id, content FROM rb UNION ALL SELECT r.tool_use_id, r.content FROM (SELECT unnest(tool_results) AS r FROM stress_turns)) WHERE tool_use_id IS NOT NULL)
"""
_MESSAGES = """
me AS (SELECT rec_key, msg_pos, any_value(role) AS role, count(*) AS n_blocks, count(*) FILTER (type = 'tool_use') AS n_uses, count(*) FILTER (type = 'tool_result') AS n_results, count(*) FILTER (type = 'thinking') AS n_thinking FROM bs WHERE sub_pos = -1 GROUP BY ALL),
ut AS (SELECT *, sum(authored::INT) OVER (PARTITION BY rec_key ORDER BY msg_pos)::BIGINT AS turn FROM (SELECT *, coalesce(role = 'user' AND n_results < n_blocks, false) AS authored FROM me))
"""


def _sql(body: str, *parts: str) -> str:
    return f"WITH {', '.join([BLOCKS, *parts])} {body}"


_TURNS = "tt AS (SELECT * FROM stress_turns QUALIFY row_number() OVER (PARTITION BY session_id, turn_index ORDER BY ingest_id) = 1)"
_ANSWERS = "tr AS (SELECT session_id || '/' || turn_index AS k, i, tool_results[i + 1] AS r, list_max(list_filter(range(len(tool_uses))::INT[], lambda p: tool_uses[p + 1].id = tool_results[i + 1].tool_use_id)) AS ca FROM (SELECT *, unnest(range(len(tool_results)))::INT AS i FROM tt))"
_KEYS = "rec_key, msg_pos, block_pos, sub_pos, call_msg_pos, call_block_pos"
ORACLES = {
    "p2_found": _sql(
        f"""SELECT {_KEYS} FROM bs
        UNION ALL SELECT session_id || '/' || turn_index, 0, unnest(range(len(tool_uses)))::INT, -1, -1, -1 FROM tt
        UNION ALL SELECT k, 1, i, -1, CASE WHEN ca IS NULL THEN -1 ELSE 0 END, coalesce(ca, -1) FROM (SELECT session_id || '/' || turn_index AS k, i, list_max(list_filter(range(len(tool_uses))::INT[], lambda p: tool_uses[p + 1].id = tool_results[i + 1].tool_use_id)) AS ca
          FROM (SELECT *, unnest(range(len(tool_results)))::INT AS i FROM tt))""",
        "tt AS (SELECT * FROM stress_turns QUALIFY row_number() OVER (PARTITION BY session_id, turn_index ORDER BY ingest_id) = 1)",
    ),
    "p2_blocks": _sql("SELECT * FROM bs"),
    "p2_all_blocks": _sql(
        """SELECT * FROM bs WHERE sub_pos < 0 UNION ALL SELECT k, 0, i, -1, -1, -1, 'assistant', u.type, u.id, NULL, u.name, NULL FROM (SELECT session_id || '/' || turn_index AS k, unnest(tool_uses) AS u, unnest(range(len(tool_uses)))::INT AS i FROM tt)
        UNION ALL SELECT k, 1, i, -1, CASE WHEN ca IS NULL THEN -1 ELSE 0 END, coalesce(ca, -1), 'user', 'tool_result', NULL, r.tool_use_id, NULL, r.content FROM tr""", _TURNS, _ANSWERS
    ),
    "p2_results": _sql(
        """SELECT rec_key, msg_pos, block_pos, call_msg_pos, call_block_pos, tool_use_id, content FROM rb UNION ALL SELECT k, 1, i, CASE WHEN ca IS NULL THEN -1 ELSE 0 END, coalesce(ca, -1), r.tool_use_id, r.content FROM tr""", RESULTS, _TURNS, _ANSWERS
    ),
    "p2_messages": _sql(
        """SELECT rec_key, msg_pos, role, msg->>'$.tool_use_id' AS tool_use_id, CASE ct WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' ELSE CASE WHEN ct IS NOT NULL THEN 'number' END END AS content_kind, coalesce(n, 0)::INT AS n_blocks
        FROM m1 LEFT JOIN (SELECT rec_key, msg_pos, count(*) AS n FROM bl GROUP BY ALL) USING (rec_key, msg_pos)
        UNION ALL SELECT session_id || '/' || turn_index, 0, 'assistant', NULL, CASE WHEN tool_uses IS NULL THEN 'null' ELSE 'array' END, coalesce(len(tool_uses), 0)::INT FROM tt
        UNION ALL SELECT session_id || '/' || turn_index, 1, 'user', NULL, CASE WHEN tool_results IS NULL THEN 'null' ELSE 'array' END, coalesce(len(tool_results), 0)::INT FROM tt""", _TURNS
    ),
    "p2_items": _sql(f"SELECT {_KEYS}, type, body FROM bs WHERE sub_pos >= 0"),
    "message_summary": _sql("SELECT * FROM me", _MESSAGES),
    "user_turns": _sql("SELECT rec_key, msg_pos, role, authored, turn FROM ut", _MESSAGES),
    "history_cut": _sql(
        """SELECT rec_key, msg_pos AS cut FROM (SELECT * FROM ut WHERE authored AND NOT EXISTS (SELECT 1 FROM bs WHERE bs.rec_key = ut.rec_key AND sub_pos = -1 AND type = 'tool_result' AND call_msg_pos >= 0 AND call_msg_pos < ut.msg_pos AND bs.msg_pos >= ut.msg_pos))
        QUALIFY row_number() OVER (PARTITION BY rec_key ORDER BY msg_pos DESC) = 3""", _MESSAGES
    ),
    "pairing_timeline": _sql(
        """SELECT n.rec_key, n.msg_pos, n_uses, coalesce(n_answers, 0) AS n_answers, next_role, coalesce(list_contains(i, next_pos), false) AS answered_next, coalesce(len(i), 0) > 1 AS fragmented
        FROM (SELECT *, lead(role) OVER w AS next_role, lead(msg_pos) OVER w AS next_pos FROM me WINDOW w AS (PARTITION BY rec_key ORDER BY msg_pos)) n
        LEFT JOIN (SELECT rec_key, call_msg_pos AS msg_pos, list(DISTINCT msg_pos) AS i, count(*) AS n_answers FROM bs WHERE sub_pos = -1 AND type = 'tool_result' AND call_msg_pos >= 0 GROUP BY ALL) a USING (rec_key, msg_pos) WHERE n_uses > 0""", _MESSAGES
    ),
    "merged_roles": _sql(
        """SELECT rec_key, island, any_value(role) AS role, min(msg_pos) AS first_pos, max(msg_pos) AS last_pos, sum(n_blocks)::BIGINT AS n_blocks FROM (SELECT *, sum(new) OVER (PARTITION BY rec_key ORDER BY msg_pos)::BIGINT AS island FROM (
        SELECT *, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role AND lag(msg_pos) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new FROM (SELECT * REPLACE (CASE WHEN role = 'tool_result' THEN 'user' ELSE role END AS role) FROM me) WINDOW w AS (PARTITION BY rec_key ORDER BY msg_pos))) GROUP BY ALL""", _MESSAGES
    ),
    "conversation_chunks": _sql(
        """SELECT rec_key, chunk, min(msg_pos) AS first_pos, max(msg_pos) AS last_pos, sum(n_blocks)::BIGINT AS n_blocks FROM (SELECT *, least(2, floor((greatest(turn, 1) - 1) * 3 / greatest(max(turn) OVER (PARTITION BY rec_key), 1)))::INT AS chunk FROM ut) GROUP BY ALL""", _MESSAGES
    ),
    "file_mentions": _sql(
        """SELECT rec_key, file, count(*) AS n, count(DISTINCT msg_pos) AS n_messages FROM (SELECT rec_key, msg_pos, unnest(regexp_extract_all(body, '([A-Za-z0-9_\\-./]+\\.(?:py|ts|go|md|sql|toml|yaml|json))\\b', 1)) AS file FROM bs WHERE body IS NOT NULL) GROUP BY ALL"""
    ),
    "fact_extract": _sql(
        """SELECT rec_key, key, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY rec_key ORDER BY key)::INT AS rank FROM (SELECT rec_key, regexp_extract(fact, '^([a-z_]+)', 1) AS key, arg_max(regexp_extract(fact, '[:=]\\s*(\\S+)$', 1), (msg_pos, block_pos, i)) AS value
        FROM (SELECT rec_key, msg_pos, block_pos, unnest(f) AS fact, unnest(range(len(f))) AS i FROM (SELECT *, regexp_extract_all(body, '\\b([a-z][a-z_]{2,}\\s*[:=]\\s*[A-Za-z0-9_./\\-]+)', 1) AS f FROM bs WHERE type = 'text' AND body IS NOT NULL)) GROUP BY rec_key, key)) WHERE rank <= 3"""
    ),
    "block_token_estimates": _sql("SELECT role, type, count(*) AS n, sum(floor(coalesce(length(body), 0) / 4))::BIGINT AS n_tokens FROM bs GROUP BY ALL"),
}
# The same over all messages, with or without blocks.
_ALL = """
me AS (SELECT m1.rec_key, m1.msg_pos, any_value(m1.role) AS role, count(block_pos) AS n_blocks, count(*) FILTER (type = 'tool_use') AS n_uses, count(*) FILTER (type = 'tool_result') AS n_results, count(*) FILTER (type = 'thinking') AS n_thinking
  FROM m1 LEFT JOIN (SELECT rec_key, msg_pos, block_pos, type FROM bs WHERE sub_pos = -1) b USING (rec_key, msg_pos) GROUP BY m1.rec_key, m1.msg_pos),
ut AS (SELECT *, sum(authored::INT) OVER (PARTITION BY rec_key ORDER BY msg_pos)::BIGINT AS turn FROM (SELECT *, coalesce(role = 'user' AND (n_results < n_blocks OR n_blocks = 0), false) AS authored FROM me))
"""
ORACLES |= {f"{name}_all": ORACLES[name].replace(_MESSAGES, _ALL) for name in ("message_summary", "user_turns", "pairing_timeline", "conversation_chunks")}
ORACLES["session_text_matches"] = _sql(
    """SELECT a.session_id, a.id AS left_id, b.id AS right_id, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS similarity FROM tk a JOIN tk b ON a.session_id = b.session_id AND a.id < b.id
    WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.25""",
    _TURNS, """tx AS (SELECT session_id, session_id || '/' || turn_index AS id, prompt AS body FROM tt UNION ALL SELECT session_id, rec_key || '/' || msg_pos || '/' || block_pos, body FROM bs
    JOIN (SELECT DISTINCT record_id::VARCHAR AS rec_key, session_id FROM replay_records) USING (rec_key) WHERE sub_pos = -1 AND type = 'text'),
    tk AS (SELECT * FROM (SELECT session_id, id, list_distinct(list_filter(regexp_split_to_array(lower(body), '[^a-z0-9_/]+'), lambda x: x <> '')) AS w FROM tx WHERE body IS NOT NULL AND session_id IS NOT NULL) WHERE len(w) > 0)""",
)
