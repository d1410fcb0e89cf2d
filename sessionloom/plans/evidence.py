"""Queries over what sessions have seen of their files, repairs of messages, and their SQL forms."""

from __future__ import annotations

from ..operators import events as E
from ..operators import evidence, unnest
from ..sources import table
from .message_sql import BLOCKS
from .sessions import _BASE, _SPLIT


def _events(f):  # type: ignore[no-untyped-def]
    return lambda spark, d: f(E.tool_events(table(spark, d, "stress_turns")))


def _blocks(f):  # type: ignore[no-untyped-def]
    return lambda spark, d: f(unnest.payload_blocks(table(spark, d, "replay_records"), bodies=False))


QUERIES = {
    "evidence_ledger": _events(evidence.ledger),
    "blind_edits": _events(evidence.blind_edits),
    "file_aliases": _events(evidence.aliases),
    "skeleton_diff": _events(evidence.skeleton_diff),
    "structural_lines": _events(evidence.structural_lines),
    "pointer_profit": _events(evidence.pointers),
    "unchanged_targets": _events(evidence.unchanged_targets),
    "prompt_words": lambda spark, d: evidence.prompt_words(E.once(table(spark, d, "stress_turns"))),
    "safe_ids": _blocks(evidence.safe_ids),
    "quarantined_blocks": _blocks(evidence.quarantined),
    "block_reorder": _blocks(evidence.reordered),
}


def _sql(body: str, *more: str) -> str:
    return f"WITH {', '.join([_BASE, *more])} {body}"


_DEFS = "regexp_extract_all({0}, '(?m)^[ \\t]*((?:def|class)[ \\t]+[A-Za-z_][A-Za-z0-9_]*[^\\n]*)', 1)"
_NAMED = "SELECT session_id, path, regexp_extract(line, '^(?:def|class)[ \\t]+([A-Za-z_][A-Za-z0-9_]*)', 1) AS name, min(line) AS {1} FROM (SELECT session_id, path, unnest(" + _DEFS + ") AS line FROM ends) GROUP BY ALL"
ORACLES = {
    "evidence_ledger": _sql(
        """SELECT session_id, path, count(*) FILTER (family = 'file_read') AS n_reads, min(turn) FILTER (form = 'whole') AS first_whole_turn, arg_max(form, (turn, pos)) FILTER (form IS NOT NULL) AS last_form,
        coalesce(max((turn, pos)) FILTER (family = 'edit') > max((turn, pos)) FILTER (family = 'file_read'), count(*) FILTER (family = 'edit') > 0) AS stale
        FROM (SELECT *, CASE WHEN family = 'edit' THEN NULL WHEN a IS NULL THEN 'whole' ELSE 'part' END AS form FROM x WHERE family IN ('file_read', 'edit') AND path IS NOT NULL) GROUP BY session_id, path"""
    ),
    "blind_edits": _sql(
        """SELECT session_id, turn, pos, path, coalesce(seen, 'never') AS seen FROM (SELECT *, last_value(CASE WHEN family = 'file_read' THEN CASE WHEN a IS NULL THEN 'whole' ELSE 'part' END END IGNORE NULLS)
        OVER (PARTITION BY session_id, path ORDER BY turn, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM x WHERE family IN ('file_read', 'edit') AND path IS NOT NULL) WHERE family = 'edit' AND coalesce(seen, 'part') = 'part'"""
    ),
    "file_aliases": _sql(
        "SELECT session_id, turn, pos, path, original FROM (SELECT *, first_value(path) OVER (PARTITION BY session_id, h ORDER BY turn, pos) AS original FROM x WHERE family = 'file_read' AND path IS NOT NULL AND length(raw) >= 200) WHERE original <> path"
    ),
    "skeleton_diff": _sql(
        f"""SELECT session_id, path, name, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed' END AS change FROM ({_NAMED.format('a', 'old')}) FULL JOIN ({_NAMED.format('b', 'new')}) USING (session_id, path, name) WHERE old IS DISTINCT FROM new""",
        "ends AS (SELECT * FROM (SELECT session_id, path, arg_min(raw, (turn, pos)) AS a, arg_max(raw, (turn, pos)) AS b, count(*) AS n FROM x WHERE family = 'file_read' AND path IS NOT NULL AND raw IS NOT NULL GROUP BY ALL) WHERE n > 1 AND a <> b)",
    ),
    "structural_lines": _sql(
        f"""SELECT session_id, turn, pos, line_no, score FROM (SELECT *, CASE WHEN regexp_matches(line, '^\\s*(def|class) ') THEN 3 WHEN regexp_matches(lower(line), 'error|raise|fail') THEN 2 WHEN regexp_matches(line, '^(import|from) ') THEN 1 ELSE 0 END AS score
        FROM (SELECT session_id, turn, pos, unnest({_SPLIT}) AS line, unnest(range(len({_SPLIT})))::INT AS line_no FROM x WHERE family = 'file_read' AND raw IS NOT NULL)) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY session_id, turn, pos ORDER BY score DESC, line_no) <= 5"""
    ),
    "pointer_profit": _sql(
        """SELECT word, n, tokens, (tokens - 2) * n - tokens AS profit FROM (SELECT word, count(*) AS n, (length(word) // 4)::BIGINT AS tokens FROM (SELECT unnest(regexp_extract_all(raw, '([A-Za-z0-9_./-]{12,})', 1)) AS word FROM x WHERE raw IS NOT NULL) GROUP BY word)
        WHERE (tokens - 2) * n - tokens > 2 ORDER BY profit DESC, word LIMIT 60"""
    ),
    "unchanged_targets": _sql("SELECT target, count(*) AS n_results, count(DISTINCT h) AS n_forms, count(DISTINCT session_id) AS n_sessions FROM x WHERE raw IS NOT NULL AND family IS NOT NULL GROUP BY target HAVING count(*) > 1"),
    "prompt_words": _sql("SELECT model, lower(regexp_extract(prompt, '^\\s*(\\S+)', 1)) AS word, count(*) AS n, count(DISTINCT session_id) AS n_sessions FROM t WHERE prompt IS NOT NULL GROUP BY ALL HAVING count(*) >= 2"),
    "safe_ids": f"""WITH {BLOCKS} SELECT rec_key, old, count(*) AS n_blocks, count(*) FILTER (type = 'tool_use') AS n_calls, 'id_' || left(sha256(old), 12) AS new FROM (SELECT rec_key, coalesce(id, tool_use_id) AS old, type FROM bs WHERE sub_pos = -1)
        WHERE old IS NOT NULL AND NOT regexp_matches(old, '^[a-zA-Z0-9_-]{{1,16}}$') GROUP BY ALL""",
    "quarantined_blocks": f"""WITH {BLOCKS} SELECT rec_key, msg_pos, block_pos, 'unanswered' AS reason FROM bs u WHERE sub_pos = -1 AND type = 'tool_use' AND NOT EXISTS (SELECT 1 FROM bs r WHERE r.sub_pos = -1 AND r.type = 'tool_result' AND r.rec_key = u.rec_key AND r.call_msg_pos = u.msg_pos AND r.call_block_pos = u.block_pos)
        UNION ALL SELECT rec_key, msg_pos, block_pos, 'no_call' FROM bs WHERE sub_pos = -1 AND type = 'tool_result' AND call_msg_pos < 0""",
    "block_reorder": f"""WITH {BLOCKS} SELECT rec_key, msg_pos, block_pos, new_pos FROM (SELECT *, (row_number() OVER (PARTITION BY rec_key, msg_pos ORDER BY (type = 'tool_use')::INT, block_pos) - 1)::INT AS new_pos FROM bs WHERE sub_pos = -1 AND role = 'assistant') WHERE new_pos <> block_pos""",
}
