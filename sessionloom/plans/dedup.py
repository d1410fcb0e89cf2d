"""Queries over what repeated results could have saved, and their SQL forms."""

from __future__ import annotations

from ..operators import dedup as D
from ..sources import table
from .identities import _args
from .sessions import _BASE, _CANONICAL


def _found(f):  # type: ignore[no-untyped-def]
    return lambda spark, d: f(D.opportunities(table(spark, d, "stress_turns")))


QUERIES = {
    "dedup_analysis": _found(lambda o: o.drop("candidates")),
    "dedup_sources": _found(D.sources),
    "dedup_totals": _found(D.totals),
    "dedup_buckets": _found(D.buckets),
    "dedup_experiments": _found(D.experiments),
    "dedup_families": _found(D.families),
}

# The base of the sessions' queries, with a row per result instead of one per use.
_OBSERVED = _BASE.replace(
    "u0 AS (SELECT session_id, turn_index AS turn, workspace_root, tool_results, unnest(tool_uses) AS u, unnest(range(len(tool_uses)))::INT AS pos FROM t)",
    """r0 AS (SELECT session_id, turn_index AS turn, workspace_root, tool_uses, input_behavior_signals AS sg, unnest(tool_results) AS r, unnest(range(len(tool_results)))::INT AS pos FROM t),
u0 AS (SELECT *, list_filter(tool_uses, lambda v: v.id = r.tool_use_id)[-1] AS u FROM r0 WHERE r.content IS NOT NULL)""",
).replace("list_filter(tool_results, lambda r: r.tool_use_id = u.id)[1].content AS raw", "r.content AS raw").replace("u.id AS tool_use_id, tool,", f"r.tool_use_id AS tool_use_id, u.id AS uid, coalesce(sg['{D.REVERTED}'] > 0, false) AS reverted, coalesce(sg['{D.BLOCKED}'] > 0, false) AS blocked, tool,")
_STEP = f"""
b0 AS (SELECT session_id, turn, pos, tool_use_id, reverted, blocked, uid IS NULL AS context_missing, CASE WHEN uid IS NULL THEN 'missing' ELSE coalesce(family, 'unknown') END AS family, CASE WHEN uid IS NULL THEN 'missing' WHEN family IS NULL THEN 'other|' || coalesce(path, '') ELSE target END AS about,
  CASE WHEN uid IS NULL THEN '' ELSE {_args()} END AS ar, h, left(sha256({_CANONICAL}), 16) AS c, length(raw)::INT AS n_chars FROM x),
b1 AS (SELECT *, family || '|' || ar AS identity, family || '|' || about AS logical FROM b0),
b2 AS (SELECT *, lag(h) OVER (PARTITION BY session_id, identity ORDER BY turn, pos) AS ih, lag(c) OVER (PARTITION BY session_id, identity ORDER BY turn, pos) AS ic, lag(h) OVER (PARTITION BY session_id, logical ORDER BY turn, pos) AS lh, lag(c) OVER (PARTITION BY session_id, logical ORDER BY turn, pos) AS lc,
  coalesce(lag(family) OVER (PARTITION BY session_id, h ORDER BY turn, pos) <> family, false) AS crossed FROM b1),
b3 AS (SELECT *, EXISTS (SELECT 1 FROM b1 p WHERE p.session_id = b2.session_id AND p.family = b2.family AND p.c = b2.c AND (p.turn, p.pos) < (b2.turn, b2.pos) AND p.identity <> b2.identity) AS oi, coalesce(ih = h, false) OR coalesce(lh = h, false) OR crossed AS exact, coalesce(ic = c, false) OR coalesce(lc = c, false) AS canonical,
  CASE WHEN ih IS NOT NULL THEN CASE WHEN ic = c AND ih <> h THEN 'canonical_repeat' ELSE 'same_identity_repeat' END WHEN lh IS NOT NULL THEN CASE WHEN lc = c AND lh <> h THEN 'canonical_repeat' ELSE 'alias_repeat' END WHEN crossed THEN 'cross_tool_same_output' ELSE 'first_seen' END AS repeat_class,
  CASE WHEN ih = h THEN CASE WHEN n_chars >= {D.LEAST} THEN 'exact_dedup_hit' ELSE 'cache_hit' END WHEN ih IS NOT NULL AND family IN ('file_read', 'search') THEN 'diff_compression' ELSE 'no_compression' END AS outcome, greatest(0, n_chars - {D.STUB}) AS stub FROM b2),
b4 AS (SELECT *, CASE WHEN outcome IN ('exact_dedup_hit', 'cache_hit') THEN stub ELSE 0 END AS saved, CASE WHEN outcome = 'exact_dedup_hit' THEN NULL WHEN reverted AND exact THEN 'preflight_reverted' WHEN blocked AND exact THEN 'history_winnowing_blocked' WHEN context_missing THEN 'context_missing'
  WHEN repeat_class = 'first_seen' THEN CASE WHEN oi THEN 'identity_changed' ELSE 'first_seen' END WHEN n_chars < {D.LEAST} THEN 'below_min_chars' WHEN repeat_class = 'canonical_repeat' THEN 'volatile_only_change' WHEN NOT exact THEN 'exact_content_changed' END AS miss_reason FROM b3),
b5 AS (SELECT *, list_filter([{', '.join(f"CASE WHEN family = 'file_read' AND exact AND n_chars >= {n} THEN {{'saved': stub, 'name': 'file_threshold_{n}'}} END" for n in D.THRESHOLDS)}, CASE WHEN family IN ('file_read', 'search') AND repeat_class = 'alias_repeat' AND exact THEN {{'saved': stub, 'name': 'alias_key'}} END,
  CASE WHEN family IN ('file_read', 'search', 'command') AND repeat_class = 'canonical_repeat' AND canonical THEN {{'saved': stub, 'name': 'canonical_hash'}} END, CASE WHEN family IN ('file_read', 'search', 'command') AND exact AND n_chars >= {D.LEAST} THEN {{'saved': greatest(saved, stub), 'name': 'shorter_form'}} END], lambda v: v IS NOT NULL) AS cand FROM b4),
b6 AS (SELECT *, list_sort(list_filter(cand, lambda v: v.saved > saved), 'DESC')[1] AS best, NOT bool_or(reverted) OVER (PARTITION BY session_id) AS trusted, blocked AND turn <= 1 AS benign, repeat_class <> 'first_seen' OR oi OR outcome IN ('exact_dedup_hit', 'cache_hit') AS repeats,
  CASE WHEN repeat_class = 'canonical_repeat' THEN 'volatile_repeat' WHEN repeat_class IN ('alias_repeat', 'cross_tool_same_output') THEN 'alias_miss' WHEN miss_reason IN ('preflight_reverted', 'history_winnowing_blocked') THEN 'structural_cliff' WHEN repeat_class = 'first_seen' THEN NULL
  WHEN n_chars < {D.LEAST} AND family = 'file_read' THEN 'small_file_repeat' WHEN n_chars < {D.LEAST} AND family = 'search' THEN 'small_search_repeat' WHEN n_chars < {D.LEAST} AND family = 'command' THEN 'small_command_repeat' ELSE 'large_exact_repeat' END AS opportunity_class FROM b5),
b7 AS (SELECT *, coalesce(best.saved - saved, 0) AS headroom FROM b6),
o AS (SELECT *, coalesce(trusted AND NOT benign AND repeats AND miss_reason <> 'first_seen' AND (headroom > 0 OR miss_reason IN ('preflight_reverted', 'history_winnowing_blocked')), false) AS actionable FROM b7)
"""


def _sql(body: str) -> str:
    return f"WITH {_OBSERVED}, {_STEP} {body}"


_SUMS = (
    "count(*) AS n_results, count(*) FILTER (trusted AND repeats) AS n_trusted, count(*) FILTER (outcome = 'exact_dedup_hit') AS n_hits, count(*) FILTER (trusted AND repeats AND outcome = 'exact_dedup_hit') AS n_trusted_hits, count(*) FILTER (outcome = 'cache_hit') AS n_cache_hits, "
    "count(*) FILTER (outcome = 'diff_compression') AS n_diffs, sum(headroom)::BIGINT AS headroom, coalesce(sum(headroom) FILTER (trusted AND repeats), 0)::BIGINT AS trusted_headroom, coalesce(sum(headroom) FILTER (actionable), 0)::BIGINT AS actionable_headroom, "
    + ", ".join(f"count(*) FILTER (miss_reason = '{r}') AS miss_{r}" for r in D.REASONS)
)
ORACLES = {
    "dedup_analysis": _sql("SELECT session_id, turn, pos, tool_use_id, family, logical, repeat_class, outcome, miss_reason, opportunity_class, n_chars, saved, best.name AS candidate, headroom, trusted, repeats, reverted, benign, actionable FROM o"),
    "dedup_sources": _sql(f"SELECT session_id, bool_and(trusted) AS trusted, concat_ws(',', CASE WHEN bool_or(miss_reason = 'context_missing') THEN 'missing_tool_context' END, CASE WHEN bool_or(reverted) THEN 'preflight_incompatible' END) AS noisy_reasons, {_SUMS} FROM o GROUP BY session_id"),
    "dedup_totals": _sql(f"SELECT count(DISTINCT session_id) AS n_sessions, count(DISTINCT session_id) FILTER (trusted) AS n_trusted_sessions, {_SUMS} FROM o"),
    "dedup_buckets": _sql(
        """SELECT *, row_number() OVER (ORDER BY headroom DESC, actionable_headroom DESC, n DESC, opportunity_class)::INT AS rank FROM (SELECT opportunity_class, count(*) AS n, count(DISTINCT session_id) AS n_sessions, sum(headroom)::BIGINT AS headroom, coalesce(sum(headroom) FILTER (actionable), 0)::BIGINT AS actionable_headroom, sum(n_chars)::BIGINT AS n_chars
        FROM o WHERE opportunity_class IS NOT NULL GROUP BY 1 HAVING sum(headroom) >= 256)"""
    ),
    "dedup_experiments": _sql(
        """SELECT k.name AS experiment, count(*) AS n, count(DISTINCT session_id) AS n_sessions, sum(k.saved)::BIGINT AS would_save, sum(greatest(0, k.saved - saved))::BIGINT AS more, coalesce(sum(greatest(0, k.saved - saved)) FILTER (trusted), 0)::BIGINT AS trusted_more
        FROM (SELECT *, unnest(cand) AS k FROM o) GROUP BY 1"""
    ),
    "dedup_families": _sql("SELECT family, count(*) AS n, sum(headroom)::BIGINT AS headroom FROM o WHERE headroom > 0 GROUP BY 1"),
}
