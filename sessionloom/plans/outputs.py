"""Queries over the kinds and forms of outputs, and their SQL forms."""

from __future__ import annotations

from ..functions import text as T
from ..operators import events as E
from ..operators import outputs as O
from ..sources import table
from .identities import _parsed, q
from .sessions import _BASE, _SPLIT


def _events(f):  # type: ignore[no-untyped-def]
    return lambda spark, d: f(E.tool_events(table(spark, d, "stress_turns")))


QUERIES = {
    "output_kinds": _events(O.kinds),
    "output_forms": _events(O.forms),
    "window_pass": _events(O.window_pass),
    "unchanged_stubs": _events(O.stubs),
    "trace_repeat_deltas": _events(O.trace_deltas),
}

_ERR = "|".join(T.ERROR_MARKS)
_COUNT = lambda p: f"len(list_filter(f, lambda v: regexp_matches(v, {q(p)})))"
_KIND = (
    f"CASE WHEN raw IS NULL OR trim(raw, ' ') = '' THEN 'empty' WHEN regexp_matches(raw, {q(O.RULES[0][1])}) THEN 'stack_trace' WHEN {_COUNT(O.FRAMES)} >= 3 THEN 'stack_trace' "
    + " ".join(f"WHEN regexp_matches(raw, {q(p)}) THEN '{k}'" for k, p in O.RULES[1:])
    + f" WHEN regexp_matches(raw, '^\\s*[\\[{{]') AND json_valid(raw) THEN CASE WHEN regexp_matches(raw, {q(O.EVIDENCE)}) THEN 'search_results' ELSE 'json' END "
    + " ".join(f"WHEN len(f) >= {least} AND {_COUNT(p)} >= len(f) * {share} THEN '{k}'" for k, p, share, least in O.SHARES)
    + " WHEN len(f) >= 5 AND length(left(f[1], 8)) = 8 AND len(list_filter(list_slice(f, 1, 5), lambda v: starts_with(v, left(f[1], 8)))) = 5 THEN 'repetitive' ELSE 'raw' END"
)
_K = f"k AS (SELECT *, {_KIND} AS kind FROM (SELECT *, list_filter({_SPLIT}, lambda v: trim(v, ' ') <> '') AS f FROM {{}} WHERE raw IS NOT NULL))"


def _sql(body: str, *more: str) -> str:
    return f"WITH {', '.join([_BASE, *(m.strip() for m in more)])} {body}"


_SUMMARY = "(SELECT coalesce(string_agg(v, ' | ' ORDER BY i), '') FROM (SELECT *, sum(length(v) + CASE WHEN n > 1 THEN 3 ELSE 0 END) OVER (ORDER BY i) AS upto FROM (SELECT *, row_number() OVER (ORDER BY i) AS n FROM (SELECT trim(t, ' ') AS v, i FROM (SELECT unnest(f3) AS t, unnest(range(len(f3))) AS i)) WHERE v <> '')) WHERE upto <= 80)"
ORACLES = {
    "output_kinds": _sql("SELECT kind, count(*) AS n, sum(length(raw))::BIGINT AS n_chars FROM k GROUP BY kind", _K.replace("{}", "x")),
    "window_pass": _sql(
        """SELECT session_id, turn, pos, kind, length(raw)::INT AS n_chars, CASE WHEN kind = 'test_report' AND regexp_matches(raw, 'FAILED|failed') THEN 'failing_tests' WHEN kind = 'code' THEN 'code' WHEN coalesce(lp, false) THEN 'path_list' WHEN length(raw) <= CASE WHEN kind IN ('grep', 'grep_context', 'listing', 'find', 'log', 'json') THEN 1200 ELSE 8000 END THEN 'small' ELSE 'shortened' END AS reason FROM k""",
        _parsed("x", "command", "ev"), _K.replace("{}", "ev"),
    ),
    "unchanged_stubs": _sql(
        f"""SELECT session_id, turn, pos, target, guard, CASE WHEN guard IS NULL THEN st END AS stub, CASE WHEN guard IS NULL THEN greatest(0, n - length(st)) ELSE 0 END::INT AS saved FROM (SELECT *, '@stable_result(hash:' || h || ') ' || target || ' |> ' || su AS st, CASE WHEN rn = 1 THEN 'first_of_target' WHEN failed AND NOT coalesce(of, false) THEN 'first_failure' WHEN a IS NOT NULL THEN 'partial_read'
        WHEN n < 200 THEN 'short' WHEN family = 'file_read' AND rn = 2 THEN 'first_repeat_of_file' WHEN oh <> h THEN 'changed' END AS guard FROM (SELECT *, row_number() OVER w AS rn, lag(h) OVER w AS oh, lag(failed) OVER w AS of FROM (SELECT *, {_SUMMARY} AS su FROM (SELECT *, length(raw) AS n, regexp_matches(lower(raw), '{_ERR}') AS failed, list_slice({_SPLIT}, 1, 3) AS f3
        FROM x WHERE raw IS NOT NULL AND family IS NOT NULL)) WINDOW w AS (PARTITION BY session_id, target ORDER BY turn, pos)))"""
    ),
    "trace_repeat_deltas": _sql(
        f"""SELECT session_id, turn, pos, signature, len(ls)::INT AS n_lines, len(list_filter(ls, lambda v: NOT list_contains(old, v)))::INT AS n_new FROM (SELECT *, lag(ls) OVER (PARTITION BY session_id, signature ORDER BY turn, pos) AS old FROM (SELECT session_id, turn, pos, list_distinct({_SPLIT}) AS ls, left(sha256(regexp_replace(list_filter({_SPLIT}, lambda v: regexp_matches(lower(v), '{_ERR}'))[-1], '[0-9]+', '0', 'g')), 16) AS signature
        FROM x WHERE regexp_matches(lower(raw), '{_ERR}'))) WHERE old IS NOT NULL"""
    ),
}
