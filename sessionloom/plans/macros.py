"""Queries over repeated workflows, and their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import macros as M
from ..sources import table
from .sessions import _BASE


def _events(spark: SparkSession, d: str) -> DataFrame:
    return E.tool_events(table(spark, d, "stress_turns"))


def _ins(f):  # type: ignore[no-untyped-def]
    return lambda spark, d: f(M.instructions(_events(spark, d)))


def _registry(ins: DataFrame) -> DataFrame:
    return M.registered(M.mined(ins))


def _used(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    ins = M.instructions(e)
    return M.uses(ins, _registry(ins), e)


def macro_credit(spark: SparkSession, d: str) -> DataFrame:
    """The last match of each session written as a state line that names it."""
    ins = M.instructions(_events(spark, d))
    lines = M.matched(ins, _registry(ins)).select("session_id", F.concat(F.lit(">>> m:@"), "name").alias("line"))
    return M.credited(lines, _used(spark, d))


def macro_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Each session's match expanded with the last argument of the session."""
    ins = M.instructions(_events(spark, d))
    last = ins.groupBy("session_id").agg(F.max_by("arg", F.struct("turn", "pos")).alias("arg"))
    reg = _registry(ins)
    return M.expanded(M.matched(ins, reg).join(last, "session_id").select(F.col("session_id").alias("call_id"), "name", "arg"), reg)


QUERIES = {
    "history_instructions": _ins(M.batches),
    "macro_mining": _ins(M.mined),
    "macro_registry": _ins(_registry),
    "macro_matches": _ins(lambda i: M.matched(i, _registry(i))),
    "macro_uses": _used,
    "macro_decay": lambda spark, d: M.kept(_used(spark, d)),
    "macro_expansion": macro_expansion,
    "macro_hints": _ins(lambda i: M.hints(i, _registry(i))),
    "macro_credit": macro_credit,
}

_INS = "ins AS (SELECT session_id, turn, pos, CASE family WHEN 'file_read' THEN 'read' WHEN 'search' THEN 'search' WHEN 'edit' THEN 'edit' WHEN 'command' THEN 'shell' END AS op, coalesce(CASE family WHEN 'search' THEN query WHEN 'command' THEN program ELSE path END, '') AS arg, raw FROM x WHERE family IN ('file_read', 'search', 'edit', 'command'))"
_MINED = """
s3 AS (SELECT *, lead(op) OVER w AS o1, lead(op, 2) OVER w AS o2, lead(arg) OVER w AS a1, lead(arg, 2) OVER w AS a2 FROM ins WINDOW w AS (PARTITION BY session_id ORDER BY turn, pos)),
sq AS (SELECT session_id, turn, pos, 2 AS size, op || ' > ' || o1 AS ops, CASE WHEN arg = a1 AND a1 <> '' THEN '0->1' ELSE '' END AS edges, [arg, a1] AS args FROM s3 WHERE o1 IS NOT NULL UNION ALL
  SELECT session_id, turn, pos, 3, op || ' > ' || o1 || ' > ' || o2, concat_ws('|', CASE WHEN arg = a1 AND a1 <> '' THEN '0->1' END, CASE WHEN a2 <> '' AND a1 = a2 THEN '1->2' WHEN a2 <> '' AND arg = a2 THEN '0->2' END), [arg, a1, a2] FROM s3 WHERE o2 IS NOT NULL),
ct AS (SELECT ops, edges, size, count(*) AS n, count(DISTINCT session_id) AS n_sessions, len(list_distinct(list_filter(arg_min(args, (session_id, turn, pos)), lambda v: contains(v, '/'))))::INT AS n_parameters FROM sq GROUP BY ALL HAVING count(*) >= 3),
mi AS (SELECT ops, edges, size, n, n_sessions, n_parameters FROM ct WHERE NOT EXISTS (SELECT 1 FROM ct d WHERE d.size > 2 AND (regexp_extract(d.ops, '^(.*) > [^>]*$', 1) = ct.ops OR regexp_extract(d.ops, '^[^>]* > (.*)$', 1) = ct.ops))),
rg AS (SELECT 'macro_' || left(sha256(ops), 8) AS name, ops, edges, size, n, n_sessions, n_parameters, n_forms FROM (SELECT *, count(*) OVER (PARTITION BY ops) AS n_forms, row_number() OVER (PARTITION BY ops ORDER BY n DESC, length(edges), edges) AS k FROM mi) WHERE k = 1)
"""
_MATCH = """
tl AS (SELECT session_id, list(op ORDER BY turn, pos) AS o FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC, pos DESC) AS k FROM ins) WHERE k <= 3 GROUP BY 1),
mt AS (SELECT session_id, arg_max(name, (size, name)) AS name, max(size) AS size FROM tl JOIN rg ON len(o) >= size AND array_to_string(list_slice(o, len(o) - size + 1, len(o)), ' > ') = ops GROUP BY 1)
"""
_USES = """
us AS (SELECT name, count(*) AS hits, count(DISTINCT sq.session_id) AS n_sessions, max(t.recorded_at::DATE) AS last_seen, sum(floor(coalesce(length(raw), 0) / 4))::BIGINT AS saved FROM sq JOIN rg USING (ops) JOIN ins USING (session_id, turn, pos) JOIN t ON t.session_id = sq.session_id AND t.turn_index = sq.turn GROUP BY name)
"""


def _sql(body: str, *more: str) -> str:
    return f"WITH {', '.join([_BASE, _INS, *more])} {body}"


_STEP = "list_distinct(list_filter(list_transform(list_filter(st, lambda v: v.o IN ({})), lambda v: v.a), lambda v: v <> ''))"
_TOLD = lambda label, ops: f"CASE WHEN len({_STEP.format(ops)}) > 0 THEN '{label} ' || (SELECT string_agg(v, ', ' ORDER BY i) FROM (SELECT v, min(i) AS i FROM (SELECT unnest(list_transform(list_filter(st, lambda v: v.o IN ({ops}) AND v.a <> ''), lambda v: v.a)) AS v, unnest(range(len(list_filter(st, lambda v: v.o IN ({ops}) AND v.a <> '')))) AS i) GROUP BY v)) END"
ORACLES = {
    "history_instructions": _sql(
        """SELECT session_id, turn, min(pos) AS pos, any_value(op) AS op, count(*) AS n, string_agg(arg, ',' ORDER BY pos) AS args FROM (SELECT *, sum(new) OVER (PARTITION BY session_id, turn ORDER BY pos) AS k FROM (SELECT *, CASE WHEN lag(op) OVER (PARTITION BY session_id, turn ORDER BY pos) = op THEN 0 ELSE 1 END AS new FROM ins)) GROUP BY session_id, turn, k"""
    ),
    "macro_mining": _sql("SELECT * FROM mi", _MINED),
    "macro_registry": _sql("SELECT * FROM rg", _MINED),
    "macro_matches": _sql("SELECT * FROM mt", _MINED, _MATCH),
    "macro_uses": _sql("SELECT * FROM us", _MINED, _USES),
    "macro_decay": _sql("SELECT *, (SELECT max(last_seen) FROM us) - last_seen AS age, NOT ((SELECT max(last_seen) FROM us) - last_seen > 7 AND hits < 3 AND saved < 50) AS keep FROM us", _MINED, _USES),
    "macro_expansion": _sql(
        """SELECT session_id AS call_id, i AS step, CASE op WHEN 'read' THEN 'read_file' WHEN 'search' THEN 'grep_search' WHEN 'edit' THEN 'edit' ELSE 'bash' END AS tool, CASE op WHEN 'search' THEN 'query' WHEN 'shell' THEN 'command' ELSE 'path' END AS argument, arg AS value
        FROM (SELECT mt.session_id, l.arg, unnest(string_split(ops, ' > ')) AS op, unnest(range(len(string_split(ops, ' > '))))::INT AS i FROM mt JOIN rg USING (name) JOIN (SELECT session_id, arg_max(arg, (turn, pos)) AS arg FROM ins GROUP BY 1) l USING (session_id))""", _MINED, _MATCH
    ),
    "macro_hints": _sql(
        f"""SELECT session_id, name, hint FROM (SELECT session_id, name, concat_ws('; ', {_TOLD('searched', "'search'")}, {_TOLD('read', "'read', 'edit'")}, {_TOLD('ran', "'shell'")}) AS hint FROM (SELECT session_id, name, arg_max(st, (turn, pos)) AS st FROM (
        SELECT session_id, turn, pos, op || ' > ' || o1 AS ops, [{{'o': op, 'a': arg}}, {{'o': o1, 'a': a1}}] AS st FROM s3 WHERE o1 IS NOT NULL UNION ALL SELECT session_id, turn, pos, op || ' > ' || o1 || ' > ' || o2, [{{'o': op, 'a': arg}}, {{'o': o1, 'a': a1}}, {{'o': o2, 'a': a2}}] FROM s3 WHERE o2 IS NOT NULL) JOIN rg USING (ops) GROUP BY ALL)) WHERE hint <> ''""", _MINED
    ),
    "macro_credit": _sql("SELECT name, count(*) AS n_lines, sum(saved // hits)::BIGINT AS credited FROM mt JOIN us USING (name) GROUP BY 1", _MINED, _MATCH, _USES),
}
