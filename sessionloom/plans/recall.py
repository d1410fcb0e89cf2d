"""Queries over what sessions remember, with SQL forms where no fold is needed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import events as E
from ..operators import recall as R
from ..sources import table
from .sessions import _BASE, _SPLIT


def _events(f):  # type: ignore[no-untyped-def]
    return lambda spark, d: f(E.tool_events(table(spark, d, "stress_turns")))


def _facts(said):  # type: ignore[no-untyped-def]
    return said.filter("field = 'facts'").select("session_id", "turn", F.substring_index("value", ":", 1).alias("key"), F.substring_index("value", ":", -1).alias("value"))


QUERIES = {
    "memory_fields": _events(lambda e: R.memories(R.values(e))),
    "value_aliases": _events(lambda e: R.aliases(R.values(e))),
    "fact_tiers": _events(lambda e: R.tiers(_facts(R.values(e)))),
    "said_values": _events(R.values),
    "state_deltas": _events(lambda e: R.deltas(R.states(R.values(e)))),
    "state_moves": _events(lambda e: R.moves(R.states(R.values(e)))),
    "episodes": _events(R.episodes),
    "snapshots": _events(R.snapshots),
}

_ERR = "|".join(T.ERROR_MARKS)
_SAID = f"""
sd AS (SELECT session_id, turn, pos, part, field, value FROM (
  SELECT session_id, turn, pos, 0 AS part, CASE WHEN family = 'edit' THEN 'edited' ELSE 'files' END AS field, path AS value FROM x UNION ALL SELECT session_id, turn, pos, 1, 'cmds', program FROM x UNION ALL SELECT session_id, turn, pos, 2, 'questions', query FROM x
  UNION ALL SELECT session_id, turn, pos, 3, 'errs', left(trim(list_filter({_SPLIT}, lambda v: regexp_matches(lower(v), '{_ERR}'))[1], ' '), 60) FROM x UNION ALL SELECT session_id, turn, pos, 4, 'facts', CASE WHEN family = 'file_read' THEN path || ':' || left(sha256(raw), 8) END FROM x) WHERE value IS NOT NULL)
"""
_STATES = """
sr AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn, field ORDER BY value) AS r FROM (SELECT DISTINCT session_id, turn, field, value FROM sd)),
sf AS (SELECT session_id, turn, field, string_agg(value, ',' ORDER BY value) AS v FROM sr WHERE r <= 3 GROUP BY ALL),
sl AS (SELECT session_id, turn, list({'k': field, 'v': v} ORDER BY field) AS st FROM sf GROUP BY ALL),
so AS (SELECT *, lag(st) OVER (PARTITION BY session_id ORDER BY turn) AS old FROM sl)
"""


def _sql(body: str, *more: str) -> str:
    return f"WITH {', '.join([_BASE, *more])} {body}"


_LINE = "array_to_string(list_transform({}, lambda e: e.k || ':' || e.v), '|')"
_CHANGED = "list_filter(st, lambda e: NOT list_contains(old, e))"
ORACLES = {
    "said_values": _sql("SELECT * FROM sd", _SAID),
    "state_deltas": _sql(
        f"""SELECT session_id, turn, how, {_LINE.format('st')} AS line, CASE how WHEN 'full' THEN {_LINE.format('st')} WHEN 'delta' THEN coalesce({_LINE.format(_CHANGED)}, '') ELSE '' END AS sent FROM (SELECT *, CASE WHEN old IS NULL THEN 'full' WHEN len({_CHANGED}) = 0 AND len(list_filter(old, lambda o: NOT list_contains(list_transform(st, lambda e: e.k), o.k))) = 0 THEN 'suppress'
        WHEN list_contains(list_transform(st, lambda e: e.k), 'facts') AND NOT list_contains(list_transform(old, lambda e: e.k), 'facts') THEN 'full' ELSE 'delta' END AS how FROM so)""", _SAID, _STATES
    ),
    "state_moves": _sql(
        """SELECT session_id, turn, len(list_filter(list_distinct(now), lambda v: NOT list_contains(was, v)))::INT AS promoted, len(list_filter(list_distinct(was), lambda v: NOT list_contains(now, v)))::INT AS demoted FROM (SELECT session_id, turn, flatten(list_transform(st, lambda e: list_transform(string_split(e.v, ','), lambda v: e.k || ':' || v))) AS now,
        coalesce(flatten(list_transform(old, lambda e: list_transform(string_split(e.v, ','), lambda v: e.k || ':' || v))), []) AS was FROM so)""", _SAID, _STATES
    ),
    "episodes": _sql(
        f"""SELECT session_id, count(*) AS n_episodes, count(*) FILTER (failed) AS n_failed, string_agg(CASE WHEN r <= 3 THEN concat_ws(':', left(goal, 24), CASE WHEN failed THEN 'F' ELSE 'S' END, learned) END, '|' ORDER BY turn) AS line FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS r
        FROM (SELECT session_id, turn, arg_min(coalesce(path, query, command, tool), pos) AS goal, bool_or(regexp_matches(lower(raw), '{_ERR}')) AS failed, arg_max(left(regexp_replace(raw, '\\s+', ' ', 'g'), 32), pos) AS learned FROM x WHERE raw IS NOT NULL GROUP BY ALL)) WHERE r <= 8 GROUP BY session_id"""
    ),
    "snapshots": _sql(
        f"""SELECT session_id, f.kind AS kind, f.fact AS fact, count(*) AS n, min(turn) AS first_turn, max(turn) AS last_turn FROM (SELECT session_id, turn, unnest(list_distinct(list_concat(list_transform(CASE WHEN family = 'search' THEN regexp_extract_all(raw, '(?m)^([^:\\s][^:\\n]*:[0-9]+:\\s*(?:class|def|async def)\\s+\\w+)', 1) ELSE [] END, lambda v: {{'kind': 'symbol', 'fact': v}}),
        list_transform(CASE WHEN family = 'file_read' AND len({_SPLIT}) >= 20 THEN regexp_extract_all(raw, '(?m)^((?:class|def|async def)\\s+\\w+)', 1) ELSE [] END, lambda v: {{'kind': 'section', 'fact': v}}), list_transform(regexp_extract_all(raw, 'File "([^"]+", line [0-9]+)', 1), lambda v: {{'kind': 'frame', 'fact': v}})))) AS f FROM x WHERE raw IS NOT NULL) GROUP BY ALL"""
    ),
}
