"""Queries of summaries, and their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import text as T
from ..operators import events as E
from ..operators import ledger, unnest
from ..operators import rollups as R
from ..sources import table
from .ledger import _LATEST, _TABLE, DRIFT, _lines
from .message_sql import BLOCKS
from .sessions import _BASE


def _latest(f):  # type: ignore[no-untyped-def]
    return lambda spark, d: f(ledger.latest(_lines(spark, d)))


def _events(f):  # type: ignore[no-untyped-def]
    return lambda spark, d: f(E.tool_events(table(spark, d, "stress_turns")))


def _turns(f):  # type: ignore[no-untyped-def]
    return lambda spark, d: f(table(spark, d, "stress_turns"))


def fixture_metrics(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "replay_records")
    return R.fixture_metrics(unnest.payload_blocks(records), records, table(spark, d, "replay_meta"))


QUERIES = {
    "session_summary": _latest(R.session_summary),
    "lifetime_summary": _latest(R.lifetime),
    "sessions_since": _latest(R.since),
    "trend_views": _latest(lambda s: R.trends(R.session_summary(s))),
    "model_compare": _latest(R.models),
    "stream_benchmark": _latest(lambda s: R.benchmark(R.session_summary(s))),
    "capture_sessions": lambda spark, d: R.captures(table(spark, d, "replay_records")),
    "capture_candidates": lambda spark, d: R.candidates(R.captures(table(spark, d, "replay_records"))),
    "stress_evidence": _turns(R.evidence_by_signal),
    "stress_summary": lambda spark, d: R.stress_summary(table(spark, d, "stress_turns"), E.tool_events(table(spark, d, "stress_turns"))),
    "usage_records": _turns(R.usage),
    "bloat_attribution": _turns(lambda t: R.bloat(R.usage(t))),
    "fixture_metrics": fixture_metrics,
    "fixture_weighted": lambda spark, d: R.weighted(fixture_metrics(spark, d)),
    "catalog_check": lambda spark, d: R.duplicates(table(spark, d, "tool_families"), table(spark, d, "ledger_fields")),
    "hot_hints": _events(R.hot_hints),
    "advisories": _events(R.advisories),
    "warm_ups": _events(R.warm_ups),
    "hot_files": _events(R.hot_files),
    "file_candidates": _events(R.file_candidates),
}

_ERR = "|".join(T.ERROR_MARKS)
_SUM = """
sm AS (SELECT stream, session_id, date, turns, baseline, prepared, gross AS saved, net, round_even(CASE WHEN baseline > 0 THEN gross * 100.0 / baseline ELSE 0.0 END, 1)::DOUBLE AS saved_pct, round_even(CASE WHEN baseline > 0 THEN net * 100.0 / baseline ELSE 0.0 END, 1)::DOUBLE AS net_pct, reacquisitions, pressure, baseline - prepared = sv AS adds_up
  FROM (SELECT *, gross - coalesce(reacquisition_cost_tokens, 0) AS net FROM (SELECT *, coalesce(la.turns, 0) AS turns_, coalesce(baseline_prompt_tokens, 0) AS baseline, coalesce(prepared_prompt_tokens, 0) AS prepared, coalesce(saved_prompt_tokens, 0) AS sv, coalesce(reacquisition_count, 0) AS reacquisitions, coalesce(invisible_pressure, 0) AS pressure,
    coalesce(saved_prompt_tokens, 0) + coalesce(reacquisition_tokens_avoided_estimate, 0) - coalesce(hot_hint_tokens_added, 0) AS gross FROM la)))
""".replace("date, turns, baseline", "date, turns_ AS turns, baseline")


def _ledger(body: str, *more: str) -> str:
    return f"WITH {', '.join([DRIFT, _TABLE, _LATEST, *more])} {body}"


def _sql(body: str, *more: str) -> str:
    return f"WITH {', '.join([_BASE, *more])} {body}"


_FIGURES = ("saved_pct", "pressure", "saved", "reacquisitions")
_CAP = """
c0 AS (SELECT record_id, session_id, payload FROM replay_records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY json_valid(payload) DESC, payload DESC) = 1),
c1 AS (SELECT session_id, payload->>'$.event' AS event, payload->>'$.model' AS model, json_array_length(payload, '$.messages')::BIGINT AS m FROM c0 WHERE json_valid(payload) AND json_type(payload::json) = 'OBJECT'),
c2 AS (SELECT session_id, model, count(*) AS n, sum(m)::BIGINT AS nm FROM c1 WHERE event IS NOT NULL GROUP BY ALL),
cs AS (SELECT session_id, sum(n)::BIGINT AS n_events, sum(nm)::BIGINT AS n_messages, count(model) AS n_models, arg_max(model, (n, model)) AS dominant FROM c2 GROUP BY session_id)
"""
_REPEATS = """
rp AS (SELECT *, (n_hot >= 2 AND (family <> 'file_read' OR n_same >= 1)) AS hot FROM (SELECT *, sum(same::INT) OVER (PARTITION BY session_id, target ORDER BY turn, pos)::BIGINT AS n_same FROM (
  SELECT *, count(*) OVER (PARTITION BY session_id, target ORDER BY turn RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n_hot, count(*) OVER (PARTITION BY session_id, target ORDER BY turn RANGE BETWEEN 7 PRECEDING AND CURRENT ROW) AS n_stuck, coalesce(h = lag(h) OVER (PARTITION BY session_id, target ORDER BY turn, pos), false) AS same FROM x WHERE family IS NOT NULL)))
"""
_US = """
us AS (SELECT session_id, turn_index AS turn, model, floor(coalesce(length(prompt), 0) / 4)::BIGINT AS prompt_tokens, coalesce(list_sum(list_transform(tool_uses, lambda u: coalesce(list_sum(list_transform(map_values(u.input), lambda v: floor(coalesce(length(v), 0) / 4))), 0))), 0)::BIGINT AS input_tokens,
  coalesce(list_sum(list_transform(tool_results, lambda r: floor(coalesce(length(r.content), 0) / 4))), 0)::BIGINT AS result_tokens FROM t)
"""
_FX = """
fx AS (SELECT fixture, n_records, n_results, before, after, min_savings_pct, coalesce(usage_weight, 1.0) AS weight, CASE WHEN before > 0 THEN (before - after) * 100.0 / before ELSE 0.0 END::DOUBLE AS saved_pct FROM (SELECT fixture, count(*) AS n_records, sum(nr)::BIGINT AS n_results, sum(b)::BIGINT AS before, sum(a)::BIGINT AS after
  FROM (SELECT rec_key, sum(m)::BIGINT AS nr, sum(m * n)::BIGINT AS b, sum(n)::BIGINT AS a FROM (SELECT rec_key, body, count(*) AS m, floor(length(body) / 4)::BIGINT AS n FROM b0 WHERE type = 'tool_result' AND body IS NOT NULL GROUP BY rec_key, body) GROUP BY rec_key)
  JOIN (SELECT DISTINCT record_id::VARCHAR AS rec_key, fixture FROM replay_records) USING (rec_key) GROUP BY fixture) LEFT JOIN replay_meta USING (fixture))
"""
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: length(w) > 3))"
ORACLES = {
    "session_summary": _ledger("SELECT * FROM sm", _SUM),
    "lifetime_summary": _ledger(
        """SELECT stream, count(*) AS n_sessions, count(*) FILTER (file_seq = l) AS n_in_flight, sum(coalesce(tokens, 0))::BIGINT AS tokens, sum(coalesce(turns, 0))::BIGINT AS turns, sum(coalesce(baseline_prompt_tokens, 0))::BIGINT AS baseline_prompt_tokens, sum(coalesce(saved_prompt_tokens, 0))::BIGINT AS saved_prompt_tokens, min(date) AS first_date, max(date) AS last_date
        FROM (SELECT *, max(file_seq) OVER (PARTITION BY stream) AS l FROM la) GROUP BY stream"""
    ),
    "sessions_since": _ledger("SELECT stream, count(*) AS n_sessions, sum(saved_prompt_tokens)::BIGINT AS saved, min(date) AS first_date FROM (SELECT *, max(date) OVER (PARTITION BY stream) AS l FROM la) WHERE l - date < 30 GROUP BY stream"),
    "trend_views": _ledger(
        f"""SELECT stream, n, {', '.join(f'avg_{c}' for c in _FIGURES)}, {', '.join(f'slope_{c}' for c in _FIGURES)}, CASE WHEN n > 1 AND s1 > s0 AND p1 <= p0 THEN 'improving' WHEN n > 1 AND (s1 < s0 OR p1 > p0) THEN 'regressing' ELSE 'flat' END AS direction FROM (SELECT stream, count(*) AS n, {', '.join(f'round_even(avg({c}), 1)::DOUBLE AS avg_{c}' for c in _FIGURES)},
        {', '.join(f'round(coalesce(regr_slope({c}::DOUBLE, (-r)::DOUBLE), 0.0), 2)::DOUBLE AS slope_{c}' for c in _FIGURES)}, arg_max(saved_pct, r) AS s0, arg_min(saved_pct, r) AS s1, arg_max(pressure, r) AS p0, arg_min(pressure, r) AS p1
        FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY date DESC, session_id DESC) AS r FROM sm WHERE date IS NOT NULL) WHERE r <= 5 GROUP BY stream)""", _SUM
    ),
    "model_compare": _ledger(
        """SELECT stream, model, n, least, median, most, model = first_value(model) OVER (PARTITION BY stream ORDER BY n DESC, model DESC) AS dominant, model = first_value(model) OVER (PARTITION BY stream ORDER BY median, model) AS cheapest
        FROM (SELECT stream, model, count(*) AS n, min(tokens) AS least, median(tokens)::DOUBLE AS median, max(tokens) AS most FROM la WHERE model IS NOT NULL AND tokens IS NOT NULL GROUP BY ALL)"""
    ),
    "stream_benchmark": _ledger(
        """SELECT stream, count(*) AS n, avg(saved_pct) AS mean_saved_pct, sum(reacquisitions)::BIGINT AS reacquisitions, sum(pressure)::BIGINT AS pressure, count(*) FILTER (net < 0) AS n_losses, count(*) FILTER (NOT adds_up) AS n_odd, max(saved_pct) FILTER (i = round_even((m - 1) * 0.95, 0)::INT) AS p95_saved_pct
        FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY saved_pct) - 1 AS i, count(*) OVER (PARTITION BY stream) AS m FROM sm) GROUP BY stream""", _SUM
    ),
    "capture_sessions": f"WITH {_CAP} SELECT * FROM cs",
    "capture_candidates": f"WITH {_CAP} SELECT *, row_number() OVER (ORDER BY score DESC, n_events DESC, dominant)::INT AS rank FROM (SELECT dominant, count(*) AS n_sessions, sum(n_events)::BIGINT AS n_events, max(n_models) AS n_models, 2 * count(*) + max(n_models) - 1 AS score FROM cs GROUP BY 1)",
    "stress_evidence": _sql("SELECT signal, count(*) AS n_turns, count(DISTINCT session_id) AS n_sessions, sum(value)::BIGINT AS total, coalesce(string_agg(DISTINCT model, ',' ORDER BY model), '') AS models FROM (SELECT session_id, model, unnest(map_keys(input_behavior_signals)) AS signal, unnest(map_values(input_behavior_signals)) AS value FROM t) GROUP BY 1"),
    "stress_summary": _sql(
        f"""SELECT session_id, n_turns, most_messages, saved_tokens, micros, n_uses, n_reads, n_searches, n_edits, n_commands, n_missing, n_failed, first_failure, first_failed_target, depth FROM (SELECT session_id, count(*) AS n_turns, max(request_messages) AS most_messages, sum(input_saved_tokens)::BIGINT AS saved_tokens, epoch_us(max(recorded_at)) - epoch_us(min(recorded_at)) AS micros FROM t GROUP BY 1)
        LEFT JOIN (SELECT session_id, count(*) AS n_uses, count(*) FILTER (family = 'file_read') AS n_reads, count(*) FILTER (family = 'search') AS n_searches, count(*) FILTER (family = 'edit') AS n_edits, count(*) FILTER (family = 'command') AS n_commands, count(*) FILTER (raw IS NULL) AS n_missing, count(*) FILTER (f) AS n_failed, min(turn) FILTER (f) AS first_failure, arg_min(target, (turn, pos)) FILTER (f) AS first_failed_target,
          round(count(*) * count(DISTINCT tool) / nullif(sum(n_tokens), 0), 4)::DOUBLE AS depth FROM (SELECT *, regexp_matches(lower(raw), '{_ERR}') AS f FROM x) GROUP BY 1) USING (session_id)"""
    ),
    "usage_records": _sql("SELECT *, prompt_tokens + input_tokens + result_tokens AS total, CASE WHEN result_tokens >= input_tokens AND result_tokens >= prompt_tokens THEN 'results' WHEN input_tokens >= prompt_tokens THEN 'inputs' ELSE 'prompt' END AS largest FROM us", _US),
    "bloat_attribution": _sql(
        """SELECT session_id, part, n_tokens, coalesce(n_tokens * 100.0 / nullif(sum(n_tokens) OVER (PARTITION BY session_id), 0), 0.0)::DOUBLE AS pct, row_number() OVER (PARTITION BY session_id ORDER BY n_tokens DESC, part)::INT AS rank FROM (SELECT session_id, 'prompt' AS part, sum(prompt_tokens)::BIGINT AS n_tokens FROM us GROUP BY 1 UNION ALL SELECT session_id, 'input', sum(input_tokens)::BIGINT FROM us GROUP BY 1
        UNION ALL SELECT session_id, 'result', sum(result_tokens)::BIGINT FROM us GROUP BY 1)""", _US
    ),
    "fixture_metrics": f"WITH {BLOCKS}, {_FX} SELECT * FROM fx",
    "fixture_weighted": f"WITH {BLOCKS}, {_FX} SELECT count(*) AS n_fixtures, sum(weight) AS weight, sum(weight * saved_pct) / sum(weight) AS saved_pct FROM fx",
    "catalog_check": """SELECT catalog, count(*) AS n_names, count(*) FILTER (n > 1) AS n_repeated, count(*) FILTER (g > 1) AS n_ambiguous FROM (SELECT 'tools' AS catalog, regexp_replace(lower(regexp_replace(trim(tool_name), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+', '_', 'g') AS name, count(*) AS n, count(DISTINCT family) AS g FROM tool_families GROUP BY ALL
        UNION ALL SELECT 'fields', name, count(*), count(DISTINCT unit) FROM (SELECT unnest([field, short_key]) AS name, unit FROM ledger_fields) WHERE name IS NOT NULL GROUP BY ALL) GROUP BY catalog""",
    "hot_hints": _sql("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY stuck DESC, last_seen DESC, avoided DESC, target)::INT AS rank FROM (SELECT session_id, family, target, arg_max(n_stuck, (turn, pos)) AS stuck, max(turn) AS last_seen, arg_max(n_tokens, (turn, pos)) AS avoided FROM rp WHERE hot GROUP BY ALL)) WHERE rank <= 2", _REPEATS),
    "advisories": _sql(
        """SELECT session_id, a[2] AS advice, a[3] AS about FROM (SELECT session_id, min((p, advice, about)) AS a FROM (SELECT session_id, 0 AS p, 'nothing_new' AS advice, arg_min(target, (turn, pos)) AS about FROM rp WHERE hot AND same GROUP BY 1 UNION ALL SELECT session_id, 1, 'directory_thrash', min(parent) FROM (
        SELECT session_id, parent FROM (SELECT *, count(*) OVER (PARTITION BY session_id, parent ORDER BY turn RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent FROM x WHERE family = 'file_read' AND contains(path, '/'))) GROUP BY ALL HAVING count(DISTINCT path) >= 3 AND max(n) >= 3) GROUP BY 1) GROUP BY 1)""", _REPEATS
    ),
    "warm_ups": _sql(
        """SELECT session_id, path, neighbour, rank FROM (SELECT session_id, l.path, neighbour, row_number() OVER (PARTITION BY session_id ORDER BY ep DESC, neighbour)::INT AS rank FROM (SELECT session_id, parent, path AS neighbour, max((turn, pos)) AS ep FROM fr GROUP BY ALL) JOIN (SELECT session_id, arg_max(path, (turn, pos)) AS path, arg_max(parent, (turn, pos)) AS parent FROM fr GROUP BY 1) l USING (session_id, parent) WHERE neighbour <> l.path) WHERE rank <= 3""",
        "fr AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent FROM x WHERE family = 'file_read' AND path IS NOT NULL)",
    ),
    "hot_files": _sql("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY heat DESC, path)::INT AS rank FROM (SELECT session_id, path, sum(CASE WHEN family = 'edit' THEN 3 ELSE 1 END)::BIGINT AS heat FROM x WHERE family IN ('file_read', 'edit') AND path IS NOT NULL GROUP BY ALL)) WHERE rank <= 5"),
    "file_candidates": _sql(
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, path)::INT AS rank FROM (SELECT session_id, path, count(*) AS score FROM (SELECT session_id, path, unnest({_WORDS.format('path')}) AS w FROM (SELECT DISTINCT session_id, path FROM x WHERE family IN ('file_read', 'edit') AND path IS NOT NULL))
        JOIN (SELECT DISTINCT session_id, w FROM (SELECT session_id, unnest({_WORDS.format("concat_ws(' ', query, command)")}) AS w FROM x)) USING (session_id, w) GROUP BY ALL)) WHERE rank <= 5"""
    ),
}
