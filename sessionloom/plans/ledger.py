"""Queries over the savings ledger and over replayed messages, with the SQL forms of the drift queries they start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, ledger, messages, unnest
from ..operators.drift import ALIASES, TRACKED, UNITS
from ..sources import table
from . import message_sql


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified(table(spark, d, "savings_files"), table(spark, d, "savings_records"))


def _sessions(f):  # type: ignore[no-untyped-def]
    return lambda spark, d: f(ledger.latest(_lines(spark, d)))


def _blocks(f, *a):  # type: ignore[no-untyped-def]
    return lambda spark, d: f(unnest.payload_blocks(table(spark, d, "replay_records")), *a)


def _messages(f):  # type: ignore[no-untyped-def]
    """f over the blocks and all messages, with or without blocks."""
    return lambda spark, d: f(unnest.payload_blocks(table(spark, d, "replay_records"), messages=True))


def _user_turns(blocks: DataFrame) -> DataFrame:
    return messages.user_turns(messages.messages(blocks)).select("rec_key", "msg_pos", "role", "authored", "turn")


def ledger_latest(spark: SparkSession, d: str) -> DataFrame:
    return ledger.latest(_lines(spark, d)).select("stream", "session_id", "file_seq", "line_no", "date", "model", "tokens", "saved_prompt_tokens")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as runs: the return flag is the lane, the ship mode's month the task."""
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("lane"), F.date_format("l_shipdate", "yyyy-MM").alias("task"), F.col("l_quantity").alias("value"), (F.col("l_discount") > 0.05).alias("success"))


def nearest_rank_p95(spark: SparkSession, d: str) -> DataFrame:
    return ledger.nearest_rank(table(spark, d, "events"), "event_type", "value")


def similar_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Names of fixtures against names of ledger fields, by shared words of more than three characters; `session_text_matches` is the job over texts."""
    t = table(spark, d, "replay_meta")
    left = t.select(F.col("fixture").alias("id"), F.lit("all").alias("key"), F.concat_ws(" ", F.replace("fixture", F.lit("_"), F.lit(" ")), "fixture_kind").alias("text"))
    right = table(spark, d, "ledger_fields").select(F.col("field").alias("id"), F.lit("all").alias("key"), F.replace("field", F.lit("_"), F.lit(" ")).alias("text"))
    return messages.similar_prompts(left, right, 0.1)


def session_text_matches(spark: SparkSession, d: str) -> DataFrame:
    """Similar texts of one session: prompts of its turns and texts of its replayed messages, each with each.

    An id is session/turn, or record/message/block. Redelivered turns and records count once; without a session_id
    there is nothing to match with. Prompts meet texts of records where both tables hold the session.
    """
    turns = table(spark, d, "stress_turns").select("session_id", "turn_index", "prompt").dropDuplicates(["session_id", "turn_index"])
    prompts = turns.select(F.col("session_id").alias("key"), F.concat_ws("/", "session_id", "turn_index").alias("id"), F.col("prompt").alias("text"))
    records = table(spark, d, "replay_records")
    blocks = unnest.payload_blocks(records).filter("sub_pos < 0 and type = 'text' and body is not null")
    owners = records.select(F.col("record_id").cast("string").alias("rec_key"), F.col("session_id").alias("key")).dropDuplicates(["rec_key"])
    said = blocks.join(owners, "rec_key").select("key", F.concat_ws("/", "rec_key", "msg_pos", "block_pos").alias("id"), F.col("body").alias("text"))
    return messages.similar_texts(prompts.unionByName(said)).withColumnRenamed("key", "session_id")


QUERIES = {
    "ledger_latest": ledger_latest,
    "ledger_rollup": _sessions(ledger.rollup),
    "session_net_saved": _sessions(ledger.saved),
    "recent_sessions": _sessions(ledger.recent),
    "trend_slope": _sessions(ledger.trend),
    "peak_savings": _sessions(ledger.peak),
    "nearest_rank_p95": nearest_rank_p95,
    "lane_summary": lambda spark, d: ledger.lanes(_runs(spark, d)),
    "paired_compare": lambda spark, d: ledger.paired(_runs(spark, d), "A", "R"),
    "message_summary": _blocks(lambda b: messages.messages(b).drop("text")),
    "user_turns": _blocks(_user_turns),
    "history_cut": _messages(messages.cuts),
    # The whole forms of four queries whose own SQL starts from messages that have blocks.
    "message_summary_all": _messages(lambda b: messages.messages(b).drop("text")),
    "user_turns_all": _messages(_user_turns),
    "pairing_timeline_all": _messages(messages.timeline),
    "conversation_chunks_all": _messages(messages.chunks),
    "pairing_timeline": _blocks(messages.timeline),
    "merged_roles": _blocks(messages.merged_roles),
    "conversation_chunks": _blocks(messages.chunks),
    "file_mentions": _blocks(messages.mentions),
    "fact_extract": _blocks(messages.facts),
    "block_token_estimates": _blocks(messages.token_estimates),
    "jaccard_match": similar_prompts,
    "session_text_matches": session_text_matches,
}

# ---- SQL --------------------------------------------------------------------------------------------------------

_KNOWN = ", ".join(f"('{a}', '{f}')" for f, more in ALIASES.items() for a in (f, *more))
_PLAIN = "CASE WHEN coalesce(v, '') = '' THEN 'missing' WHEN regexp_matches(v, '^[+-]?[0-9]+$') THEN 'whole' WHEN regexp_matches(v, '^[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'decimal' ELSE 'text' END"
_JSON = "CASE WHEN json_type(j) = 'NULL' OR (j->>'$') = '' THEN 'missing' WHEN json_type(j) IN ('BIGINT', 'UBIGINT') THEN 'whole' WHEN json_type(j) = 'DOUBLE' THEN 'decimal' ELSE 'text' END"
DRIFT = f"""
known(a, field) AS (VALUES {_KNOWN}),
ln0 AS (SELECT r.file_id, r.line_no, r.raw, f.stream, f.file_seq, f.fmt, f.header, CASE fmt WHEN 'jsonl' THEN json_valid(raw) AND coalesce(json_type(try_cast(raw AS json)), '') = 'OBJECT'
  WHEN 'semi' THEN len(string_split(header, ';')) = len(string_split(raw, ';')) WHEN 'kv' THEN len(list_filter(string_split(raw, '|'), lambda p: strpos(p, ':') <= 1)) = 0 ELSE false END AS readable
  FROM savings_records r LEFT JOIN savings_files f USING (file_id)),
ln AS (SELECT * FROM ln0 QUALIFY row_number() OVER (PARTITION BY file_id, line_no ORDER BY readable DESC, raw DESC) = 1),
j1 AS (SELECT file_id, line_no, k, json_extract(raw::json, '$."' || k || '"') AS j FROM (SELECT *, unnest(json_keys(raw::json)) AS k FROM ln WHERE readable AND fmt = 'jsonl')),
j2 AS (SELECT file_id, line_no, k, j FROM j1 WHERE json_type(j) <> 'OBJECT' UNION ALL
  SELECT file_id, line_no, k || '.' || k2, json_extract(j, '$."' || k2 || '"') FROM (SELECT *, unnest(json_keys(j)) AS k2 FROM j1 WHERE json_type(j) = 'OBJECT')),
s1 AS (SELECT file_id, line_no, unnest(string_split(header, ';')) AS k, trim(unnest(string_split(raw, ';'))) AS v FROM ln WHERE readable AND fmt = 'semi'),
k1 AS (SELECT file_id, line_no, split_part(p, ':', 1) AS k, trim(regexp_replace(p, '^[^:]*:', '')) AS v FROM (SELECT *, unnest(string_split(raw, '|')) AS p FROM ln WHERE readable AND fmt = 'kv')),
en0 AS (SELECT file_id, line_no, k AS name, {_JSON} AS kind, j->>'$' AS value FROM j2 UNION ALL SELECT file_id, line_no, k, {_PLAIN}, v FROM (SELECT * FROM s1 UNION ALL SELECT * FROM k1)),
en AS (SELECT en0.*, coalesce(known.field, simple) AS field FROM (SELECT *, regexp_replace(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+', '_', 'g') AS simple FROM en0) en0 LEFT JOIN known ON a = simple)
"""
_GRID = f"""
nr AS (SELECT file_id, count(*) AS n FROM ln WHERE readable GROUP BY 1),
nm AS (SELECT file_id, field, name, count(*) AS n FROM en WHERE field IN {TRACKED} GROUP BY ALL),
kd AS (SELECT file_id, field, kind, count(*) AS n FROM en WHERE field IN {TRACKED} AND kind <> 'missing' GROUP BY ALL),
c AS (SELECT nm.file_id, nm.field, sum(nm.n) AS carry, arg_min(name, (-nm.n, name)) AS name FROM nm GROUP BY ALL),
d AS (SELECT file_id, field, arg_min(kind, (-n, kind)) AS kind FROM kd GROUP BY ALL),
g AS (SELECT f.file_id, stream, file_seq, x.field, name, kind, coalesce(2 * carry > n, false) AS present FROM savings_files f CROSS JOIN (SELECT unnest({list(TRACKED)}) AS field) x
  LEFT JOIN nr USING (file_id) LEFT JOIN c ON c.file_id = f.file_id AND c.field = x.field LEFT JOIN d ON d.file_id = f.file_id AND d.field = x.field)
"""


def _cast(field: str) -> str:
    v = f"max(CASE WHEN kind <> 'missing' THEN value END) FILTER (field = '{field}')"
    unit = UNITS[field]
    if unit == "text":
        return f"{v} AS {field}"
    if unit == "date":
        return f"try_cast({v} AS DATE) AS {field}"
    number = f"try_cast(replace(regexp_replace({v}, '^~|\\s*[a-zA-Z]*$', '', 'g'), ',', '') AS DOUBLE)"
    return f"{number} AS {field}" if unit == "usd" else f"round({number})::BIGINT AS {field}"


_TABLE = f"""
un AS (SELECT stream, file_seq, ln.file_id, ln.line_no, q.* EXCLUDE (file_id, line_no), NOT readable AS damaged, CASE WHEN NOT readable THEN raw END AS damaged_raw
  FROM ln LEFT JOIN (SELECT file_id, line_no, {', '.join(map(_cast, ALIASES))} FROM en GROUP BY file_id, line_no) q ON q.file_id = ln.file_id AND q.line_no = ln.line_no)
"""
_LATEST = "la AS (SELECT * FROM un WHERE NOT damaged AND session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stream, session_id ORDER BY file_seq DESC, line_no DESC, file_id DESC) = 1)"


def _sql(body: str, *parts: str) -> str:
    return f"WITH {', '.join([DRIFT, *parts])} {body}"


_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in ledger.COUNTERS)
_RUNS = "WITH runs AS (SELECT l_returnflag AS lane, strftime(l_shipdate, '%Y-%m') AS task, l_quantity AS value, l_discount > 0.05 AS success FROM lineitem)"
ORACLES = message_sql.ORACLES | {
    "p1_found": _sql(
        """SELECT file_id, field, change FROM (SELECT file_id, field, unnest([CASE WHEN present AND NOT was THEN 'added' END, CASE WHEN NOT present AND was THEN 'removed' END,
        CASE WHEN present AND was AND name <> old THEN 'renamed' END, CASE WHEN present AND was AND kind <> old_kind THEN 'retyped' END]) AS change FROM (SELECT *, lag(present) OVER w AS was, lag(name) OVER w AS old, lag(kind) OVER w AS old_kind FROM g
        WINDOW w AS (PARTITION BY stream, field ORDER BY file_seq, file_id))) WHERE change IS NOT NULL""", _GRID
    ),
    "p1_lifespans": _sql(
        """SELECT stream, field, name, kind, min(file_seq) AS first_seq, max(file_seq) AS last_seq, count(*) AS n_files, max(file_seq) = any_value(e) AS open FROM (SELECT *, max(file_seq) OVER (PARTITION BY stream, field) AS e,
        row_number() OVER (PARTITION BY stream, field ORDER BY file_seq, file_id) - row_number() OVER (PARTITION BY stream, field, present, name, kind ORDER BY file_seq, file_id) AS i FROM g) WHERE present GROUP BY stream, field, name, kind, i""", _GRID
    ),
    "p1_table": _sql("SELECT * FROM un", _TABLE),
    "ledger_latest": _sql("SELECT stream, session_id, file_seq, line_no, date, model, tokens, saved_prompt_tokens FROM la", _TABLE, _LATEST),
    "ledger_rollup": _sql(f"SELECT stream, model, grouping(stream, model)::INT AS level, count(*) AS n_sessions, {_SUMS} FROM la GROUP BY ROLLUP (stream, model)", _TABLE, _LATEST),
    "session_net_saved": _sql(
        """SELECT stream, session_id, date, net_saved, CASE WHEN baseline_prompt_tokens <> 0 THEN net_saved * 100.0 / baseline_prompt_tokens END::DOUBLE AS net_pct FROM (SELECT *, coalesce(saved_prompt_tokens, 0) - coalesce(hot_hint_tokens_added, 0) - coalesce(reacquisition_cost_tokens, 0) AS net_saved FROM la)""", _TABLE, _LATEST
    ),
    "recent_sessions": _sql(f"SELECT stream, count(*) AS n_sessions, min(date) AS first_date, max(date) AS last_date, {_SUMS} FROM (SELECT * FROM la QUALIFY row_number() OVER (PARTITION BY stream ORDER BY date DESC NULLS LAST, file_seq DESC, line_no DESC, session_id DESC) <= 5) GROUP BY stream", _TABLE, _LATEST),
    "trend_slope": _sql(
        """SELECT *, CASE WHEN last > first THEN 'up' WHEN last < first THEN 'down' ELSE 'flat' END AS direction FROM (SELECT stream, count(*) AS n_sessions, avg(y) AS mean, regr_slope(y, i) AS slope, arg_min(y, i) AS first, arg_max(y, i) AS last
        FROM (SELECT *, saved_prompt_tokens::DOUBLE AS y, row_number() OVER (PARTITION BY stream ORDER BY date, file_seq, line_no, session_id) AS i FROM la WHERE saved_prompt_tokens IS NOT NULL AND date IS NOT NULL) GROUP BY stream)""", _TABLE, _LATEST
    ),
    "peak_savings": _sql(
        """SELECT stream, max(pct)::DOUBLE AS peak_pct, count(*) AS n_sessions FROM (SELECT stream, 100.0 * sum(saved_prompt_tokens) OVER w / nullif(sum(baseline_prompt_tokens) OVER w, 0) AS pct FROM la
        WHERE saved_prompt_tokens IS NOT NULL AND baseline_prompt_tokens IS NOT NULL AND date IS NOT NULL WINDOW w AS (PARTITION BY stream ORDER BY date, file_seq, line_no, session_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY stream""", _TABLE, _LATEST
    ),
    "nearest_rank_p95": "SELECT event_type, value, n FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE i = round_even((n - 1) * 0.95, 0)::INT",
    "lane_summary": f"""{_RUNS}, t AS (SELECT lane, task, count(*) AS n, count(*) FILTER (success) AS ok, var_pop(value) AS v, count(DISTINCT success) AS outcomes FROM runs GROUP BY ALL)
        SELECT t.lane, sum(n)::BIGINT AS n_runs, sum(ok) / sum(n) AS success_rate, avg(v) FILTER (n > 1) AS mean_variance, count(*) FILTER (outcomes = 1) AS n_stable, any_value(m.median) AS median
        FROM t JOIN (SELECT lane, median(value) AS median FROM runs GROUP BY lane) m USING (lane) GROUP BY t.lane""",
    "paired_compare": f"""{_RUNS} SELECT task, base, candidate, candidate - base AS delta, CASE WHEN candidate < base THEN 'candidate' WHEN candidate > base THEN 'base' ELSE 'tie' END AS winner
        FROM (SELECT task, avg(value) AS base FROM runs WHERE lane = 'A' GROUP BY task) JOIN (SELECT task, avg(value) AS candidate FROM runs WHERE lane = 'R' GROUP BY task) USING (task)""",
    "jaccard_match": """WITH a AS (SELECT fixture AS id, list_distinct(list_filter(regexp_split_to_array(lower(concat_ws(' ', replace(fixture, '_', ' '), fixture_kind)), '[^a-z0-9]+'), lambda w: length(w) > 3)) AS w FROM replay_meta),
        b AS (SELECT field AS id, list_distinct(list_filter(regexp_split_to_array(lower(replace(field, '_', ' ')), '[^a-z0-9]+'), lambda w: length(w) > 3)) AS w FROM ledger_fields)
        SELECT a.id AS left_id, b.id AS right_id, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS similarity FROM a, b WHERE len(list_intersect(a.w, b.w)) > 0 AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.1""",
}
