"""Queries over texts, traces, memory and streams, with SQL forms where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import codecs, folds, memory, structure
from ..operators import events as E
from ..sources import table
from ..streaming import windows
from .sessions import _BASE


def _documents(f):  # type: ignore[no-untyped-def]
    return lambda spark, d: f(table(spark, d, "documents"))


def _events(f):  # type: ignore[no-untyped-def]
    return lambda spark, d: f(E.tool_events(table(spark, d, "stress_turns")))


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return windows.drained(windows.tumbling(windows.events(spark, d)), "complete")


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users by gaps of half an hour, closed by the watermark."""
    s = windows.sessions(windows.events(spark, d)).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("end"), "n")
    return windows.drained(s)


def stream_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    unique = windows.deduplicated(windows.events(spark, d), "event_id")
    return windows.drained(unique.select("event_id", "user_id", "event_type"))


def stream_memory(spark: SparkSession, d: str) -> DataFrame:
    """The fold over a stream of the turns' files, against `memory_decay`."""
    turns = windows.tables(spark, d, "stress_turns")
    u = F.explode("tool_uses")
    values = turns.select("session_id", F.col("turn_index").alias("turn"), u.alias("u")).select("session_id", "turn", T.tool_name(F.col("u.name")).alias("value"))
    return windows.drained(memory.stream(values), "update", ["session_id"])


def memory_decay(spark: SparkSession, d: str) -> DataFrame:
    return memory.remembered(E.tool_events(table(spark, d, "stress_turns")).select("session_id", "turn", F.col("tool").alias("value")))


def batch_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users by gaps of half an hour, the batch form of the streaming operator."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n")


def text_scalars(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.token_estimate(t).alias("n_tokens"), T.digest(t).alias("digest"), F.size(T.lines(t)).alias("n_lines"), T.has_error(t).alias("has_error"), T.clip(t, 60).alias("clip"))


QUERIES = {
    "markdown_nodes": _documents(structure.markdown_nodes),
    "code_signatures": _documents(structure.signatures),
    "shared_lines": _documents(structure.shared_lines),
    "redact_secrets": _documents(structure.redacted),
    "text_scalars": text_scalars,
    "trace_audit": lambda spark, d: structure.trace_audit(table(spark, d, "stress_turns")),
    "codec_pass": _events(codecs.passed),
    "reread_diffs": _events(codecs.reread_diffs),
    "memory_decay": memory_decay,
    "result_cache_expiry": _events(folds.cache_outcomes),
    "hint_cooldown": lambda spark, d: folds.cooled(E.signals(table(spark, d, "stress_turns")).select("session_id", F.col("signal").alias("hint"), "turn")),
    "event_sessions": batch_sessions,
    "stream_tumbling": stream_tumbling,
    "stream_deduplicated": stream_deduplicated,
    "stream_memory": stream_memory,
    "stream_sessions": stream_sessions,
}

_LINES = "string_split(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n$', ''), chr(10))"
_DOC_LINES = f"SELECT doc_id, source, unnest({_LINES}) AS line, unnest(range(len({_LINES})))::INT AS line_no FROM documents"
_MASKED = "text"
for _p, _mask in T.SECRETS:
    _MASKED = f"regexp_replace({_MASKED}, '{_p.replace(chr(39), chr(39) * 2)}', '{_mask.replace('$', chr(92))}', 'g')"
_KIND = "CASE WHEN f THEN 'fence' WHEN fenced THEN 'code' WHEN regexp_matches(line, '^#{1,6} ') THEN 'heading' WHEN regexp_matches(line, '^\\s*[-*+] ') THEN 'item' WHEN regexp_matches(line, '^\\|.*\\|$') THEN 'row' ELSE 'text' END"
ORACLES = {
    "markdown_nodes": f"""WITH l AS (SELECT *, starts_with(line, '```') AS f FROM ({_DOC_LINES}) WHERE trim(line, ' ') <> ''),
        k AS (SELECT *, coalesce(sum(f::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS fenced FROM l), n AS (SELECT *, {_KIND} AS kind FROM k)
        SELECT doc_id, line_no, kind, CASE kind WHEN 'heading' THEN length(regexp_extract(line, '^(#+)', 1)) WHEN 'item' THEN length(regexp_extract(line, '^(\\s*)', 1)) ELSE 0 END::INT AS level, fenced,
        last_value(CASE WHEN kind = 'heading' THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM n""",
    "code_signatures": f"""SELECT doc_id, line_no, kind, regexp_extract(line, '(?:def|class)\\s+([A-Za-z_]\\w*)', 1) AS name, length(regexp_extract(line, '^(\\s*)', 1))::INT AS indent, CASE WHEN trim(p) = '' THEN 0 ELSE len(string_split(p, ','))::INT END AS n_parameters
        FROM (SELECT *, regexp_extract(line, '^\\s*(def|class)\\s+[A-Za-z_]\\w*', 1) AS kind, regexp_extract(line, '\\(([^)]*)\\)', 1) AS p FROM ({_DOC_LINES})) WHERE kind <> ''""",
    "shared_lines": f"SELECT line, count(DISTINCT source) AS n_sources, count(DISTINCT doc_id) AS n_texts FROM ({_DOC_LINES}) WHERE length(line) >= 20 GROUP BY line HAVING count(DISTINCT source) > 1",
    "redact_secrets": f"SELECT doc_id, left(sha256(masked), 16) AS digest, (length(text) - length(masked))::INT AS n_masked FROM (SELECT doc_id, text, {_MASKED} AS masked FROM documents) WHERE masked <> text",
    "text_scalars": f"""SELECT doc_id, floor(coalesce(length(text), 0) / 4)::BIGINT AS n_tokens, left(sha256(text), 16) AS digest, coalesce(len({_LINES})::INT, NULL) AS n_lines, regexp_matches(lower(text), '{'|'.join(T.ERROR_MARKS)}') AS has_error,
        CASE WHEN length(text) <= 60 THEN text ELSE left(text, 59) || '…' END AS clip FROM documents""",
    "trace_audit": """SELECT ingest_id, session_id, code FROM (SELECT ingest_id, session_id, unnest([CASE WHEN nth > 1 THEN 'duplicate' END, CASE WHEN turn_index < highest THEN 'out_of_order' END, CASE WHEN prompt IS NULL THEN 'missing_prompt' END,
        CASE WHEN workspace_id IS NULL THEN 'missing_workspace' END, CASE WHEN model IS NULL THEN 'missing_model' END, CASE WHEN len(tool_uses) = 0 THEN 'no_tool_use' END]) AS code FROM (SELECT *, row_number() OVER (PARTITION BY session_id, turn_index ORDER BY ingest_id) AS nth,
        max(turn_index) OVER (PARTITION BY session_id ORDER BY ingest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM stress_turns)) WHERE code IS NOT NULL""",
    "event_sessions": """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
    "hint_cooldown": """WITH h AS (SELECT session_id, turn_index AS turn, unnest(map_keys(input_behavior_signals)) AS hint FROM (SELECT * FROM stress_turns QUALIFY row_number() OVER (PARTITION BY session_id, turn_index ORDER BY ingest_id) = 1)),
        g AS (SELECT session_id, hint, list_reduce(list([turn] ORDER BY turn), lambda a, v: CASE WHEN v[1] - a[-1] > 3 THEN list_append(a, v[1]) ELSE a END) AS given FROM h GROUP BY ALL)
        SELECT h.session_id, h.hint, h.turn, list_contains(g.given, h.turn) AS given FROM h JOIN g USING (session_id, hint)""",
    "result_cache_expiry": f"""WITH {_BASE}, q AS (SELECT session_id, target, turn, pos, family, h, epoch_us(recorded_at) / 1e6 AS tm FROM x JOIN (SELECT session_id, turn_index AS turn, recorded_at FROM t) USING (session_id, turn) WHERE raw IS NOT NULL AND family IS NOT NULL),
        f AS (SELECT session_id, target, list_reduce(list([{{'turn': turn, 'pos': pos, 'family': family, 'h': h, 'tm': tm, 'o': 'stored'}}] ORDER BY turn, pos), lambda a, v: list_append(a, CASE WHEN v[1].tm - a[-1].tm > 1800 THEN {{'turn': v[1].turn, 'pos': v[1].pos, 'family': v[1].family, 'h': v[1].h, 'tm': v[1].tm, 'o': 'expired'}}
          WHEN a[-1].h = v[1].h THEN {{'turn': v[1].turn, 'pos': v[1].pos, 'family': v[1].family, 'h': v[1].h, 'tm': v[1].tm, 'o': 'unchanged'}} WHEN v[1].family = 'command' THEN {{'turn': v[1].turn, 'pos': v[1].pos, 'family': v[1].family, 'h': v[1].h, 'tm': v[1].tm, 'o': 'changed'}}
          ELSE {{'turn': v[1].turn, 'pos': v[1].pos, 'family': v[1].family, 'h': a[-1].h, 'tm': a[-1].tm, 'o': 'changed'}} END)) AS s FROM q GROUP BY ALL)
        SELECT session_id, target, e.turn AS turn, e.pos AS pos, e.family AS family, e.o AS outcome FROM (SELECT session_id, target, unnest(s) AS e FROM f)""",
    "stream_tumbling": "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    # A file source without further batches closes no window after the last data, but an availableNow run ends with one batch without data, at the watermark of the data before it.
    "stream_sessions": """SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(b + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS "end", n FROM (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
        FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s) WHERE b + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
    "stream_deduplicated": "SELECT event_id, user_id, event_type FROM events",
}
