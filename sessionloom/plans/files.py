"""Round trips through files and line formats, each against SQL over the tables they were written from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import ledger, unnest
from ..sources import readers as R
from ..sources import table
from .ledger import _LATEST, _TABLE, DRIFT, _lines
from .message_sql import BLOCKS
from .sessions import _BASE, _SPLIT

META = "model string, provider string, fixture_kind string, min_savings_pct double, max_repeat_file_read int, usage_weight double"


def replay_files(spark: SparkSession, d: str) -> DataFrame:
    """The records written as JSONL by fixture and read again: lines by shape, with their sidecar's model."""
    place, records = R.scratch(spark, "replay"), table(spark, d, "replay_records").select("fixture", F.regexp_replace("payload", "[\r\n]+", " ").alias("line"))
    R.write_replay(records, table(spark, d, "replay_meta"), place)
    lines = R.replay_lines(spark, f"{place}/records").withColumn("shape", R.record_shape(F.col("line")))
    return lines.groupBy("fixture", "shape").agg(F.count("*").alias("n")).join(R.replay_meta(spark, f"{place}/meta", META).select("fixture", "model", "min_savings_pct"), "fixture", "left")


def model_stats(spark: SparkSession, d: str) -> DataFrame:
    """Totals by stream and model as lines of statistics, parsed again."""
    s = ledger.latest(_lines(spark, d)).filter("model is not null").groupBy("stream", "model").agg(*[F.sum(c).alias(c) for c in ("tokens", "turns", "hot_hint_tokens_added", "reacquisition_cost_tokens")])
    line = R.model_line(F.col("model"), {c: F.col(c) for c in ("tokens", "turns")}, {"hint": F.col("hot_hint_tokens_added"), "reacquired": F.col("reacquisition_cost_tokens")})
    p = s.select("stream", R.parse_model_line(line).alias("p"))
    at = lambda m, k: F.element_at(f"p.{m}", k)
    return p.select("stream", "p.model", at("counts", "tokens").alias("tokens"), at("counts", "turns").alias("turns"), at("breakdown", "hint").alias("hint"), at("breakdown", "reacquired").alias("reacquired"))


def ledger_files(spark: SparkSession, d: str) -> DataFrame:
    """The two-section ledger of each stream, written as text and read again: its totals and the fields of its log."""
    s = ledger.latest(_lines(spark, d))
    totals = s.groupBy("stream").agg(F.count("*").alias("n_sessions"), F.sum("tokens").alias("tokens"))
    place = R.scratch(spark, "ledger")
    R.ledger_text(totals, s, "stream", ["date", "session_id", "turns", "tokens"]).write.mode("overwrite").parquet(place)
    return R.parse_ledger(spark.read.parquet(place), "stream").groupBy("stream", "section", "name").agg(F.count("*").alias("n"), F.count_if(F.col("value") != "").alias("n_full"), F.sum(F.col("value").try_cast("bigint")).alias("total"))


def sse_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The assistant's texts as streams of server events, decoded again."""
    b = unnest.payload_blocks(table(spark, d, "replay_records")).filter("role = 'assistant' and sub_pos = -1 and type in ('text', 'thinking') and body is not null")
    m = b.groupBy(F.concat_ws("/", "rec_key", "msg_pos").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("block_pos", "type", "body"))), lambda x: F.struct(x["type"].alias("type"), x["body"].alias("text"))).alias("blocks")).withColumn("model", F.lit("m"))
    got = R.from_sse(R.to_sse(m))
    return got.select("id", "model", "index", "type", F.length("text").alias("n_chars"), F.substring(F.sha2("text", 256), 1, 16).alias("digest"))


def log_counters(spark: SparkSession, d: str) -> DataFrame:
    return R.log_counters(E.tool_events(table(spark, d, "stress_turns")).filter("raw is not null"))


def saved_state(spark: SparkSession, d: str) -> DataFrame:
    """What of the results' digests, saved as a snapshot at the last turn, hasn't expired a day later than each session's last turn less a day."""
    e = E.tool_events(table(spark, d, "stress_turns")).filter("raw is not null and path is not null")
    state = e.groupBy("session_id", F.col("path").alias("key")).agg(F.max(F.struct("recorded_at", "turn", "pos", F.substring(F.sha2("raw", 256), 1, 16).alias("h"))).alias("x")).select("session_id", "key", F.col("x.h").alias("value"), F.col("x.recorded_at").alias("at"))
    place = R.scratch(spark, "state")
    R.save_state(state, place)
    newest = spark.read.parquet(place).agg(F.max("at")).first()[0]
    return R.load_state(spark, place, F.lit(newest), 86_400).select("session_id", "key", "value")


def file_overview(spark: SparkSession, d: str) -> DataFrame:
    """The structure of the files as they were last read: lines, definitions, imports, comments and the deepest indentation; the large ones marked."""
    e = E.tool_events(table(spark, d, "stress_turns")).filter("family = 'file_read' and raw is not null and path is not null")
    last = e.groupBy("session_id", "path").agg(F.max_by("raw", F.struct("turn", "pos")).alias("text"))
    from ..functions import text as T

    full = T.lines(F.col("text"))
    n = lambda p: F.size(F.filter(full, lambda x: x.rlike(p)))
    deep = F.coalesce(F.array_max(F.transform(F.filter(full, lambda x: F.trim(x) != ""), lambda x: F.length(F.regexp_extract(x, "^( *)", 1)))), F.lit(0))
    return last.select("session_id", "path", F.size(full).alias("n_lines"), n(r"^\s*(async )?def ").alias("n_functions"), n(r"^\s*class ").alias("n_classes"), n(r"^\s*(import|from) ").alias("n_imports"), n(r"^\s*#").alias("n_comments"), deep.alias("deepest"), (F.size(full) > 500).alias("large"))


def synthetic_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Generated sessions of four kinds of steps, by arithmetic on their numbers: 50 sessions for each workspace."""
    n = table(spark, d, "workspaces").count() * 50
    i = spark.range(n).select(F.col("id").alias("session"), (F.col("id") * 7919 % 13 + 3).alias("n_turns"))
    t = i.select("session", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_turns") - 1)).alias("turn"))
    k = (F.col("session") * 31 + F.col("turn") * 17) % 4
    op = F.element_at(F.array(*map(F.lit, ("read", "search", "edit", "shell"))), (k + 1).cast("int"))
    return t.select("session", "turn", op.alias("op"), F.concat(F.lit("src/m"), (F.col("session") % 7).cast("string"), F.lit("/f"), (F.col("turn") * 5 % 11).cast("string"), F.lit(".py")).alias("path")).groupBy("op", "path").agg(F.count("*").alias("n"), F.count_distinct("session").alias("n_sessions"))


QUERIES = {f.__name__: f for f in (replay_files, model_stats, ledger_files, sse_blocks, log_counters, saved_state, file_overview, synthetic_sessions)}


def _ledger(body: str) -> str:
    return f"WITH {', '.join([DRIFT, _TABLE, _LATEST])} {body}"


def _sql(body: str) -> str:
    return f"WITH {_BASE} {body}"


_F = lambda p: f"len(list_filter(l, lambda v: regexp_matches(v, '{p}')))::INT"
ORACLES = {
    "replay_files": """SELECT fixture, shape, n, model, min_savings_pct FROM (SELECT fixture, CASE WHEN NOT json_valid(p) THEN 'damaged' WHEN json_type(p, '$.messages') = 'ARRAY' THEN 'messages' WHEN json_type(p::json) = 'OBJECT' AND (json_exists(p, '$.role') OR json_exists(p, '$.content')) THEN 'message' ELSE 'damaged' END AS shape, count(*) AS n
        FROM (SELECT fixture, CASE WHEN json_valid(payload) AND json_type(payload::json) = 'VARCHAR' THEN payload::json->>'$' ELSE payload END AS p FROM replay_records WHERE trim(payload, ' ') <> '') GROUP BY ALL) LEFT JOIN (SELECT fixture, model, min_savings_pct FROM replay_meta) USING (fixture)""",
    "model_stats": _ledger("SELECT stream, model, sum(tokens)::BIGINT AS tokens, sum(turns)::BIGINT AS turns, sum(hot_hint_tokens_added)::BIGINT AS hint, sum(reacquisition_cost_tokens)::BIGINT AS reacquired FROM la WHERE model IS NOT NULL GROUP BY ALL"),
    "ledger_files": _ledger(
        """SELECT stream, section, name, count(*) AS n, count(*) FILTER (value <> '') AS n_full, sum(try_cast(value AS BIGINT))::BIGINT AS total FROM (SELECT stream, 'lifetime_savings' AS section, 'n_sessions' AS name, count(*)::VARCHAR AS value FROM la GROUP BY 1 UNION ALL SELECT stream, 'lifetime_savings', 'tokens', coalesce(sum(tokens)::BIGINT::VARCHAR, '') FROM la GROUP BY 1
        UNION ALL SELECT stream, 'per_session_log', unnest(['0', '1', '2', '3']), unnest([coalesce(date::VARCHAR, ''), session_id, coalesce(turns::VARCHAR, ''), coalesce(tokens::VARCHAR, '')]) FROM la) GROUP BY ALL"""
    ),
    "sse_blocks": f"""WITH {BLOCKS} SELECT rec_key || '/' || msg_pos AS id, 'm' AS model, (row_number() OVER (PARTITION BY rec_key, msg_pos ORDER BY block_pos) - 1)::INT AS index, type, length(body)::INT AS n_chars, left(sha256(body), 16) AS digest FROM b0 WHERE role = 'assistant' AND type IN ('text', 'thinking') AND body IS NOT NULL""",
    "log_counters": _sql("SELECT string_split(p, '=')[1] AS name, count(*) AS n, sum(string_split(p, '=')[2]::BIGINT)::BIGINT AS total, min(string_split(p, '=')[2]::BIGINT) AS least, max(string_split(p, '=')[2]::BIGINT) AS most FROM (SELECT unnest(regexp_extract_all(raw, '\\b([A-Za-z_]\\w*=[0-9]+)\\b', 1)) AS p FROM x WHERE raw IS NOT NULL) GROUP BY 1"),
    "saved_state": _sql(
        """SELECT session_id, key, value FROM (SELECT session_id, path AS key, (max((recorded_at, turn, pos, left(sha256(raw), 16))))[4] AS value, max(recorded_at) AS r FROM (SELECT x.*, t.recorded_at FROM x JOIN t ON t.session_id = x.session_id AND t.turn_index = x.turn) WHERE raw IS NOT NULL AND path IS NOT NULL GROUP BY ALL)
        WHERE floor(epoch((SELECT max(recorded_at) FROM t JOIN (SELECT DISTINCT session_id, turn FROM x WHERE raw IS NOT NULL AND path IS NOT NULL) k ON k.session_id = t.session_id AND k.turn = t.turn_index))) - floor(epoch(r)) <= 86400"""
    ),
    "file_overview": _sql(
        f"""SELECT session_id, path, len(l)::INT AS n_lines, {_F('^\\s*(async )?def ')} AS n_functions, {_F('^\\s*class ')} AS n_classes, {_F('^\\s*(import|from) ')} AS n_imports, {_F('^\\s*#')} AS n_comments, coalesce(list_max(list_transform(list_filter(l, lambda v: trim(v, ' ') <> ''), lambda v: length(regexp_extract(v, '^( *)', 1)))), 0)::INT AS deepest, len(l) > 500 AS large
        FROM (SELECT session_id, path, {_SPLIT} AS l FROM (SELECT session_id, path, arg_max(raw, (turn, pos)) AS raw FROM x WHERE family = 'file_read' AND raw IS NOT NULL AND path IS NOT NULL GROUP BY ALL))"""
    ),
    "synthetic_sessions": """SELECT op, path, count(*) AS n, count(DISTINCT session) AS n_sessions FROM (SELECT session, turn, ['read', 'search', 'edit', 'shell'][((session * 31 + turn * 17) % 4) + 1] AS op, 'src/m' || session % 7 || '/f' || (turn * 5 % 11) || '.py' AS path
        FROM (SELECT session, unnest(range(session * 7919 % 13 + 3)) AS turn FROM (SELECT unnest(range((SELECT count(*) FROM workspaces) * 50)) AS session))) GROUP BY ALL""",
}
