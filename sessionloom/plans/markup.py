"""Queries of the markup and the formats around it: round trips and node tables over whole tables, with SQL forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import events as E
from ..operators import markup as M
from ..operators import unnest
from ..sources import table
from .message_sql import BLOCKS
from .sessions import _BASE
from .texts import _LINES

_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}


def mapped(df: DataFrame, schema: str, rows: Callable[..., list[tuple]]) -> DataFrame:
    """rows(*values) of each row of df, as rows of schema ("name type, ...")."""
    names, kinds = zip(*(x.split(" ") for x in schema.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [r for values in zip(*(c.to_pylist() for c in b.columns)) for r in rows(*values)]
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(columns, kinds)], names=list(names))

    return df.mapInArrow(run, schema)


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """Each record once, the delivery that parses first."""
    r = table(spark, d, "replay_records")
    return r.groupBy(F.col("record_id").cast("string").alias("rec_key")).agg(F.max_by("payload", F.struct(F.try_parse_json("payload").isNotNull(), "payload")).alias("payload"))


def _written(payload: str | None) -> str:
    """A conversation as markup: a node per message, its texts, calls and results below it."""
    tables = unnest.conversation(payload)
    if tables is None:
        return ""
    nodes = {m: M.Node("msg", attrs={"role": row.get("role"), "at": m}) for (m,), row in tables["messages"].items()}
    for at, row in sorted(tables["blocks"].items()):
        kind = row.get("type")
        if kind == "tool_use":
            attrs = {k[6:]: v for k, v in row.items() if k.startswith("input.") and not isinstance(v, (tuple, frozenset))}
            nodes[at[0]].children.append(M.Node("Tool", str(row.get("name")), attrs))
        elif kind == "tool_result":
            nodes[at[0]].children.append(M.Node("result", lines=(row["content"].split("\n") if isinstance(row.get("content"), str) else [])))
        elif kind == "text":
            nodes[at[0]].children.append(M.Node("say", lines=str(row.get("text") or "").split("\n")))
    return M.write(nodes.values())


def markup_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Conversations written as markup and parsed again in pieces: nodes by type, with the length of their text."""

    def rows(key: str, payload: str | None) -> list[tuple]:
        p, text, out = M.Parser(), _written(payload), []
        nodes = [n for k in range(0, len(text), 1000) for n in p.feed(text[k : k + 1000])] + p.flush()
        while nodes:
            n = nodes.pop(0)
            out.append((key, n.type, len(n.text)))
            nodes = n.children + nodes
        return out

    found = mapped(_payloads(spark, d), "rec_key string, type string, n_chars int", rows)
    return found.groupBy("rec_key", "type").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Payloads that are JSON objects, through the markup and back: whether they are equal."""
    found = mapped(_payloads(spark, d), "rec_key string, equal boolean, n_chars int", lambda k, p: [(k, *M.json_round(p))])
    return found.filter("equal is not null").select("rec_key", "equal")


def calls_in_text(spark: SparkSession, d: str) -> DataFrame:
    """The tool calls found in conversations written as markup, by name."""
    found = mapped(_payloads(spark, d), "rec_key string, name string, n_args int", lambda k, p: [(k, n, len({x.split(".")[0] for x in a})) for n, a in M.calls_in(_written(p))])
    return found.groupBy("rec_key", "name").agg(F.count("*").alias("n"), F.sum("n_args").alias("n_args"))


def table_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The workspaces of each language as a Markdown table, read back into rows."""
    names = ["workspace_id", "root", "team", "n_files"]
    w = table(spark, d, "workspaces").select("language", F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names]).alias("w"))
    per = w.groupBy("language").agg(F.sort_array(F.collect_list("w")).alias("rows"))

    def rows(language: str, values: list[dict[str, str]]) -> list[tuple]:
        text = M.to_table(names, [[v[c] for c in names] for v in values])
        return [(language, *(r[c] for c in names)) for r in M.from_table(text)]

    return mapped(per, "language string, workspace_id string, root string, team string, n_files string", rows)


def xml_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The inputs of tool calls as XML of one level, read back: members and characters by tool."""
    e = E.tool_events(table(spark, d, "stress_turns")).filter("tool is not null").select("tool", F.to_json("args").alias("args"))

    def rows(tool: str, args: str) -> list[tuple]:
        import json

        return [(tool, k, len(v)) for k, v in M.from_xml(M.to_xml(json.loads(args))).items()]

    return mapped(e, "tool string, member string, n_chars int", rows).groupBy("tool", "member").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


def skeleton_replay(spark: SparkSession, d: str) -> DataFrame:
    """Rereads of a file: the changes of its signatures, and whether they make the new skeleton of the old one."""
    e = E.tool_events(table(spark, d, "stress_turns")).filter("family = 'file_read' and raw is not null and path is not null")
    e = e.withColumn("old", F.lag("raw").over(W.partitionBy("session_id", "path").orderBy("turn", "pos"))).filter("old is not null").select("session_id", "path", "turn", "pos", "old", "raw")

    def rows(session: str, path: str, turn: int, pos: int, old: str, new: str) -> list[tuple]:
        a, b = M.skeleton(old), M.skeleton(new)
        changes = M.difference(a, b)
        n = lambda op: sum(c[0] == op for c in changes)
        return [(session, path, turn, pos, n("add"), n("remove"), n("update"), M.applied(a, changes) == b)]

    return mapped(e, "session_id string, path string, turn int, pos int, added int, removed int, updated int, replayed boolean", rows)


def input_schemas(spark: SparkSession, d: str) -> DataFrame:
    """Calls whose input lacks what its family needs, or has members the family doesn't know."""
    need = {"file_read": (("path", "file_path"), ("offset", "limit")), "search": (("query", "pattern"), ("path", "search_path")), "edit": (("path", "file_path"), ("old_string", "new_string", "content")), "command": (("command", "cmd"), ())}
    e = E.tool_events(table(spark, d, "stress_turns"))
    keys, out = F.map_keys("args"), []
    for family, (one_of, more) in need.items():
        known = F.array(*map(F.lit, one_of + more))
        out.append(F.when(F.col("family") == family, F.array_compact(F.array(F.when(~F.arrays_overlap(keys, F.array(*map(F.lit, one_of))), f"missing:{one_of[0]}"), F.when(F.size(F.array_except(keys, known)) > 0, F.concat(F.lit("unknown:"), F.array_join(F.array_sort(F.array_except(keys, known)), ",")))))))
    return e.select("session_id", "turn", "pos", "tool", F.explode(F.coalesce(*out)).alias("code"))


def markdown_parts(spark: SparkSession, d: str) -> DataFrame:
    """What documents hold of Markdown's parts: front matter, footnotes, headings with their place in the table of contents, tables, fences, links."""
    t = F.col("text")
    full = T.lines(t)
    n = lambda p: F.size(F.filter(full, lambda x: x.rlike(p)))
    heads = F.transform(F.filter(full, lambda x: x.rlike("^#{1,6} ")), lambda x: F.concat(F.repeat(F.lit(" "), F.length(F.regexp_extract(x, "^(#+)", 1)) - 1), F.regexp_replace(x, "^#+ +", "")))
    return table(spark, d, "documents").filter("text is not null").select(
        "doc_id", t.rlike(r"^---\n(?s:.*?)\n---(\n|$)").alias("front_matter"), n(r"^\[\^[^\]]+\]:").alias("n_footnotes"), F.size(heads).alias("n_headings"), T.digest(F.array_join(heads, "\n")).alias("toc"), n(r"^\|.*\|$").alias("n_rows"), n("^```").alias("n_fences"), F.regexp_count(t, F.lit(r"\[[^\]\n]+\]\([^)\n]+\)")).alias("n_links")
    )


QUERIES: dict[str, Any] = {f.__name__: f for f in (markup_nodes, json_roundtrip, calls_in_text, table_roundtrip, xml_roundtrip, skeleton_replay, input_schemas, markdown_parts)}
_SIG = "map_from_entries(list_transform(list_distinct(list_transform(regexp_extract_all({0}, '(?m)^[ \\t]*((?:def|class)[ \\t]+[A-Za-z_]\\w*)', 1), lambda v: regexp_replace(v, '[ \\t]+', ' ', 'g'))), lambda k: {{'k': k, 'v': trim(regexp_extract({0}, '(?m)^[ \\t]*' || regexp_replace(k, ' ', '[ \\\\t]+') || '\\b(.*)$', 1))}}))"
_N = lambda p: f"len(list_filter({_LINES}, lambda v: regexp_matches(v, '{p}')))::INT"
_NEEDS = " ".join(
    f"WHEN '{f}' THEN list_filter([CASE WHEN NOT list_has_any(k, {list(o)}) THEN 'missing:{o[0]}' END, CASE WHEN len(list_filter(k, lambda v: NOT list_contains({list(o + m)}, v))) > 0 THEN 'unknown:' || array_to_string(list_sort(list_filter(k, lambda v: NOT list_contains({list(o + m)}, v))), ',') END], lambda v: v IS NOT NULL)"
    for f, (o, m) in {"file_read": (("path", "file_path"), ("offset", "limit")), "search": (("query", "pattern"), ("path", "search_path")), "edit": (("path", "file_path"), ("old_string", "new_string", "content")), "command": (("command", "cmd"), ())}.items()
)
ORACLES = {
    "markup_nodes": f"""WITH {BLOCKS} SELECT rec_key, 'msg' AS type, count(*) AS n, 0 AS n_chars FROM m1 GROUP BY 1 UNION ALL SELECT rec_key, CASE type WHEN 'tool_use' THEN 'Tool' WHEN 'tool_result' THEN 'result' ELSE 'say' END, count(*), coalesce(sum(CASE WHEN type IN ('text', 'tool_result') THEN length(body) ELSE 0 END), 0)::BIGINT FROM bl WHERE type IN ('tool_use', 'tool_result', 'text') GROUP BY 1, 2""",
    "json_roundtrip": "SELECT record_id::VARCHAR AS rec_key, true AS equal FROM (SELECT record_id, payload FROM replay_records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY json_valid(payload) DESC, payload DESC) = 1) WHERE json_valid(payload) AND json_type(payload::json) = 'OBJECT'",
    "calls_in_text": f"WITH {BLOCKS}, k AS (SELECT rec_key, msg->'$.content' AS c FROM m1 WHERE role IS DISTINCT FROM 'tool_result' AND ct = 'ARRAY') SELECT rec_key, b->>'$.name' AS name, count(*) AS n, sum(len(json_keys(b, '$.input')))::BIGINT AS n_args FROM (SELECT rec_key, unnest(json_extract(c, '$[*]')) AS b FROM k) WHERE b->>'$.type' = 'tool_use' GROUP BY ALL",
    "table_roundtrip": "SELECT language, workspace_id, root, coalesce(team, '') AS team, n_files::VARCHAR AS n_files FROM workspaces",
    "xml_roundtrip": f"WITH {_BASE} SELECT tool, member, count(*) AS n, sum(length(v))::BIGINT AS n_chars FROM (SELECT tool, unnest(map_keys(args)) AS member, unnest(map_values(args)) AS v FROM x WHERE tool IS NOT NULL) WHERE v IS NOT NULL GROUP BY ALL",
    "skeleton_replay": f"""WITH {_BASE} SELECT session_id, path, turn, pos, len(list_filter(map_keys(b), lambda k: a[k] IS NULL))::INT AS added, len(list_filter(map_keys(a), lambda k: b[k] IS NULL))::INT AS removed, len(list_filter(map_keys(b), lambda k: a[k] IS NOT NULL AND a[k] <> b[k]))::INT AS updated, true AS replayed
        FROM (SELECT *, {_SIG.format('old')} AS a, {_SIG.format('raw')} AS b FROM (SELECT session_id, path, turn, pos, raw, lag(raw) OVER (PARTITION BY session_id, path ORDER BY turn, pos) AS old FROM x WHERE family = 'file_read' AND raw IS NOT NULL AND path IS NOT NULL) WHERE old IS NOT NULL)""",
    "input_schemas": f"WITH {_BASE} SELECT session_id, turn, pos, tool, unnest(CASE family {_NEEDS} ELSE [] END) AS code FROM (SELECT *, coalesce(map_keys(args), []) AS k FROM x)",
    "markdown_parts": f"""SELECT doc_id, regexp_matches(text, '^---\\n(?s:.*?)\\n---(\\n|$)') AS front_matter, {_N('^\\[\\^[^\\]]+\\]:')} AS n_footnotes, len(h)::INT AS n_headings, left(sha256(array_to_string(list_transform(h, lambda v: repeat(' ', length(regexp_extract(v, '^(#+)', 1)) - 1) || regexp_replace(v, '^#+ +', '')), chr(10))), 16) AS toc, {_N('^\\|.*\\|$')} AS n_rows, {_N('^```')} AS n_fences,
        len(regexp_extract_all(text, '\\[[^\\]\\n]+\\]\\([^)\\n]+\\)'))::INT AS n_links FROM (SELECT *, list_filter({_LINES}, lambda v: regexp_matches(v, '^#{{1,6}} ')) AS h FROM documents WHERE text IS NOT NULL)""",
}
