"""Deeply nested records as related flat tables.

Each record is parsed once, inside the task that reads it, into (path, ordinals, value) triples; triples whose paths
share a repeated ancestor and its ordinals are pivoted into one row of that ancestor's table. A row's key is the record
and the ordinals, its parent's key is the same without the last ordinal, so no identifiers have to be made and no
shuffle is needed: the only exchange is the one that lets redelivered records count once.

Cases. A record that parses in no way, or to neither messages nor a message, gives no rows (see `damaged`). A JSON
string that holds JSON text is parsed again. Content that is null, empty text or an empty array gives no block; a
message of role tool_result always gives one. Elements that are no objects still hold their position. Of several
calls with one id the last one before the result counts. Null record keys are never taken for redeliveries. Very
deep or long payloads are walked without recursion limits other than the JSON parser's (RecursionError: damaged).
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Triple = tuple[str, tuple[int, ...], Any]
EMPTY_LIST, EMPTY_OBJECT = (), frozenset()


def parse(text: str | None) -> Any:
    """The JSON value in text, unwrapped while it is itself a JSON text; None when it is damaged."""
    for _ in range(4):
        if not isinstance(text, str):
            return text
        try:
            text = json.loads(text)
        except (ValueError, RecursionError):
            return None
    return None


def triples(value: Any, path: str = "", at: tuple[int, ...] = ()) -> Iterator[Triple]:
    """Leaves in document order: dotted path with [] for each array step, the array positions, the value.

    Empty arrays and objects are leaves too, as () and frozenset().
    """
    stack = [(path, at, value)]
    while stack:
        p, o, v = stack.pop()
        if isinstance(v, dict):
            if v:
                stack.extend((f"{p}.{k}" if p else k, o, x) for k, x in reversed(v.items()))
            else:
                yield p, o, EMPTY_OBJECT
        elif isinstance(v, list):
            if v:
                p += "[]"
                stack.extend((p, (*o, i), v[i]) for i in range(len(v) - 1, -1, -1))
            else:
                yield p, o, EMPTY_LIST
        else:
            yield p, o, v


def above(path: str) -> list[tuple[str, str]]:
    """The repeated ancestors of a path, each with the path relative to it: every prefix that ends in an array step."""
    out, at = [], path.find("[]")
    while at >= 0:
        out.append((path[: at + 2], path[at + 2 :].lstrip(".")))
        at = path.find("[]", at + 2)
    return out


def grouped(found: Iterable[Triple]) -> defaultdict[str, dict[tuple[int, ...], dict[str, Any]]]:
    """Triples pivoted by the repeated ancestors that the data have: ancestor -> ordinals -> {relative path: value}.

    A triple makes a row of each ancestor above it, with the ancestor's share of the ordinals; its value goes to the
    deepest one, so what is below a further array is left to the table of that array.
    """
    tables: defaultdict[str, dict[tuple[int, ...], dict[str, Any]]] = defaultdict(dict)
    where: dict[str, list[tuple[str, str]]] = {}
    for path, at, value in found:
        if (own := where.get(path)) is None:
            own = where[path] = above(path)
        for depth, (a, rest) in enumerate(own, 1):
            row = tables[a].setdefault(at[:depth], {})
            if depth == len(own):
                row[rest] = value
    return tables


# ---- the shape of a conversation -------------------------------------------------------------------------------

MESSAGES, CONTENT, ITEMS = "messages[]", "messages[].content[]", "messages[].content[].content[]"


def document(payload: str | None) -> dict[str, list] | None:
    """The messages of one payload, a bare message as the only one; None when it is damaged."""
    doc = parse(payload)
    if not isinstance(doc, dict):
        return None
    if isinstance(doc.get("messages"), list):
        return {"messages": doc["messages"]}
    return {"messages": [doc]} if "role" in doc or "content" in doc else None


def conversation(payload: str | None) -> dict[str, dict[tuple[int, ...], dict[str, Any]]] | None:
    """messages, blocks and items of one payload as pivoted tables, None when it is damaged."""
    doc = document(payload)
    if doc is None:
        return None
    found = grouped(triples(doc))
    blocks, items = {}, dict(found[ITEMS])
    by_message: dict[int, list[tuple[int, ...]]] = {}
    for at in found[CONTENT]:
        by_message.setdefault(at[0], []).append(at)
    for (m,), row in found[MESSAGES].items():
        content = row.get("content")
        if row.get("role") == "tool_result":
            blocks[m, 0] = {"type": "tool_result", "tool_use_id": row.get("tool_use_id"), "content": content}
            for at in by_message.get(m, ()):
                items[m, 0, at[1]] = found[CONTENT][at]
        elif isinstance(content, str) and content:
            blocks[m, 0] = {"type": "text", "text": content}
        else:
            for at in by_message.get(m, ()):
                blocks[at] = found[CONTENT][at]
    items = {at: row for at, row in items.items() if blocks.get(at[:2], {}).get("type") == "tool_result"}
    return {"messages": found[MESSAGES], "blocks": blocks, "items": items}


def _text(value: Any) -> str | None:
    """A leaf as text: JSON's form for what is no string, null for empty containers."""
    if value is None or value is EMPTY_LIST or value == EMPTY_OBJECT:
        return None
    return value if isinstance(value, str) else json.dumps(value)


def linked(blocks: dict[tuple[int, ...], dict[str, Any]]) -> dict[tuple[int, ...], tuple[int, int]]:
    """For each tool_result block the last tool_use with its id that stands earlier in the record, else (-1, -1)."""
    last: dict[Any, tuple[int, int]] = {}
    out = {}
    for at in sorted(blocks):
        row = blocks[at]
        if row.get("type") == "tool_use" and row.get("id") is not None:
            last[row["id"]] = at
        elif row.get("type") == "tool_result":
            out[at] = last.get(row.get("tool_use_id"), (-1, -1)) if row.get("tool_use_id") is not None else (-1, -1)
    return out


def result_text(row: dict[str, Any], items: Iterable[dict[str, Any]]) -> str | None:
    """A tool result's content: its string, or the text of its text items joined by newlines; null when it has neither."""
    content = row.get("content")
    if isinstance(content, str):
        return content
    if content is EMPTY_LIST:
        return ""
    parts = [x["text"] for x in items if x.get("type") == "text" and isinstance(x.get("text"), str)]
    return "\n".join(parts) if parts else None


_BLOCK = "msg_pos int, block_pos int, sub_pos int, call_msg_pos int, call_block_pos int, role string, type string, id string, tool_use_id string, name string, body string"
_BLOCK_FIELDS = ("msg_pos", "block_pos", "sub_pos", "call_msg_pos", "call_block_pos", "role", "type", "id", "tool_use_id", "name", "body")
_MESSAGE = "msg_pos int, role string, tool_use_id string, content_kind string, n_blocks int"
_RESULT = "msg_pos int, block_pos int, call_msg_pos int, call_block_pos int, tool_use_id string, content string"
_MEMBER = "msg_pos int, block_pos int, sub_pos int, member string, positions array<int>, kind string, value string"
_ARROW = {"int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
_BODY = ("text", "thinking", "content", "")


def _kind(value: Any) -> str:
    """JSON's name of a value's type."""
    if isinstance(value, (str, bool)) or value is None:
        return "string" if isinstance(value, str) else "null" if value is None else "boolean"
    return "object" if isinstance(value, (dict, frozenset)) else "array" if isinstance(value, (list, tuple)) else "number"


def _message_rows(payload: str | None) -> list[tuple] | None:
    tables, doc = conversation(payload), document(payload)
    if tables is None or doc is None:
        return None
    n: dict[int, int] = {}
    for at in tables["blocks"]:
        n[at[0]] = n.get(at[0], 0) + 1
    raw = [x if isinstance(x, dict) else {} for x in doc["messages"]]
    return [(m, _text(row.get("role")), _text(row.get("tool_use_id")), _kind(raw[m]["content"]) if "content" in raw[m] else None, n.get(m, 0)) for (m,), row in tables["messages"].items()]


def _result_rows(payload: str | None) -> list[tuple] | None:
    tables = conversation(payload)
    if tables is None:
        return None
    items: dict[tuple[int, ...], list[dict[str, Any]]] = {}
    for at, row in sorted(tables["items"].items()):
        items.setdefault(at[:2], []).append(row)
    return [(*at, *call, _text(tables["blocks"][at].get("tool_use_id")), result_text(tables["blocks"][at], items.get(at, ()))) for at, call in linked(tables["blocks"]).items()]


def _member_rows(payload: str | None) -> list[tuple] | None:
    """The leaves of messages, blocks and items that have no column in their tables."""
    doc = document(payload)
    if doc is None:
        return None
    out: list[tuple] = []

    def leaves(at: tuple[int, int, int], value: Any, columns: Iterable[str]) -> None:
        if isinstance(value, dict):
            if not (value := {k: v for k, v in value.items() if k not in columns}):
                return
        elif not isinstance(value, list):
            return
        out.extend((*at, path, list(o), _kind(v), _text(v)) for path, o, v in triples(value))

    def element(at: tuple[int, int, int], value: Any) -> None:
        columns = {"type", "id", "tool_use_id", "name"}
        if isinstance(value, dict):
            columns = {k for k in columns if not isinstance(value.get(k), (dict, list))}
            body = next((k for k in _BODY if k in value and (not isinstance(value[k], (dict, list)) or not value[k])), None)
            result = value.get("type") == "tool_result" and at[2] < 0 and isinstance(value.get("content"), list)
            leaves(at, value, columns | ({body} if body is not None else set()) | ({"content"} if result else set()))
            for i, item in enumerate(value["content"] if result else ()):
                element((at[0], at[1], i), item)
        else:
            leaves(at, value, ())

    for m, message in enumerate(doc["messages"]):
        content = message.get("content") if isinstance(message, dict) else None
        own = {k for k in ("role", "tool_use_id") if isinstance(message, dict) and not isinstance(message.get(k), (dict, list))}
        leaves((m, -1, -1), message, own | (set() if isinstance(content, (dict, bool, int, float)) else {"content"}))
        for b, block in enumerate(content if isinstance(content, list) else ()):
            element((m, 0, b) if message.get("role") == "tool_result" else (m, b, -1), block)
    return out


def _rows(payload: str | None, bodies: bool, messages: bool = False) -> list[tuple] | None:
    tables = conversation(payload)
    if tables is None:
        return None
    calls = linked(tables["blocks"])
    roles = {m: _text(row.get("role")) for (m,), row in tables["messages"].items()}
    out = [(m, -1, -1, -1, -1, role, None, None, None, None, None) for m, role in roles.items()] if messages else []
    for source, table in (("blocks", tables["blocks"]), ("items", tables["items"])):
        for at, row in table.items():
            call = calls.get(at[:2], (-1, -1))
            body = next((_text(row[k]) for k in _BODY if k in row), None) if bodies else None
            out.append((at[0], at[1], at[2] if source == "items" else -1, *call, roles.get(at[0]), *(_text(row.get(k)) for k in ("type", "id", "tool_use_id", "name")), body))
    return out


def _once(records: DataFrame, key: str, payload: str, rows: Callable[[str | None], list[tuple] | None], schema: str) -> DataFrame:
    """rec_key and the columns of schema: rows(payload) of each record that parses.

    Redelivered records count once: the tasks that parse send one row per delivery, of which one per key is kept.
    """
    names, types = zip(*(x.split() for x in schema.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = [], []
            for k, p in zip(batch.column(0), batch.column(1).to_pylist()):
                if (found := rows(p)) is not None:
                    keys.append(k.as_py())
                    lists.append(found)
            flat = [x for r in lists for x in r]
            columns = list(zip(*flat)) if flat else [[] for _ in names]
            struct = pa.StructArray.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(columns, types)], names=list(names))
            ends = [0]
            for r in lists:
                ends.append(ends[-1] + len(r))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)], names=["rec_key", "rows"])

    source = records.select(F.col(key).cast("string").alias("rec_key"), F.col(payload).cast("string").alias("payload"))
    parsed = source.mapInArrow(run, f"rec_key string, rows array<struct<{', '.join(f'{n}: {t}' for n, t in zip(names, types))}>>")
    once = parsed.withColumn("own", F.when(F.col("rec_key").isNull(), F.monotonically_increasing_id())).dropDuplicates(["rec_key", "own"])
    return once.select("rec_key", F.inline("rows"))


def payload_blocks(records: DataFrame, key: str = "record_id", payload: str = "payload", bodies: bool = True, messages: bool = False) -> DataFrame:
    """One row per block and result item of each record that parses: rec_key and the columns of _BLOCK.

    bodies False leaves the texts out, and so out of the exchange. messages True adds a row of block_pos -1 for each
    message, so that those without blocks have one too.
    """
    return _once(records, key, payload, lambda p: _rows(p, bodies, messages), _BLOCK)


def payload_messages(records: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """One row per message, with or without blocks: rec_key and the columns of _MESSAGE."""
    return _once(records, key, payload, _message_rows, _MESSAGE)


def payload_contents(records: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """One row per tool result with its call and whole content: rec_key and the columns of _RESULT."""
    return _once(records, key, payload, _result_rows, _RESULT)


def payload_members(records: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """One row per leaf without a column of its own, such as input.path: rec_key and the columns of _MEMBER.

    block_pos -1 is a member of the message, sub_pos -1 one of the block; member is the dotted path with [] for each
    array step, positions are those in the arrays.
    """
    return _once(records, key, payload, _member_rows, _MEMBER)


def turn_positions(turns: DataFrame) -> DataFrame:
    """The blocks of recorded turns, results linked to their calls: rec_key and the position columns of _BLOCK.

    A turn is taken as a record of two messages, its tool_uses and its tool_results, and goes the way of the payloads:
    triples, grouped by their repeated ancestors. Only ids are read; redelivered turns, (session_id, turn_index), count
    once. A null id is linked to nothing.
    """
    ids = turns.select("session_id", "turn_index", F.col("tool_uses.id").alias("uses"), F.col("tool_results.tool_use_id").alias("results")).dropDuplicates(["session_id", "turn_index"])
    none = F.lit(None).cast("string")
    message = lambda role, kind, column, call: F.struct(F.lit(role).alias("role"), F.transform(column, lambda x: F.struct(F.lit(kind).alias("type"), (x if call else none).alias("id"), (none if call else x).alias("tool_use_id"))).alias("content"))
    record = F.struct(F.array(message("assistant", "tool_use", "uses", True), message("user", "tool_result", "results", False)).alias("messages"))
    names = _BLOCK.split(", ")[:5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [_positions(doc) for doc in batch.column(1).to_pylist()]
            columns = list(zip(*(x for rows in lists for x in rows))) or [()] * len(names)
            keys = batch.column(0).take(pa.array([i for i, rows in enumerate(lists) for _ in rows], pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, pa.int32()) for c in columns)], names=["rec_key", *(n.split(" ")[0] for n in names)])

    return ids.select(_turn_key(), record.alias("record")).mapInArrow(run, ", ".join(["rec_key string", *names]))


def _positions(doc: dict[str, Any]) -> list[tuple[int, ...]]:
    tables = conversation(doc) or {"blocks": {}}
    calls = linked(tables["blocks"])
    return [(*at, -1, *calls.get(at, (-1, -1))) for at in tables["blocks"]]


def turn_blocks(turns: DataFrame, bodies: bool = False) -> DataFrame:
    """The blocks of recorded turns: tool_uses as msg_pos 0, tool_results as msg_pos 1, results linked to their calls.

    Without bodies these are `turn_positions`; with them all columns of _BLOCK, for which the typed columns are
    flattened by generators. Redelivered turns, (session_id, turn_index), count once. A null id is linked to nothing.
    """
    if not bodies:
        return turn_positions(turns)
    ids = turns.select("session_id", "turn_index", F.col("tool_uses.id").alias("uses"), F.col("tool_results.tool_use_id").alias("results"), "tool_uses", "tool_results")
    once = ids.dropDuplicates(["session_id", "turn_index"])
    none, nothing, no_ids = F.lit(-1), F.lit(None).cast("int"), F.array().cast("array<string>")
    last = lambda x: F.size("uses") - F.array_position(F.reverse("uses"), x).cast("int")
    text = lambda x: (F.lit(None) if x is None else x).cast("string")
    more = lambda m, b: [text(x).alias(n) for n, x in zip(_BLOCK_FIELDS[5:], _turn_columns(m, b))]
    row = lambda m, b, call: F.struct(F.lit(m).alias("msg_pos"), b.cast("int").alias("block_pos"), none.alias("sub_pos"), F.when(call.isNull(), -1).otherwise(0).alias("call_msg_pos"), F.coalesce(call, none).alias("call_block_pos"), *more(m, b))
    uses = F.transform(F.coalesce("uses", no_ids), lambda _, i: row(0, i, nothing))
    results = F.transform(F.coalesce("results", no_ids), lambda x, i: row(1, i, F.when(F.array_contains(F.coalesce("uses", no_ids), x), last(x))))
    return once.select(_turn_key(), F.inline(F.concat(uses, results)))


def path_catalogue(records: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """Every path of the payloads: its table, the repeated ancestor, its name there, its values' kinds and in how many records and rows it stands."""

    def rows(text: str | None) -> list[tuple] | None:
        doc = parse(text)
        if not isinstance(doc, (dict, list)):
            return None
        n: Counter = Counter()
        for path, _, value in triples(doc):
            a = above(path)
            n[(a[-1] if a else ("", path)) + (_kind(value),)] += 1
        return [(*k, c) for k, c in n.items()]

    found = _once(records, key, payload, rows, "ancestor string, member string, kind string, n int")
    return found.groupBy("ancestor", "member", "kind").agg(F.count("*").alias("n_records"), F.sum("n").alias("n_rows"))


def _turn_key() -> Column:
    return F.concat_ws("/", "session_id", F.col("turn_index").cast("string")).alias("rec_key")


def _turn_columns(message: int, block: Column) -> tuple[Column | None, ...]:
    """role, type, id, tool_use_id, name and body of one use or result."""
    e = F.get("tool_results" if message else "tool_uses", block)
    if message:
        return F.lit("user"), F.lit("tool_result"), None, e["tool_use_id"], None, e["content"]
    return F.lit("assistant"), e["type"], e["id"], None, e["name"], None


def turn_messages(turns: DataFrame) -> DataFrame:
    """The two messages of each turn, its uses and its results, also without any: rec_key and the columns of _MESSAGE."""
    sizes = turns.select("session_id", "turn_index", F.size("tool_uses").alias("u"), F.size("tool_results").alias("r")).dropDuplicates(["session_id", "turn_index"])
    one = lambda m, role, n: F.struct(F.lit(m).alias("msg_pos"), F.lit(role).alias("role"), F.lit(None).cast("string").alias("tool_use_id"), F.when(F.col(n) >= 0, "array").otherwise("null").alias("content_kind"), F.greatest(n, F.lit(0)).alias("n_blocks"))
    return sizes.select(_turn_key(), F.inline(F.array(one(0, "assistant", "u"), one(1, "user", "r"))))


def turn_members(turns: DataFrame) -> DataFrame:
    """One row per member of each tool use's input, an empty input as one of kind object: rec_key and the columns of _MEMBER."""
    once = turns.select("session_id", "turn_index", "tool_uses").dropDuplicates(["session_id", "turn_index"])
    uses = once.select(_turn_key(), F.posexplode("tool_uses").alias("block_pos", "e")).select("rec_key", "block_pos", F.col("e.input").alias("input"))
    member = lambda name, kind, value: F.struct(name.alias("member"), kind.alias("kind"), value.cast("string").alias("value"))
    each = F.transform(F.map_entries("input"), lambda x: member(F.concat(F.lit("input."), x["key"]), F.when(x["value"].isNull(), "null").otherwise("string"), x["value"]))
    rows = uses.select("rec_key", "block_pos", F.inline(F.when(F.size("input") == 0, F.array(member(F.lit("input"), F.lit("object"), F.lit(None)))).otherwise(each)))
    return rows.select("rec_key", F.lit(0).alias("msg_pos"), "block_pos", F.lit(-1).alias("sub_pos"), "member", F.array().cast("array<int>").alias("positions"), "kind", "value")


def damaged(records: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """Keys and texts of the records that no delivery of which could be parsed."""

    @F.pandas_udf("boolean")
    def ok(texts):  # type: ignore[no-untyped-def]
        return texts.map(lambda t: conversation(t) is not None)

    state = records.select(F.col(key).alias(key), F.col(payload).alias(payload), ok(F.col(payload)).alias("ok"))
    return state.groupBy(key).agg(F.max("ok").alias("ok"), F.min(payload).alias(payload)).filter("not ok").drop("ok")


def payload_results(records: DataFrame, payload: str = "payload") -> DataFrame:
    """(tool_use_id, content) of each tool result in payloads that parse; redeliveries are not merged here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for p in batch.column(0).to_pylist():
                tables = conversation(p)
                if tables is None:
                    continue
                items: dict[tuple[int, ...], list[dict[str, Any]]] = {}
                for at, row in sorted(tables["items"].items()):
                    items.setdefault(at[:2], []).append(row)
                for at, row in tables["blocks"].items():
                    if row.get("type") == "tool_result" and row.get("tool_use_id") is not None:
                        ids.append(_text(row["tool_use_id"]))
                        texts.append(result_text(row, items.get(at, ())))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["tool_use_id", "content"])

    return records.select(F.col(payload).cast("string").alias("payload")).mapInArrow(run, "tool_use_id string, content string")


def tool_results(turns: DataFrame, records: DataFrame) -> DataFrame:
    """(tool_use_id, content) of every tool result of both tables. Redeliveries are equal rows here; ids that are null are left out."""
    recorded = turns.select(F.inline("tool_results")).select("tool_use_id", "content").filter("tool_use_id is not null")
    return recorded.unionByName(payload_results(records))
