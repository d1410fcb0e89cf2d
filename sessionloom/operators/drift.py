"""Schemas that drift between files: a lifespan catalogue of columns, the changes it shows, one consistent table.

Every line is reduced to (name, kind, value) entries, whatever the file's format and however deep its objects; the catalogue holds, for each
producer, file and logical field, the spelling and type most lines used. Lag over the producer's files gives the
changes, islands of equal (spelling, type) the lifespans, and the alias table the casts into one table.

Cases. Lines redelivered under one (file_id, line_no) count once, a readable one first. A line is damaged, and
counts nowhere but in `damaged`, when its JSON doesn't parse to an object, when its values aren't as many as the
header's names, or when a piece has no name. Null or empty values are missing: they carry the field's name, not its
type. A file without readable lines has no field. Equal counts: the spelling (type) that sorts first. Null raw or
unknown file_id: damaged. Empty tables give empty results with the same columns. Unknown names stay in the
catalogue under their own simplified name. Further columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Simplified spellings (see `simple`) of each logical field of the ledger.
ALIASES: Mapping[str, Sequence[str]] = {
    "session_id": (),
    "date": (),
    "model": ("m",),
    "turns": ("turn_count",),
    "tokens": ("total_tokens",),
    "cost_usd": ("act", "actual_cost_usd"),
    "baseline_cost_usd": ("base",),
    "baseline_prompt_tokens": ("bpt", "baseline_prompt", "base_prompt_tok", "orig_prompt_tokens", "prompt_baseline", "prompt_tokens_baseline", "stats_baseline_prompt_tokens", "stats_bpt"),
    "prepared_prompt_tokens": ("ppt", "prepared_prompt"),
    "saved_prompt_tokens": ("spt", "saved_prompt"),
    "hot_hint_tokens_added": ("hht", "hint_added", "hint_tokens", "hints_tokens_added", "hot_hint_tok", "tokens_added_by_hot_hint", "stats_hht", "stats_hot_hint_tokens_added"),
    "reacquisition_tokens_avoided_estimate": ("rat", "avoided"),
    "reacquisition_cost_tokens": ("rct", "cost_of_reacquisition", "reacq_cost", "reacq_cost_tok", "reacquisition_cost", "refetch_cost_tokens", "stats_reacq_cost", "stats_rct"),
    "reacquisition_count": ("reacquisitions",),
    "hot_recent_hint_injected": (),
    "invisible_pressure": ("pressure",),
    "degradation_reason": (),
}
# Unit of each logical field, and the type it is cast to.
UNITS = {
    "session_id": "text", "date": "date", "model": "text", "turns": "count", "tokens": "tokens", "cost_usd": "usd",
    "baseline_cost_usd": "usd", "baseline_prompt_tokens": "tokens", "prepared_prompt_tokens": "tokens", "saved_prompt_tokens": "tokens",
    "hot_hint_tokens_added": "tokens", "reacquisition_tokens_avoided_estimate": "tokens", "reacquisition_cost_tokens": "tokens",
    "reacquisition_count": "count", "hot_recent_hint_injected": "count", "invisible_pressure": "count", "degradation_reason": "text",
}
TRACKED = ("baseline_prompt_tokens", "reacquisition_cost_tokens", "hot_hint_tokens_added")


def simple_name(name: str) -> str:
    """A name as lower-case words joined by underscores: camel case, blanks, hyphens and dots are equal."""
    return re.sub("[^a-z0-9]+", "_", re.sub("([a-z0-9])([A-Z])", r"\1_\2", name).lower())


class _Number(str):
    """A JSON number with a decimal point or exponent, as it is written."""


def _no_constant(name: str) -> None:
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_float=_Number, parse_constant=_no_constant)
_WHOLE, _DECIMAL = re.compile(r"[+-]?[0-9]+"), re.compile(r"[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")
Entry = tuple[str, str, str | None]


def _json_entries(raw: str) -> list[Entry] | None:
    """(dotted name, kind, value) of each leaf of a JSON object, at any depth; None when raw is no object."""
    try:
        doc = _DECODER.decode(raw)
    except (ValueError, RecursionError):
        return None
    if not isinstance(doc, dict):
        return None
    out: list[Entry] = []
    stack = [(k, v) for k, v in reversed(doc.items())]
    while stack:
        name, value = stack.pop()
        if isinstance(value, dict):
            stack.extend((f"{name}.{k}", v) for k, v in reversed(value.items()))
        elif value is None or value == "":
            out.append((name, "missing", value))
        elif isinstance(value, (bool, list)):
            out.append((name, "text", json.dumps(value, ensure_ascii=False, separators=(",", ":"))))
        else:
            out.append((name, "decimal" if isinstance(value, _Number) else "text" if isinstance(value, str) else "whole", str(value)))
    return out


def _plain_entry(name: str, value: str) -> Entry:
    value = value.strip(" ")
    return name.strip(" "), "missing" if not value else "whole" if _WHOLE.fullmatch(value) else "decimal" if _DECIMAL.fullmatch(value) else "text", value


def line_entries(fmt: str | None, header: str | None, raw: str | None) -> list[Entry] | None:
    """The entries of one line of a file, None when it is damaged."""
    if raw is None:
        return None
    if fmt == "jsonl":
        return _json_entries(raw)
    if fmt == "semi" and header is not None:
        names, values = header.split(";"), raw.split(";")
        return [_plain_entry(n, v) for n, v in zip(names, values)] if len(names) == len(values) else None
    if fmt == "kv":
        pieces = raw.split("|")
        return [_plain_entry(p[:at], p[at + 1 :]) for p in pieces if (at := p.index(":"))] if all(p.find(":") > 0 for p in pieces) else None
    return None


_ENTRY = pa.struct([("name", pa.string()), ("field", pa.string()), ("kind", pa.string()), ("value", pa.string())])


def entries(files: DataFrame, records: DataFrame, fields: Sequence[str] | None = None, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """One row per line: file_id, stream, file_seq, line_no, readable, entries array<struct<name, field, kind, value>>, raw.

    fields: the logical fields whose entries are wanted, so that no others are exchanged; None: all.
    """
    known = {a: field for field, more in aliases.items() for a in (field, *more)}
    wanted = None if fields is None else frozenset(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meant: dict[str, str] = {}
        for batch in batches:
            columns: list[list[str | None]] = [[], [], [], []]
            ends, ok = [0], []
            for fmt, header, raw in zip(*(batch.column(c).to_pylist() for c in ("fmt", "header", "raw"))):
                found = line_entries(fmt, header, raw)
                ok.append(found is not None)
                for name, kind, value in found or ():
                    if (field := meant.get(name)) is None:
                        if len(meant) > 100_000:  # names that are data don't fill the memory
                            meant.clear()
                        plain = simple_name(name)
                        field = meant[name] = known.get(plain, plain)
                    if wanted is None or field in wanted:
                        for held, x in zip(columns, (name, field, kind, value)):
                            held.append(x)
                ends.append(len(columns[0]))
            parts = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], fields=list(_ENTRY))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)
            kept = ("file_id", "line_no", "stream", "file_seq", "raw")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(ok), lists], names=[*kept, "readable", "entries"])

    joined = records.select("file_id", "line_no", "raw").join(files.select("file_id", "stream", "file_seq", "fmt", "header"), "file_id", "left")
    kinds = dict(joined.dtypes)
    kept = ", ".join(f"{c} {kinds[c]}" for c in ("file_id", "line_no", "stream", "file_seq", "raw"))
    lines = joined.mapInArrow(run, f"{kept}, readable boolean, entries array<struct<name: string, field: string, kind: string, value: string>>")
    once = lines.groupBy("file_id", "line_no").agg(F.max_by(F.struct("stream", "file_seq", "readable", "entries", "raw"), F.struct("readable", "raw")).alias("line"))
    return once.select("file_id", "line_no", "line.*")


def catalogue(files: DataFrame, records: DataFrame, fields: Sequence[str] | None = TRACKED) -> DataFrame:
    """For each file and logical field: lines that carry it, of how many readable, and the usual spelling and type.

    Lines are read once; counts are aggregated by (file, field, spelling, type) before anything is compared, so a hot
    stream or file costs one small row per spelling. fields None: every field.
    """
    line = F.array(F.struct(F.lit("").alias("name"), F.lit(None).cast("string").alias("field"), F.lit("line").alias("kind"), F.lit("").alias("value")))
    lines = entries(files, records, fields).filter("readable").select("file_id", F.inline(F.concat(line, "entries")))
    spelt = lines.groupBy("file_id", "field", "name", "kind").agg(F.count("*").alias("n"))
    own = lambda *more: W.partitionBy("file_id", *more)
    told = spelt.repartition("file_id").select(
        "*", F.max(F.when(F.col("kind") == "line", F.col("n"))).over(own()).alias("n_readable"), F.sum("n").over(own("field")).alias("n_carry"),
        F.sum("n").over(own("field", "name")).alias("n_name"), F.sum("n").over(own("field", "kind")).alias("n_kind"),
    )
    best = lambda c, n: F.struct(-F.col(n), F.col(c))
    typed = F.col("kind") != "missing"
    usual = told.filter("field is not null").groupBy("file_id", "field").agg(
        F.min_by("name", best("name", "n_name")).alias("name"), F.min_by("kind", F.when(typed, best("kind", "n_kind"))).alias("kind"), F.first("n_carry").alias("n_carry"), F.first("n_readable").alias("n_readable")
    )
    return usual.withColumn("present", 2 * F.col("n_carry") > F.col("n_readable"))


def _grid(files: DataFrame, found: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A row for each file and field, absent ones too, in the order of the stream."""
    every = files.select("file_id", "stream", "file_seq", F.explode(F.array(*map(F.lit, fields))).alias("field"))
    return every.join(found.filter("present").select("file_id", "field", "name", "kind", F.lit(True).alias("present")), ["file_id", "field"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def changes(files: DataFrame, records: DataFrame, fields: Sequence[str] = TRACKED) -> DataFrame:
    """(file_id, field, change): what each file adds, removes, renames or retypes against the file before it in its stream."""
    at = W.partitionBy("stream", "field").orderBy("file_seq", "file_id")
    seen = _grid(files, catalogue(files, records, fields), fields)
    seen = seen.select("file_id", "field", "present", "name", "kind", F.lag("present").over(at).alias("was"), F.lag("name").over(at).alias("old"), F.lag("kind").over(at).alias("old_kind"))
    both = F.col("present") & F.col("was")
    said = F.array_compact(
        F.array(
            F.when(F.col("present") & ~F.col("was"), "added"),
            F.when(~F.col("present") & F.col("was"), "removed"),
            F.when(both & (F.col("name") != F.col("old")), "renamed"),
            F.when(both & (F.col("kind") != F.col("old_kind")), "retyped"),
        )
    )
    return seen.filter("was is not null").select("file_id", "field", F.explode(said).alias("change"))


def lifespans(files: DataFrame, records: DataFrame, fields: Sequence[str] = TRACKED) -> DataFrame:
    """Islands: for each stream and field the spans of files in which spelling and type stayed the same.

    first_seq and last_seq are the span's start and ending; `open` spans reach the stream's last file.
    """
    whole, own = W.partitionBy("stream", "field").orderBy("file_seq", "file_id"), W.partitionBy("stream", "field", "present", "name", "kind").orderBy("file_seq", "file_id")
    seen = _grid(files, catalogue(files, records, fields), fields)
    seen = seen.withColumn("island", F.row_number().over(whole) - F.row_number().over(own)).withColumn("end", F.max("file_seq").over(W.partitionBy("stream", "field")))
    return (
        seen.filter("present")
        .groupBy("stream", "field", "name", "kind", "island")
        .agg(F.min("file_seq").alias("first_seq"), F.max("file_seq").alias("last_seq"), F.count("*").alias("n_files"), F.first("end").alias("end"))
        .select("stream", "field", "name", "kind", "first_seq", "last_seq", "n_files", (F.col("last_seq") == F.col("end")).alias("open"))
    )


def cast(value: Column, unit: str) -> Column:
    """A raw value as its unit's type; junk becomes null. `~12`, `12 tok`, `12tok` and `1,234` are numbers."""
    if unit == "text":
        return F.nullif(value, F.lit(""))
    if unit == "date":
        return value.try_cast("date")
    number = F.regexp_replace(F.regexp_replace(value, r"^~|\s*[a-zA-Z]*$", ""), r"(?<=\d),(?=\d{3})", "").try_cast("double")
    return number if unit == "usd" else F.round(number).try_cast("bigint")


def unified(files: DataFrame, records: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """One row per line with one typed column per logical field; unreadable lines keep their keys, `damaged` and raw.

    The casts are generated from the alias table. Names outside it are kept as text in the map `others`.
    """
    lines = entries(files, records, aliases=aliases)
    named = F.transform("entries", lambda e: F.struct(e["field"].alias("key"), F.when(e["kind"] != "missing", e["value"]).alias("value")))
    lines = lines.withColumn("named", named)
    first = lambda field: F.try_element_at(F.transform(F.filter("named", lambda e: e["key"] == field), lambda e: e["value"]), F.lit(1))
    columns = [cast(first(field), UNITS.get(field, "text")).alias(field) for field in aliases]
    others = F.filter("named", lambda e: ~e["key"].isin(*aliases) & e["value"].isNotNull())
    merged = F.aggregate(others, F.expr("cast(map() as map<string,string>)"), lambda m, e: F.when(F.map_contains_key(m, e["key"]), m).otherwise(F.map_concat(m, F.create_map(e["key"], e["value"]))))
    return lines.select("stream", "file_seq", "file_id", "line_no", *columns, merged.alias("others"), (~F.col("readable")).alias("damaged"), F.when(~F.col("readable"), F.col("raw")).alias("damaged_raw"))


def others(files: DataFrame, records: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """(stream, file_seq, file_id, line_no, pos, name, kind, value) of each value whose name isn't in the alias table, in the line's order."""
    each = entries(files, records, aliases=aliases).select("stream", "file_seq", "file_id", "line_no", F.posexplode("entries").alias("pos", "e"))
    return each.filter(~F.col("e.field").isin(*aliases)).select("stream", "file_seq", "file_id", "line_no", "pos", "e.name", "e.kind", "e.value")


def report(files: DataFrame, records: DataFrame, fields: Sequence[str] = TRACKED) -> dict[str, DataFrame]:
    """The consistent table, each change and each lifespan."""
    return {"table": unified(files, records), "changes": changes(files, records, fields), "lifespans": lifespans(files, records, fields)}
