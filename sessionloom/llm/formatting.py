"""Duplicates hidden by formatting: contents with the same letters and digits, JSON members in any order.

A content's fingerprint is a sequence hash over its plain stretches and JSON objects; an object's own hash is the sum,
modulo 2**128, of the hashes of its (name, value) pairs, so members commute and nothing is sorted. Grouping is by
fingerprint only: the exchange carries 16-byte hashes and ids, partially aggregated, so a group of copies may hold any
share of the rows. Contents that differ in bytes are then verified once per group and form: their fields are counted
as a multiset and compared with those of the group's first form.

A content whose quotes were changed no longer parses as JSON although its letters and digits are the same; so each
content also has a plain fingerprint, and contents are copies when either is equal, directly or through others.

Cases. Redelivered results, equal tool_use_id, count once. Null contents and contents of under `least` characters are
no copies of anything; neither are contents without letters and digits. keep_id is the smallest id of a set. Letters and digits are those of Unicode, compared by case folding; a JSON
string counts with its unescaped value, a number with its literal's digits; repeated names in an object count as often
as they stand. A JSON text nested too deep to parse is taken as plain text, as are strings inside an object that breaks off. Empty tables give no rows; further columns
of the input are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from contextlib import suppress
from hashlib import blake2b
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .components import components
from .semijoin import sifted

LEAST = 80
_MOD = 1 << 128
_PLAIN = re.compile(r"[\W_]+")


def plain(text: str) -> str:
    """Letters and digits only; the text is case folded already."""
    return _PLAIN.sub("", text)


def _hash(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=16).digest(), "little")


class _Object:
    """A parsed object: its multiset hash and, when kept, its pairs."""

    __slots__ = ("code", "pairs")

    def __init__(self, pairs: list[tuple[str, Any]], keep: bool):
        total = 0
        for name, value in pairs:
            total += _hash(f"{plain(name)}\x00{code_of(value)}".encode("utf-8", "surrogatepass"))
        self.code = f"\x01{total % _MOD:032x}"
        self.pairs = pairs if keep else None


def code_of(value: Any) -> str:
    """A value's form for hashing: letters and digits for leaves, the multiset hash for objects, the sequence for arrays."""
    if isinstance(value, str):
        return plain(value)
    if isinstance(value, _Object):
        return value.code
    if isinstance(value, list):
        return "".join(map(code_of, value))
    return {True: "true", False: "false", None: "null"}[value]


def _decoder(keep: bool) -> json.JSONDecoder:
    return json.JSONDecoder(object_pairs_hook=lambda pairs: _Object(pairs, keep), parse_int=str, parse_float=str, parse_constant=str)


_FAST, _KEEPING = _decoder(False), _decoder(True)


_OPEN = re.compile(r'\{[ \t\n\r]*["}]')
_MARKS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.S)


def _closed(text: str, at: int, end: int) -> tuple[list[int], int]:
    """(starts of the outermost objects closed in text[at:end], the end of the last whole mark there).

    The stretch is what a parser took before it failed, so its strings are whole. The objects still open at its end
    fail at the same place as the outermost one and needn't be tried.
    """
    opened: list[int] = []
    closed: list[int] = []
    last = at + 1
    for m in _MARKS.finditer(text, at, end):
        mark, last = m[0], m.end()
        if mark == "{":
            opened.append(m.start())
        elif mark == "}" and opened:
            start = opened.pop()
            while closed and closed[-1] > start:
                closed.pop()
            closed.append(start)
    return closed, last


class _Text(str):
    """A text whose parse errors don't look for their line, which would take as long as the text before them."""

    def count(self, *_: Any) -> int:
        return 0

    def rfind(self, *_: Any) -> int:
        return -1


def _balanced(text: str, at: int) -> int:
    """The end of the object at a place, by its brackets alone; the text's end when it isn't closed."""
    depth = 0
    for m in _MARKS.finditer(text, at):
        depth += (m[0] in "{[") - (m[0] in "}]")
        if depth == 0:
            return m.end()
    return len(text)


def pieces(text: str, keep: bool = False) -> Iterator[str | _Object]:
    """The content as plain stretches and the JSON objects that occur between them, in time linear in its length."""
    decode = (_KEEPING if keep else _FAST).raw_decode
    text, start, at = _Text(text), 0, 0
    while m := _OPEN.search(text, at):
        at = m.start()
        try:
            found = [(at, *decode(text, at))]
            after = found[0][2]
        except json.JSONDecodeError as e:
            begins, after = _closed(text, at, max(e.pos, at + 1))
            found = []
            for a in begins:
                with suppress(ValueError, RecursionError):  # braces of a string that broke off look like an object's
                    found.append((a, *decode(text, a)))
        except (ValueError, RecursionError):  # digits beyond what an integer may have, or nested too deep
            found, after = [], _balanced(text, at)
        for begin, value, end in found:
            if start < begin:
                yield text[start:begin]
            yield value
            start = end
        at = after
    if start < len(text):
        yield text[start:]


def fingerprint(text: str) -> tuple[int, int]:
    """(fingerprint with commuting members, plain fingerprint); both 0 when there is no letter or digit."""
    text = text.casefold()  # before parsing, so that TRUE, NULL and \\N of an upper-cased copy parse too
    flat = plain(text)
    if not flat:
        return 0, 0
    straight = _hash(flat.encode("utf-8", "surrogatepass"))
    if '"' not in text or "{" not in text:
        return straight, straight
    parts = list(pieces(text))
    if not any(isinstance(p, _Object) for p in parts):
        return straight, straight
    return _hash("".join(p.code if isinstance(p, _Object) else plain(p) for p in parts).encode("utf-8", "surrogatepass")), straight


def fields(text: str) -> Counter:
    """The multiset of a content's fields: (position of its piece, name path, value); members of one object have equal positions."""
    found: Counter = Counter()

    def walk(value: Any, path: tuple) -> None:
        if isinstance(value, _Object):
            for name, x in value.pairs or ():
                walk(x, (*path, plain(name)))
            found[(*path, "\x01", len(value.pairs or ()))] += 1
        elif isinstance(value, list):
            if any(isinstance(x, (list, _Object)) for x in value):
                for i, x in enumerate(value):
                    walk(x, (*path, i))
            else:
                found[(*path, "".join(map(code_of, value)))] += 1
        else:
            found[(*path, code_of(value))] += 1

    at, run = 0, ""
    for piece in pieces(text.casefold(), keep=True):
        if isinstance(piece, _Object):
            found[(at, run)] += 1
            walk(piece, (at + 1,))
            at, run = at + 2, ""
        else:
            run += plain(piece)
    found[(at, run)] += 1
    return found


def same(a: str, b: str) -> bool:
    """Whether two contents are copies: equal letters and digits in order, or equal multisets of fields."""
    return plain(a.casefold()) == plain(b.casefold()) or fields(a) == fields(b)


# ---- over tables ------------------------------------------------------------------------------------------------

_PRINTS = "tool_use_id string, member binary, straight binary, form binary"


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = lambda x: x.to_bytes(16, "little")
    for batch in batches:
        rows = []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            member, straight = fingerprint(text)
            if member or straight:
                rows.append((k, pack(member), pack(straight), blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()))
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["tool_use_id", "member", "straight", "form"])


def copies(results: DataFrame, least: int = LEAST) -> DataFrame:
    """(keep_id, copy_id) of contents that differ in formatting only, from (tool_use_id, content)."""
    long = results.select("tool_use_id", "content").filter((F.length("content") >= least) & F.col("tool_use_id").isNotNull())
    prints = cut(long.mapInArrow(_prints, _PRINTS).dropDuplicates(["tool_use_id"]))
    prints = cut(verified(prints, long))
    several = prints.groupBy("straight").agg(F.min("member").alias("a"), F.max("member").alias("b")).filter("a <> b")
    if not several.isEmpty():
        links = prints.join(several.select("straight", "a"), "straight").filter("member <> a").select(F.col("a"), F.col("member").alias("b")).distinct()
        prints = prints.join(components(links).withColumnsRenamed({"node": "member"}), "member", "left").withColumn("member", F.coalesce("root", "member")).drop("root")
    sets = prints.groupBy("member").agg(F.min("tool_use_id").alias("keep_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return prints.join(sets, "member").filter("tool_use_id <> keep_id").select("keep_id", F.col("tool_use_id").alias("copy_id"))


def verified(prints: DataFrame, contents: DataFrame) -> DataFrame:
    """prints with the member fingerprint changed where a form's fields aren't those of its group's first form.

    One content per form, a distinct byte string of a group, is fetched and compared; groups of one form need none.
    """
    forms = prints.groupBy("member", "form").agg(F.min("tool_use_id").alias("tool_use_id"))
    firsts = forms.groupBy("member").agg(F.min("tool_use_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    wanted = cut(forms.join(firsts, "member"))
    texts = wanted.join(sifted(contents, wanted, "tool_use_id", ["content"]), "tool_use_id").dropDuplicates(["tool_use_id"])
    first = texts.filter("tool_use_id = first_id").select("member", F.col("content").alias("first_content"))

    @F.pandas_udf("boolean")
    def equal(a, b):  # type: ignore[no-untyped-def]
        import pandas as pd

        return pd.Series([same(x, y) for x, y in zip(a, b)], dtype="bool")

    other = texts.filter("tool_use_id <> first_id").join(first, "member").filter(~equal("content", "first_content")).select("member", "form", F.lit(True).alias("differs"))
    return prints.join(other, ["member", "form"], "left").withColumn("member", F.when(F.col("differs"), F.col("form")).otherwise(F.col("member"))).drop("differs")
