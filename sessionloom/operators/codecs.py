"""Codecs: shorter forms of tool outputs by kind, never longer than the input.

The kind is a Column expression (functions.text.content_kind); the codecs need whole texts and loops over lines and run
as one Arrow-batched pandas UDF. `register` adds or replaces a codec.
"""

from __future__ import annotations

import difflib
import json
import re
from collections import Counter, defaultdict
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window as W

from ..functions import text as T
from .unnest import triples

Codec = Callable[[str], str]
REGISTRY: dict[str, Codec] = {}


def register(*kinds: str) -> Callable[[Codec], Codec]:
    def add(codec: Codec) -> Codec:
        REGISTRY.update(dict.fromkeys(kinds, codec))
        return codec

    return add


@register("search")
def search(text: str, limits: tuple[tuple[int, int], ...] = ((20, 1 << 30), (50, 6), (1 << 30, 3))) -> str:
    """Hits grouped by file, fewer of each file the more there are in all: limits are (hits in all, hits of a file); what is left out is counted."""
    by: dict[str, list[str]] = defaultdict(list)
    rest = []
    for line in text.splitlines():
        if m := re.match(r"([^\s:]+):(\d+):\s?(.*)", line):
            by[m[1]].append(f"  {m[2]}: {m[3][:80]}")
        elif line.strip():
            rest.append(line)
    total = sum(map(len, by.values()))
    most = next(m for n, m in limits if total <= n)
    out = [f"{total} hits in {len(by)} files"]
    for file, hits in by.items():
        out += [f"{file} ({len(hits)})", *hits[:most], *([f"  ... {len(hits) - most} more"] if len(hits) > most else [])]
    return "\n".join(out + rest)


@register("diff")
def diff(text: str) -> str:
    """Changed lines and headers only."""
    keep = [x for x in text.splitlines() if x[:1] in "+-@" or x.startswith("diff ")]
    plus, minus = sum(x[:1] == "+" and x[:3] != "+++" for x in keep), sum(x[:1] == "-" and x[:3] != "---" for x in keep)
    return "\n".join([f"+{plus} -{minus}", *keep])


@register("test_report")
def test_report(text: str) -> str:
    """Counts of outcomes, then the lines of what failed."""
    lines = text.splitlines()
    counts = Counter(m.lower() for x in lines for m in re.findall(r"\b(PASSED|FAILED|ERROR|SKIPPED)\b", x))
    bad = [x for x in lines if re.search(r"\b(FAILED|ERROR)\b|^E\s|[Aa]ssert|Error", x)]
    end = [x for x in lines if re.search(r"\d+ (passed|failed)", x)]
    return "\n".join([", ".join(f"{n} {k}" for k, n in sorted(counts.items())) or "no outcomes", *bad, *(x for x in end if x not in bad)])


@register("log")
def log(text: str) -> str:
    """Runs of lines that differ in digits only as one line with their count; errors and warnings always in full."""
    out: list[list[Any]] = []
    for line in text.splitlines():
        shape = re.sub(r"\d+", "0", line)
        if out and out[-1][0] == shape and not re.search(r"ERROR|FATAL|WARN", line):
            out[-1][2] += 1
        else:
            out.append([shape, line, 1])
    return "\n".join(line if n == 1 else f"{line} (x{n})" for _, line, n in out)


@register("listing")
def listing(text: str) -> str:
    """Names and sizes of up to 20 entries, else a histogram of extensions."""
    names = [(p[-1], p[-2]) for x in text.splitlines() if re.match(r"[-dl][rwx-]{9}\s", x) and len(p := x.split()) > 2]
    if len(names) <= 20:
        return "\n".join(f"{n} {size}" for n, size in names)
    kinds = Counter(n.rsplit(".", 1)[-1] if "." in n else "(none)" for n, _ in names)
    return f"{len(names)} entries: " + ", ".join(f"{k} {n}" for k, n in kinds.most_common())


def outline(value: Any, budget: int = 1500, sample: int = 40) -> str:
    """A JSON value as its paths: each once, with its kinds, how often it stands and its first value, up to `budget` characters.

    Paths in document order; what the budget leaves out is counted in the last line.
    """
    paths: dict[str, tuple[Counter, str]] = {}
    for path, _, leaf in triples(value):
        kinds, _ = paths.setdefault(path or ".", (Counter(), "" if isinstance(leaf, (tuple, frozenset)) else json.dumps(leaf, ensure_ascii=False)))
        kinds[type(leaf).__name__.replace("NoneType", "null").replace("tuple", "array").replace("frozenset", "object")] += 1
    out, left = [], budget
    for path, (kinds, first) in paths.items():
        line = f"{path}: {'|'.join(kinds)} x{sum(kinds.values())} {first if len(first) <= sample else first[:sample] + '~'}".rstrip()
        left -= len(line) + 1
        if left < 0:
            out.append(f"... {len(paths) - len(out)} more paths")
            break
        out.append(line)
    return "\n".join(out)


@register("json")
def json_(text: str) -> str:
    """The outline, under the number of characters it stands for."""
    try:
        return f"json of {len(text)} characters\n" + outline(json.loads(text))
    except (ValueError, RecursionError):
        return text


@register("traceback")
def traceback(text: str) -> str:
    """Frames of installed packages are left out."""
    out, skip = [], False
    for line in text.splitlines():
        if re.match(r'\s+File "', line):
            skip = "site-packages" in line or "/lib/python" in line
        elif not line.startswith("    "):
            skip = False
        if not skip:
            out.append(line)
    return "\n".join(out)


@register("code")
def code(text: str) -> str:
    """Signatures of functions and classes, with the numbers of lines left out between them."""
    out, hidden = [], 0
    for line in text.splitlines():
        if re.match(r"\s*(def|class|async def|import|from|@)\b", line):
            if hidden:
                out.append(f"  ... {hidden} lines")
            out.append(line)
            hidden = 0
        else:
            hidden += 1
    return "\n".join([*out, *([f"  ... {hidden} lines"] if hidden else [])])


@register("text")
def repeated(text: str) -> str:
    """Runs of five lines or more that begin as the run's first line does, as one line: greedy from the top."""
    lines, out, i = text.splitlines(), [], 0
    while i < len(lines):
        head, j = lines[i][:12], i + 1
        while len(head) == 12 and j < len(lines) and lines[j].startswith(head):
            j += 1
        out += [f"{lines[i]} (+{j - i - 1} alike)"] if j - i >= 5 else lines[i:j]
        i = j
    return "\n".join(out)


def compress(text: str | None, kind: str | None) -> str | None:
    """The codec's form where it is shorter, else the text."""
    if not text or kind not in REGISTRY:
        return text
    short = REGISTRY[kind](text)
    return short if len(short) < len(text) else text


def truncate(text: str | None, limit: int = 1200) -> str | None:
    """Head and tail at line ends, with a note of what is left out; untouched up to one and a half times the limit."""
    if text is None or len(text) <= limit * 3 // 2:
        return text
    head, tail = text[: limit * 2 // 3], text[-limit // 3 :]
    head, tail = head[: head.rfind("\n") + 1] or head, tail[tail.find("\n") + 1 :] or tail
    short = f"{head}[... {len(text) - len(head) - len(tail)} characters ...]\n{tail}"
    return short if len(short) < len(text) else text


@F.pandas_udf(StringType())
def compressed(texts: pd.Series, kinds: pd.Series) -> pd.Series:
    return pd.Series([compress(t, k) for t, k in zip(texts, kinds)], dtype=object)


@F.pandas_udf(StringType())
def unified(old: pd.Series, new: pd.Series) -> pd.Series:
    """A unified diff without context; null where there is no earlier text."""
    return pd.Series([None if a is None or b is None else "\n".join(difflib.unified_diff(a.splitlines(), b.splitlines(), lineterm="", n=0)) for a, b in zip(old, new)], dtype=object)


@F.pandas_udf(StringType())
def unified_lines(old: pd.Series, new: pd.Series) -> pd.Series:
    """A unified diff of lines parted by LF alone, which can be replayed to the byte."""
    return pd.Series([None if a is None or b is None else "\n".join(difflib.unified_diff(a.split("\n"), b.split("\n"), lineterm="", n=1)) for a, b in zip(old, new)], dtype=object)


def passed(events: DataFrame) -> DataFrame:
    """Events with their kind, the codec's form of their text and the characters saved."""
    e = events.filter("raw is not null").withColumn("kind", T.content_kind(F.col("raw")))
    e = e.withColumn("short", compressed("raw", "kind"))
    return e.select("session_id", "turn", "pos", "kind", "short", F.length("raw").alias("n_chars"), (F.length("raw") - F.length("short")).alias("saved"))


def reread_diffs(events: DataFrame) -> DataFrame:
    """Reads of a file read before in the session: the diff against the earlier text, where it is shorter than the text."""
    e = events.filter("family = 'file_read' and raw is not null and path is not null")
    e = e.withColumn("old", F.lag("raw").over(W.partitionBy("session_id", "path").orderBy("turn", "pos"))).filter("old is not null and old <> raw")
    return e.withColumn("diff", unified("old", "raw")).filter(F.length("diff") < F.length("raw")).select("session_id", "turn", "pos", "path", "diff", (F.length("raw") - F.length("diff")).alias("saved"))
