"""Outputs of all kinds: a classifier of sixteen kinds as a Column, codecs for those that `codecs` has none for, and what is kept whole.

No form is ever longer than its text, failing tests and code are not shortened in a stream of outputs, and what a codec
leaves out is counted in its form.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window as W

from ..functions import text as T
from . import codecs
from .events import with_target

# What lines of each kind look like, and the share or number of a text's full lines that must.
FRAMES = r"^\s*at \S+ ?\([^)]*:[0-9]+(:[0-9]+)?\)"
SHARES = (
    ("log", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.]+Z? +[A-Z]+ ", 0.5, 2), ("grep_context", r"^[^\s:][^:]*-[0-9]+-", 0.6, 4), ("git_log", r"^(commit [0-9a-f]{40}|[0-9a-f]{7,40}\s+\S.*)$", 0.4, 2), ("grep", r"^\S+:[0-9]+:", 0.7, 3), ("find", r"^(/|\./)[^\s:]+$", 0.85, 3), ("listing", r"^[-dl][rwx-]{9}\s", 0.5, 3),
    ("install", r"(?i)^\s*(downloading|installing|resolving|fetching|collecting|preparing|using cached|requirement already|building|installed|successfully installed)\b", 0.6, 5), ("code", r"^\s*(def |class |import |from .* import |return |raise |assert |for |if |with |#)", 0.3, 2),
)
RULES = (
    ("stack_trace", r"(?m)^Traceback \(most recent call last\)"), ("test_report", r"(?m)^(=+ .*(passed|failed).*=+|FAILED \S+|\S+\.py::\S+)"), ("diff", r"(?m)^diff --git |^@@ -[0-9]+"), ("ps", r"^(USER\s+PID\s+%CPU|UID\s+PID\s+PPID)"), ("env", r"(?m)^(HOME|PATH|SHELL|USER|LANG)="),
)
EVIDENCE = r'^\s*\[\s*\{[^{}]*"(line|snippet|content|text|match|context)"\s*:'


def kind(text: Column) -> Column:
    """The first kind whose rule holds; repetitive for five lines that begin alike, raw for the rest."""
    full = F.filter(T.lines(text), lambda x: F.trim(x) != "")
    n = F.size(full)
    part = lambda pattern: F.size(F.filter(full, lambda x: x.rlike(pattern)))
    out = F.when(text.isNull() | (F.trim(text) == ""), "empty")
    for name, pattern in RULES[:1]:
        out = out.when(text.rlike(pattern), name)
    out = out.when(part(FRAMES) >= 3, "stack_trace")
    for name, pattern in RULES[1:]:
        out = out.when(text.rlike(pattern), name)
    is_json = text.rlike(r"^\s*[\[{]") & F.try_parse_json(text).isNotNull()
    out = out.when(is_json & text.rlike(EVIDENCE), "search_results").when(is_json, "json")
    for name, pattern, share, least in SHARES:
        out = out.when((n >= least) & (part(pattern) >= n * share), name)
    head = F.substring(F.get(full, F.lit(0)), 1, 8)
    return out.when((n >= 5) & (F.length(head) == 8) & F.forall(F.slice(full, 1, 5), lambda x: x.startswith(head)), "repetitive").otherwise("raw")


def grep_context(text: str) -> str:
    """Lines under the file they stand in, hits marked, gaps shown."""
    out, file, last = [], None, -1
    for line in text.splitlines():
        m = re.match(r"([^\s:][^:]*?)([:-])(\d+)\2(.*)", line)
        if not m:
            if line.strip() != "--":
                out.append(line)
            continue
        if m[1] != file:
            file, last = m[1], -1
            out.append(file)
        if last >= 0 and int(m[3]) > last + 1:
            out.append(" ...")
        last = int(m[3])
        out.append(f" {m[3]}{'*' if m[2] == ':' else ''} {m[4]}")
    return "\n".join(out)


def git_log(text: str) -> str:
    """A commit's first eight digits and its subject, one line each."""
    out: list[list[str]] = []
    for line in text.splitlines():
        if m := re.match(r"commit ([0-9a-f]{40})$", line):
            out.append([m[1][:8], ""])
        elif m := re.match(r"([0-9a-f]{7,40})\s+(.+)", line):
            out.append([m[1][:8], m[2][:72]])
        elif out and not out[-1][1] and line.startswith("    ") and line.strip():
            out[-1][1] = line.strip()[:72]
    return "\n".join([f"{len(out)} commits", *(" ".join(x) for x in out)])


def find(text: str, verbatim: int = 200) -> str:
    """Paths by directory: the directory once, the names below it; every path can be put together again."""
    paths = [x.strip() for x in text.splitlines() if x.strip()]
    if len(paths) <= verbatim:
        return f"{len(paths)} paths\n" + "\n".join(paths)
    by: dict[str, list[str]] = defaultdict(list)
    for p in paths:
        head, _, name = p.rpartition("/")
        by[head].append(name)
    return "\n".join([f"{len(paths)} paths", *(f"{d}/: {' '.join(names)}" for d, names in by.items())])


def install(text: str) -> str:
    """Lines of progress counted, others kept; after a failure everything from two lines before it."""
    lines = text.splitlines()
    progress = re.compile(next(p for k, p, *_ in SHARES if k == "install"))
    bad = next((i for i, x in enumerate(lines) if re.search(r"(?i)\b(error|failed|exception|traceback)\b", x)), None)
    body = lines[max(0, bad - 2) :] if bad is not None else [x for x in lines if not progress.match(x) or re.match(r"(?i)\s*successfully", x)]
    return "\n".join([f"install, {sum(bool(progress.match(x)) for x in lines)} lines of progress{', failed' if bad is not None else ''}", *body])


def search_rows(text: str) -> str:
    """The rows of a JSON array: shared names once, then a line of values for each row."""
    try:
        rows = json.loads(text)
    except (ValueError, RecursionError):
        return text
    if not isinstance(rows, list) or not rows or not all(isinstance(r, dict) for r in rows):
        return text
    names = [k for k in rows[0] if all(k in r for r in rows)]
    return "\n".join([f"{len(rows)} rows of {','.join(names)}", *(":".join(str(r[k])[:80].replace("\n", " ") for k in names) for r in rows)])


def processes(text: str, most: int = 20) -> str:
    """The first `most` processes that aren't the system's."""
    head, *rest = text.splitlines()
    own = [x for x in rest if not re.search(r"/System/|/usr/libexec/|kernel_task|\[k\w+", x)]
    return "\n".join([head, *own[:most], f"... {len(rest) - min(most, len(own))} more"])


def environment(text: str) -> str:
    """Names of variables, with values only for plain ones; secrets never."""
    shown = re.compile(r"(PATH|HOME|USER|SHELL|EDITOR|LANG|PWD|VIRTUAL_ENV|PORT|\w*_PORT)=")
    lines = text.splitlines()
    kept = [x for x in lines if shown.match(x)]
    return "\n".join([f"{len(lines)} variables", *kept])


LIBRARY = re.compile(r"node_modules|site-packages|dist-packages|/lib/python|/usr/lib|\bjava\.|\bsun\.|node:internal")


def frames(text: str) -> str:
    """A trace without its library frames, which are counted; Python, Node and Java."""
    out, hidden, skip = [], 0, False
    for line in text.splitlines():
        if re.match(r'\s+File "', line) or re.match(r"\s*at ", line):
            skip = bool(LIBRARY.search(line))
            hidden += skip
        elif not line.startswith("    "):
            skip = False
        if not skip:
            out.append(line)
    return "\n".join([*out, *([f"({hidden} library frames)"] if hidden else [])])


OWN = {"grep_context": grep_context, "git_log": git_log, "find": find, "install": install, "search_results": search_rows, "ps": processes, "env": environment, "stack_trace": frames}
SHARED = {"grep": "search", "diff": "diff", "test_report": "test_report", "json": "json", "listing": "listing", "log": "log", "code": "code", "repetitive": "text", "raw": "text"}
TIGHT = ("grep", "grep_context", "listing", "install", "repetitive", "search_results")


def shortened(text: str | None, kind_: str | None, tight: bool = False, keep: int = 4) -> str | None:
    """The kind's form where it is shorter; tight: of kinds that are lists only the head and `keep` lines, the rest counted."""
    if not text or not kind_:
        return text
    codec = OWN.get(kind_) or codecs.REGISTRY.get(SHARED.get(kind_, ""))
    short = codec(text) if codec else text
    if tight and kind_ in TIGHT and len(lines := short.splitlines()) > keep + 1:
        short = "\n".join([*lines[: keep + 1], f"... {len(lines) - keep - 1} more lines"])
    return short if len(short) < len(text) else text


@F.pandas_udf(StructType([StructField(n, StringType()) for n in ("short", "tight", "cut")]))
def _forms(texts: pd.Series, kinds: pd.Series) -> pd.DataFrame:
    rows = [(s := shortened(t, k), shortened(t, k, True), codecs.truncate(s)) for t, k in zip(texts, kinds)]
    return pd.DataFrame(rows, columns=["short", "tight", "cut"])


def forms(events: DataFrame) -> DataFrame:
    """Each result's kind, its codec's form, the tight form, and the form cut to size."""
    e = events.filter("raw is not null").select("session_id", "turn", "pos", "raw", kind(F.col("raw")).alias("kind")).withColumn("f", _forms("raw", "kind"))
    return e.select("session_id", "turn", "pos", "kind", F.length("raw").alias("n_chars"), F.length("f.short").alias("n_short"), F.length("f.tight").alias("n_tight"), F.length("f.cut").alias("n_cut"), T.digest(F.col("f.short")).alias("digest"))


def kinds(events: DataFrame) -> DataFrame:
    e = events.filter("raw is not null").withColumn("kind", kind(F.col("raw")))
    return e.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("raw")).alias("n_chars"))


def window_pass(events: DataFrame, large: int = 8000, evidence: int = 1200) -> DataFrame:
    """Which results a pass over the recent window would shorten: large ones, or evidence above its own limit; never failing tests, code or paths a git command lists."""
    from ..functions.commands import lists_paths

    e = events.filter("raw is not null").withColumn("kind", kind(F.col("raw"))).withColumn("n", F.length("raw"))
    failing = (F.col("kind") == "test_report") & F.col("raw").rlike("FAILED|failed")
    limit = F.when(F.col("kind").isin("grep", "grep_context", "listing", "find", "log", "json"), evidence).otherwise(large)
    reason = F.when(failing, "failing_tests").when(F.col("kind") == "code", "code").when(F.coalesce(lists_paths(F.col("command")), F.lit(False)), "path_list").when(F.col("n") <= limit, "small").otherwise("shortened")
    return e.select("session_id", "turn", "pos", "kind", F.col("n").alias("n_chars"), reason.alias("reason"))


def stubs(events: DataFrame, least: int = 200) -> DataFrame:
    """What each repeat of an unchanged result is replaced by: its target, a digest and a summary. The first of a target, the first after a failure, partial reads and short texts stay whole."""
    e = with_target(events).filter("raw is not null and family is not null").withColumn("failed", T.has_error(F.col("raw"))).withColumn("h", T.digest(F.col("raw")))
    summary = T.joined_within(F.slice(T.lines(F.col("raw")), 1, 3), 80)
    e = e.select("session_id", "turn", "pos", "family", "target", "h", "failed", F.length("raw").alias("n"), summary.alias("summary"), F.col("offset").isNotNull().alias("partial"))
    line = W.partitionBy("session_id", "target").orderBy("turn", "pos")
    old = F.lag("h").over(line)
    first_failure = F.col("failed") & ~F.coalesce(F.lag("failed").over(line), F.lit(False))
    guard = (
        F.when(F.row_number().over(line) == 1, "first_of_target").when(first_failure, "first_failure").when(F.col("partial"), "partial_read").when(F.col("n") < least, "short")
        .when((F.col("family") == "file_read") & (F.row_number().over(line) == 2), "first_repeat_of_file").when(old != F.col("h"), "changed")
    )
    stub = F.concat(F.lit("@stable_result(hash:"), F.col("h"), F.lit(") "), F.col("target"), F.lit(" |> "), F.col("summary"))
    s = e.withColumn("guard", guard)
    return s.select("session_id", "turn", "pos", "target", "guard", F.when(F.col("guard").isNull(), stub).alias("stub"), F.when(F.col("guard").isNull(), F.greatest(F.lit(0), F.col("n") - F.length(stub))).otherwise(0).alias("saved"))


def trace_deltas(events: DataFrame) -> DataFrame:
    """Failing results whose last error line is that of the failure before in the session: how many of their lines are new."""
    error = F.try_element_at(F.filter(T.lines(F.col("raw")), T.has_error), F.lit(-1))
    e = events.filter(T.has_error(F.col("raw"))).select("session_id", "turn", "pos", T.digest(F.regexp_replace(error, "[0-9]+", "0")).alias("signature"), F.array_distinct(F.transform(T.lines(F.col("raw")), lambda x: F.xxhash64(x))).alias("lines"))
    line = W.partitionBy("session_id", "signature").orderBy("turn", "pos")
    return e.withColumn("old", F.lag("lines").over(line)).filter("old is not null").select("session_id", "turn", "pos", "signature", F.size("lines").alias("n_lines"), F.size(F.array_except("lines", "old")).alias("n_new"))
