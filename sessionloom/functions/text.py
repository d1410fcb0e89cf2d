"""Text as Column expressions: lines, hashes, canonical forms, identities. All stay inside the JVM's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of tools by the family they belong to.
FAMILIES = {
    "file_read": ("view_file", "read_file", "read", "open_file"),
    "search": ("grep_search", "grep", "search_code", "find_by_name"),
    "edit": ("edit", "replace_file_content", "write_to_file"),
    "command": ("bash", "run_terminal"),
}
# Marks of an error in a text.
ERROR_MARKS = ("error", "exception", "traceback", "failed", "failure", "fatal")
# Patterns of what changes between otherwise equal outputs, and the tags that stand for them, in order.
VOLATILE = (
    (r"\x1b\[[0-9;]*[A-Za-z]", ""),
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>"),
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?", "<time>"),
    (r"\b[0-9a-f]{16,}\b", "<hex>"),
    (r"\b[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?\b", "<time>"),
)
# What is masked before a text is shown.
SECRETS = ((r"(?i)bearer\s+[a-z0-9._\-]+", "Bearer <redacted>"), (r"\bsk-[A-Za-z0-9_\-]{8,}", "<redacted>"), (r"(?i)\b(api[_-]?key|token|secret|password)(\s*[=:]\s*)[\"']?[^\s\"',;]{6,}[\"']?", "$1$2<redacted>"))


def lines(text: Column) -> Column:
    """A text's lines; CR LF and CR end lines too, and a final line end makes no further line."""
    return F.split(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"\n\z", ""), "\n")


def token_estimate(text: Column) -> Column:
    """Characters by four, the engine's size estimate where no tokenizer is named."""
    return F.floor(F.coalesce(F.length(text), F.lit(0)) / 4)


def digest(text: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def tool_name(name: Column) -> Column:
    """A tool's name in one spelling."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.trim(name), "([a-z0-9])([A-Z])", "$1_$2")), "[^a-z0-9]+", "_")


def family(name: Column) -> Column:
    key = tool_name(name)
    out = F.when(key.isNull(), None)
    for f, names in FAMILIES.items():
        out = out.when(key.isin(*names), f)
    return out.otherwise("other")


def path_argument(args: Column) -> Column:
    return F.coalesce(args["path"], args["file_path"], args["search_path"])


def query_argument(args: Column) -> Column:
    return F.coalesce(args["query"], args["pattern"])


def command_argument(args: Column) -> Column:
    return F.coalesce(args["command"], args["cmd"])


def plain_path(path: Column, root: Column) -> Column:
    """A path relative to its root, slashes one way, without ., doubled slashes and single `x/..` steps."""
    p = F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), "^file://", "")
    p = F.regexp_replace(F.regexp_replace(p, "/+", "/"), r"(^|/)(\./)+", "$1")
    p = F.regexp_replace(p, r"[^/]+/\.\./", "")
    return F.when(p.startswith(F.concat(root, F.lit("/"))), F.substring(p, F.length(root) + 2, F.length(p))).otherwise(p)


def normal_path(path: Column) -> Column:
    """A path with slashes one way and without . and .. steps or doubled slashes; empty where nothing is left."""
    p = F.regexp_replace(F.trim(path), r"\\", "/")
    parts = F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))
    rooted = p.startswith("/")
    walked = F.aggregate(
        parts,
        F.expr("cast(array() as array<string>)"),
        lambda done, s: F.when(s != "..", F.concat(done, F.array(s)))
        .when((F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != ".."), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(rooted, done)
        .otherwise(F.concat(done, F.array(s))),
    )
    return F.when(p.rlike(r"//|(^|/)\.\.?(/|$)|/$"), F.concat(F.when(rooted, "/").otherwise(""), F.array_join(walked, "/"))).otherwise(p)


def command_family(command: Column) -> Column:
    """The program a command runs: leading assignments, env, sudo, `uv run` and `python -m` are skipped."""
    c = F.regexp_replace(F.trim(command), r"^(?:env\s+|sudo\s+|[A-Za-z_][A-Za-z0-9_]*=\S*\s+)+", "")
    c = F.regexp_replace(c, r"^uv\s+run\s+", "")
    c = F.regexp_replace(c, r"^python3?\s+-m\s+", "")
    return F.nullif(F.regexp_extract(c, r"^(?:\S*/)?([^\s/]+)", 1), F.lit(""))


def canonical(text: Column, root: Column | None = None) -> Column:
    """A text without what changes between equal outputs: line ends, escapes, ids, times, the root, trailing blanks."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    for pattern, tag in VOLATILE:
        t = F.regexp_replace(t, pattern, tag)
    if root is not None:
        t = F.when(root.isNotNull() & (root != ""), F.replace(t, root, F.lit("$CWD"))).otherwise(t)
    return F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "(?m) +$", "")


def redact(text: Column) -> Column:
    for pattern, mask in SECRETS:
        text = F.regexp_replace(text, pattern, mask)
    return text


def has_error(text: Column) -> Column:
    return F.lower(text).rlike("|".join(ERROR_MARKS))


def clip(text: Column, n: int) -> Column:
    """At most n characters, with an ellipsis for what is left out."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - 1), F.lit("…")))


def content_kind(text: Column) -> Column:
    """What a tool's output is, by the first rule that holds; shares are of the lines that aren't blank."""
    full = F.filter(lines(text), lambda x: F.trim(x) != "")
    n = F.size(full)
    share = lambda pattern: F.size(F.filter(full, lambda x: x.rlike(pattern))) / F.greatest(n, F.lit(1))
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "empty")
        .when(text.rlike(r"(?m)^Traceback \(most recent call last\)"), "traceback")
        .when(text.rlike(r"(?m)^diff --git |^@@ -[0-9]+"), "diff")
        .when(text.rlike(r"(?m)^(=+ .*(passed|failed).*=+|FAILED \S+|\S+\.py::\S+)"), "test_report")
        .when(text.rlike(r"^\s*[\[{]") & F.try_parse_json(text).isNotNull(), "json")
        .when(share(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.]+Z? +[A-Z]+ ") >= 0.5, "log")
        .when(share(r"^[^\s:]+\.[A-Za-z0-9]+:[0-9]+:") >= 0.7, "search")
        .when(share(r"^[-dl][rwx-]{9} ") >= 0.5, "listing")
        .when(share(r"^\s*(def |class |import |from .* import |return |raise |assert |for |if |with |#)") >= 0.3, "code")
        .otherwise("text")
    )


# Kinds of errors by the first pattern that a text has, in order.
ERROR_KINDS = (
    ("enoent", "no such file|file not found|does not exist|enoent"),
    ("eacces", "permission denied|access denied|eacces"),
    ("not_found", "not found|cannot find|could not find"),
    ("regex_error", "regex.*error|error.*regex|invalid regex|bad regex"),
    ("import_error", "importerror|modulenotfounderror|no module named|import error"),
    ("syntax_error", r"syntaxerror|\bsyntax\s+error\b|\bparse\s+error\b|\bparse-error\b"),
    ("attr_error", "attributeerror|has no attribute|no attribute|attribute error"),
    ("type_error", "typeerror|incompatible type|type error"),
    ("value_error", "valueerror|invalid value|value error"),
    ("timeout", "timeout|timed out|deadline exceeded"),
    ("network_error", "connection.*refused|connection.*reset|network.*error"),
    ("command_failed", "command failed|exit code [0-9]+|non-zero exit"),
    ("already_exists", "already exists|file exists"),
    ("empty_or_missing", "empty|zero bytes|no such"),
)
# Endings of source files, and of files that texts name.
SOURCES = "py|ts|tsx|js|jsx|go|rs|rb|java|c|cc|cpp|h"
NAMED = "py|ts|tsx|js|jsx|json|md|toml|yaml|yml|sh|txt|css|html|sql|rs|go|rb"
SEARCH_LINE, CONTEXT_LINE = r"^\s*\S*?:[0-9]+(:[0-9]+)?:", r"^\s*[^\s:][^:]*-[0-9]+-"
EVIDENCE_KEY = r'"(line|snippet|content|text|match|context)"\s*:'
WIRE = r"(?m)^>>>|^@(msg|thought|Tool|result|meta|Delegate)\b"
INJECTED = r"(?s)\n?<system-reminder>.*?</system-reminder>\n?"


def error_kind(text: Column) -> Column:
    """The first kind of ERROR_KINDS a text shows; null when it shows none."""
    low, out = F.lower(text), None
    for kind, pattern in ERROR_KINDS:
        out = F.when(low.rlike(pattern), kind) if out is None else out.when(low.rlike(pattern), kind)
    return out


def names_source_line(text: Column) -> Column:
    """Whether a line begins with a source file and a line number."""
    return text.rlike(r"(?m)^\s*(?:\.?/)?[A-Za-z0-9_./-]+\.(?:" + SOURCES + r"):[0-9]+(?::|\s|$)")


def evidence_level(text: Column) -> Column:
    """exact_content when a search result shows lines, or JSON rows with content, else navigation."""
    shows = F.exists(lines(text), lambda x: x.rlike(SEARCH_LINE) | x.rlike(CONTEXT_LINE))
    rows = F.trim(text).rlike(r"(?s)^\[.*\]$") & F.try_parse_json(text).isNotNull() & F.lower(text).rlike(EVIDENCE_KEY)
    return F.when(shows | rows, "exact_content").otherwise("navigation")


def keepable_output(program: Column, text: Column) -> Column:
    """Whether a command's output may be kept: neither blank nor a failure, by the program that ran."""
    low = F.lower(F.trim(strip_injected(text)))
    failed = low.rlike(r"traceback \(most recent call last\)|command not found|no such file or directory|fatal:|(?m)^error:")
    tests = (program == "pytest") & low.rlike(r"=+\s+failures?\s+=+|\bfailed\b|\berrors?\b")
    checks = program.isin("ruff", "mypy") & low.contains("error") & ~low.contains("success:")
    return (low != "") & ~failed & ~F.coalesce(tests, F.lit(False)) & ~F.coalesce(checks, F.lit(False))


def strip_injected(text: Column) -> Column:
    """A text without the blocks that a harness put in."""
    return F.regexp_replace(text, INJECTED, "")


def has_markup(text: Column) -> Column:
    return (F.length(text) >= 10) & text.rlike(WIRE)


def named_files(text: Column) -> Column:
    """The files a text names, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_./-]+\.(?:" + NAMED + r"))\b")))


def joined_within(items: Column, limit: int, separator: str = " | ") -> Column:
    """Items joined until the first that would pass the limit; blank ones are left out."""
    full = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    step = lambda s, x: F.when(s["full"] | (F.length(s["text"]) + F.when(s["text"] == "", 0).otherwise(len(separator)) + F.length(x) > limit), F.struct(s["text"].alias("text"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(s["text"], F.when(s["text"] == "", "").otherwise(separator), x).alias("text"), F.lit(False).alias("full")))
    return F.aggregate(full, F.struct(F.lit("").alias("text"), F.lit(False).alias("full")), step)["text"]


def clip_around(text: Column, n: int) -> Column:
    """At most n characters: around the first mark of an error where there is one, else the beginning."""
    at = F.regexp_instr(F.lower(text), F.lit("|".join(ERROR_MARKS)))
    start = F.greatest(F.lit(1), F.least(at - n // 2, F.length(text) - n + 1))
    return F.when(F.length(text) <= n, text).otherwise(F.substring(text, F.when(at > 0, start).otherwise(1), F.lit(n)))


def bare_markdown(text: Column) -> Column:
    """A text without Markdown's marks: fences, headings, quotes, list marks, emphasis, links."""
    t = F.regexp_replace(text, r"(?m)^```.*$", "")
    t = F.regexp_replace(t, r"(?m)^\s{0,3}(#{1,6}|>|[-*+]|[0-9]+\.)\s+", "")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"(\*\*|__|`)", ""), r"\n{3,}", "\n\n")


def wire_shortened(text: Column) -> Column:
    """State lines with commas for bars, block marks without indentation, blank runs closed up."""
    t = F.regexp_replace(text, r"(?m)^( {2,})(@(?:msg|thought|Tool|result|meta|Delegate)\b)", "$2")
    for _ in range(12):  # one bar of a state line each; lines have fewer fields than that
        t = F.regexp_replace(t, r"(?m)^(>>> [^\n|]*)\|([a-z_]+:)", "$1,$2")
    return F.regexp_replace(F.replace(t, F.lit("|>"), F.lit(">")), r"\n{3,}", "\n")


def masked_members(members: Column) -> Column:
    """A map with the values of secret keys masked, and secrets within the others."""
    return F.transform_values(members, lambda k, v: F.when(F.lower(k).rlike("api[_-]?key|token|secret|password|authorization|cookie"), F.when(v.isNotNull(), "<redacted>")).otherwise(redact(v)))
