"""What shell commands read, search, list or look up, as Column expressions; commands are split at blanks outside quotes.

A command's words can be given as a column, so that several expressions over it don't split it each on its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normal_path

# Programs whose output may be kept, those that change files, and git's reading subcommands.
KEPT = ("rg", "grep", "find", "ls", "wc", "sed", "head", "tail", "nl", "git", "pytest", "ruff", "mypy")
GIT_KEPT = ("status", "log", "show", "diff", "blame")
# Marks of pipes, redirections, substitutions and globs; probes of metadata; temporary places.
UNSAFE = r"[;|<>`*?]|&&|\$\("
PROBES = ("git", "stat", "wc", "file", "ls", "find")
GIT_PROBES = ("log", "status", "shortlog", "blame")
TEMPORARY = r"^(/tmp/|/var/tmp/|/private/tmp/|tmp/)"
PARTS = r"""("[^"]*"|'[^']*'|\S+)"""
WRAPPERS = (r"^(?:(?:\S*/)?env(?:\s+[A-Za-z_][A-Za-z0-9_]*=\S*)*\s+)+", r"^uv\s+run\s+", r"^(?:\S*/)?python3?\s+-m\s+")


def squeezed(command: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(command, r"\s+", " ")), F.lit(""))


def words(command: Column) -> Column:
    """The words of a command without wrappers such as env or uv run, quotes taken off."""
    c = squeezed(command)
    for wrapper in WRAPPERS:
        c = F.regexp_replace(c, wrapper, "")
    return F.transform(F.regexp_extract_all(c, F.lit(PARTS)), lambda w: F.regexp_replace(w, r"""^"(.*)"$|^'(.*)'$""", "$1$2"))


def root(words_: Column) -> Column:
    return F.lower(F.regexp_extract(F.get(words_, F.lit(0)), r"([^/]*)$", 1))


def _arguments(words_: Column) -> Column:
    return F.slice(words_, F.lit(2), F.greatest(F.size(words_) - 1, F.lit(0)))


def _plain(arguments: Column) -> Column:
    return F.filter(arguments, lambda a: ~a.startswith("-"))


def read_path(command: Column, split: Column | None = None) -> Column:
    """The one file that cat, head, tail, nl or sed -n shows; null for anything that pipes, redirects or globs."""
    w = words(command) if split is None else split
    r, a = root(w), _arguments(w)
    bare = F.filter(a, lambda x: x != "--")
    one = F.when(F.size(_plain(a)) == 1, _plain(a)[0])
    path = (
        F.when(r == "cat", F.when((F.size(bare) == 1) & ~F.get(bare, F.lit(0)).startswith("-"), F.get(bare, F.lit(0))))
        .when(r.isin("head", "tail", "nl"), F.when(F.size(_plain(a)) == 1, one).when((F.size(_plain(a)) == 2) & (F.get(a, F.lit(0)) == "-n"), F.get(_plain(a), F.lit(1))))
        .when((r == "sed") & (F.size(a) == 3) & (F.get(a, F.lit(0)) == "-n"), F.get(a, F.lit(2)))
    )
    return F.when(~command.rlike(UNSAFE), path)


def search(command: Column, split: Column | None = None) -> Column:
    """struct<query, scope> of a grep, rg or ag."""
    w = words(command) if split is None else split
    a = _plain(_arguments(w))
    found = root(w).isin("grep", "rg", "ag") & (F.size(a) > 0)
    return F.when(found, F.struct(F.get(a, F.lit(0)).alias("query"), F.when(F.size(a) > 1, normal_path(F.element_at(a, -1))).alias("scope")))


def revision_kind(revision: Column) -> Column:
    return F.when(F.lower(revision) == "head", "head").when(revision.startswith("HEAD~"), "head_n").when(revision.rlike("^[0-9a-f]{4,40}$"), "sha").when(revision.startswith("@"), "ref").otherwise("other")


def history(command: Column) -> Column:
    """struct<path, revision kind> of git show REV:PATH and git diff REV -- PATH."""
    c = squeezed(command)
    show, diff = (r"^git show ([^:]+):(.+)$", r"^git diff (\S+) ?-- ?(.+)$")
    each = lambda pattern: F.struct(normal_path(F.regexp_extract(c, pattern, 2)).alias("path"), revision_kind(F.regexp_extract(c, pattern, 1)).alias("revision"))
    return F.when(c.rlike(show), each(show)).when(c.rlike(diff), each(diff))


def probe(command: Column, split: Column | None = None) -> Column:
    """What metadata a command looks up: git_log, stat, wc, ls and the like."""
    w = words(command) if split is None else split
    r, sub = root(w), F.lower(F.get(w, F.lit(1)))
    return F.when(~command.rlike(UNSAFE), F.when(r == "git", F.when(sub.isin(*GIT_PROBES), F.concat(F.lit("git_"), sub))).when(r.isin(*PROBES), r))


def listing(command: Column, split: Column | None = None) -> Column:
    """struct<path, mode> of an ls or find: its first plain argument, and the other ones."""
    w = words(command) if split is None else split
    a = F.filter(_arguments(w), lambda x: x != "--")
    path = F.get(_plain(a), F.lit(0))
    return F.when(root(w).isin("ls", "find"), F.struct(normal_path(F.coalesce(path, F.lit(""))).alias("path"), F.array_join(F.filter(a, lambda x: x.startswith("-")), " ").alias("mode")))


def cacheable(command: Column, split: Column | None = None) -> Column:
    """The command, squeezed and without wrappers, if its output can be kept: it only reads and pipes nothing."""
    w = words(command) if split is None else split
    r, second, has = root(w), F.lower(F.get(w, F.lit(1))), lambda x: F.array_contains(w, x)
    harmless = (
        F.when(r == "git", second.isin(*GIT_KEPT))
        .when(r == "ruff", (second == "check") & ~has("--fix"))
        .when(r == "sed", has("-n") & ~has("-i") & ~has("--in-place"))
        .when(r == "find", ~F.arrays_overlap(w, F.array(*map(F.lit, ("-delete", "-exec", "-execdir", "-ok", "-okdir")))))
        .otherwise(r.isin(*KEPT))
    )
    return F.when(~command.rlike(UNSAFE) & r.isin(*KEPT) & F.coalesce(harmless, F.lit(False)), F.array_join(w, " "))


def lists_paths(command: Column, split: Column | None = None) -> Column:
    """Whether a git command gives bare paths, which are evidence and are never shortened."""
    w = words(command) if split is None else split
    return (root(w) == "git") & F.coalesce(F.get(w, F.lit(1)).isin("diff", "log", "show"), F.lit(False)) & F.exists(w, lambda x: x.rlike("^(--name-only(=.*)?|--name-status|--raw)$"))
