"""What calls are about: identities of their arguments, of the evidence they give and of what a cache may keep of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import commands as C
from ..functions import text as T


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def arguments(args: Column, *without: str) -> Column:
    """The arguments in the order of their names, values with single blanks, empty ones left out."""
    kept = F.filter(F.array_sort(F.map_entries(args)), lambda e: ~e["key"].isin(*without) if without else F.lit(True))
    pairs = F.transform(kept, lambda e: F.struct(e["key"].alias("key"), blank(C.squeezed(e["value"])).alias("value")))
    return F.array_join(F.transform(F.filter(pairs, lambda e: e["value"] != ""), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


# Arguments that are part of an identity in another way.
OWN = ("path", "file_path", "search_path", "query", "pattern", "command", "cmd", "offset", "limit")


def shell_forms(events: DataFrame) -> DataFrame:
    """Events with the shell command that would do the same, their own where they have one: what the reading of commands is checked against."""
    p, q, n = F.col("path"), F.col("query"), F.pmod(F.col("turn") + F.col("pos"), F.lit(6))
    reads = (
        F.when(n == 0, F.concat(F.lit("cat "), p)).when(n == 1, F.concat(F.lit("head -n 20 "), p)).when(n == 2, F.concat(F.lit("sed -n 1,5p "), p))
        .when(n == 3, F.concat(F.lit("git show HEAD~1:"), p)).when(n == 4, F.concat(F.lit("ls -la "), p)).otherwise(F.concat(F.lit("env A=1 uv run wc -l "), p))
    )
    edits = F.when(n < 3, F.concat(F.lit("git diff HEAD -- "), p)).otherwise(F.concat(F.lit("git log --name-only "), p))
    shell = F.coalesce("command", F.when(F.col("family") == "file_read", reads).when(F.col("family") == "edit", edits).when(F.col("family") == "search", F.concat(F.lit('grep -rn "'), q, F.lit('" '), F.coalesce(p, F.lit("./src/")))))
    return events.withColumn("shell", shell).filter("shell is not null")


def commands(events: DataFrame) -> DataFrame:
    """What each command reads, searches, lists, probes; whether its output may be kept or is a list of paths."""
    c, w = F.col("shell"), F.col("w")
    e = shell_forms(events).select("session_id", "turn", "pos", "shell", C.words(c).alias("w"))
    e = e.select("*", C.search(c, w).alias("found"), C.history(c).alias("past"), C.listing(c, w).alias("dir"))
    return e.select(
        "session_id", "turn", "pos", "shell", C.root(w).alias("root"), C.read_path(c, w).alias("read_path"), "found.query", "found.scope", F.col("past.path").alias("past_path"), "past.revision",
        C.probe(c, w).alias("probe"), F.col("dir.path").alias("dir_path"), F.col("dir.mode").alias("dir_mode"), C.cacheable(c, w).alias("kept"), C.lists_paths(c, w).alias("lists_paths"),
    )


def identities(events: DataFrame) -> DataFrame:
    """The identities of each event: its arguments, the evidence it gives, what it intends, its label, its cache keys."""
    command, w = F.col("command"), F.col("w")
    e = events.filter("tool is not null").select(
        "session_id", "turn", "pos", "tool", "family", "command", C.words(command).alias("w"), blank(T.normal_path(F.col("path"))).alias("path"), blank(C.squeezed(F.col("query"))).alias("query"),
        arguments(F.col("args")).alias("all"), arguments(F.col("args"), *OWN).alias("flags"), arguments(F.col("args"), "offset", "limit").alias("whole"),
    )
    e = e.select("*", C.read_path(command, w).alias("shell_path"), C.search(command, w).alias("shell_search"), C.history(command).alias("past"), C.probe(command, w).alias("probed"), C.listing(command, w).alias("dir"))
    path, query, family, args, flags = (F.col(c) for c in ("path", "query", "family", "all", "flags"))
    shell_path, shell_search, past, probed, dir_ = (F.col(c) for c in ("shell_path", "shell_search", "past", "probed", "dir"))
    is_file = (family == "file_read") | shell_path.isNotNull()
    is_search = (family == "search") | shell_search.isNotNull()
    named = lambda p: F.when(p == "", "path-missing").otherwise(p)
    scope = lambda: F.when(path != "", path).otherwise(blank(shell_search["scope"]))
    asked = lambda: F.when(query != "", query).otherwise(blank(shell_search["query"]))
    target = named(F.when(path != "", path).otherwise(blank(T.normal_path(shell_path))))
    evidence = (
        F.when(is_file, F.concat(F.lit("file_read|"), target))
        .when(is_search, F.concat_ws("|", F.lit("search"), asked(), scope(), flags))
        .when(dir_.isNotNull(), F.concat_ws("|", F.lit("listing"), named(F.when(path != "", path).otherwise(blank(dir_["path"]))), dir_["mode"]))
    )
    temporary = target.rlike(C.TEMPORARY)
    pick = lambda past_, found_, probe_, read_, file_, search_: F.when(past.isNotNull(), past_).when(shell_search.isNotNull(), found_).when(probed.isNotNull(), probe_).when(shell_path.isNotNull(), read_).when((family == "file_read") & (path != ""), file_).when((family == "search") | (query != ""), search_)
    s = F.lit
    anchor = F.concat_ws("|", asked(), scope())
    label = (
        F.when(family == "file_read", F.when(path != "", path).otherwise(shell_path))
        .when(family == "search", F.when((query != "") & (path != ""), F.concat(query, F.lit(" @ "), path)).otherwise(F.nullif(query, F.lit(""))))
        .when(family == "command", T.command_family(command))
    )
    return e.select(
        "session_id", "turn", "pos", args.alias("arguments"), evidence.alias("evidence_key"),
        pick(s("file_history"), s("search"), F.when(probed.isin("ls", "find"), "listing").otherwise("file_metadata"), s("file_current"), s("file_current"), s("search")).alias("domain"),
        pick(past["path"], anchor, F.when(path != "", path).otherwise(probed), target, target, anchor).alias("anchor"),
        pick(s("diff"), s("search_results"), s("metadata"), F.when(temporary, "copy").otherwise("full"), s("full"), s("search_results")).alias("variant"),
        pick(past["revision"], anchor, probed, s(""), s(""), anchor).alias("novelty"),
        pick(s("git_history"), s("shell_search"), s("metadata_probe"), F.when(temporary, "temp_copy").otherwise("shell_read"), s("native_tool"), s("native_tool")).alias("source"),
        F.coalesce(label, F.lit("")).alias("label"),
        F.substring(F.sha2(F.concat_ws(":", "tool", args), 256), 1, 12).alias("result_key"), F.concat(F.col("tool"), F.lit(":"), F.substring(F.sha2("whole", 256), 1, 16)).alias("semantic_key"),
        T.family(F.col("tool")).alias("family"),
    )


def results(events: DataFrame) -> DataFrame:
    """What each result shows: kind of error, lines of sources, level of evidence, markup, whether it may be kept."""
    raw = F.col("raw")
    return events.filter("raw is not null").select(
        "session_id", "turn", "pos", T.error_kind(raw).alias("error_kind"), T.names_source_line(raw).alias("source_lines"), F.when(F.col("family") == "search", T.evidence_level(raw)).alias("evidence_level"),
        T.has_markup(raw).alias("markup"), T.keepable_output(T.command_family(F.col("command")), raw).alias("keepable"), F.size(T.named_files(raw)).alias("n_files"),
        F.length(T.strip_injected(raw)).alias("n_own"), T.joined_within(F.slice(T.lines(raw), 1, 6), 160).alias("summary"), T.clip_around(raw, 60).alias("clip"), T.digest(T.bare_markdown(raw)).alias("bare"),
    )


def protected(events: DataFrame, documents: tuple[str, ...] = ("readme.md", "changelog.md", "release.md"), logs: str = r"(bridge|collector)\.log$|\.log$") -> DataFrame:
    """Reads whose text is kept as it is: documents of a release, and logs of the engine itself."""
    p = F.lower(T.normal_path(F.col("path")))
    base = F.regexp_extract(p, "([^/]*)$", 1)
    e = events.filter("family = 'file_read' and path is not null")
    named = base.isin(*documents) & (p.rlike("(^|/)docs/") | (base == "readme.md"))
    return e.select("session_id", "turn", "pos", "path", named.alias("document"), p.rlike(logs).alias("log"), p.rlike("(^|/)(docs|spec)/").alias("in_docs"))


def labels(events: DataFrame) -> DataFrame:
    """A short label of each call by its id: its command, path or name, at most 40 characters."""
    return events.filter("tool_use_id is not null").groupBy("tool_use_id").agg(F.max_by(F.substring(F.coalesce("command", "path", "query", "tool", F.lit("tool")), 1, 40), F.struct("session_id", "turn", "pos")).alias("label"))


def causal_failures(events: DataFrame, weight: int = 3) -> DataFrame:
    """Failing results as `call>first line`, by session, with how often each came up and its weight."""
    e = events.filter(T.has_error(F.col("raw")))
    first = F.get(F.filter(T.lines(F.col("raw")), lambda x: F.trim(x) != ""), F.lit(0))
    label = F.substring(F.regexp_replace(F.concat_ws(">", F.substring(F.coalesce("command", "path", "query", "tool", F.lit("tool")), 1, 40), F.substring(F.trim(first), 1, 50)), r"\s+", "_"), 1, 60)
    return e.groupBy("session_id", label.alias("failure")).agg(F.count("*").alias("n"), (F.count("*") * weight).alias("weight"))


def rewrite_skips(turns: DataFrame, density: float = 0.35, heavy: int = 800) -> DataFrame:
    """Per session why its history would not be rewritten: many results for its messages, many calls, or heavy results."""
    from .events import once

    t = once(turns.select("session_id", "turn_index", "ingest_id", "tool_uses", "tool_results"))
    fam = F.transform("tool_uses", lambda u: T.family(u["name"]))
    of = lambda f: F.size(F.filter(fam, lambda x: x == f))
    per = t.groupBy("session_id").agg(
        F.sum(F.lit(2)).alias("n_messages"), F.sum(F.greatest(F.size("tool_uses"), F.lit(0))).alias("n_uses"), F.sum(F.greatest(F.size("tool_results"), F.lit(0))).alias("n_results"), F.sum(of("file_read")).alias("n_reads"), F.sum(of("command")).alias("n_commands"),
        F.sum(F.size(F.filter("tool_results", lambda r: F.length(r["content"]) > heavy))).alias("n_heavy"),
    )
    reason = (
        F.when((F.col("n_results") / F.col("n_messages") >= density) & (F.col("n_results") >= 8), "tool_density_high").when(F.col("n_uses") >= 10, "tool_use_count_high")
        .when((F.col("n_reads") >= 6) & (F.col("n_commands") >= 5), "file_and_command_heavy").when(F.col("n_heavy") >= 6, "tool_volume_heavy").otherwise("")
    )
    return per.select("session_id", "n_uses", "n_results", "n_reads", "n_commands", "n_heavy", reason.alias("reason"), (reason == "tool_volume_heavy").alias("skip"))


def trackers(events: DataFrame) -> DataFrame:
    """How often a call's very arguments and its target came up before in the session, and its equals within the same turn."""
    from .events import with_target

    e = with_target(events).filter("family is not null").withColumn("call", F.concat_ws("|", "tool", arguments(F.col("args"))))
    before = lambda *key: F.row_number().over(W.partitionBy("session_id", *key).orderBy("turn", "pos")) - 1
    return e.select("session_id", "turn", "pos", before("call").alias("n_same_call"), before("target").alias("n_same_target"), (F.count("*").over(W.partitionBy("session_id", "turn", "call")) - 1).alias("n_in_turn"))
