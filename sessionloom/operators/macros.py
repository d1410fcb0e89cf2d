"""Workflows that sessions repeat: instructions mined as sequences with their data flow, registered, matched and expanded.

An instruction is an event with its operation (read, search, edit, shell) and argument. In a sequence, (i, j) is an
edge when the argument at j was last used at i. Sequences of two and three are counted by operations and edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from .stretches import ahead, numbered, parted

# The operation of each family of tools, and the tool that does it.
OPERATIONS = {"file_read": "read", "search": "search", "edit": "edit", "command": "shell"}
TOOLS = {"read": ("read_file", "path"), "search": ("grep_search", "query"), "edit": ("edit", "path"), "shell": ("bash", "command")}


def instructions(events: DataFrame) -> DataFrame:
    """(session_id, turn, pos, op, arg) of each event that does something."""
    op = F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv])[F.col("family")]
    arg = F.when(F.col("family") == "search", F.col("query")).when(F.col("family") == "command", T.command_family(F.col("command"))).otherwise(F.col("path"))
    return events.select("session_id", "turn", "pos", op.alias("op"), F.coalesce(arg, F.lit("")).alias("arg")).filter("op is not null")


def batches(ins: DataFrame) -> DataFrame:
    """Runs of one operation in a turn as one instruction with its arguments joined."""
    own = W.partitionBy("session_id", "turn").orderBy("pos")
    new = ins.withColumn("new", F.when(F.lag("op").over(own) == F.col("op"), 0).otherwise(1)).withColumn("k", F.sum("new").over(own))
    per = new.groupBy("session_id", "turn", "k").agg(F.first("op").alias("op"), F.min("pos").alias("pos"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "arg"))), lambda x: x["arg"]), ",").alias("args"))
    return per.select("session_id", "turn", "pos", "op", "n", "args")


def _edges(args: Column, n: int) -> Column:
    """The edges of a sequence: for each place the last one before it with the same argument."""
    found = []
    for j in range(1, n):
        out = None
        for i in range(j - 1, -1, -1):
            same = (args[i] == args[j]) & (args[j] != "")
            out = F.when(same, f"{i}->{j}") if out is None else out.when(same, f"{i}->{j}")
        found.append(out)
    return F.array_join(F.array_compact(F.array(*found)), "|")


def _sequences(ins: DataFrame, sizes: Sequence[int] = (2, 3)) -> DataFrame:
    longest = max(sizes)
    e = ahead(parted(ins, "turn"), "session_id", ("turn", "pos"), ("op", "arg"), longest - 1)
    e = e.withColumn("ops", F.concat(F.array("op"), F.col("next.op"))).withColumn("args", F.concat(F.array("arg"), F.col("next.arg")))
    each = F.array(*[F.when(F.col("ops")[n - 1].isNotNull(), F.struct(F.lit(n).alias("size"), F.array_join(F.slice("ops", 1, n), " > ").alias("ops"), _edges(F.col("args"), n).alias("edges"), F.slice("args", 1, n).alias("args"))) for n in sizes])
    return e.select("session_id", "turn", "pos", F.inline(F.array_compact(each)))


def mined(ins: DataFrame, least: int = 3) -> DataFrame:
    """Frequent sequences by operations and edges that stand in no longer frequent one, with the arguments they share as parameters."""
    found = _sequences(ins)
    first = F.min_by(F.size(F.array_distinct(F.filter("args", lambda a: a.contains("/")))), F.struct("session_id", "turn", "pos"))
    counted = found.groupBy("ops", "edges", "size").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("n_sessions"), first.alias("n_parameters")).filter(F.col("n") >= least)
    inner = counted.filter("size > 2").select(F.explode(F.array(F.regexp_extract("ops", "^(.*) > [^>]*$", 1), F.regexp_extract("ops", "^[^>]* > (.*)$", 1))).alias("ops")).distinct()
    return counted.join(inner, "ops", "left_anti").select("ops", "edges", "size", "n", "n_sessions", "n_parameters")


def registered(macros: DataFrame) -> DataFrame:
    """One macro for each sequence of operations: of several the most frequent, then the one with fewer edges, by name."""
    best = macros.groupBy("ops").agg(F.min_by(F.struct("edges", "size", "n", "n_sessions", "n_parameters"), F.struct(-F.col("n"), F.length("edges"), F.col("edges"))).alias("m"), F.count("*").alias("n_forms"))
    return best.select(F.concat(F.lit("macro_"), F.substring(F.sha2("ops", 256), 1, 8)).alias("name"), "ops", "m.*", "n_forms")


def matched(ins: DataFrame, macros: DataFrame) -> DataFrame:
    """For each session the longest macro that its last instructions end with."""
    n = numbered(parted(ins, "turn"), "session_id", ("turn", "pos"), "i")
    last = n.groupBy("session_id").agg(F.max("i").alias("n"))
    tail = n.join(last, "session_id").filter("i > n - 3").groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "op"))), lambda x: x["op"]).alias("ops"))
    ends = tail.select("session_id", F.explode(F.array_compact(F.array(*[F.when(F.size("ops") >= k, F.array_join(F.slice("ops", F.size("ops") - k + 1, F.lit(k)), " > ")) for k in (2, 3)]))).alias("ops"))
    hit = ends.join(macros.select("ops", "name", "size"), "ops")
    return hit.groupBy("session_id").agg(F.max_by("name", F.struct("size", "name")).alias("name"), F.max("size").alias("size"))


def uses(ins: DataFrame, macros: DataFrame, events: DataFrame) -> DataFrame:
    """Each macro's uses: how often, when last, how many tokens the results of its steps had, by session rolled up."""
    found = _sequences(ins).join(macros.select("ops", "name"), "ops").select("session_id", "turn", "pos", "name")
    size = events.select("session_id", "turn", "pos", F.to_date("recorded_at").alias("day"), T.token_estimate(F.col("raw")).alias("n_tokens"))
    return found.join(size, ["session_id", "turn", "pos"]).groupBy("name").agg(F.count("*").alias("hits"), F.count_distinct("session_id").alias("n_sessions"), F.max("day").alias("last_seen"), F.sum("n_tokens").alias("saved"))


def kept(used: DataFrame, days: int = 7, hits: int = 3, worth: int = 50) -> DataFrame:
    """Macros after decay: old and rarely used ones go, unless they saved `worth` tokens or more; age counts from the newest use."""
    newest = used.agg(F.max("last_seen")).first()[0]
    aged = used.withColumn("age", F.date_diff(F.lit(newest).cast("date"), "last_seen"))
    return aged.withColumn("keep", ~((F.col("age") > days) & (F.col("hits") < hits) & (F.col("saved") < worth)))


def expanded(calls: DataFrame, macros: DataFrame) -> DataFrame:
    """(call_id, step, tool, argument, value) of calls (call_id, name, arg) of macros: one tool call for each operation, each with the argument."""
    tools = F.create_map(*[F.lit(x) for op, (tool, _) in TOOLS.items() for x in (op, tool)])
    names = F.create_map(*[F.lit(x) for op, (_, name) in TOOLS.items() for x in (op, name)])
    steps = calls.join(macros.select("name", "ops"), "name").select("call_id", "arg", F.posexplode(F.split("ops", " > ")).alias("step", "op"))
    return steps.select("call_id", "step", tools[F.col("op")].alias("tool"), names[F.col("op")].alias("argument"), F.col("arg").alias("value"))


def hints(ins: DataFrame, macros: DataFrame) -> DataFrame:
    """For each session and macro the last place it was done, told as what was searched, read and run there."""
    e = ahead(parted(ins, "turn"), "session_id", ("turn", "pos"), ("op", "arg"), 2)
    step = F.concat(F.array(F.struct("op", "arg")), "next")
    seq = e.select("session_id", "turn", "pos", F.explode(F.array(*[F.struct(F.array_join(F.slice(step, 1, n)["op"], " > ").alias("ops"), F.slice(step, 1, n).alias("steps")) for n in (2, 3)])).alias("s")).select("session_id", "turn", "pos", "s.*").filter(F.forall("steps", lambda x: x["op"].isNotNull()))
    last = seq.join(macros.select("ops", "name"), "ops").groupBy("session_id", "name").agg(F.max_by("steps", F.struct("turn", "pos")).alias("steps"))
    of = lambda *ops: F.array_join(F.array_distinct(F.filter(F.transform(F.filter("steps", lambda x: x["op"].isin(*ops)), lambda x: x["arg"]), lambda a: a != "")), ", ")
    part = lambda label, text: F.when(text != "", F.concat(F.lit(label), text))
    told = F.concat_ws("; ", part("searched ", of("search")), part("read ", of("read", "edit")), part("ran ", of("shell")))
    return last.select("session_id", "name", told.alias("hint")).filter("hint <> ''")


def credited(lines: DataFrame, used: DataFrame) -> DataFrame:
    """Tokens credited to the macros that state lines (session_id, line) name as @name."""
    named = lines.select("session_id", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit("@(macro_[0-9a-f]{8})")))).alias("name"))
    return named.join(used.select("name", "hits", "saved"), "name").groupBy("name").agg(F.count("*").alias("n_lines"), F.sum(F.expr("saved div hits")).alias("credited"))
