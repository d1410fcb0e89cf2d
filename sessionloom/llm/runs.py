"""Runs of equal consecutive tool uses, each collapsed into one event with its count and duration.

A use's value is its tool's family and the file its path denotes. Per session, the difference between a use's row
number and its row number among uses of the same value is constant within a run and nowhere else.

So that one session may hold any share of the rows, a session is cut into stretches of `stretch` turn numbers; row
numbers are taken within a stretch, and only the first and last run of each stretch, at most two rows, meet in a
window over the session, where runs that go on across a cut are joined.

Cases. Redelivered turns, (session_id, turn_index), count once. A use that is null, has no name, or whose path is
missing or blank is in no run and ends the run before it. Tools of no known family are a family of their own under
their simplified name. A null workspace_root leaves relative paths relative. Turns without uses and gaps in turn_index
don't end a run. Rows whose session_id or turn_index is null have no place in a sequence and are left out. Empty
tables give no runs; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

STRETCH = 2048


def tool_key(name: Column) -> Column:
    """A tool's name in one spelling: ReadFile, READ-FILE and read_file are equal."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.trim(name), r"([a-z0-9])([A-Z])", "$1_$2")), r"[^a-z0-9]+", "_")


def file_key(path: Column, root: Column) -> Column:
    """The file a path denotes, as an absolute path: slashes either way, file: addresses, ., .., doubled slashes."""
    p = F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), r"^(?i:file:)(?://(?:localhost)?(?=/))?", "")
    absolute = F.when(p.startswith("/") | p.rlike("^[A-Za-z]:/"), p).otherwise(F.concat(F.coalesce(F.regexp_replace(root, r"\\", "/"), F.lit("")), F.lit("/"), p))
    parts = F.filter(F.split(absolute, "/"), lambda s: (s != "") & (s != "."))
    walked = F.aggregate(
        parts,
        F.expr("cast(array() as array<string>)"),
        lambda done, s: F.when(s != "..", F.concat(done, F.array(s))).otherwise(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))),
    )
    odd = absolute.rlike(r"//|/\.\.?(/|$)|/$|^[^/]")
    return F.when(odd, F.concat(F.lit("/"), F.array_join(walked, "/"))).otherwise(absolute)


def values(turns: DataFrame, families: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """One row per tool use: session_id, part, turn, pos, at, value (null when the use can be in no run).

    families may list any number of tools: it is joined, and of a tool in several families the first counts.
    """
    known = families.filter("tool_name is not null and family is not null").groupBy(tool_key(F.col("tool_name")).alias("name")).agg(F.min("family").alias("family"))
    part = F.floor(F.col("turn_index") / stretch).cast("int")
    uses = turns.filter("session_id is not null and turn_index is not null and size(tool_uses) > 0").select(
        "session_id", part.alias("part"), F.col("turn_index").alias("turn"), F.col("recorded_at").alias("at"), "workspace_root", F.posexplode("tool_uses").alias("pos", "use")
    )
    path = F.coalesce(F.element_at("use.input", "path"), F.element_at("use.input", "file_path"))
    plain = uses.select("session_id", "part", "turn", "at", "pos", tool_key(F.col("use.name")).alias("name"), F.when(F.trim(path) != "", file_key(path, F.col("workspace_root"))).alias("file"))
    named = plain.join(known, "name", "left").withColumn("value", F.concat(F.coalesce("family", F.concat(F.lit("\x01"), "name")), F.lit("\x00"), "file"))
    return named.select("session_id", "part", "turn", "at", "pos", "value").repartition("session_id", "part").dropDuplicates(["session_id", "part", "turn", "pos"])


def runs(turns: DataFrame, families: DataFrame, least: int = 2, stretch: int = STRETCH) -> DataFrame:
    """Maximal runs of `least` or more equal uses: session_id, first_turn, first_pos, last_turn, last_pos, n_uses, started_at, ended_at, seconds."""
    own = W.partitionBy("session_id", "part")
    ordered, alike = own.orderBy("turn", "pos"), W.partitionBy("session_id", "part", "value").orderBy("turn", "pos")
    numbered = values(turns, families, stretch).withColumn("rn", F.row_number().over(ordered)).withColumn("island", F.col("rn") - F.row_number().over(alike))
    local = numbered.groupBy("session_id", "part", "value", "island").agg(
        F.min(F.struct("turn", "pos")).alias("first"), F.max(F.struct("turn", "pos")).alias("last"), F.count("*").alias("n"), F.min("at").alias("start"), F.max("at").alias("end"), F.min("rn").alias("rn0"), F.max("rn").alias("rn1")
    )
    local = local.withColumn("size", F.max("rn1").over(own))
    edge = (F.col("rn0") == 1) | (F.col("rn1") == F.col("size"))
    columns = ["session_id", "part", "value", "first", "last", "n", "start", "end"]
    inner = local.filter(~edge & F.col("value").isNotNull() & (F.col("n") >= least)).select(*columns)

    line = W.partitionBy("session_id").orderBy("part", "first")
    before_value, before_part = F.lag("value").over(line), F.lag("part").over(line)
    goes_on = F.coalesce((before_value == F.col("value")) & (before_part != F.col("part")), F.lit(False))
    edges = local.filter(edge).select(*columns).withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("chain", F.sum("new").over(line))
    joined = edges.groupBy("session_id", "chain").agg(
        F.first("value").alias("value"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.min("start").alias("start"), F.max("end").alias("end")
    )
    joined = joined.filter((F.col("n") >= least) & F.col("value").isNotNull())
    every = inner.drop("part", "value").unionByName(joined.drop("chain", "value"))
    seconds = (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 1e6
    return every.select(
        "session_id", F.col("first.turn").alias("first_turn"), F.col("first.pos").alias("first_pos"), F.col("last.turn").alias("last_turn"), F.col("last.pos").alias("last_pos"),
        F.col("n").alias("n_uses"), F.col("start").alias("started_at"), F.col("end").alias("ended_at"), seconds.alias("seconds"),
    )
