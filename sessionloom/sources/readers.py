"""Files that are no parquet: replayed conversations with their sidecars, logs, ledgers, code, event streams; and their writers.

Readers take a folder or file name and give rows with the file they come from; what can't be read is a row that says so.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for written tables in the folder all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _stem() -> Column:
    return F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1), r"\.jsonl(\.meta\.json)?$", "")


def replay_lines(spark: SparkSession, place: str) -> DataFrame:
    """(fixture, line) of each line of *.jsonl that isn't blank; a folder fixture=NAME names it too."""
    lines = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").text(place)
    named = F.regexp_extract(F.col("_metadata.file_path"), r"/fixture=([^/]*)/", 1)
    return lines.select(F.when(named != "", named).otherwise(_stem()).alias("fixture"), F.col("value").alias("line")).filter(F.trim("line") != "")


def replay_meta(spark: SparkSession, place: str, schema: str) -> DataFrame:
    """(fixture, ...) of the sidecars NAME.jsonl.meta.json, a missing member as null."""
    docs = spark.read.option("pathGlobFilter", "*.meta.json").option("recursiveFileLookup", "true").option("wholetext", "true").text(place)
    return docs.select(_stem().alias("fixture"), F.from_json("value", schema).alias("m")).select("fixture", "m.*")


def record_shape(line: Column) -> Column:
    """messages, message or damaged, by the members of a record's JSON, which may be a JSON string that holds it."""
    doc = F.try_parse_json(line)
    inner = F.coalesce(F.try_parse_json(F.try_variant_get(doc, "$", "string")), doc)
    kind = F.schema_of_variant(inner)
    return F.when(F.try_variant_get(inner, "$.messages", "array<variant>").isNotNull(), "messages").when(kind.startswith("OBJECT") & (kind.rlike("[<, ](role|content): ")), "message").otherwise("damaged")


def write_replay(records: DataFrame, meta: DataFrame, place: str) -> None:
    """Records (fixture, line) as JSONL files by fixture, and a sidecar for each row of meta."""
    records.select("fixture", "line").write.mode("overwrite").partitionBy("fixture").option("compression", "none").text(f"{place}/records")
    for path in _parts(records.sparkSession, f"{place}/records"):
        _rename(records.sparkSession, path, path + ".jsonl")
    rows = [r for r in meta.select("fixture", F.to_json(F.struct(*[c for c in meta.columns if c != "fixture"])).alias("json")).limit(10_000).collect()]
    for r in rows:  # one small file each, at most 10,000
        _write(records.sparkSession, f"{place}/meta/{r.fixture}.jsonl.meta.json", r.json)


def _fs(spark: SparkSession, path: str):  # type: ignore[no-untyped-def]
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _parts(spark: SparkSession, place: str) -> list[str]:
    p, fs = _fs(spark, place)
    found, walk = [], fs.listFiles(p, True)
    while walk.hasNext():
        name = walk.next().getPath().toString()
        if name.rsplit("/", 1)[-1].startswith("part-") and not name.endswith((".crc", ".jsonl")):
            found.append(name)
    return found


def _rename(spark: SparkSession, old: str, new: str) -> None:
    p, fs = _fs(spark, old)
    fs.rename(p, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new))


def _write(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


# ---- lines of statistics ----------------------------------------------------------------------------------------


def model_line(model: Column, counts: dict[str, Column], breakdown: dict[str, Column]) -> Column:
    """` m:model|k:v|breakdown:a=1,b=2`: counters of a model as one line; nulls are left out."""
    pair = lambda k, v, sep: F.when(v.isNotNull(), F.concat(F.lit(f"{k}{sep}"), v.cast("string")))
    inner = F.concat_ws(",", *[pair(k, v, "=") for k, v in breakdown.items()])
    return F.concat(F.lit(" "), F.concat_ws("|", F.concat(F.lit("m:"), model), *[pair(k, v, ":") for k, v in counts.items()], F.when(inner != "", F.concat(F.lit("breakdown:"), inner))))


def parse_model_line(line: Column) -> Column:
    """struct<model, counts map<string,bigint>, breakdown map<string,bigint>>; null for a line of another shape."""
    pieces = F.split(F.trim(line), r"\|")
    field = lambda p: F.struct(F.substring_index(p, ":", 1).alias("k"), F.regexp_replace(p, "^[^:]*:", "").alias("v"))
    rest = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), field)
    counts = F.map_from_entries(F.transform(F.filter(rest, lambda e: e["k"] != "breakdown"), lambda e: F.struct(e["k"], e["v"].try_cast("bigint"))))
    inner = F.get(F.filter(rest, lambda e: e["k"] == "breakdown"), F.lit(0))["v"]
    parts = F.transform(F.filter(F.split(F.coalesce(inner, F.lit("")), ","), lambda x: x != ""), lambda x: F.struct(F.substring_index(x, "=", 1), F.substring_index(x, "=", -1).try_cast("bigint")))
    return F.when(F.get(pieces, F.lit(0)).startswith("m:"), F.struct(F.substring(F.get(pieces, F.lit(0)), 3, 1 << 20).alias("model"), counts.alias("counts"), F.map_from_entries(parts).alias("breakdown")))


TOTALS, LOG = "@lifetime_savings", "@per_session_log"


def ledger_text(totals: DataFrame, log: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, text): the two-section ledger of each key: totals as name:value, then a line of values for each session by date and id."""
    t = totals.select(key, F.array_join(F.transform(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in totals.columns if c != key]), lambda e: F.concat(e["k"], F.lit(":"), F.coalesce(e["v"], F.lit("")))), "\n").alias("head"))
    rows = log.select(key, F.struct(F.concat_ws(";", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("row")).alias("r"))
    body = rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["row"]), "\n").alias("body"))
    return t.join(body, key, "left").select(key, F.concat_ws("\n", F.lit(TOTALS), "head", F.lit(LOG), "body").alias("text"))


def parse_ledger(texts: DataFrame, key: str) -> DataFrame:
    """(key, section, line_no, name, value) of two-section ledgers: a line belongs to the last section begun before it; of log lines the fields."""
    lines = texts.select(key, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    upto = W.partitionBy(key).orderBy("line_no")
    section = F.last(F.when(F.col("line").startswith("@"), F.substring("line", 2, 100)), ignorenulls=True).over(upto)
    s = lines.withColumn("section", section).filter(~F.col("line").startswith("@") & (F.trim("line") != "") & F.col("section").isNotNull())
    total = F.array(F.struct(F.substring_index("line", ":", 1).alias("name"), F.regexp_replace("line", "^[^:]*:", "").alias("value")))
    fields = F.transform(F.split("line", ";"), lambda v, i: F.struct(i.cast("string").alias("name"), v.alias("value")))
    return s.select(key, "section", "line_no", F.inline(F.when(F.col("section") == TOTALS[1:], total).otherwise(fields)))


def log_counters(texts: DataFrame, text: str = "raw") -> DataFrame:
    """name=number counters mined from log texts: how often each stands, their sum, least and most."""
    pairs = texts.select(F.explode(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z_]\w*=[0-9]+)\b"))).alias("p"))
    split = pairs.select(F.substring_index("p", "=", 1).alias("name"), F.substring_index("p", "=", -1).cast("bigint").alias("v"))
    return split.groupBy("name").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"))


# ---- event streams ----------------------------------------------------------------------------------------------


def to_sse(messages: DataFrame, part: int = 40) -> DataFrame:
    """(id, text) from (id, model, blocks array<struct<type, text>>): the server events of each message, its texts in pieces of `part` characters."""
    event = lambda **f: F.concat(F.lit("data: "), F.to_json(F.struct(*[v.alias(k) for k, v in f.items()])))
    one = lambda b, i: F.concat(
        F.array(event(type=F.lit("content_block_start"), index=i, block=F.struct(b["type"].alias("type")))),
        F.transform(F.filter(F.sequence(F.lit(0), F.floor(F.greatest(F.length(b["text"]) - 1, F.lit(0)) / part).cast("int")), lambda k: F.length(b["text"]) > 0), lambda k: event(type=F.lit("content_block_delta"), index=i, delta=F.substring(b["text"], k * part + 1, F.lit(part)))),
        F.array(event(type=F.lit("content_block_stop"), index=i)),
    )
    body = F.flatten(F.transform("blocks", one))
    return messages.select("id", F.array_join(F.concat(F.array(event(type=F.lit("message_start"), model=F.col("model"))), body, F.array(F.lit("data: [DONE]"))), "\n\n").alias("text"))


def from_sse(streams: DataFrame) -> DataFrame:
    """(id, model, index, type, text): the content blocks that a stream of server events builds, in order; broken events are passed over."""
    events = streams.select("id", F.posexplode(F.split("text", r"\n\n")).alias("n", "event")).filter(F.col("event").startswith("data: {"))
    e = events.select("id", "n", F.from_json(F.substring("event", 7, 1 << 30), "type string, model string, index int, block struct<type: string>, delta string").alias("e")).select("id", "n", "e.*")
    model = e.groupBy("id").agg(F.max("model").alias("model"))
    blocks = e.filter("index is not null").groupBy("id", "index").agg(F.max("block.type").alias("type"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("delta").isNotNull(), F.struct("n", "delta")))), lambda x: x["delta"]), "").alias("text"))
    return blocks.join(model, "id").select("id", "model", "index", "type", "text")


# ---- code and state ---------------------------------------------------------------------------------------------


def code_files(spark: SparkSession, place: str, glob: str = "*.py", without: str = r"(^|/)(\.venv|node_modules|build|dist)/|(^|/)(test_[^/]*|conftest)\.py$") -> DataFrame:
    """(path, text) of the code files below a folder, tests and built trees left out."""
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("wholetext", "true").text(place)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).filter(~F.col("path").rlike(without))


def large_files(files: DataFrame, least: int = 500) -> DataFrame:
    """Files of more than `least` lines."""
    return files.select("path", F.size(F.split("text", "\n")).alias("n_lines")).filter(F.col("n_lines") > least)


def save_state(state: DataFrame, place: str) -> None:
    """A snapshot of session state (session_id, key, value, at), replaced as a whole."""
    state.write.mode("overwrite").parquet(place)


def load_state(spark: SparkSession, place: str, now: Column, seconds: int = 1800) -> DataFrame:
    """The snapshot's entries that haven't expired at `now`."""
    return spark.read.parquet(place).filter(F.unix_timestamp(now) - F.unix_timestamp("at") <= seconds)
