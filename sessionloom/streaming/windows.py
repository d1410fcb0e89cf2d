"""Event-time operators on streams; each returns a streaming frame, `drained` runs one over what is there."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import shared_folder


def tables(spark: SparkSession, folder: str, name: str, each: int | None = None) -> DataFrame:
    """A table, one parquet file or a folder of them, as a stream of its files, `each` of them in a micro-batch."""
    schema, place = spark.read.parquet(f"{folder}/{name}.parquet").schema, Path(f"{folder}/{name}.parquet")
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", each) if each else reader
    return reader.parquet(str(place)) if place.is_dir() else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def events(spark: SparkSession, folder: str, each: int | None = None) -> DataFrame:
    """The table events as a stream of its files."""
    return tables(spark, folder, "events", each).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums by event type in windows of fixed size; rows later than `late` are dropped once their window is closed."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Each user's sessions, ended by a gap without events."""
    w = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(stream: DataFrame, *keys: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def drained(stream: DataFrame, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """What the stream gives for all that is there now, written to and read from the shared folder.

    append: the rows of all micro-batches. complete: those of the last one. update: for each value of `keys` the rows
    of the last batch that had some.
    """
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys that later rows replace")
    spark, place = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    out, kind = f"{place}/out", stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    spark.createDataFrame([], kind).write.parquet(f"{out}/batch=-1")  # a stream without any batch gives no rows
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    rows = spark.read.schema(StructType([*kind.fields, StructField("batch", IntegerType())])).parquet(out)
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.filter(F.col("batch") == F.lit(last))
    elif mode == "update":
        rows = rows.join(rows.groupBy(*keys).agg(F.max("batch").alias("batch")), [*keys, "batch"], "left_semi")
    return rows.select(*kind.names)
