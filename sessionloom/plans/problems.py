"""Queries of the core's own problems: drifting schemas (p1) and nested records (p2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, unnest
from ..sources import table

BLOCK_KEYS = ("rec_key", "msg_pos", "block_pos", "sub_pos", "call_msg_pos", "call_block_pos")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "savings_files"), table(spark, d, "savings_records"))


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified(table(spark, d, "savings_files"), table(spark, d, "savings_records")).drop("others")


def p1_others(spark: SparkSession, d: str) -> DataFrame:
    """The values that p1_table has no column for."""
    return drift.others(table(spark, d, "savings_files"), table(spark, d, "savings_records"))


def p1_lifespans(spark: SparkSession, d: str) -> DataFrame:
    return drift.lifespans(table(spark, d, "savings_files"), table(spark, d, "savings_records"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    payloads = unnest.payload_blocks(table(spark, d, "replay_records"), bodies=False).select(*BLOCK_KEYS)
    return payloads.unionByName(unnest.turn_blocks(table(spark, d, "stress_turns")))


def p2_messages(spark: SparkSession, d: str) -> DataFrame:
    """Blocks with role, type and text, for those who want the contents too."""
    return unnest.payload_blocks(table(spark, d, "replay_records"))


def _p2(payloads: Callable[[DataFrame], DataFrame], turns: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A flat table over both sources."""
    return lambda spark, d: payloads(table(spark, d, "replay_records")).unionByName(turns(table(spark, d, "stress_turns")))


def p2_items(spark: SparkSession, d: str) -> DataFrame:
    """The items of results; those of recorded turns are strings and have none."""
    return unnest.payload_blocks(table(spark, d, "replay_records")).filter("sub_pos >= 0").select(*BLOCK_KEYS, "type", "body")


def _turn_results(turns: DataFrame) -> DataFrame:
    return unnest.turn_blocks(turns, bodies=True).filter("msg_pos = 1").select("rec_key", "msg_pos", "block_pos", "call_msg_pos", "call_block_pos", "tool_use_id", F.col("body").alias("content"))


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """The paths that the payloads have, by repeated ancestor: the tables and columns found in the data."""
    return unnest.path_catalogue(table(spark, d, "replay_records"))


# Messages, blocks, items and results point to their parents by the shorter key, results and items to their calls.
TABLES = {
    "p2_messages": _p2(unnest.payload_messages, unnest.turn_messages),
    "p2_all_blocks": _p2(lambda r: unnest.payload_blocks(r).filter("sub_pos < 0"), lambda t: unnest.turn_blocks(t, bodies=True)),
    "p2_members": _p2(unnest.payload_members, unnest.turn_members),
    "p2_items": p2_items,
    "p2_results": _p2(unnest.payload_contents, _turn_results),
}
QUERIES = TABLES | {"p1_found": p1_found, "p1_table": p1_table, "p1_others": p1_others, "p1_lifespans": p1_lifespans, "p2_found": p2_found, "p2_blocks": p2_messages, "p2_paths": p2_paths}
ORACLES: dict[str, str] = {}
