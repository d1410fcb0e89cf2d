"""Trace blocks: emitted from recorded events, read from lines, validated by rule, digested, and their deltas replayed."""

from __future__ import annotations

import json
import re
from hashlib import sha256
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window as W

from ..functions import text as T

# The version that blocks are emitted with, a parameter where they are audited. What the other members may be.
VERSION, UNCOMPUTED = "trace/v0.1", "draft-uncomputed"
DIRECTIONS = ("request", "response", "internal")
CLASSES = ("file", "search", "tool", "message", "system", "response")
ACTIONS = ("pass_through", "store", "reference", "delta", "fallback", "skeleton_reference", "summary_reference")
RESULTS = ("ok", "degraded", "error", "rejected")
RESOLVERS = ("available_local", "resolvable_remote", "missing_identifiable", "unresolvable_fallback_required")
EXPECTATIONS = ("accept_exact", "accept_reference", "accept_pass_through", "accept_delta", "accept_fallback", "reject_malformed", "accept_non_exact_reference")
ALGORITHMS = ("line", "unified_diff", "json_patch", "binary")
HASH = "^sha256:[0-9a-f]{64}$"

SCHEMA = (
    "envelope struct<trace_version: string, block_id: string, session_id: string, turn: bigint, step: bigint, direction: string, payload_digest: string>, observation struct<class: string, key: string, action: string, result: string>, "
    "content struct<exact: boolean, hash: string, size_bytes: bigint, resolver_uri: string, base_hash: string, delta_hash: string, delta_uri: string, delta_algorithm: string>, audit struct<resolver_state: string, expectation: string, reason: string>"
)


def emitted(events: DataFrame) -> DataFrame:
    """(session_id, turn, pos, line): one block without contents for each event, as JSON; its step is the event's place in its turn.

    A first result is stored, an equal one referred to, another one a delta; without a result, or with an error in it,
    the block says so.
    """
    e = events.withColumn("h", F.sha2("raw", 256)).withColumn("key", F.coalesce("path", "query", T.command_family(F.col("command"))))
    line = W.partitionBy("session_id", "family", "key").orderBy("turn", "pos")
    e = e.select("session_id", "turn", "pos", "tool_use_id", "family", "key", "h", F.octet_length("raw").alias("size"), T.has_error(F.col("raw")).alias("failed"), F.lag("h").over(line).alias("old"))
    missing, same = F.col("h").isNull(), F.col("h") == F.col("old")
    action = F.when(missing, "fallback").when(F.col("old").isNull(), "store").when(same, "reference").otherwise("delta")
    result = F.when(missing, "error").when(F.col("failed"), "degraded").otherwise("ok")
    tagged = lambda c: F.concat(F.lit("sha256:"), c)
    block = F.struct(
        F.struct(F.lit(VERSION).alias("trace_version"), F.concat_ws("/", "session_id", "turn", "pos").alias("block_id"), "session_id", "turn", F.col("pos").alias("step"), F.lit("response").alias("direction"), F.lit(UNCOMPUTED).alias("payload_digest")).alias("envelope"),
        F.struct(F.when(F.col("family").isin("file_read", "edit"), "file").when(F.col("family") == "search", "search").when(F.col("family").isNotNull(), "tool").alias("class"), F.col("key"), action.alias("action"), result.alias("result")).alias("observation"),
        F.struct(
            (~missing).alias("exact"), tagged(F.col("h")).alias("hash"), F.col("size").alias("size_bytes"), F.when(action.isin("store", "delta"), F.concat(F.lit("local:"), "tool_use_id")).alias("resolver_uri"),
            F.when(action == "delta", tagged(F.col("old"))).alias("base_hash"), F.when(action == "delta", tagged(F.sha2(F.concat("old", "h"), 256))).alias("delta_hash"), F.when(action == "delta", F.concat(F.lit("delta:"), "tool_use_id")).alias("delta_uri"), F.when(action == "delta", "unified_diff").alias("delta_algorithm"),
        ).alias("content"),
        F.struct(
            F.when(missing, "unresolvable_fallback_required").when(action == "reference", "resolvable_remote").otherwise("available_local").alias("resolver_state"),
            F.when(missing, "accept_fallback").when(action == "reference", "accept_reference").when(action == "delta", "accept_delta").otherwise("accept_exact").alias("expectation"), F.when(missing, "no_result").alias("reason"),
        ).alias("audit"),
    )
    return e.select("session_id", "turn", "pos", F.to_json(block).alias("line"))


def scanned(lines: DataFrame) -> DataFrame:
    """Lines (source, line_no, line) with their block, or why there is none; blank lines are left out."""
    kept = lines.filter("line is not null and trim(line) <> ''")
    doc = F.try_parse_json("line")
    kind = F.schema_of_variant(doc)
    inner = F.coalesce(F.try_variant_get(doc, "$.block", "string"), F.when(~kind.contains("block:"), F.col("line")))
    fault = F.when(doc.isNull(), "invalid_jsonl_line").when(~kind.startswith("OBJECT"), "jsonl_line_not_object").when(~F.coalesce(F.schema_of_variant(F.try_parse_json(inner)).startswith("OBJECT"), F.lit(False)), "missing_or_invalid_block")
    return kept.select("source", "line_no", F.from_json(F.when(fault.isNull(), inner), SCHEMA).alias("b"), fault.alias("fault"))


def _codes(b: Column, version: str) -> Column:
    """The codes of a block's faults, in the order of its sections."""
    e, o, c, a = b["envelope"], b["observation"], b["content"], b["audit"]
    no = lambda x: ~F.coalesce(x, F.lit(False))
    said = lambda x: F.coalesce(x, F.lit("")) != ""
    hashed = lambda x: F.coalesce(x.rlike(HASH), F.lit(False))
    local, exact, delta = a["resolver_state"] == "available_local", c["exact"], o["action"] == "delta"
    identity = hashed(c["hash"]) & F.coalesce(c["size_bytes"] >= 0, F.lit(False))
    expect, loose = lambda x: F.coalesce(a["expectation"] == x, F.lit(False)), o["action"].isin("skeleton_reference", "summary_reference")
    fallback = (o["action"] == "fallback") | o["result"].isin("degraded", "error", "rejected") | (a["resolver_state"] == "unresolvable_fallback_required")
    rules = {
        "invalid_trace_version": no(e["trace_version"] == version), "invalid_block_id": ~said(e["block_id"]), "invalid_session_id": ~said(e["session_id"]), "invalid_turn": no(e["turn"] >= 0), "invalid_step": no(e["step"] >= 0), "invalid_direction": no(e["direction"].isin(*DIRECTIONS)),
        "invalid_payload_digest": ~((F.coalesce(e["payload_digest"], F.lit("")) == UNCOMPUTED) | hashed(e["payload_digest"])), "invalid_class": no(o["class"].isin(*CLASSES)), "invalid_key": ~said(o["key"]), "invalid_action": no(o["action"].isin(*ACTIONS)), "invalid_result": no(o["result"].isin(*RESULTS)),
        "invalid_exact": exact.isNull(), "missing_or_invalid_content_identity": (exact | delta | local) & ~identity, "missing_or_invalid_base_hash": delta & ~hashed(c["base_hash"]), "missing_or_invalid_delta_hash": delta & ~hashed(c["delta_hash"]), "missing_or_invalid_delta_uri": delta & ~said(c["delta_uri"]),
        "missing_or_invalid_delta_algorithm": delta & no(c["delta_algorithm"].isin(*ALGORITHMS)), "non_exact_reference_marked_exact": loose & no(~exact), "invalid_resolver_state": no(a["resolver_state"].isin(*RESOLVERS)), "invalid_expectation": no(a["expectation"].isin(*EXPECTATIONS)),
        "reject_requires_rejected_result": expect("reject_malformed") & no(o["result"] == "rejected"), "accept_exact_requires_exact_local_content": expect("accept_exact") & no(exact & local), "accept_reference_requires_exact_reference": expect("accept_reference") & no(exact & (o["action"] == "reference")),
        "accept_non_exact_requires_non_exact_reference": expect("accept_non_exact_reference") & no(loose & ~exact), "accept_pass_through_requires_ok_pass_through": expect("accept_pass_through") & no((o["action"] == "pass_through") & (o["result"] == "ok") & ~exact), "accept_delta_requires_exact_local_delta": expect("accept_delta") & no(delta & exact & local),
        "accept_fallback_requires_fallback": expect("accept_fallback") & no(fallback), "ok_cannot_be_unresolvable": (o["result"] == "ok") & (a["resolver_state"] == "unresolvable_fallback_required"), "missing_reason": (fallback | (a["resolver_state"] == "missing_identifiable")) & ~said(a["reason"]), "available_local_missing_resolver": local & ~said(c["resolver_uri"]),
    }
    sections = F.array_compact(F.array(*[F.when(b[s].isNull(), f"missing_section:{s}") for s in ("envelope", "observation", "content", "audit")]))
    return F.when(F.size(sections) > 0, sections).otherwise(F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), code) for code, rule in rules.items()])))


def audited(lines: DataFrame, version: str = VERSION) -> DataFrame:
    """Each line's verdict and codes: fail over warn over pass; later blocks of one id, and those before their session's last place, fail too."""
    s = scanned(lines)
    e = F.col("b.envelope")
    at = F.struct(e["turn"].alias("turn"), e["step"].alias("step"))
    s = s.withColumn("nth", F.when(e["block_id"].isNotNull(), F.row_number().over(W.partitionBy(e["block_id"]).orderBy("source", "line_no"))))
    ordered = e["session_id"].isNotNull() & e["turn"].isNotNull() & e["step"].isNotNull()
    s = s.withColumn("before", F.when(ordered, F.lag(at).over(W.partitionBy(e["session_id"], ordered).orderBy("source", "line_no"))))
    codes = F.when(F.col("fault").isNotNull(), F.array("fault")).otherwise(_codes(F.col("b"), version))
    more = F.array_compact(F.array(F.when(F.col("nth") > 1, "duplicate_block_id"), F.when(at < F.col("before"), "out_of_order_trace_block")))
    a, digest = F.col("b.audit"), e["payload_digest"]
    warnings = F.array_compact(F.array(F.when(digest == UNCOMPUTED, "draft_payload_digest_uncomputed"), F.when(a["resolver_state"].isin(*RESOLVERS[2:]) | ((a["resolver_state"] == "resolvable_remote") & a["expectation"].isin("accept_reference", "accept_non_exact_reference", "accept_pass_through")), a["resolver_state"])))
    s = s.withColumn("errors", F.concat(codes, more)).withColumn("warnings", F.coalesce(warnings, F.array().cast("array<string>")))
    status = F.when(F.size("errors") > 0, "fail").when(F.size("warnings") > 0, "warn").otherwise("pass")
    return s.select("source", "line_no", e["block_id"].alias("block_id"), status.alias("status"), F.array_join(F.when(status == "fail", F.col("errors")).otherwise(F.col("warnings")), ",").alias("codes"))


def digest(block: str | None) -> str | None:
    """The digest of a block's stable sections, as JSON with sorted names; null for what is no block."""
    try:
        doc: Any = json.loads(block or "")
        payload = {k: doc[k] for k in ("observation", "content", "audit")} | ({"extensions": doc["extensions"]} if "extensions" in doc else {})
    except (ValueError, KeyError, TypeError):
        return None
    return "sha256:" + sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode("utf-8", "surrogatepass")).hexdigest()


@F.pandas_udf(StringType())
def digests(blocks: pd.Series) -> pd.Series:
    return blocks.map(digest)


_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@")


def replayed(base: str, delta: str) -> str:
    """base with a unified diff applied; ValueError where its context or removals don't stand in base."""
    old, out, at = base.split("\n"), [], 0
    rows = delta.split("\n")
    i = 0
    while i < len(rows):
        m = _HUNK.match(rows[i])
        i += 1
        if not m:
            continue
        first = int(m[1]) - (m[2] != "0")
        if first < at:
            raise ValueError("hunks out of order")
        out += old[at:first]
        at = first
        while i < len(rows) and rows[i][:1] in "+- " and rows[i]:
            mark, line = rows[i][0], rows[i][1:]
            if mark != "+":
                if at >= len(old) or old[at] != line:
                    raise ValueError("base differs")
                at += 1
            if mark != "-":
                out.append(line)
            i += 1
    return "\n".join(out + old[at:])


@F.pandas_udf(StringType())
def replays(old: pd.Series, diff: pd.Series, new: pd.Series) -> pd.Series:
    """match when the diff makes new of old, else what went wrong."""

    def one(a: str | None, d: str | None, b: str | None) -> str | None:
        if a is None or d is None or b is None:
            return None
        try:
            return "match" if replayed(a, d) == b else "differs"
        except ValueError as e:
            return str(e)

    return pd.Series([one(*x) for x in zip(old, diff, new)], dtype=object)


def delta_audit(events: DataFrame) -> DataFrame:
    """Rereads of a file that changed: whether the diff against the text before, replayed, gives the new text to the byte."""
    from .codecs import unified_lines

    e = events.filter("family = 'file_read' and raw is not null and path is not null")
    e = e.withColumn("old", F.lag("raw").over(W.partitionBy("session_id", "path").orderBy("turn", "pos"))).filter("old is not null and old <> raw")
    return e.withColumn("diff", unified_lines("old", "raw")).select("session_id", "turn", "pos", "path", replays("old", "diff", "raw").alias("outcome"))
