"""What repeated results could have saved: each observation against the earlier ones of its session, and the sums over them.

An observation is one tool result with the call it answers, where its turn has that call. Digests are taken before
anything is exchanged; no window carries a text. A turn's own signals say whether it was sent as it was
(`REVERTED`) or whether its history couldn't be cut (`BLOCKED`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from .events import once, target
from .identities import arguments

REVERTED, BLOCKED = "fail_open_compat_response", "non_tok_response"
LEAST, STUB, THRESHOLDS = 200, 36, (64, 96, 128)
# Reasons of a miss, in the order in which they are looked for.
REASONS = ("preflight_reverted", "history_winnowing_blocked", "context_missing", "identity_changed", "first_seen", "below_min_chars", "volatile_only_change", "exact_content_changed")
STRUCTURAL = REASONS[:2]


def observations(turns: DataFrame) -> DataFrame:
    """One row per tool result: its text's digests and size, its call's identity and target, and its turn's signals."""
    t = once(turns.select("session_id", "turn_index", "ingest_id", "workspace_root", "tool_uses", "tool_results", "input_behavior_signals"))
    signal = lambda name: F.coalesce(F.element_at("input_behavior_signals", F.lit(name)) > 0, F.lit(False))
    r = t.select("session_id", F.col("turn_index").alias("turn"), "workspace_root", "tool_uses", signal(REVERTED).alias("reverted"), signal(BLOCKED).alias("blocked"), F.posexplode("tool_results").alias("pos", "r"))
    use = F.try_element_at(F.filter("tool_uses", lambda u: u["id"] == F.col("r.tool_use_id")), F.lit(-1))
    r = r.select("session_id", "turn", "pos", "workspace_root", "reverted", "blocked", F.col("r.tool_use_id").alias("tool_use_id"), F.col("r.content").alias("raw"), use.alias("u")).filter("raw is not null")
    args = F.coalesce(F.col("u.input"), F.expr("cast(map() as map<string,string>)"))
    missing = F.col("u.id").isNull()
    fam = F.when(missing, "missing").otherwise(F.coalesce(T.family(F.col("u.name")), F.lit("unknown")))
    about = F.when(missing, "missing").otherwise(target(fam, T.plain_path(T.path_argument(args), F.col("workspace_root")), T.query_argument(args), T.command_argument(args)))
    return r.select(
        "session_id", "turn", "pos", "tool_use_id", "reverted", "blocked", missing.alias("context_missing"), fam.alias("family"), F.concat_ws("|", fam, F.when(missing, "").otherwise(arguments(args))).alias("identity"),
        F.concat_ws("|", fam, about).alias("logical"), T.digest(F.col("raw")).alias("h"), T.digest(T.canonical(F.col("raw"), F.col("workspace_root"))).alias("c"), F.length("raw").alias("n_chars"),
    )


def opportunities(turns: DataFrame) -> DataFrame:
    """Each observation with its repeat class, what the current strategy saves of it, why more was missed and what could be saved."""
    o = observations(turns)
    before = lambda value, *key: F.lag(value).over(W.partitionBy("session_id", *key).orderBy("turn", "pos"))
    earlier = W.partitionBy("session_id", "family", "c").orderBy("turn", "pos").rowsBetween(W.unboundedPreceding, -1)
    o = o.select(
        "*", before("h", "identity").alias("ih"), before("c", "identity").alias("ic"), before("h", "logical").alias("lh"), before("c", "logical").alias("lc"), before("family", "h").alias("rf"),
        F.coalesce((F.min("identity").over(earlier) != F.col("identity")) | (F.max("identity").over(earlier) != F.col("identity")), F.lit(False)).alias("other_identity"),
    )
    yes = lambda c: F.coalesce(c, F.lit(False))
    h, c = F.col("h"), F.col("c")
    crossed = yes((F.col("rf") != F.col("family")) & F.col("rf").isNotNull())
    o = o.withColumn("exact", yes(F.col("ih") == h) | yes(F.col("lh") == h) | crossed).withColumn("canonical", yes(F.col("ic") == c) | yes(F.col("lc") == c))
    repeat = (
        F.when(F.col("ih").isNotNull(), F.when((F.col("ic") == c) & (F.col("ih") != h), "canonical_repeat").otherwise("same_identity_repeat"))
        .when(F.col("lh").isNotNull(), F.when((F.col("lc") == c) & (F.col("lh") != h), "canonical_repeat").otherwise("alias_repeat"))
        .when(crossed, "cross_tool_same_output")
        .otherwise("first_seen")
    )
    outcome = F.when(yes(F.col("ih") == h), F.when(F.col("n_chars") >= LEAST, "exact_dedup_hit").otherwise("cache_hit")).when(F.col("ih").isNotNull() & F.col("family").isin("file_read", "search"), "diff_compression").otherwise("no_compression")
    stub = F.greatest(F.lit(0), F.col("n_chars") - STUB)
    o = o.withColumn("repeat_class", repeat).withColumn("outcome", outcome).withColumn("stub", stub).withColumn("saved", F.when(F.col("outcome").isin("exact_dedup_hit", "cache_hit"), F.col("stub")).otherwise(0))
    reason = (
        F.when(F.col("outcome") == "exact_dedup_hit", None).when(F.col("reverted") & F.col("exact"), "preflight_reverted").when(F.col("blocked") & F.col("exact"), "history_winnowing_blocked").when(F.col("context_missing"), "context_missing")
        .when(F.col("repeat_class") == "first_seen", F.when(F.col("other_identity"), "identity_changed").otherwise("first_seen")).when(F.col("n_chars") < LEAST, "below_min_chars")
        .when(F.col("repeat_class") == "canonical_repeat", "volatile_only_change").when(~F.col("exact"), "exact_content_changed")
    )
    o = o.withColumn("miss_reason", reason)
    known = F.col("family").isin("file_read", "search", "command")
    tried = F.array_compact(
        F.array(
            *[F.when((F.col("family") == "file_read") & F.col("exact") & (F.col("n_chars") >= n), F.struct(F.col("stub").alias("saved"), F.lit(f"file_threshold_{n}").alias("name"))) for n in THRESHOLDS],
            F.when(F.col("family").isin("file_read", "search") & (F.col("repeat_class") == "alias_repeat") & F.col("exact"), F.struct(F.col("stub").alias("saved"), F.lit("alias_key").alias("name"))),
            F.when(known & (F.col("repeat_class") == "canonical_repeat") & F.col("canonical"), F.struct(F.col("stub").alias("saved"), F.lit("canonical_hash").alias("name"))),
            F.when(known & F.col("exact") & (F.col("n_chars") >= LEAST), F.struct(F.greatest("saved", "stub").alias("saved"), F.lit("shorter_form").alias("name"))),
        )
    )
    o = o.withColumn("candidates", tried).withColumn("best", F.array_max(F.filter("candidates", lambda x: x["saved"] > F.col("saved"))))
    small = F.when(F.col("family") == "file_read", "small_file_repeat").when(F.col("family") == "search", "small_search_repeat").when(F.col("family") == "command", "small_command_repeat")
    kind = (
        F.when(F.col("repeat_class") == "canonical_repeat", "volatile_repeat").when(F.col("repeat_class").isin("alias_repeat", "cross_tool_same_output"), "alias_miss").when(F.col("miss_reason").isin(*STRUCTURAL), "structural_cliff")
        .when(F.col("repeat_class") == "first_seen", None).otherwise(F.when(F.col("n_chars") < LEAST, F.coalesce(small, F.lit("large_exact_repeat"))).otherwise("large_exact_repeat"))
    )
    o = o.withColumn("opportunity_class", kind).withColumn("headroom", F.coalesce(F.col("best.saved") - F.col("saved"), F.lit(0)))
    trusted = ~F.max("reverted").over(W.partitionBy("session_id"))
    o = o.withColumn("trusted", trusted).withColumn("benign", F.col("blocked") & (F.col("turn") <= 1)).withColumn("repeats", (F.col("repeat_class") != "first_seen") | F.col("other_identity") | F.col("outcome").isin("exact_dedup_hit", "cache_hit"))
    actionable = F.col("trusted") & ~F.col("benign") & F.col("repeats") & yes(F.col("miss_reason") != "first_seen") & ((F.col("headroom") > 0) | F.col("miss_reason").isin(*STRUCTURAL))
    return o.select(
        "session_id", "turn", "pos", "tool_use_id", "family", "logical", "repeat_class", "outcome", "miss_reason", "opportunity_class", "n_chars", "saved", F.col("best.name").alias("candidate"), "headroom", "candidates",
        "trusted", "repeats", "reverted", "benign", F.coalesce(actionable, F.lit(False)).alias("actionable"),
    )


def _sums() -> list:
    count = lambda c: F.count_if(c)
    if_ = lambda c: F.sum(F.when(c, F.col("headroom")).otherwise(0))
    good = F.col("trusted") & F.col("repeats")
    return [
        F.count("*").alias("n_results"), count(good).alias("n_trusted"), count(F.col("outcome") == "exact_dedup_hit").alias("n_hits"), count(good & (F.col("outcome") == "exact_dedup_hit")).alias("n_trusted_hits"),
        count(F.col("outcome") == "cache_hit").alias("n_cache_hits"), count(F.col("outcome") == "diff_compression").alias("n_diffs"), F.sum("headroom").alias("headroom"), if_(good).alias("trusted_headroom"), if_(F.col("actionable")).alias("actionable_headroom"),
        *[count(F.col("miss_reason") == r).alias(f"miss_{r}") for r in REASONS],
    ]


def sources(found: DataFrame) -> DataFrame:
    """Per session its trust, the reasons against it, and all sums, a zero for each reason that didn't come up."""
    noisy = F.array_compact(F.array(F.when(F.max(F.col("miss_reason") == "context_missing"), "missing_tool_context"), F.when(F.max("reverted"), "preflight_incompatible")))
    return found.groupBy("session_id").agg(F.min("trusted").alias("trusted"), F.array_join(noisy, ",").alias("noisy_reasons"), *_sums())


def totals(found: DataFrame) -> DataFrame:
    """The sums over all sessions, beside those of the trusted ones."""
    return found.agg(F.count_distinct("session_id").alias("n_sessions"), F.count_distinct(F.when(F.col("trusted"), F.col("session_id"))).alias("n_trusted_sessions"), *_sums())


def buckets(found: DataFrame, least: int = 256) -> DataFrame:
    """Opportunity classes with at least `least` characters of headroom, by headroom, actionable headroom, number and name."""
    per = found.filter("opportunity_class is not null").groupBy("opportunity_class").agg(
        F.count("*").alias("n"), F.count_distinct("session_id").alias("n_sessions"), F.sum("headroom").alias("headroom"), F.sum(F.when(F.col("actionable"), F.col("headroom")).otherwise(0)).alias("actionable_headroom"), F.sum("n_chars").alias("n_chars")
    )
    order = W.orderBy(F.desc("headroom"), F.desc("actionable_headroom"), F.desc("n"), "opportunity_class")  # a row per class, of which there are nine
    return per.filter(F.col("headroom") >= least).withColumn("rank", F.row_number().over(order))


def experiments(found: DataFrame) -> DataFrame:
    """What each strategy would save, over all results it applies to and over the trusted ones."""
    each = found.select("session_id", "trusted", "saved", F.inline(F.transform("candidates", lambda x: F.struct(x["name"].alias("experiment"), x["saved"].alias("would_save")))))
    more = F.greatest(F.lit(0), F.col("would_save") - F.col("saved"))
    return each.groupBy("experiment").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("n_sessions"), F.sum("would_save").alias("would_save"), F.sum(more).alias("more"), F.sum(F.when(F.col("trusted"), more).otherwise(0)).alias("trusted_more"))


def families(found: DataFrame) -> DataFrame:
    """Headroom by family of tool: number and sum of the results that have some."""
    return found.filter("headroom > 0").groupBy("family").agg(F.count("*").alias("n"), F.sum("headroom").alias("headroom"))
