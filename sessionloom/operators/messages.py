"""Operators over messages: cuts, pairing across messages, merging of roles, chunks, tags.

`blocks` are rows of `unnest.payload_blocks`: rec_key, msg_pos, block_pos, sub_pos, call positions, role, type, ids, body. With
payload_blocks' rows of block_pos -1 messages without blocks count as messages too; otherwise they are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from . import similar


def messages(blocks: DataFrame) -> DataFrame:
    """One row per message among blocks: role, number of blocks by type, its text joined by blanks."""
    b = blocks.filter("sub_pos = -1")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("type").isin("text", "tool_result"), F.struct("block_pos", "body")))), lambda x: x["body"]), " ")
    return b.groupBy("rec_key", "msg_pos").agg(
        F.first("role").alias("role"), F.count_if(F.col("block_pos") >= 0).alias("n_blocks"), F.count_if(F.col("type") == "tool_use").alias("n_uses"), F.count_if(F.col("type") == "tool_result").alias("n_results"),
        F.count_if(F.col("type") == "thinking").alias("n_thinking"), text.alias("text"),
    )


def user_turns(msgs: DataFrame) -> DataFrame:
    """Messages with the number of user-authored messages up to them: a user message of tool results alone is none, an empty one is."""
    authored = (F.col("role") == "user") & ((F.col("n_results") < F.col("n_blocks")) | (F.col("n_blocks") == 0))
    return msgs.withColumn("authored", F.coalesce(authored, F.lit(False))).withColumn("turn", F.sum(F.col("authored").cast("int")).over(W.partitionBy("rec_key").orderBy("msg_pos").rowsBetween(W.unboundedPreceding, 0)))


def cuts(blocks: DataFrame, keep: int = 3) -> DataFrame:
    """Per record the last position before which history may be cut: a user-authored message, at least `keep` of which remain, that parts no call from its result."""
    m = user_turns(messages(blocks))
    crossing = blocks.filter("sub_pos = -1 and type = 'tool_result' and call_msg_pos >= 0").select("rec_key", F.col("call_msg_pos").alias("a"), F.col("msg_pos").alias("b"))
    # +1 where a pair opens, -1 where it closes: a running sum of 0 parts nothing
    steps = crossing.select("rec_key", F.inline(F.array(F.struct((F.col("a") + 1).alias("msg_pos"), F.lit(1).alias("step")), F.struct((F.col("b") + 1).alias("msg_pos"), F.lit(-1).alias("step")))))
    every = m.select("rec_key", "msg_pos", "authored", F.lit(0).alias("step")).unionByName(steps.withColumn("authored", F.lit(None).cast("boolean")))
    upto = W.partitionBy("rec_key").orderBy("msg_pos").rangeBetween(W.unboundedPreceding, 0)
    free = every.withColumn("open", F.sum("step").over(upto)).filter("authored and open = 0")
    rank = F.row_number().over(W.partitionBy("rec_key").orderBy(F.desc("msg_pos")))
    return free.withColumn("rank", rank).filter(F.col("rank") == keep).select("rec_key", F.col("msg_pos").alias("cut"))


def timeline(blocks: DataFrame) -> DataFrame:
    """For each message with calls: calls, how many the next message answers, and that message's role."""
    m = messages(blocks)
    line = W.partitionBy("rec_key").orderBy("msg_pos")
    nxt = m.select("rec_key", "msg_pos", "n_uses", F.lead("role").over(line).alias("next_role"), F.lead("msg_pos").over(line).alias("next_pos"))
    answered = blocks.filter("sub_pos = -1 and type = 'tool_result' and call_msg_pos >= 0").groupBy("rec_key", F.col("call_msg_pos").alias("msg_pos")).agg(F.collect_set("msg_pos").alias("in"), F.count("*").alias("n_answers"))
    both = nxt.filter("n_uses > 0").join(answered, ["rec_key", "msg_pos"], "left")
    return both.select("rec_key", "msg_pos", "n_uses", F.coalesce("n_answers", F.lit(0)).alias("n_answers"), "next_role", F.coalesce(F.array_contains("in", F.col("next_pos")), F.lit(False)).alias("answered_next"), (F.coalesce(F.size("in"), F.lit(0)) > 1).alias("fragmented"))


def merged_roles(blocks: DataFrame) -> DataFrame:
    """Adjacent messages of one role as one: islands of equal roles, with their span and number of blocks. A tool_result message counts as user, one without blocks parts nothing."""
    m = messages(blocks).filter("n_blocks > 0").withColumn("role", F.when(F.col("role") == "tool_result", "user").otherwise(F.col("role")))
    line = W.partitionBy("rec_key").orderBy("msg_pos")
    new = m.withColumn("new", F.when(F.lag("role").over(line).eqNullSafe(F.col("role")) & F.lag("msg_pos").over(line).isNotNull(), 0).otherwise(1))
    return new.withColumn("island", F.sum("new").over(line)).groupBy("rec_key", "island").agg(F.first("role").alias("role"), F.min("msg_pos").alias("first_pos"), F.max("msg_pos").alias("last_pos"), F.sum("n_blocks").alias("n_blocks"))


def chunks(blocks: DataFrame, n: int = 3) -> DataFrame:
    """Each record in n chunks of nearly equal numbers of user turns: first and last message and blocks of each."""
    m = user_turns(messages(blocks))
    total = F.max("turn").over(W.partitionBy("rec_key"))
    chunk = F.least(F.lit(n - 1), F.floor((F.greatest(F.col("turn"), F.lit(1)) - 1) * n / F.greatest(total, F.lit(1)))).cast("int")
    return m.withColumn("chunk", chunk).groupBy("rec_key", "chunk").agg(F.min("msg_pos").alias("first_pos"), F.max("msg_pos").alias("last_pos"), F.sum("n_blocks").alias("n_blocks"))


def mentions(blocks: DataFrame) -> DataFrame:
    """Files named in a record's texts: how often and in how many messages."""
    found = blocks.filter("body is not null").select("rec_key", "msg_pos", F.explode(F.regexp_extract_all("body", F.lit(r"([A-Za-z0-9_\-./]+\.(?:py|ts|go|md|sql|toml|yaml|json))\b"))).alias("file"))
    return found.groupBy("rec_key", "file").agg(F.count("*").alias("n"), F.count_distinct("msg_pos").alias("n_messages"))


def facts(blocks: DataFrame, k: int = 3) -> DataFrame:
    """`key=value` and `key: value` facts of a record's texts: the last value of each key, the first k keys by name."""
    found = blocks.filter("type = 'text' and body is not null").select("rec_key", "msg_pos", "block_pos", F.posexplode(F.regexp_extract_all("body", F.lit(r"\b([a-z][a-z_]{2,}\s*[:=]\s*[A-Za-z0-9_./\-]+)"))).alias("i", "fact"))
    pair = found.select("rec_key", F.regexp_extract("fact", r"^([a-z_]+)", 1).alias("key"), F.regexp_extract("fact", r"[:=]\s*(\S+)$", 1).alias("value"), F.struct("msg_pos", "block_pos", "i").alias("at"))
    last = pair.groupBy("rec_key", "key").agg(F.max_by("value", "at").alias("value"))
    return last.withColumn("rank", F.row_number().over(W.partitionBy("rec_key").orderBy("key"))).filter(F.col("rank") <= k)


def similar_prompts(left: DataFrame, right: DataFrame, least: float = 0.25) -> DataFrame:
    """Pairs (left_id, right_id, similarity) of texts whose word sets have a Jaccard similarity of `least` or more.

    Inputs are (id, key, text); pairs are formed within a key, through the words they share, never all with all.
    """
    words = lambda df, i: df.select("key", F.col("id").alias(i), F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: F.length(w) > 3)).alias(f"w_{i}")).filter(F.size(f"w_{i}") > 0)
    a, b = words(left, "left_id"), words(right, "right_id")
    shared = a.select("key", "left_id", F.explode("w_left_id").alias("w")).join(b.select("key", "right_id", F.explode("w_right_id").alias("w")), ["key", "w"]).groupBy("key", "left_id", "right_id").agg(F.count("*").alias("n"))
    sizes = shared.join(a.select("left_id", F.size("w_left_id").alias("na")), "left_id").join(b.select("right_id", F.size("w_right_id").alias("nb")), "right_id")
    return sizes.select("left_id", "right_id", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("similarity")).filter(F.col("similarity") >= least)


def similar_texts(texts: DataFrame, least: float = 0.25, frequent: int = 64) -> DataFrame:
    """Pairs (key, left_id, right_id, similarity) of texts of one key with a Jaccard similarity of `least` or more.

    Inputs are (key, id, text), ids unique, pairs have left_id < right_id; tokens are maximal runs of a-z, 0-9, _ and /
    in lower case. A key of any size is matched part by part; `frequent` is the factor of `similar`. No pair is lost.
    """
    tokens = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9_/]+"), lambda w: w != ""))
    sets = texts.select("key", "id", tokens.alias("w")).filter("key is not null and size(w) > 0")
    return similar.pairs(sets, least, frequent)


def token_estimates(blocks: DataFrame) -> DataFrame:
    """Tokens by role and type over all records."""
    return blocks.groupBy("role", "type").agg(F.count("*").alias("n"), F.sum(T.token_estimate(F.col("body"))).alias("n_tokens"))
