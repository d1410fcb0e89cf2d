"""Checks and cuts of whole conversations. `blocks` are rows of unnest.payload_blocks with those of block_pos -1, one for each message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from .messages import messages, user_turns

# Beginnings and marks of lines that plan, block, ask, limit or decide; fillers of answers without substance.
LINES = {
    "next": r"(?i)^\s*(next|i will|i'll|plan|then)\b", "blocker": r"(?i)\b(blocked|cannot|can't|failed|missing)\b", "question": r"\?\s*$",
    "constraint": r"(?i)\b(must|should|only|never|do not|don't|avoid)\b", "decision": r"(?i)\b(because|so that|in order to|reason:|rationale:)",
}
FILLER = r"(?i)\b(sure|certainly|of course|let me|here is|here's|i will|as requested|please)\b"


def _texts(blocks: DataFrame) -> DataFrame:
    """Each message's text: its text and result blocks and their items in order, joined by blanks."""
    said = blocks.filter("body is not null and (type in ('text', 'tool_result') or sub_pos >= 0)")
    return said.groupBy("rec_key", "msg_pos").agg(F.first("role").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_pos", "sub_pos", "body"))), lambda x: x["body"]), " ").alias("text"))


def texts(blocks: DataFrame) -> DataFrame:
    """Size and digest of each message's text, the files it names, and its lines by what they say."""
    t = _texts(blocks)
    n = lambda p: F.size(F.filter(T.lines(F.col("text")), lambda x: x.rlike(p)))
    return t.select("rec_key", "msg_pos", "role", F.length("text").alias("n_chars"), T.digest(F.col("text")).alias("digest"), F.size(T.named_files(F.col("text"))).alias("n_files"), *[n(p).alias(f"n_{k}") for k, p in LINES.items()])


def assistant_texts(blocks: DataFrame) -> DataFrame:
    """The texts of assistant messages that aren't blank."""
    said = blocks.filter("role = 'assistant' and type = 'text' and sub_pos = -1 and trim(body) <> ''")
    return said.groupBy("rec_key", "msg_pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_pos", F.trim("body").alias("t")))), lambda x: x["t"]), "\n").alias("text")).select("rec_key", "msg_pos", F.length("text").alias("n_chars"), T.digest(F.col("text")).alias("digest"))


def drift(blocks: DataFrame, words: int = 40, filled: int = 10) -> DataFrame:
    """Assistant texts that drift into prose: fillers and more than `filled` words, more than `words` words, or lists; none that carry markup."""
    t = _texts(blocks).filter("role = 'assistant'")
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    bullets = F.size(F.filter(T.lines(F.col("text")), lambda x: x.rlike(r"^\s*[-*+] ")))
    reasons = F.array_compact(F.array(F.when(F.col("text").rlike(FILLER) & (n > filled), "filler"), F.when(n > words, "long"), F.when(bullets >= 2, "list"), F.when(F.col("text").rlike(r"(?m)^#{1,6} "), "headers")))
    return t.filter(~T.has_markup(F.col("text"))).select("rec_key", "msg_pos", n.alias("n_words"), bullets.alias("n_bullets"), F.array_join(reasons, ",").alias("reasons")).filter("reasons <> ''")


def cut_reasons(blocks: DataFrame) -> DataFrame:
    """Whether each message is one before which history may be cut, and why not."""
    m = messages(blocks)
    reason = F.when(F.col("role") == "tool_result", "top_level_tool_result").when(~F.col("role").eqNullSafe("user"), "non_user").when((F.col("n_results") > 0) & (F.col("n_results") < F.col("n_blocks")), "user_contains_tool_result_block").otherwise("eligible")
    return m.select("rec_key", "msg_pos", (reason == "eligible").alias("eligible"), reason.alias("reason"))


def _shapes(blocks: DataFrame) -> DataFrame:
    """Per message: calls, results, results of the message before, results of no call, and the orders of its blocks that a provider refuses."""
    b = blocks.filter("sub_pos = -1")
    is_, call = lambda t: F.col("type") == t, F.col("call_msg_pos")
    first = lambda t: F.min(F.when(is_(t), F.col("block_pos")))
    last = lambda t: F.max(F.when(is_(t), F.col("block_pos")))
    return b.groupBy("rec_key", "msg_pos").agg(
        F.first("role").alias("role"), F.count_if(is_("tool_use")).alias("n_uses"), F.count_if(is_("tool_result")).alias("n_results"), F.count_if(is_("tool_result") & (call >= 0) & (call == F.col("msg_pos") - 1)).alias("n_answers"),
        F.count_distinct(F.when(is_("tool_result") & (call == F.col("msg_pos") - 1), F.col("call_block_pos"))).alias("n_answered"), F.count_if(is_("tool_result") & (call < 0)).alias("n_unknown"),
        F.count_if(is_("tool_result") & (call >= 0) & (call < F.col("msg_pos") - 1)).alias("n_late"), (first("text") < last("tool_result")).alias("text_first"),
        first("tool_use").alias("u0"), last("tool_use").alias("u1"), first("thinking").alias("t0"), last("thinking").alias("t1"), last("text").alias("x1"),
    )


def shape_risks(blocks: DataFrame, batch: int = 3) -> DataFrame:
    """Per record how often each fault of pairing and order comes up; records without any are left out."""
    m = _shapes(blocks)
    line = W.partitionBy("rec_key").orderBy("msg_pos")
    m = m.withColumn("next_role", F.lead("role").over(line)).withColumn("next_answers", F.coalesce(F.lead("n_answers").over(line), F.lit(0))).withColumn("next_answered", F.coalesce(F.lead("n_answered").over(line), F.lit(0)))
    calls = (F.col("role") == "assistant") & (F.col("n_uses") > 0)
    user = F.col("role").isin("user", "tool_result")
    mixed = calls & (F.col("x1") > F.col("u0"))
    count = {
        "missing_next_result": calls & (F.col("next_answers") == 0), "incomplete_next_result": calls & (F.col("next_answers") > 0) & (F.col("next_answered") < F.col("n_uses")), "unknown_result": user & (F.col("n_unknown") > 0),
        "late_result": user & (F.col("n_late") > 0), "text_before_result": user & F.coalesce(F.col("text_first"), F.lit(False)), "thinking_between_uses": calls & (F.col("n_uses") > 1) & (F.col("t1") > F.col("u0")) & (F.col("t0") < F.col("u1")),
        "large_batch": calls & (F.col("n_uses") >= batch), "text_after_use": mixed,
    }
    per = m.groupBy("rec_key").agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in count.items()])
    return per.filter(" + ".join(count) + " > 0")


def validated(blocks: DataFrame) -> DataFrame:
    """The codes a strict provider would refuse each record for; records without any are left out."""
    first = blocks.filter("sub_pos = -1").groupBy("rec_key").agg(F.min_by("role", "msg_pos").alias("first_role"), F.count_if((F.col("block_pos") < 0) & ~F.coalesce(F.col("role").isin("user", "assistant", "tool_result", "system"), F.lit(False))).alias("odd_roles"))
    both = first.join(shape_risks(blocks), "rec_key", "left")
    hit = lambda c: F.when(F.col(c) > 0, c)
    codes = F.array_compact(F.array(F.when(~F.col("first_role").eqNullSafe("user"), "first_message_not_user"), F.when(F.col("odd_roles") > 0, "invalid_role"), *[hit(c) for c in ("missing_next_result", "incomplete_next_result", "unknown_result", "late_result", "text_before_result")]))
    return both.select("rec_key", F.array_join(F.array_sort(codes), ",").alias("codes")).filter("codes <> ''")


def _pairs(blocks: DataFrame) -> DataFrame:
    return blocks.filter("sub_pos = -1 and type = 'tool_result' and call_msg_pos >= 0").select("rec_key", F.col("call_msg_pos").alias("a"), F.col("call_block_pos").alias("ab"), F.col("msg_pos").alias("b"))


def safe_suffix(blocks: DataFrame) -> DataFrame:
    """Per record the first message from which on history holds calls, each answered, and no answer to a call before it.

    A message the user wrote comes first; where there is none to begin at, one of results alone.
    """
    m, pairs = user_turns(messages(blocks)), _pairs(blocks)
    uses = blocks.filter("sub_pos = -1 and type = 'tool_use'").select("rec_key", F.col("msg_pos").alias("a"), F.col("block_pos").alias("ab"))
    open_ = uses.join(pairs.select("rec_key", "a", "ab").distinct(), ["rec_key", "a", "ab"], "left_anti").groupBy("rec_key").agg(F.max("a").alias("unanswered"))
    last = uses.groupBy("rec_key").agg(F.max("a").alias("last_call"))
    steps = pairs.select("rec_key", F.inline(F.array(F.struct((F.col("a") + 1).alias("msg_pos"), F.lit(1).alias("step")), F.struct((F.col("b") + 1).alias("msg_pos"), F.lit(-1).alias("step"))))).withColumn("kind", F.lit(None).cast("int"))
    kind = F.when(F.col("authored") & (F.col("n_results") == 0), 0).when((F.col("role").isin("user")) & (F.col("n_results") > 0), 1)
    every = m.select("rec_key", "msg_pos", F.lit(0).alias("step"), kind.alias("kind")).unionByName(steps)
    upto = W.partitionBy("rec_key").orderBy("msg_pos").rangeBetween(W.unboundedPreceding, 0)
    free = every.withColumn("open", F.sum("step").over(upto)).filter("kind is not null and open = 0").join(last, "rec_key").join(open_, "rec_key", "left").filter("msg_pos <= last_call and coalesce(unanswered, -1) < msg_pos")
    return free.groupBy("rec_key").agg(F.min(F.struct("kind", "msg_pos")).alias("s")).select("rec_key", F.col("s.msg_pos").alias("start"), (F.col("s.kind") == 1).alias("fallback"))


def recovery_floor(blocks: DataFrame) -> DataFrame:
    """The least that must stay after a broken stream: the last message the user wrote, the last calls, and what first answers them."""
    m = user_turns(messages(blocks))
    per = m.groupBy("rec_key").agg(F.max(F.when(F.col("authored"), F.col("msg_pos"))).alias("prompt"), F.max(F.when((F.col("role") == "assistant") & (F.col("n_uses") > 0), F.col("msg_pos"))).alias("calls"))
    answers = _pairs(blocks).filter("b > a").groupBy("rec_key", F.col("a").alias("calls")).agg(F.min("b").alias("answer"))
    return per.join(answers, ["rec_key", "calls"], "left").select("rec_key", "prompt", "calls", "answer")


def pruned(blocks: DataFrame) -> DataFrame:
    """Results without an error that stand before the last message the user wrote: what may be replaced by their outcome."""
    last = user_turns(messages(blocks)).filter("authored").groupBy("rec_key").agg(F.max("msg_pos").alias("last"))
    old = blocks.filter("sub_pos = -1 and type = 'tool_result' and body is not null").join(last, "rec_key").filter("msg_pos < last").filter(~T.has_error(F.col("body")))
    return old.select("rec_key", "msg_pos", "block_pos", F.length("body").alias("n_chars"))


def protected(blocks: DataFrame) -> DataFrame:
    """The last message with thinking of each record and the digest of its thinking, to be compared before and after a rewrite."""
    t = blocks.filter("sub_pos = -1 and type = 'thinking'")
    per = t.groupBy("rec_key", "msg_pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_pos", F.coalesce("body", F.lit("")).alias("body")))), lambda x: x["body"]), "\n").alias("t"), F.count("*").alias("n_blocks"))
    return per.groupBy("rec_key").agg(F.max(F.struct("msg_pos", T.digest(F.col("t")).alias("digest"), "n_blocks")).alias("x")).select("rec_key", "x.*")


def mutated(before: DataFrame, after: DataFrame) -> DataFrame:
    """Records whose protected thinking is another after a rewrite, or gone."""
    a, b = protected(before), protected(after)
    both = a.join(b.select("rec_key", F.col("digest").alias("now")), "rec_key", "left")
    return both.filter(~F.col("digest").eqNullSafe(F.col("now"))).select("rec_key", "digest", "now")


def split_mixed(blocks: DataFrame) -> DataFrame:
    """User messages that hold results and other blocks, as two: the results first, the rest after them."""
    b = blocks.filter("sub_pos = -1 and block_pos >= 0 and role = 'user'").select("rec_key", "msg_pos", "block_pos", (F.col("type") == "tool_result").alias("is_result"))
    own = W.partitionBy("rec_key", "msg_pos")
    mixed = b.withColumn("n", F.count_if("is_result").over(own)).withColumn("all", F.count("*").over(own)).filter("n > 0 and n < all")
    part = (~F.col("is_result")).cast("int")
    return mixed.select("rec_key", "msg_pos", "block_pos", part.alias("part"), (F.row_number().over(W.partitionBy("rec_key", "msg_pos", part).orderBy("block_pos")) - 1).alias("new_pos"))


def provider_messages(blocks: DataFrame) -> DataFrame:
    """The messages of another provider: one of role tool for each result, one of text and calls for each other message that has some."""
    b = blocks.filter("sub_pos = -1 and block_pos >= 0")
    tools = b.filter("type = 'tool_result'").select("rec_key", "msg_pos", F.col("block_pos").alias("part"), F.lit("tool").alias("role"), F.col("tool_use_id").alias("tool_call_id"), F.lit(0).cast("bigint").alias("n_calls"), F.length("body").alias("n_chars"))
    rest = b.filter("type <> 'tool_result'").groupBy("rec_key", "msg_pos").agg(F.first("role").alias("role"), F.count_if(F.col("type") == "tool_use").alias("n_calls"), F.sum(F.when(F.col("type") == "text", F.length("body"))).cast("int").alias("n_chars"))
    rest = rest.select("rec_key", "msg_pos", F.lit(-1).alias("part"), "role", F.lit(None).cast("string").alias("tool_call_id"), "n_calls", "n_chars")
    order = W.partitionBy("rec_key").orderBy("msg_pos", F.col("part") < 0, "part")  # results come before what else a message says
    return tools.unionByName(rest).withColumn("seq", F.row_number().over(order) - 1).select("rec_key", "seq", "role", "tool_call_id", "n_calls", "n_chars")


def labelled(blocks: DataFrame) -> DataFrame:
    """`Label: value` lines of assistant texts, the last value of each label; placeholders don't count."""
    t = blocks.filter("role = 'assistant' and type = 'text' and sub_pos = -1 and body is not null")
    line = t.select("rec_key", "msg_pos", "block_pos", F.posexplode(T.lines(F.col("body"))).alias("i", "line")).filter(F.col("line").rlike(r"^\s*[-*]?\s*[A-Za-z][A-Za-z _-]{1,30}:\s+\S"))
    pair = line.select("rec_key", F.struct("msg_pos", "block_pos", "i").alias("at"), F.lower(F.regexp_extract("line", r"^\s*[-*]?\s*([A-Za-z][A-Za-z _-]{1,30}):", 1)).alias("label"), F.substring(F.trim(F.regexp_extract("line", r":\s+(\S.*)$", 1)), 1, 96).alias("value"))
    return pair.filter(~F.lower("value").rlike(r"^(n/a|none|tbd|todo|unknown|\.\.\.|<.*>)$")).groupBy("rec_key", "label").agg(F.max_by("value", "at").alias("value"), F.count("*").alias("n"))


def error_snippets(blocks: DataFrame, last: int = 2, n: int = 80) -> DataFrame:
    """Lines with an error's mark in the last `last` messages of each record, each once, at most n characters."""
    m = blocks.filter("sub_pos = -1").groupBy("rec_key").agg(F.max("msg_pos").alias("end"))
    near = blocks.filter("body is not null").join(m, "rec_key").filter(F.col("msg_pos") > F.col("end") - last)
    return near.select("rec_key", F.explode(T.lines(F.col("body"))).alias("line")).filter(T.has_error(F.col("line"))).select("rec_key", F.substring(F.trim("line"), 1, n).alias("snippet")).distinct()


def marker_counts(records: DataFrame, marker: str, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """How often a member's name stands in each record's JSON text, of its delivery that sorts first."""
    once = records.groupBy(key).agg(F.min(payload).alias(payload))
    return once.select(F.col(key), F.regexp_count(payload, F.lit(f'"{marker}"')).alias("n")).filter("n > 0")
