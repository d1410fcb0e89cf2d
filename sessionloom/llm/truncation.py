"""Texts cut off by field limits or in transfer.

Method: intact values are cut artificially, at their source's limits and at random, to make positives; endings of
lines and texts are the negatives; hashed logistic regression on closing characters, last words, punctuation, open
brackets and the distance of the length to a limit is trained on them, then scores every record.

Limits are found in all records: per source the lengths, in characters and in bytes, that stand out of the counts
around them. The classifier is fitted on at most `SAMPLE` texts of about `SAMPLE_CHARS` characters in all, chosen by a hash
of the id (documented bounds; a quarter of them give the vocabulary, the others the examples); fitting runs in one task, its result is a vector of
2**`BITS` weights and the vocabulary of the sample, so neither grows with the data. Words at the end are the last six
of a text's last 400 characters; its last line counts whole, however long.

Cases. Null and empty texts and texts of white space are not truncated. Equal texts have one verdict, the highest
score of their copies. A null source is a source of its own. Very long texts are read whole. With no records to learn
from, nothing is found. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from random import Random
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SAMPLE_CHARS = 64_000_000
SAMPLE, BITS, EPOCHS, NEAR, CUT_AT, SOURCES = 16_000, 20, 6, 24, 0.5, 10_000
_TOKEN = re.compile(r"\w+|[^\w\s]")
_LOG = re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:")
_MARK = re.compile(r"(…|\.\.\.|\[(?:…|\.\.\.)\]|\((?:…|\.\.\.)\)|<truncated>|\(truncated\)|\[truncated\])\s*$", re.I)
_CLOSED = frozenset(".!?。！？}`\"”»")


# ---- limits -----------------------------------------------------------------------------------------------------


def limits(documents: DataFrame, least: int = 5, factor: float = 6.0, around: int = 64) -> DataFrame:
    """(source, chars array<int>, bytes array<int>): lengths that at least `least` texts have, `factor` times as many as lengths around, the most frequent first."""
    once = documents.filter("text is not null and text <> ''").select("source", F.xxhash64("text").alias("h"), F.length("text").alias("c"), F.octet_length("text").alias("b")).dropDuplicates(["source", "h"])
    sizes = once.select("source", F.explode(F.array(F.struct(F.lit("c").alias("unit"), F.col("c").alias("n")), F.struct(F.lit("b").alias("unit"), F.col("b").alias("n")))).alias("e")).select("source", "e.*")
    counts = sizes.groupBy("source", "unit", "n").agg(F.count("*").alias("k"))
    near = W.partitionBy("source", "unit").orderBy("n").rangeBetween(-around, around)
    peaks = counts.withColumn("rest", (F.sum("k").over(near) - F.col("k")) / (2 * around)).filter((F.col("k") >= least) & (F.col("k") > factor * F.greatest("rest", F.lit(0.3))))
    top = lambda unit: F.transform(F.sort_array(F.collect_list(F.when(F.col("unit") == unit, F.struct("k", "n"))), asc=False), lambda e: e["n"])
    return peaks.groupBy("source").agg(top("c").alias("chars"), top("b").alias("bytes"))


# ---- features ---------------------------------------------------------------------------------------------------


class Vocabulary:
    """Document counts of the sample's words: which words are known, and which are common."""

    def __init__(self, texts: list[str] = (), share: float = 0.02):
        self.counts: Counter = Counter()
        for t in texts:
            self.counts.update({w.lower() for w in _TOKEN.findall(t)[:-2] if w[0].isalpha()})
        self.common = max(8, share * len(texts))

    def rank(self, word: str) -> int:
        n = self.counts.get(word.lower(), 0)
        return 0 if not n else min(4, 1 + int(math.log(n, 4)))

    def gram(self, word: str) -> str:
        low = word.lower()
        if len(low) >= 12 and any(c.isdigit() for c in low):
            return "#"
        if low[0].isdigit():
            return "0"
        return low if not low[0].isalpha() or self.counts.get(low, 0) >= self.common else "@"


def _shape(s: str) -> str:
    return "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in s)


def _runs(s: str) -> str:
    return re.sub(r"(.)\1+", r"\1", _shape(s))


def _kind(text: str, line: str, fenced: bool) -> str:
    if fenced:
        return "code"
    if text[:1] in "{[" and re.match(r'[\[{]\s*["{\[]', text):
        return "json"
    if _LOG.match(line):
        return "log"
    bare = line.lstrip()
    return "list" if re.match(r"([-*+•]|\d+[.)])\s", bare) else "head" if bare.startswith("#") else "fence" if bare.startswith("```") else "quote" if bare.startswith(">") else "prose"


def _near(size: int, marks: list[int] | None) -> str:
    least = min((m - size for m in marks or () if 0 <= m - size <= NEAR), default=None)
    return "far" if least is None else "at" if least == 0 else "by" if least <= 3 else "near" if least <= 10 else "some"


def features(text: str, chars: list[int] | None, octets: list[int] | None, words: Vocabulary) -> list[int]:
    """Hashed features of how a text ends."""
    body = text.rstrip()
    mark = _MARK.search(body)
    core = body[: mark.start()].rstrip() if mark else body
    fenced = core.count("```") % 2 == 1
    end = core.rfind("\n")
    line, previous = core[end + 1 :], ""
    while end >= 0 and not previous.strip():
        start = core.rfind("\n", 0, end)
        previous, end = core[start + 1 : end], start
    previous = previous if previous.strip() else ""
    kind = _kind(core.lstrip(), line, fenced)
    last = core[-1:]
    ends = "." if last in _CLOSED else "w" if last.isalpha() else "0" if last.isdigit() else last
    tokens = _TOKEN.findall(core[-400:])[-6:]
    grams = [words.gram(t) for t in tokens]
    word = tokens[-1] if tokens else ""
    rank = words.rank(word) if word[:1].isalpha() else "-"
    near_c, near_b = _near(len(text), chars), _near(len(text.encode("utf-8", "surrogatepass")), octets)
    at = "at" if "at" in (near_c, near_b) else near_c if near_c != "far" else near_b
    sure = ""
    if kind == "json":
        try:
            json.loads(core)
            sure = "ok"
        except (ValueError, RecursionError):
            sure = "bad"
    opened = sum(line.count(x) for x in "([{") - sum(line.count(x) for x in ")]}")
    quotes = line.count('"') % 2
    f = [
        f"b|{kind}", f"e|{ends}", f"ke|{kind}|{ends}", f"l|{last}", f"m|{mark.group(1) if mark else ''}", f"r|{rank}", f"kr|{kind}|{rank}|{ends}",
        f"s3|{core[-3:].lower()}", f"s2|{kind}|{core[-2:].lower()}", f"s4|{core[-4:].lower()}", f"sp|{kind}|{text != body and not text.endswith(chr(10))}",
        f"c|{near_c}", f"o|{near_b}", f"a|{at}", f"ae|{at}|{ends}", f"am|{at}|{bool(mark)}", f"ake|{at}|{kind}|{ends}", f"j|{sure}", f"f|{fenced}|{ends}",
        f"p|{kind}|{max(-2, min(2, opened))}|{quotes}", f"lw|{kind}|{min(6, len(line.split()))}|{ends}", f"w1|{word.lower()}",
    ]
    for n in range(1, 6):
        if len(grams) >= n:
            f.append(f"g{n}|{' '.join(grams[-n:])}")
            f.append(f"h{n}|{kind}|{' '.join(grams[-n:])}")
    if kind in ("log", "code"):
        tail, old = line.split(" ")[-1], previous.split(" ")[-1]
        f += [f"t|{kind}|{_runs(tail)}|{len(line.split())}", f"ts|{kind}|{_shape(tail) == _shape(old)}", f"tr|{kind}|{_runs(tail) == _runs(old)}", f"n|{kind}|{len(line.split()) - len(previous.split())}"]
    return [crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in f]


# ---- examples ---------------------------------------------------------------------------------------------------


def _closed(text: str) -> bool:
    return text.count("```") % 2 == 0


def _intact(text: str, chars: list[int] | None, octets: list[int] | None) -> bool:
    """Whether a text can serve as an intact value: closed at its end and not as long as a limit."""
    if not text or text != text.rstrip() or _MARK.search(text) or not _closed(text):
        return False
    if _near(len(text), chars) != "far" or _near(len(text.encode("utf-8", "surrogatepass")), octets) != "far":
        return False
    if text[0] in "{[" and re.match(r'[\[{]\s*["{\[]', text):
        try:
            return json.loads(text) is not None
        except (ValueError, RecursionError):
            return False
    line = text[text.rfind("\n") + 1 :]
    if _LOG.match(line):
        before = text[:-len(line) - 1]
        old = before[before.rfind("\n") + 1 :]
        return bool(old) and _shape(line.split(" ")[-1]) == _shape(old.split(" ")[-1])
    return text[-1] in _CLOSED or text.endswith(")")


def examples(text: str, chars: list[int] | None, octets: list[int] | None, random: Random) -> Iterator[tuple[str, int, float, int]]:
    """(text, whether it is cut, weight, a length to take for a limit or 0) made from one value."""
    if _intact(text, chars, octets):
        yield text, 0, 2.0, 0
        yield text, 0, 1.2, len(text)  # an intact value may be just as long as a limit
        if text[-1] == "." and random.random() < 0.5:
            yield text[:-1] + random.choice(("...", "...", "…")), 0, 1.0, 0  # or trail off
        usable = [m for m in chars or () if m < len(text)]
        if usable:
            m = random.choice(usable)
            sign = random.choice(("", "", "", "…", "...", " [...]"))
            part = text[: m - len(sign)]
            if random.random() < 0.4:
                part = part.rsplit(None, 1)[0]
            yield part + sign, 1, 1.0, 0
        usable = [m for m in octets or () if m < len(text)]
        if usable:
            yield text.encode("utf-8", "surrogatepass")[: random.choice(usable)].decode("utf-8", random.choice(("replace", "ignore"))), 1, 1.0, 0
    elif text[:1] in "{[":
        return
    borders = [m.start() for m in re.finditer(r"\n+", text)]
    for at in random.sample(borders, min(len(borders), 6)):
        part = text[:at]
        if part.strip() and _closed(part) and text[:1] not in "{[":
            yield part, 0, 1.5, 0
    for _ in range(4):
        at = random.randint(min(20, len(text)), len(text))
        part = text[:at]
        if not part.strip() or at >= len(text) - 1 or text[at] == "\n" or part[-1] in "\n.!?。":
            continue
        if random.random() < 0.3:
            part = part.rsplit(None, 1)[0] + random.choice(("", "", " "))
        elif random.random() < 0.08:
            part += random.choice(("…", "...", " [...]"))
        if text[len(part) : len(part) + 1] != "\n" and part.strip():
            yield part, 1, 1.0, 0


class Model:
    """Vocabulary, weights and bias of the regression."""

    def __init__(self, words: Vocabulary, weights: np.ndarray, bias: float):
        self.words, self.weights, self.bias = words, weights, bias

    def score(self, text: str | None, chars: list[int] | None, octets: list[int] | None) -> float:
        if not text or not text.strip():
            return 0.0
        z = float(self.weights[features(text, chars, octets, self.words)].sum()) + self.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(rows: list[tuple[str, list[int] | None, list[int] | None]], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Hashed logistic regression, by AdaGrad, on examples made from three quarters of the rows; the others give the vocabulary."""
    words = Vocabulary([t for t, _, _ in rows[::4]])
    random = Random(seed)
    made = [
        (features(part, [*(c or ()), extra] if extra else c, o, words), y, w)
        for i, (t, c, o) in enumerate(rows)
        if i % 4
        for part, y, w, extra in examples(t, c, o, random)
    ]
    weights, seen, bias = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6), 0.0
    if not made or len({y for _, y, _ in made}) < 2:
        return Model(words, weights, -30.0)
    sizes = np.array([len(f) for f, _, _ in made])
    flat, ends = np.concatenate([np.array(f) for f, _, _ in made]), np.concatenate([[0], np.cumsum(sizes)])
    rare = np.bincount(flat, minlength=1 << BITS) < 3  # says nothing that would hold for other texts
    y, w = np.array([y for _, y, _ in made], float), np.array([w for _, _, w in made])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for batch in np.array_split(order.permutation(len(made)), max(1, len(made) // 256)):
            n = sizes[batch]
            index = flat[np.repeat(ends[batch] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            z = np.add.reduceat(weights[index], np.concatenate([[0], np.cumsum(n)[:-1]])) + bias
            g = (1 / (1 + np.exp(-z)) - y[batch]) * w[batch]
            grad = np.bincount(index, weights=np.repeat(g, n), minlength=1 << BITS)
            grad[rare] = 0
            touched = np.flatnonzero(grad)
            d = grad[touched] / len(batch) + 1e-6 * weights[touched]
            seen[touched] += d * d
            weights[touched] -= 0.15 * d / np.sqrt(seen[touched])
            bias -= 0.05 * g.mean()
    return Model(words, weights, bias)


# ---- over tables ------------------------------------------------------------------------------------------------


def _with_limits(documents: DataFrame) -> DataFrame:
    """documents with their source's limits, which are broadcast where at most SOURCES sources have some."""
    d, spark = documents.select("doc_id", "text", "source"), documents.sparkSession
    known = limits(d).withColumnRenamed("source", "limited")
    rows = known.limit(SOURCES + 1).collect()
    if len(rows) <= SOURCES:
        known = F.broadcast(spark.createDataFrame(rows, "limited string, chars array<int>, bytes array<int>"))
    return d.join(known, F.col("source").eqNullSafe(F.col("limited")), "left").drop("limited")


def trained(prepared: DataFrame, sample: int = SAMPLE) -> bytes:
    """A pickled Model, fitted in one task on at most `sample` texts."""
    usable = prepared.filter("text is not null and length(text) >= 40").select("text", "chars", "bytes", F.xxhash64("doc_id", F.lit(11)).alias("h"))
    n, chars = usable.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    share = min(1.0, 0.97 * sample / max(n, 1), SAMPLE_CHARS / max(chars, 1))
    if n > sample or share < 1 and chars > SAMPLE_CHARS:  # a share chosen by hash, so that the limit binds only by chance and no global order is needed
        usable = usable.filter(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)))
    chosen = usable.select("text", "chars", "bytes").limit(sample).repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        rows.sort(key=lambda r: (crc32(r[0].encode("utf-8", "surrogatepass")), r[0]))  # one order, however the sample arrived
        m = fit(rows)
        small = Vocabulary()
        small.counts, small.common = Counter({k: n for k, n in m.words.counts.items() if n > 1}), m.words.common
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((dict(small.counts), small.common, m.weights.astype(np.float32), m.bias))], pa.binary())], names=["model"])

    fitted = chosen.mapInArrow(run, "model binary").first()
    return bytes(fitted[0]) if fitted else pickle.dumps(({}, 8, np.zeros(1 << BITS, np.float32), -30.0))


def _load(blob: bytes) -> Model:
    counts, common, weights, bias = pickle.loads(blob)
    words = Vocabulary()
    words.counts, words.common = Counter(counts), common
    return Model(words, weights.astype(float), bias)


def scores(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, source, score) of every record; equal texts have the highest score of their copies."""
    prepared = _with_limits(documents)
    model = prepared.sparkSession.sparkContext.broadcast(trained(prepared, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _load(model.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            s = [m.score(t, c, o) for t, c, o in zip(texts, b.column("chars").to_pylist(), b.column("bytes").to_pylist())]
            keys = [blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() if t else None for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(keys, pa.binary()), pa.array(s, pa.float64())], names=["doc_id", "source", "form", "own"])

    kinds = dict(documents.select("doc_id", "source").dtypes)
    each = prepared.select("doc_id", "source", "text", "chars", "bytes").mapInArrow(run, f"doc_id {kinds['doc_id']}, source string, form binary, own double")
    best = each.filter("own > 0.01").groupBy("form").agg(F.max("own").alias("best"))
    return each.join(best, "form", "left").select("doc_id", "source", F.coalesce("best", "own").alias("score"))


def truncated(documents: DataFrame, sample: int = SAMPLE, least: float = CUT_AT) -> DataFrame:
    """The doc_id of each record whose text was cut off."""
    return scores(documents, sample).filter(F.col("score") >= least).select("doc_id")


def rates(documents: DataFrame, sample: int = SAMPLE, least: float = CUT_AT) -> DataFrame:
    """For each source: records, truncated records and their share."""
    s = scores(documents, sample)
    cut = F.sum((F.col("score") >= least).cast("bigint"))
    return s.groupBy("source").agg(F.count("*").alias("n_docs"), cut.alias("n_truncated"), (cut / F.count("*")).alias("rate"))
