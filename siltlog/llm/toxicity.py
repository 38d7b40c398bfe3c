"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

1. Lexicon: word forms and word beginnings that occur in toxic training texts far more often than in others
   (a likelihood-ratio test on counts of texts, near copies counting once), counted by an aggregation.
2. Voters: slices of the lexicon's whole words and of its word beginnings, each voting when its entries are a certain
   share of a text's words; voters on patterns of the text that need no lexicon (PATTERNS); one on a lexicon word
   beside the second person; voters on the share of words in the lexicon; and the given label as one more.
3. Label model: expectation maximisation over a hidden class estimates how often each voter fires in either
   class; a voter that fires less often in the toxic one abstains. The correlations of the voters within the classes,
   estimated next, divide the weight of voters that say the same, and the fit is repeated with those weights.
4. Classifier: logistic regression on the shares of the lexicon's entries, trained on the posterior labels. Shares,
   not occurrences: a long text isn't toxic for a single word that happens to look like one.

Training reads at most SAMPLE_ROWS labelled texts of either label (a fixed hash of the identifier chooses
them), and the lexicon has at most LEXICON_ENTRIES entries (131 on a tenth of a million texts); scoring is one pass over all whole texts without a shuffle.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import table, written

#: Labelled rows of either label that training may read.
SAMPLE_ROWS = 10_000
#: Entries of the lexicon, the least number of toxic texts with an entry, how many times more often than others.
LEXICON_ENTRIES, LEAST_TEXTS, LEAST_ODDS = 4096, 3, 3.0
LEXICON_VOTERS = 24
#: Voters on a pattern of the text: what they look for and the share of words from which on they vote.
PATTERNS = {
    "shouted words": (re.compile(r"(?<!\w)[^\W\d_a-z]{4,}(?!\w)"), 0.1),
    "repeated marks": (re.compile(r"[!?]{2,}"), 0.01),
    "masked letters": (re.compile(r"[^\W\d_][*#]+(?=[^\W\d_])|[^\W\d_][*#]{2,}"), 0.005),
    "look-alike spelling": (re.compile(r"[^\W\d_][013457@$]+(?=[^\W\d_])"), 0.005),
    "drawn-out letters": (re.compile(r"([^\W\d_])\1\1+"), 0.005),
    "spaced letters": (re.compile(r"(?<!\w)(?:[^\W\d_][ .-]){3,}[^\W\d_](?!\w)"), 0.005),
    "second person": (re.compile(r"(?<!\w)(?:you|your|yours|du|dich|dein|deine|ihr|euch|tu|toi|ton|vous|tú|usted|tuyo)(?!\w)", re.I), 0.02),
}
#: Words between a lexicon word and the second person that still count as beside it.
BESIDE = 3
#: The share of a text's words at which an entry counts in full.
FULL_SHARE = 0.02
#: Words of the shingles by which near copies in the sample are told.
FAMILY_WORDS = 5
#: Word beginnings of these lengths count beside whole words.
BEGINNINGS = (4, 5, 6, 7)
CACHED_WORDS = 200_000
#: Digits and signs that stand for letters.
LEET = str.maketrans("013457@$!", "oieastasi")
MARKS = ".,;:!?\"'()[]{}<>|*#_-…«»„“”¿¡"


def held_out(id_col):
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def forms(word: str) -> list[str]:
    """What of a word may be in the lexicon: the word, the word with letters for look-alikes, its beginnings."""
    word = word.lower().strip(MARKS)
    if not word:
        return []
    out = {"=" + word, "=" + word.translate(LEET)}
    out.update(word[:n] for n in BEGINNINGS if len(word) > n)
    return sorted(out)


class Reader:
    """Turns texts to (number of words, words in the lexicon, {entry: count}); all forms count without a lexicon."""

    def __init__(self, lexicon: dict[str, int] | None):
        self.lexicon, self.cache = lexicon, {}

    def word(self, word: str):
        got = forms(word) if self.lexicon is None else [self.lexicon[f] for f in forms(word) if f in self.lexicon]
        if len(self.cache) < CACHED_WORDS and len(word) < 40:
            self.cache[word] = got
        return got

    def __call__(self, text: str | None) -> tuple[int, int, Counter]:
        words, get, own, hits, found = (text or "").split(), self.cache.get, self.word, Counter(), 0
        for word in words:
            got = get(word)
            if got is None:
                got = own(word)
            if got:
                hits.update(got)
                found += 1
        return len(words), found, hits


def share(count: int, words: int) -> float:
    return min(1.0, count / (FULL_SHARE * max(words, 1)))


@dataclass(frozen=True)
class Model:
    """Weights of the lexicon's entries, then of the share of words in the lexicon."""

    lexicon: dict[str, int]
    weights: np.ndarray
    bias: float

    def logit(self, words: int, found: int, hits: Counter) -> float:
        total = self.bias + float(self.weights[-1]) * share(found, words)
        for k, n in hits.items():
            total += float(self.weights[k]) * share(n, words)
        return total


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, text, toxic) of at most `rows` labelled training texts of either label; its identifiers fit a broadcast."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(rows) for y in (0, 1)]
    ids = written(chosen[0].unionByName(chosen[1]), "label-sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids), "id")
    return written(texts, "labelled-texts").withColumn("family", _family("text")).dropDuplicates(["family", "toxic"])


@F.pandas_udf(T.StringType())
def _family(texts):
    """Two minhashes of a text's shingles: near copies mostly share both, texts with a common passage hardly ever."""
    import pandas as pd

    def least(text: str | None) -> str:
        words = (text or "").lower().split()
        h = np.array([zlib.crc32(" ".join(words[k : k + FAMILY_WORDS]).encode()) for k in range(max(1, len(words) - FAMILY_WORDS + 1))], np.uint32)
        return f"{h.min():x}-{(h * np.uint32(0x9E3779B1)).min():x}"

    return pd.Series([least(t) for t in texts], dtype="object")


def lexicon(texts: DataFrame) -> list[str]:
    """Entries by descending likelihood ratio, at most LEXICON_ENTRIES."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, seen = Reader(None), {}

        def flush() -> pa.RecordBatch:
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[k][1] for k in keys], pa.int64()), pa.array([seen[k][0] for k in keys], pa.int64())], names=["entry", "toxic", "other"])

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for entry in read(text.as_py())[2]:
                    seen.setdefault(entry, [0, 0])[y] += 1
            if len(seen) > 500_000:
                yield flush()
                seen.clear()
        if seen:
            yield flush()

    totals = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = float(totals.get(1, 0)), float(totals.get(0, 0))
    if not n1 or not n0:
        return []
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    share = (a + b) / F.lit(n1 + n0)
    ratio = 2 * (a * F.log(a / (n1 * share)) + F.when(b > 0, b * F.log(b / (n0 * share))).otherwise(0.0))
    odds = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    got = texts.select("text", F.col("toxic").cast("long")).mapInArrow(count, "entry string, toxic long, other long").groupBy("entry").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    got = written(got.where(a + b >= LEAST_TEXTS).withColumn("ratio", ratio).withColumn("odds", odds), "entries")
    chance = 2 * math.log(max(got.count(), 2))  # of so many entries without meaning, about one goes beyond this
    got = got.where((a >= LEAST_TEXTS) & (F.col("ratio") >= chance) & (F.col("odds") >= math.log(LEAST_ODDS)))
    return [r.entry for r in got.orderBy(F.desc("ratio"), "entry").limit(LEXICON_ENTRIES).select("entry").collect()]


#: A row of the training data: words, words in the lexicon, entries and counts, patterns found, label.
Row = tuple[int, int, Counter, tuple[bool, ...], int]


def patterns(text: str | None, read: Reader) -> tuple[bool, ...]:
    """Whether each of PATTERNS is found often enough, and whether a lexicon word stands beside the second person."""
    text = text or ""
    words = text.split()
    out = [sum(1 for _ in p.finditer(text)) >= max(1, least * len(words)) for p, least in PATTERNS.values()]
    person, last, beside = PATTERNS["second person"][0], {}, False
    for k, word in enumerate(words):
        for kind, there in (("person", person.search(word)), ("entry", read.cache.get(word) or (word not in read.cache and read.word(word)))):
            if there:
                last[kind] = k
        beside = beside or (len(last) == 2 and abs(last["person"] - last["entry"]) <= BESIDE)
    return (*out, beside)


def votes(rows: list[Row], entries: list[str]) -> np.ndarray:
    """One column per voter: slices of whole words, slices of beginnings, patterns, four shares, the given label."""
    half = LEXICON_VOTERS // 2
    kinds = [[k for k, e in enumerate(entries) if e.startswith("=") == whole] for whole in (True, False)]
    sizes = [min(half, len(kind)) for kind in kinds]
    slices = sum(sizes)
    voter = {entry: nth % size + first for kind, size, first in zip(kinds, sizes, (0, sizes[0]), strict=True) for nth, entry in enumerate(kind)}
    out = np.zeros((len(rows), slices + len(PATTERNS) + 1 + 5), bool)
    for k, (words, found, hits, marks, y) in enumerate(rows):
        by_slice = np.zeros(slices)
        for entry, n in hits.items():
            by_slice[voter[entry]] += n
        out[k, :slices] = by_slice >= max(1, 0.1 * FULL_SHARE * words)
        out[k, slices:-5] = marks
        out[k, -5:] = (*(found >= max(1, f * FULL_SHARE * words) for f in (0.2, 0.4, 0.6)), found >= 2 and found >= 0.8 * FULL_SHARE * words, y == 1)
    return out


def label_model(fires: np.ndarray, start: np.ndarray, steps: int = 25, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the hidden class for each row, and each voter's weight (1 if no other voter says the same)."""
    weight, q = np.ones(fires.shape[1]), start
    x = fires.astype(float)
    for fit in range(rounds):
        for _ in range(steps):
            on = (x.T @ q + 0.5) / (q.sum() + 1)
            off = (x.T @ (1 - q) + 0.5) / ((1 - q).sum() + 1)
            prior = np.log((q.sum() + 1) / ((1 - q).sum() + 1))
            says = np.where(on > off, weight, 0.0)
            logit = prior + x @ (says * np.log(on / off)) + (1 - x) @ (says * np.log((1 - on) / (1 - off)))
            q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if fit < rounds - 1:
            rest = x - (q[:, None] * on + (1 - q)[:, None] * off)
            cov = rest.T @ rest / len(x)
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            weight = 1 / np.abs(cov / np.outer(scale, scale)).sum(axis=1).clip(1)
    return q, weight


def regression(rows: list[Row], labels: np.ndarray, entries: int, steps: int = 400, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by gradient steps (Adam) over sparse rows."""
    at = np.array([k for k, (_, _, hits, *_) in enumerate(rows) for _ in range(len(hits) + 1)], np.int64)
    of = np.array([e for _, _, hits, *_ in rows for e in (*hits, entries)], np.int64)
    x = np.array([v for words, found, hits, *_ in rows for v in (*(share(n, words) for n in hits.values()), share(found, words))])
    params = np.zeros(entries + 2)
    params[-1] = math.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    shrink = np.append(np.full(entries + 1, ridge), 0.0)
    first, second = np.zeros(entries + 2), np.zeros(entries + 2)
    for k in range(1, steps + 1):
        z = params[-1] + np.bincount(at, params[of] * x, len(rows))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        grad = (np.append(np.bincount(of, error[at] * x, entries + 1), error.sum()) + shrink * params) / len(rows)
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        params = params - 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return params[:-1], float(params[-1])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Without labelled training texts of both labels, the model says 0.5 or the only label for all texts."""
    texts = sample(docs, labels, rows)
    entries = lexicon(texts)
    number = {e: k for k, e in enumerate(entries)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(number)
        for batch in batches:
            got = [read(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([n for n, _, _ in got], pa.int64()), pa.array([n for _, n, _ in got], pa.int64())]
                + [pa.array([list(h) for *_, h in got], pa.list_(pa.int64())), pa.array([list(h.values()) for *_, h in got], pa.list_(pa.int64()))]
                + [pa.array([patterns(t.as_py(), read) for t in batch.column(1)], pa.list_(pa.bool_()))],
                names=["id", "toxic", "words", "found", "entries", "counts", "patterns"],
            )

    got = texts.select("id", "text", "toxic").mapInArrow(features, "id long, toxic int, words long, found long, entries array<long>, counts array<long>, patterns array<boolean>").collect()  # at most 2 * rows
    got.sort(key=lambda r: (r.id, r.words, r.toxic))
    data = [(r.words, r.found, Counter(dict(zip(r.entries, r.counts, strict=True))), tuple(r.patterns), r.toxic) for r in got]
    if not entries:
        y = [t for *_, t in data]
        return Model({}, np.zeros(1), math.log((sum(y) + 0.5) / (len(y) - sum(y) + 0.5)))
    fires = votes(data, entries)
    start = 0.1 + 0.8 * fires[:, -5:].mean(axis=1)
    posterior, _ = label_model(fires, start)
    weights, bias = regression(data, posterior, len(entries))
    return Model(number, weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (0 to 1). Null and empty texts get the score of a text without words;
    repeated rows are rows like any other; an empty table gives an empty result; other columns aren't read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # LEXICON_ENTRIES entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        read = Reader(m.lexicon)
        for batch in batches:
            z = np.array([m.logit(*read(t.as_py())) for t in batch.column(1)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go; null texts are scored as empty, very long ones whole. Repeated rows get
    one verdict; an empty table gives an empty result; other columns, whatever their names, pass through."""
    model = train(docs, table(spark, sf_dir, "labels"))
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.BooleanType())
    def toxic(texts):
        import pandas as pd

        read = _reader(sent)
        return pd.Series([sent.value.logit(*read(t)) >= 0 for t in texts], dtype=bool)

    return docs.where(~toxic("text"))


#: The model that this process scored with last, and its reader, which keeps the model alive.
_LAST: list[tuple[Model, Reader]] = []


def _reader(sent) -> Reader:
    """One reader, and so one cache of words, per process and model."""
    if not _LAST or _LAST[0][0] is not sent.value:
        _LAST[:] = [(sent.value, Reader(sent.value.lexicon))]
    return _LAST[0][1]
