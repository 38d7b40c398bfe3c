"""Quality rules as a short-circuit cascade.

Each rule is a test on features of a text that are computed when a rule first asks for them. On a sample the
cost of each rule and the share of texts that it rejects are measured, as they are in the run: on texts that pass the base
rules, with the features that are reported already there. Rules run in descending order of rejection per cost, and a
text that one rejects is not tested further. The order changes the time taken, not the verdict.
"""

from __future__ import annotations

import operator
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

#: Texts in the sample on which costs and rejections are estimated.
SAMPLE_ROWS = 500
SPACE = b" \t\n\v\f\r"
#: Bytes that don't begin a code point.
INSIDE = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


def count_of(data: bytes, characters: bytes) -> int:
    return len(data) - len(data.translate(None, characters))


class Text:
    """Features of one whole text, computed when asked for."""

    def __init__(self, text: str | None):
        self.data = (text or "").encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.data.translate(None, SPACE + INSIDE))

    @cached_property
    def n_symbols(self) -> int:
        return count_of(self.data, SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of three that occur twice or more in the text."""
        n = self.n_words
        if n < 4:
            return 0
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, n)
        pairs = ids[:-1] * len(number) + ids[1:]
        pairs = np.unique(pairs, return_inverse=True)[1]  # so that no product overflows
        windows = pairs[:-1] * len(number) + ids[2:]
        _, of, counts = np.unique(windows, return_inverse=True, return_counts=True)
        twice = counts[of] > 1
        inside = np.zeros(n, bool)
        for k in range(3):
            inside[k : n - 2 + k] |= twice
        return int(inside.sum())

    @cached_property
    def n_upper(self) -> int:
        return count_of(self.data, UPPER)

    @cached_property
    def n_letters(self) -> int:
        return self.n_upper + count_of(self.data, LOWER)

    @cached_property
    def n_exclamations(self) -> int:
        return self.data.count(b"!")

    @cached_property
    def n_stutters(self) -> int:
        return sum(map(operator.eq, self.words, self.words[1:]))


@dataclass(frozen=True)
class Rule:
    """rejects(text) is true for a text that fails the rule."""

    name: str
    rejects: Callable[[Text], bool]


BASE = (
    Rule("too_short", lambda t: t.n_words < 50),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > 3 * t.n_words),
    Rule("duplicate_lines", lambda t: 2 * t.n_dup_lines > len(t.lines)),
    Rule("word_length", lambda t: t.word_chars < 2 * t.n_words or t.word_chars > 15 * t.n_words),
    Rule("shouting", lambda t: 2 * t.n_upper > t.n_letters),
    Rule("exclamations", lambda t: 5 * t.n_exclamations > t.n_words),
    Rule("stutter", lambda t: 5 * t.n_stutters > t.n_words),
)


def ready(text: str | None, features: tuple[str, ...]) -> Text:
    """A text with the given features computed, and nothing else but what they need."""
    out = Text(text)
    for name in features:
        getattr(out, name)
    return out


def measured(texts: Iterable[str | None], rules: tuple[Rule, ...], base: tuple[Rule, ...], features: tuple[str, ...], clock: Callable[[], int] = time.perf_counter_ns) -> tuple[list[int], list[int]]:
    """What each rule costs, and how many texts it rejects, of those that pass the base rules: each rule pays for the
    features that it needs beyond the given ones."""
    spent, rejected = [0] * len(rules), [0] * len(rules)
    for text in texts:
        known = ready(text, features)
        if any(rule.rejects(known) for rule in base):
            continue
        have = dict(known.__dict__)
        for k, rule in enumerate(rules):
            known.__dict__ = dict(have)
            began = clock()
            rejected[k] += rule.rejects(known)
            spent[k] += clock() - began
    return spent, rejected


def ordered(docs: DataFrame, rules: tuple[Rule, ...], base: tuple[Rule, ...], features: tuple[str, ...], text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """rules by rejection per cost on at most `rows` texts of a sample by hash. Without rows, as given."""
    total = docs.count()
    if not total:
        return list(rules)
    slots = 1 << 20
    chosen = docs.where(F.pmod(F.xxhash64(text_col), F.lit(slots)) < min(slots, max(1, 4 * rows * slots // total))).limit(rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected = measured((text.as_py() for batch in batches for text in batch.column(0)), rules, base, features)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int64()), pa.array(spent, pa.int64()), pa.array(rejected, pa.int64())], names=["rule", "spent", "rejected"])

    got = chosen.select(text_col).mapInArrow(measure, "rule long, spent long, rejected long")
    per = {r.rule: (r.rejected + 0.5) / (r.spent + 1) for r in got.groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("rejected").alias("rejected")).collect()}
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: -per.get(k, 0.0))]


#: The features that are reported.
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, features: tuple[str, ...] = FEATURES, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: id, the features, base_failed, kept.

    Null and empty texts have no words and fail the base rule for short texts. Repeated rows are rows like any
    other, an empty table gives an empty result, other columns aren't read. Ties in the order of rules keep the
    order given.
    """
    cascade = ordered(docs, rules, base, features, text_col, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, failed, kept = [[] for _ in features], [], []
            for t in batch.column(1):
                text = ready(t.as_py(), features)
                for column, name in zip(columns, features, strict=True):
                    column.append(getattr(text, name))
                failed.append(any(rule.rejects(text) for rule in base))
                kept.append(not failed[-1] and not any(rule.rejects(text) for rule in cascade))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(failed), pa.array(kept)], names=["id", *features, "base_failed", "kept"])

    schema = "id long, " + "".join(f"{f} long, " for f in features) + "base_failed boolean, kept boolean"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
f AS (SELECT rid, doc_id, w, len(w) AS n_words, len(l) AS n_lines,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines,
             length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
             length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters,
             length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations,
             len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_stutters FROM w),
p AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM p),
r AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS pos FROM g WHERE n > 1) GROUP BY rid),
b AS (SELECT f.*, coalesce(r.n, 0) AS n_repeat_words FROM f LEFT JOIN r USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_upper > n_letters
            OR 5 * n_exclamations > n_words OR 5 * n_stutters > n_words) AS kept
FROM b
"""
