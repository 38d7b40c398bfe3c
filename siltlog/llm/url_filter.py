"""URL filters by a sort-merge range join.

The labels of a host, reversed and each followed by a dot, make a key in which a host and all its subdomains
share a prefix, so a rule's host is the interval of keys from its own key up to the same key with its last dot
replaced by the next character. URLs and rules are dealt into ranges of the key, each range with the rules
whose intervals meet it, and sorted; one sweep per range keeps a stack of the rules that are open, which are always
nested, and tests the URL's path against them.

Range borders come from a sample of bounded size. A host with more URLs than a range holds gets several equal
borders, and its URLs are dealt over all ranges between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import table

#: URLs of a range, keys in the sample from which its borders are taken.
RANGE_ROWS, SAMPLE_KEYS = 250_000, 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url and one without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    """The reversed labels of a host, each with a dot; the empty host, which as a rule fits all, has the empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _borders(urls: DataFrame, ranges: int, rows: int, total: int) -> list[bytes]:
    """From a sample of all parts of the table, of about `rows` keys; twice as many are never reached but by chance."""
    chosen = urls.select("key").sample(min(1.0, rows / max(total, 1)), seed=1).limit(2 * rows)
    keys = sorted(r.key.encode() for r in chosen.collect())
    return [keys[k * len(keys) // ranges] for k in range(1, ranges)] if keys else []


def _dealt(borders: list[bytes]):
    """Column functions: the first and the last range that a key may be in."""

    @F.pandas_udf(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
    def find(keys):
        import bisect

        import pandas as pd

        raw = [k.encode() for k in keys]
        return pd.DataFrame({"first": [bisect.bisect_left(borders, k) for k in raw], "last": [bisect.bisect_right(borders, k) for k in raw]}, dtype="int64")

    return find


class _Frame:
    """The rules of one host while its interval is open: by path, and the lengths of paths, longest first."""

    def __init__(self, prefix: str):
        self.prefix, self.rules, self.lengths = prefix, {}, []

    def add(self, path: str, verdict: str) -> None:
        if path not in self.rules:
            self.lengths = sorted({*self.lengths, len(path)}, reverse=True)
        self.rules[path] = max(verdict, self.rules.get(path, ""))

    def find(self, path: str) -> str | None:
        return next((path[:n] for n in self.lengths if path[:n] in self.rules and len(path) >= n), None)


def sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Rows (part, key, is_url, id, host, path, verdict) in this order of the first three; rules have no id."""
    part, stack = None, []
    for batch in batches:
        out: list[tuple] = []
        for now, key, is_url, page, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != part:
                part, stack = now, []
            while stack and not key.startswith(stack[-1].prefix):
                stack.pop()
            if not is_url:
                if not stack or stack[-1].prefix != key:
                    stack.append(_Frame(key))
                stack[-1].add(path, verdict)
                continue
            best = (-1, None, default)
            for frame in reversed(stack):  # a longer host wins a tie
                found = frame.find(path)
                size = max(len(frame.prefix) - 1, 0) + len(found) if found is not None else -1
                if size > best[0]:
                    rule = ".".join(reversed(frame.prefix[:-1].split("."))) + found
                    best = (size, rule, frame.rules[found])
            out.append((page, host, path, best[1], best[2]))
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k else pa.int64()) for k, c in enumerate(columns)], names=["id", "host", "path", "rule", "verdict"])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", range_rows: int = RANGE_ROWS, sample_keys: int = SAMPLE_KEYS) -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits), verdict.

    rules: (verdict, host, path). A rule fits its host and all subdomains where the path starts with the rule's;
    the longest (host and path together) wins, of equally long ones that with the longer host; of two verdicts for
    one host and path the alphabetically last. Null and malformed urls have an empty host and path; repeated rows
    are rows like any other; empty tables of pages or rules are allowed; other columns aren't read.
    """
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", key_of(F.col("host")))
    total = pages.count()
    ranges = max(2 * pages.sparkSession.sparkContext.defaultParallelism, -(-total // range_rows))
    find = _dealt(_borders(urls, ranges, sample_keys, total))
    spread = F.pmod(F.xxhash64("id", "path"), F.col("at.last") - F.col("at.first") + 1)
    left = urls.withColumn("at", find("key")).select((F.col("at.first") + spread).alias("part"), "key", F.lit(True).alias("is_url"), "id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    keyed = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path").dropna().distinct().withColumn("key", key_of(F.col("host")))
    end = F.when(F.col("key") == "", F.lit("\U0010ffff")).otherwise(F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/")))
    keyed = keyed.withColumn("parts", F.sequence(find("key")["first"], find(end)["last"]))
    right = keyed.select(F.explode("parts").alias("part"), "key", F.lit(False).alias("is_url"), F.lit(None).cast("long").alias("id"), "host", "path", "verdict")
    # a range is a partition: dealt by number, not by its hash
    dealt = left.unionByName(right).repartitionById(ranges, F.col("part").cast("int")).sortWithinPartitions("part", "key", "is_url")
    return dealt.mapInArrow(lambda batches: sweep(batches, default), "id long, host string, path string, rule string, verdict string")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


ORACLE = r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT *, CASE WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                     WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                     WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                     WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM f
"""
