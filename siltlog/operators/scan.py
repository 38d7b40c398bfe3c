"""Point reads and scans of an index."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltlog.functions.expr import has_prefix, is_visible, trim_prefix
from siltlog.operators.snapshot import committed_log, latest, without_deleted_buckets
from siltlog.sources.log import NOW


def get_many(log: DataFrame, requests: DataFrame, now: int = NOW) -> DataFrame:
    """(bucket, key) requests with outcome and value: 'found' or one of three kinds of miss. Only entries of the keys asked
    for are ranked."""
    entries = without_deleted_buckets(committed_log(log))
    asked = requests.select("bucket", "key").distinct()
    buckets = entries.select("bucket").join(asked.select("bucket").distinct(), "bucket", "left_semi").distinct().withColumn("_bucket", F.lit(True))
    rows = latest(entries.join(asked, ["bucket", "key"], "left_semi")).select("bucket", "key", "value", "flag", "ttl", "ts", F.lit(True).alias("_key"))
    joined = requests.join(rows, ["bucket", "key"], "left").join(buckets, "bucket", "left")
    outcome = F.when(F.col("_bucket").isNull(), "bucket not found").when(F.col("_key").isNull(), "key not found").when(is_visible(now), "found").otherwise("not visible")
    return joined.select(*requests.columns, outcome.alias("outcome"), F.when(outcome == "found", F.col("value")).alias("value"))


def range_scan(indexed: DataFrame, bucket: str, start: str, end: str, now: int = NOW) -> DataFrame:
    """Visible keys from start to end, both included, in key order."""
    if start > end:
        raise ValueError("the start key is after the end key")
    return indexed.where((F.col("bucket") == bucket) & F.col("key").between(start, end)).where(is_visible(now)).select("key", "value").orderBy("key")


def range_status(indexed: DataFrame, ranges: DataFrame, now: int = NOW) -> DataFrame:
    """For ranges (request, bucket, start, end): raw and visible keys, and how the scan ends.

    The ranges' ends, which are read here, cut the key space into sections; each task counts its keys by section, so a row
    per section and task is all that moves, whatever the ranges share. A range's keys are the difference of two running
    sums over the sections. A range with a null has no result.
    """
    spark = indexed.sparkSession
    asked = [tuple(r) for r in ranges.select("request", "bucket", "start", "end").collect()]  # the requests, not the log
    whole = [r for r in asked if None not in r[1:]]
    # a section begins before a start (0) and after an end (2); a key (1) stands between
    cuts = sorted({c for _, bucket, start, end in whole for c in ((bucket, start, 0), (bucket, end, 2))})
    place = {c: k + 1 for k, c in enumerate(cuts)}
    width = max(1, math.isqrt(len(cuts)))
    chunks = [cuts[k : k + width] for k in range(0, len(cuts), width)]
    cut = "struct<bucket:string,key:string,side:int>"
    index = spark.createDataFrame([([c[0] for c in chunks], chunks)], f"firsts array<{cut}>, chunks array<array<{cut}>>")  # one row, as long as the requests
    at, low, high = F.struct("bucket", "key", F.lit(1).alias("side")), min((r[2] for r in whole), default=""), max((r[3] for r in whole), default="")
    keys = indexed.where(F.col("bucket").isNotNull() & F.col("key").between(low, high)).select("bucket", "key", is_visible(now).alias("visible")).crossJoin(F.broadcast(index))
    keys = keys.withColumn("nth", F.size(F.filter("firsts", lambda c: c < at)))
    section = F.when(F.col("nth") > 0, (F.col("nth") - 1) * width + F.size(F.filter(F.element_at("chunks", F.greatest("nth", F.lit(1))), lambda c: c < at))).otherwise(0)
    counts = keys.groupBy(section.cast("long").alias("section")).agg(F.count("*").alias("raw"), F.count_if("visible").alias("visible"))
    so_far = Window.orderBy("section")  # a row per section
    sums = spark.range(len(cuts) + 1).withColumnRenamed("id", "section").join(counts, "section", "left")
    sums = sums.select("section", F.sum(F.coalesce("raw", F.lit(0))).over(so_far).alias("raw"), F.sum(F.coalesce("visible", F.lit(0))).over(so_far).alias("visible"))
    # keys of section k have passed k cuts, so those of a range are in sections place(start) to place(end) - 1
    placed = [(*r, place[r[1], r[2], 0] - 1, place[r[1], r[3], 2] - 1) if None not in r[1:] else (*r, None, None) for r in asked]
    frame = spark.createDataFrame(placed, f"request {dict(ranges.dtypes)['request']}, bucket string, start string, end string, before long, last long")
    ends = [sums.select(F.col("section").alias(name), F.col("raw").alias(f"{name}_raw"), F.col("visible").alias(f"{name}_visible")) for name in ("before", "last")]
    frame = frame.join(ends[0], "before", "left").join(ends[1], "last", "left")
    raw, visible = (F.coalesce(F.greatest(F.col(f"last_{c}") - F.col(f"before_{c}"), F.lit(0)), F.lit(0)) for c in ("raw", "visible"))
    status = F.when(F.col("start") > F.col("end"), "start key after end key").when(raw == 0, "no result").otherwise("ok")
    return frame.select("request", raw.alias("raw"), visible.alias("visible"), status.alias("status"))


def sparse_index(log: DataFrame) -> DataFrame:
    """Per file: the least and the greatest (bucket, key) of its committed entries, and how many it has."""
    key = F.struct("bucket", "key")
    return committed_log(log).groupBy("file_id").agg(F.min(key).alias("least"), F.max(key).alias("greatest"), F.count("*").alias("entries"))


def sparse_get(log: DataFrame, files: DataFrame, bucket: str, key: str, now: int = NOW) -> DataFrame:
    """A point read through the log's sparse_index (which may be a stored table): one row with the number of files whose range has the key, the file of its
    last entry, outcome and value. The newest file that has the key decides; older ones aren't asked. The key goes
    to the scan of the log, where the statistics of a log table's row groups prune."""
    asked = F.struct(F.lit(bucket).alias("bucket"), F.lit(key).alias("key"))
    files = files.agg(F.count_if((asked >= F.col("least")) & (asked <= F.col("greatest"))).alias("files_in_range"))
    entries = without_deleted_buckets(committed_log(log)).where((F.col("bucket") == bucket) & (F.col("key") == key))
    last = entries.agg(F.max_by(F.struct("file_id", "value", "flag", "ttl", "ts"), F.struct("file_id", "pos")).alias("last"))
    found = F.col("last").isNotNull() & is_visible(now, "last.flag", "last.ttl", "last.ts")
    out = files.crossJoin(last)  # one row each
    return out.select(F.lit(bucket).alias("bucket"), F.lit(key).alias("key"), "files_in_range", F.col("last.file_id").alias("file_id"), F.when(found, "found").otherwise("key not found").alias("outcome"), F.when(found, F.col("last.value")).alias("value"))


def _after(rows: DataFrame, offset: int) -> DataFrame:
    """Rows without the first `offset` by key. Each task passes on at most that many keys, of which the last is the
    border; nothing is ranked in a single task."""
    if offset <= 0:
        return rows
    border = rows.select("key").orderBy("key").limit(offset).agg(F.max("key").alias("_border"))
    return rows.join(F.broadcast(border), F.col("_border").isNull() | (F.col("key") > F.col("_border"))).drop("_border")  # one row


def _first(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy("key").limit(limit) if limit > 0 else rows


def prefix_page(indexed: DataFrame, bucket: str, prefix: str, offset: int = 0, limit: int = 0, now: int = NOW) -> DataFrame:
    """Offset and limit count index rows, hidden ones too; visibility is tested on the page. limit 0: no limit."""
    rows = indexed.where((F.col("bucket") == bucket) & has_prefix("key", prefix))
    return _first(_after(rows, offset), limit).where(is_visible(now)).select("key", "value").orderBy("key")


def prefix_visible_page(indexed: DataFrame, bucket: str, prefix: str, offset: int = 0, limit: int = 0, now: int = NOW) -> DataFrame:
    """Offset and limit count visible keys."""
    rows = indexed.where((F.col("bucket") == bucket) & has_prefix("key", prefix)).where(is_visible(now)).select("key", "value")
    return _first(_after(rows, offset), limit).orderBy("key")


def prefix_regex_page(indexed: DataFrame, bucket: str, prefix: str, pattern: str, offset: int = 0, limit: int = 0, now: int = NOW) -> DataFrame:
    """Offset counts keys with the prefix, before the pattern; limit counts keys whose rest the pattern finds."""
    rows = indexed.where((F.col("bucket") == bucket) & has_prefix("key", prefix))
    found = _after(rows, offset).where(trim_prefix("key", prefix).rlike(pattern))
    return _first(found, limit).where(is_visible(now)).select("key", "value").orderBy("key")


def prefix_skipped(indexed: DataFrame, bucket: str, prefix: str, offset: int) -> DataFrame:
    """How many rows a page with this offset passes over."""
    return indexed.where((F.col("bucket") == bucket) & has_prefix("key", prefix)).agg(F.least(F.count("*"), F.lit(offset)).alias("skipped"))


def full_scan(indexed: DataFrame) -> DataFrame:
    """All index rows in key order, deleted ones included."""
    return indexed.select("bucket", "key", "flag", "ttl", "ts", "file_id", "pos").orderBy("bucket", "key")
