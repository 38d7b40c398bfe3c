"""Statistics of the log: segments, amplification, read hotness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltlog.functions.expr import entry_size, garbage_ratio, is_visible, ratio
from siltlog.operators.snapshot import BY_KEY, ORDER, committed_log, last_places, without_deleted_buckets
from siltlog.sources.log import NOW


def sized(entries: DataFrame) -> DataFrame:
    return entries.withColumn("size", entry_size())


def hotness(reads: DataFrame, indexed: DataFrame) -> DataFrame:
    """Reads (bucket, key) per file of the entry that answers them."""
    counted = reads.groupBy(*BY_KEY).agg(F.count("*").alias("n"))
    return counted.join(indexed.select(*BY_KEY, "file_id"), BY_KEY).groupBy("file_id").agg(F.sum("n").alias("read_count"))


def segments(log: DataFrame, reads: DataFrame | None = None, now: int = NOW) -> DataFrame:
    """(file_id, size, live_bytes, read_count): all entries of a file, and those that are current and visible. What a
    bucket delete has hidden is garbage."""
    sizes = sized(log).groupBy("file_id").agg(F.sum("size").alias("size"), F.lit(0).cast("long").alias("live_bytes"), F.lit(0).cast("long").alias("read_count"))
    last = last_places(log, F.struct("flag", "ttl", "ts", entry_size().alias("size")))
    alive = F.when(is_visible(now, "last.flag", "last.ttl", "last.ts"), F.col("last.size")).otherwise(0)
    if reads is None:
        last = last.withColumn("n", F.lit(0).cast("long"))
    else:
        last = last.join(reads.groupBy(*BY_KEY).agg(F.count("*").alias("n")), BY_KEY, "left")
    by_file = last.groupBy("place.file_id").agg(F.lit(0).cast("long").alias("size"), F.sum(alive).alias("live_bytes"), F.sum(F.coalesce("n", F.lit(0))).alias("read_count"))
    return sizes.unionByName(by_file).groupBy("file_id").agg(*[F.sum(c).alias(c) for c in ("size", "live_bytes", "read_count")])


def segment_ratios(segs: DataFrame) -> DataFrame:
    return segs.select("file_id", "size", "live_bytes", garbage_ratio().alias("garbage_ratio"))


def observation(segs: DataFrame, segment_size: int, written: int, merged: int) -> DataFrame:
    """The compaction observation: logical, live, obsolete and physical bytes, space and write amplification."""
    sums = segs.agg(F.sum("size").alias("logical_bytes"), F.sum("live_bytes").alias("live_bytes"), F.count("*").alias("files"))
    physical = F.col("files") * segment_size
    return sums.select(
        "logical_bytes", "live_bytes", (F.col("logical_bytes") - F.col("live_bytes")).alias("obsolete_bytes"), physical.alias("physical_bytes"),
        ratio(physical, "live_bytes").alias("space_amp"), F.lit((written + merged) / written if written else 0.0).alias("write_amp"),
    )


def superseded(log: DataFrame) -> DataFrame:
    """Committed entries that a later committed entry of their key replaces, but for those that a bucket delete has hidden.
    The last entries are aggregated in the tasks and joined, so that a key with a large share of the log can be split."""
    entries = without_deleted_buckets(committed_log(log)).select(*ORDER, *BY_KEY)
    last = entries.groupBy(*BY_KEY).agg(F.max(F.struct(*ORDER)).alias("_last"))
    return entries.join(last, BY_KEY).where(F.struct(*ORDER) < F.col("_last")).select(*ORDER, *BY_KEY)


def active_offset(log: DataFrame) -> DataFrame:
    """The active file and the bytes written to it."""
    return sized(log).groupBy("file_id").agg(F.sum("size").alias("write_offset")).orderBy(F.desc("file_id")).limit(1)


def checksums(log: DataFrame) -> DataFrame:
    """IEEE CRC-32 of each entry's bucket, key and value."""
    return log.select(*ORDER, F.crc32(F.concat(F.col("bucket"), F.col("key"), F.coalesce("value", F.lit(""))).cast("binary")).alias("crc"))
