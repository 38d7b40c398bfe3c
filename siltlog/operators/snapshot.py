"""Snapshots of a log: what is visible, by recovery semantics.

An entry counts if its transaction has a commit marker anywhere in the log; of the entries of a key the last
one in (file_id, pos) order counts; deleted and expired ones are hidden after that, never before. Bucket and key
predicates may be pushed below the choice of the last entry, visibility may not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltlog.functions.expr import is_expired, is_visible
from siltlog.sources.log import BUCKET_DELETE, DELETE, MARKER, NOW

ORDER = ["file_id", "pos"]
BY_KEY = ["bucket", "key"]


def committed(log: DataFrame) -> DataFrame:
    """tx_id of transactions of which any entry has the commit marker."""
    return log.where("status = 1").select("tx_id").distinct()


def committed_log(log: DataFrame) -> DataFrame:
    """Entries of committed transactions. A plain semi join, which needs no distinct markers: the planner broadcasts them
    or sorts both sides, by size."""
    return log.join(log.where("status = 1").select("tx_id"), "tx_id", "left_semi").select(log.columns)


def latest(entries: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The last entry of each key. A ranking window: only one row per key and task goes through the shuffle's sort."""
    last = Window.partitionBy(*BY_KEY).orderBy(*[F.desc(c) for c in ORDER])
    entries = entries if columns is None else entries.select(*columns)
    return entries.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank")


def without_deleted_buckets(entries: DataFrame) -> DataFrame:
    """Drops markers and what a bucket held before its last marker."""
    marks = entries.where((F.col("ds") == MARKER) & (F.col("flag") == BUCKET_DELETE)).groupBy("bucket").agg(F.max(F.struct(*ORDER)).alias("_mark"))
    kept = entries.where((F.col("ds") != MARKER) | (F.col("flag") != BUCKET_DELETE)).join(marks, "bucket", "left")
    return kept.where(F.col("_mark").isNull() | (F.struct(*ORDER) > F.col("_mark"))).select(entries.columns)


def index(log: DataFrame) -> DataFrame:
    """The last committed entry of each key, deleted and expired ones included."""
    return latest(without_deleted_buckets(committed_log(log)))


def index_plain(log: DataFrame) -> DataFrame:
    """index() for logs that have no bucket deletes: one join less."""
    return latest(committed_log(log))


def live(indexed: DataFrame, now: int = NOW) -> DataFrame:
    return indexed.where(is_visible(now))


def tombstones(indexed: DataFrame) -> DataFrame:
    return indexed.where(F.col("flag") == DELETE)


def expired(indexed: DataFrame, now: int = NOW) -> DataFrame:
    return indexed.where((F.col("flag") != DELETE) & is_expired(now))


def last_places(log: DataFrame, value: Column) -> DataFrame:
    """(bucket, key, place, last): where the last committed entry of each key stands, and a value of that entry. Tasks pass
    on one row per key, and one per bucket that has a marker; what came before a bucket's last marker is out."""
    place = F.struct(*ORDER)
    marker = (F.col("ds") == MARKER) & (F.col("flag") == BUCKET_DELETE)
    entries = committed_log(log)
    by_key = entries.groupBy("bucket", F.when(~marker, F.col("key")).alias("key"), marker.alias("_marker")).agg(F.max(place).alias("place"), F.max_by(value, place).alias("last"))
    marks = by_key.where("_marker").select("bucket", F.col("place").alias("_mark"))
    kept = by_key.where("NOT _marker").join(marks, "bucket", "left")
    return kept.where(F.col("_mark").isNull() | (F.col("place") > F.col("_mark"))).select("bucket", "key", "place", "last")


def key_counts(log: DataFrame, now: int = NOW) -> DataFrame:
    """Per bucket: replayed records, keys in the index, visible keys. Tasks pass on one row per key, hot or not. Records
    that a bucket delete has hidden, and the markers, aren't counted."""
    entries = without_deleted_buckets(committed_log(log))
    last = F.max_by(F.struct("flag", "ttl", "ts"), F.struct(*ORDER)).alias("last")
    by_key = entries.groupBy(*BY_KEY).agg(F.count("*").alias("records"), last)
    return by_key.groupBy("bucket").agg(F.sum("records").alias("records"), F.count("*").alias("index_keys"), F.count_if(is_visible(now, "last.flag", "last.ttl", "last.ts")).alias("live_keys"))


def key_range(indexed: DataFrame) -> DataFrame:
    return indexed.groupBy("bucket").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def valid_key_counter(log: DataFrame) -> DataFrame:
    """The counter an index keeps while it replays: a new key adds one even if deleted, later changes of state count.
    Per key these add up to one, plus the last state, less the first; a bucket delete starts anew. Both states are
    aggregated in the tasks."""
    place, live = F.struct(*ORDER), (F.col("flag") != DELETE).cast("long")
    by_key = without_deleted_buckets(committed_log(log)).groupBy(*BY_KEY).agg(F.min_by(live, place).alias("first"), F.max_by(live, place).alias("last"))
    return by_key.groupBy("bucket").agg(F.sum(1 + F.col("last") - F.col("first")).alias("valid_keys"))


def replay_trace(log: DataFrame, now: int = NOW) -> DataFrame:
    """What recovery says of every entry."""
    marks = committed(log).withColumn("_committed", F.lit(True))
    reason = (
        F.when(F.col("_committed").isNull(), "transaction has no commit marker")
        .when(F.col("flag") == DELETE, "committed tombstone")
        .when(is_expired(now), "committed value expired")
        .otherwise("latest committed value")
    )
    return log.join(marks, "tx_id", "left").select(*ORDER, "bucket", "key", F.col("_committed").isNotNull().alias("applied"), reason.alias("reason"))
