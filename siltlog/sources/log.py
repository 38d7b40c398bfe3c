"""The columnar log: its schema, and the log that the driver's events table stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entry flags, as stored. Only these three have an effect; the others belong to structures without operations.
DELETE, SET, BUCKET_DELETE = 0, 1, 16
#: What an entry's data structure field says: a plain value, a structural marker, a pointer into the value log.
VALUE, MARKER, POINTER = 0, 1, 2
#: Bytes of an entry's header.
HEADER_BYTES = 42
#: The moment at which the queries look at the log: 2024-02-01 UTC, in seconds.
NOW = 1706745600
#: Entries per file of the derived log, and entries per transaction.
FILE_ENTRIES, TX_ENTRIES = 1000, 4

LOG_SCHEMA = T.StructType(
    [T.StructField(name, kind) for name, kind in (
        ("file_id", T.LongType()), ("pos", T.LongType()), ("bucket", T.StringType()), ("key", T.StringType()), ("value", T.StringType()),
        ("flag", T.IntegerType()), ("status", T.IntegerType()), ("ds", T.IntegerType()), ("ttl", T.LongType()), ("ts", T.LongType()), ("tx_id", T.LongType()),
    )]
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(ts: str):
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def derive_log(events: DataFrame) -> DataFrame:
    """events as a log: 1000 entries a file, 4 a transaction, every seventh transaction without commit marker."""
    event, tx = F.col("event_id"), F.expr(f"event_id div {TX_ENTRIES}")
    return events.select(
        F.expr(f"event_id div {FILE_ENTRIES}").alias("file_id"),
        (event % FILE_ENTRIES).alias("pos"),
        F.concat(F.lit("b"), (F.col("user_id") % 4).cast("string")).alias("bucket"),
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"),
        F.col("props").alias("value"),
        F.when(F.col("event_type") == "error", DELETE).otherwise(SET).alias("flag"),
        F.when((event % TX_ENTRIES == TX_ENTRIES - 1) & (tx % 7 != 0), 1).otherwise(0).alias("status"),
        F.lit(VALUE).alias("ds"),
        F.when(F.col("event_type") == "signup", 86400).otherwise(0).cast("long").alias("ttl"),
        epoch_seconds("ts").alias("ts"),
        tx.alias("tx_id"),
    )


def load_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_log(read_table(spark, sf_dir, "events"))


def with_bucket_deletes(log: DataFrame) -> DataFrame:
    """The log with every 211th entry turned into a marker that deletes its bucket."""
    marked = (F.col("file_id") * FILE_ENTRIES + F.col("pos")) % 211 == 0
    return log.withColumns({"flag": F.when(marked, BUCKET_DELETE).otherwise(F.col("flag")), "ds": F.when(marked, MARKER).otherwise(F.col("ds"))})
