"""Queries that run a stream to its end, or commands on a table, over files in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siltlog.plans.registry import query
from siltlog.plans.sqltext import over_log
from siltlog.plans.valuetable import ValueTable
from siltlog.sources.log import NOW, load_log, read_table
from siltlog.streaming import state


def folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, removed when the application ends. Where that is unset one of our own, but only on
    a single machine: on a cluster every executor would write to its own disk."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="siltlog-")
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/siltlog-stream-{uuid.uuid4().hex}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


@query("stream_index", over_log("SELECT bucket, key, flag, CAST(ttl AS BIGINT) AS ttl, ts, tx_id, file_id, pos FROM idx"))
def stream_index(spark, sf_dir):
    return state.run_index(spark, load_log(spark, sf_dir), folder(spark)).select("bucket", "key", "flag", "ttl", "ts", "tx_id", "file_id", "pos")


@query(
    "stream_epochs",
    """SELECT user_id AS instance, CAST(floor((rn - 1) / 16) AS BIGINT) + 1 AS epoch, count(*) AS waiters, max(event_id) AS frontier
    FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) GROUP BY 1, 2 HAVING count(*) = 16""",
)
def stream_epochs(spark, sf_dir):
    """Waiters that come all at once: every epoch is full, and the last waiters wait for their timer."""
    waiters = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("instance"), F.col("event_id").alias("seq"), F.lit(0).cast("long").alias("at"))
    return state.run_epochs(spark, waiters, folder(spark), 16, 3_600_000)


@query(
    "value_table_collected",
    """SELECT 'documents' AS bucket, lpad(CAST(doc_id // 3 AS VARCHAR), 9, '0') AS key, strlen(arg_max(coalesce(text, ''), doc_id)) AS size, md5(arg_max(coalesce(text, ''), doc_id)) AS md5 FROM documents GROUP BY ALL
    UNION ALL SELECT 'pages', lpad(CAST(page_id AS VARCHAR), 9, '0'), strlen(coalesce(url, '')), md5(coalesce(url, '')) FROM pages""",
)
def value_table_collected(spark, sf_dir):
    """What is live after two batches and a garbage collection of the first one's segment, in which three documents share a key."""
    table = ValueTable(spark, folder(spark), 32)
    key = lambda number: F.lpad(number.cast("string"), 9, "0")
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.lit("documents").alias("bucket"), key(F.expr("doc_id div 3")).alias("key"), F.coalesce("text", F.lit("")).alias("value"), F.lit(0).alias("ttl"))
    pages = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.lit("pages").alias("bucket"), key(F.col("page_id")).alias("key"), F.coalesce("url", F.lit("")).alias("value"), F.lit(0).alias("ttl"))
    for batch in (docs, pages):
        table.put_batch(batch, NOW)
    table.collect_garbage(0.3, NOW)
    return table.live(NOW).select("bucket", "key", F.octet_length("value").cast("long").alias("size"), F.md5(F.col("value").cast("binary")).alias("md5"))
