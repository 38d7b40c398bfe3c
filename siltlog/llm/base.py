"""Helpers shared by the operators: the shared folder, written intermediate tables, Arrow batches."""

from __future__ import annotations

import functools
import operator
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The separators of the word pattern [^\x20\x09-\x0D]+ (bytes.split() without arguments uses the same six).
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of a table that are sent to all tasks; of longer ones a filter is sent.
SENT_ROWS = 200_000
#: Words of 64 bits in a filter, as few and as many as there may be (16 MB); bits per entry that are aimed at.
LEAST_WORDS, MOST_WORDS, ENTRY_BITS = 1 << 10, 1 << 21, 12


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset one of our own, but only on a single
    machine: on a cluster every executor would write to its own disk."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="siltlog-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/siltlog-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_row_each(docs: DataFrame) -> DataFrame:
    """Of rows that repeat both doc_id and text (null counting as empty) one; all columns stay."""
    name = "_text"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.coalesce("text", F.lit(""))).dropDuplicates(["doc_id", name]).drop(name)


def filter_bits(hashes: DataFrame, words: int | None = None) -> np.ndarray:
    """A Bloom filter of the longs in the column hash, two bits each. Its size follows their number up to MOST_WORDS words,
    which is also what reaches the driver at most; a fuller filter lets more pass, and never stops one that is in it."""
    if words is None:
        words = min(MOST_WORDS, max(LEAST_WORDS, 1 << (hashes.count() * ENTRY_BITS // 64).bit_length()))
    bits = [F.pmod(F.col("hash") if not k else F.xxhash64("hash"), F.lit(64 * words)) for k in range(2)]
    at = hashes.select(F.explode(F.array(*bits)).alias("bit"))
    got = at.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(words, np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out


def passes(spark: SparkSession, bits: np.ndarray):
    """A column function: may this long be in the filter?"""
    sent, n = spark.sparkContext.broadcast(bits), 64 * len(bits)

    @F.pandas_udf(T.BooleanType())
    def probe(first, second):
        words = sent.value
        return ((words[first // 64] >> (first % 64)) & (words[second // 64] >> (second % 64)) & 1).astype(bool)

    return lambda hash_: probe(F.pmod(hash_, F.lit(n)), F.pmod(F.xxhash64(hash_), F.lit(n)))


def without(docs: DataFrame, gone: DataFrame, keys: dict[str, Column], sent_rows: int = SENT_ROWS) -> DataFrame:
    """docs without the rows whose keys (columns of gone to columns over docs) are in gone, nulls being equal.

    gone has a row for each key. If it is short it is sent to all tasks; else a filter of it is, and only rows that pass
    the filter are moved for the join.
    """
    same = functools.reduce(operator.and_, [own.eqNullSafe(gone[name]) for name, own in keys.items()])
    if gone.count() <= sent_rows:
        return docs.join(F.broadcast(gone), same, "left_anti")
    probe = passes(docs.sparkSession, filter_bits(gone.select(F.xxhash64(*keys).alias("hash"))))
    suspect = probe(F.xxhash64(*keys.values()))
    return docs.where(~suspect).unionByName(docs.where(suspect).join(gone, same, "left_anti"))
