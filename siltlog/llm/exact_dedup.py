"""Exact deduplication by a log-structured merge index.

Each task keeps a memtable of digests and flushes it, sorted, as a run: Parquet with a Bloom filter on the digest.
Compaction merges all runs, keeping for each digest the smallest identifier (the largest on request) and the
number of rows. The compacted index yields a filter of the digests that occur more than once; rows that pass it are
hits, whose bytes are compared with the bytes of the row that stays. Rows that share a digest but not the bytes (a collision) are
grouped again by digest and bytes, so the result never depends on the digest alone.

Only hits move their text, and they are written once. The filter grows with the number of repeated digests, up to 16 MB
(at 12 bits each, 11 million of them, of which a text that isn't repeated passes once in 40); beyond that more rows take
the join, and nothing else changes. A digest that a third of all rows share has one entry per memtable in the runs, and
one side of the hit join has a single row for it, so adaptive execution can split it.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import filter_bits, new_folder, one_row_each, passes, table, without, written

#: Entries that a memtable holds before it is flushed as a run.
MEMTABLE_ROWS = 200_000

def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def flush_runs(rows: DataFrame, keep: str = "smallest", memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """(id, digest) to sorted runs (run, digest, keep_id, n): one run for each full memtable of a task."""
    best = min if keep == "smallest" else max

    def flush(run: int, memtable: dict) -> pa.RecordBatch:
        digests = sorted(memtable)
        ids, counts = zip(*(memtable[d] for d in digests), strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([run] * len(digests), pa.int64()), pa.array(digests, pa.binary()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64())],
            names=["run", "digest", "keep_id", "n"],
        )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, memtable = 0, {}
        for batch in batches:
            for key, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = memtable.get(digest)
                if held is None:
                    memtable[digest] = (key, 1)
                else:
                    first = held[0]
                    memtable[digest] = (key if first is None else first if key is None else best(first, key), held[1] + 1)
            if len(memtable) >= memtable_rows:
                yield flush(run, memtable)
                run, memtable = run + 1, {}
        if memtable:
            yield flush(run, memtable)

    return rows.select("id", "digest").mapInArrow(fill, "run long, digest binary, keep_id long, n long")


def compact(runs: DataFrame, keep: str = "smallest") -> DataFrame:
    """Merges runs (or earlier compactions) to one entry per digest."""
    pick = F.min if keep == "smallest" else F.max
    return runs.groupBy("digest").agg(pick("keep_id").alias("keep_id"), F.sum("n").alias("n"))


class MergeIndex:
    """The index on disk: runs of level 0, as they were flushed, and one compacted level 1. Both are sorted by digest
    and have Bloom filters, so a lookup of a few digests reads few row groups."""

    def __init__(self, spark: SparkSession, keep: str = "smallest", memtable_rows: int = MEMTABLE_ROWS):
        self.spark, self.keep, self.memtable_rows = spark, keep, memtable_rows
        self.runs: list[str] = []
        self.level: str | None = None

    def _write(self, entries: DataFrame, label: str) -> str:
        path = new_folder(self.spark, label)
        filters = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": str(self.memtable_rows)}
        entries.write.options(**filters).parquet(path)
        return path

    def add(self, rows: DataFrame) -> None:
        """Flushes the runs of (id, digest)."""
        self.runs.append(self._write(flush_runs(rows, self.keep, self.memtable_rows).select("digest", "keep_id", "n"), "runs"))

    def entries(self) -> DataFrame:
        """(digest, keep_id, n) of all levels; a digest may have several until the next compaction."""
        paths = [*self.runs, *filter(None, [self.level])]
        return self.spark.read.schema("digest binary, keep_id long, n long").parquet(*paths) if paths else self.spark.createDataFrame([], "digest binary, keep_id long, n long")

    def compact(self) -> DataFrame:
        """Merges all levels into one and returns it."""
        merged = compact(self.entries(), self.keep).sortWithinPartitions("digest")
        self.level, self.runs = self._write(merged, "compacted"), []
        return self.entries()

    def find(self, digests: list[bytes]) -> DataFrame:
        return compact(self.entries().where(F.col("digest").isin([bytearray(d) for d in digests])), self.keep)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest=sha256, memtable_rows: int = MEMTABLE_ROWS, filter_words: int | None = None) -> DataFrame:
    """One row per input row: id, digest, keep_id, group_size, kept.

    Texts are equal when their bytes are; null counts as empty. `keep` is 'smallest' or 'largest'. Null
    identifiers lose to any other; a group with no other keeps one row with a null keep_id. Of rows that
    repeat both identifier and text one is kept. An empty table gives an empty result. Other columns of docs
    are not read, so their names can't clash. `digest` is a column function to at least 12 bytes.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("digest", digest(F.col("text")))
    rows = written(texts.select("id", "digest"), "digests")
    index = MergeIndex(docs.sparkSession, keep, memtable_rows)
    index.add(rows)
    repeated = written(index.compact().where("n > 1"), "repeated")
    probe = passes(docs.sparkSession, filter_bits(repeated.select(F.xxhash64("digest").alias("hash")), filter_words))
    hits = written(texts.where(probe(F.xxhash64("digest"))).withColumn("row", F.monotonically_increasing_id()), "hits")
    # written, so that the join has plain shuffles on both sides and a digest with many hits can be split
    keepers = written(_keepers(repeated, hits), "keepers")
    joined = hits.join(keepers, "digest", "left").select(
        "id", "digest", "row", "keep_id", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce(F.col("text") == F.col("keep_text"), F.lit(True)).alias("same"), F.col("n").isNull().alias("alone")
    )
    joined = written(joined, "compared")
    if not joined.where("not same").isEmpty():
        joined = _regrouped(joined, hits, keep)
    joined = joined.withColumn("keep_id", F.when(F.col("alone"), F.col("id")).otherwise(F.col("keep_id")))
    stays, gone = joined.where(F.col("id").eqNullSafe(F.col("keep_id"))), joined.where(~F.col("id").eqNullSafe(F.col("keep_id")))
    # of rows that repeat identifier and text the first is kept; it is found in the tasks, however many they are
    part = [c for c in ("id", "digest", "part") if c in joined.columns]
    first = written(stays.groupBy(*[F.col(c).alias(f"_{c}") for c in part]).agg(F.min("row").alias("first"), F.count("*").alias("times")).where("times > 1"), "repeats")
    if first.isEmpty():
        stays = stays.withColumn("kept", F.lit(True))
    else:
        same = functools.reduce(operator.and_, [stays[c].eqNullSafe(first[f"_{c}"]) for c in part])
        stays = stays.join(first, same, "left").withColumn("kept", F.coalesce(F.col("row") == F.col("first"), F.lit(True)))
    single = rows.where(~probe(F.xxhash64("digest"))).select("id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("kept"))
    columns = ["id", "digest", "keep_id", F.col("n").alias("group_size"), "kept"]
    return single.select(columns).unionByName(stays.select(columns)).unionByName(gone.withColumn("kept", F.lit(False)).select(columns))


def _keepers(repeated: DataFrame, hits: DataFrame) -> DataFrame:
    """The repeated digests with the text of the row that stays (any of them, if rows repeat its identifier)."""
    mine = hits.select(F.col("id").alias("keep_id"), F.col("digest").alias("own"), F.col("text").alias("keep_text"))
    found = repeated.join(mine, repeated.keep_id.eqNullSafe(mine.keep_id) & (repeated.digest == mine.own))
    return found.groupBy(repeated.digest).agg(F.first(repeated.keep_id).alias("keep_id"), F.first("n").alias("n"), F.min("keep_text").alias("keep_text"))


def _regrouped(joined: DataFrame, hits: DataFrame, keep: str) -> DataFrame:
    """The exact way for digests that different texts share: groups by digest and bytes."""
    pick = F.min if keep == "smallest" else F.max
    shared = joined.where("not same").select("digest").distinct()
    texts = hits.join(shared, "digest", "left_semi")
    groups = texts.groupBy("digest", "text").agg(pick("id").alias("keep_id"), F.count("*").alias("n"))
    again = texts.join(groups, ["digest", "text"]).select("id", "digest", "row", "keep_id", "n", F.lit(True).alias("same"), F.lit(False).alias("alone"), F.xxhash64("text").alias("part"))
    rest = joined.join(shared, "digest", "left_anti").withColumn("part", F.lit(0).cast("long"))
    return written(rest.unionByName(again), "regrouped")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_groups(table(spark, sf_dir, "documents"), keep="largest")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same
         AND row_number() OVER (PARTITION BY doc_id, coalesce(text, '')) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the largest doc_id; a group without doc_ids keeps
    one as well. Of rows that repeat both doc_id and text one stays.

    Null and empty texts are equal; very long texts are compared whole. An empty table gives an empty result. All columns of
    docs pass through, whatever their names.
    """
    groups = written(exact_groups(docs, keep="largest").select("id", "digest", "keep_id", "kept"), "exact-stage")
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    gone = written(groups.where(~stays).select(F.col("id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct(), "exact-gone")
    out = without(docs, gone, {"gone_id": docs["doc_id"].cast("long"), "gone_digest": sha256(F.coalesce(docs["text"], F.lit("")))})
    return out if groups.where(stays & ~F.col("kept")).isEmpty() else one_row_each(out)
