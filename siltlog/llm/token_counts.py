"""Token counts of documents in flat token files, found by scanning for the separator.

A flat file is a run of token ids without an index; each document ends with a separator. The file is read in
blocks. In each block a vectorised search finds the separators; a prefix scan over the blocks of a file (how many
separators came before, and where the last one stood) then stitches documents that cross block borders. The scan
carries two numbers per block, so a document may span any number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import new_folder, table, written
from .tokens import encode_ranks, ranks, vocabulary

#: Tokens per block: 2 MB of 16-bit ids.
BLOCK_TOKENS = 1 << 20


def write_blocks(docs: DataFrame, path: str, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the texts as flat token files, one per task, each document followed by the separator.

    Returns (file, block, data, ids): data are little-endian ids of `width` bytes (see width_of); ids are the
    identifiers of the documents that end in the block, which the scan doesn't read.
    """
    kind, separator = f"<u{width_of(path)}", separator_of(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        block, held, size, ids = 0, [], 0, []

        def row(data: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}"]), pa.array([block], pa.int64()), pa.array([data.tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], names=["file", "block", "data", "ids"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                left = np.append(encode_ranks(path, text.as_py() or ""), separator).astype(kind)
                while size + len(left) > block_tokens:
                    cut = block_tokens - size
                    yield row(np.concatenate([*held, left[:cut]]))
                    block, held, size, ids, left = block + 1, [], 0, [], left[cut:]
                held.append(left)
                size += len(left)
                ids.append(key)
        if size:
            yield row(np.concatenate(held))

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "file string, block long, data binary, ids array<long>")
    where = new_folder(docs.sparkSession, "token-files")
    out.write.option("compression", "zstd").parquet(where)
    return docs.sparkSession.read.schema(out.schema).parquet(where)


def read_blocks(spark: SparkSession, paths: list[str], width: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, data) of flat binary files of ids of `width` bytes, each read by ranges as several tasks.

    The file systems are those that Arrow opens (local, HDFS, S3, GCS). A last id that is cut short is an error.
    """
    import pyarrow.fs

    step, rows = width * block_tokens, []
    for path in paths:
        system, at = pyarrow.fs.FileSystem.from_uri(path)
        size = system.get_file_info(at).size
        if size % width:
            raise ValueError(f"{path}: {size} bytes are no whole number of ids")
        rows += [(path, k, min(step, size - k * step)) for k in range(-(-size // step))]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, k, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, at = pyarrow.fs.FileSystem.from_uri(path)
                with system.open_input_file(at) as file:
                    data = file.read_at(size, k * step)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k], pa.int64()), pa.array([data], pa.binary())], names=["file", "block", "data"])

    plan = spark.createDataFrame(rows, "file string, block long, size long").repartition(max(1, min(len(rows), 10_000)), "file", "block")
    return plan.mapInArrow(fetch, "file string, block long, data binary")


def separator_of(path: str) -> int:
    """The id after the vocabulary's last, which its text never uses."""
    return max(ranks(path).values()) + 1


def width_of(path: str) -> int:
    return 2 if separator_of(path) < 1 << 16 else 4


def scan(blocks: DataFrame, separator: int, width: int) -> DataFrame:
    """(file, block, data) to one row per block: file, block, size, ends (places in the block of its separators)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends = [], []
            for data in batch.column(2):
                ids = np.frombuffer(data.as_buffer() or b"", f"<u{width}") if data.is_valid else np.empty(0, f"<u{width}")
                sizes.append(len(ids))
                ends.append(np.flatnonzero(ids == separator))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["file", "block", "size", "ends"])

    return blocks.select("file", "block", "data").mapInArrow(run, "file string, block long, size long, ends array<long>")


def documents(scanned: DataFrame) -> DataFrame:
    """One row per document: file, ordinal (from 0), block (where it ends), start, n_tokens (without separator), closed.

    Tokens after a file's last separator are a document that isn't closed; a separator right after another, or
    at the start, ends an empty document. Files without tokens have no document.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    sizes = scanned.select("file", "block", "size", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    placed = sizes.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    placed = placed.withColumn("end", F.col("at") + F.col("last") + 1)
    placed = placed.select(
        "file", "block", "at",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ordinal"), F.coalesce(F.max("end").over(before), F.lit(0)).alias("open"),
        F.sum("size").over(whole).alias("total"), F.sum("n").over(whole).alias("documents"), F.coalesce(F.max("end").over(whole), F.lit(0)).alias("closed"),
        F.max("block").over(whole).alias("last_block"),
    )
    found = scanned.select("file", "block", "ends").join(placed.select("file", "block", "at", "ordinal", "open"), ["file", "block"])
    ends = F.transform("ends", lambda x: x + F.col("at"))
    pairs = F.arrays_zip(F.concat(F.array("open"), F.transform(ends, lambda x: x + 1)).alias("start"), ends.alias("end"))
    rows = found.select("file", "block", "ordinal", F.posexplode(F.filter(pairs, lambda p: p["end"].isNotNull())).alias("k", "p"))
    closed = rows.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), "block", "k", F.col("p.start").alias("start"), (F.col("p.end") - F.col("p.start")).alias("n_tokens"), F.lit(True).alias("closed"))
    tail = placed.where((F.col("block") == F.col("last_block")) & (F.col("total") > F.col("closed")))
    tail = tail.select("file", F.col("documents").alias("ordinal"), "block", F.lit(None).cast("int").alias("k"), F.col("closed").alias("start"), (F.col("total") - F.col("closed")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(tail)


def count_tokens(blocks: DataFrame, separator: int, width: int) -> DataFrame:
    """documents() of the scan of the blocks, which may come from write_blocks or read_blocks."""
    return documents(written(scan(blocks, separator, width), "scanned"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens (without separator), file, ordinal and start of each document in the flat files.

    Null and empty texts have no token but a separator; repeated rows are documents of their own; an empty table
    gives an empty result; other columns aren't read.
    """
    path = vocabulary("byte_bpe_50k.tiktoken")
    blocks = write_blocks(table(spark, sf_dir, "documents"), path)
    found = count_tokens(blocks, separator_of(path), width_of(path))
    ids = blocks.select("file", "block", F.posexplode("ids").alias("k", "doc_id"))
    return ids.join(found, ["file", "block", "k"]).select("doc_id", "n_tokens", "file", "ordinal", "start")
