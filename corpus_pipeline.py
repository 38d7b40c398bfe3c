"""A corpus pipeline: toxicity, exact dedup, SimHash near-dedup, secret scans, best-fit packing.

Each stage works on all rows that its predecessor kept and is written as Parquet, in the folder that executors
share, before the next one reads it. Toxic documents go, of equal texts the one with the largest doc_id stays,
of near copies the one with the smallest; secrets are replaced in the texts of those that are left, which are
then packed. Rows with nulls, empty texts and repeated rows pass through every stage as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltlog.llm import exact_dedup, packing, secrets, simhash, toxicity
from siltlog.llm.base import table, written

STAGES = [
    ("toxicity", toxicity.stage),
    ("exact_dedup", exact_dedup.stage),
    ("simhash_near_dedup", simhash.stage),
    ("secrets", secrets.stage),
    ("packing", packing.stage),
]

#: The classifier, the similarity and the packing are beyond SQL; a test holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
