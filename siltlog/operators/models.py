"""Workload generators, fault schedules, recovery tables, and the two scaffolds (overlay store, replicated log)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltlog.functions.expr import numbered_key, over_limit
from siltlog.functions.fold import ordered_fold


def _ops(rows: DataFrame, kind, key, size) -> DataFrame:
    return rows.select(F.col("id").alias("seq"), kind.alias("kind"), numbered_key(key).alias("key"), size.cast("long").alias("bytes"))


def sequential(spark: SparkSession, keys: int) -> DataFrame:
    """Each key is put once, then read once; values are 'value-' and six digits."""
    at = F.col("id")
    put = at < keys
    return _ops(spark.range(2 * keys), F.when(put, "put").otherwise("get"), F.expr(f"id % {keys}"), F.when(put, 12).otherwise(0))


def hotspot(spark: SparkSession, keys: int, reads: int, hot: list[int]) -> DataFrame:
    """sequential(), then reads that go round the hot keys."""
    at = F.col("id") - 2 * keys
    hot_key = F.get(F.array(*[F.lit(k).cast("long") for k in hot]), F.pmod(at, F.lit(len(hot))).cast("int"))
    put = F.col("id") < keys
    return _ops(spark.range(2 * keys + reads), F.when(put, "put").otherwise("get"), F.when(at < 0, F.expr(f"id % {keys}")).otherwise(hot_key), F.when(put, 12).otherwise(0))


def overwrite_hotset(spark: SparkSession, keys: int, writes: int, hotset: int, size: int) -> DataFrame:
    """Each key is put once, then the first `hotset` keys are put in turn."""
    return _ops(spark.range(keys + writes), F.lit("put"), F.when(F.col("id") < keys, F.col("id")).otherwise((F.col("id") - keys) % hotset), F.lit(size))


def cold_garbage(spark: SparkSession, keys: int, overwritten: int, size: int) -> DataFrame:
    """Each key is put once, then the first `overwritten` keys once more."""
    return _ops(spark.range(keys + overwritten), F.lit("put"), F.when(F.col("id") < keys, F.col("id")).otherwise(F.col("id") - keys), F.lit(size))


def mixed(spark: SparkSession, keys: int, operations: int, write_percent: int, size: int) -> DataFrame:
    """Each key is put once, then reads and writes in turn over the keys, writes spread evenly."""
    at = f"(id - {keys})"
    writes = F.expr(f"id < {keys} OR ({at} + 1) * {write_percent} div 100 > {at} * {write_percent} div 100")
    return _ops(spark.range(keys + operations), F.when(writes, "put").otherwise("get"), F.when(F.col("id") < keys, F.col("id")).otherwise((F.col("id") - keys) % keys), F.lit(size))


def fault_schedule(calls: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(idx, point) with the number of the call of its point and whether it fails; points without limit never fail."""
    nth = F.row_number().over(Window.partitionBy("point").orderBy("idx")).cast("long")
    limit = F.lit(None).cast("long")
    for point, n in limits.items():
        limit = F.when(F.col("point") == point, n).otherwise(limit)
    fails = F.coalesce((limit >= 0) & (nth > limit), F.lit(False))
    return calls.withColumns({"call": nth, "fails": fails})


def point_fails(calls: DataFrame, limit: int) -> DataFrame:
    return calls.withColumn("fails", over_limit(limit, F.col("call")))


def torn_writes(spark: SparkSession, header: int, bucket: int, key: int, value: int) -> DataFrame:
    """Every byte of an entry at which a write may be torn: region, offset, bytes up to the region's end."""
    rows, base = [], 0
    for name, size in (("header", header), ("bucket", bucket), ("key", key), ("value", value)):
        rows.append((name, base, size))
        base += size
    regions = spark.createDataFrame(rows, "region string, base long, length long").where("length > 0")
    out = regions.select("region", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("length") - 1)).alias("offset"), (F.col("base") + F.col("length")).alias("size"))
    return out.withColumn("id", F.format_string("recovery/torn-write/region=%s/offset=%d/size=%d", "region", "offset", "size"))


#: Fixed tables: manifest writes (kind, phase, occurrence) and the stages of each.
MANIFEST_WRITES = [
    ("merge", "prepared", 1),
    ("merge", "installed", 2),
    ("value-gc", "prepared", 1),
    ("value-gc", "prepared", 2),
    ("value-gc", "pointers-installed", 3),
    ("value-gc", "source-removed", 4),
    ("value-gc", "finalized", 5),
]
MANIFEST_STAGES = ["temp-write", "file-sync", "rename", "directory-sync"]

#: Fixed table of recovery scenarios: name, fault point, place in the scenario, kind, transaction, key, value, marker, expiry.
SCENARIOS = [
    ("before-first-write", "before-first-write", None, None, None, None, None, None, None),
    ("before-commit-marker", "before-commit-marker", 0, "put", 1, "partial", "hidden", False, 0),
    ("after-commit-marker", "after-commit-marker", 0, "put", 1, "first", "v1", False, 0),
    ("after-commit-marker", "after-commit-marker", 1, "put", 1, "second", "v2", True, 0),
    ("uncommitted-newer-overwrite", "before-second-commit-marker", 0, "put", 1, "key", "old", True, 0),
    ("uncommitted-newer-overwrite", "before-second-commit-marker", 1, "put", 2, "key", "new", False, 0),
    ("committed-tombstone", "after-delete-marker", 0, "put", 1, "key", "old", True, 0),
    ("committed-tombstone", "after-delete-marker", 1, "delete", 2, "key", None, True, 0),
    ("expired-value", "after-expired-marker", 0, "put", 1, "expired", "old", True, 10),
]
SCENARIO_SCHEMA = "scenario string, fault_point string, idx long, kind string, tx_id long, key string, value string, committed boolean, expires_at long"


def manifest_faults(spark: SparkSession) -> DataFrame:
    """The fixed matrix of manifest writes and stages (7 by 4), with what recovery has to do."""
    rows = [(*w, s) for w in MANIFEST_WRITES for s in MANIFEST_STAGES]
    out = spark.createDataFrame(rows, "kind string, phase string, occurrence long, stage string")
    synced = F.when(F.col("phase").isin("installed", "pointers-installed"), "remove-source").when(F.col("phase").isin("source-removed", "finalized"), "clear-manifest").otherwise("retain-source")
    action = F.when(F.col("stage").isin("temp-write", "file-sync"), "ignore-attempt").when(F.col("stage") == "directory-sync", synced).otherwise("retain-source")
    return out.withColumns({"action": action, "id": F.format_string("manifest/%s/phase=%s/stage=%s/occurrence=%d", "kind", "phase", "stage", "occurrence")}).orderBy("id")


def merge_manifest_decision(manifests: DataFrame) -> DataFrame:
    """(state, phase, targets, present) with what an open does: state is missing, corrupt or read."""
    known = F.col("phase").isin("prepared", "installed")
    action = F.when(F.col("state") == "missing", "nothing").when((F.col("state") == "corrupt") | ~known, "error").when((F.col("phase") == "installed") & (F.col("present") >= F.col("targets")), "remove-source-and-clear").otherwise("clear")
    return manifests.withColumn("action", action)


def scenario_results(ops: DataFrame, now: int) -> DataFrame:
    """(scenario, idx, kind, tx_id, key, value, committed, expires_at) to the last state of each key: value and found."""
    marks = ops.where("committed").select("scenario", "tx_id").distinct()
    applied = ops.join(marks, ["scenario", "tx_id"], "left_semi")
    gone = (F.col("kind") == "delete") | ((F.col("expires_at") > 0) & (F.col("expires_at") <= now))
    last = applied.groupBy("scenario", "key").agg(F.max_by(F.struct((~gone).alias("found"), F.when(~gone, F.col("value")).alias("value")), "idx").alias("s"))
    return last.select("scenario", "key", "s.found", "s.value")


def overlay(sorted_table: DataFrame, write_ahead: DataFrame) -> DataFrame:
    """(key, value, seq): the write-ahead log's last value of a key hides the sorted table's."""
    both = sorted_table.withColumn("_level", F.lit(0)).unionByName(write_ahead.withColumn("_level", F.lit(1)))
    return both.groupBy("key").agg(F.max_by("value", F.struct("_level", "seq")).alias("value"))


def flush(sorted_table: DataFrame, write_ahead: DataFrame) -> DataFrame:
    """The sorted table (key, value, seq) that takes the place of both; the write-ahead log is empty after it. Written in
    key order, it is what a store that is opened again reads first."""
    both = sorted_table.withColumn("_level", F.lit(0)).unionByName(write_ahead.withColumn("_level", F.lit(1)))
    last = both.groupBy("key").agg(F.max_by(F.struct("value", "seq"), F.struct("_level", "seq")).alias("_last"))
    return last.select("key", "_last.value", "_last.seq").orderBy("key")


def replicated_append(batches: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, batch, order, index, term, command): the entries held in the end, and how each batch ended.

    An entry with the index and term of one held is passed over; another term cuts the log there; index 0 or a gap
    is a conflict that ends the batch, whose earlier entries stay. Emits one row per entry of the input: its effect and
    the log's last index after it. The state is one term per entry held.
    """
    kinds = dict(batches.dtypes)

    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        if row["batch"] != s["batch"]:
            s |= {"batch": row["batch"], "failed": False}
        terms, at = s["terms"], row["index"]
        if s["failed"]:
            effect = "not reached"
        elif at == 0:
            effect, s["failed"] = "conflict", True
        elif at <= len(terms) and terms[at - 1] == row["term"]:
            effect = "present"
        else:
            effect = "appended" if at > len(terms) else "replaced"
            del terms[max(at - 1, 0) :]
            if at != len(terms) + 1:
                effect, s["failed"] = "conflict", True
            else:
                terms.append(row["term"])
        return s, [{**{k: row[k] for k in [*keys, "batch", *order, "index", "term"]}, "effect": effect, "last_index": len(terms)}]

    columns = [*keys, "batch", *order, "index", "term"]
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in columns), "effect string", "last_index bigint"])
    return ordered_fold(batches.select(*columns), keys, ["batch", *order], lambda: {"terms": [], "batch": None, "failed": False}, step, schema)


def held_entries(appended: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, index, term) that each replicated log holds after all batches: of an index the last entry put there, up to
    the last index. A lookup is a filter on the index."""
    put = appended.where(F.col("effect").isin("appended", "replaced")).groupBy(*keys, "index").agg(F.max_by("term", order).alias("term"))
    return put.join(last_index(appended, keys, order), keys).where(F.col("index") <= F.col("last_index")).drop("last_index")


def last_index(appended: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last index of each replicated log after all batches."""
    return appended.groupBy(*keys).agg(F.max_by("last_index", order).alias("last_index"))


def fixed_value(size):
    """Bytes 0, 1, ... 250, 0, ... of the given length, as hex."""
    return F.when(size > 0, F.array_join(F.transform(F.sequence(F.lit(0), (size - 1).cast("int")), lambda k: F.lpad(F.lower(F.hex(k % 251)), 2, "0")), "")).otherwise("")
