"""Commands that write: appending to a log table, merging files, collecting a value log's garbage.

A log table is a folder of Parquet data sets and of numbered pointers. A pointer is one file that says of each data set of a
snapshot which log files it has and which of these a merge has replaced since; such files aren't read any more, so a
merge writes what survives of its sources and nothing else. A command writes a new data set, then a pointer under a temporary
name, and renames it to the next number, which fails if that number exists: of two commands that publish the same number
one gets an error. A reader takes the highest number, so it sees the old state or the new one. A command that dies in
between leaves the old state and folders that vacuum() removes.
"""

from __future__ import annotations

import functools
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltlog.functions.expr import byte_length
from siltlog.operators import compaction, stats
from siltlog.sources.log import LOG_SCHEMA, NOW, VALUE


class EmptyKey(ValueError):
    pass


class EmptyBucket(ValueError):
    pass


class LostRace(RuntimeError):
    """Another command has published a snapshot since this one read the table."""


#: How pointers' names begin; a number of twelve digits follows.
POINTER = "snapshot-"


def _joined(ranges: list[list[int]]) -> list[list[int]]:
    """Ranges of file numbers in order, those that meet in one."""
    out: list[list[int]] = []
    for first, last in sorted(map(list, ranges)):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


class LogTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._new_path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._new_path(self.path).getFileSystem(self._conf)

    def _version(self) -> int:
        """The number of the newest pointer, -1 for a new table."""
        at = self._new_path(self.path)
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max((int(n[len(POINTER) :]) for n in names if n.startswith(POINTER) and n[len(POINTER) :].isdigit()), default=-1)

    def _current(self, version: int) -> list[dict]:
        """The data sets of a snapshot: kind, name, first and last file, ranges of files that merges have replaced."""
        if version < 0:
            return []
        return [json.loads(r.value) for r in self.spark.read.text(f"{self.path}/{POINTER}{version:012d}").collect() if r.value]

    def _publish(self, sets: list[dict], after: int) -> None:
        """Makes sets the snapshot that follows number `after`. The rename creates its target or fails."""
        new, final = self._new_path(f"{self.path}/new-{uuid.uuid4().hex}"), self._new_path(f"{self.path}/{POINTER}{after + 1:012d}")
        out = self._fs.create(new, False)
        out.write(bytearray("".join(json.dumps(x) + "\n" for x in sets).encode()))
        out.close()
        how = self._jvm.org.apache.hadoop.fs.Options.Rename
        flags = self.spark.sparkContext._gateway.new_array(how, 1)
        flags[0] = how.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(new, final, flags)
        except Py4JJavaError as error:
            self._fs.delete(new, False)
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                raise LostRace("another command has published a snapshot meanwhile") from None
            raise

    def _read(self, sets: list[dict]) -> DataFrame:
        at = lambda x: f"{self.path}/{x['name']}"
        whole = [at(x) for x in sets if x["kind"] == "data" and not x["replaced"]]
        marks = [at(x) for x in sets if x["kind"] == "marks"]
        logs = [self.spark.read.schema(LOG_SCHEMA).parquet(*whole)] if whole else []
        for x in sets:
            if x["kind"] == "data" and x["replaced"]:
                log = self.spark.read.schema(LOG_SCHEMA).parquet(at(x))
                logs.append(functools.reduce(lambda d, r: d.where(~F.col("file_id").between(*r)), x["replaced"], log))
        if not logs:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        log = functools.reduce(DataFrame.unionByName, logs)
        return compaction.with_marks(log, self.spark.read.schema("tx_id long").parquet(*marks)) if marks else log

    def read(self) -> DataFrame:
        return self._read(self._current(self._version()))

    def _write(self, log: DataFrame) -> dict | None:
        """Writes a data set; None if it has no rows."""
        name = f"data-{uuid.uuid4().hex}"
        # clustered by key, in as many tasks as it takes: statistics of row groups prune point reads and ranges
        place = ["bucket", "key", "file_id", "pos"]
        log.select([f.name for f in LOG_SCHEMA]).repartitionByRange(*place).sortWithinPartitions(*place).write.parquet(f"{self.path}/{name}")
        files = self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.path}/{name}").agg(F.min("file_id").alias("first"), F.max("file_id").alias("last")).first()
        return None if files["first"] is None else {"kind": "data", "name": name, "first": files["first"], "last": files["last"], "replaced": []}

    def _next_file(self, sets: list[dict]) -> int:
        return max((x["last"] for x in sets if x["kind"] == "data"), default=-1) + 1

    def _append(self, entries: DataFrame, ts: int, flag: int, sets: list[dict], version: int, last: int) -> None:
        file_id = self._next_file(sets)
        given = lambda name, default: F.col(name) if name in entries.columns else F.lit(default)
        rows = entries.select(
            F.lit(file_id).cast("long").alias("file_id"), F.col("seq").alias("pos"), "bucket", "key", "value", given("flag", flag).cast("int").alias("flag"), (F.col("seq") == last).cast("int").alias("status"),
            given("ds", VALUE).cast("int").alias("ds"), F.col("ttl").cast("long").alias("ttl"), given("ts", ts).cast("long").alias("ts"), F.lit(file_id).cast("long").alias("tx_id"),
        )
        self._publish([*sets, self._write(rows)], version)

    def put_batch(self, entries: DataFrame, ts: int, flag: int = 1) -> None:
        """(seq, bucket, key, value, ttl) in one transaction: all entries or none; the last one by seq has the marker.

        Columns ds, flag and ts, if there, stand for the arguments of the same name. An empty key or bucket rejects the
        batch; an empty batch does nothing.
        """
        version = self._version()
        sets = self._current(version)
        bad = entries.agg(F.count_if(F.coalesce(F.length("key"), F.lit(0)) == 0).alias("keys"), F.count_if(F.coalesce(F.length("bucket"), F.lit(0)) == 0).alias("buckets"), F.count("*").alias("n"), F.max("seq").alias("last")).first()
        if bad["keys"]:
            raise EmptyKey("an entry has no key")
        if bad["buckets"]:
            raise EmptyBucket("an entry has no bucket")
        if bad["n"]:
            self._append(entries, ts, flag, sets, version, bad["last"])

    def put(self, bucket: str, key: str, value: str | None, ts: int, ttl: int = 0, flag: int = 1) -> None:
        """One entry in a transaction of its own. Unlike a batch it may have an empty bucket; an empty key is rejected."""
        if not key:
            raise EmptyKey("the entry has no key")
        version = self._version()
        entry = self.spark.createDataFrame([(0, bucket, key, value, ttl)], "seq long, bucket string, key string, value string, ttl long")
        self._append(entry, ts, flag, self._current(version), version, 0)

    def load(self, log: DataFrame) -> None:
        version = self._version()
        new = self._write(log)
        if new:
            self._publish([*self._current(version), new], version)

    def _merge(self, sets: list[dict], version: int, targets: list[tuple[int, int]], now: int) -> None:
        """Publishes the survivors of the sources in place of the source files."""
        log = self._read(sets)
        sources = self.spark.createDataFrame(targets, "file_id long, target long")
        new = self._write(compaction.merged_files(log, sources, now))
        name = f"marks-{uuid.uuid4().hex}"
        compaction.late_marks(log, sources).write.parquet(f"{self.path}/{name}")
        marked = not self.spark.read.schema("tx_id long").parquet(f"{self.path}/{name}").isEmpty()
        by_target: dict[int, list[int]] = {}
        for file_id, target in targets:
            by_target.setdefault(target, []).append(file_id)
        gone = [[min(files), max(files)] for files in by_target.values()]
        kept = []
        for x in sets:
            if x["kind"] == "data":
                x = {**x, "replaced": _joined([*x["replaced"], *([max(a, x["first"]), min(b, x["last"])] for a, b in gone if a <= x["last"] and b >= x["first"])])}
                if any(a <= x["first"] and x["last"] <= b for a, b in x["replaced"]):
                    continue
            kept.append(x)
        self._publish([*kept, *([new] if new else []), *([{"kind": "marks", "name": name}] if marked else [])], version)

    def merge(self, sources: DataFrame, now: int = NOW) -> None:
        """Rewrites the source files into one, which takes the place of the newest of them.

        Sources must be consecutive up to the newest, or an entry of a file between them could lose its order.
        """
        version = self._version()
        sets = self._current(version)
        ids = sorted(r.file_id for r in sources.select("file_id").distinct().collect())  # a file list, as long as the log's
        if len(ids) < 2:
            raise ValueError("a merge needs two files")
        if not self._read(sets).where(F.col("file_id").between(ids[0], ids[-1]) & ~F.col("file_id").isin(ids)).isEmpty():
            raise ValueError("files between the sources aren't merged")
        self._merge(sets, version, [(f, ids[-1]) for f in ids], now)

    def merge_within(self, budget: int, now: int = NOW) -> list[list[int]]:
        """Merges the segments that fit the budget, first fit in file order; returns the runs of files merged.

        Files that stay out split the others into runs; a run of one file is left as it is. All runs are merged in one
        pass and published together; nothing but their survivors is written.
        """
        version = self._version()
        sets = self._current(version)
        segments = stats.segments(self._read(sets), now=now)
        taken = compaction.within_budget(segments, budget).select(F.col("file_id").alias("_file"))
        listed = segments.join(taken, F.col("file_id") == F.col("_file"), "left").select("file_id", "_file").collect()  # a file list
        targets = compaction.run_targets([r.file_id for r in listed], {r["_file"] for r in listed if r["_file"] is not None})
        if targets:
            self._merge(sets, version, targets, now)
        runs: dict[int, list[int]] = {}
        for file_id, target in targets:
            runs.setdefault(target, []).append(file_id)
        return list(runs.values())

    def merge_recommended(self, recommendation: DataFrame, now: int = NOW) -> list[list[int]]:
        """Does what compaction.recommend() says: nothing if it isn't available or has no budget."""
        row = recommendation.first()
        return self.merge_within(row.budget, now) if row and row.available and row.budget else []

    def vacuum(self) -> None:
        """Removes data sets and pointers that the current snapshot doesn't use."""
        version = self._version()
        used = {*(x["name"] for x in self._current(version)), f"{POINTER}{version:012d}"}
        for status in self._fs.listStatus(self._new_path(self.path)):
            if status.getPath().getName() not in used:
                self._fs.delete(status.getPath(), True)


def separate(entries: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Entries with short values as they are, and the long ones for the value log."""
    long = byte_length("value") >= threshold
    return entries.where(~long), entries.where(long)


def collect_garbage(values: DataFrame, pointers: DataFrame, keys: list[str], segment: int) -> tuple[DataFrame, DataFrame]:
    """Moves what is live in a segment to the end of the log: (values, pointers) after it.

    values (keys, segment, offset, value) and pointers (keys, segment, offset, size, ...); offsets in the new segment,
    which follows the last one, are running sums of sizes in the old order.
    """
    last = values.groupBy(*keys).agg((F.max("segment") + 1).alias("_new"))
    moving = pointers.where(F.col("segment") == segment).join(last, keys)
    before = Window.partitionBy(*keys).orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    moved = moving.withColumn("_at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    kept = values.where(F.col("segment") != segment)
    copied = moved.select(*keys, "segment", "offset", "_new", "_at").join(values, [*keys, "segment", "offset"])
    new_values = kept.unionByName(copied.select(*keys, F.col("_new").alias("segment"), F.col("_at").alias("offset"), "value"))
    new_pointers = pointers.where(F.col("segment") != segment).unionByName(moved.withColumns({"segment": F.col("_new"), "offset": F.col("_at")}).select(pointers.columns))
    return new_values, new_pointers
