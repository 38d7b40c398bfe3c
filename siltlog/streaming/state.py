"""Streams over the appended log: the index kept up to date, and group-commit epochs with a timer."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.window import Window

from siltlog.operators.snapshot import ORDER, without_deleted_buckets
from siltlog.sources.log import BUCKET_DELETE, LOG_SCHEMA, MARKER


class IndexStream:
    """Keeps in a folder the entries whose transaction has no marker yet, the markers seen, and the index of committed ones.

    Each micro-batch joins the new entries with the waiting ones, and what is committed now becomes a run of the index: one
    entry per key. A run takes in the runs before it while these are at most twice its size, so there are few runs, each
    more than twice as large as the next, and a small batch doesn't rewrite a large index. Markers are kept in the same way,
    for entries that arrive late. A batch ends with a file that lists its runs. Replaying a batch after a failure writes the
    same folders again, so nothing counts twice. A keeper that is made anew on the folder goes on from the newest
    complete batch; what neither it nor the one before lists is removed. Bucket deletes hide what came before them in the log.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.batch = max(self._batches("manifests"), default=-1)  # written last

    def _batches(self, kind: str) -> list[int]:
        at = self._path(f"{self.folder}/{kind}")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")]

    @staticmethod
    def _at(kind: str, batch: int) -> str:
        return f"{kind}/batch={batch:09d}"

    def _read(self, paths: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{path}")

    def _manifest(self, batch: int) -> dict:
        """Runs as [path, rows], oldest first, and the folder of the waiting entries."""
        if batch < 0:
            return {"index": [], "marks": [], "waiting": []}
        return json.loads(self.spark.read.text(f"{self.folder}/{self._at('manifests', batch)}").first().value)

    def _publish(self, manifest: dict, batch: int) -> None:
        new, final = self._path(f"{self.folder}/manifests/_new-{batch}"), self._path(f"{self.folder}/{self._at('manifests', batch)}")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._fs.delete(final, False)  # of a batch that is replayed
        if not self._fs.rename(new, final):
            raise OSError(f"can't write {final.toString()}")

    def _add(self, kind: str, runs: list, rows: DataFrame, merged, schema, batch: int) -> list:
        """The runs after `rows` became one, with the runs that it takes in."""
        new = self._at(f"new-{kind}", batch)
        self._write(rows, new)
        size = self._read([new], schema).count()
        if not size:
            return runs
        runs, taken = list(runs), []
        while runs and runs[-1][1] <= 2 * size:
            path, n = runs.pop()
            taken.append(path)
            size += n
        if not taken:
            return [*runs, [new, size]]
        path = self._at(kind, batch)
        self._write(merged(self._read([*taken, new], schema)), path)
        return [*runs, [path, self._read([path], schema).count()]]

    @staticmethod
    def _last(rows: DataFrame) -> DataFrame:
        """The last entry of each key, and the last marker of each bucket."""
        marker = (F.col("ds") == MARKER) & (F.col("flag") == BUCKET_DELETE)
        columns = [f.name for f in LOG_SCHEMA]
        last = Window.partitionBy("bucket", F.when(~marker, F.col("key")), marker).orderBy(*[F.desc(c) for c in ORDER])
        return rows.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").select(columns)

    def apply(self, rows: DataFrame, batch: int) -> None:
        before = self._manifest(batch - 1)
        columns, marked = [f.name for f in LOG_SCHEMA], "tx_id bigint"
        marks = self._add("marks", before["marks"], rows.where("status = 1").select("tx_id").distinct(), DataFrame.distinct, marked, batch)
        known = self._read([p for p, _ in marks], marked)
        waiting = self._read(before["waiting"], LOG_SCHEMA).unionByName(rows.select(columns))
        index = self._add("index", before["index"], self._last(waiting.join(known, "tx_id", "left_semi").select(columns)), self._last, LOG_SCHEMA, batch)
        self._write(waiting.join(known, "tx_id", "left_anti").select(columns), self._at("waiting", batch))
        now = {"index": index, "marks": marks, "waiting": [self._at("waiting", batch)]}
        self._publish(now, batch)
        self.batch = batch
        used = {p for m in (before, now) for p in (*(p for p, _ in m["index"]), *(p for p, _ in m["marks"]), *m["waiting"])}
        for kind in ("index", "marks", "waiting", "new-index", "new-marks", "manifests"):  # the batch before stays, in case this one is replayed
            for old in self._batches(kind):
                if self._at(kind, old) not in used and (kind != "manifests" or old < batch - 1):
                    self._fs.delete(self._path(f"{self.folder}/{self._at(kind, old)}"), True)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def index(self) -> DataFrame:
        runs = self._manifest(self.batch)["index"]
        return without_deleted_buckets(self._last(self._read([p for p, _ in runs], LOG_SCHEMA)))


class EpochProcessor(StatefulProcessor):
    """Group-commit epochs per instance: an epoch closes when it is full, or when its delay after the first waiter has
    passed, which a timer tells if no waiter comes. Emits (instance, epoch, waiters, frontier) for each closed epoch.

    A stream with timers has no end, as another batch may always close an epoch; without them it can run to the end of
    its input, and epochs that are open then stay in the state.
    """

    def __init__(self, max_writes: int = 16, max_delay_ms: int = 1000, timers: bool = True):
        self.max_writes, self.max_delay, self.timers = max_writes, max_delay_ms, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "epoch bigint, first bigint, n bigint, last bigint")

    def _open(self) -> tuple[int, int, int, int]:
        return tuple(self.state.get()) if self.state.exists() else (1, 0, 0, 0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        epoch, first, n, last = self._open()
        out = []
        for frame in rows:
            for seq, at in zip(*(frame.sort_values("seq")[c] for c in ("seq", "at")), strict=True):
                if n and (n == self.max_writes or at >= first + self.max_delay):
                    out.append((key[0], epoch, n, last))
                    epoch, n = epoch + 1, 0
                if not n:
                    first = int(at)
                n, last = n + 1, int(seq)
        if n == self.max_writes:
            out.append((key[0], epoch, n, last))
            epoch, n = epoch + 1, 0
        self.state.update((epoch, first, n, last))
        if self.timers:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if self.timers and n:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.max_delay)
        yield pd.DataFrame(out, columns=["instance", "epoch", "waiters", "frontier"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        epoch, first, n, last = self._open()
        if n:
            self.state.update((epoch + 1, first, 0, last))
            yield pd.DataFrame([(key[0], epoch, n, last)], columns=["instance", "epoch", "waiters", "frontier"])

    def close(self) -> None:
        pass


def epochs(stream: DataFrame, max_writes: int = 16, max_delay_ms: int = 1000, timers: bool = True) -> DataFrame:
    """(instance, seq, at in ms) to closed epochs."""
    schema = "instance bigint, epoch bigint, waiters bigint, frontier bigint"
    return stream.groupBy("instance").transformWithStateInPandas(EpochProcessor(max_writes, max_delay_ms, timers), schema, "Append", "ProcessingTime" if timers else "None")


def run_index(spark: SparkSession, log: DataFrame, folder: str, files: int = 4) -> DataFrame:
    """Writes a log as files, streams them, and returns the index that the stream keeps."""
    source = f"{folder}/source-{uuid.uuid4().hex}"
    log.repartition(files).write.parquet(source)
    keeper = IndexStream(spark, f"{folder}/state-{uuid.uuid4().hex}")
    stream = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    keeper.start(stream, f"{folder}/checkpoint-{uuid.uuid4().hex}").awaitTermination()
    return keeper.index()


def run_epochs(spark: SparkSession, waiters: DataFrame, folder: str, max_writes: int = 16, max_delay_ms: int = 1000) -> DataFrame:
    """Streams (instance, seq, at) from files and returns the epochs that were closed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out = f"{folder}/source-{uuid.uuid4().hex}", f"{folder}/epochs-{uuid.uuid4().hex}"
    waiters.repartition("instance").write.parquet(source)
    stream = spark.readStream.schema("instance bigint, seq bigint, at bigint").parquet(source)
    query = epochs(stream, max_writes, max_delay_ms, timers=False).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/checkpoint-{uuid.uuid4().hex}")
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("instance bigint, epoch bigint, waiters bigint, frontier bigint").parquet(out)


