"""A log table with its long values beside it, in a value log of numbered segments.

A segment is a Parquet folder of (offset, value), written once; a value's offset is its entry's place in the batch, so no
task has to see the sizes of the others. Every command writes the segment first and publishes the log's pointer after it:
an entry of the log never points to a value that isn't there. A command that dies in between, or loses the race for the
snapshot, leaves a segment to which nothing points, which is garbage like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.functions.expr import decode_pointer, encode_pointer
from siltlog.operators import snapshot, valuelog
from siltlog.plans.maintenance import LogTable
from siltlog.sources.log import NOW, POINTER, VALUE


class NoCandidate(ValueError):
    """No segment is stale enough."""


class StillInUse(RuntimeError):
    """After its live values were copied, a segment still had live pointers."""


@dataclass(frozen=True)
class Collected:
    """What a garbage collection did."""

    segment: int
    source_bytes: int
    live_bytes: int
    stale_bytes: int
    values_copied: int
    bytes_reclaimed: int


class ValueTable:
    def __init__(self, spark: SparkSession, path: str, threshold: int = 1024):
        self.spark, self.path, self.threshold = spark, path.rstrip("/"), threshold
        self.log = LogTable(spark, f"{self.path}/log")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _claim(self) -> int:
        """A segment's number that no other command has: a file created exclusively says so."""
        folder = self._path(f"{self.path}/claims")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        number = max((int(n) for n in names if n.isdigit()), default=-1) + 1
        while not self._fs.createNewFile(self._path(f"{self.path}/claims/{number}")):
            number += 1
        return number

    def _at(self, segment: int) -> str:
        return f"{self.path}/values/segment={segment}"

    def values(self) -> DataFrame:
        """(segment, offset, value) of all segments."""
        schema = "offset long, value string, segment long"
        if not self._fs.exists(self._path(f"{self.path}/values")):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/values")

    def _write_segment(self, values: DataFrame) -> int:
        segment = self._claim()
        values.select("offset", "value").write.parquet(self._at(segment))
        return segment

    @staticmethod
    def _pointer(segment: int):
        """The log's value for an entry whose value has gone to a segment under the number seq."""
        data = F.col("value")
        return F.base64(encode_pointer(F.lit(segment), F.col("seq"), F.octet_length(data), F.crc32(data.cast("binary"))))

    def put_batch(self, entries: DataFrame, ts: int) -> None:
        """(seq, bucket, key, value, ttl) in one transaction; values of at least `threshold` bytes go to a new segment,
        which is complete before the log is published. seq must differ from row to row."""
        long = F.coalesce(valuelog.separates(self.threshold), F.lit(False))
        separated = entries.where(long)
        if separated.isEmpty():
            return self.log.put_batch(entries, ts)
        segment = self._write_segment(separated.select(F.col("seq").alias("offset"), "value"))
        self.log.put_batch(entries.withColumns({"value": F.when(long, self._pointer(segment)).otherwise(F.col("value")), "ds": F.when(long, POINTER).otherwise(VALUE)}), ts)

    def _pointers(self, now: int) -> DataFrame:
        """Live pointers of the current snapshot: the entry's columns with segment, offset, size and crc."""
        found = valuelog.live_pointers(snapshot.index(self.log.read()), now).withColumn("p", decode_pointer(F.unbase64("value")))
        return found.select("bucket", "key", "flag", "ttl", "ts", F.col("p.file_id").alias("segment"), F.col("p.offset").alias("offset"), F.col("p.size").alias("size"), F.col("p.crc").alias("crc"))

    def live(self, now: int = NOW) -> DataFrame:
        """(bucket, key, value) of visible keys; a pointer whose value is missing, or of another size, gives null."""
        inline = snapshot.live(snapshot.index(self.log.read()), now).where(F.col("ds") != POINTER).select("bucket", "key", "value")
        return inline.unionByName(valuelog.resolve(self._pointers(now), self.values(), ["segment", "offset"]).select("bucket", "key", "value"))

    def stats(self, now: int = NOW) -> DataFrame:
        """Per segment: total, live and stale bytes; the newest is active."""
        sizes = self.values().select("segment", F.octet_length("value").cast("long").alias("size"))
        return valuelog.segment_stats(sizes, self._pointers(now), [])

    def collect_garbage(self, least: float, now: int = NOW) -> Collected:
        """Copies the live values of the stalest segment to a new one, puts pointers to them in one transaction (times and
        flags stay), makes sure that no live pointer to the old segment is left, and removes it."""
        stats = self.stats(now)
        chosen = valuelog.gc_candidate(stats, [], least).join(stats, "segment").select("segment", "total_bytes", "live_bytes", "stale_bytes", "stale_ratio").first()
        if chosen is None:
            raise NoCandidate(f"no segment has a stale ratio of {least}")
        source = chosen["segment"]
        version = self.log._version()
        moving = valuelog.resolve(self._pointers(now).where(F.col("segment") == source), self.values().where(F.col("segment") == source), ["segment", "offset"])
        size = moving.agg(F.count("*").alias("n"), F.count("value").alias("there"), F.max("offset").alias("last")).first()
        if size["there"] < size["n"]:
            raise ValueError(f"{size['n'] - size['there']} values of segment {source} are missing")
        if size["n"]:
            target = self._write_segment(moving)
            entries = moving.select(F.col("offset").alias("seq"), "bucket", "key", "value", "ttl", "ts", "flag", F.lit(POINTER).alias("ds"))
            # published only if no other command has come in between: its entries could be newer than the copies
            self.log._append(entries.withColumn("value", self._pointer(target)), now, 1, self.log._current(version), version, size["last"])
        if not self._pointers(now).where(F.col("segment") == source).isEmpty():
            raise StillInUse(f"segment {source} still has live pointers")
        self._fs.delete(self._path(self._at(source)), True)
        return Collected(source, chosen["total_bytes"], chosen["live_bytes"], chosen["stale_bytes"], size["n"], chosen["total_bytes"])
