"""The native binary log: a Python data source that reads its files, and an encoder.

A file holds entries one after the other: a header of 42 bytes (little-endian: checksum u32, timestamp u64, key size
u32, value size u32, flag u16, ttl u32, bucket size u32, status u16, structure u16, transaction u64), then bucket, key
and value. The checksum is the IEEE CRC-32 of all that follows it. Files are preallocated with zeros, so a header
whose checksum, sizes and timestamp are all zero ends the log; a torn or damaged entry is an error.

Entries have no marks by which a reader could find its place in the middle, so a file is one task. Files are
read in buffered pieces; memory is bounded by the largest entry.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

HEADER = struct.Struct("<IQIIHIIHHQ")
BATCH_ROWS = 4096

SCHEMA = "file_id bigint, pos bigint, bucket binary, key binary, value binary, flag int, status int, ds int, ttl bigint, ts bigint, tx_id decimal(20,0)"


class CorruptLog(ValueError):
    """An entry that is cut short or whose checksum differs."""


def encode_entry(bucket: bytes, key: bytes, value: bytes, flag: int = 1, status: int = 1, ds: int = 0, ttl: int = 0, ts: int = 1, tx_id: int = 1) -> bytes:
    body = HEADER.pack(0, ts, len(key), len(value), flag, ttl, len(bucket), status, ds, tx_id)[4:] + bucket + key + value
    return struct.pack("<I", zlib.crc32(body)) + body


def decode_file(file, file_id: int, limit: int | None = None) -> Iterator[tuple]:
    """Rows of SCHEMA from a binary file, up to the zero header, the end, or `limit` bytes."""
    from decimal import Decimal

    at = 0
    while limit is None or at < limit:
        head = file.read(HEADER.size)
        if not head.strip(b"\0"):
            return
        if len(head) < HEADER.size:
            raise CorruptLog(f"file {file_id}: header cut short at {at}")
        crc, ts, keys, values, flag, ttl, buckets, status, ds, tx = HEADER.unpack(head)
        if not (crc or ts or keys or values):
            return
        body = file.read(buckets + keys + values)
        if len(body) < buckets + keys + values or zlib.crc32(body, zlib.crc32(head[4:])) != crc:
            raise CorruptLog(f"file {file_id}: damaged entry at {at}")
        yield file_id, at, body[:buckets], body[buckets : buckets + keys], body[buckets + keys :], flag, status, ds, ttl, ts, Decimal(tx)
        at += HEADER.size + len(body)


def file_ids(names: list[str]) -> list[tuple[int, str]]:
    """Data files in the order of their numbers, whatever their names' order."""
    found = []
    for name in names:
        stem, dot, kind = name.rsplit("/", 1)[-1].rpartition(".")
        if dot and kind == "data" and stem.isdigit():
            found.append((int(stem), name))
    return sorted(found)


@dataclass
class LogFile(InputPartition):
    file_id: int
    path: str


class NativeLogReader(DataSourceReader):
    def __init__(self, path: str, segment_size: int | None):
        self.path, self.segment_size = path, segment_size

    def partitions(self) -> list[LogFile]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        names = [f.path for f in system.get_file_info(fs.FileSelector(at)) if f.is_file]
        return [LogFile(k, name) for k, name in file_ids(names)]

    def read(self, partition: LogFile) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        names = ["file_id", "pos", "bucket", "key", "value", "flag", "status", "ds", "ttl", "ts", "tx_id"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.decimal128(20, 0)]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        with system.open_input_stream(partition.path, buffer_size=1 << 20) as file:
            for row in decode_file(file, partition.file_id, self.segment_size):
                rows.append(row)
                if len(rows) == BATCH_ROWS:
                    yield batch()
                    rows.clear()
        if rows:
            yield batch()


class NativeLog(DataSource):
    """format('siltlog'): path is a folder of <number>.data files; option segment_size stops reading there."""

    @classmethod
    def name(cls) -> str:
        return "siltlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> NativeLogReader:
        size = self.options.get("segment_size")
        return NativeLogReader(self.options["path"], int(size) if size else None)


def read_native(spark: SparkSession, path: str, segment_size: int | None = None) -> DataFrame:
    spark.dataSource.register(NativeLog)
    reader = spark.read.format("siltlog")
    return (reader.option("segment_size", segment_size) if segment_size else reader).load(path)
