"""Scalar functions over columns. All stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltlog.sources.log import DELETE, HEADER_BYTES


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_visible(now: int, flag: Column | str = "flag", ttl: Column | str = "ttl", ts: Column | str = "ts") -> Column:
    """Neither deleted nor expired at `now`; a value expires in the second ts + ttl."""
    return (column(flag) != DELETE) & ~is_expired(now, ttl, ts)


def is_expired(now: int, ttl: Column | str = "ttl", ts: Column | str = "ts") -> Column:
    return (column(ttl) != 0) & (column(ts) + column(ttl) <= now)


def byte_length(x: Column | str) -> Column:
    return F.coalesce(F.octet_length(column(x)), F.lit(0)).cast("long")


def entry_size(bucket: Column | str = "bucket", key: Column | str = "key", value: Column | str = "value", flag: Column | str = "flag") -> Column:
    """Bytes of an entry in a native file; a delete has no value."""
    return F.lit(HEADER_BYTES) + byte_length(bucket) + byte_length(key) + F.when(column(flag) == DELETE, 0).otherwise(byte_length(value))


def ratio(part: Column | str, total: Column | str) -> Column:
    """part / total, 0 where total isn't positive."""
    part, total = column(part), column(total)
    return F.when(total > 0, part.cast("double") / total.cast("double")).otherwise(F.lit(0.0))


def garbage_ratio(size: Column | str = "size", live: Column | str = "live_bytes") -> Column:
    return ratio(column(size) - column(live), size)


def positive_ratio(part: Column | str, total: Column | str) -> Column:
    """part / total, 0 where either isn't positive."""
    return F.when((column(part) > 0) & (column(total) > 0), column(part).cast("double") / column(total).cast("double")).otherwise(F.lit(0.0))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def clamp_budget(x: Column, most: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(most), x)).cast("long")


def has_prefix(key: Column | str, prefix: str) -> Column:
    return F.startswith(column(key), F.lit(prefix))


def trim_prefix(key: Column | str, prefix: str) -> Column:
    return F.when(has_prefix(key, prefix), F.substring(column(key), F.lit(len(prefix) + 1), F.length(column(key)))).otherwise(column(key))


def over_limit(limit: int, count: Column) -> Column:
    """A fault point fires from the call after the limit on; a negative limit never."""
    return (F.lit(limit) >= 0) & (count > limit)


def numbered_key(x: Column) -> Column:
    return F.concat(F.lit("key-"), F.lpad(x.cast("string"), 6, "0"))


#: The fixed encoding of a value-log pointer: 30 bytes, little-endian.
POINTER_MAGIC, POINTER_VERSION, POINTER_BYTES = 0x564C4F47, 1, 30


def _little(x: Column, size: int) -> Column:
    """The `size` low bytes of a number, lowest first."""
    big = F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(big, 15 - 2 * k, 2) for k in range(size)]))


def encode_pointer(file_id: Column, offset: Column, size: Column, crc: Column) -> Column:
    """magic u32, version u16, file u64, offset u64, size u32, crc u32."""
    return F.concat(_little(F.lit(POINTER_MAGIC), 4), _little(F.lit(POINTER_VERSION), 2), _little(file_id, 8), _little(offset, 8), _little(size, 4), _little(crc, 4))


def _number(data: Column, at: int, size: int) -> Column:
    return F.conv(F.concat(*[F.hex(F.substring(data, at + size - k, 1)) for k in range(size)]), 16, 10).cast("long")


def decode_pointer(data: Column) -> Column:
    """A struct (file_id, offset, size, crc); null for anything but a pointer of this version."""
    ok = (F.octet_length(data) == POINTER_BYTES) & (_number(data, 0, 4) == POINTER_MAGIC) & (_number(data, 4, 2) == POINTER_VERSION)
    return F.when(ok, F.struct(_number(data, 6, 8).alias("file_id"), _number(data, 14, 8).alias("offset"), _number(data, 22, 4).alias("size"), _number(data, 26, 4).alias("crc")))
