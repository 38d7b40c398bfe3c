"""The native reader and the streams."""

from __future__ import annotations

import pytest

from siltlog.operators import snapshot
from siltlog.sources.log import LOG_SCHEMA, load_log
from siltlog.sources.native import encode_entry, file_ids, read_native
from siltlog.streaming import state


def write(folder, name, data, size=0):
    (folder / name).write_bytes(data.ljust(size, b"\0"))


def test_native_files(spark, tmp_path):
    write(tmp_path, "2.data", encode_entry(b"b", b"k", b"old", tx_id=1) + encode_entry(b"b", b"x", b"", flag=0, tx_id=(1 << 64) - 1), 500)
    write(tmp_path, "10.data", encode_entry(b"b", b"k", b"new", tx_id=2, ttl=7, ts=9))
    write(tmp_path, "notes.txt", b"no data file")
    rows = read_native(spark, str(tmp_path)).orderBy("file_id", "pos").collect()
    assert [(r.file_id, r.pos, bytes(r.key), bytes(r.value), r.flag) for r in rows] == [(2, 0, b"k", b"old", 1), (2, 47, b"x", b"", 0), (10, 0, b"k", b"new", 1)]
    assert (rows[2].ttl, rows[2].ts, int(rows[1].tx_id)) == (7, 9, (1 << 64) - 1)


def test_file_order():
    assert [k for k, _ in file_ids(["a/10.data", "a/2.data", "a/x.data", "a/3.txt"])] == [2, 10]


@pytest.mark.parametrize("cut", [10, 41, 43, 46])
def test_torn_entry_is_an_error(spark, tmp_path, cut):
    write(tmp_path, "0.data", encode_entry(b"b", b"key", b"value")[:cut])
    with pytest.raises(Exception, match="cut short|damaged"):
        read_native(spark, str(tmp_path)).collect()


def test_damaged_byte_is_an_error(spark, tmp_path):
    data = bytearray(encode_entry(b"b", b"key", b"value"))
    data[42] = 0xFF
    write(tmp_path, "0.data", bytes(data))
    with pytest.raises(Exception, match="damaged"):
        read_native(spark, str(tmp_path)).collect()


def test_stream_of_files_in_any_order(spark, tmp_path):
    """Markers may come before or after the entries of their transaction, and old entries after new ones."""
    log = load_log(spark, "/root/testdata/sf0.001")
    got = state.run_index(spark, log, f"file://{tmp_path}", files=5)
    columns = [f.name for f in LOG_SCHEMA]
    want = snapshot.index_plain(log).select(columns)
    assert sorted(got.select(columns).collect()) == sorted(want.collect())


def test_epoch_stream(spark, tmp_path):
    rows = [(1, k, 0) for k in range(10)] + [(2, k, k * 100) for k in range(5)]
    got = state.run_epochs(spark, spark.createDataFrame(rows, "instance long, seq long, at long"), f"file://{tmp_path}", 4, 200)
    assert {(r.instance, r.epoch, r.waiters, r.frontier) for r in got.collect()} == {(1, 1, 4, 3), (1, 2, 4, 7), (2, 1, 2, 1), (2, 2, 2, 3)}


def test_epoch_timer(spark, tmp_path):
    """An epoch that nobody fills closes when its delay has passed."""
    import time

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out = f"file://{tmp_path}/source", f"file://{tmp_path}/out"
    schema = "instance bigint, seq bigint, at bigint"
    spark.createDataFrame([(1, k, 0) for k in range(3)], schema).coalesce(1).write.parquet(source)
    stream = state.epochs(spark.readStream.schema(schema).parquet(source), 16, 500)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/checkpoint").outputMode("append").trigger(processingTime="1 second").start()
    try:
        got, until = [], time.time() + 60
        while not got and time.time() < until and query.isActive:
            time.sleep(1)
            if (tmp_path / "out" / "_spark_metadata").exists():
                got = spark.read.schema("instance bigint, epoch bigint, waiters bigint, frontier bigint").parquet(out).collect()
    finally:
        query.stop()
    assert [tuple(r) for r in got] == [(1, 1, 3, 2)]
