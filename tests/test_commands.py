"""Range counts, sparse reads and the table with a value log."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siltlog.functions.expr import decode_pointer
from siltlog.operators import scan, snapshot
from siltlog.plans.maintenance import EmptyKey, LostRace
from siltlog.plans.valuetable import Collected, NoCandidate, ValueTable
from tests.test_snapshot import NOW, delete, log_of, put, random_log

BATCH = "seq long, bucket string, key string, value string, ttl long"


@pytest.mark.parametrize("seed", range(3))
def test_range_counts(spark, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randrange(4)))
    rows = [delete(word(), 1, bucket=rnd.choice("xy")) if rnd.random() < 0.2 else put(word(), "v", 1, bucket=rnd.choice("xy")) for _ in range(60)]
    index = snapshot.index(log_of(spark, rows))
    keys = [(r.bucket, r.key, r.flag != 0) for r in index.collect()]
    ranges = [(k, rnd.choice("xyz"), word(), word()) for k in range(40)] + [(90, None, "a", "b"), (91, "x", None, "b"), (92, "x", "a", "a"), (93, "x", "", "zz"), (93, "x", "", "zz")]
    want = []
    for n, bucket, start, end in ranges:
        hit = [v for b, k, v in keys if None not in (bucket, start, end) and b == bucket and start <= k <= end]
        bad = None not in (start, end) and start > end
        want.append((n, len(hit), sum(hit), "start key after end key" if bad else "ok" if hit else "no result"))
    got = scan.range_status(index, spark.createDataFrame(ranges, "request long, bucket string, start string, end string"), NOW)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert scan.range_status(index, spark.createDataFrame([], "request long, bucket string, start string, end string"), NOW).collect() == []


def test_range_counts_move_no_keys(spark):
    index = log_of(spark, [put("a", "v", 1)])  # a single entry is its own index, whose plan has no join
    got = scan.range_status(index, spark.createDataFrame([(1, "b", "a", "c")], "request long, bucket string, start string, end string"), NOW)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (bucket" not in plan and "Join LeftOuter, (bucket" not in plan
    assert [tuple(r) for r in got.collect()] == [(1, 1, 1, "ok")]


def test_sparse_get(spark):
    log = spark.createDataFrame(random_log(random.Random(4)), log_of(spark, [put("a", "v", 1)]).schema)
    live = {(r.bucket, r.key): r.value for r in snapshot.live(snapshot.index(log), NOW).collect()}
    files = scan.sparse_index(log)
    spans = [(tuple(r.least), tuple(r.greatest)) for r in files.collect()]
    for bucket, key in [("a", "w"), ("a", "z"), ("b", "x"), ("b", "none"), ("c", "w")]:
        got = scan.sparse_get(log, files, bucket, key, NOW).first()
        assert (got.outcome, got.value) == (("found", live[bucket, key]) if (bucket, key) in live else ("key not found", None))
        assert got.files_in_range == sum(a <= (bucket, key) <= b for a, b in spans)


@pytest.fixture
def table(spark, tmp_path):
    table = ValueTable(spark, f"file://{tmp_path}/table", 10)
    table.put_batch(spark.createDataFrame([(0, "b", "k1", "short", 0), (1, "b", "k2", "a value for the log", 0), (2, "b", "k3", "another such value é", 0), (3, "b", "k4", None, 0), (4, "b", "k5", "soon gone, but long", 5)], BATCH), NOW)
    table.put_batch(spark.createDataFrame([(0, "b", "k3", "a newer value of it", 0)], BATCH), NOW + 1)
    return table


def state(table, now=NOW + 2):
    return {r.key: r.value for r in table.live(now).collect()}


LIVE = {"k1": "short", "k2": "a value for the log", "k3": "a newer value of it", "k4": None, "k5": "soon gone, but long"}


def test_values_are_separated(spark, table):
    assert state(table) == LIVE
    assert state(table, NOW + 10) == {k: v for k, v in LIVE.items() if k != "k5"}
    assert {r.value for r in table.values().collect()} == {v for v in LIVE.values() if v and len(v) >= 10} | {"another such value é"}
    assert {r.segment: (r.total_bytes, r.live_bytes, r.active) for r in table.stats(NOW + 10).collect()} == {0: (19 + 21 + 19, 19, False), 1: (19, 19, True)}


def test_garbage_is_collected(spark, table):
    before = {r.key: (r.ts, r.ttl, r.flag) for r in snapshot.index(table.log.read()).collect()}
    with pytest.raises(NoCandidate):
        table.collect_garbage(0.9, NOW + 10)
    assert table.collect_garbage(0.3, NOW + 2) == Collected(0, 59, 38, 21, 2, 59)
    assert state(table) == LIVE
    assert {r.key: (r.ts, r.ttl, r.flag) for r in snapshot.index(table.log.read()).collect()} == before
    assert {r.segment for r in table.values().select("segment").distinct().collect()} == {1, 2}
    with pytest.raises(NoCandidate):
        table.collect_garbage(0.3, NOW + 2)
    assert state(table, NOW + 10) == {k: v for k, v in LIVE.items() if k != "k5"}


def test_collection_of_a_segment_without_live_values(spark, table):
    table.put_batch(spark.createDataFrame([(0, "b", "k2", "x", 0)], BATCH), NOW + 3)
    assert table.collect_garbage(1.0, NOW + 10) == Collected(0, 59, 0, 59, 0, 59)
    assert state(table, NOW + 10) == {"k1": "short", "k2": "x", "k3": "a newer value of it", "k4": None}


def test_values_come_before_their_pointers(spark, table, monkeypatch):
    """Whatever ends a command early, the log has no pointer to a value that isn't there."""
    seen = []

    def publish(sets, after):
        seen.append(table.values().count())
        raise LostRace("lost")

    monkeypatch.setattr(table.log, "_publish", publish)
    with pytest.raises(LostRace):
        table.put_batch(spark.createDataFrame([(0, "b", "k9", "a value that nobody sees", 0)], BATCH), NOW)
    with pytest.raises(LostRace):
        table.collect_garbage(0.3, NOW + 2)
    monkeypatch.undo()
    assert seen == [5, 7]  # the values were there before
    assert state(table) == LIVE
    found = table._pointers(NOW + 2).join(table.values(), ["segment", "offset"], "left_anti")
    assert found.isEmpty()
    table.put_batch(spark.createDataFrame([(0, "b", "k9", "a value that comes after", 0)], BATCH), NOW)
    assert state(table) == LIVE | {"k9": "a value that comes after"}


def test_a_bad_batch_leaves_the_table(spark, table):
    with pytest.raises(EmptyKey):
        table.put_batch(spark.createDataFrame([(0, "b", "", "a value without a key", 0)], BATCH), NOW)
    assert state(table) == LIVE
    bad = table.log.read().where("ds = 2").select(decode_pointer(F.unbase64("value")).alias("p")).where("p IS NULL")
    assert bad.isEmpty()
