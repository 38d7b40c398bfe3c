"""Semantics of snapshots, scans and merges on small logs."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from siltlog.operators import compaction, models, scan, snapshot, stats
from siltlog.plans.maintenance import EmptyBucket, EmptyKey, LogTable, LostRace
from siltlog.sources.log import LOG_SCHEMA

NOW = 1000


def log_of(spark, rows):
    """Rows (bucket, key, value, flag, status, ttl, ts, tx), in order; one file of ten entries after another."""
    full = [(k // 10, k % 10, b, key, v, flag, status, 0, ttl, ts, tx) for k, (b, key, v, flag, status, ttl, ts, tx) in enumerate(rows)]
    return spark.createDataFrame(full, LOG_SCHEMA)


def put(key, value, tx, status=1, ttl=0, ts=NOW, bucket="b"):
    return (bucket, key, value, 1, status, ttl, ts, tx)


def delete(key, tx, status=1, bucket="b"):
    return (bucket, key, None, 0, status, 0, NOW, tx)


def visible(spark, rows, now=NOW):
    return {(r.bucket, r.key): r.value for r in snapshot.live(snapshot.index(log_of(spark, rows)), now).collect()}


def test_put_delete_put(spark):
    rows = [put("k", "val1", 1), delete("k", 2), put("k", "val001", 3)]
    assert visible(spark, rows[:1]) == {("b", "k"): "val1"}
    assert visible(spark, rows[:2]) == {}
    assert visible(spark, rows) == {("b", "k"): "val001"}


def test_ttl(spark):
    rows = [put("expired", "x", 1, ttl=1, ts=NOW - 10), put("persistent", "p", 2, ts=NOW - 10), put("live", "l", 3, ttl=60)]
    assert set(visible(spark, rows)) == {("b", "persistent"), ("b", "live")}
    assert set(visible(spark, rows, NOW + 60)) == {("b", "persistent")}  # expires in the very second


def test_commit_marker(spark):
    assert visible(spark, [put("k", "v", 1, status=0)]) == {}
    assert set(visible(spark, [put("k1", "a", 1, status=0), put("k2", "b", 1)])) == {("b", "k1"), ("b", "k2")}
    assert visible(spark, [put("k", "old", 1), put("k", "new", 2, status=0)]) == {("b", "k"): "old"}


def test_composite_keys_differ(spark):
    assert len(visible(spark, [put("c", "1", 1, bucket="ab"), put("bc", "2", 2, bucket="a")])) == 2


def test_numeric_file_order(spark):
    rows = [put("k", str(n), n) for n in range(120)]  # twelve files: file 10 comes after file 2
    assert visible(spark, rows) == {("b", "k"): "119"}


def test_bucket_delete(spark):
    rows = [put("a", "1", 1), ("b", "", None, 16, 1, 0, NOW, 2), put("c", "3", 3)]
    log = log_of(spark, rows).withColumn("ds", F.when(F.col("flag") == 16, 1).otherwise(0))
    assert {r.key for r in snapshot.live(snapshot.index(log), NOW).collect()} == {"c"}


def test_scans(spark):
    rows = [put(k, k, n) for n, k in enumerate(["a1", "a2", "a3", "b1"])] + [delete("a2", 10), put("a4", "x", 11, ttl=1, ts=NOW - 10)]
    index = snapshot.index(log_of(spark, rows))
    keys = lambda df: [r.key for r in df.collect()]
    assert keys(scan.range_scan(index, "b", "a1", "a4", NOW)) == ["a1", "a3"]
    assert keys(scan.prefix_page(index, "b", "a", now=NOW)) == ["a1", "a3"]
    assert keys(scan.prefix_page(index, "b", "a", 1, 2, now=NOW)) == ["a3"]  # a2 is hidden, but counts
    assert keys(scan.prefix_visible_page(index, "b", "a", 1, 2, now=NOW)) == ["a3"]
    assert keys(scan.prefix_regex_page(index, "b", "a", "^[13]", 0, 1, now=NOW)) == ["a1"]
    with pytest.raises(ValueError):
        scan.range_scan(index, "b", "z", "a")


def test_empty_log(spark):
    log = spark.createDataFrame([], LOG_SCHEMA)
    assert snapshot.live(snapshot.index(log)).collect() == []
    assert stats.segments(log).collect() == []
    assert snapshot.key_counts(log).collect() == []


@pytest.mark.parametrize("sources", [s for n in (1, 2, 3) for s in itertools.combinations(range(3), n)])
def test_any_merge_keeps_the_snapshot(spark, sources):
    """Tombstones, expired and uncommitted entries over older ones in files that aren't merged: none comes back."""
    rows = [put("dead", "1", 1), put("old", "1", 2), put("twice", "1", 3), put("undone", "1", 4)] + [put(f"fill{k}", "x", 5) for k in range(6)]
    rows += [delete("dead", 20), put("old", "2", 21, ttl=1, ts=NOW - 10), put("twice", "2", 22), put("undone", "2", 23, status=0)] + [put(f"fill{k}", "y", 24) for k in range(6)]
    rows += [put("late", "1", 40), delete("late", 41), put("twice", "3", 42), delete("never", 43)]
    log = log_of(spark, rows)
    before = {(r.key, r.value) for r in snapshot.live(snapshot.index(log), NOW).collect()}
    kept = compaction.survivors(log, spark.createDataFrame([(s,) for s in sources], "file_id long"), NOW)
    rest = log.where(~F.col("file_id").isin(list(sources)))
    # survivors stay at their old places here: what counts is that dropping the others changes nothing
    after = rest.unionByName(kept.withColumns({"status": F.lit(1), "tx_id": F.lit(999).cast("long")}))
    assert {(r.key, r.value) for r in snapshot.live(snapshot.index(after), NOW).collect()} == before


@pytest.mark.parametrize("first,last", [(a, b) for a in range(4) for b in range(a + 1, 4)])
def test_merged_runs(spark, first, last):
    """Transactions across files, bucket deletes, deletes: the snapshot stays, and a second merge changes nothing."""
    rows = [put(f"k{n}", "0", 1, status=0) for n in range(9)] + [put("span", "first", 7, status=0)]
    rows += [put("k0", "marker of both", 7), put("k1", "1", 1), delete("k2", 8), ("b2", "x", "lost", 1, 1, 0, NOW, 9), put("k3", "2", 10, status=0)] + [put(f"f{n}", "1", 11) for n in range(5)]
    rows += [("b2", "", None, 16, 1, 0, NOW, 12), ("b2", "y", "kept", 1, 1, 0, NOW, 13), put("k4", "3", 14, ttl=1, ts=NOW - 10), put("k3", "marked late", 10)] + [put(f"f{n}", "2", 15) for n in range(6)]
    rows += [put("k2", "again", 16), delete("f0", 17), put("open", "x", 18, status=0)]
    log = log_of(spark, rows).withColumn("ds", F.when(F.col("flag") == 16, 1).otherwise(0))
    state = lambda df: {(r.bucket, r.key, r.value) for r in snapshot.live(snapshot.index(df), NOW).collect()}
    before = state(log)
    assert ("b2", "y", "kept") in before and ("b", "span", "first") in before and len(before) > 10
    files = spark.createDataFrame([(f,) for f in range(first, last + 1)], "file_id long")
    merged = spark.createDataFrame(compaction.merged_log(log, files, last, NOW).collect(), LOG_SCHEMA)
    assert state(merged) == before
    again = compaction.merged_log(merged, merged.select("file_id").distinct(), 3, NOW)
    assert state(again) == before


def test_log_table(spark, tmp_path):
    table = LogTable(spark, f"file://{tmp_path}/log")
    batch = lambda rows: spark.createDataFrame(rows, "seq long, bucket string, key string, value string, ttl long")
    table.put_batch(batch([(0, "b", "k1", "v1", 0), (1, "b", "k2", "v2", 0)]), NOW)
    with pytest.raises(EmptyKey):
        table.put_batch(batch([(0, "b", "k3", "v", 0), (1, "b", "", "v", 0)]), NOW)
    with pytest.raises(EmptyBucket):
        table.put_batch(batch([(0, "", "k3", "v", 0)]), NOW)
    table.put_batch(batch([]), NOW)
    table.put_batch(batch([(0, "b", "k1", "new", 0)]), NOW)
    table.put_batch(batch([(0, "b", "k2", "gone", 5)]), NOW - 100)
    state = lambda: {(r.key, r.value) for r in snapshot.live(snapshot.index(table.read()), NOW).collect()}
    assert state() == {("k1", "new")}
    assert table.merge_within(60, NOW) == []
    none = spark.createDataFrame([(True, 0)], "available boolean, budget long")
    assert table.merge_recommended(none, NOW) == []
    assert table.merge_within(10_000, NOW) == [[0, 1, 2]]
    assert state() == {("k1", "new")}
    assert table.read().count() == 1
    table.vacuum()
    assert state() == {("k1", "new")}
    with pytest.raises(ValueError):
        table.merge(table.read().select("file_id").distinct(), NOW)
    with pytest.raises(LostRace):
        table._publish([], table._version() - 1)  # a command that began before the last snapshot
    assert state() == {("k1", "new")}
    table.put("", "k", "in no bucket", NOW)
    with pytest.raises(EmptyKey):
        table.put("b", "", "x", NOW)
    assert state() == {("k1", "new"), ("k", "in no bucket")}


def random_log(rnd, files=6):
    """Rows of LOG_SCHEMA: puts, deletes, expired ones, bucket deletes, transactions across files, some without marker."""
    rows = []
    for n in range(files * 6):
        bucket, key, tx = rnd.choice("ab"), rnd.choice("wxyz"), rnd.randrange(files * 3)
        kind = rnd.random()
        flag, ds, ttl = (16, 1, 0) if kind < 0.08 else (0, 0, 0) if kind < 0.25 else (1, 0, 5 if kind < 0.35 else 0)
        rows.append((n // 6, n % 6, bucket, "" if flag == 16 else key, f"v{n}", flag, int(rnd.random() < 0.6), ds, ttl, NOW - 10, tx))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_sequences_of_merges_keep_the_snapshot(spark, seed):
    rnd = random.Random(seed)
    log = spark.createDataFrame(random_log(rnd), LOG_SCHEMA)
    state = lambda df: {(r.bucket, r.key, r.value) for r in snapshot.live(snapshot.index(df), NOW).collect()}
    before = state(log)
    for _ in range(4):
        files = sorted(r.file_id for r in log.select("file_id").distinct().collect())
        if len(files) < 2:
            break
        a = rnd.randrange(len(files) - 1)
        run = files[a : rnd.randrange(a + 2, len(files) + 1)]
        merged = compaction.merged_log(log, spark.createDataFrame([(f,) for f in run], "file_id long"), run[-1], NOW)
        log = spark.createDataFrame(merged.collect(), LOG_SCHEMA)
        assert state(log) == before


def test_merge_after_a_bucket_delete_and_a_merge(spark):
    """What was written after a bucket delete stays after it, however often its file has been merged."""
    rows = [(0, 0, "a", "k", "x", 1, 1, 0, 0, NOW, 1), (5, 0, "a", "k", "y", 1, 1, 0, 0, NOW, 2), (5, 1, "b", "k", "old", 1, 1, 0, 0, NOW, 3)]
    rows += [(5, 2, "b", "", None, 16, 1, 1, 0, NOW, 4), (6, 0, "b", "k", "new", 1, 1, 0, 0, NOW, 5)]
    log = spark.createDataFrame(rows, LOG_SCHEMA)
    for files in ([0, 5], [5, 6]):
        log = spark.createDataFrame(compaction.merged_log(log, spark.createDataFrame([(f,) for f in files], "file_id long"), files[-1], NOW).collect(), LOG_SCHEMA)
        assert {(r.bucket, r.value) for r in snapshot.live(snapshot.index(log), NOW).collect()} == {("a", "y"), ("b", "new")}
    assert {r.file_id: r.live_bytes for r in stats.segments(log, now=NOW).collect()} == {6: 2 * 44 + 1 + 3}


def test_budgeted_merges_write_their_survivors_only(spark, tmp_path):
    rnd = random.Random(9)
    rows = [*random_log(rnd, 8), (1, 6, "c", "only", "kept", 1, 1, 0, 0, NOW, 999)]
    table = LogTable(spark, f"file://{tmp_path}/log")
    table.load(spark.createDataFrame(rows, LOG_SCHEMA))
    state = lambda: {(r.bucket, r.key, r.value) for r in snapshot.live(snapshot.index(table.read()), NOW).collect()}
    before, whole = state(), table._current(table._version())[0]["name"]
    size = {r.file_id: r.size for r in stats.segments(table.read(), now=NOW).collect()}
    assert table.merge_within(size[0] + size[1] + size[2], NOW) == [[0, 1, 2]]
    assert state() == before
    names = [x["name"] for x in table._current(table._version()) if x["kind"] == "data"]
    assert names[0] == whole and len(names) == 2  # the loaded data set is still read, without the files replaced
    assert {r.file_id for r in spark.read.parquet(f"{tmp_path}/log/{names[1]}").collect()} == {2}
    assert {r.file_id for r in table.read().collect()} == {2, 3, 4, 5, 6, 7}
    table.merge(spark.createDataFrame([(f,) for f in (2, 3, 4)], "file_id long"), NOW)
    assert state() == before
    table.put_batch(spark.createDataFrame([(0, "a", "w", "last", 0)], "seq long, bucket string, key string, value string, ttl long"), NOW)
    after = state()
    assert ("a", "w", "last") in after
    assert table.merge_within(1 << 30, NOW) == [[4, 5, 6, 7, 8]]
    assert state() == after and whole not in [x.get("name") for x in table._current(table._version())]
    table.vacuum()
    assert state() == after


def test_two_publishers(spark, tmp_path):
    """Of two commands that read the same snapshot one gets an error, and nothing that was published is lost."""
    one, two = LogTable(spark, f"file://{tmp_path}/log"), LogTable(spark, f"file://{tmp_path}/log")
    one.put("b", "k", "1", NOW)
    version = two._version()
    one.put("b", "k", "2", NOW)
    with pytest.raises(LostRace):
        two._publish([], version)
    assert {r.value for r in snapshot.live(snapshot.index(one.read()), NOW).collect()} == {"2"}


def test_bucket_deletes_in_counters(spark):
    rows = [put("a", "1", 1), ("b", "", None, 16, 1, 0, NOW, 2), put("c", "3", 3), delete("c", 4), put("d", "4", 5)]
    log = log_of(spark, rows).withColumn("ds", F.when(F.col("flag") == 16, 1).otherwise(0))
    assert [(r.records, r.index_keys, r.live_keys) for r in snapshot.key_counts(log, NOW).collect()] == [(3, 2, 1)]
    assert [r.valid_keys for r in snapshot.valid_key_counter(log).collect()] == [1]
    assert [r.key for r in stats.superseded(log).collect()] == ["c"]


def test_live_bytes_of_segments(spark):
    rows = [put("dead", "x", 1), delete("dead", 2), put("old", "x", 3, ttl=1, ts=NOW - 10), put("live", "value", 4)]
    segs = stats.segments(log_of(spark, rows), now=NOW).collect()
    assert [r.live_bytes for r in segs] == [42 + 1 + 4 + 5]


def test_recovery_scenarios(spark):
    ops = spark.createDataFrame(models.SCENARIOS, models.SCENARIO_SCHEMA).where("idx IS NOT NULL")
    got = {(r.scenario, r.key): r.value if r.found else None for r in models.scenario_results(ops, 100).collect()}
    assert got == {
        ("after-commit-marker", "first"): "v1", ("after-commit-marker", "second"): "v2", ("uncommitted-newer-overwrite", "key"): "old",
        ("committed-tombstone", "key"): None, ("expired-value", "expired"): None,
    }


def test_get_many(spark):
    rows = [put("a", "1", 1), put("b", "2", 2), delete("b", 3), put("a", "3", 4), put("c", "x", 5, status=0), put("z", "gone", 6, bucket="d"), ("d", "", None, 16, 1, 0, NOW, 7)]
    log = log_of(spark, rows).withColumn("ds", F.when(F.col("flag") == 16, 1).otherwise(0))
    asked = spark.createDataFrame([("b", "a"), ("b", "b"), ("b", "c"), ("d", "z"), ("none", "a"), ("b", "a")], "bucket string, key string")
    got = sorted((r.bucket, r.key, r.outcome, r.value) for r in scan.get_many(log, asked, NOW).collect())
    assert got == [("b", "a", "found", "3")] * 2 + [("b", "b", "not visible", None), ("b", "c", "key not found", None), ("d", "z", "bucket not found", None), ("none", "a", "bucket not found", None)]


def test_index_stream_goes_on_after_a_restart(spark, tmp_path):
    from siltlog.streaming.state import IndexStream

    batches = [log_of(spark, rows) for rows in ([put("a", "1", 1)], [put("b", "2", 2)], [put("a", "3", 3)], [put("c", "4", 4)])]
    batches = [b.withColumn("file_id", F.lit(n).cast("long")) for n, b in enumerate(batches)]
    for n, batch in enumerate(batches):
        keeper = IndexStream(spark, f"file://{tmp_path}/state")  # a new one for each batch
        assert keeper.batch == n - 1
        keeper.apply(batch, n)
    again = IndexStream(spark, f"file://{tmp_path}/state")
    assert {(r.key, r.value) for r in again.index().collect()} == {("a", "3"), ("b", "2"), ("c", "4")}
    assert sorted(again._batches("index")) == [2, 3]


def test_small_batches_leave_a_large_run(spark, tmp_path):
    from siltlog.streaming.state import IndexStream

    keeper = IndexStream(spark, f"file://{tmp_path}/state")
    keeper.apply(log_of(spark, [put(f"k{n:02d}", "old", 1) for n in range(40)]), 0)
    large = keeper._manifest(0)["index"][0]
    for n in range(1, 6):
        keeper.apply(log_of(spark, [put("k07", f"v{n}", n + 1)]).withColumn("file_id", F.lit(n * 100).cast("long")), n)
        runs = keeper._manifest(n)["index"]
        assert runs[0] == large and len(runs) == 2
    assert {(r.key, r.value) for r in keeper.index().collect()} == {(f"k{n:02d}", "v5" if n == 7 else "old") for n in range(40)}


@pytest.mark.parametrize("seed", [1, 2])
def test_index_stream_over_random_batches(spark, tmp_path, seed):
    """Bucket deletes, late markers and late entries; each batch twice, as after a failure."""
    from siltlog.streaming.state import IndexStream

    rnd = random.Random(seed)
    rows = random_log(rnd, 5)
    rnd.shuffle(rows)
    keeper = IndexStream(spark, f"file://{tmp_path}/state")
    for n in range(6):
        part = spark.createDataFrame(rows[n * 5 : n * 5 + 5], LOG_SCHEMA)
        keeper.apply(part, n)
        keeper.apply(part, n)
    want = snapshot.index(spark.createDataFrame(rows, LOG_SCHEMA))
    columns = [f.name for f in LOG_SCHEMA]
    assert sorted(map(str, keeper.index().select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
