"""Decision tables, folds and models on the published examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltlog.functions.expr import decode_pointer, encode_pointer
from siltlog.operators import app, compaction, durability, models, policy, valuelog
from siltlog.plans.maintenance import collect_garbage

MB = 1024 * 1024


def segments(spark, rows):
    return spark.createDataFrame([(*r, 0) if len(r) == 3 else r for r in rows], "file_id long, size long, live_bytes long, read_count long")


def picked(df):
    return [(r.file_id, round(r.score, 6)) for r in df.collect()]


def test_pickers(spark):
    assert picked(compaction.by_garbage(segments(spark, [(1, 100, 80), (2, 100, 20), (3, 100, 60)]), 0.5)) == [(2, 0.8)]
    assert picked(compaction.by_garbage(segments(spark, [(1, 100, 90)]), 0.5)) == []
    assert picked(compaction.by_heat(segments(spark, [(1, 100, 20, 1000), (2, 100, 20, 1)]), 0.5, 10))[0][0] == 2
    assert picked(compaction.by_heat(segments(spark, [(1, 100, 10, 1000), (2, 100, 40, 1)]), 0.5, 10))[0][0] == 2
    assert [r.file_id for r in compaction.by_file_id(segments(spark, [(2, 1, 0), (0, 1, 0), (1, 1, 0)])).collect()] == [0, 1, 2]


def test_budget(spark):
    segs = segments(spark, [(1, 40, 0), (2, 70, 0), (3, 30, 0)])
    assert [r.file_id for r in compaction.within_budget(segs, 75).orderBy("file_id").collect()] == [1, 3]
    assert compaction.within_budget(segs, 20).collect() == []


OBS = "seq long, p99 long, target long, garbage long, data long, write_amp double, space_amp double, phase string, inst long"


def observations(spark, rows):
    return spark.createDataFrame([(k, p99 * 1_000_000, target * 1_000_000, garbage * MB, data * MB, wa, sa, phase, 0) for k, (p99, target, garbage, data, wa, sa, phase) in enumerate(rows)], OBS)


def test_controller_rules(spark):
    rows = [(20, 10, 128, 256, 1.0, 1.0, "mixed"), (20, 10, 128, 256, 1.0, 2.5, "mixed"), (5, 10, 192, 256, 1.0, 1.0, "overwrite-heavy"), (5, 10, 128, 256, 1.0, 1.0, "read-heavy"), (5, 10, 128, 256, 3.0, 1.0, "mixed")]
    got = compaction.evaluate(observations(spark, rows)).orderBy("seq").collect()
    assert [(r.budget, r.picker) for r in got][0] == (0, "file-id")
    assert got[0].reason == "foreground p99 exceeds target"
    assert (got[1].budget > 0, got[1].picker, got[1].reason) == (True, "garbage-ratio", "emergency space amplification")
    assert (got[2].budget > 0, got[2].picker, got[2].reason) == (True, "garbage-ratio", "garbage pressure within latency budget")
    assert (got[3].budget > 0, got[3].picker) == (True, "hot-cold")
    assert got[4].budget == 8 * MB


def test_controller_hysteresis(spark):
    work, throttle = (5, 10, 128, 512, 1.0, 1.0, "mixed"), (20, 10, 128, 512, 1.0, 1.0, "mixed")
    got = compaction.observe(compaction.evaluate(observations(spark, [work, work] + [throttle, work] * 4)), ["inst"], "seq").orderBy("seq").collect()
    assert [r.changed for r in got] == [False, True] + [False] * 8
    eager = compaction.ControllerConfig(stable_windows=1, cooldown_windows=0)
    big = (5, 10, 192, 256, 1.0, 1.0, "mixed")  # wants 32 MiB, moves by one base budget
    assert compaction.observe(compaction.evaluate(observations(spark, [big]), eager), ["inst"], "seq", eager).first().budget == 16 * MB


WINDOW = "win long, reads long, writes long, overwrites long, large_writes long, sync_latency long, inst long"


def windows(spark, rows):
    return spark.createDataFrame([(k, *r, 0) for k, r in enumerate(rows)], WINDOW)


W, R = (20, 80, 0, 0, 0), (80, 20, 0, 0, 0)


def test_phases(spark):
    rows = [W, R, (20, 80, 50, 0, 0), (20, 80, 0, 50, 0), (20, 80, 0, 0, 10_000_000), (50, 50, 0, 0, 0), (0, 99, 0, 0, 0)]
    want = ["write-heavy", "read-heavy", "overwrite-heavy", "large-value-heavy", "sync-latency-sensitive", "mixed", "unknown"]
    assert [r.phase for r in policy.analyze(windows(spark, rows)).orderBy("win").collect()] == want


def observed(spark, rows, **how):
    config = policy.DetectorConfig(**how)
    return [(r.phase, r.changed) for r in policy.observe(policy.analyze(windows(spark, rows)), ["inst"], "win", config).orderBy("win").collect()]


def test_phase_hysteresis(spark):
    assert observed(spark, [W, W]) == [("unknown", False), ("write-heavy", True)]
    assert all(not changed for _, changed in observed(spark, [R, W] * 8))
    assert [changed for _, changed in observed(spark, [W, W, R, R, R], cooldown=3)] == [False, True, False, False, True]


def test_lifecycle(spark):
    rows = [(32, 10, 0, 0, 0), (4096, 10, 0, 0, 0), (4096, 0, 5, 0, 0), (4096, 2, 2, 0, 0), (131072, 2, 2, 10, 0), (32, 0, 0, 0, 0), (4096, 0, 0, 0, 0)]
    obs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "seq long, size long, reads long, updates long, age long, overwrite_window long")
    assert [r.placement for r in valuelog.classify(obs).orderBy("seq").collect()] == ["inline", "inline", "inline", "value-log", "cold-tier", "inline", "value-log"]
    stable, hot = (4096, 2, 2, 0, 0), (4096, 10, 0, 0, 0)
    obs = spark.createDataFrame([(0, k, *r) for k, r in enumerate([stable, hot, stable, hot, hot])], "inst long, seq long, size long, reads long, updates long, age long, overwrite_window long")
    got = valuelog.settle(valuelog.classify(obs), ["inst"], "seq").orderBy("seq").collect()
    assert [r.placement for r in got] == ["value-log"] * 4 + ["inline"]


def test_core_placement(spark):
    ops = lambda kinds: spark.createDataFrame([("k", n, kind, 40) for n, kind in enumerate(kinds)], "key string, seq long, kind string, size long")
    place = lambda kinds, **how: [r.placement for r in valuelog.core_decisions(ops(kinds), ["key"], "seq", valuelog.Lifecycle(threshold=16, **how)).orderBy("seq").collect()]
    assert place(["put", "put"], min_observations=2, frequent_updates=2) == ["value-log", "inline"]
    assert place(["put", "get", "get", "put"], min_observations=3, hot_reads=2)[-1] == "inline"
    one = valuelog.placement_metrics(valuelog.core_decisions(ops(["put"]), ["key"], "seq", valuelog.Lifecycle(threshold=16))).first()
    assert (one.inline_decisions, one.value_log_decisions, one.threshold_fallbacks) == (0, 1, 1)


def test_value_log(spark):
    puts = spark.createDataFrame([(0, 0, "key", 40), (0, 1, "key", 40), (0, 2, "live", 40)], "inst long, seq long, key string, size long")
    placed = valuelog.rotate(puts, ["inst"], "seq", 64, value_log=True)
    last = puts.groupBy("key").agg(F.max("seq").alias("seq")).select("seq")
    pointers = placed.join(last, "seq", "left_semi")
    stats = valuelog.segment_stats(placed, pointers, ["inst"])
    assert [(r.segment, r.live_bytes, r.stale_bytes, r.active) for r in stats.orderBy("segment").collect()] == [(0, 0, 40, False), (1, 40, 0, False), (2, 40, 0, True)]
    assert [r.segment for r in valuelog.gc_candidate(stats, ["inst"], 0.5).collect()] == [0]
    alone = valuelog.segment_stats(placed.where("segment = 2"), pointers, ["inst"])
    assert valuelog.gc_candidate(alone, ["inst"], 0.0).collect() == []
    values = placed.select("inst", "segment", "offset", F.concat(F.lit("v"), F.col("seq").cast("string")).alias("value"), "size")
    after, moved = collect_garbage(values.select("inst", "segment", "offset", "value"), pointers.select("inst", "segment", "offset", "size", "seq"), ["inst"], 1)
    got = moved.join(after, ["inst", "segment", "offset"]).select("seq", "value", "segment").collect()
    assert {(r.seq, r.value) for r in got} == {(1, "v1"), (2, "v2")}
    assert {r.segment for r in after.collect()} == {0, 2, 3}


def test_rotation_limits(spark):
    rows = spark.createDataFrame([(0, k, n) for k, n in enumerate([60, 50, 200, 40])], "inst long, seq long, size long")
    data = valuelog.rotate(rows, ["inst"], "seq", 100).orderBy("seq").collect()
    assert [(r.segment, r.offset) for r in data] == [(0, 0), (1, 0), (None, None), (1, 50)]
    log = valuelog.rotate(rows, ["inst"], "seq", 100, value_log=True).orderBy("seq").collect()
    assert [(r.segment, r.offset) for r in log] == [(0, 0), (1, 0), (2, 0), (3, 0)]
    assert {r.segment for r in valuelog.rotate(rows, ["inst"], "seq", 0, value_log=True).collect()} == {0}


def test_pointer_codec(spark):
    row = spark.createDataFrame([(7, 1 << 40, 4096, 0xFFFFFFFF)], "f long, o long, s long, c long")
    data = row.select(encode_pointer(F.col("f"), F.col("o"), F.col("s"), F.col("c")).alias("d"))
    assert bytes(data.first().d) == b"GOLV\x01\x00" + (7).to_bytes(8, "little") + (1 << 40).to_bytes(8, "little") + (4096).to_bytes(4, "little") + b"\xff" * 4
    back = data.select(decode_pointer(F.col("d")).alias("p"), decode_pointer(F.concat(F.lit(b"x"), F.expr("substring(d, 2, 29)"))).alias("bad")).first()
    assert tuple(back.p) == (7, 1 << 40, 4096, 0xFFFFFFFF)
    assert back.bad is None


def test_group_sizes(spark):
    rows, seq = [], 0
    for epoch, n in enumerate([1, 2, 3, 4, 5, 8, 9, 16]):
        for _ in range(n):
            rows.append((0, seq, epoch * 10_000_000))
            seq += 1
    epochs = durability.group_epochs(spark.createDataFrame(rows, "inst long, seq long, at long"), ["inst"], "seq")
    m = durability.epoch_metrics(epochs, ["inst"], "seq").first()
    assert (m.size_1, m.size_2, m.size_3_4, m.size_5_8, m.size_9_plus, m.epochs, m.waiters, m.max_size) == (1, 1, 2, 2, 2, 8, 48, 16)


def test_adaptive_model(spark):
    obs = spark.createDataFrame([(0, 1024, 0, 0), (1, 0, 50, 0), (2, 128, 20, 10), (3, 0, 0, 0)], "seq long, dirty_bytes long, since long, latency long")
    got = durability.model_decision(obs, durability.SyncPolicy(1024, 0, 5, 50, 5)).orderBy("seq").collect()
    assert [(r.should_sync, r.delay) for r in got] == [(True, 0), (True, 0), (False, 5), (False, 5)]
    slow = durability.model_decision(obs.where("seq = 2"), durability.SyncPolicy(1024, 0, 2000, 1000, 5)).first()
    assert (slow.should_sync, slow.delay) == (False, 1000)


def test_latencies(spark):
    rows = [(0, n) for n in (5_000, 20_000, 75_000, 2_000_000, 20_000_000)]
    r = durability.latency_percentiles(spark.createDataFrame(rows, "inst long, latency long"), ["inst"]).first()
    assert (r["count"], r.p50, r.p95, r.p99, r.max) == (5, 100_000, 25_000_000, 25_000_000, 20_000_000)


def test_workloads(spark):
    kinds = lambda df: [(r.kind, r.key) for r in df.orderBy("seq").collect()]
    assert len(kinds(models.sequential(spark, 2))) == 4
    hot = kinds(models.hotspot(spark, 3, 4, [1, 2]))
    assert len(hot) == 10 and [k for _, k in hot[-4:]] == ["key-000001", "key-000002"] * 2
    assert len(kinds(models.overwrite_hotset(spark, 4, 5, 2, 16))) == 9
    tail = [k for k, _ in kinds(models.mixed(spark, 5, 10, 30, 4))[5:]]
    assert (tail.count("put"), tail.count("get")) == (3, 7)
    r = compaction.analyze_workload(models.overwrite_hotset(spark, 10, 20, 10, 100), 500, 2000).first()
    assert (r.operations, r.logical_bytes, r.live_bytes, r.obsolete_bytes, r.write_amp, r.space_amp) == (30, 3000, 1000, 2000, 3500 / 3000, 2.0)
    r = compaction.analyze_workload(models.mixed(spark, 10, 100, 30, 64), 0, 0).first()
    assert (r.writes, r.reads, r.live_bytes) == (40, 70, 640)


def test_faults(spark):
    calls = spark.createDataFrame(list(enumerate("WWW")), "idx long, point string")
    assert [r.fails for r in models.fault_schedule(calls, {"W": 1}).orderBy("idx").collect()] == [False, True, True]
    calls = spark.createDataFrame(list(enumerate("WSSR")), "idx long, point string")
    assert [r.fails for r in models.fault_schedule(calls, {"W": 0, "S": 1}).orderBy("idx").collect()] == [True, False, True, False]
    torn = models.torn_writes(spark, 4, 2, 3, 5)
    assert torn.count() == 14
    assert [r.o for r in torn.groupBy("region").agg(F.min("offset").alias("o")).orderBy("o").collect()] == [0, 4, 6, 9]
    faults = models.manifest_faults(spark).collect()
    ids = [r.id for r in faults]
    assert len(set(ids)) == 28 and ids == sorted(ids)
    assert all(r.action != "remove-source" for r in faults if r.phase == "prepared")


def test_replicated_log(spark):
    rows = [(0, 0, 0, 1, 1), (0, 0, 1, 2, 1), (0, 0, 2, 3, 1), (0, 1, 3, 2, 2), (1, 0, 4, 2, 1), (1, 0, 5, 1, 1)]
    df = spark.createDataFrame(rows, "inst long, batch long, seq long, index long, term long")
    got = {(r.inst, r.seq): (r.effect, r.last_index) for r in models.replicated_append(df, ["inst"], ["seq"]).collect()}
    assert got[(0, 3)] == ("replaced", 2)
    assert got[(1, 4)] == ("conflict", 0) and got[(1, 5)] == ("not reached", 0)


def test_overlay(spark):
    sst = spark.createDataFrame([("key", "sst", 9), ("only", "s", 1)], "key string, value string, seq long")
    wal = spark.createDataFrame([("key", "wal", 1)], "key string, value string, seq long")
    assert {r.key: r.value for r in models.overlay(sst, wal).collect()} == {"key": "wal", "only": "s"}


def test_place_orders(spark):
    stock = spark.createDataFrame([("sku", 10)], "sku string, stock long")
    orders = spark.createDataFrame([("sku", 1, 3), ("sku", 2, 2), ("sku", 3, 6), ("other", 4, 1)], "sku string, seq long, count long")
    got = app.place_orders(stock, orders).orderBy("seq").collect()
    assert [(r.accepted, r.stock_after) for r in got] == [(True, 7), (True, 5), (False, 5), (False, 0)]
