"""Queries over the log: snapshots, reads, statistics, compaction; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.operators import compaction, durability, scan, snapshot, stats
from siltlog.plans.registry import query
from siltlog.plans.sqltext import over_log, over_segments
from siltlog.sources.log import load_log, read_table, with_bucket_deletes

ENTRY = ["bucket", "key", "value", "ts", "ttl", "file_id", "pos"]


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.index_plain(load_log(spark, sf_dir))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    return events.select(F.concat(F.lit("b"), (F.col("user_id") % 4).cast("string")).alias("bucket"), F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.segments(load_log(spark, sf_dir), reads(spark, sf_dir))


@query("live_snapshot", over_log("SELECT bucket, key, value, ts, CAST(ttl AS BIGINT) AS ttl, file_id, pos FROM live"))
def live_snapshot(spark, sf_dir):
    return snapshot.live(_index(spark, sf_dir)).select(ENTRY)


@query("index_latest", over_log("SELECT bucket, key, flag, CAST(ttl AS BIGINT) AS ttl, ts, tx_id, file_id, pos FROM idx"))
def index_latest(spark, sf_dir):
    return _index(spark, sf_dir).select("bucket", "key", "flag", "ttl", "ts", "tx_id", "file_id", "pos")


@query("committed_tx", over_log("SELECT tx_id FROM committed"))
def committed_tx(spark, sf_dir):
    return snapshot.committed(load_log(spark, sf_dir))


@query("uncommitted_entries", over_log("SELECT file_id, pos, tx_id, bucket, key FROM log ANTI JOIN committed USING (tx_id)"))
def uncommitted_entries(spark, sf_dir):
    log = load_log(spark, sf_dir)
    return log.join(snapshot.committed(log), "tx_id", "left_anti").select("file_id", "pos", "tx_id", "bucket", "key")


@query("tombstones_current", over_log("SELECT bucket, key, ts, file_id, pos FROM idx WHERE flag = 0"))
def tombstones_current(spark, sf_dir):
    return snapshot.tombstones(_index(spark, sf_dir)).select("bucket", "key", "ts", "file_id", "pos")


@query("expired_current", over_log("SELECT bucket, key, ts, CAST(ttl AS BIGINT) AS ttl FROM idx WHERE flag <> 0 AND ttl <> 0 AND ts + ttl <= 1706745600"))
def expired_current(spark, sf_dir):
    return snapshot.expired(_index(spark, sf_dir)).select("bucket", "key", "ts", "ttl")


@query(
    "bucket_delete_snapshot",
    over_log(
        """SELECT bucket, key, value, file_id, pos FROM (SELECT e.* FROM clog e LEFT JOIN (SELECT bucket, max(event_id) AS mark FROM clog WHERE event_id % 211 = 0 GROUP BY 1) m USING (bucket)
        WHERE e.event_id % 211 <> 0 AND (m.mark IS NULL OR e.event_id > m.mark) QUALIFY row_number() OVER (PARTITION BY bucket, key ORDER BY file_id DESC, pos DESC) = 1)
        WHERE flag <> 0 AND (ttl = 0 OR ts + ttl > 1706745600)"""
    ),
)
def bucket_delete_snapshot(spark, sf_dir):
    return snapshot.live(snapshot.index(with_bucket_deletes(load_log(spark, sf_dir)))).select("bucket", "key", "value", "file_id", "pos")


@query("live_key_count", over_log("SELECT bucket, c.n AS records, i.n AS index_keys, coalesce(l.n, 0) AS live_keys FROM (SELECT bucket, count(*) AS n FROM clog GROUP BY 1) c JOIN (SELECT bucket, count(*) AS n FROM idx GROUP BY 1) i USING (bucket) LEFT JOIN (SELECT bucket, count(*) AS n FROM live GROUP BY 1) l USING (bucket)"))
def live_key_count(spark, sf_dir):
    return snapshot.key_counts(load_log(spark, sf_dir))


@query("bucket_min_max", over_log("SELECT bucket, min(key) AS min_key, max(key) AS max_key FROM idx GROUP BY 1"))
def bucket_min_max(spark, sf_dir):
    return snapshot.key_range(_index(spark, sf_dir))


@query(
    "valid_key_counter",
    over_log(
        """SELECT bucket, CAST(sum(CASE WHEN was IS NULL THEN 1 WHEN was <> 0 AND flag = 0 THEN -1 WHEN was = 0 AND flag <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS valid_keys
        FROM (SELECT *, lag(flag) OVER (PARTITION BY bucket, key ORDER BY file_id, pos) AS was FROM clog) GROUP BY 1"""
    ),
)
def valid_key_counter(spark, sf_dir):
    return snapshot.valid_key_counter(load_log(spark, sf_dir))


@query(
    "oracle_replay_trace",
    over_log(
        """SELECT file_id, pos, bucket, key, c.tx_id IS NOT NULL AS applied, CASE WHEN c.tx_id IS NULL THEN 'transaction has no commit marker' WHEN flag = 0 THEN 'committed tombstone'
        WHEN ttl <> 0 AND ts + ttl <= 1706745600 THEN 'committed value expired' ELSE 'latest committed value' END AS reason FROM log LEFT JOIN committed c ON c.tx_id = log.tx_id"""
    ),
)
def oracle_replay_trace(spark, sf_dir):
    return snapshot.replay_trace(load_log(spark, sf_dir))


def _requests(spark: SparkSession) -> DataFrame:
    """A thousand point reads over four buckets that exist and one that doesn't."""
    return spark.range(1000).select(F.concat(F.lit("b"), (F.col("id") % 5).cast("string")).alias("bucket"), F.concat(F.lit("u"), F.lpad(F.expr("id div 5").cast("string"), 6, "0")).alias("key"))


_REQUESTS = "req AS (SELECT 'b' || CAST(id % 5 AS VARCHAR) AS bucket, 'u' || lpad(CAST(id // 5 AS VARCHAR), 6, '0') AS key FROM range(1000) t(id))"


@query("get_hit", over_log("SELECT bucket, key, value FROM req JOIN live USING (bucket, key)", _REQUESTS))
def get_hit(spark, sf_dir):
    return scan.get_many(load_log(spark, sf_dir), _requests(spark)).where("outcome = 'found'").select("bucket", "key", "value")


@query(
    "get_miss_reason",
    over_log(
        """SELECT req.bucket, req.key, CASE WHEN b.bucket IS NULL THEN 'bucket not found' WHEN i.key IS NULL THEN 'key not found' WHEN l.key IS NULL THEN 'not visible' ELSE 'found' END AS outcome, l.value
        FROM req LEFT JOIN (SELECT DISTINCT bucket FROM idx) b USING (bucket) LEFT JOIN idx i ON i.bucket = req.bucket AND i.key = req.key LEFT JOIN live l ON l.bucket = req.bucket AND l.key = req.key""",
        _REQUESTS,
    ),
)
def get_miss_reason(spark, sf_dir):
    return scan.get_many(load_log(spark, sf_dir), _requests(spark))


@query("range_inclusive", over_log("SELECT key, value FROM live WHERE bucket = 'b1' AND key BETWEEN 'u000020' AND 'u000101' ORDER BY key"))
def range_inclusive(spark, sf_dir):
    return scan.range_scan(_index(spark, sf_dir), "b1", "u000020", "u000101")


_RANGES = [(0, "b1", "u000020", "u000100"), (1, "b1", "u000100", "u000020"), (2, "b9", "u000000", "u999999"), (3, "b2", "u000002", "u000002"), (4, "b3", "x", "y")]


@query(
    "range_status",
    over_log(
        """SELECT request, count(i.key) AS raw, count(l.key) AS visible, CASE WHEN s > e THEN 'start key after end key' WHEN count(i.key) = 0 THEN 'no result' ELSE 'ok' END AS status
        FROM rng LEFT JOIN idx i ON i.bucket = rng.b AND i.key BETWEEN s AND e LEFT JOIN live l ON l.bucket = i.bucket AND l.key = i.key GROUP BY request, s, e""",
        "rng AS (SELECT CAST(r AS BIGINT) AS request, b, s, e FROM (VALUES " + ", ".join(str(r) for r in _RANGES) + ") v(r, b, s, e))",
    ),
)
def range_status(spark, sf_dir):
    return scan.range_status(_index(spark, sf_dir), spark.createDataFrame(_RANGES, "request long, bucket string, start string, end string"))


@query(
    "sparse_index",
    over_log(
        """SELECT file_id, arg_min(bucket, bucket || chr(1) || key) AS least_bucket, arg_min(key, bucket || chr(1) || key) AS least_key,
        arg_max(bucket, bucket || chr(1) || key) AS greatest_bucket, arg_max(key, bucket || chr(1) || key) AS greatest_key, count(*) AS entries FROM clog GROUP BY 1"""
    ),
)
def sparse_index(spark, sf_dir):
    got = scan.sparse_index(load_log(spark, sf_dir))
    return got.select("file_id", F.col("least.bucket").alias("least_bucket"), F.col("least.key").alias("least_key"), F.col("greatest.bucket").alias("greatest_bucket"), F.col("greatest.key").alias("greatest_key"), "entries")


@query(
    "sparse_get",
    over_log(
        """SELECT 'b1' AS bucket, 'u000021' AS key, (SELECT count(*) FROM span WHERE 'b1' || chr(1) || 'u000021' BETWEEN least AND greatest) AS files_in_range,
        i.file_id, CASE WHEN l.key IS NOT NULL THEN 'found' ELSE 'key not found' END AS outcome, l.value
        FROM (SELECT 1) LEFT JOIN idx i ON i.bucket = 'b1' AND i.key = 'u000021' LEFT JOIN live l ON l.bucket = 'b1' AND l.key = 'u000021'""",
        "span AS (SELECT file_id, min(bucket || chr(1) || key) AS least, max(bucket || chr(1) || key) AS greatest FROM clog GROUP BY 1)",
    ),
)
def sparse_get(spark, sf_dir):
    log = load_log(spark, sf_dir)
    return scan.sparse_get(log, scan.sparse_index(log), "b1", "u000021")


@query("prefix_raw_page", over_log("SELECT key, value FROM (SELECT *, row_number() OVER (ORDER BY key) AS n FROM idx WHERE bucket = 'b2' AND starts_with(key, 'u0000')) WHERE n > 2 AND n <= 12 AND flag <> 0 AND (ttl = 0 OR ts + ttl > 1706745600)"))
def prefix_raw_page(spark, sf_dir):
    return scan.prefix_page(_index(spark, sf_dir), "b2", "u0000", 2, 10)


@query("prefix_visible_page", over_log("SELECT key, value FROM live WHERE bucket = 'b2' AND starts_with(key, 'u0000') ORDER BY key LIMIT 10 OFFSET 2"))
def prefix_visible_page(spark, sf_dir):
    return scan.prefix_visible_page(_index(spark, sf_dir), "b2", "u0000", 2, 10)


@query(
    "prefix_regex_page",
    over_log(
        """SELECT key, value FROM (SELECT *, row_number() OVER (ORDER BY key) AS hit FROM (SELECT *, row_number() OVER (ORDER BY key) AS n FROM idx WHERE bucket = 'b1' AND starts_with(key, 'u000'))
        WHERE n > 3 AND regexp_matches(substr(key, 5), '[37]$')) WHERE hit <= 8 AND flag <> 0 AND (ttl = 0 OR ts + ttl > 1706745600)"""
    ),
)
def prefix_regex_page(spark, sf_dir):
    return scan.prefix_regex_page(_index(spark, sf_dir), "b1", "u000", "[37]$", 3, 8)


@query("prefix_skipped", over_log("SELECT least(count(*), 20) AS skipped FROM idx WHERE bucket = 'b2' AND starts_with(key, 'u0000')"))
def prefix_skipped(spark, sf_dir):
    return scan.prefix_skipped(_index(spark, sf_dir), "b2", "u0000", 20)


@query("full_scan_sorted", over_log("SELECT bucket, key, flag, CAST(ttl AS BIGINT) AS ttl, ts, file_id, pos FROM idx ORDER BY bucket, key"))
def full_scan_sorted(spark, sf_dir):
    return scan.full_scan(_index(spark, sf_dir))


@query("segment_stats", over_segments("SELECT file_id, size, live_bytes, read_count FROM seg"))
def segment_stats(spark, sf_dir):
    return _segments(spark, sf_dir)


@query("garbage_ratio", over_segments("SELECT file_id, size, live_bytes, garbage_ratio FROM ratios"))
def garbage_ratio(spark, sf_dir):
    return stats.segment_ratios(stats.segments(load_log(spark, sf_dir)))


@query(
    "compaction_observation",
    over_segments(
        """SELECT CAST(sum(size) AS BIGINT) AS logical_bytes, CAST(sum(live_bytes) AS BIGINT) AS live_bytes, CAST(sum(size) - sum(live_bytes) AS BIGINT) AS obsolete_bytes, count(*) * 131072 AS physical_bytes,
        CASE WHEN sum(live_bytes) > 0 THEN CAST(count(*) * 131072 AS DOUBLE) / CAST(sum(live_bytes) AS DOUBLE) ELSE 0.0 END AS space_amp, CAST(1.25 AS DOUBLE) AS write_amp FROM seg"""
    ),
)
def compaction_observation(spark, sf_dir):
    return stats.observation(stats.segments(load_log(spark, sf_dir)), 131072, 4_000_000, 1_000_000)


@query("superseded_entries", over_log("SELECT file_id, pos, bucket, key FROM clog QUALIFY row_number() OVER (PARTITION BY bucket, key ORDER BY file_id DESC, pos DESC) > 1"))
def superseded_entries(spark, sf_dir):
    return stats.superseded(load_log(spark, sf_dir))


@query("segment_hotness", over_segments("SELECT file_id, reads AS read_count FROM hot"))
def segment_hotness(spark, sf_dir):
    return stats.hotness(reads(spark, sf_dir), _index(spark, sf_dir))


@query("active_write_offset", over_segments("SELECT file_id, size AS write_offset FROM seg ORDER BY file_id DESC LIMIT 1"))
def active_write_offset(spark, sf_dir):
    return stats.active_offset(load_log(spark, sf_dir))


@query("entry_crc32")
def entry_crc32(spark, sf_dir):
    return stats.checksums(load_log(spark, sf_dir))


@query("pick_file_id", over_segments("SELECT file_id FROM seg ORDER BY file_id"))
def pick_file_id(spark, sf_dir):
    return compaction.by_file_id(stats.segments(load_log(spark, sf_dir)))


@query("pick_garbage_ratio", over_segments("SELECT file_id, garbage_ratio AS score FROM ratios WHERE garbage_ratio >= 0.5 ORDER BY score DESC, file_id LIMIT 1"))
def pick_garbage_ratio(spark, sf_dir):
    return compaction.by_garbage(stats.segments(load_log(spark, sf_dir)), 0.5)


@query("pick_hot_cold", over_segments("SELECT file_id, garbage_ratio * CASE WHEN read_count > 100 THEN 0.5 ELSE 1.0 END AS score FROM ratios WHERE garbage_ratio >= 0.5 ORDER BY score DESC, file_id LIMIT 1"))
def pick_hot_cold(spark, sf_dir):
    return compaction.by_heat(_segments(spark, sf_dir), 0.5, 100)


@query("pick_pure_no_candidate", over_segments("SELECT file_id, garbage_ratio AS score FROM ratios WHERE garbage_ratio >= 2.0"))
def pick_pure_no_candidate(spark, sf_dir):
    return compaction.by_garbage(stats.segments(load_log(spark, sf_dir)), 2.0)


@query("pick_or_all", over_segments("SELECT file_id FROM seg"))
def pick_or_all(spark, sf_dir):
    segs = stats.segments(load_log(spark, sf_dir))
    return compaction.or_all(compaction.by_garbage(segs, 2.0), segs)


@query(
    "budget_selection",
    over_segments(
        """SELECT g.inst, s.file_id, s.size, g.used FROM fit g JOIN nth s ON s.inst = g.inst AND s.rn = g.rn WHERE g.taken""",
        "nth AS (SELECT file_id % 4 AS inst, file_id, size, row_number() OVER (PARTITION BY file_id % 4 ORDER BY file_id) AS rn FROM seg)",
        """fit AS (SELECT inst, rn, size > 0 AND size <= 200000 AS taken, CASE WHEN size > 0 AND size <= 200000 THEN size ELSE 0 END AS used FROM nth WHERE rn = 1
        UNION ALL SELECT n.inst, n.rn, n.size > 0 AND f.used + n.size <= 200000, CASE WHEN n.size > 0 AND f.used + n.size <= 200000 THEN f.used + n.size ELSE f.used END FROM fit f JOIN nth n ON n.inst = f.inst AND n.rn = f.rn + 1)""",
    ).replace("WITH log", "WITH RECURSIVE log", 1),
)
def budget_selection(spark, sf_dir):
    segs = stats.segments(load_log(spark, sf_dir)).withColumn("inst", F.col("file_id") % 4)
    return compaction.within_budget(segs, 200_000, ["inst"])


_SURVIVORS = """surv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY file_id DESC, pos DESC) AS rnk, count(*) FILTER (file_id % 3 <> 0) OVER (PARTITION BY bucket, key) > 0 AS outside FROM clog)
  WHERE rnk = 1 AND file_id % 3 = 0 AND (outside OR NOT (flag = 0 OR (ttl <> 0 AND ts + ttl <= 1706745600))))"""


def _sources(log: DataFrame) -> DataFrame:
    """Every third file is merged."""
    return log.where("file_id % 3 = 0").select("file_id").distinct()


@query("merge_survivors", over_log("SELECT bucket, key, flag, file_id, pos FROM surv", _SURVIVORS))
def merge_survivors(spark, sf_dir):
    log = load_log(spark, sf_dir)
    return compaction.survivors(log, _sources(log)).select("bucket", "key", "flag", "file_id", "pos")


@query(
    "merge_byte_counters",
    over_segments(
        "SELECT CAST((SELECT coalesce(sum(size), 0) FROM sized WHERE file_id % 3 = 0) AS BIGINT) AS bytes_read, CAST(coalesce(sum(42 + strlen(bucket) + strlen(key) + CASE WHEN flag = 0 THEN 0 ELSE strlen(value) END), 0) AS BIGINT) AS bytes_written FROM surv",
        _SURVIVORS,
    ),
)
def merge_byte_counters(spark, sf_dir):
    log = load_log(spark, sf_dir)
    return compaction.merge_bytes(log, _sources(log))


@query("merge_snapshot_invariance", over_log("SELECT bucket, key, value, ts, CAST(ttl AS BIGINT) AS ttl FROM live"))
def merge_snapshot_invariance(spark, sf_dir):
    """The live snapshot after a merge of all files up to the middle one, which must be the one before."""
    log = load_log(spark, sf_dir)
    middle = log.agg(F.expr("max(file_id) div 2")).first()[0]
    # the merged file takes the place of the newest source, so that later files still win
    merged = compaction.merged_log(log, log.where(F.col("file_id") <= middle).select("file_id").distinct(), middle)
    return snapshot.live(snapshot.index_plain(merged)).select("bucket", "key", "value", "ts", "ttl")


_DELETED = """marked AS (SELECT e.* FROM clog e LEFT JOIN (SELECT bucket, max(event_id) AS mark FROM clog WHERE event_id % 211 = 0 GROUP BY 1) m USING (bucket) WHERE e.event_id % 211 <> 0 AND (m.mark IS NULL OR e.event_id > m.mark)),
didx AS (SELECT * FROM marked QUALIFY row_number() OVER (PARTITION BY bucket, key ORDER BY file_id DESC, pos DESC) = 1),
dlive AS (SELECT * FROM didx WHERE flag <> 0 AND (ttl = 0 OR ts + ttl > 1706745600))"""
_DELETED_SEGMENTS = """dsized AS (SELECT file_id, sum(42 + strlen(bucket) + strlen(key) + CASE WHEN flag = 0 AND event_id % 211 <> 0 THEN 0 ELSE strlen(value) END) AS size FROM log GROUP BY 1),
dseg AS (SELECT file_id, CAST(size AS BIGINT) AS size, CAST(coalesce(live, 0) AS BIGINT) AS live_bytes FROM dsized LEFT JOIN (SELECT file_id, sum(42 + strlen(bucket) + strlen(key) + strlen(value)) AS live FROM dlive GROUP BY 1) USING (file_id))"""


@query("merge_twice_invariance", over_log("SELECT bucket, key, value, ts, CAST(ttl AS BIGINT) AS ttl FROM dlive", _DELETED))
def merge_twice_invariance(spark, sf_dir):
    """The live snapshot of a log with bucket deletes after its older files have been merged, and what came of them has been
    merged again with the files that follow: the one before."""
    log = with_bucket_deletes(load_log(spark, sf_dir))
    most = log.agg(F.max("file_id")).first()[0]
    for upto in (most // 3, 2 * most // 3):
        log = compaction.merged_log(log, log.where(F.col("file_id") <= upto).select("file_id").distinct(), upto)
    return snapshot.live(snapshot.index(log)).select("bucket", "key", "value", "ts", "ttl")


@query("segment_stats_bucket_deletes", over_log("SELECT file_id, size, live_bytes FROM dseg", _DELETED, _DELETED_SEGMENTS))
def segment_stats_bucket_deletes(spark, sf_dir):
    return stats.segments(with_bucket_deletes(load_log(spark, sf_dir))).select("file_id", "size", "live_bytes")


@query("pick_garbage_bucket_deletes", over_log("SELECT file_id, CAST(size - live_bytes AS DOUBLE) / CAST(size AS DOUBLE) AS score FROM dseg WHERE size > 0 ORDER BY score DESC, file_id LIMIT 1", _DELETED, _DELETED_SEGMENTS))
def pick_garbage_bucket_deletes(spark, sf_dir):
    return compaction.by_garbage(stats.segments(with_bucket_deletes(load_log(spark, sf_dir))), 0.0)


@query(
    "valid_key_counter_bucket_deletes",
    over_log(
        """SELECT bucket, CAST(sum(CASE WHEN was IS NULL THEN 1 WHEN was <> 0 AND flag = 0 THEN -1 WHEN was = 0 AND flag <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS valid_keys
        FROM (SELECT *, lag(flag) OVER (PARTITION BY bucket, key ORDER BY file_id, pos) AS was FROM marked) GROUP BY 1""",
        _DELETED,
    ),
)
def valid_key_counter_bucket_deletes(spark, sf_dir):
    return snapshot.valid_key_counter(with_bucket_deletes(load_log(spark, sf_dir)))


#: Bytes of the budgeted merge: the oldest files that fit.
MERGE_BUDGET = 250_000


@query(
    "budgeted_merge_bytes",
    over_segments(
        """SELECT target, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes_read, CAST(coalesce(any_value(w.written), 0) AS BIGINT) AS bytes_written
        FROM src LEFT JOIN (SELECT target, sum(42 + strlen(bucket) + strlen(key) + CASE WHEN flag = 0 THEN 0 ELSE strlen(value) END) AS written FROM kept GROUP BY 1) w USING (target) GROUP BY target""",
        "nth AS (SELECT file_id, size, row_number() OVER (ORDER BY file_id) AS rn FROM seg)",
        f"""fit AS (SELECT rn, file_id, size, size > 0 AND size <= {MERGE_BUDGET} AS taken, CASE WHEN size > 0 AND size <= {MERGE_BUDGET} THEN size ELSE 0 END AS used FROM nth WHERE rn = 1
        UNION ALL SELECT n.rn, n.file_id, n.size, n.size > 0 AND f.used + n.size <= {MERGE_BUDGET}, CASE WHEN n.size > 0 AND f.used + n.size <= {MERGE_BUDGET} THEN f.used + n.size ELSE f.used END FROM fit f JOIN nth n ON n.rn = f.rn + 1)""",
        "runs AS (SELECT *, rn - row_number() OVER (ORDER BY rn) AS run FROM fit WHERE taken)",
        "src AS (SELECT file_id, size, max(file_id) OVER (PARTITION BY run) AS target FROM runs QUALIFY count(*) OVER (PARTITION BY run) > 1)",
        """kept AS (SELECT * FROM (SELECT c.*, s.target, row_number() OVER (PARTITION BY c.bucket, c.key ORDER BY c.file_id DESC, c.pos DESC) AS rnk, count(*) FILTER (s.file_id IS NULL) OVER (PARTITION BY c.bucket, c.key) > 0 AS outside
        FROM clog c LEFT JOIN src s ON s.file_id = c.file_id) WHERE rnk = 1 AND target IS NOT NULL AND (outside OR NOT (flag = 0 OR (ttl <> 0 AND ts + ttl <= 1706745600))))""",
    ).replace("WITH log", "WITH RECURSIVE log", 1),
)
def budgeted_merge_bytes(spark, sf_dir):
    """What a merge within a budget reads and writes, by target: its sources and their survivors, not the table."""
    log = load_log(spark, sf_dir)
    segs = stats.segments(log)
    taken = compaction.within_budget(segs, MERGE_BUDGET).select("file_id").collect()
    targets = compaction.run_targets([r.file_id for r in segs.select("file_id").collect()], {r.file_id for r in taken})
    sources = spark.createDataFrame(targets, "file_id long, target long")
    read = segs.join(sources, "file_id").groupBy("target").agg(F.count("*").alias("files"), F.sum("size").alias("bytes_read"))
    written = stats.sized(compaction.merged_files(log, sources)).groupBy(F.col("file_id").alias("target")).agg(F.sum("size").alias("bytes_written"))
    return read.join(written, "target", "left").select("target", "files", "bytes_read", F.coalesce("bytes_written", F.lit(0)).alias("bytes_written"))


@query(
    "analyze_workload",
    """WITH puts AS (SELECT event_id AS seq, user_id AS key, CAST(floor(value * 100) AS BIGINT) AS bytes FROM events WHERE event_type NOT IN ('click', 'view')),
    s AS (SELECT count(*) AS writes, CAST(sum(bytes) AS BIGINT) AS logical_bytes FROM puts), l AS (SELECT CAST(sum(b) AS BIGINT) AS live_bytes FROM (SELECT arg_max(bytes, seq) AS b FROM puts GROUP BY key)),
    t AS (SELECT count(*) AS operations, count(*) FILTER (event_type IN ('click', 'view')) AS reads FROM events)
    SELECT operations, writes, reads, logical_bytes, live_bytes, logical_bytes - live_bytes AS obsolete_bytes, CAST(logical_bytes + 500000 AS DOUBLE) / CAST(logical_bytes AS DOUBLE) AS write_amp,
    CAST(20000000 AS DOUBLE) / CAST(live_bytes AS DOUBLE) AS space_amp FROM s, l, t""",
)
def analyze_workload(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("click", "view"), "get").otherwise("put")
    ops = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), kind.alias("kind"), F.col("user_id").alias("key"), F.floor(F.col("value") * 100).alias("bytes"))
    return compaction.analyze_workload(ops, 500_000, 20_000_000)


@query("point_read", over_log("SELECT file_id, pos, bucket, key, value, flag, status FROM log WHERE file_id = 0 AND pos = 7"))
def point_read(spark, sf_dir):
    """One entry by its place; the range of event_ids reaches the scan."""
    return load_log(spark, sf_dir).where("file_id = 0 AND pos = 7").select("file_id", "pos", "bucket", "key", "value", "flag", "status")


@query(
    "compaction_recommendation",
    over_segments(
        """SELECT true AS available, CAST(CASE rule WHEN 0 THEN 33554432 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 8388608 ELSE 16777216 * CASE WHEN heap >= 0.5 THEN 2 ELSE 1 END END AS BIGINT) AS budget,
        CASE WHEN rule = 0 THEN 'garbage-ratio' ELSE 'hot-cold' END AS picker,
        ['emergency space amplification', 'foreground p99 exceeds target', 'garbage below minimum work threshold', 'high write amplification limits rewrite budget', 'garbage pressure within latency budget'][rule + 1] AS reason,
        CAST(greatest(0.0, least(1.0, CASE rule WHEN 0 THEN space_amp / 2.0 / 2 WHEN 1 THEN CAST(p99 AS DOUBLE) / 100000000.0 / 2 WHEN 2 THEN 1 - heap WHEN 3 THEN 1.25 / 3.0 / 2 ELSE heap + 0.25 END)) AS DOUBLE) AS confidence, 'read-heavy' AS phase, p99
        FROM (SELECT *, CASE WHEN space_amp >= 2.0 THEN 0 WHEN p99 > 100000000 THEN 1 WHEN garbage < 1000 THEN 2 ELSE 4 END AS rule FROM
          (SELECT CAST(sum(size) - sum(live_bytes) AS DOUBLE) / CAST(sum(size) AS DOUBLE) AS heap, sum(size) - sum(live_bytes) AS garbage, CASE WHEN sum(live_bytes) > 0 THEN CAST(count(*) * 4096 AS DOUBLE) / CAST(sum(live_bytes) AS DOUBLE) ELSE 0.0 END AS space_amp FROM seg),
          (SELECT CAST(max(bound) FILTER (rn = (total * 99 + 99) // 100) AS BIGINT) AS p99 FROM (SELECT *, row_number() OVER (ORDER BY latency) AS rn, count(*) OVER () AS total FROM
            (SELECT CAST(floor(value * 100000) AS BIGINT) AS latency, coalesce(list_min(list_filter([10000, 25000, 50000, 100000, 250000, 500000, 1000000, 2000000, 5000000, 10000000, 25000000, 50000000, 100000000, 250000000, 500000000, 1000000000], lambda x: x >= CAST(floor(value * 100000) AS BIGINT))), 1000000000) AS bound FROM events))))"""
    ),
)
def compaction_recommendation(spark, sf_dir):
    observed = stats.observation(stats.segments(load_log(spark, sf_dir)), 4096, 4_000_000, 1_000_000)
    commits = read_table(spark, sf_dir, "events").select(F.lit(0).alias("db"), F.floor(F.col("value") * 100_000).alias("latency"))
    config = compaction.ControllerConfig(min_garbage=1000)
    return compaction.recommend(observed, durability.latency_percentiles(commits, ["db"]), spark.range(1).select(F.lit("read-heavy").alias("phase")), 100_000_000, config)
