"""Queries over the value log, the policies and the durability decisions; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.functions.expr import byte_length, decode_pointer, encode_pointer
from siltlog.operators import compaction, durability, policy, valuelog
from siltlog.plans import log_queries  # noqa: F401  (its SQL is part of the metrics)
from siltlog.plans.registry import ORACLES, query
from siltlog.plans.sqltext import DOCS, OPS, OVERWRITES, SIZED, VLOG, over_log, over_ops, over_values, over_windows
from siltlog.sources.log import load_log, read_table

THRESHOLD, SEGMENT_BYTES, LEAST_STALE = 1024, 65536, 0.3
LOG = ["source"]


# The value log over documents: three documents share a key, texts from the threshold on are separated, a log per source.


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", F.expr("doc_id div 3").alias("key"), byte_length("text").alias("size"))


def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = _sizes(spark, sf_dir).where(F.col("size") >= THRESHOLD)
    return valuelog.rotate(big, LOG, "doc_id", SEGMENT_BYTES, value_log=True)


def _pointers(spark: SparkSession, sf_dir: str, appended: DataFrame) -> DataFrame:
    """Those of the last document of each key, if it was separated."""
    last = _sizes(spark, sf_dir).groupBy("key").agg(F.max("doc_id").alias("doc_id")).select("doc_id")
    return appended.join(last, "doc_id", "left_semi")


def _stats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    appended = _appended(spark, sf_dir)
    pointers = _pointers(spark, sf_dir, appended)
    return valuelog.segment_stats(appended, pointers, LOG), pointers


@query("kv_separation_split", "SELECT CASE WHEN strlen(coalesce(text, '')) >= 1024 THEN 'value-log' ELSE 'inline' END AS placement, count(*) AS n, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def kv_separation_split(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    placement = F.when(valuelog.separates(THRESHOLD, "text"), "value-log").otherwise("inline")
    return docs.groupBy(placement.alias("placement")).agg(F.count("*").alias("n"), F.sum(byte_length("text")).alias("bytes"))


@query("value_log_rotation", over_values('SELECT source, doc_id, CAST(size AS BIGINT) AS size, CAST(segment AS BIGINT) AS segment, CAST("offset" AS BIGINT) AS "offset" FROM placed'))
def value_log_rotation(spark, sf_dir):
    return _appended(spark, sf_dir)


@query("value_log_stats", over_values("SELECT source, CAST(segment AS BIGINT) AS segment, total_bytes, live_bytes, stale_bytes, active FROM vstats"))
def value_log_stats(spark, sf_dir):
    return _stats(spark, sf_dir)[0]


@query("gc_candidate", over_values("SELECT source, CAST(segment AS BIGINT) AS segment, stale_ratio FROM candidates"))
def gc_candidate(spark, sf_dir):
    return valuelog.gc_candidate(_stats(spark, sf_dir)[0], LOG, LEAST_STALE)


@query("gc_live_pointers", over_values('SELECT source, doc_id, CAST(p.segment AS BIGINT) AS segment, CAST(p."offset" AS BIGINT) AS "offset", CAST(size AS BIGINT) AS size FROM pointers p SEMI JOIN candidates USING (source, segment)'))
def gc_live_pointers(spark, sf_dir):
    stats, pointers = _stats(spark, sf_dir)
    found = valuelog.gc_candidate(stats, LOG, LEAST_STALE).select(*LOG, "segment")
    return pointers.join(found, [*LOG, "segment"], "left_semi").select("source", "doc_id", "segment", "offset", "size")


@query(
    "gc_plan",
    over_values(
        """SELECT c.source, CAST(c.segment AS BIGINT) AS segment, coalesce(p.n, 0) AS copied_values, CAST(coalesce(p.b, 0) AS BIGINT) AS copied_bytes, s.total_bytes AS reclaimed_bytes, CAST(s.total_bytes - coalesce(p.b, 0) AS BIGINT) AS net_bytes
        FROM candidates c JOIN vstats s USING (source, segment) LEFT JOIN (SELECT source, segment, count(*) AS n, sum(size) AS b FROM pointers GROUP BY ALL) p USING (source, segment)"""
    ),
)
def gc_plan(spark, sf_dir):
    stats, pointers = _stats(spark, sf_dir)
    return valuelog.gc_plan(valuelog.gc_candidate(stats, LOG, LEAST_STALE), stats, pointers, LOG)


@query("value_pointer_resolve", over_values('SELECT p.source, p.doc_id, CAST(p.segment AS BIGINT) AS segment, CAST(p."offset" AS BIGINT) AS "offset", CAST(p.size AS BIGINT) AS size, md5(d.value) AS value_md5 FROM pointers p JOIN docs d ON d.doc_id = p.doc_id'))
def value_pointer_resolve(spark, sf_dir):
    appended = _appended(spark, sf_dir)
    texts = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("value"))
    stored = appended.join(texts, "doc_id").select("source", "segment", "offset", "value")
    found = valuelog.resolve(_pointers(spark, sf_dir, appended), stored, ["source", "segment", "offset"])
    return found.select("source", "doc_id", "segment", "offset", "size", F.md5("value").alias("value_md5"))


@query("value_pointer_codec", "SELECT event_id AS file_id, event_id * 1000 + user_id AS \"offset\", user_id AS size, event_id * 7 % 4294967296 AS crc, CAST(30 AS BIGINT) AS bytes, true AS same FROM events")
def value_pointer_codec(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    rows = events.select(F.col("event_id").alias("file_id"), (F.col("event_id") * 1000 + F.col("user_id")).alias("offset"), F.col("user_id").alias("size"), (F.col("event_id") * 7 % (1 << 32)).alias("crc"))
    coded = rows.withColumn("data", encode_pointer(F.col("file_id"), F.col("offset"), F.col("size"), F.col("crc"))).withColumn("back", decode_pointer(F.col("data")))
    same = F.struct("file_id", "offset", "size", "crc") == F.col("back")
    return coded.select("back.file_id", "back.offset", "back.size", "back.crc", F.octet_length("data").cast("long").alias("bytes"), same.alias("same"))


@query(
    "model_store_stats",
    """WITH p AS (SELECT user_id, event_id, strlen(props) AS n FROM events) SELECT CAST(sum(n) AS BIGINT) AS total_bytes, CAST(sum(n) FILTER (latest) AS BIGINT) AS live_bytes, CAST(sum(n) FILTER (NOT latest) AS BIGINT) AS stale_bytes
    FROM (SELECT *, event_id = max(event_id) OVER (PARTITION BY user_id) AS latest FROM p)""",
)
def model_store_stats(spark, sf_dir):
    puts = read_table(spark, sf_dir, "events").select("user_id", "event_id", byte_length("props").alias("n"))
    by_key = puts.groupBy("user_id").agg(F.sum("n").alias("total"), F.max_by("n", "event_id").alias("live"))
    return by_key.agg(F.sum("total").alias("total_bytes"), F.sum("live").alias("live_bytes"), F.sum(F.col("total") - F.col("live")).alias("stale_bytes"))


# Operations derived from events.


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views read, the others write; four operations a transaction, whose last one syncs."""
    e = F.col("event_id")
    return read_table(spark, sf_dir, "events").select(
        (e + 1).alias("seq"), F.when(F.col("event_type").isin("click", "view"), "get").otherwise("put").alias("kind"),
        F.concat(F.lit("b"), (F.col("user_id") % 4).cast("string")).alias("bucket"),
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit(":"), (e % 13).cast("string")).alias("key"),
        F.floor(F.col("value") * 1000).alias("size"), F.expr("event_id div 4").alias("tx"),
        F.when(e % 4 == 3, F.floor(F.col("value") * 500000)).alias("latency"), "user_id", "event_id", "event_type",
    )


_COUNTED = """counted AS (SELECT *, count(*) FILTER (kind = 'get') OVER w AS reads, count(*) FILTER (kind = 'put') OVER w AS updates FROM ops WINDOW w AS (PARTITION BY bucket, user_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
core AS (SELECT user_id, seq, size, reads, updates, reads + updates < 4 AS fallback, CASE WHEN size < 8192 OR (reads + updates >= 4 AND (reads >= 40 OR updates >= 30)) THEN 'inline' ELSE 'value-log' END AS placement FROM counted WHERE kind = 'put')"""
_CORE = valuelog.Lifecycle(threshold=8192, hot_reads=40, frequent_updates=30)


def _core(spark, sf_dir):
    return valuelog.core_decisions(ops(spark, sf_dir), ["user_id"], "seq", _CORE)


@query("lifecycle_core", over_ops("SELECT user_id, seq, size, reads, updates, fallback, placement FROM core", _COUNTED))
def lifecycle_core(spark, sf_dir):
    return _core(spark, sf_dir)


@query("placement_metrics", over_ops("SELECT count(*) FILTER (placement = 'inline') AS inline_decisions, count(*) FILTER (placement = 'value-log') AS value_log_decisions, count(*) FILTER (fallback) AS threshold_fallbacks FROM core", _COUNTED))
def placement_metrics(spark, sf_dir):
    return valuelog.placement_metrics(_core(spark, sf_dir))


def _observed(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", F.floor(F.col("value") * 3000).alias("size"), (F.col("event_id") % 11).alias("reads"), (F.col("event_id") % 6).alias("updates"), (F.col("event_id") % 13).alias("age"), (F.col("event_id") % 17).alias("overwrite_window"))


_MODEL = """obs AS (SELECT user_id, event_id, CAST(floor(value * 3000) AS BIGINT) AS size, event_id % 11 AS reads, event_id % 6 AS updates, event_id % 13 AS age, event_id % 17 AS ow FROM events),
model AS (SELECT *, CASE WHEN reads + updates < 4 THEN 0 WHEN size < 1024 THEN 1 WHEN updates >= 4 OR ow BETWEEN 1 AND 2 THEN 2 WHEN reads >= 8 THEN 3 WHEN size >= 65536 AND age >= 8 THEN 4 ELSE 5 END AS rule FROM obs),
placed AS (SELECT user_id, event_id, size, CASE WHEN rule = 0 THEN CASE WHEN size >= 1024 THEN 'value-log' ELSE 'inline' END WHEN rule IN (1, 2, 3) THEN 'inline' WHEN rule = 4 THEN 'cold-tier' ELSE 'value-log' END AS placement,
  ['insufficient history; size threshold fallback', 'small value avoids pointer fixed cost', 'frequent updates avoid value-log garbage', 'hot reads avoid value-log indirection',
   'large old value is a cold-tier candidate', 'large stable value reduces main-log rewrite bytes'][rule + 1] AS reason, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM model)"""


@query("lifecycle_model", f"WITH {_MODEL} SELECT user_id, event_id, size, placement, reason FROM placed")
def lifecycle_model(spark, sf_dir):
    return valuelog.classify(_observed(spark, sf_dir)).select("user_id", "event_id", "size", "placement", "reason")


@query(
    "lifecycle_hysteresis",
    f"""WITH RECURSIVE {_MODEL}, st AS (SELECT user_id, event_id, rn, placement AS cur, CAST(NULL AS VARCHAR) AS cand, 0 AS held, reason, true AS changed FROM placed WHERE rn = 1
    UNION ALL SELECT p.user_id, p.event_id, p.rn, CASE WHEN p.placement <> s.cur AND p.placement = s.cand AND s.held + 1 >= 2 THEN p.placement ELSE s.cur END,
      CASE WHEN p.placement = s.cur OR (p.placement = s.cand AND s.held + 1 >= 2) THEN NULL ELSE p.placement END,
      CASE WHEN p.placement = s.cur OR (p.placement = s.cand AND s.held + 1 >= 2) THEN 0 WHEN p.placement = s.cand THEN s.held + 1 ELSE 1 END,
      p.reason, coalesce(p.placement <> s.cur AND p.placement = s.cand AND s.held + 1 >= 2, false) FROM st s JOIN placed p ON p.user_id = s.user_id AND p.rn = s.rn + 1)
    SELECT user_id, event_id, cur AS placement, reason, changed FROM st""",
)
def lifecycle_hysteresis(spark, sf_dir):
    return valuelog.settle(valuelog.classify(_observed(spark, sf_dir)), ["user_id"], "event_id")


_MANIFESTS = [(v, p, n, r) for v in (1, 2) for p in ("prepared", "pointers-installed", "source-removed", "finalized", "other") for n in (0, 3) for r in (0, 2)]


@query(
    "gc_manifest_recovery",
    "SELECT CAST(v AS BIGINT) AS version, p AS phase, CAST(n AS BIGINT) AS pointers, CAST(r AS BIGINT) AS replacements, CASE WHEN v = 1 THEN CASE WHEN n = 0 THEN 'remove-source' ELSE 'retain-source' END WHEN p IN ('prepared', 'pointers-installed') THEN CASE WHEN n > 0 THEN 'retain-source' WHEN r > 0 THEN 'remove-source' ELSE 'error' END WHEN p = 'source-removed' THEN 'remove-source' WHEN p = 'finalized' THEN 'clear-manifest' ELSE 'error' END AS action FROM (VALUES "
    + ", ".join(str(m) for m in _MANIFESTS)
    + ") t(v, p, n, r)",
)
def gc_manifest_recovery(spark, sf_dir):
    return valuelog.manifest_recovery(spark.createDataFrame(_MANIFESTS, "version long, phase string, pointers long, replacements long"))


# Segment rotation of data files, one store per user.


@query(
    "segment_rotation",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, 42 + 2 + 7 + strlen(props) AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    st AS (SELECT user_id, event_id, rn, size, 0 AS segment, CASE WHEN size > 256 THEN NULL ELSE 0 END AS "offset", CASE WHEN size > 256 THEN 0 ELSE size END AS used FROM e WHERE rn = 1
    UNION ALL SELECT e.user_id, e.event_id, e.rn, e.size, CASE WHEN e.size <= 256 AND s.used + e.size > 256 THEN s.segment + 1 ELSE s.segment END,
      CASE WHEN e.size > 256 THEN NULL WHEN s.used + e.size > 256 THEN 0 ELSE s.used END, CASE WHEN e.size > 256 THEN s.used WHEN s.used + e.size > 256 THEN e.size ELSE s.used + e.size END
    FROM st s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)
    SELECT user_id, event_id, CAST(size AS BIGINT) AS size, CAST(CASE WHEN size > 256 THEN NULL ELSE segment END AS BIGINT) AS segment, CAST("offset" AS BIGINT) AS "offset" FROM st""",
)
def segment_rotation(spark, sf_dir):
    entries = read_table(spark, sf_dir, "events").select("user_id", "event_id", (F.lit(42 + 2 + 7) + byte_length("props")).alias("size"))
    return valuelog.rotate(entries, ["user_id"], "event_id", 256)


# The compaction controller, one instance per user, an observation per event.


def _control(spark, sf_dir):
    e = F.col("event_id")
    phase = F.when(F.col("event_type") == "view", "read-heavy").when(F.col("event_type") == "signup", "overwrite-heavy").when(F.col("event_type") == "purchase", "write-heavy").otherwise("mixed")
    # the phase of a user's observations changes every third event at most, so that decisions can settle
    return read_table(spark, sf_dir, "events").select(
        "user_id", "event_id", (e % 7 * 2_000_000).alias("p99"), F.lit(10_000_000).cast("long").alias("target"), (e % 5 * 50_000_000).alias("garbage"),
        F.lit(256_000_000).cast("long").alias("data"), (1 + (e % 9) / F.lit(4.0)).alias("write_amp"), (1 + (e % 11) / F.lit(8.0)).alias("space_amp"), phase.alias("phase"),
    )


_CONTROL = """c AS (SELECT user_id, event_id, event_id % 7 * 2000000 AS p99, 10000000 AS target, event_id % 5 * 50000000 AS garbage, 256000000 AS data, 1 + (event_id % 9) / 4.0::DOUBLE AS write_amp, 1 + (event_id % 11) / 8.0::DOUBLE AS space_amp,
  CASE event_type WHEN 'view' THEN 'read-heavy' WHEN 'signup' THEN 'overwrite-heavy' WHEN 'purchase' THEN 'write-heavy' ELSE 'mixed' END AS phase, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
h AS (SELECT *, CASE WHEN garbage > 0 THEN CAST(garbage AS DOUBLE) / CAST(data AS DOUBLE) ELSE 0.0 END AS heap,
  CASE WHEN space_amp >= 2.0 THEN 0 WHEN p99 > target THEN 1 WHEN garbage < 67108864 THEN 2 WHEN write_amp >= 3.0 THEN 3 ELSE 4 END AS rule FROM c),
ev AS (SELECT user_id, event_id, rn, CAST(CASE rule WHEN 0 THEN 33554432 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 8388608 ELSE least(268435456, 16777216 * CASE WHEN heap >= 0.5 THEN 2 ELSE 1 END // CASE WHEN phase = 'write-heavy' THEN 2 ELSE 1 END) END AS BIGINT) AS budget,
  CASE WHEN rule = 0 OR phase = 'overwrite-heavy' THEN 'garbage-ratio' WHEN phase = 'read-heavy' THEN 'hot-cold' ELSE 'file-id' END AS picker,
  ['emergency space amplification', 'foreground p99 exceeds target', 'garbage below minimum work threshold', 'high write amplification limits rewrite budget', 'garbage pressure within latency budget'][rule + 1] AS reason,
  greatest(0.0, least(1.0, CASE rule WHEN 0 THEN space_amp / 2.0 / 2 WHEN 1 THEN CAST(p99 AS DOUBLE) / CAST(target AS DOUBLE) / 2 WHEN 2 THEN 1 - heap WHEN 3 THEN write_amp / 3.0 / 2 ELSE heap + 0.25 END))::DOUBLE AS confidence FROM h)"""
_SETTLED = """st AS (SELECT user_id, event_id, rn, CAST(0 AS BIGINT) AS budget, 'file-id' AS picker, CASE WHEN budget = 0 AND picker = 'file-id' THEN reason END AS reason, CASE WHEN budget = 0 AND picker = 'file-id' THEN confidence END AS confidence,
    CASE WHEN budget = 0 AND picker = 'file-id' THEN NULL ELSE budget END AS wb, CASE WHEN budget = 0 AND picker = 'file-id' THEN NULL ELSE picker END AS wp, CASE WHEN budget = 0 AND picker = 'file-id' THEN 0 ELSE 1 END AS held, CAST(0 AS BIGINT) AS changed_at, false AS changed FROM ev WHERE rn = 1
  UNION ALL SELECT user_id, event_id, rn, CASE WHEN takes THEN greatest(b - 16777216, least(b + 16777216, nb)) ELSE b END, CASE WHEN takes THEN np ELSE p END, CASE WHEN same OR takes THEN nr ELSE r END, CASE WHEN same OR takes THEN nc ELSE c END,
    CASE WHEN same OR takes THEN NULL ELSE nb END, CASE WHEN same OR takes THEN NULL ELSE np END, CASE WHEN same OR takes THEN 0 ELSE nh END, CASE WHEN takes THEN rn ELSE ca END, takes
  FROM (SELECT *, NOT same AND nh >= 2 AND (ca = 0 OR rn - ca >= 2) AS takes FROM (SELECT e.user_id, e.event_id, e.rn, s.budget AS b, s.picker AS p, s.reason AS r, s.confidence AS c, s.changed_at AS ca, e.budget AS nb, e.picker AS np, e.reason AS nr, e.confidence AS nc,
    e.budget = s.budget AND e.picker = s.picker AS same, CASE WHEN e.budget = s.wb AND e.picker = s.wp THEN s.held + 1 ELSE 1 END AS nh FROM st s JOIN ev e ON e.user_id = s.user_id AND e.rn = s.rn + 1)))"""


@query("slo_evaluate", f"WITH {_CONTROL} SELECT user_id, event_id, budget, picker, reason, confidence FROM ev")
def slo_evaluate(spark, sf_dir):
    return compaction.evaluate(_control(spark, sf_dir)).select("user_id", "event_id", "budget", "picker", "reason", "confidence")


def _observed_control(spark, sf_dir):
    return compaction.observe(compaction.evaluate(_control(spark, sf_dir)), ["user_id"], "event_id")


@query("slo_observe", f"WITH RECURSIVE {_CONTROL}, {_SETTLED} SELECT user_id, event_id, budget, picker, reason, confidence, changed FROM st")
def slo_observe(spark, sf_dir):
    return _observed_control(spark, sf_dir)


@query(
    "recommendation_audit_ring",
    f"WITH RECURSIVE {_CONTROL}, {_SETTLED} SELECT user_id, event_id, budget, picker, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM st QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 32",
)
def recommendation_audit_ring(spark, sf_dir):
    return compaction.last_events(_observed_control(spark, sf_dir).select("user_id", "event_id", "budget", "picker"), ["user_id"], "event_id", 32)


# Durability.

_CONFIGS = [(m, s) for m in ("default", "none", "every-commit", "group", "adaptive") for s in (False, True)]


@query("effective_sync_policy", "SELECT m AS mode, s AS sync_enable, CASE WHEN m <> 'default' THEN m WHEN s THEN 'every-commit' ELSE 'none' END AS policy FROM (VALUES " + ", ".join(f"('{m}', {str(s).lower()})" for m, s in _CONFIGS) + ") t(m, s)")
def effective_sync_policy(spark, sf_dir):
    return durability.effective(spark.createDataFrame(_CONFIGS, "mode string, sync_enable boolean"))


def _dirty(spark, sf_dir):
    e = F.col("event_id")
    return read_table(spark, sf_dir, "events").select("event_id", (e % 97 * 50).alias("dirty_bytes"), (e % 71).alias("dirty_commits"), (e % 60 * 1_000_000).alias("since"), F.floor(F.col("value") * 100_000).alias("latency"))


_DIRTY = "d AS (SELECT event_id, event_id % 97 * 50 AS dirty_bytes, event_id % 71 AS dirty_commits, event_id % 60 * 1000000 AS since, CAST(floor(value * 100000) AS BIGINT) AS latency FROM events)"


@query("adaptive_engine_decision", f"WITH {_DIRTY} SELECT event_id, CASE WHEN dirty_bytes >= 4096 OR dirty_commits >= 64 OR since >= 50000000 THEN true WHEN since < 1000000 THEN false WHEN latency > 5000000 AND dirty_bytes < 4096 THEN false ELSE true END AS should_sync FROM d")
def adaptive_engine_decision(spark, sf_dir):
    should = durability.engine_decision(durability.SyncPolicy(), F.col("dirty_bytes"), F.col("dirty_commits"), F.col("since"), F.col("latency"))
    return _dirty(spark, sf_dir).select("event_id", should.alias("should_sync"))


@query("adaptive_model_decision", f"WITH {_DIRTY}, m AS (SELECT *, CASE WHEN dirty_bytes >= 4096 OR since >= 50000000 THEN 0 WHEN latency > 5000000 AND dirty_bytes < 4096 THEN 1 WHEN since < 1000000 THEN 2 ELSE 0 END AS rule FROM d) SELECT event_id, rule = 0 AS should_sync, CAST(CASE rule WHEN 1 THEN 1000000 WHEN 2 THEN 1000000 - since ELSE 0 END AS BIGINT) AS delay FROM m")
def adaptive_model_decision(spark, sf_dir):
    return durability.model_decision(_dirty(spark, sf_dir), durability.SyncPolicy()).select("event_id", "should_sync", "delay")


_COMMITS = "cm AS (SELECT user_id, event_id, epoch_us(ts) * 1000 // 1000000 AS at_, CAST(floor(value * 40) AS BIGINT) AS size, CAST(floor(value * 200000) AS BIGINT) AS latency, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)"


def _commits(spark, sf_dir):
    """A commit per event; milliseconds of the events count as nanoseconds, so that commits come close together."""
    at = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return read_table(spark, sf_dir, "events").select("user_id", "event_id", at.alias("at"), F.floor(F.col("value") * 40).alias("size"), F.floor(F.col("value") * 200_000).alias("latency"))


_EAGER = durability.SyncPolicy(bytes_limit=4096, commits_limit=8, min_delay=20_000_000, max_delay=200_000_000, target_latency=5_000_000)


@query(
    "dirty_accumulation",
    f"""WITH RECURSIVE {_COMMITS}, st AS (SELECT user_id, event_id, rn, at_, size AS db, CAST(1 AS BIGINT) AS dc, at_ AS synced_at, CAST(0 AS BIGINT) AS ll, size >= 4096 AS synced, latency FROM cm WHERE rn = 1
    UNION ALL SELECT user_id, event_id, rn, at_, db, dc, sa, ll, CASE WHEN db >= 4096 OR dc >= 8 OR at_ - sa >= 200000000 THEN true WHEN at_ - sa < 20000000 THEN false ELSE NOT (ll > 5000000 AND db < 4096) END, latency
    FROM (SELECT c.user_id, c.event_id, c.rn, c.at_, CASE WHEN s.synced THEN 0 ELSE s.db END + c.size AS db, CASE WHEN s.synced THEN 0 ELSE s.dc END + 1 AS dc, CASE WHEN s.synced THEN s.at_ ELSE s.synced_at END AS sa, CASE WHEN s.synced THEN s.latency ELSE s.ll END AS ll, c.latency
      FROM st s JOIN cm c ON c.user_id = s.user_id AND c.rn = s.rn + 1))
    SELECT user_id, event_id, CAST(db AS BIGINT) AS dirty_bytes, CAST(dc AS BIGINT) AS dirty_commits, synced FROM st""",
)
def dirty_accumulation(spark, sf_dir):
    return durability.dirty_counters(_commits(spark, sf_dir), ["user_id"], "event_id", _EAGER)


_EPOCHS = """ep AS (SELECT user_id, event_id, rn, at_ AS first, 1 AS n, CAST(1 AS BIGINT) AS epoch FROM cm WHERE rn = 1
  UNION ALL SELECT c.user_id, c.event_id, c.rn, CASE WHEN e.n = 4 OR c.at_ >= e.first + 60000000 THEN c.at_ ELSE e.first END, CASE WHEN e.n = 4 OR c.at_ >= e.first + 60000000 THEN 1 ELSE e.n + 1 END,
    CASE WHEN e.n = 4 OR c.at_ >= e.first + 60000000 THEN e.epoch + 1 ELSE e.epoch END FROM ep e JOIN cm c ON c.user_id = e.user_id AND c.rn = e.rn + 1)"""


def _epochs(spark, sf_dir):
    return durability.group_epochs(_commits(spark, sf_dir), ["user_id"], "event_id", 4, 60_000_000)


@query("group_epochs", f"WITH RECURSIVE {_COMMITS}, {_EPOCHS} SELECT user_id, event_id, epoch FROM ep")
def group_epochs(spark, sf_dir):
    return _epochs(spark, sf_dir)


@query(
    "group_epoch_metrics",
    f"""WITH RECURSIVE {_COMMITS}, {_EPOCHS}, z AS (SELECT user_id, epoch, count(*) AS n, max(event_id) AS last FROM ep GROUP BY ALL)
    SELECT user_id, count(*) AS epochs, CAST(sum(n) AS BIGINT) AS waiters, max(n) AS max_size, count(*) FILTER (n <= 1) AS size_1, count(*) FILTER (n = 2) AS size_2, count(*) FILTER (n BETWEEN 3 AND 4) AS size_3_4,
    count(*) FILTER (n BETWEEN 5 AND 8) AS size_5_8, count(*) FILTER (n >= 9) AS size_9_plus, max(epoch) AS last_epoch, max(last) AS frontier FROM z GROUP BY 1""",
)
def group_epoch_metrics(spark, sf_dir):
    return durability.epoch_metrics(_epochs(spark, sf_dir), ["user_id"], "event_id")


@query(
    "retry_streaks",
    """WITH s AS (SELECT user_id, event_id, event_type <> 'error' AND event_id % 3 <> 0 AS ok FROM events),
    r AS (SELECT *, coalesce(count(*) FILTER (ok) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM s),
    g AS (SELECT user_id, run, count(*) FILTER (NOT ok) AS n, bool_or(ok) AS won FROM r GROUP BY ALL)
    SELECT user_id, count(*) FILTER (won AND n > 0) AS retries_ok, count(*) FILTER (won AND n = 1) AS after_1, count(*) FILTER (won AND n = 2) AS after_2, count(*) FILTER (won AND n = 3) AS after_3, count(*) FILTER (won AND n >= 4) AS after_4_plus FROM g GROUP BY 1""",
)
def retry_streaks(spark, sf_dir):
    syncs = read_table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("event_type") != "error") & (F.col("event_id") % 3 != 0)).alias("ok"))
    return durability.retry_streaks(syncs, ["user_id"], "event_id")


_BOUNDS = ", ".join(str(b) for b in durability.LATENCY_BOUNDS)


@query(
    "latency_percentiles",
    f"""WITH l AS (SELECT event_type, CAST(floor(value * value * 100000) AS BIGINT) AS latency FROM events),
    b AS (SELECT *, coalesce(list_min(list_filter([{_BOUNDS}], lambda x: x >= latency)), 1000000000) AS bound FROM l),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY latency) AS rn, count(*) OVER (PARTITION BY event_type) AS total FROM b)
    SELECT event_type, max(total) AS count, CAST(max(bound) FILTER (rn = (total * 50 + 99) // 100) AS BIGINT) AS p50, CAST(max(bound) FILTER (rn = (total * 95 + 99) // 100) AS BIGINT) AS p95,
    CAST(max(bound) FILTER (rn = (total * 99 + 99) // 100) AS BIGINT) AS p99, max(latency) AS max FROM r GROUP BY 1""",
)
def latency_percentiles(spark, sf_dir):
    commits = read_table(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") * F.col("value") * 100000).alias("latency"))
    return durability.latency_percentiles(commits, ["event_type"])


@query(
    "metrics_snapshot",
    over_log(
        """SELECT count(*) FILTER (m = 1) AS commits, count(*) FILTER (m = 0) AS partial_transactions, CAST(sum(n) AS BIGINT) AS entries_written, CAST(sum(CASE WHEN m = 1 THEN n ELSE 0 END) AS BIGINT) AS entries_committed,
        CAST(sum(d) AS BIGINT) AS deletes, CAST(sum(b) AS BIGINT) AS value_bytes FROM (SELECT tx_id, count(*) AS n, max(status) AS m, count(*) FILTER (flag = 0) AS d, sum(strlen(value)) AS b FROM log GROUP BY 1)"""
    ),
)
def metrics_snapshot(spark, sf_dir):
    return durability.metrics(load_log(spark, sf_dir))


_SYNCS = "SELECT event_type <> 'error' AND event_id % 3 <> 0 AS ok, CAST(floor(value * 500000) AS BIGINT) AS latency FROM events"


@query(
    "metrics_all",
    f"""SELECT l.*, t.*, s.*, m.*, e.*, r.* FROM
    (SELECT CAST(count(*) AS BIGINT) AS entries_written, CAST(sum(size) AS BIGINT) AS bytes_written, count(DISTINCT file_id) - 1 AS rotations FROM ({over_log("SELECT file_id, size FROM sized", SIZED)})) l,
    (SELECT commits, entries_committed AS recovery_entries, commits AS recovery_committed_tx FROM ({ORACLES["metrics_snapshot"]})) t,
    (SELECT count(*) FILTER (ok) AS syncs, count(*) FILTER (NOT ok) AS sync_errors, CAST(sum(latency) AS BIGINT) AS total_sync_nanos FROM ({_SYNCS})) s,
    (SELECT CAST(count(*) AS BIGINT) AS merge_runs, CAST(sum(bytes_read) AS BIGINT) AS merge_bytes_read, CAST(sum(bytes_written) AS BIGINT) AS merge_bytes_written FROM ({ORACLES["merge_byte_counters"]})) m,
    (SELECT CAST(sum(epochs) AS BIGINT) AS group_epochs, CAST(sum(waiters) AS BIGINT) AS group_waiters, max(max_size) AS group_max_size, max(last_epoch) AS group_last_epoch, CAST(sum(size_1) AS BIGINT) AS group_size_1,
      CAST(sum(size_2) AS BIGINT) AS group_size_2, CAST(sum(size_3_4) AS BIGINT) AS group_size_3_4, CAST(sum(size_5_8) AS BIGINT) AS group_size_5_8, CAST(sum(size_9_plus) AS BIGINT) AS group_size_9_plus, max(frontier) AS durable_frontier FROM ({ORACLES["group_epoch_metrics"]})) e,
    (SELECT (SELECT count(*) FROM ({_SYNCS}) WHERE NOT ok) AS durability_retries, CAST(sum(retries_ok) AS BIGINT) AS durability_retry_ok, CAST(sum(after_1) AS BIGINT) AS durability_retry_after_1, CAST(sum(after_2) AS BIGINT) AS durability_retry_after_2,
      CAST(sum(after_3) AS BIGINT) AS durability_retry_after_3, CAST(sum(after_4_plus) AS BIGINT) AS durability_retry_after_4_plus FROM ({ORACLES["retry_streaks"]})) r""",
)
def metrics_all(spark, sf_dir):
    events, log = read_table(spark, sf_dir, "events"), load_log(spark, sf_dir)
    syncs = events.select("user_id", "event_id", ((F.col("event_type") != "error") & (F.col("event_id") % 3 != 0)).alias("ok"), F.floor(F.col("value") * 500_000).alias("latency"))
    failures = syncs.groupBy("user_id").agg(F.count_if(~F.col("ok")).alias("failures"))
    retries = durability.retry_streaks(syncs.select("user_id", "event_id", "ok"), ["user_id"], "event_id").join(failures, "user_id")
    merges = compaction.merge_bytes(log, log.where("file_id % 3 = 0").select("file_id").distinct())
    return durability.metrics_snapshot(log, syncs, group_epoch_metrics(spark, sf_dir), retries, merges)


_OPTIONS = [(0, 0, 0.0, 0.0, 0, 0, 0, 0), (1, 1000, 0.0, 2.5, 0, 0, 5, -1), (2, -5, 1.5, 0.0, 4096, 8192, 0, 3), (3, 1, 9.0, 9.0, 1, 1, 1, 1)]
_OPTION_NAMES = ["min_garbage", "emergency_space_amp", "high_write_amp", "base_budget", "max_budget", "stable_windows", "cooldown_windows"]


@query(
    "slo_overrides",
    "SELECT CAST(inst AS BIGINT) AS inst, " + ", ".join(f"CAST(CASE WHEN {n} > 0 THEN {n} ELSE {getattr(compaction.ControllerConfig, n)} END AS {'DOUBLE' if 'amp' in n else 'BIGINT'}) AS {n}" for n in _OPTION_NAMES)
    + f" FROM (VALUES {', '.join(map(str, _OPTIONS))}) t(inst, {', '.join(_OPTION_NAMES)})",
)
def slo_overrides(spark, sf_dir):
    kinds = ["long" if "amp" not in n else "double" for n in _OPTION_NAMES]
    return compaction.overridden(spark.createDataFrame(_OPTIONS, "inst long, " + ", ".join(f"{n} {k}" for n, k in zip(_OPTION_NAMES, kinds, strict=True))))


# Phases.


@query("op_counters", over_ops("SELECT count(*) FILTER (kind = 'get') AS reads, count(*) FILTER (kind = 'put') AS writes, count(*) FILTER (overwrite) AS overwrites, count(*) FILTER (kind = 'put' AND size >= 16384) AS large_writes FROM marked"))
def op_counters(spark, sf_dir):
    return policy.op_counters(ops(spark, sf_dir))


@query("op_windows", over_windows("SELECT * FROM wins"))
def op_windows(spark, sf_dir):
    return policy.op_windows(ops(spark, sf_dir))


def _analyzed(spark, sf_dir):
    return policy.analyze(policy.op_windows(ops(spark, sf_dir))).withColumn("inst", F.col("win") % 4)


@query("phase_analyze", over_windows("SELECT * FROM analyzed"))
def phase_analyze(spark, sf_dir):
    return policy.analyze(policy.op_windows(ops(spark, sf_dir)))


_OBSERVED = """nth AS (SELECT win % 4 AS inst, *, row_number() OVER (PARTITION BY win % 4 ORDER BY win) AS rn FROM analyzed),
st AS (SELECT inst, win, rn, 'unknown' AS cur, CASE WHEN phase = 'unknown' THEN NULL ELSE phase END AS cand, CASE WHEN phase = 'unknown' THEN 0 ELSE 1 END AS held, CAST(0 AS BIGINT) AS ca, confidence, reason, false AS changed FROM nth WHERE rn = 1
  UNION ALL SELECT inst, win, rn, CASE WHEN takes THEN phase ELSE cur END, CASE WHEN keeps OR takes THEN NULL ELSE phase END, CASE WHEN keeps OR takes THEN 0 ELSE nh END, CASE WHEN takes THEN rn ELSE ca END, confidence, reason, takes
  FROM (SELECT *, NOT keeps AND nh >= 2 AND (ca = 0 OR rn - ca >= 2) AS takes FROM (SELECT n.inst, n.win, n.rn, n.phase, n.confidence, n.reason, s.cur, s.ca, n.phase = 'unknown' OR n.phase = s.cur AS keeps, CASE WHEN n.phase = s.cand THEN s.held + 1 ELSE 1 END AS nh FROM st s JOIN nth n ON n.inst = s.inst AND n.rn = s.rn + 1)))"""
_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in policy.RECOMMENDATIONS) + ") t(phase, sync, compaction, placement))"


def _phases(spark, sf_dir):
    return policy.observe(_analyzed(spark, sf_dir), ["inst"], "win")


@query("phase_observe", over_windows("SELECT inst, win, cur AS phase, confidence, reason, changed FROM st", _OBSERVED))
def phase_observe(spark, sf_dir):
    return _phases(spark, sf_dir)


@query("phase_recommend", over_windows("SELECT inst, win, cur AS phase, sync, compaction, placement FROM st JOIN rules ON rules.phase = st.cur", _OBSERVED, _RULES))
def phase_recommend(spark, sf_dir):
    return policy.recommend(_phases(spark, sf_dir)).select("inst", "win", "phase", "sync", "compaction", "placement")


@query(
    "autotune_decision",
    over_windows(
        """SELECT inst, win, mode, lifecycle, mode <> 'file-id' AS compaction_changed, lifecycle AS placement_changed, CASE WHEN cur = 'unknown' THEN 'recommendation unavailable' WHEN confidence < 0.5 THEN 'recommendation below confidence threshold' ELSE reason END AS outcome
        FROM (SELECT *, CASE WHEN confidence >= 0.5 AND cur <> 'unknown' AND compaction <> 'no-change' THEN compaction ELSE 'file-id' END AS mode, confidence >= 0.5 AND cur <> 'unknown' AND placement = 'lifecycle' AS lifecycle FROM st JOIN rules ON rules.phase = st.cur)""",
        _OBSERVED,
        _RULES,
    ),
)
def autotune_decision(spark, sf_dir):
    done = policy.autotune(policy.recommend(_phases(spark, sf_dir)), "file-id", False, value_log=True, min_confidence=0.5)
    return done.select("inst", "win", "mode", "lifecycle", "compaction_changed", "placement_changed", "outcome")


@query(
    "autotune_reset",
    f"""SELECT inst, win, 'file-id' AS mode, false AS lifecycle, mode <> 'file-id' AS compaction_changed, lifecycle AS placement_changed, 'restored configured policies' AS outcome FROM ({ORACLES["autotune_decision"]})""",
)
def autotune_reset(spark, sf_dir):
    return policy.reset(autotune_decision(spark, sf_dir), "file-id", False)


@query("policy_audit_ring", over_windows("SELECT inst, win, cur AS phase, row_number() OVER (PARTITION BY inst ORDER BY win) AS sequence FROM st QUALIFY row_number() OVER (PARTITION BY inst ORDER BY win DESC) <= 16", _OBSERVED))
def policy_audit_ring(spark, sf_dir):
    return compaction.last_events(_phases(spark, sf_dir).select("inst", "win", "phase"), ["inst"], "win", 16)


@query(
    "autonomous_observation",
    f"""WITH RECURSIVE {OPS}, {OVERWRITES}, {DOCS}, {VLOG}
    SELECT m.*, v.* FROM (SELECT count(*) FILTER (kind = 'get') AS reads, count(*) FILTER (kind = 'put') AS writes, count(*) FILTER (overwrite) AS overwrites, CAST(sum(latency) // count(latency) AS BIGINT) AS sync_latency FROM marked) m,
    (SELECT CAST(sum(total_bytes) AS BIGINT) AS value_log_bytes, CAST(sum(stale_bytes) AS BIGINT) AS stale_bytes FROM vstats) v""",
)
def autonomous_observation(spark, sf_dir):
    flagged = policy.mark_overwrites(ops(spark, sf_dir))
    counters = flagged.agg(F.count_if(F.col("kind") == "get").alias("reads"), F.count_if(F.col("kind") == "put").alias("writes"), F.count_if("overwrite").alias("overwrites"), F.expr("sum(latency) div count(latency)").alias("sync_latency"))
    pressure = _stats(spark, sf_dir)[0].agg(F.sum("total_bytes").alias("value_log_bytes"), F.sum("stale_bytes").alias("stale_bytes"))
    return counters.join(pressure)  # one row each


@query("value_log_segment_ids", "SELECT CASE WHEN id = 0 THEN 'values.vlog' ELSE 'values-' || lpad(CAST(id * 977 AS VARCHAR), 20, '0') || '.vlog' END AS name, id * 977 AS segment FROM range(200) t(id)")
def value_log_segment_ids(spark, sf_dir):
    number = F.concat(F.lit("values-"), F.lpad((F.col("id") * 977).cast("string"), 20, "0"), F.lit(".vlog"))
    names = spark.range(200).select(F.explode(F.array(F.when(F.col("id") == 0, "values.vlog").otherwise(number), F.concat(F.col("id").cast("string"), F.lit(".data")))).alias("name"))
    return valuelog.segment_ids(names)


@query(
    "value_log_read",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'checksum differs' WHEN doc_id % 5 = 1 THEN 'out of bounds' ELSE 'ok' END AS status,
    CASE WHEN doc_id % 5 > 1 THEN md5(text) END AS value_md5 FROM documents WHERE octet_length(encode(coalesce(text, ''))) >= 1024""",
)
def value_log_read(spark, sf_dir):
    """Each long document is a segment; every fifth pointer has a wrong checksum, another fifth is a byte too long."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("blob")).where(F.octet_length("blob") >= THRESHOLD)
    size = F.octet_length("blob") + F.when(F.col("doc_id") % 5 == 1, 1).otherwise(0)
    crc = F.crc32("blob") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    pointers = docs.select("doc_id", F.lit(0).alias("offset"), size.alias("size"), crc.alias("crc"))
    return valuelog.read_values(docs, pointers, ["doc_id"]).select("doc_id", "status", F.md5("value").alias("value_md5"))
