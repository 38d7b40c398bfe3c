"""Workload phases and what they recommend."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltlog.functions.expr import ratio
from siltlog.functions.fold import ordered_fold

#: Fixed table: phase, sync policy, compaction, placement.
RECOMMENDATIONS = [
    ("write-heavy", "group", "garbage-ratio", "inline"),
    ("read-heavy", "no-change", "hot-cold", "inline"),
    ("overwrite-heavy", "group", "garbage-ratio", "lifecycle"),
    ("large-value-heavy", "adaptive", "hot-cold", "value-log"),
    ("sync-latency-sensitive", "adaptive", "file-id", "no-change"),
    ("mixed", "adaptive", "hot-cold", "lifecycle"),
    ("unknown", "no-change", "no-change", "no-change"),
]


@dataclass(frozen=True)
class DetectorConfig:
    """Fixed defaults of the detector; the latency is in nanoseconds."""

    min_operations: int = 100
    write_ratio: float = 0.70
    read_ratio: float = 0.70
    overwrite_ratio: float = 0.50
    large_ratio: float = 0.50
    sync_latency: int = 5_000_000
    consecutive: int = 2
    cooldown: int = 2


def op_counters(ops: DataFrame, large: int = 16 * 1024) -> DataFrame:
    """(seq, kind, bucket, key, size, tx): reads, writes, overwrites of keys an earlier transaction wrote, large writes."""
    flagged = mark_overwrites(ops)
    return flagged.agg(
        F.count_if(F.col("kind") == "get").alias("reads"), F.count_if(F.col("kind") == "put").alias("writes"),
        F.count_if("overwrite").alias("overwrites"), F.count_if((F.col("kind") == "put") & (F.col("size") >= large)).alias("large_writes"),
    )


def mark_overwrites(ops: DataFrame) -> DataFrame:
    """overwrite: a put whose key a put of an earlier transaction has written. First writes are aggregated in the tasks
    and joined, so that a key with a large share of the operations can be split."""
    first = ops.where("kind = 'put'").groupBy("bucket", "key").agg(F.min("tx").alias("_first"))
    marked = ops.join(first, ["bucket", "key"], "left").withColumn("overwrite", (F.col("kind") == "put") & (F.col("_first") < F.col("tx")))
    return marked.drop("_first")


def op_windows(ops: DataFrame, size: int = 100, large: int = 16 * 1024) -> DataFrame:
    """Tumbling windows of `size` operations by seq (from 1), with the mean latency of the syncs in the window."""
    flagged = mark_overwrites(ops).withColumn("win", F.expr(f"(seq - 1) div {size}"))
    return flagged.groupBy("win").agg(
        F.count_if(F.col("kind") == "get").alias("reads"), F.count_if(F.col("kind") == "put").alias("writes"), F.count_if("overwrite").alias("overwrites"),
        F.count_if((F.col("kind") == "put") & (F.col("size") >= large)).alias("large_writes"),
        F.coalesce(F.expr("sum(latency) div nullif(count(latency), 0)"), F.lit(0)).alias("sync_latency"),
    )


def analyze(windows: DataFrame, config: DetectorConfig = DetectorConfig()) -> DataFrame:
    """windows with phase, confidence and reason."""
    ops = F.col("reads") + F.col("writes")
    write, read = ratio("writes", ops), ratio("reads", ops)
    over, large = ratio("overwrites", "writes"), ratio("large_writes", "writes")
    some = F.col("writes") > 0
    few = ops < config.min_operations
    rules = [
        (few, "unknown", F.lit(0.0), "insufficient operations"),
        (some & (F.col("sync_latency") >= config.sync_latency) & (write >= 0.5), "sync-latency-sensitive", F.least(F.lit(1.0), F.col("sync_latency").cast("double") / (2.0 * config.sync_latency)), "sync latency exceeds threshold"),
        (some & (over >= config.overwrite_ratio), "overwrite-heavy", over, "overwrites dominate writes"),
        (some & (large >= config.large_ratio), "large-value-heavy", large, "large values dominate writes"),
        (write >= config.write_ratio, "write-heavy", write, "writes dominate operations"),
        (read >= config.read_ratio, "read-heavy", read, "reads dominate operations"),
    ]
    phase, confidence, reason = F.lit("mixed"), 1 - F.abs(write - read), F.lit("no operation class dominates")
    for rule, name, score, why in reversed(rules):
        phase, confidence, reason = F.when(rule, name).otherwise(phase), F.when(rule, score).otherwise(confidence), F.when(rule, why).otherwise(reason)
    return windows.withColumns({"phase": phase, "confidence": confidence, "reason": reason})


def observe(analyzed: DataFrame, keys: list[str], order: str, config: DetectorConfig = DetectorConfig()) -> DataFrame:
    """The phase with hysteresis: another one must hold for consecutive windows, and after the cooldown. The newest
    analysis' confidence and reason are reported whatever the phase."""
    kinds = dict(analyzed.dtypes)

    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        s["window"] += 1
        seen, changed = row["phase"], False
        if seen in ("unknown", s["now"]):
            s |= {"wish": None, "held": 0}
        else:
            s["held"] = s["held"] + 1 if seen == s["wish"] else 1
            s["wish"] = seen
            if s["held"] >= config.consecutive and (not s["changed_at"] or s["window"] - s["changed_at"] >= config.cooldown):
                s |= {"now": seen, "wish": None, "held": 0, "changed_at": s["window"]}
                changed = True
        return s, [{**{k: row[k] for k in [*keys, order]}, "phase": s["now"], "confidence": row["confidence"], "reason": row["reason"], "changed": changed}]

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in [*keys, order]), "phase string", "confidence double", "reason string", "changed boolean"])
    return ordered_fold(analyzed.select(*keys, order, "phase", "confidence", "reason"), keys, [order], lambda: {"now": "unknown", "wish": None, "held": 0, "window": 0, "changed_at": 0}, step, schema)


def recommend(phases: DataFrame) -> DataFrame:
    """phases with sync, compaction and placement of the fixed table (seven rows, sent to all tasks)."""
    rules = phases.sparkSession.createDataFrame(RECOMMENDATIONS, "phase string, sync string, compaction string, placement string")
    return phases.join(F.broadcast(rules), "phase")


def reset(applied: DataFrame, configured_mode: str, configured_lifecycle: bool) -> DataFrame:
    """(mode, lifecycle) in force, set back to what was configured, with what that changes."""
    changed = {"compaction_changed": F.col("mode") != configured_mode, "placement_changed": F.col("lifecycle") != F.lit(configured_lifecycle)}
    return applied.withColumns(changed).withColumns({"mode": F.lit(configured_mode), "lifecycle": F.lit(configured_lifecycle), "outcome": F.lit("restored configured policies")})


def autotune(recommended: DataFrame, configured_mode: str, configured_lifecycle: bool, value_log: bool, min_confidence: float = 0.7, apply_compaction: bool = True, apply_placement: bool = True) -> DataFrame:
    """What applying each recommendation, by itself, would set; below the least confidence nothing changes."""
    enough = (F.col("confidence") >= min_confidence) & (F.col("phase") != "unknown")
    mode = F.when(F.col("compaction").isin("garbage-ratio", "hot-cold", "file-id"), F.col("compaction")).otherwise(configured_mode)
    on = F.when(F.col("placement") == "lifecycle", True).when(F.col("placement").isin("inline", "value-log"), False).otherwise(F.lit(configured_lifecycle))
    mode = F.when(enough & F.lit(apply_compaction), mode).otherwise(configured_mode)
    on = F.when(enough & F.lit(apply_placement and value_log), on).otherwise(F.lit(configured_lifecycle))
    reason = F.when(F.col("phase") == "unknown", "recommendation unavailable").when(~enough, "recommendation below confidence threshold").otherwise(F.col("reason"))
    return recommended.withColumns({"mode": mode, "lifecycle": on, "compaction_changed": mode != configured_mode, "placement_changed": on != F.lit(configured_lifecycle), "outcome": reason})
