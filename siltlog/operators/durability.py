"""Durability decisions and metrics: sync policies, dirty counters, group-commit epochs, retries, latencies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltlog.functions.expr import entry_size
from siltlog.functions.fold import ordered_fold

#: Upper bounds of the commit latency histogram, in nanoseconds; longer ones count in a bucket reported as 1 s.
LATENCY_BOUNDS = [10_000, 25_000, 50_000, 100_000, 250_000, 500_000, 1_000_000, 2_000_000, 5_000_000, 10_000_000, 25_000_000, 50_000_000, 100_000_000, 250_000_000, 500_000_000, 1_000_000_000]


@dataclass(frozen=True)
class SyncPolicy:
    """Bytes, commits and nanoseconds; 0 switches a limit off."""

    bytes_limit: int = 4096
    commits_limit: int = 64
    min_delay: int = 1_000_000
    max_delay: int = 50_000_000
    target_latency: int = 5_000_000


def effective(configs: DataFrame) -> DataFrame:
    """(mode, sync_enable) with the policy in force."""
    return configs.withColumn("policy", F.when(F.col("mode") != "default", F.col("mode")).when(F.col("sync_enable"), "every-commit").otherwise("none"))


def engine_decision(p: SyncPolicy, dirty_bytes: Column, dirty_commits: Column, since: Column, latency: Column) -> Column:
    """Whether to sync: limits first, then the least delay, then a slow last sync."""
    rules = [
        (p.bytes_limit > 0, dirty_bytes >= p.bytes_limit, True),
        (p.commits_limit > 0, dirty_commits >= p.commits_limit, True),
        (p.max_delay > 0, since >= p.max_delay, True),
        (p.min_delay > 0, since < p.min_delay, False),
        (p.target_latency > 0 and p.bytes_limit > 0, (latency > p.target_latency) & (dirty_bytes < p.bytes_limit), False),
    ]
    out = F.lit(True)
    for on, rule, verdict in reversed(rules):
        if on:
            out = F.when(rule, verdict).otherwise(out)
    return out


def model_decision(obs: DataFrame, p: SyncPolicy) -> DataFrame:
    """(dirty_bytes, since, latency) with should_sync and delay: here a slow last sync comes before the least delay."""
    held = min(max(p.min_delay, 0), p.max_delay) if p.max_delay > 0 else max(p.min_delay, 0)
    full = F.lit(p.bytes_limit > 0) & (F.col("dirty_bytes") >= p.bytes_limit)
    late = F.lit(p.max_delay > 0) & (F.col("since") >= p.max_delay)
    slow = F.lit(p.target_latency > 0) & (F.col("latency") > p.target_latency) & (F.col("dirty_bytes") < p.bytes_limit)
    early = F.lit(p.min_delay > 0) & (F.col("since") < p.min_delay)
    sync = full | late | ~(slow | early)
    return obs.withColumns({"should_sync": sync, "delay": F.when(sync, 0).when(slow, held).otherwise(p.min_delay - F.col("since")).cast("long")})


def dirty_counters(commits: DataFrame, keys: list[str], order: str, p: SyncPolicy) -> DataFrame:
    """(keys, order, at, size, latency): what is dirty after each commit, and whether it syncs, which resets it.

    `at` is the commit's time, `latency` what a sync at it takes; the first commit counts from time `at`.
    """
    kinds = dict(commits.dtypes)

    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        if s["synced_at"] is None:
            s["synced_at"] = row["at"]
        s["bytes"] += row["size"]
        s["commits"] += 1
        since = row["at"] - s["synced_at"]
        if (0 < p.bytes_limit <= s["bytes"]) or (0 < p.commits_limit <= s["commits"]) or (0 < p.max_delay <= since):
            sync = True
        elif since < p.min_delay:
            sync = False
        else:
            sync = not (p.target_latency > 0 and s["latency"] > p.target_latency and s["bytes"] < p.bytes_limit)
        out = {**{k: row[k] for k in [*keys, order]}, "dirty_bytes": s["bytes"], "dirty_commits": s["commits"], "synced": sync}
        if sync:
            s |= {"bytes": 0, "commits": 0, "synced_at": row["at"], "latency": row["latency"]}
        return s, [out]

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in [*keys, order]), "dirty_bytes bigint", "dirty_commits bigint", "synced boolean"])
    return ordered_fold(commits.select(*keys, order, "at", "size", "latency"), keys, [order], lambda: {"bytes": 0, "commits": 0, "synced_at": None, "latency": 0}, step, schema)


def group_epochs(waiters: DataFrame, keys: list[str], order: str, max_writes: int = 16, max_delay: int = 1_000_000) -> DataFrame:
    """(keys, order, at) with the epoch that each waiter joins: it closes when full or max_delay after its first."""
    kinds = dict(waiters.dtypes)

    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        if s["n"] == 0 or s["n"] == max_writes or row["at"] >= s["first"] + max_delay:
            s |= {"epoch": s["epoch"] + 1, "first": row["at"], "n": 0}
        s["n"] += 1
        return s, [{**{k: row[k] for k in [*keys, order]}, "epoch": s["epoch"]}]

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in [*keys, order]), "epoch bigint"])
    return ordered_fold(waiters.select(*keys, order, "at"), keys, [order], lambda: {"epoch": 0, "first": 0, "n": 0}, step, schema)


def epoch_metrics(epochs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per instance: epochs, waiters, largest, sizes 1, 2, 3-4, 5-8 and 9+, last epoch, frontier (last waiter)."""
    sizes = epochs.groupBy(*keys, "epoch").agg(F.count("*").alias("n"), F.max(order).alias("last"))
    n = F.col("n")
    return sizes.groupBy(*keys).agg(
        F.count("*").alias("epochs"), F.sum("n").alias("waiters"), F.max("n").alias("max_size"),
        F.count_if(n <= 1).alias("size_1"), F.count_if(n == 2).alias("size_2"), F.count_if(n.between(3, 4)).alias("size_3_4"),
        F.count_if(n.between(5, 8)).alias("size_5_8"), F.count_if(n >= 9).alias("size_9_plus"), F.max("epoch").alias("last_epoch"), F.max("last").alias("frontier"),
    )


def retry_streaks(syncs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, order, ok): successes right after 1, 2, 3 and 4 or more failures in a row."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    runs = syncs.withColumn("_run", F.coalesce(F.count_if("ok").over(so_far), F.lit(0)))
    ends = runs.groupBy(*keys, "_run").agg(F.count_if(~F.col("ok")).alias("failures"), F.max("ok").alias("recovered"))
    n = F.col("failures")
    won = F.col("recovered") & (n > 0)
    return ends.groupBy(*keys).agg(
        F.count_if(won).alias("retries_ok"), F.count_if(won & (n == 1)).alias("after_1"), F.count_if(won & (n == 2)).alias("after_2"),
        F.count_if(won & (n == 3)).alias("after_3"), F.count_if(won & (n >= 4)).alias("after_4_plus"),
    )


def latency_percentiles(commits: DataFrame, keys: list[str], latency: str = "latency", percentiles: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Per instance: count, nearest-rank percentiles as upper bounds of fixed buckets, exact maximum.

    Counts per bucket are aggregated in the tasks, so at most 17 rows per instance are shuffled by each.
    """
    bucket = F.lit(LATENCY_BOUNDS[-1])
    for bound in reversed(LATENCY_BOUNDS):
        bucket = F.when(F.col(latency) <= bound, bound).otherwise(bucket)
    # what exceeds the last bound is a bucket of its own, reported with the same value
    over = (F.col(latency) > LATENCY_BOUNDS[-1]).cast("int")
    counts = commits.groupBy(*keys, bucket.cast("long").alias("bound"), over.alias("over")).agg(F.count("*").alias("n"), F.max(latency).alias("most"))
    up_to = Window.partitionBy(*keys).orderBy("bound", "over").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"seen": F.sum("n").over(up_to), "total": F.sum("n").over(Window.partitionBy(*keys))})
    at = lambda p: F.min(F.when(F.col("seen") >= F.expr(f"(total * {p} + 99) div 100"), F.col("bound"))).alias(f"p{p}")
    return ranked.groupBy(*keys).agg(F.max("total").alias("count"), *[at(p) for p in percentiles], F.max("most").alias("max"))


def metrics_snapshot(log: DataFrame, syncs: DataFrame, epochs: DataFrame, retries: DataFrame, merges: DataFrame) -> DataFrame:
    """All 28 counters in one row.

    syncs: (ok, latency); epochs: rows of epoch_metrics(); retries: rows of retry_streaks(); merges: (bytes_read, bytes_written)
    of each run. Every part is aggregated to one row before it meets the others.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    entries = log.withColumn("size", entry_size())
    of_log = entries.agg(F.count("*").alias("entries_written"), total("size").alias("bytes_written"), (F.count_distinct("file_id") - 1).alias("rotations"))
    of_tx = metrics(log).select("commits", F.col("entries_committed").alias("recovery_entries"), F.col("commits").alias("recovery_committed_tx"))
    of_syncs = syncs.agg(F.count_if("ok").alias("syncs"), F.count_if(~F.col("ok")).alias("sync_errors"), total("latency").alias("total_sync_nanos"))
    of_merges = merges.agg(F.count("*").alias("merge_runs"), total("bytes_read").alias("merge_bytes_read"), total("bytes_written").alias("merge_bytes_written"))
    sizes = ["size_1", "size_2", "size_3_4", "size_5_8", "size_9_plus"]
    of_epochs = epochs.agg(
        total("epochs").alias("group_epochs"), total("waiters").alias("group_waiters"), F.max("max_size").alias("group_max_size"), F.max("last_epoch").alias("group_last_epoch"),
        *[total(c).alias(f"group_{c}") for c in sizes], F.max("frontier").alias("durable_frontier"),
    )
    after = ["after_1", "after_2", "after_3", "after_4_plus"]
    of_retries = retries.agg(total("failures").alias("durability_retries"), total("retries_ok").alias("durability_retry_ok"), *[total(c).alias(f"durability_retry_{c}") for c in after])
    return of_log.join(of_tx).join(of_syncs).join(of_merges).join(of_epochs).join(of_retries)  # one row each


def metrics(log: DataFrame) -> DataFrame:
    """Counters of a log in one pass: entries, commits, partial transactions, puts, deletes, bytes."""
    by_tx = log.groupBy("tx_id").agg(F.count("*").alias("n"), F.max("status").alias("marked"), F.count_if(F.col("flag") == 0).alias("deletes"), F.sum(F.octet_length("value")).alias("bytes"))
    done = F.col("marked") == 1
    return by_tx.agg(
        F.count_if(done).alias("commits"), F.count_if(~done).alias("partial_transactions"), F.sum("n").alias("entries_written"),
        F.sum(F.when(done, F.col("n")).otherwise(0)).alias("entries_committed"), F.sum("deletes").alias("deletes"), F.sum("bytes").alias("value_bytes"),
    )
