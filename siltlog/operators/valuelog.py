"""Separation of keys and values: the value log, its statistics, garbage collection and placement policies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltlog.functions.expr import byte_length, is_visible, ratio
from siltlog.functions.fold import ordered_fold
from siltlog.sources.log import NOW, POINTER


def rotate(entries: DataFrame, keys: list[str], order: str, limit: int, size: str = "size", value_log: bool = False) -> DataFrame:
    """Greedy segments per instance: (keys, order, size, segment, offset).

    Data files take no entry over the limit (its segment and offset are null, it is rejected); a value log takes
    one in a segment of its own, and never rotates with limit 0.
    """
    kinds = dict(entries.dtypes)

    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        n, out = row[size], {**{k: row[k] for k in [*keys, order]}, "size": row[size]}
        if not value_log and n > limit:
            return s, [out | {"segment": None, "offset": None}]
        if s["used"] + n > limit and (not value_log or (limit > 0 and s["used"] > 0)):
            s |= {"segment": s["segment"] + 1, "used": 0}
        out |= {"segment": s["segment"], "offset": s["used"]}
        s["used"] += n
        return s, [out]

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in [*keys, order]), "size bigint", "segment bigint", "offset bigint"])
    return ordered_fold(entries.select(*keys, order, size), keys, [order], lambda: {"segment": 0, "used": 0}, step, schema)


def separates(threshold: int, value: str = "value"):
    """Values of at least threshold bytes leave the log; threshold 0 separates all."""
    return byte_length(value) >= threshold


def resolve(pointers: DataFrame, values: DataFrame, on: list[str]) -> DataFrame:
    """Pointers (on, size, ...) with the stored value; one to nothing, or of another size, has a null value."""
    stored = values.select(*on, F.col("value").alias("_stored"))
    fits = F.octet_length("_stored") == F.col("size")
    return pointers.join(stored, on, "left").withColumn("value", F.when(fits, F.col("_stored"))).drop("_stored")


def segment_stats(appended: DataFrame, pointers: DataFrame, keys: list[str]) -> DataFrame:
    """Per segment: total, live and stale bytes; the last one of an instance is active."""
    total = appended.groupBy(*keys, "segment").agg(F.sum("size").alias("total_bytes"))
    alive = pointers.groupBy(*keys, "segment").agg(F.sum("size").alias("_live"))
    joined = total.join(alive, [*keys, "segment"], "left")
    live = F.coalesce("_live", F.lit(0))
    active = F.col("segment") == F.max("segment").over(Window.partitionBy(*keys))
    return joined.select(*keys, "segment", "total_bytes", live.alias("live_bytes"), F.greatest(F.lit(0), F.col("total_bytes") - live).cast("long").alias("stale_bytes"), active.alias("active"))


def gc_candidate(stats: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Per instance the segment, not the active one, with the highest stale ratio of at least `least`."""
    ranked = stats.where(~F.col("active")).withColumn("stale_ratio", ratio("stale_bytes", "total_bytes")).where(F.col("stale_ratio") >= least)
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("stale_ratio"), "segment"))
    return ranked.withColumn("_nth", best).where("_nth = 1").select(*keys, "segment", "stale_ratio")


def gc_plan(candidates: DataFrame, stats: DataFrame, pointers: DataFrame, keys: list[str]) -> DataFrame:
    """What collecting each candidate copies and reclaims."""
    copied = pointers.join(candidates.select(*keys, "segment"), [*keys, "segment"]).groupBy(*keys, "segment").agg(F.count("*").alias("copied_values"), F.sum("size").alias("copied_bytes"))
    joined = candidates.select(*keys, "segment").join(stats.select(*keys, "segment", "total_bytes"), [*keys, "segment"]).join(copied, [*keys, "segment"], "left")
    n, b = F.coalesce("copied_values", F.lit(0)), F.coalesce("copied_bytes", F.lit(0))
    return joined.select(*keys, "segment", n.alias("copied_values"), b.alias("copied_bytes"), F.col("total_bytes").alias("reclaimed_bytes"), (F.col("total_bytes") - b).alias("net_bytes"))


def live_pointers(indexed: DataFrame, now: int = NOW) -> DataFrame:
    return indexed.where((F.col("ds") == POINTER) & is_visible(now))


@dataclass(frozen=True)
class Lifecycle:
    """Fixed defaults of the placement policies: bytes, operations and windows."""

    threshold: int = 1024
    min_observations: int = 4
    hot_reads: int = 8
    frequent_updates: int = 4
    cold_age: int = 8
    cold_value: int = 64 * 1024
    stable: int = 2


def core_decisions(ops: DataFrame, keys: list[str], order: str, policy: Lifecycle = Lifecycle()) -> DataFrame:
    """For each put of (keys, order, kind, size): running reads and updates, and where its value goes."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = ops.withColumns({"reads": F.count_if(F.col("kind") == "get").over(so_far), "updates": F.count_if(F.col("kind") == "put").over(so_far)}).where("kind = 'put'")
    young = F.col("reads") + F.col("updates") < policy.min_observations
    inline = (F.col("size") < policy.threshold) | (~young & ((F.col("reads") >= policy.hot_reads) | (F.col("updates") >= policy.frequent_updates)))
    return counted.select(*keys, order, "size", "reads", "updates", young.alias("fallback"), F.when(inline, "inline").otherwise("value-log").alias("placement"))


def placement_metrics(decisions: DataFrame) -> DataFrame:
    """Decisions by placement; a fallback counts as a decision too."""
    return decisions.agg(F.count_if(F.col("placement") == "inline").alias("inline_decisions"), F.count_if(F.col("placement") == "value-log").alias("value_log_decisions"), F.count_if("fallback").alias("threshold_fallbacks"))


def classify(obs: DataFrame, policy: Lifecycle = Lifecycle()) -> DataFrame:
    """obs (size, reads, updates, age, overwrite_window) with placement and reason."""
    young = F.col("reads") + F.col("updates") < policy.min_observations
    small = F.col("size") < policy.threshold
    changing = (F.col("updates") >= policy.frequent_updates) | F.col("overwrite_window").between(1, 2)
    hot = F.col("reads") >= policy.hot_reads
    cold = (F.col("size") >= policy.cold_value) & (F.col("age") >= policy.cold_age)
    return obs.withColumns(
        {
            "placement": F.when(small | (~young & (changing | hot)), "inline").when(~young & cold, "cold-tier").otherwise("value-log"),
            "reason": F.when(young, "insufficient history; size threshold fallback")
            .when(small, "small value avoids pointer fixed cost")
            .when(changing, "frequent updates avoid value-log garbage")
            .when(hot, "hot reads avoid value-log indirection")
            .when(cold, "large old value is a cold-tier candidate")
            .otherwise("large stable value reduces main-log rewrite bytes"),
        }
    )


def settle(classified: DataFrame, keys: list[str], order: str, policy: Lifecycle = Lifecycle()) -> DataFrame:
    """Placement with hysteresis: the first is adopted at once, another after it held for `stable` observations."""
    kinds = dict(classified.dtypes)

    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        wish, changed = row["placement"], False
        if s["now"] is None:
            s["now"], changed = wish, True
        elif wish == s["now"]:
            s |= {"wish": None, "held": 0}
        else:
            s["held"] = s["held"] + 1 if wish == s["wish"] else 1
            s["wish"] = wish
            if s["held"] >= policy.stable:
                s |= {"now": wish, "wish": None, "held": 0}
                changed = True
        return s, [{**{k: row[k] for k in [*keys, order]}, "placement": s["now"], "reason": row["reason"], "changed": changed}]

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in [*keys, order]), "placement string", "reason string", "changed boolean"])
    return ordered_fold(classified.select(*keys, order, "placement", "reason"), keys, [order], lambda: {"now": None, "wish": None, "held": 0}, step, schema)


def manifest_recovery(manifests: DataFrame) -> DataFrame:
    """(version, phase, pointers, replacements) with what an open does about an interrupted collection."""
    none, moving = F.col("pointers") == 0, F.col("phase").isin("prepared", "pointers-installed")
    action = (
        F.when(F.col("version") == 1, F.when(none, "remove-source").otherwise("retain-source"))
        .when(moving & ~none, "retain-source")
        .when(moving & (F.col("replacements") > 0), "remove-source")
        .when(moving, "error")
        .when(F.col("phase") == "source-removed", "remove-source")
        .when(F.col("phase") == "finalized", "clear-manifest")
        .otherwise("error")
    )
    return manifests.withColumn("action", action)


#: The name of a value log's first segment, and the pattern of the others, which have a number of 20 digits.
FIRST_SEGMENT, NUMBERED_SEGMENT = "values.vlog", r"^values-(\d{20})\.vlog$"


def segment_ids(names: DataFrame, name: str = "name") -> DataFrame:
    """File names to (name, segment); other files are left out."""
    number = F.regexp_extract(name, NUMBERED_SEGMENT, 1)
    segment = F.when(F.col(name) == FIRST_SEGMENT, F.lit(0).cast("long")).when(number != "", number.cast("long"))
    return names.select(name, segment.alias("segment")).where("segment IS NOT NULL")


def read_values(blobs: DataFrame, pointers: DataFrame, on: list[str]) -> DataFrame:
    """Pointers (on, offset, size, crc) into segments kept as one blob each (on, blob): value and status.

    Out of bounds, or a checksum that differs, gives a null value and says so.
    """
    joined = pointers.join(blobs, on, "left")
    inside = (F.col("offset") >= 0) & (F.col("offset") + F.col("size") <= F.octet_length("blob"))
    value = F.substring(F.col("blob"), (F.col("offset") + 1).cast("int"), F.col("size").cast("int"))
    status = F.when(F.col("blob").isNull(), "no segment").when(~inside, "out of bounds").when(F.crc32(value) != F.col("crc"), "checksum differs").otherwise("ok")
    return joined.withColumn("status", status).withColumn("value", F.when(F.col("status") == "ok", value)).drop("blob")
