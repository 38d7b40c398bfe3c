"""Compaction: which segments to rewrite, how much at once, what survives, and the controller of the budget."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltlog.functions.expr import clamp01, clamp_budget, garbage_ratio, is_expired, positive_ratio, ratio
from siltlog.functions.fold import ordered_fold
from siltlog.operators.snapshot import BY_KEY, ORDER, committed_log, without_deleted_buckets
from siltlog.operators.stats import sized
from siltlog.sources.log import BUCKET_DELETE, DELETE, MARKER, NOW


def by_file_id(segs: DataFrame) -> DataFrame:
    return segs.select("file_id").orderBy("file_id")


def _best(segs: DataFrame, score: Column, least: float) -> DataFrame:
    """The segment with the highest score of those whose ratio reaches least; of equal ones the lowest file."""
    return segs.where(garbage_ratio() >= least).withColumn("score", score).orderBy(F.desc("score"), "file_id").limit(1).select("file_id", "score")


def by_garbage(segs: DataFrame, least: float) -> DataFrame:
    return _best(segs, garbage_ratio(), least)


def by_heat(segs: DataFrame, least: float, hot_reads: int) -> DataFrame:
    """Like by_garbage, but the score of a segment read more than hot_reads times is halved."""
    return _best(segs, garbage_ratio() * F.when(F.col("read_count") > hot_reads, 0.5).otherwise(1.0), least)


def or_all(picked: DataFrame, segs: DataFrame) -> DataFrame:
    """What a merge takes: the picked segment, or all if none qualifies."""
    some = picked.select(F.count("*").alias("_n"))
    fallback = segs.select("file_id").join(some).where("_n = 0").select("file_id")  # one row on the right
    return picked.select("file_id").unionByName(fallback)


def within_budget(segs: DataFrame, budget: int, keys: list[str] | None = None, order: str = "file_id") -> DataFrame:
    """First fit in order: a segment is taken if it still fits, else passed over, and the search goes on."""
    keys = keys or ["_all"]
    rows = segs if "_all" not in keys else segs.withColumn("_all", F.lit(0))
    kinds = dict(rows.dtypes)

    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        if row["size"] > 0 and state["used"] + row["size"] <= budget:
            state["used"] += row["size"]
            return state, [{**{k: row[k] for k in keys}, order: row[order], "size": row["size"], "used": state["used"]}]
        return state, []

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{order} {kinds[order]}", "size bigint", "used bigint"])
    out = ordered_fold(rows.select(*keys, order, "size"), keys, [order], lambda: {"used": 0}, step, schema)
    return out.drop("_all")


def survivors(log: DataFrame, sources: DataFrame, now: int = NOW) -> DataFrame:
    """Rows that a merge of the source files writes.

    Committed entries that are the last of their key survive unless deleted or expired. Those two are kept as well
    while an older committed entry of the key lies outside the sources: dropping them would bring that one back.
    Markers that delete a bucket stay, and what they delete goes. Of other files only keys and places are read.
    """
    files = sources.select("file_id").distinct()
    done = committed_log(log)
    entries = without_deleted_buckets(done)
    # one row per key and task: the last entry inside, the last place outside
    by_key = [F.col(k).alias(f"_{k}") for k in BY_KEY]
    last = entries.join(files, "file_id", "left_semi").groupBy(*by_key).agg(F.max_by(F.struct(*log.columns), F.struct(*ORDER)).alias("last"))
    outside = entries.join(files, "file_id", "left_anti").groupBy(*by_key).agg(F.max(F.struct(*ORDER)).alias("_outside"))
    last = last.join(outside, [f"_{k}" for k in BY_KEY], "left").select("last.*", "_outside")
    newest = F.col("_outside").isNull() | (F.col("_outside") < F.struct(*ORDER))
    dead = (F.col("flag") == DELETE) | is_expired(now)
    marks = done.where((F.col("ds") == MARKER) & (F.col("flag") == BUCKET_DELETE)).join(files, "file_id", "left_semi")
    return last.where(newest & (~dead | F.col("_outside").isNotNull())).select(log.columns).unionByName(marks.select(log.columns))


def merge_bytes(log: DataFrame, sources: DataFrame, now: int = NOW) -> DataFrame:
    """Bytes that a merge reads and writes."""
    read = sized(log.join(sources.select("file_id"), "file_id", "left_semi")).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_read"))
    wrote = sized(survivors(log, sources, now)).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_written"))
    return read.join(wrote)  # one row each


def renumbered(entries: DataFrame) -> DataFrame:
    """Positions that only keep the order of (file_id, pos): the number of a range of places, then the row within it. They
    don't grow with the number of merges that an entry has been through."""
    return entries.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("pos", F.monotonically_increasing_id())


def merged_files(log: DataFrame, sources: DataFrame, now: int = NOW) -> DataFrame:
    """What a merge writes. sources: (file_id, target); survivors of a file go to its target, in a committed transaction."""
    moved = renumbered(survivors(log, sources, now)).join(sources.select("file_id", "target").distinct(), "file_id")
    return moved.select(*[F.col("target").cast("long").alias(c) if c == "file_id" else F.lit(1).alias(c) if c == "status" else (-1 - F.col("target")).cast("long").alias(c) if c == "tx_id" else c for c in log.columns])


def late_marks(log: DataFrame, sources: DataFrame) -> DataFrame:
    """tx_id of transactions that have their marker in a source file and entries without one elsewhere."""
    files = sources.select("file_id").distinct()
    inside = log.where("status = 1").join(files, "file_id", "left_semi").select("tx_id").distinct()
    return inside.join(log.join(files, "file_id", "left_anti").where("status <> 1").select("tx_id"), "tx_id", "left_semi")


def with_marks(log: DataFrame, marks: DataFrame) -> DataFrame:
    """The log with a commit marker for each entry of the given transactions."""
    found = marks.select("tx_id", F.lit(1).alias("_marked")).distinct()
    return log.join(found, "tx_id", "left").withColumn("status", F.coalesce("_marked", "status")).select(log.columns)


def merged_log(log: DataFrame, sources: DataFrame, file_id: int, now: int = NOW) -> DataFrame:
    """The log after the merge: the other files, and the survivors in a new file in a committed transaction.

    Entries in other files whose transaction has its marker in a merged file get a marker of their own.
    """
    files = sources.select("file_id").distinct()
    rest = with_marks(log.join(files, "file_id", "left_anti"), late_marks(log, files))
    return rest.select(log.columns).unionByName(merged_files(log, files.withColumn("target", F.lit(file_id).cast("long")), now))


def run_targets(files: list[int], chosen: set[int]) -> list[tuple[int, int]]:
    """(file, target) for runs of chosen files, next to each other in the order of files: the target of a run is its newest
    file. A run of one file is left as it is."""
    out, run = [], []
    for file_id in [*sorted(files), None]:
        if file_id in chosen:
            run.append(file_id)
            continue
        if len(run) > 1:
            out += [(f, run[-1]) for f in run]
        run = []
    return out


def analyze_workload(ops: DataFrame, rewrite_bytes: int, physical_bytes: int) -> DataFrame:
    """(seq, kind, key, bytes): operations, bytes written, live and obsolete, and both amplifications."""
    puts = ops.where("kind = 'put'").groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("written"), F.max_by("bytes", "seq").alias("latest"))
    sums = puts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("writes"), F.coalesce(F.sum("written"), F.lit(0)).alias("logical_bytes"), F.coalesce(F.sum("latest"), F.lit(0)).alias("live_bytes"))
    total = ops.agg(F.count("*").alias("operations"), F.count_if(F.col("kind") == "get").alias("reads"))
    return total.join(sums).select(  # one row each
        "operations", "writes", "reads", "logical_bytes", "live_bytes", (F.col("logical_bytes") - F.col("live_bytes")).alias("obsolete_bytes"),
        ratio(F.col("logical_bytes") + rewrite_bytes, "logical_bytes").alias("write_amp"), ratio(F.lit(physical_bytes), "live_bytes").alias("space_amp"),
    )


@dataclass(frozen=True)
class ControllerConfig:
    """Fixed defaults of the compaction controller, in bytes, ratios and windows."""

    min_garbage: int = 64 * 1024 * 1024
    emergency_space_amp: float = 2.0
    high_write_amp: float = 3.0
    base_budget: int = 16 * 1024 * 1024
    max_budget: int = 256 * 1024 * 1024
    stable_windows: int = 2
    cooldown_windows: int = 2


def overridden(options: DataFrame, config: ControllerConfig = ControllerConfig()) -> DataFrame:
    """Rows of options, of which any may be missing or null, as the controller takes them: only values over 0 replace a default."""
    columns = [F.col(f.name) if f.name in options.columns else F.lit(None) for f in fields(config)]
    rest = [c for c in options.columns if c not in {f.name for f in fields(config)}]
    return options.select(*rest, *[F.when(c > 0, c).otherwise(getattr(config, f.name)).cast("double" if f.type == "float" else "long").alias(f.name) for f, c in zip(fields(config), columns, strict=True)])


def evaluate(obs: DataFrame, config: ControllerConfig = ControllerConfig()) -> DataFrame:
    """obs (p99, target, garbage, data, write_amp, space_amp, phase) with budget, picker, reason and confidence."""
    heap = positive_ratio("garbage", "data")
    emergency = F.col("space_amp") >= config.emergency_space_amp
    slow = (F.col("target") > 0) & (F.col("p99") > F.col("target"))
    little = F.col("garbage") < config.min_garbage
    rewriting = F.col("write_amp") >= config.high_write_amp
    base = F.lit(config.base_budget) * F.when(heap >= 0.5, 2).otherwise(1)
    usual = F.when(F.col("phase") == "write-heavy", F.floor(base / 2)).otherwise(base)
    picker = F.when(F.col("phase") == "read-heavy", "hot-cold").when(F.col("phase") == "overwrite-heavy", "garbage-ratio").otherwise("file-id")
    budget = F.when(emergency, config.base_budget * 2).when(slow | little, 0).when(rewriting, config.base_budget // 2).otherwise(usual)
    return obs.withColumns(
        {
            "budget": clamp_budget(budget, max(config.max_budget, config.base_budget)),
            "picker": F.when(emergency, "garbage-ratio").otherwise(picker),
            "reason": F.when(emergency, "emergency space amplification")
            .when(slow, "foreground p99 exceeds target")
            .when(little, "garbage below minimum work threshold")
            .when(rewriting, "high write amplification limits rewrite budget")
            .otherwise("garbage pressure within latency budget"),
            "confidence": F.when(emergency, clamp01(F.col("space_amp") / config.emergency_space_amp / 2))
            .when(slow, clamp01(positive_ratio("p99", "target") / 2))
            .when(little, clamp01(1 - heap))
            .when(rewriting, clamp01(F.col("write_amp") / config.high_write_amp / 2))
            .otherwise(clamp01(heap + 0.25)),
        }
    )


def observe(evaluated: DataFrame, keys: list[str], order: str, config: ControllerConfig = ControllerConfig()) -> DataFrame:
    """The controller with hysteresis: a decision that differs must hold for stable windows, and after the cooldown,
    before it takes effect, and the budget then moves by at most one base budget."""
    kinds = dict(evaluated.dtypes)

    def start() -> dict:
        return {"now": (0, "file-id"), "reason": None, "confidence": None, "wish": None, "held": 0, "window": 0, "changed_at": 0}

    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        s["window"] += 1
        wish, changed = (row["budget"], row["picker"]), False
        if wish == s["now"]:
            s |= {"wish": None, "held": 0, "reason": row["reason"], "confidence": row["confidence"]}
        else:
            s["held"] = s["held"] + 1 if wish == s["wish"] else 1
            s["wish"] = wish
            rested = not s["changed_at"] or s["window"] - s["changed_at"] >= config.cooldown_windows
            if s["held"] >= config.stable_windows and rested:
                budget = max(s["now"][0] - config.base_budget, min(s["now"][0] + config.base_budget, wish[0]))
                s |= {"now": (budget, wish[1]), "reason": row["reason"], "confidence": row["confidence"], "wish": None, "held": 0, "changed_at": s["window"]}
                changed = True
        return s, [{**{k: row[k] for k in [*keys, order]}, "budget": s["now"][0], "picker": s["now"][1], "reason": s["reason"], "confidence": s["confidence"], "changed": changed}]

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in [*keys, order]), "budget bigint", "picker string", "reason string", "confidence double", "changed boolean"])
    return ordered_fold(evaluated.select(*keys, order, "budget", "picker", "reason", "confidence"), keys, [order], start, step, schema)


def last_events(events: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """A bounded audit ring: the last `size` events of each instance, with a running number."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    left = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return events.withColumns({"sequence": number.cast("long"), "_left": left}).where(F.col("_left") <= size).drop("_left")


#: Phases of the detector that the controller tells apart; any other counts as unknown to it.
CONTROLLED_PHASES = ["write-heavy", "read-heavy", "overwrite-heavy", "mixed"]


def recommend(observed: DataFrame, latency: DataFrame, phase: DataFrame, target: int, config: ControllerConfig = ControllerConfig()) -> DataFrame:
    """What the controller says of one observation of the log, the commit latency's p99 and the newest phase: one row.

    available is false for an empty log, whose recommendation has no budget.
    """
    passed = F.when(F.col("phase").isin(CONTROLLED_PHASES), F.col("phase")).otherwise("unknown").alias("phase")
    obs = observed.join(latency.select("p99")).join(phase.select(passed))  # one row each
    obs = obs.withColumns({"target": F.lit(target).cast("long"), "garbage": F.col("obsolete_bytes"), "data": F.col("logical_bytes"), "available": F.col("logical_bytes") > 0})
    out = evaluate(obs, config)
    return out.select("available", F.when(F.col("available"), F.col("budget")).otherwise(0).alias("budget"), "picker", "reason", "confidence", "phase", "p99")
