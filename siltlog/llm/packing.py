"""Packing of documents into as few sequences as possible, by a grouping genetic algorithm.

Pieces of equal length are interchangeable, so a packing is a table of bin patterns with multiplicities, and
its size depends on the number of distinct lengths (at most the sequence length), not on the number of
documents: each step of a best-fit over a histogram uses up either a length or a class of equal bins, which
leaves at most three classes per length. The genetic algorithm works on these tables. Crossover injects whole
well-filled bins of one parent into the other, removes the bins that now hold a piece twice, and puts the
pieces that lost their bin back by best fit. Populations evolve as islands, one task each, and after each epoch
every island takes the best packing of its neighbour. Islands end early when the number of bins equals the lower
bound given by the total length, which a first member may already do.

Pieces get their places without a global sort: a piece's rank among those of its length is its rank within its
task plus the number in earlier tasks, and a pattern covers an interval of ranks of each length.
"""

from __future__ import annotations

import bisect
import json
import random
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import table, written
from .tokens import encode, vocabulary

ISLANDS, MEMBERS, EPOCHS, CROSSOVERS = 6, 4, 3, 20
#: A bin is well filled, and may be injected, from this share of the sequence length on.
WELL_FILLED = 0.999
#: Rows (task, length, number of pieces before the task) that are sent to all tasks; more are joined by a sorted merge.
SENT_BASES = 100_000

#: A packing: classes of equal bins, (piece lengths in descending order, number of such bins).
Packing = list[tuple[tuple[int, ...], int]]


def best_fit(lengths: dict[int, int], size: int, order: list[int] | None = None, opened: Packing = ()) -> Packing:
    """Puts count pieces of each length, by default the longest first, each into the fullest bin that takes it."""
    free: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for pattern, n in opened:
        free[size - sum(pattern)].append((pattern, n))
    rooms = sorted(free)
    for length in order or sorted(lengths, reverse=True):
        left = lengths.get(length, 0)
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                room, pattern, n = size, (), left
            else:
                room = rooms[at]
                pattern, n = free[room].pop()
                if not free[room]:
                    del free[room], rooms[at]
            each = min(room // length, left)
            used = min(n, left // each)
            left -= used * each
            after = room - each * length
            if after not in free:
                bisect.insort(rooms, after)
            free[after].append((pattern + (length,) * each, used))
            if pattern and used < n:
                if room not in free:
                    bisect.insort(rooms, room)
                free[room].append((pattern, n - used))
    merged: Counter = Counter()
    for classes in free.values():
        for pattern, n in classes:
            merged[tuple(sorted(pattern, reverse=True))] += n
    return sorted(merged.items(), reverse=True)


def bins(packing: Packing) -> int:
    return sum(n for _, n in packing)


def fitness(packing: Packing, size: int) -> tuple[int, float]:
    """Smaller is better: bins, then how unevenly they are filled (full bins beside empty ones leave most room)."""
    return bins(packing), -sum(n * (sum(p) / size) ** 2 for p, n in packing)


def crossover(mother: Packing, father: Packing, lengths: dict[int, int], size: int, rnd: random.Random) -> Packing:
    left, child = dict(lengths), []

    def take(pattern: tuple[int, ...], most: int) -> None:
        need = Counter(pattern)
        n = min(most, *(left[k] // c for k, c in need.items()))
        if n > 0:
            child.append((pattern, n))
            for k, c in need.items():
                left[k] -= n * c

    for pattern, n in father:  # whole groups, injected
        if sum(pattern) >= WELL_FILLED * size and rnd.random() < 0.5:
            take(pattern, n)
    for pattern, n in sorted(mother, key=lambda x: -sum(x[0])):  # bins with a piece that is already placed go
        if sum(pattern) >= WELL_FILLED * size or rnd.random() < 0.7:
            take(pattern, n)
    return best_fit({k: n for k, n in left.items() if n}, size, opened=child)


def seeded(lengths: dict[int, int], size: int, rnd: random.Random, plain: bool) -> Packing:
    """A first member: best fit over descending lengths, or over an order disturbed at random."""
    if plain:
        return best_fit(lengths, size)
    order = sorted(lengths, key=lambda k: -k * rnd.uniform(0.8, 1.0))
    return best_fit(lengths, size, order)


def evolve(population: list[Packing], lengths: dict[int, int], size: int, rnd: random.Random) -> list[Packing]:
    bound = -(-sum(k * n for k, n in lengths.items()) // size)
    for _ in range(CROSSOVERS):
        population.sort(key=lambda p: fitness(p, size))
        if bins(population[0]) <= bound:
            break
        mother, father = rnd.choice(population[:2]), rnd.choice(population)
        population[-1:] = [min(population[-1], crossover(mother, father, lengths, size, rnd), key=lambda p: fitness(p, size))]
    return sorted(population, key=lambda p: fitness(p, size))


def search(spark: SparkSession, lengths: dict[int, int], size: int, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = 0) -> Packing:
    """The best packing of a histogram that the islands find. Same input, same result."""
    bound = -(-sum(k * n for k, n in lengths.items()) // size)
    schema = "island long, member long, bins long, fitness double, genome string"

    def rows(island: int, population: list[Packing]) -> list[tuple]:
        return [(island, k, *fitness(p, size), json.dumps(p)) for k, p in enumerate(population)]

    def settle(batches: Iterator) -> Iterator:
        for batch in batches:
            for island in batch["island"]:
                rnd = random.Random(f"{seed}-{island}")
                yield frame(rows(int(island), evolve([seeded(lengths, size, rnd, not k) for k in range(MEMBERS)], lengths, size, rnd)))

    def frame(got: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(got, columns=["island", "member", "bins", "fitness", "genome"])

    def epoch(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            members = pd.concat(list(batches) or [frame([])])  # MEMBERS + 1 rows of each island in the task
            for island, rest in members.groupby("island"):
                rnd = random.Random(f"{seed}-{number}-{island}")
                population = [[(tuple(p), n) for p, n in json.loads(g)] for g in rest.sort_values(["bins", "fitness", "member"])["genome"]]
                yield frame(rows(int(island), evolve(population[:MEMBERS], lengths, size, rnd)))

        return run

    # dealt by the island's number, so that adaptive execution leaves each island its task
    def alone(df: DataFrame) -> DataFrame:
        return df.repartitionById(islands, F.col("island").cast("int"))

    state = written(alone(spark.range(islands).select(F.col("id").alias("island"))).mapInPandas(settle, schema), "islands")
    for number in range(epochs):
        best = state.select("bins").agg(F.min("bins")).first()[0]
        if best <= bound:
            break
        elite = state.where("member = 0").select(((F.col("island") + 1) % islands).alias("island"), F.lit(MEMBERS).cast("long").alias("member"), "bins", "fitness", "genome")
        state = written(alone(state.unionByName(elite)).mapInPandas(epoch(number), schema), "islands")
    top = state.orderBy("bins", "fitness", "island", "member").select("genome").first()
    return [(tuple(p), n) for p, n in json.loads(top[0])]


def cut(docs: DataFrame, path: str, size: int, id_col: str, text_col: str) -> DataFrame:
    """Token ids of each document, then id 0, cut into pieces of `size`; only the first may be shorter.

    Rows (id, piece, start, length, ids_crc32, part, rank): rank counts the pieces of a length within a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(path, text.as_py() or ""), 0).astype("<u4")
                edges = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    out.append((key, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), part, seen[b - a]))
                    seen[b - a] += 1
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(columns)], names=["id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, part long, rank long")


def places(packing: Packing, size: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: from which rank on, pieces per bin, first sequence and first offset of each pattern."""
    out, taken, sequence = defaultdict(list), Counter(), 0
    for pattern, n in packing:
        offset = 0
        for length, each in sorted(Counter(pattern).items(), reverse=True):
            out[length].append((taken[length], each, sequence, offset))
            taken[length] += n * each
            offset += length * each
        sequence += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in out.items()}


def pack(docs: DataFrame, path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a document of the separator alone. Long texts are cut, and runs of a million characters
    of white space or of one letter are encoded like any other. Repeated rows are packed as often as they occur; pieces
    of equal length may change places. An empty table gives an empty result. Other columns aren't read.
    """
    spark = docs.sparkSession
    pieces = written(cut(docs, path, size, id_col, text_col), "pieces")
    counted = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counted = written(counted, "piece-counts")
    lengths = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    where = places(search(spark, dict(sorted(lengths.items())), size, **how), size)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("at").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for k in np.unique(length):
                mine = np.flatnonzero(length == k)
                base, each, first, start = where[int(k)]
                at = np.searchsorted(base, rank[mine], "right") - 1
                nth = rank[mine] - base[at]
                sequence[mine] = first[at] + nth // each[at]
                offset[mine] = start[at] + nth % each[at] * k
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    bases = F.broadcast(bases) if counted.count() <= SENT_BASES else bases.hint("merge")
    at = pieces.join(bases, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("at"))
    return at.mapInArrow(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places, as pack() gives them, with doc_id; nulls, long texts, repeated rows,
    an empty table and other columns as there."""
    return pack(docs, vocabulary("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")
