"""Near-duplicate documents by SimHash: fingerprints, pigeonhole blocks, Hamming verification, components.

Equal fingerprints are collapsed first (a group of copies is one row from there on). A fingerprint is cut
into BLOCKS blocks; two that differ in at most `distance` bits agree on at least BLOCKS - distance of them, so
each fingerprint takes one key for every choice of that many blocks, and close pairs share a key. Within the
rows of one key the Hamming distances are verified, and only links that join parts not yet joined there are
returned: as many as rows at most, never all pairs, and the components are the same. A key with more than
`bucket_rows` fingerprints is cut again by the pigeonhole principle over its remaining bits, until its
parts are small; distinct fingerprints with b free bits are at most 2**b, so this ends. No candidate is dropped.
A dense group needs about one comparison per row, as the search drops the rows that it has reached.

The pipeline's stage links texts whose sets of five-word shingles have a Jaccard similarity of SIMILARITY or more
(similar_groups). Fingerprints of such texts differ in more bits than 64 bits have blocks for, so the stage's have WORDS times
64 bits, of which the first 64 are the fingerprint above. They are dealt by some of their bits, once for each of tables_for
tables; a task cuts its rows again by more of their bits and verifies the Hamming distance of rows that agree (close_nodes).
Components of these links are then verified exactly, each in a task. One of more than KEY_ROWS texts is dealt over tasks
(hot_links): all its texts are compared with a few pivots, which joins the dense ones; then, if at most KEY_ROWS stand outside
the largest component, those are compared with all, else it is cut by keys of minhashes, which only deal out this exact check.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import filter_bits, one_row_each, passes, table, without, written
from .components import components

#: Bits of a fingerprint, and into how many blocks it is cut for the first keys.
BITS, BLOCKS = 64, 6
#: Fingerprints of one key that a task compares (8 bytes each); more are cut into smaller keys.
BUCKET_ROWS = 5000
SEED = 42
#: The stage: words of a shingle, least similarity of near copies.
STAGE_WORDS, SIMILARITY = 5, 0.8
#: Longs of the stage's fingerprints, and the share of bits in which similar texts agree where it is least (4 and 5 shingles).
WORDS, AGREE = 4, 0.8125
#: Bits in which fingerprints of similar texts may differ, if the smaller set has less than FEW shingles and else: five deviations
#: more than the mean, in simulation; in the first 64 bits WIDE.
FEW, FAR, NEAR, WIDE = 20, 80, 70, 28
#: Tables: how often a task finds two texts that share its bits, how often no table finds them (both where AGREE holds); rows
#: that share a table's bits, about; least number of such bits.
HIT, MISS, TASK_ROWS, TASK_BITS = 0.9, 1e-7, 1 << 20, 4
#: Rows of a task that agree in its own bits, about; more than MOST are compared by a search that drops what it has reached.
RUN, MOST = 16, 64
#: Texts of a component whose sets of shingles a task compares with each other; pivots of a larger one.
KEY_ROWS, PIVOTS = 500, 4
#: Keys of minhashes that cut a large component, and rows of each: at similarity 0.8 two texts share no key once in 300,000
#: pairs (1 - 0.8**4) ** 24. Finer ones: (1 - 0.8**8) ** 69 is (1 - 0.8**4) ** 24.
BANDS, BAND_ROWS = 24, 4
FINE_BANDS, FINE_ROWS = 72, 8
_SET = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of a whole text; a text of fewer words is one shingle."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    h = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([h(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(parts) - words + 1].tolist()
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Per bit, 1 if set in over half of the hashes."""
    raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(raw[:, k], minlength=256) @ _SET for k in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words: int) -> int:
    """The SimHash of a whole text: per bit, 1 if set in over half of the shingles' XXH64. No words: 0."""
    return majority(shingles(text, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(id, fp, text_hash): one row per document, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64), pa.int64()), batch.column(1)], names=["id", "fp", "text_hash"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col))
    return rows.mapInArrow(run, "id long, fp long, text_hash long")


def text_hash(text: Column) -> Column:
    """Tells apart rows that share an identifier."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def blocks_of(bits: list[int], n: int) -> list[list[int]]:
    """bits cut into n runs of nearly equal length."""
    cuts = [round(k * len(bits) / n) for k in range(n + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _keys(rows: DataFrame, masks: list[int]) -> DataFrame:
    """Each fingerprint with the part of its bits under each mask; mask holds all bits that are fixed so far."""
    return rows.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))).withColumn("key", F.expr("fp & mask"))


def spanning_links(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what chains of close fingerprints connect: a breadth-first search over the rows not
    yet reached, so a dense group costs little more than one comparison per row."""
    left = np.unique(fps).view(np.uint64)
    a, b = [], []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            close = np.bitwise_count(left ^ at) <= distance
            if close.any():
                reached = left[close]
                a.append(np.full(len(reached), at))
                b.append(reached)
                frontier.extend(reached)
                left = left[~close]
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)


def _starts(rows: np.ndarray) -> np.ndarray:
    """Where the rows of a (mask, key) begin."""
    if not rows.shape[1]:
        return np.empty(0, np.int64)
    new = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _links_of(fps: np.ndarray, starts: np.ndarray, distance: int) -> pa.RecordBatch:
    """spanning_links of each run of rows; runs of two, by far the most, all at once."""
    ends = np.append(starts, len(fps))[1:]
    two = starts[ends - starts == 2]
    close = np.bitwise_count((fps[two] ^ fps[two + 1]).view(np.uint64)) <= distance
    a, b = [fps[two][close]], [fps[two + 1][close]]
    for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
        if end - start > 2:
            x, y = spanning_links(fps[start:end], distance)
            a.append(x)
            b.append(y)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])


def close_links(fps: DataFrame, distance: int, blocks: int = BLOCKS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) whose components are those of all pairs within distance."""
    if blocks <= distance:
        raise ValueError("more blocks than differing bits are needed")
    if bucket_rows < 1 << distance:
        raise ValueError("a bucket must hold the fingerprints that differ in `distance` given bits")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (mask, key, fp) with the rows of a key together; a key's rows may go on in the next batch."""
        left = np.empty((3, 0), np.int64)
        for batch in batches:
            rows = np.concatenate([left, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            starts = _starts(rows)
            if len(starts):
                yield _links_of(rows[2, : starts[-1]], starts[:-1], distance)
                left = rows[:, starts[-1] :]
        yield _links_of(left[2], np.zeros(min(1, left.shape[1]), np.int64), distance)

    spark = fps.sparkSession
    cut = blocks_of(list(range(BITS)), blocks)
    masks = [_signed(0, sum(chosen, [])) for chosen in combinations(cut, blocks - distance)]
    keyed, out = _keys(fps.select("fp"), masks), None
    while True:
        sizes = written(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
        small = keyed.join(sizes.where(F.col("n") <= bucket_rows).select("mask", "key"), ["mask", "key"], "left_semi")
        dealt = small.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key")
        found = dealt.mapInArrow(links, "a long, b long")
        hot = sizes.where(F.col("n") > bucket_rows).select("mask", "key")
        masks = [r.mask for r in hot.select("mask").distinct().collect()]  # as many as the blocks make, whatever the rows
        if not masks:
            return found if out is None else out.unionByName(found)
        found = written(found, "hot-links")
        out = found if out is None else out.unionByName(found)
        finer = [(m, _signed(m, x)) for m in masks for x in blocks_of([b for b in range(BITS) if not (m >> b) & 1], distance + 1)]
        rows = keyed.join(hot, ["mask", "key"], "left_semi").join(F.broadcast(spark.createDataFrame(finer, "mask long, finer long")), "mask")
        keyed = written(rows.select("fp", F.col("finer").alias("mask")).distinct().withColumn("key", F.expr("fp & mask")), "hot-keys")


def _signed(mask: int, bits: list[int]) -> int:
    m = (mask & ((1 << 64) - 1)) | sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, distance: int = 4, blocks: int = BLOCKS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per input row: id, fp (signed long), text_hash, root (a fingerprint of the component), component_id
    (smallest identifier reachable).

    Words are separated by the six ASCII white-space characters, A-Z is lower-cased, whole texts count. Null
    and empty texts have fingerprint 0 and link like any other; a text with fewer words than a shingle is one
    shingle. Null identifiers never name a component unless it has no other. Repeated rows and identifiers
    are rows like any other. An empty table gives an empty result. Other columns aren't read.
    """
    rows = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    linked = components(close_links(distinct, distance, blocks, bucket_rows))
    named = distinct.join(linked, distinct.fp == linked.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # written, so that the last join has plain shuffles on both sides and a fingerprint of many rows can be split
    of = written(named.join(least, "root").select("fp", "root", "component_id"), "roots")
    return rows.join(of, "fp", "left").select("id", "fp", "text_hash", "root", "component_id")


class Minhashes:
    """The keys of a set of shingles, as signed longs; an empty set has none. Each number gives functions of its own."""

    def __init__(self, bands: int, rows: int, number: int):
        self.bands, self.rows = bands, rows
        self.xor, self.times = np.random.default_rng([SEED, number]).integers(0, 1 << 64, (2, bands * rows, 1), np.uint64)
        self.times |= np.uint64(1)

    def __call__(self, distinct: np.ndarray) -> list[int]:
        if not len(distinct):
            return []
        least = np.concatenate([((distinct[k : k + 4096] ^ self.xor) * self.times).min(1)[:, None] for k in range(0, len(distinct), 4096)], axis=1).min(1)
        rows = least.astype("<u8").reshape(self.bands, self.rows)
        return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)], np.uint64).view(np.int64).tolist()


def wide_fingerprint(distinct: np.ndarray) -> np.ndarray:
    """WORDS signed longs: the majority of the shingles' hashes, and of as many mixtures of their bits. An empty set: 0."""
    ones = np.zeros(WORDS * 64, np.int64)
    for at in range(0, len(distinct), 4096):
        hashes = [distinct[at : at + 4096]]
        for k in range(1, WORDS):
            mixed = (hashes[0] ^ (hashes[0] >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            hashes.append(mixed ^ (mixed >> np.uint64(32)))
        ones += np.unpackbits(np.stack(hashes, axis=1).astype(">u8").view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(distinct)).view(">u8").astype(np.int64)


def tables_for(rows: int) -> tuple[int, int]:
    """Bits by which so many rows are dealt, and how many tables of so many bits keep to MISS."""
    bits = max(TASK_BITS, math.ceil(math.log2(max(1, rows) / TASK_ROWS)))
    return bits, math.ceil(math.log(MISS) / math.log(1 - HIT * AGREE**bits))


def table_parts(bits: int, tables: int) -> list[str]:
    """Per table an expression over w0, w1, ...: the table's number and, below it, `bits` bits of the fingerprint."""
    out = []
    for t in range(tables):
        word, at = t % WORDS, t // WORDS * bits
        turn = (at + at // 64) % 64
        out.append(f"{t << bits}L + ((shiftrightunsigned(w{word}, {turn}) | shiftleft(w{word}, {(64 - turn) % 64})) & {(1 << bits) - 1}L)")
    return out


def are_close(sizes: np.ndarray, words: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes can be similar and their fingerprints are as close as those of similar sets."""
    few, many = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    return (few >= similarity * many - 1e-9) & (np.bitwise_count(words[a] ^ words[b]).sum(-1) <= np.where(few < FEW, FAR, NEAR))


def close_nodes(sizes: np.ndarray, words: np.ndarray, table: int, similarity: float) -> tuple[list[int], list[int]]:
    """Links (positions) that connect rows of close fingerprints: at most one less than rows. Rows are compared if they agree
    in one of the table's keys of about log2(rows / RUN) bits, of which there are enough to find a pair with HIT."""
    n = len(sizes)
    of, a, b = np.arange(n), [], []

    def join(xs: np.ndarray, ys: np.ndarray) -> None:
        """Adds the links that join two of the groups in `of` (each row's group, by a row of it)."""
        nonlocal of
        for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
            p, q = x, y
            while of[p] != p:
                p = of[p]
            while of[q] != q:
                q = of[q]
            if p != q:
                of[max(p, q)] = min(p, q)
                a.append(x)
                b.append(y)
        while (of[of] != of).any():
            of = of[of]

    def search(rows: np.ndarray) -> None:
        """Compares rows with each other, as far as they aren't joined: those outside a group of over half of them with all,
        else breadth first, without the rows reached."""
        groups, times = np.unique(of[rows], return_counts=True)
        if len(groups) == 1:
            return
        main = groups[times.argmax()]
        if 2 * times.max() > len(rows):
            for at in rows[of[rows] != main]:
                other = rows[of[rows] != of[at]]
                reached = other[are_close(sizes, words, at, other, similarity)]
                join(np.full(len(reached), at), reached)
            return
        left = rows
        while len(left):
            frontier, left = [left[0]], left[1:]
            while frontier and len(left):
                at = frontier.pop()
                close = are_close(sizes, words, at, left, similarity)
                join(np.full(close.sum(), at), left[close])
                frontier.extend(left[close])
                left = left[~close]

    bits = max(0, math.ceil(math.log2(max(1, n) / RUN)))
    rng, low = np.random.default_rng([SEED, table]), bits // 2
    for _ in range(math.ceil(math.log(1 - HIT) / math.log(1 - AGREE**bits)) if bits else 1):
        i, j, s, t = (int(x) for x in rng.integers(0, [WORDS, WORDS - 1, 64, 64]))
        one, two = words[:, i], words[:, (i + 1 + j) % WORDS]
        one, two = (w >> np.uint64(r) | w << np.uint64(-r % 64) for w, r in ((one, s), (two, t)))
        key = (one & np.uint64((1 << low) - 1)) << np.uint64(bits - low) | two & np.uint64((1 << bits - low) - 1)
        both = np.sort(key << np.uint64(32) | np.arange(n, dtype=np.uint64))
        key, order = both >> np.uint64(32), (both & np.uint64((1 << 32) - 1)).astype(np.int64)
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        lengths = np.diff(np.append(starts, n))
        if lengths.max() > MOST:
            for k in np.flatnonzero(lengths > MOST).tolist():
                search(np.sort(order[starts[k] : starts[k] + lengths[k]]))
            short = np.repeat(lengths <= MOST, lengths)
            key, order = key[short], order[short]
        first = words[order, 0]
        for step in range(1, MOST):
            same = key[step:] == key[:-step]
            if not same.any():
                break
            at = np.flatnonzero(same & (np.bitwise_count(first[step:] ^ first[:-step]) <= WIDE))
            x, y = order[at], order[at + step]
            apart = of[x] != of[y]
            x, y = x[apart], y[apart]
            close = are_close(sizes, words, x, y, similarity)
            if close.any():
                join(x[close], y[close])
    return a, b


def wide_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """(node, n, w0, w1, ...) of distinct sets of n shingles to links (a, b) of close fingerprints, whose components hold
    together what similar sets connect."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (part, node, n, w0, ...) with the rows of a part together; a part's rows may go on in the next batch."""
        part, held = None, []

        def found() -> pa.RecordBatch:
            rows = np.concatenate(held)
            a, b = close_nodes(rows[:, 2], np.ascontiguousarray(rows[:, 3:]).view(np.uint64), part >> bits, similarity) if len(rows) > 1 else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(rows[a, 1] if a else [], pa.int64()), pa.array(rows[b, 1] if b else [], pa.int64())], names=["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            for piece in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1):
                if len(piece) and piece[0, 0] != part:
                    if held:
                        yield found()
                    part, held = int(piece[0, 0]), []
                held.append(piece)
        if held:
            yield found()

    bits, tables = tables_for(nodes.count())
    parts = F.array(*[F.expr(x) for x in table_parts(bits, tables)])
    rows = nodes.select(F.explode(parts).alias("part"), "node", "n", *[f"w{k}" for k in range(WORDS)])
    return rows.repartition("part").sortWithinPartitions("part", "node").mapInArrow(links, "a long, b long")


def node_of(distinct: np.ndarray) -> int:
    """One signed long per set of shingles (sorted)."""
    return int(np.uint64(xxhash.xxh64_intdigest(distinct.astype("<u8").tobytes(), SEED)).view(np.int64))


def similar_links(nodes: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links that connect what chains of similar sets connect, found as in spanning_links."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    parts = [token[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    marked = np.zeros(len(token), bool)
    left, a, b = np.arange(len(nodes)), [], []
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            maybe = np.minimum(sizes[left], sizes[at]) >= similarity * np.maximum(sizes[left], sizes[at]) - 1e-9
            maybe &= np.bitwise_count((fps[left] ^ fps[at]).view(np.uint64)) <= WIDE
            marked[parts[at]] = True
            for k in np.flatnonzero(maybe).tolist():
                both = int(marked[parts[left[k]]].sum())
                maybe[k] = both >= similarity * (sizes[at] + sizes[left[k]] - both) - 1e-9
            marked[parts[at]] = False
            reached = left[maybe]
            a += [int(nodes[at])] * len(reached)
            b += nodes[reached].tolist()
            frontier += reached.tolist()
            left = left[~maybe]
    return a, b


def are_similar(sets: list[np.ndarray], fps: np.ndarray, sizes: np.ndarray, one: np.ndarray, fp: int, similarity: float) -> list[int]:
    """Which of the sets are similar to one."""
    maybe = np.minimum(sizes, len(one)) >= similarity * np.maximum(sizes, len(one)) - 1e-9
    maybe &= np.bitwise_count((fps ^ fp).view(np.uint64)) <= WIDE
    out = []
    for k in np.flatnonzero(maybe).tolist():
        both = len(np.intersect1d(sets[k], one, assume_unique=True))
        if both >= similarity * (len(one) + sizes[k] - both) - 1e-9:
            out.append(k)
    return out


def key_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(key, node) to links (a, b) that connect the similar sets of each key. A key's sets stand in one task."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, node, fp, shingles) with the rows of a key together; a key's rows may go on in the next batch."""
        key, held = None, []

        def found() -> pa.RecordBatch:
            a, b = similar_links(np.array([r[0] for r in held]), np.array([r[1] for r in held]), [r[2] for r in held], similarity) if len(held) > 1 else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for own, node, fp, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    yield found()
                    key, held = own, []
                held.append((node, fp, np.frombuffer(raw, "<u8")))
        yield found()

    dealt = members.join(sets, "node").select("key", "node", "fp", "shingles").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(links, "a long, b long")


def pivot_links(members: DataFrame, pivots: DataFrame, sizes: DataFrame, sets: DataFrame, similarity: float, key_rows: int) -> DataFrame:
    """(key, node) and pivots (key, node) to links between each pivot and the similar members of its key. sizes has the
    number n of a key's members; these are dealt in parts of about key_rows, each with all pivots of the key."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, part, is_member, node, fp, shingles) in this order of the first three."""
        now, held = None, ([], [], [])
        arrays = (np.empty(0, np.int64),) * 2
        for batch in batches:
            a, b = [], []
            for key, part, is_member, node, fp, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, part) != now:
                    now, held, arrays = (key, part), ([], [], []), None
                one = np.frombuffer(raw, "<u8")
                if not is_member:
                    for x, y in zip(held, (node, fp, one), strict=True):
                        x.append(y)
                    continue
                if arrays is None:
                    arrays = np.array(held[1], np.int64), np.array([len(x) for x in held[2]], np.int64)
                for k in are_similar(held[2], *arrays, one, fp, similarity) if held[0] else ():
                    if held[0][k] != node:
                        a.append(held[0][k])
                        b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    parts = sizes.select("key", F.ceil(F.col("n") / key_rows).cast("long").alias("parts"))
    left = members.join(parts, "key").select("key", F.pmod(F.xxhash64("node"), "parts").alias("part"), F.lit(True).alias("is_member"), "node")
    right = pivots.join(parts, "key").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("is_member"), "node")
    rows = left.unionByName(right).join(sets, "node").select("key", "part", "is_member", "node", "fp", "shingles")
    return rows.repartition("key", "part").sortWithinPartitions("key", "part", "is_member").mapInArrow(compare, "a long, b long")


def shared_keys(keyed: DataFrame) -> DataFrame:
    """(key, node) to (key, n) of the keys that two nodes share; of keys that hold the same nodes one."""
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("all")).where("n > 1")
    return shared.groupBy("n", "least", "all").agg(F.min("key").alias("key")).select("key", "n")


def hot_links(members: DataFrame, sets: DataFrame, similarity: float, key_rows: int = KEY_ROWS) -> DataFrame:
    """Links of keys (key, node) of any size: key_links dealt over tasks. See the module's text."""
    found, level = None, 0
    while True:
        sizes = written(members.groupBy("key").agg(F.count("*").alias("n"), *[F.min_by("node", F.xxhash64("node", F.lit(level), F.lit(j))).alias(f"p{j}") for j in range(PIVOTS)]), "hot-sizes")
        pivots = sizes.select("key", F.explode(F.array_distinct(F.array(*[f"p{j}" for j in range(PIVOTS)]))).alias("node"))
        new = written(pivot_links(members, pivots, sizes, sets, similarity, key_rows), "pivot-links")
        found = new if found is None else found.unionByName(new)
        rooted = written(members.join(components(found), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "hot-roots")
        by_root = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
        by_key = by_root.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"))
        rest = written(by_key.where("roots > 1").withColumn("few", F.col("n") - F.col("most") <= key_rows), "hot-rest")
        if rest.isEmpty():
            return found
        few = rooted.join(rest.where("few").select("key", "main"), "key")
        found = found.unionByName(written(pivot_links(few.select("key", "node"), few.where("root <> main").select("key", "node"), rest, sets, similarity, key_rows), "few-links"))
        many = written(rooted.join(rest.where("NOT few").select("key"), "key", "left_semi"), "hot-many")
        if many.isEmpty():
            return found
        level += 1
        fine = Minhashes(BANDS, BAND_ROWS, 0) if level == 1 else Minhashes(FINE_BANDS, FINE_ROWS, level)

        def finer(batches: Iterator[pa.RecordBatch], fine: Minhashes = fine) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = [fine(np.frombuffer(x.as_py(), "<u8")) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["node", "keys"])

        own = sets.join(many.select("node").distinct(), "node", "left_semi").select("node", "shingles").mapInArrow(finer, "node long, keys array<long>")
        keyed = many.join(own, "node").select("key", "node", "root", F.explode("keys").alias("fine"))
        keyed = written(keyed.select(F.xxhash64("key", "fine").alias("key"), "node", "root").distinct(), "fine-keys")
        open_ = keyed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
        keyed = keyed.join(open_, "key", "left_semi").select("key", "node")
        chosen = written(shared_keys(keyed), "fine-shared")
        found = found.unionByName(written(key_links(keyed.join(chosen.where(F.col("n") <= key_rows).select("key"), "key", "left_semi"), sets, similarity), "fine-links"))
        members = written(keyed.join(chosen.where(F.col("n") > key_rows).select("key"), "key", "left_semi"), "hot-members")
        if members.isEmpty():
            return found


def those_with(texts: DataFrame, hashes: DataFrame) -> DataFrame:
    """The rows of texts whose text_hash is in hashes (hash). Only rows that pass a filter of these are moved."""
    probe = passes(texts.sparkSession, filter_bits(hashes))
    return texts.where(probe(F.col("text_hash"))).join(hashes, F.col("text_hash") == F.col("hash"), "left_semi")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = STAGE_WORDS, similarity: float = SIMILARITY, key_rows: int = KEY_ROWS) -> DataFrame:
    """One row per input row: id, text_hash, root (one for all texts that chains of similar texts connect).

    Words are those of near_groups. Texts of equal sets of shingles are one node; null and empty texts have the empty
    set. Very long texts count whole, and a set stands in one task. An empty table gives an empty result; other columns
    aren't read.
    """
    if similarity < SIMILARITY:
        raise ValueError("the fingerprints find similarities of 0.8 or more")
    names = [f"w{k}" for k in range(WORDS)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(t.as_py(), words)) for t in batch.column(2)]
            prints = np.array([wide_fingerprint(x) for x in sets], np.int64).reshape(-1, WORDS)
            numbers = [pa.array(map(node_of, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), *(pa.array(w, pa.int64()) for w in prints.T)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers], names=["id", "text_hash", "node", "n", *names])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [np.unique(shingles(t.as_py(), words)) for t in batch.column(0)[at : at + 256]]
                fps = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(map(node_of, sets), pa.int64()), pa.array(fps), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["node", "fp", "shingles"]
                )

    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    rows = written(texts.mapInArrow(sketch, "id long, text_hash long, node long, n long, " + ", ".join(f"{w} long" for w in names)), "sketches")
    # sets of less than four shingles are similar to equal ones only
    nodes = written(rows.where("n > 3").groupBy("node", "n", *names).agg(F.min("text_hash").alias("text_hash")), "nodes")
    near = written(components(wide_links(nodes, similarity)).withColumnRenamed("root", "key"), "near")
    sizes = written(near.groupBy("key").agg(F.count("*").alias("size")), "near-sizes")
    hashes = written(nodes.join(near, "node", "left_semi").select(F.col("text_hash").alias("hash")).distinct(), "near-hashes")
    wanted = those_with(texts, hashes).groupBy("text_hash").agg(F.first("text").alias("text"))
    sets = written(wanted.select("text").mapInArrow(fetch, "node long, fp long, shingles binary"), "shingle-sets")
    found = key_links(near.join(sizes.where(F.col("size") <= key_rows), "key", "left_semi").select("key", "node"), sets, similarity)
    hot = near.join(sizes.where(F.col("size") > key_rows), "key", "left_semi").select("key", "node")
    if not hot.isEmpty():
        found = found.unionByName(hot_links(hot, sets, similarity, key_rows))
    linked = components(found)
    return rows.join(linked, "node", "left").select("id", "text_hash", F.coalesce("root", "node").alias("root"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"), words=4, distance=4)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similar_groups) stays, the one with the smallest doc_id (then
    text_hash); a group without doc_ids keeps one as well. Of rows that repeat both doc_id and text one stays.

    Null and empty texts are one group; very long texts count whole. An empty table gives an empty result. All columns of
    docs pass through, whatever their names.
    """
    groups = written(similar_groups(docs).withColumn("rank", F.struct(F.col("id").isNull(), "id", "text_hash")), "near-groups")
    # rows that repeat both are counted first, so that a root has a row for each rank
    ranked = groups.groupBy("root", "rank").agg(F.count("*").alias("times"))
    stays = written(ranked.groupBy("root").agg(F.min("rank").alias("first"), F.min_by("times", "rank").alias("times"), F.count("*").alias("n")), "near-stays")
    gone = groups.join(stays.where("n > 1"), "root").where(~F.col("rank").eqNullSafe(F.col("first"))).select(F.col("id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    out = without(docs, written(gone.distinct(), "near-gone"), {"gone_id": docs["doc_id"].cast("long"), "gone_hash": text_hash(docs["text"])})
    return out if stays.where(F.col("times") > 1).isEmpty() else one_row_each(out)
