"""Language-model scores: a unigram base and a class-based bigram model (Brown classes by exchange).

1. Counts of all words of the training texts, by an aggregation that starts in the tasks.
2. All texts are written as numbers of a dictionary; words beyond it are listed with their places. What follows
   reads these numbers, not the texts.
3. Bigram counts over the most frequent words (all others are one symbol), and exchange clustering on the driver, on a
   matrix whose size is fixed: each of the frequent words moves to the class where the likelihood of the class bigrams is
   highest, until none moves. Then every other word that occurs CLASS_COUNT times or more goes to the class with the
   highest gain of the same likelihood, from the counts of its neighbours' classes, which are aggregated in Spark: in
   blocks of numbers for the dictionary, by word beyond it. Class bigrams are counted again with all classes.
4. A text's score is the sum, over its words and its end, of log10 of the smoothed class transition times the
   word's probability in its class. Words that are rarer share an open class, which gives unknown words (one
   type, as in the base) the weight of the words that occur once, after Good and Turing.

The dictionary has the words from a threshold on (the lowest count at which at most DICTIONARY_WORDS words are left)
that have at most LONG_WORD bytes, so its size is bounded in bytes too. Counts and classes of the other words, whose
number grows with the input, are joined to the texts that have them. Both give the same exact sums.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table, written

#: Words whose counts tasks hold, words that are clustered, classes, rounds of exchange at most.
DICTIONARY_WORDS, FREQUENT_WORDS, CLASSES, ROUNDS = 200_000, 1000, 48, 8
#: Bytes of a word of the dictionary at most; longer ones are joined.
LONG_WORD = 64
#: Occurrences from which a word has a class.
CLASS_COUNT = 20
#: In a path of classes, a word whose class comes with the join.
UNRESOLVED = 255
#: Distinct words, and bytes of texts, that a task counts before it passes its counts on.
COUNTED_WORDS, COUNTED_BYTES = 300_000, 1 << 27
#: Tokens that a task looks at in one go, and words in a block of context counts.
SLICE_TOKENS, BLOCK_WORDS = 500_000, 256
#: Bits of the filter of words beyond the dictionary that get a class: 8 MB at any input size.
FILTER_BITS = 1 << 26
#: Weight of the class's overall share in a transition probability.
SMOOTHING = 5.0
#: Threshold steps per doubling of the count.
STEPS = 16


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """(text) to (word binary, c)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, read = Counter(), 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                seen.update(words)
                read += sum(map(len, words))
                if len(seen) >= COUNTED_WORDS or read >= COUNTED_BYTES:
                    yield flush()
                    seen.clear()
                    read = 0
        if seen:
            yield flush()

    return texts.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Dictionary:
    """Words from a threshold on: number by word, counts by number. whole: there are no other known words. once: how
    many words occur once, 1 at least."""

    number: dict[bytes, int]
    counts: np.ndarray
    whole: bool
    least: int
    n_train: int
    n_tokens: int
    n_words: int
    once: int


def _step() -> Column:
    return F.floor(F.log2(F.col("c")) * STEPS + 1e-6)


def _listed(least: int) -> Column:
    """Whether a word is in the dictionary whose threshold is `least`."""
    return (_step() >= least) & (F.octet_length("word") <= LONG_WORD)


def dictionary(counts: DataFrame, n_train: int, words: int = DICTIONARY_WORDS) -> Dictionary:
    """n_tokens and n_words include the end, of which each training text has one."""
    short = F.octet_length("word") <= LONG_WORD
    got = counts.groupBy(_step().alias("step"), short.alias("short")).agg(F.count("*").alias("n"), F.sum("c").alias("total")).collect()  # some hundred rows
    known, tokens, once = sum(r.n for r in got), sum(r.total for r in got), sum(r.n for r in got if not r.step)
    by_step = {r.step: r.n for r in got if r.short}
    chosen, least_step = 0, None
    for s in sorted(by_step, reverse=True):
        if chosen + by_step[s] > words:
            break
        chosen, least_step = chosen + by_step[s], s
    least = least_step if least_step is not None else 1 << 20
    top = counts.where(_listed(least)).collect() if least_step is not None else []
    top.sort(key=lambda r: (-r.c, bytes(r.word)))
    return Dictionary({bytes(r.word): k for k, r in enumerate(top)}, np.array([r.c for r in top], np.int64), chosen == known, least, n_train, tokens + n_train, known + (n_train > 0), max(1, once))


def encoded(rows: DataFrame, words: Dictionary) -> DataFrame:
    """(id, text, held_out) to (key, id, held_out, ids, rare): 32-bit numbers of a text's words, that after the last for a
    word beyond the dictionary; rare has those words, each with its places."""
    sent = rows.sparkSession.sparkContext.broadcast(words.number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, key = sent.value, TaskContext.get().partitionId() << 33
        get, none = number.get, len(number)
        for batch in batches:
            ids, listed, edges, places, ends = [], [], [0], [], [0]
            for text in batch.column(1):
                tokens, rare = words_of(text.as_py()), {}
                at = np.array([get(w, none) for w in tokens], np.int32)
                for k in np.flatnonzero(at == none).tolist():
                    rare.setdefault(tokens[k], []).append(k)
                ids.append(at.tobytes())
                listed += rare
                for x in rare.values():
                    places += x
                    ends.append(len(places))
                edges.append(len(listed))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
            found = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(listed, pa.binary()), lists], ["word", "places"]))
            keys = pa.array(range(key, key + batch.num_rows), pa.int64())
            key += batch.num_rows
            yield pa.RecordBatch.from_arrays([keys, batch.column(0), batch.column(2), pa.array(ids, pa.binary()), found], names=["key", "id", "held_out", "ids", "rare"])

    return rows.select("id", "text", "held_out").mapInArrow(run, "key long, id long, held_out boolean, ids binary, rare array<struct<word:binary,places:array<int>>>")


def sliced(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most SLICE_TOKENS tokens, but for longer texts, which come alone. The first column has
    `width` bytes a token."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False) // width)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(upto, (upto[start - 1] if start else 0) + SLICE_TOKENS, "right"))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def sums_of(text: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text, values, n).astype(float)


def flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all texts in one run, and how many each text has."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(x.as_buffer() for x in column), kind), sizes


class Runs:
    """Symbols of several texts, each between two borders, in one run."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, border: int):
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        self.starts = np.cumsum(sizes + 2) - (sizes + 2)
        #: Where the words stand in the run.
        self.at = np.arange(len(symbols)) + 2 * self.text + 1
        self.run = np.full(len(symbols) + 2 * len(sizes), border, np.int64)
        self.run[self.at] = symbols
        #: Neighbours are a place and the next one, but for the end of a text and the start of the next.
        self.inside = np.ones(max(len(self.run) - 1, 0), bool)
        self.inside[self.starts[1:] - 1] = False

    def pairs(self, size: int) -> np.ndarray:
        return np.bincount((self.run[:-1] * size + self.run[1:])[self.inside], minlength=size * size)


def _pair_counts(rows: DataFrame, count, size: int) -> np.ndarray:
    """Sums of the pairs that count(batches) yields as arrays of size * size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for found in count(batches):
            total += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    got = rows.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # size ** 2 rows at most
    out = np.zeros(size * size, np.int64)
    out[got["pair"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(size, size)


def symbol_bigrams(texts: DataFrame, m: int) -> np.ndarray:
    """Counts of neighbours among the words 0 to m - 1, any other word (m), the border of texts (m + 1), from the ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in sliced(batches, 4):
            ids, sizes = flat(batch.column(0), "<i4")
            yield Runs(np.minimum(ids, m), sizes, m + 1).pairs(m + 2)

    return _pair_counts(texts.select("ids"), count, m + 2)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each symbol: frequent words 0 to classes - 1, then a class each for other words and the border."""
    m = len(bigrams) - 2
    classes = max(1, min(classes, m))
    of = np.append(np.arange(m) % classes, [classes, classes + 1])
    k = classes + 2
    counts = bigrams.astype(float)
    member = np.eye(k)[of]
    table_ = member.T @ counts @ member
    own = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for w in range(m):
            here, twice = of[w], counts[w, w]
            right = np.bincount(of, counts[w], k)
            left = np.bincount(of, counts[:, w], k)
            right[here] -= twice
            left[here] -= twice
            table_[here, :] -= right
            table_[:, here] -= left
            table_[here, here] -= twice
            rows, columns = table_[:classes], table_[:, :classes].T
            gain = (_xlogx(rows + right) - _xlogx(rows)).sum(1) + (_xlogx(columns + left) - _xlogx(columns)).sum(1)
            diagonal = table_[own, own]
            gain += _xlogx(diagonal + right[:classes] + left[:classes] + twice) - _xlogx(diagonal)
            gain -= _xlogx(diagonal + right[:classes]) - _xlogx(diagonal) + _xlogx(diagonal + left[:classes]) - _xlogx(diagonal)
            # the word's own counts as a whole don't depend on the class, those of the classes do
            out, into = table_.sum(1)[:classes], table_.sum(0)[:classes]
            gain -= _xlogx(out + counts[w].sum()) - _xlogx(out) + _xlogx(into + counts[:, w].sum()) - _xlogx(into)
            best = int(np.argmax(gain))
            if gain[best] <= gain[here] + 1e-9:
                best = here
            moved += best != here
            of[w] = best
            table_[best, :] += right
            table_[:, best] += left
            table_[best, best] += twice
        if not moved:
            break
    return of


def assign(table_: np.ndarray, classes: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For words (rows) with counts of their neighbours' classes, the class below `classes` of the highest gain."""
    own = np.arange(classes)
    rows, columns, diagonal = table_[:classes], table_[:, :classes].T, table_[own, own]
    out, into = rows.sum(1), columns.sum(1)
    least = [_xlogx(x) for x in (rows, columns, diagonal, out, into)]
    best = np.empty(len(left), np.int64)
    for k in range(0, len(left), 256):
        x, y = left[k : k + 256], right[k : k + 256]
        r, c = y[:, :classes], x[:, :classes]
        gain = (_xlogx(rows + y[:, None, :]) - least[0]).sum(2) + (_xlogx(columns + x[:, None, :]) - least[1]).sum(2)
        gain += _xlogx(diagonal + r + c) - _xlogx(diagonal + r) - _xlogx(diagonal + c) + least[2]
        gain -= _xlogx(out + y.sum(1, keepdims=True)) - least[3] + _xlogx(into + x.sum(1, keepdims=True)) - least[4]
        best[k : k + 256] = gain.argmax(1)
    return best


def _filter(often: DataFrame) -> np.ndarray:
    """A bit for the hash of each word."""
    at = often.select(F.xxhash64("word").bitwiseAND(FILTER_BITS - 1).alias("bit"))
    bits = at.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()  # FILTER_BITS / 64 rows at most
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    return out


def word_classes(texts: DataFrame, counts: DataFrame, words: Dictionary, bigrams: np.ndarray, of: np.ndarray, least_count: int) -> tuple[np.ndarray, DataFrame]:
    """The class of each dictionary word that occurs least_count times, by number (the frequent ones' as in `of`), and
    (word, class) of those beyond the dictionary. texts are rows of encoded()."""
    m, k = len(bigrams) - 2, int(of.max()) + 1
    member = np.eye(k)[of]
    table_, open_class, border = member.T @ bigrams @ member, int(of[m]), int(of[m + 1])
    clustered, none = int((words.counts >= least_count).sum()), len(words.counts)
    of_number = np.full(none + 1, open_class)
    of_number[:m] = of[:m]
    out = of_number[:none].copy()
    context = texts.sparkSession.sparkContext

    def run_of(batch: pa.RecordBatch) -> tuple[np.ndarray, Runs]:
        ids, sizes = flat(batch.column(0), "<i4")
        return ids, Runs(of_number[ids], sizes, border)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((clustered - m) * 2 * k, np.int32)
        for batch in sliced(batches, 4):
            ids, r = run_of(batch)
            mine = np.flatnonzero((ids >= m) & (ids < clustered))
            first, at = (ids[mine].astype(np.int64) - m) * 2 * k, r.at[mine]
            np.add.at(total, first + r.run[at - 1], 1)
            np.add.at(total, first + k + r.run[at + 1], 1)
        size = BLOCK_WORDS * 2 * k
        for block in range(-(-len(total) // size)):
            part = total[block * size : (block + 1) * size]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([part[at].astype("<i4").tobytes()], pa.binary())], names=["block", "cell", "n"])

    def block_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with those of a block together; a block's rows may go on in the next batch."""
        now, total = None, np.zeros(0)

        def found() -> pa.RecordBatch:
            got = total.reshape(-1, 2, k)
            first = m + (now or 0) * BLOCK_WORDS
            numbers = np.arange(first, first + len(got))[: clustered - first]
            return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(assign(table_, open_class, got[: len(numbers), 0], got[: len(numbers), 1]), pa.int64())], names=["number", "class"])

        for batch in batches:
            for block, cell, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    if now is not None:
                        yield found()
                    now, total = block, np.zeros(BLOCK_WORDS * 2 * k)
                total[np.frombuffer(cell, "<i4")] += np.frombuffer(n, "<i4")
        if now is not None:
            yield found()

    if clustered > m:
        dealt = texts.select("ids").mapInArrow(blocks, "block long, cell binary, n binary").repartition("block").sortWithinPartitions("block")
        got = dealt.mapInArrow(block_classes, "number long, class long").toArrow()  # DICTIONARY_WORDS rows at most
        out[got["number"].to_numpy()] = got["class"].to_numpy()
    often = counts.where((F.col("c") >= least_count) & ~_listed(words.least)).select("word")
    bits = None if words.whole else _filter(often)
    if bits is None or not bits.any():
        return out, texts.sparkSession.createDataFrame([], "word binary, class long")
    sent = context.broadcast(bits)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, h, held, size = sent.value, xxhash.xxh64_intdigest, {}, 0

        def flush() -> pa.RecordBatch:
            sides = [np.unique(np.concatenate(x), return_counts=True) for x in held.values()]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), pa.array([s.astype("<i4").tobytes() for s, _ in sides], pa.binary()), pa.array([n.astype("<i8").tobytes() for _, n in sides], pa.binary())],
                names=["word", "side", "n"],
            )

        for batch in sliced(batches, 4):
            _, r = run_of(batch)
            rare, text = batch.column(1).flatten(), pc.list_parent_indices(batch.column(1)).to_numpy()
            listed = rare.field(0).to_pylist()
            hashes = np.fromiter((h(w, 42) for w in listed), np.uint64, len(listed)).view(np.int64) & (FILTER_BITS - 1)
            wanted = np.flatnonzero((bits[hashes // 64] >> (hashes % 64)) & 1)
            places = rare.field(1).take(pa.array(wanted))
            at = places.flatten().to_numpy() + np.repeat(r.starts[text[wanted]] + 1, pc.list_value_length(places).to_numpy())
            sides = np.stack([r.run[at - 1], k + r.run[at + 1]], axis=1).astype(np.int32).reshape(-1)
            ends = 2 * np.cumsum(pc.list_value_length(places).to_numpy())
            for e, part in zip(wanted.tolist(), np.split(sides, ends[:-1]) if len(ends) else [], strict=True):
                held.setdefault(listed[e], []).append(part)
                size += len(part) + len(listed[e]) + 64
            if len(held) >= COUNTED_WORDS or size >= COUNTED_BYTES // 4:
                yield flush()
                held, size = {}, 0
        if held:
            yield flush()

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with those of a word together; a word's rows may go on in the next batch."""
        found: dict[bytes, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            done = list(found)
            got = np.array([found.pop(w) for w in done]).reshape(len(done), 2, k)
            return pa.RecordBatch.from_arrays([pa.array(done, pa.binary()), pa.array(assign(table_, open_class, got[:, 0], got[:, 1]), pa.int64())], names=["word", "class"])

        last = None
        for batch in batches:
            for word, side, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if word != last and len(found) >= 4096:
                    yield flush()
                if word not in found:
                    found[word] = np.zeros(2 * k)
                found[word][np.frombuffer(side, "<i4")] += np.frombuffer(n, "<i8")
                last = word
        yield flush()

    dealt = texts.select("ids", "rare").mapInArrow(contexts, "word binary, side binary, n binary").join(often, "word", "left_semi").repartition("word").sortWithinPartitions("word")
    return out, dealt.mapInArrow(classes, "word binary, class long")


@dataclass(frozen=True)
class Model:
    """log10 of transitions, class by number of a dictionary word, log10 of its probability in its class, the open
    class and that of the border, log10 of the classes' totals, of the open class's total and of the weight of unknown
    words in it."""

    transition: np.ndarray
    of: np.ndarray
    emission: np.ndarray
    open_class: int
    border: int
    totals: np.ndarray
    open_total: float
    unknown: float


def paths(texts: DataFrame, counts: DataFrame, words: Dictionary, model: Model) -> DataFrame:
    """Rows of encoded() to the path of classes of each text, sums over its dictionary words, and `found`: class, count
    and places of its other words. counts has the class of each word beyond the dictionary that has one."""
    sent = texts.sparkSession.sparkContext.broadcast((words.counts, words.whole, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, whole, model = sent.value
        none = len(counts)
        plus_one = np.append(np.log10(counts + 1.0), 0.0)
        of = np.append(model.of, model.open_class if whole else UNRESOLVED).astype(np.uint8)
        # other words count as unknown here; what they have beyond that is added after the join
        emission = np.append(model.emission, model.unknown - model.open_total)
        for batch in sliced(batches, 4):
            ids, sizes = flat(batch.column(0), "<i4")
            n, text = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
            ends, raw = np.cumsum(sizes), of[ids].tobytes()
            path = pa.array([raw[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())
            sums = [sums_of(text, ids < none, n).astype(np.int64), sums_of(text, plus_one[ids], n), sums_of(text, emission[ids], n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], path, *map(pa.array, sums)], names=["key", "id", "held_out", "path", "known", "base", "emitted"])

    out = texts.select("ids", "key", "id", "held_out").mapInArrow(run, "key long, id long, held_out boolean, path binary, known long, base double, emitted double")
    if words.whole:
        return out.withColumn("found", F.lit(None).cast("array<struct<class:long,c:long,places:array<int>>>"))
    rare = texts.select("key", F.explode("rare").alias("r")).select("key", "r.word", "r.places").join(counts.where(~_listed(words.least)), "word")
    found = rare.groupBy("key").agg(F.collect_list(F.struct("class", "c", "places")).alias("found"))
    return out.join(found, "key", "left")


def resolved(batch: pa.RecordBatch, model: Model) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From (path, found): the classes of the texts, and for each word that the join has found its text, class, count
    and number of places. Words that it hasn't found are unknown."""
    path, sizes = flat(batch.column(0), "<u1")
    r = Runs(np.where(path == UNRESOLVED, model.open_class, path), sizes, model.border)
    found, text = batch.column(1).flatten(), pc.list_parent_indices(batch.column(1)).to_numpy()
    own = pc.fill_null(found.field(0), model.open_class).to_numpy()
    times = pc.list_value_length(found.field(2)).to_numpy()
    r.run[found.field(2).flatten().to_numpy() + np.repeat(r.starts[text] + 1, times)] = np.repeat(own, times)
    return r, text, own, found.field(1).to_numpy(), times


def class_bigrams(found: DataFrame, model: Model) -> np.ndarray:
    """Counts of neighbours among the classes and the border, from rows of paths()."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in sliced(batches, 1):
            yield resolved(batch, model)[0].pairs(model.border + 1)

    return _pair_counts(found.select("path", "found"), count, model.border + 1)


def learn(
    texts: DataFrame, counts: DataFrame, words: Dictionary, frequent_words: int = FREQUENT_WORDS, classes: int = CLASSES, least_count: int = CLASS_COUNT
) -> tuple[DataFrame, Model]:
    """Counts of all words, with the class of those beyond the dictionary that have one, and the model without transitions,
    from the training rows of encoded()."""
    m = min(frequent_words, len(words.counts))
    bigrams = symbol_bigrams(texts, m)
    of = exchange(bigrams, classes)
    open_class, border = int(of[m]), int(of[m + 1])
    if border >= UNRESOLVED:
        raise ValueError("a path has a byte per class")
    number_class = np.zeros(0, np.int64)
    if m:
        number_class, beyond = word_classes(texts, counts, words, bigrams, of, least_count)
        beyond = beyond.withColumnRenamed("word", "of_word")
        counts = written(counts.join(beyond, F.col("word") == F.col("of_word"), "left").select("word", "c", "class"), "classed-counts")
    else:
        counts = counts.withColumn("class", F.lit(None).cast("long"))
    sums = np.bincount(number_class, words.counts, border + 1)
    sums[open_class] = 0
    for r in counts.where("class IS NOT NULL").groupBy("class").agg(F.sum("c").alias("c")).collect():
        sums[r["class"]] += r.c
    sums[open_class] = words.n_tokens - words.n_train - int(sums.sum()) + words.once
    totals = np.log10(np.maximum(sums, 1))
    emission = np.log10(np.maximum(words.counts, 1)) - totals[number_class]
    return counts, Model(np.zeros((border + 1, border + 1)), number_class, emission, open_class, border, totals, float(totals[open_class]), math.log10(words.once))


def with_transitions(model: Model, pairs: np.ndarray) -> Model:
    share = (pairs.sum(0) + 1) / (pairs.sum() + len(pairs))
    return replace(model, transition=np.log10((pairs + SMOOTHING * share) / (pairs.sum(1, keepdims=True) + SMOOTHING)))


def train(texts: DataFrame, n_train: int, dictionary_words: int = DICTIONARY_WORDS, **sizes) -> tuple[DataFrame, Dictionary, Model]:
    counts = written(word_counts(texts), "word-counts")
    words = dictionary(counts, n_train, dictionary_words)
    rows = written(encoded(texts.select(F.lit(0).cast("long").alias("id"), "text", F.lit(False).alias("held_out")), words), "encoded")
    counts, model = learn(rows, counts, words, **sizes)
    return counts, words, with_transitions(model, class_bigrams(paths(rows, counts, words, model), model))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held=held_out, dictionary_words: int = DICTIONARY_WORDS, **sizes) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that aren't held out and scores all. Null and empty texts are an end alone; very long texts and
    words are read whole. Without training rows all counts are zero and the model knows the open class and the border
    alone. Repeated rows are rows like any other; an empty table gives an empty result; other columns aren't read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    training = rows.where(~held(F.col("id")))
    counts = written(word_counts(training.select("text")), "word-counts")
    words = dictionary(counts, training.count(), dictionary_words)
    texts = written(encoded(rows.withColumn("held_out", held(F.col("id"))), words), "encoded")
    counts, model = learn(texts.where("NOT held_out"), counts, words, **sizes)
    found = written(paths(texts, counts, words, model), "paths")
    model = with_transitions(model, class_bigrams(found.where("NOT held_out"), model))
    base_total, n_train, n_tokens = math.log10(words.n_tokens + words.n_words + 1), words.n_train, words.n_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            r, text, own, c, times = resolved(batch, model)
            n, size = batch.num_rows, pc.binary_length(batch.column(0)).to_numpy() + 1
            known, base, emitted = (x.to_numpy() for x in batch.columns[4:])
            steps = np.where(r.inside, model.transition[r.run[:-1], r.run[1:]], 0.0)
            of_step = np.repeat(np.arange(n), size + 1)[: len(steps)]
            total = sums_of(of_step, steps, n) + emitted + sums_of(text, times * (np.log10(c) - model.totals[own] - model.unknown + model.open_total), n)
            base = base + sums_of(text, times * np.log10(c + 1.0), n) + math.log10(n_train + 1) - size * base_total
            known = known + sums_of(text, times, n).astype(np.int64) + (n_train > 0)
            columns = [batch.column(2), batch.column(3), pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(n, n_tokens), pa.int64()), pa.array(base), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return found.select("path", "found", "id", "held_out", "known", "base", "emitted").mapInArrow(
        run, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
