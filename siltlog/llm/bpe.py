"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece there is exactly one last token with which a valid encoding of that prefix can
end: the one that makes a valid pair with the last token of the prefix before it. A table of these tokens
gives the encoding of every prefix by walking back, so bytes can be appended without looking at earlier
ones, and after an edit only the entries near it are computed again, until they agree with the old table.

A text is cut into the matches of the vocabulary's pattern and each match is encoded by itself. Encodings
of short pieces are kept in a bounded cache per Python process.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table
from .tokens import ranks, vocabulary

#: Pieces, and runs of pieces between spaces, whose encodings a process keeps, and the longest kept.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 48
#: Valid and invalid pairs that a process keeps.
PAIR_ENTRIES = 2_000_000
#: Prefixes whose last tokens a process keeps, and the longest piece whose prefixes are kept.
PREFIX_ENTRIES, STORED_BYTES = 500_000, 64


class PrefixBpe:
    """The dynamic program over one vocabulary of ranks."""

    def __init__(self, rank: dict[bytes, int]):
        self.rank = rank
        self.bytes = [b""] * (max(rank.values()) + 1)
        for token, k in rank.items():
            self.bytes[k] = token
        self.longest = max(map(len, rank))
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.prefixes: dict[bytes, int] = {}

    def half(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte and a token no merge makes."""
        if token not in self.halves:
            parts = [bytes([b]) for b in self.bytes[token]]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda k: self.rank.get(parts[k] + parts[k + 1], 1 << 40))
                if self.rank.get(parts[best] + parts[best + 1], 1 << 40) >= token:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            self.halves[token] = (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def made(self, token: int) -> bool:
        """Whether merging its bytes gives the token."""
        return len(self.bytes[token]) == 1 or self.half(token) is not None

    def pair(self, left: int, right: int) -> bool:
        """Whether the encoding of the bytes of both is these two tokens. From the outermost merges inwards: no
        merge across the border may come before the merges that made the two sides."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is not None:
            return known
        a, b, before = left, right, 1 << 40
        ok = True
        while True:
            across = self.rank.get(self.bytes[a] + self.bytes[b])
            if across is not None and across < before:
                ok = False
                break
            a_half, b_half = self.half(a), self.half(b)
            # undo the later of the two merges; of equal ones the right one came later, as merges go left to right
            if a_half and (a > b or not b_half):
                before, a = a, a_half[1]
            elif b_half:
                before, b = b + 1, b_half[0]
            else:
                break
        if len(self.pairs) < PAIR_ENTRIES:
            self.pairs[key] = ok
        return ok

    def extend(self, piece: bytes, last: list[int], upto: int | None = None) -> None:
        """Appends to last the last tokens of the prefixes of piece that it lacks, up to length `upto`."""
        get, known = self.rank.get, self.pairs.get
        for end in range(len(last) + 1, (len(piece) if upto is None else upto) + 1):
            for start in range(max(0, end - self.longest), end):
                token = get(piece[start:end])
                if token is None:
                    continue
                if not start:
                    ok = self.made(token)
                else:
                    before = last[start - 1]
                    ok = known(before << 32 | token)
                    if ok is None:
                        ok = self.made(token) and self.pair(before, token)
                if ok:
                    last.append(token)
                    break
            else:
                raise ValueError("a byte is missing from the vocabulary")

    def walk(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes[last[end - 1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece; a piece that is a token is that token, as rank encoders have it.

        The last token of a prefix depends on the prefix alone, so a piece starts from its longest prefix met before.
        """
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > STORED_BYTES:
            last: list[int] = []
            self.extend(piece, last)
            return self.walk(last)
        prefixes, get, known = self.prefixes, self.rank.get, self.pairs.get
        n = len(piece)
        end = n
        while end and piece[:end] not in prefixes:
            end -= 1
        if n - end + len(prefixes) > PREFIX_ENTRIES:
            prefixes.clear()
            end = 0
        while end < n:
            end += 1
            for start in range(max(0, end - self.longest), end):
                token = get(piece[start:end])
                if token is None:
                    continue
                if start:
                    before = prefixes[piece[:start]]
                    ok = known(before << 32 | token)
                    if ok is None:
                        ok = self.made(token) and self.pair(before, token)
                else:
                    ok = self.made(token)
                if ok:
                    prefixes[piece[:end]] = token
                    break
            else:
                raise ValueError("a byte is missing from the vocabulary")
        out = []
        while n:
            token = prefixes[piece[:n]]
            out.append(token)
            n -= len(self.bytes[token])
        return out[::-1]


class PrefixTable:
    """A piece that can grow and be edited, with its encoding kept up to date."""

    def __init__(self, bpe: PrefixBpe, piece: bytes = b""):
        self.bpe, self.piece, self.last = bpe, piece, []
        bpe.extend(piece, self.last)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.bpe.extend(self.piece, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts new in place of piece[start:end]; returns the number of table entries computed."""
        old, tail = self.last, end
        self.piece = self.piece[:start] + new + self.piece[end:]
        self.last, shift, same, at = old[:start], len(new) - (end - start), 0, start + len(new)
        self.bpe.extend(self.piece, self.last, at)
        while at < len(self.piece) and same < self.bpe.longest:
            self.bpe.extend(self.piece, self.last, at + 1)
            inside = len(self.bpe.bytes[self.last[at]]) <= at + 1 - start - len(new)
            same = same + 1 if inside and self.last[at] == old[at - shift] else 0
            at += 1
        self.last += old[at - shift :] if tail <= at - shift else []
        return at - start

    def ids(self) -> list[int]:
        return self.bpe.walk(self.last)


@functools.lru_cache(4)
def _bpe(path: str) -> PrefixBpe:
    return PrefixBpe(ranks(path))


class TextEncoder:
    """Whole texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, pattern: str):
        self.bpe, self.find = _bpe(path), regex.compile(pattern).findall
        # before a space that a non-space follows, one match always ends: runs in between can be encoded apart
        self.cut = regex.compile(r"(?= \S)").split
        self.spaced = re.compile(r" (?:\s|\Z)").search
        self.packed = [k.to_bytes(4, "little") for k in range(len(self.bpe.bytes))]
        self.runs: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = b"".join([self.packed[k] for k in self.bpe.encode(piece.encode())])
            if len(piece) <= CACHE_CHARS and len(self.pieces) < CACHE_ENTRIES:
                self.pieces[piece] = got
        return got

    def first(self, run: str) -> bytes:
        return b"".join(map(self.piece, self.find(run)))

    def run(self, run: str) -> bytes:
        """A run after a space, given without it."""
        got = self.first(" " + run)
        if len(run) < CACHE_CHARS and len(self.runs) < CACHE_ENTRIES:
            self.runs[run] = got
        return got

    def encode(self, text: str) -> bytes:
        if self.spaced(text):
            first, *parts = self.cut(text)
            parts = [p[1:] for p in parts]
        else:
            first, *parts = text.split(" ")
        get, run = self.runs.get, self.run
        return self.first(first) + b"".join([get(p) or run(p) for p in parts])


@functools.lru_cache(4)
def text_encoder(path: str, pattern: str) -> TextEncoder:
    return TextEncoder(path, pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids as little-endian unsigned 32-bit integers. Null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path, pattern)
        for batch in batches:
            ids = [encoder.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.large_binary()).cast(pa.binary())], names=["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, ids binary")


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """(id, ids) to (id, ids, bytes). An id that the vocabulary lacks is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _bpe(path).bytes.__getitem__
        for batch in batches:
            got = [b"".join(map(of, np.frombuffer(x.as_py() or b"", "<u4").tolist())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], names=["id", "ids", "bytes"])

    return rows.select("id", "ids").mapInArrow(run, "id long, ids binary, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass; only lengths and digests leave the task.

    One row per input row: id, n_tokens, ids_sha256, decoded_sha256. Null and empty texts have no token; rows
    may repeat; an empty table gives an empty result; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path, pattern)
        of = encoder.bpe.bytes.__getitem__
        for batch in batches:
            counts, digests, decoded = [], [], []
            for t in batch.column(1):
                ids = encoder.encode(t.as_py() or "")
                counts.append(len(ids) // 4)
                digests.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(b"".join(map(of, np.frombuffer(ids, "<u4").tolist()))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.withColumnRenamed("id", "doc_id")
