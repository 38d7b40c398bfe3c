"""The registered queries that have no SQL, as they are registered, against brute force on the smallest tables."""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from siltlog.llm import lm, quality, tokens
from siltlog.llm.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def lowered(text):
    return [w.translate({k: k + 32 for k in range(65, 91)}) for w in WORD.findall(text)]


def crc(k):
    return zlib.crc32(str(k).encode())


def test_op4(spark, texts):
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {tuple(r) for r in QUERIES["op4_byte_bpe"](spark, DATA).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    ids = {k: coder.encode_ordinary(t) for k, t in texts.items()}
    assert got == {(k, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[k].encode()).hexdigest()) for k, x in ids.items()}


def test_op5(spark, texts):
    reader, size, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 2048, []
    for k, t in texts.items():
        ids = [*reader.encode(t, add_special_tokens=False).ids, 0]
        edges = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
        want += [(k, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    got = QUERIES["op5_packing"](spark, DATA).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    at = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= size and len(at) <= 1.01 * sum(at.values()) / size + 1


def test_op7(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, DATA).collect()}
    assert set(got) == set(texts)
    for k, r in got.items():
        assert r.held_out == (crc(k) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op8(spark, texts):
    fps = {}
    for k, t in texts.items():
        w = lowered(t)
        parts = [" ".join(w[j : j + 4]) for j in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        fps[k] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    component = {k: k for k in fps}

    def find(k):
        while component[k] != k:
            k = component[k]
        return k

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if b < a and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                component[y] = x
    assert {tuple(r) for r in QUERIES["op8_simhash"](spark, DATA).select("doc_id", "fingerprint", "component_id").collect()} == {(k, f"{fps[k]:016x}", find(k)) for k in ids}


def test_op9(spark, texts):
    """All columns; the score from the model's classes, with counts, transitions and emissions counted anew."""
    train = {k: t for k, t in texts.items() if crc(k) % 7 != 2}
    count = Counter(w for t in train.values() for w in lowered(t))
    total, types = sum(count.values()) + len(train), len(count) + 1
    frame = spark.createDataFrame([(t,) for t in train.values()], "text string")
    counted, words, model = lm.train(frame, len(train))
    classes = {w.decode(): int(model.of[k]) for w, k in words.number.items()}
    assert {w for w, c in classes.items() if c != model.open_class} >= {w for w, c in count.items() if c >= lm.CLASS_COUNT}
    of = lambda w: classes.get(w, model.open_class)
    once = max(1, sum(c == 1 for c in count.values()))
    mass = Counter()
    for w, c in count.items():
        mass[of(w)] += c
    mass[model.open_class] += once
    pairs = np.zeros((model.border + 1, model.border + 1))
    path = lambda t: [model.border, *map(of, lowered(t)), model.border]
    for t in train.values():
        p = path(t)
        np.add.at(pairs, (p[:-1], p[1:]), 1)
    share = (pairs.sum(0) + 1) / (pairs.sum() + len(pairs))
    step = np.log10((pairs + lm.SMOOTHING * share) / (pairs.sum(1, keepdims=True) + lm.SMOOTHING))
    got = {r.doc_id: r for r in QUERIES["op9_lm_scores"](spark, DATA).collect()}
    assert set(got) == set(texts)
    for k, t in texts.items():
        r, w, p = got[k], lowered(t), path(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(k) % 7 == 2, len(w) + 1, sum(x in count for x in w) + 1, total)
        base = sum(math.log10((count[x] + 1) / (total + types + 1)) for x in w) + math.log10((len(train) + 1) / (total + types + 1))
        score = sum(step[a, b] for a, b in zip(p, p[1:], strict=False)) + sum(math.log10(count.get(x, once) / mass[of(x)]) for x in w)
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 1e-6


def test_op10(spark, texts):
    coder = tokens.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = QUERIES["op10_token_counts"](spark, DATA).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((k, len(coder.encode_ordinary(t))) for k, t in texts.items())
    at = {}
    for r in sorted(got, key=lambda r: (r.file, r.ordinal)):
        assert r.start == at.get(r.file, 0)
        at[r.file] = r.start + r.n_tokens + 1


def test_costs_of_rules_are_those_that_the_cascade_pays():
    """With a clock that counts features computed: a rule on a reported feature is free, one on words of its own isn't."""
    computed = []
    clock = lambda: len(computed)

    class Counted(quality.Text):
        pass

    for name in ("n_upper", "n_letters", "n_stutters"):
        own = getattr(quality.Text, name).func
        setattr(Counted, name, property(lambda self, own=own: computed.append(1) or own(self)))
    texts = ["word " * 60 + "more of them and others " * 20, "short"] + [" ".join(f"w{k}" for k in range(100))] * 3
    plain, quality.Text = quality.Text, Counted
    try:
        spent, rejected = quality.measured(texts, quality.RULES, quality.BASE, quality.FEATURES, clock)
    finally:
        quality.Text = plain
    of = dict(zip((r.name for r in quality.RULES), spent, strict=True))
    assert of["symbols"] == of["duplicate_lines"] == of["word_length"] == 0
    assert of["shouting"] == 3 * of["stutter"] > 0  # n_upper, and n_letters, which needs it again where nothing is kept
    assert sum(rejected) == 0
