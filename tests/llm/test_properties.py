"""Properties on arbitrary inputs, without Spark."""

from __future__ import annotations

from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from siltlog.llm import bpe, packing, quality, simhash, tokens

from .test_operators import RANKS, brute_fingerprint, brute_quality, check_packing

TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.ranks(RANKS), special_tokens={})
TEXT = st.text(st.one_of(st.sampled_from(" \n\tab'seT|#!é漢　\x1c"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_bpe_equals_the_library(text):
    encoder = bpe.text_encoder(RANKS, public_tokenizers.PATTERN)
    ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
    assert ids == TIKTOKEN.encode_ordinary(text)
    assert b"".join(encoder.bpe.bytes[k] for k in ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_quality_features(text):
    t = quality.Text(text)
    assert tuple(getattr(t, f) for f in quality.FEATURES) == brute_quality(text)


@settings(max_examples=100, deadline=None)
@given(TEXT, st.integers(1, 5))
def test_fingerprint(text, words):
    assert simhash.fingerprint(text, words) == brute_fingerprint(text, words)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=20))
def test_best_fit(lengths):
    packed = packing.best_fit(lengths, 50)
    check_packing(packed, lengths, 50)
    assert len(packed) <= 3 * len(lengths) + 1
    places = packing.places(packed, 50)
    slots = Counter()
    for length, (base, each, first, offset) in places.items():
        for rank in range(lengths[length]):
            at = int(np.searchsorted(base, rank, "right")) - 1
            nth = rank - int(base[at])
            start = int(offset[at]) + nth % int(each[at]) * length
            for k in range(start, start + length):
                slots[(int(first[at]) + nth // int(each[at]), k)] += 1
    assert all(n == 1 for n in slots.values())
    assert sum(slots.values()) == sum(k * n for k, n in lengths.items())
