"""The pipeline's near-duplicate stage against brute force over all pairs of texts."""

from __future__ import annotations

import random

import numpy as np

from siltlog.llm import base, simhash

from .test_operators import docs_of


def edited_texts(seed=3):
    """Texts of 6 to 400 words, each with copies in which a few words are replaced, and texts with a passage in common."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(5000)
    out = []
    for size in [6, 8, 9, 12, 20, 40, 60, 100, 100, 200, 200, 400] * 2:
        first = [word() for _ in range(size)]
        out.append(first)
        for edits in (0, 1, size // 60 + 1, size // 45 + 1, size // 25 + 1, size // 8 + 1):
            copy = list(first)
            for _ in range(edits):
                copy[rng.randrange(size)] = word()
            out.append(copy[: size - edits % 2])
    passage = [word() for _ in range(80)]
    out += [[word() for _ in range(30)] + passage for _ in range(10)]
    return ["", None, *(" ".join(t) for t in out)]


def brute_sets(texts):
    words = [(t or "").lower().split() for t in texts]
    return [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]


def brute_near(texts):
    """Of each group that chains of texts with a Jaccard similarity of 0.8 or more connect, the first index by index."""
    sets, first = brute_sets(texts), list(range(len(texts)))

    def find(k):
        while first[k] != k:
            k = first[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                first[y] = x
    return [find(k) for k in range(len(texts))]


def test_near_stage_equals_brute_force(spark):
    texts = edited_texts()
    first = brute_near(texts)
    assert 30 < len(set(first)) < len(texts) - 30
    docs = docs_of(spark, list(enumerate(texts)))
    groups = {r.id: r.root for r in simhash.similar_groups(docs).collect()}
    for a in range(len(texts)):
        for b in range(a):
            assert (groups[a] == groups[b]) == (first[a] == first[b]), (texts[a], texts[b])
    assert {r.doc_id for r in simhash.stage(spark, docs, "").collect()} == set(first)


def test_hot_keys_equal_brute_force(spark):
    """Keys of more texts than a task may hold: a dense group, chains in it, and strangers with a passage in common."""
    rng = random.Random(6)
    word = lambda: "w%d" % rng.randrange(5000)
    first = [word() for _ in range(60)]
    texts = []
    for _ in range(40):
        copy = list(first)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            copy[rng.randrange(60)] = word()
        texts.append(" ".join(copy))
    chain = list(first)
    for _ in range(14):
        chain[:2] = []
        chain += [word(), word()]
        texts.append(" ".join(chain))
    texts += [" ".join([word() for _ in range(rng.randrange(4, 30))] + first + [word() for _ in range(rng.randrange(30))]) for _ in range(25)]
    want = brute_near(texts)
    assert 5 < len(set(want)) < 60
    docs = docs_of(spark, list(enumerate(texts)))
    for key_rows in (2, 8):
        groups = {r.id: r.root for r in simhash.similar_groups(docs, key_rows=key_rows).collect()}
        for a in range(len(texts)):
            for b in range(a):
                assert (groups[a] == groups[b]) == (want[a] == want[b]), (key_rows, texts[a], texts[b])


def test_without_a_long_table(spark):
    """The same rows go whether what is gone is sent or a filter of it."""
    docs = docs_of(spark, [(k if k % 9 else None, f"t{k % 7}") for k in range(200)])
    gone = spark.createDataFrame([(k, f"t{k % 5}") for k in range(0, 200, 2)] + [(None, "t0")], "a long, b string")
    keys = {"a": docs["doc_id"], "b": docs["text"]}
    left = [sorted((r.doc_id or -1, r.text) for r in base.without(docs, gone, keys, sent_rows=n).collect()) for n in (1000, 0)]
    assert left[0] == left[1] and 100 < len(left[0]) < 195


def test_chains_within_a_key():
    """The first and the last set of a chain are unlike, yet one group; a set apart has no link."""
    sets = [np.arange(k, k + 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k in (0, 4, 8, 12, 500)]
    sets = [np.sort(s) for s in sets]
    fps = np.zeros(5, np.int64)
    a, b = simhash.similar_links(np.arange(5), fps, sets, 0.8)
    assert sorted(map(sorted, zip(a, b, strict=True))) == [[0, 1], [1, 2], [2, 3]]


def test_band_keys_find_similar_sets():
    rng = np.random.default_rng(5)
    band_keys = simhash.Minhashes(simhash.BANDS, simhash.BAND_ROWS, 0)
    fine_keys = simhash.Minhashes(simhash.FINE_BANDS, simhash.FINE_ROWS, 1)
    missed = 0
    for n in (5, 10, 50, 400):
        for _ in range(100):
            both = rng.integers(0, 1 << 64, n, np.uint64)
            more = both[: n - n // 5]
            for keys in (band_keys, fine_keys):
                missed += not set(keys(np.sort(both))) & set(keys(np.sort(more)))
    assert missed == 0 and band_keys(np.empty(0, np.uint64)) == []


def test_candidates_come_from_fingerprints(spark, monkeypatch):
    """Similar texts are found by keys and distances of fingerprints: without minhashes the groups are the same."""
    monkeypatch.setattr(simhash, "Minhashes", None)
    texts = edited_texts(seed=8)
    first = brute_near(texts)
    groups = {r.id: r.root for r in simhash.similar_groups(docs_of(spark, list(enumerate(texts)))).collect()}
    for a in range(len(texts)):
        for b in range(a):
            assert (groups[a] == groups[b]) == (first[a] == first[b]), (texts[a], texts[b])


def test_tables_find_close_fingerprints():
    """Each pair at the least similarity is linked among strangers, in runs that are cut by keys and in one that isn't."""
    rng = np.random.default_rng(7)
    bits, tables = simhash.tables_for(4000)
    for n in (5, 25, 200):
        sets = [x for _ in range(100) for both in [rng.integers(0, 1 << 64, n, np.uint64)] for x in (both, both[: n - n // 5])]
        words = np.concatenate([np.array([simhash.wide_fingerprint(x) for x in sets]).view(np.uint64), rng.integers(0, 1 << 64, (1800, simhash.WORDS), np.uint64)])
        sizes = np.array([*map(len, sets), *[n] * 1800])
        for rows in (2000, 200):
            found = set()
            for t in range(tables):
                part = words[:rows, t % simhash.WORDS] >> np.uint64(t // simhash.WORDS * bits) & np.uint64((1 << bits) - 1)
                for own in range(1 << bits):
                    at = np.flatnonzero(part == own)
                    if len(at):
                        found |= {tuple(sorted(x)) for x in zip(*(at[x].tolist() for x in simhash.close_nodes(sizes[at], words[at], t, 0.8)), strict=True)}
            assert {(k, k + 1) for k in range(0, 200, 2)} <= found


def test_wide_fingerprint_begins_with_the_fingerprint():
    text = " ".join(f"w{k}" for k in range(5000))
    assert simhash.wide_fingerprint(np.unique(simhash.shingles(text, 5)))[0] == np.uint64(simhash.fingerprint(text, 5)).view(np.int64)
    assert simhash.wide_fingerprint(np.empty(0, np.uint64)).tolist() == [0] * simhash.WORDS


def test_only_wanted_texts_move(spark):
    """The join gets the wanted texts, and few others, from below."""
    texts = spark.createDataFrame([(k, f"text {k}") for k in range(2000)], "text_hash long, text string")
    for want in ({k for k in range(0, 2000, 40)}, set()):
        hashes = spark.createDataFrame([(k,) for k in want], "hash long")
        out = simhash.those_with(texts, hashes)
        assert {r.text_hash for r in out.collect()} == want
        assert "ArrowEvalPython" in out._jdf.queryExecution().optimizedPlan().children().head().toString()
        assert texts.where(simhash.passes(spark, simhash.filter_bits(hashes))(texts.text_hash)).count() <= len(want) + 20
