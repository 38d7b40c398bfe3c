"""Classes of the words beyond the frequent ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siltlog.llm import lm

from .test_operators import docs_of


def alternating(n=300):
    """Texts in which words of kind a and kind b take turns; 40 words of each kind, and one rare word a text."""
    rnd = random.Random(4)
    return [(k, " ".join(rnd.choice("ab"[j % 2 :][:1]) + str(min(rnd.randrange(40), rnd.randrange(40))) for j in range(40)) + f" rare{k}") for k in range(n)]


@pytest.mark.parametrize("dictionary_words", [200_000, 30, 10])
def test_words_beyond_the_frequent_have_classes(spark, dictionary_words):
    docs = docs_of(spark, alternating())
    counts, words, model = lm.train(docs.select("text"), 300, dictionary_words=dictionary_words, frequent_words=10, classes=2)
    classes = {bytes(r.word): r["class"] for r in counts.collect()}
    classes |= {w: int(model.of[k]) if model.of[k] != model.open_class else None for w, k in words.number.items()}
    assert all(classes[f"rare{k}".encode()] is None for k in range(300))
    seen = {w: c for w, c in classes.items() if not w.startswith(b"rare")}
    often = {bytes(r.word) for r in counts.where("c >= 20").collect()}
    assert len(often) > 60
    for kind in (b"a", b"b"):
        assert len({seen[w] for w in often if w.startswith(kind)}) == 1
    assert len({seen[w] for w in often}) == 2
    assert all(seen[w] is None for w in set(seen) - often)


def test_scores_with_classes_do_not_depend_on_the_dictionary(spark):
    docs = docs_of(spark, alternating())
    got = [sorted((r.id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs, dictionary_words=n, frequent_words=10, classes=2).collect()) for n in (10, 30, 200_000)]
    assert got[0] == got[1] == got[2]


def test_classes_raise_held_out_scores(spark):
    docs = docs_of(spark, alternating())
    of = lambda **x: lm.score(docs, frequent_words=10, classes=2, **x).where("held_out").agg(F.sum("score")).first()[0]
    assert of() > of(least_count=1 << 40) + 10
