"""Queries with SQL against it, and the pipeline's stages against their operators, on the smallest tables."""

from __future__ import annotations

import os
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest

from siltlog.llm import exact_dedup, secrets, simhash, toxicity
from siltlog.llm.queries import ORACLES, QUERIES

from .test_operators import brute_base, brute_entropy
from .test_similar import brute_near

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = db.execute(ORACLES[name]).df()
    columns = sorted(want.columns)
    got = QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == columns
    plain = lambda df: sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))
    assert plain(got) == plain(want)


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    everything = {r.doc_id: r.text for r in docs.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        after_df = stage(spark, kept, DATA)
        assert after_df.columns == docs.columns
        after = {r.doc_id: r.text for r in after_df.collect()}
        assert set(after) <= set(before)
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
            scores = {r.id: r.score for r in toxicity.score(docs, model).collect()}
            assert set(after) == {k for k in before if scores[k] < 0.5}
        elif name == "exact_dedup":
            by = {}
            for k, t in before.items():
                by[t] = max(k, by.get(t, k))
            assert set(after) == set(by.values())
        elif name == "simhash_near_dedup":
            ids = sorted(before)
            assert set(after) == {ids[k] for k in brute_near([before[k] for k in ids])}
        else:
            found = secrets.spans(kept).where("size(base) + size(added) > 0")
            assert {k for k in before if before[k] != after[k]} == {r.id for r in found.select("id").collect()}
            assert set(after) == set(before)
        kept = spark.createDataFrame(after_df.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, DATA)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}
    assert set(everything) >= {r.doc_id for r in kept.collect()}


def test_stages_of_odd_rows(spark):
    """Null texts and identifiers, repeated rows, one identifier with two texts, columns named as inner ones are."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, digest string, gone_id long, _text string, root long"
    rows = [(1, None, "x"), (1, None, "x"), (1, "", "x"), (None, "", None), (2, "a b", "y"), (3, "a b", "z"), (None, "a b", None), (3, "c d e f g h", "z"), (None, "lone", None)]
    docs = spark.createDataFrame([(k, t, None, None, None, c, None, c, None) for k, t, c in rows], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert sorted((r.doc_id, r.text or "") for r in docs.where("doc_id IS NOT NULL").collect()) == [(1, ""), (3, "a b"), (3, "c d e f g h")]
    assert [r.text for r in docs.where("doc_id IS NULL").collect()] == ["lone"]


def test_near_stage_alone(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(2, "a b c d e"), (1, "A b c d e"), (1, "a b C d e"), (1, "A b c d e"), (None, "a b c d E"), (9, "other words stand in this text here")]
    out = simhash.stage(spark, spark.createDataFrame([(k, t, None, None, None) for k, t in rows], schema), DATA).collect()
    assert len(out) == 2 and {r.doc_id for r in out} == {1, 9}


def test_pipeline_of_no_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_run_equals_plain_python(spark, tmp_path):
    """run() over a table with nulls, copies, near copies, secrets, long texts and repeated rows."""
    from tokenizers import Tokenizer

    given = spark.read.parquet(f"{DATA}/documents.parquet")
    some = given.where("doc_id < 80").collect()
    lang, source = some[0].lang, some[0].source
    row = lambda k, t: (k, t, lang, source, len(t or ""))
    words = [f"w{k * 7919 % 1009}" for k in range(300)]
    odd = [row(9001, None), row(9002, ""), row(9003, " ".join(words)), row(9004, " ".join([*words[:150], "changed", *words[151:]])), row(9005, " ".join(words))]
    odd += [row(9006, "the password=abcdefgh12 of it"), row(9007, "x " + " " * 60_000 + "long run"), row(9008, "tail " * 30_000), row(9003, " ".join(words))]
    docs = spark.createDataFrame([*map(tuple, some), *odd], given.schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    read = toxicity.Reader(model.lexicon)
    kept = {(r.doc_id, r.text) for r in docs.collect() if model.logit(*read(r.text)) < 0}
    last = {}
    for k, t in kept:
        last[t or ""] = max(k, last.get(t or "", k))
    kept = sorted((k, t) for t, k in last.items())
    first = brute_near([t for _, t in kept])
    kept = [x for k, x in enumerate(kept) if first[k] == k]
    reader, size, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 2048, []
    for k, text in kept:
        done, out = 0, ""
        for _, a, b in sorted([*brute_base(text), *brute_entropy(text, brute_base(text))], key=lambda s: s[1:]):
            if a >= done:
                out += text[done:a] + "<secret>"
            done = max(done, b)
        ids = [*reader.encode(out + text[done:], add_special_tokens=False).ids, 0]
        edges = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
        for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want.append((k, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
