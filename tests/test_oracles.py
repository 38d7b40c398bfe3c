"""Every query over the log against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from siltlog.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def sql():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return db


def rows(frame, columns):
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(str, plain.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sql, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = sql.execute(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


def test_crc_is_ieee(spark):
    import zlib

    got = QUERIES["entry_crc32"](spark, DATA).limit(5).collect()
    from siltlog.sources.log import load_log

    by = {(r.file_id, r.pos): r for r in load_log(spark, DATA).collect()}
    for r in got:
        e = by[(r.file_id, r.pos)]
        assert r.crc == zlib.crc32((e.bucket + e.key + e.value).encode())
