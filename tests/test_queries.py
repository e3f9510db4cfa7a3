"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(data):
    return Counter(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in data)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(name, spark, sf, duck):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    want = duck.sql(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()
    assert rows(tuple(r) for r in df.select(*cols).collect()) == rows(want)


def test_entry(spark):
    if not os.path.isdir(entry.SMALL):
        pytest.skip("no test tables here")
    assert entry.entry(spark).count() > 0


def test_json_of_every_stream_is_decoded(spark, sf, duck):
    got = {}
    for r in entry.queries()["source_json"](spark, sf).collect():
        got[r.stream_name] = got.get(r.stream_name, 0) + r.n
        assert r.id is not None and any(v is not None for k, v in r.asDict().items() if k.startswith("total_"))
    want = duck.sql("select stream_name, count(*) from produced_record where partition_id is not null group by 1").fetchall()
    assert got == dict(want) and len(got) > 3
