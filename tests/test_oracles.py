"""Every query with SQL agrees with DuckDB on the smallest tables, and all of them run."""

import math

import duckdb
import pytest

from veriflume import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return float(f"{float(v):.6g}") if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    return sorted((tuple(cell(r[c]) for c in sorted(df[0])) for r in df), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = [r.asDict() for r in catalog.QUERIES[name](spark, DATA).collect()]
    if name not in catalog.ORACLES:
        assert got
        return
    rel = duck.sql(catalog.ORACLES[name])
    want = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    assert len(got) == len(want)
    if want:
        assert rows(got) == rows(want)
