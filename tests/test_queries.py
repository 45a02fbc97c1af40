"""Every query with SQL equals it on the smallest tables; the engine that checks is DuckDB."""

import glob
import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from docketry.plans import core_problems, lists, records, statistics

FOLDER = "/root/testdata/sf0.001"
#: Queries that the smallest tables say too little for.
LARGER = {"p3_zone_recall": "/root/testdata/sf0.01"}
QUERIES = {n: f for m in (statistics, records, lists, core_problems) for n, f in m.QUERIES.items()}
ORACLE = {n: s for m in (statistics, records, lists, core_problems) for n, s in m.ORACLE.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    out = {}
    for folder in {FOLDER, *LARGER.values()}:
        out[folder] = duckdb.connect()
        for p in glob.glob(folder + "/*.parquet"):
            out[folder].sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return out


def plain(df):
    df = df[sorted(df.columns)]
    text = lambda v: "null" if v is None or v is pd.NA or v != v else f"{v:.6g}" if isinstance(v, float) else f"{float(v):.6g}" if type(v).__name__.startswith(("int", "Int")) else str(v)
    return sorted(tuple(text(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    folder = LARGER.get(name, FOLDER)
    got = QUERIES[name](spark, folder).toPandas()
    if name in ORACLE:
        want = duck[folder].sql(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
