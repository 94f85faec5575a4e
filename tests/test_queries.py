import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from srcgraph.plans import catalogue, trees  # noqa: F401 - trees adds its queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return db


def _norm(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return str(round(v, 6) + 0.0) if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    rel = duck.sql(catalogue.ORACLE[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert _norm(got) == _norm([tuple(r[i] for i in at) for r in rel.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).columns and set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_files(spark):
    plan = catalogue.QUERIES["find_definitions"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema") :]
    assert "p_retailprice" not in read
