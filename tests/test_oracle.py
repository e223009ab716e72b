"""End-to-end: every registered query against its DuckDB oracle at sf0.001 (same check as the driver's)."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

from __spark_entry__ import entry
from chatlens.plans.oracle import oracle_sql
from chatlens.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 6))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns[:3] == ["department", "ordinal", "month_label"] and df.count() >= 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert _canon(df.columns, rows) == _canon(dcols, drows)


def test_every_query_registered_has_oracle_or_is_iterative():
    assert set(QUERIES) - set(oracle_sql()) == {"prompt_clusters"}


def test_registered_queries_have_no_row_caps(spark):
    """Every registered query reads its tables whole: no Limit or Sample in the optimized plan."""
    for name, fn in QUERIES.items():
        plan = fn(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        features = name in ("prompt_terms", "prompt_tfidf", "prompt_clusters")  # the vocabulary's cut is the feature
        assert (features or "Limit" not in plan) and "Sample" not in plan, name


SAME_TYPE = {("string", "VARCHAR"), ("bigint", "BIGINT"), ("double", "DOUBLE"), ("boolean", "BOOLEAN"),
             ("date", "DATE")}


def test_column_types_match_oracle(spark, duck):
    for name, sql in oracle_sql().items():
        spark_types = dict(QUERIES[name](spark, SF).dtypes)
        rel = duck.sql(sql)
        duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
        for col, st in spark_types.items():
            assert (st, duck_types.get(col)) in SAME_TYPE, (name, col, st, duck_types.get(col))
