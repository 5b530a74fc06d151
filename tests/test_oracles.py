"""Every query with SQL against DuckDB over the smallest tables."""

import datetime
import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "-"
    if isinstance(v, bool) or type(v).__name__.startswith("bool"):
        return str(bool(v))
    if isinstance(v, (int, float)) or type(v).__name__.startswith(("int", "float")):
        return f"{round(float(v), 6) + 0.0:.6f}"
    if isinstance(v, datetime.date):
        return pd.Timestamp(v).isoformat()
    return str(v)


def rows(df: pd.DataFrame) -> list:
    columns = sorted(df.columns)
    return sorted(tuple(map(cell, r)) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql()))
def test_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF)
    got = pd.DataFrame([tuple(r) for r in got.collect()], columns=got.columns)
    cursor = con.execute(entry.oracle_sql()[name])
    want = pd.DataFrame(cursor.fetchall(), columns=[d[0] for d in cursor.description])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["name", "n_sites", "least_gap"] and df.count() > 0


def test_no_nested_loops(spark):
    for name in ("covering_products", "match_nearest_year", "revisit_pairs", "exclude_within_radius", "knn_spatial"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
