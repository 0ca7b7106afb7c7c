"""Every query with SQL gives DuckDB's rows; the others give rows."""

import os

import duckdb
import pytest

from tidelock import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.sql(f"create view {t.split('.')[0]} as select * from '{sf_dir}/{t}'")
    return c


def test_every_default_cutoff_is_perturbed(spark, sf_dir):
    rows = catalog.queries()["perturb_extreme_diff"](spark, sf_dir).groupBy("strategy").count().collect()
    assert {r["strategy"]: r["count"] for r in rows} == {"trailing_mean": 40, "next_close": 40}  # 8 cutoffs, 5 schemes


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, sf_dir, duck, name):
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    expected = duck.sql(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(expected.columns) and len(got) == len(expected)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, expected))
    assert not ((a.astype(str) != b.astype(str)) & ~(a.isna() & b.isna())).any(axis=None)
