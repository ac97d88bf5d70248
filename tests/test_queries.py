"""Every query with an oracle gives the rows that DuckDB gives for its SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from skymesh.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 8) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted(tuple(norm(v) for v in r) for r in got.select(*(f"`{c}`" for c in cols)).collect())
    result = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted(tuple(norm(r[i]) for i in at) for r in result.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["rf_attribution", "rf_quantiles", "perm_importance"])
def test_every_held_out_year_is_done(spark, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    rows = catalog.ml_rows(spark, SF).toPandas()
    years = set(rows.year) & set(range(1995, 2002))
    assert set(got.fold) == years
    if name != "perm_importance":
        each = got.drop_duplicates([*catalog.ROW_KEY, "fold"])
        assert each.groupby("fold").size().to_dict() == rows[rows.year.isin(years)].groupby("year").size().to_dict()
    if name == "rf_quantiles":
        assert len(got) == len(each) and got[["q_0_05", "q_0_5", "q_0_95"]].isin(set(rows.target)).all().all()
