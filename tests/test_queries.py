"""Every query with SQL, against DuckDB on the smallest tables, and the others for their rows."""

import glob
import os

import duckdb
import pytest

from tidemark.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
SLOW = {"f10_search", "i8_fitted_leaderboard", "i7_fitted_leaders", "l10_fitted_importance", "h10_run_single", "h11_run_multi", "i4_stacked_ensemble", "i5_cross_validation"}


@pytest.fixture(scope="module")
def tables(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def canonical(df, columns):
    def text(v):
        if v is None or v != v or str(v) in ("<NA>", "NaT"):
            return "null"
        if isinstance(v, (bool, str)):
            return str(v)
        return repr(float(v)) if not hasattr(v, "isoformat") else v.isoformat()

    return sorted(tuple(text(v) for v in row) for row in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, tables, name):
    mine, theirs = QUERIES[name](spark, sf_dir).toPandas(), tables.sql(SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    assert canonical(mine, columns) == canonical(theirs, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(3).count() > 0


def test_entry(spark, sf_dir):
    assert catalogue.entry(spark, sf_dir).count() > 0


def test_names_belong_together():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 90
