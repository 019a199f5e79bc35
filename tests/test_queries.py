"""Every registered query that has SQL, against that SQL."""

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings"
          " pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(table):
    cols = sorted(table.column_names)
    data = zip(*[table.column(c).to_pylist() for c in cols])
    return cols, sorted(repr(tuple(v + 0.0 if isinstance(v, float) else v for v in r))
                        for r in data)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = contract.queries()[name](spark, SF).toArrow()
    expected = duck.sql(contract.oracle_sql()[name]).to_arrow_table()
    assert rows(got) == rows(expected)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["loess_depth", "qa_logistic", "glmm_method", "gam_depth",
                                  "ranef_order"])
def test_query_without_sql_has_rows(spark, name):
    assert contract.queries()[name](spark, SF).count() > 0
