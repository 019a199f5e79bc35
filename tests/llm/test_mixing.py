import duckdb

from conftest import documents
from driftline.llm import mixing
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "domain", "lang", "source", "n_tokens", "epoch"]


def test_matches_sql_with_odd_rows(docs, no_docs):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    expected = con.sql(mixing.mix_sql()).to_arrow_table().select(COLUMNS).to_pylist()
    got = mixing.mixed_documents(docs.sparkSession, docs).select(COLUMNS).collect()
    assert sorted(map(repr, (tuple(r.values()) for r in expected))) == sorted(repr(tuple(r)) for r in got)
    assert got and mixing.mixed_documents(docs.sparkSession, no_docs).count() == 0


def test_work_setting_never_shows(docs, monkeypatch):
    levels = [mixing.domain_of(F.col("source")), F.col("lang"), F.col("source")]
    once = sorted(map(repr, mixing.mix(docs, levels, mixing.WEIGHTS).select(COLUMNS).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    assert once == sorted(map(repr, mixing.mix(docs, levels, mixing.WEIGHTS).select(COLUMNS).collect()))


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "x", 1, 10), ("a", "y", 1, 1000), ("b", "x", 1, 1000)], "_l0 string, _l1 string, _docs long, _tokens long")
    got = {(r._l0, r._l1): r._budget for r in
           mixing.leaf_budgets(leaves, 2, {("a",): 1.0, ("b",): 1.0}, 400 / 2010, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 200}
    short = spark.createDataFrame([("a", "x", 1, 10), ("a", "y", 1, 20), ("b", "x", 1, 1000)], leaves.schema)
    got = {(r._l0, r._l1): r._budget for r in mixing.leaf_budgets(short, 2, {}, 400 / 1030, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 370}
    none = {(r._l0, r._l1): r._budget for r in mixing.leaf_budgets(short, 2, {("b",): 0.0}, 400 / 1030, 1).collect()}
    assert none == {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 0}


def test_prefix_keeps_to_the_budget(docs, clashing):
    rows = mixing.mixed_documents(docs.sparkSession, docs)
    total = sum(len((t or "").encode().split()) for _, t in documents())
    assert rows.agg(F.sum("n_tokens")).first()[0] <= total * mixing.SHARE
    odd = mixing.mixed_documents(docs.sparkSession, clashing)
    assert odd.count() == rows.count() and set(odd.columns) == set(clashing.columns) | set(rows.columns)
