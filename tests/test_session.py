"""Scratch tables and package shipping."""

import os

import pytest
from pyspark.sql import functions as F

from driftline import session


class Conf:
    def __init__(self, folder):
        self.folder = folder

    def get(self, key, default=None):
        assert key == "spark.checkpoint.dir"
        return self.folder or default


class Stub:
    """A session as ``scratch_dir`` sees it."""

    def __init__(self, folder, master):
        self.conf = Conf(folder)
        self.sparkContext = type("Context", (), {"applicationId": "app-1", "master": master})


def test_scratch_follows_the_setting():
    assert session.scratch_dir(Stub("hdfs:///shared/", "yarn")) == "hdfs:///shared/app-1"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_dir(Stub(None, "spark://host:7077"))
    local = session.scratch_dir(Stub(None, "local[2]"))
    assert local.endswith("/app-1") and local == session.scratch_dir(Stub(None, "local[2]"))


def test_cut_lineage_writes_once_and_can_be_released(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "scratch")
    monkeypatch.setattr(session, "scratch_dir", lambda _: folder)
    df = session.cut_lineage(spark.range(5).selectExpr("id", "id * 2 AS b"))
    assert len(os.listdir(folder)) == 1 and df.count() == 5
    assert all("scratch" in f for f in df.inputFiles())
    assert session.release_scratch(spark) and not os.path.exists(folder)


def test_shuffle_files_go_with_the_query(spark):
    """Only while a table is written: the session's own setting comes back."""
    assert spark.conf.get(session.SHUFFLE_CLEANUP, None) in (None, "false")
    before = spark.conf.get(session.SHUFFLE_CLEANUP, None)
    df = session.cut_lineage(spark.range(1000).repartition("id").groupBy((F.col("id") % 7).alias("k")).count())
    assert df.count() == 7 and spark.conf.get(session.SHUFFLE_CLEANUP, None) == before


def test_a_replaced_table_can_be_dropped(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "scratch")
    monkeypatch.setattr(session, "scratch_dir", lambda _: folder)
    first = session.cut_lineage(spark.range(5))
    second = session.cut_lineage(first.selectExpr("id + 1 AS id"))
    session.drop_tables(first)
    assert len(os.listdir(folder)) == 1 and second.count() == 5
    with pytest.raises(ValueError):
        session.drop_tables(spark.range(3))


def test_workers_can_import_the_package(spark):
    def module(batches):
        import pandas as pd

        import driftline
        for _ in batches:
            yield pd.DataFrame({"name": [driftline.__name__]})
    got = spark.range(1).mapInPandas(module, "name string").collect()
    assert got[0]["name"] == "driftline"
