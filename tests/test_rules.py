"""Missing-value rules on tiny hand-made frames."""

import pytest
from pyspark.sql import functions as F

from driftline.functions import binning, recode, rsem, text


def one(df, *cols):
    return df.agg(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_sums_and_ratio(spark):
    df = spark.createDataFrame([("a", None, None), ("b", 1, 0), ("b", 2, None), ("c", 3, 6)],
                               "g string, k long, n long")
    got = {r["g"]: r for r in df.groupBy("g").agg(
        rsem.sum_skip_null("k").alias("skip"), rsem.sum_strict("n").alias("strict"),
        rsem.frequency("k", "n").alias("fo"), rsem.frequency_strict("k", "n").alias("fs")
    ).collect()}
    assert got["a"]["skip"] == 0 and got["a"]["strict"] is None and got["a"]["fo"] is None
    assert got["b"]["skip"] == 3 and got["b"]["strict"] is None and got["b"]["fo"] is None
    assert got["c"]["fo"] == got["c"]["fs"] == 0.5


def test_weighted_mean(spark):
    df = spark.createDataFrame([(1.0, 2.0), (4.0, 1.0), (None, 3.0)], "x double, w double")
    strict, skip = one(df, rsem.weighted_mean("x", "w"), rsem.weighted_mean("x", "w", True))
    assert strict is None and skip == 2.0
    zero = spark.createDataFrame([(1.0, 2.0), (None, 0.0)], "x double, w double")
    assert one(zero, rsem.weighted_mean("x", "w"))[0] == 1.0
    lost = spark.createDataFrame([(1.0, 2.0), (2.0, None)], "x double, w double")
    assert one(lost, rsem.weighted_mean("x", "w", True))[0] is None


def test_distinct_counts_null_and_error_of_one_row(spark):
    df = spark.createDataFrame([("x", 1.0), (None, None), (None, None)], "s string, v double")
    n, se = one(df, rsem.n_distinct("s"), rsem.standard_error("v"))
    assert n == 2 and se is None


def test_first_keeps_null(spark):
    df = spark.createDataFrame([(2, "b"), (1, None), (3, "c")], "i int, v string")
    assert one(df, rsem.first_by("v", "i"))[0] is None
    pair = one(df, rsem.first_by(F.struct("v", "i"), F.struct("i")))[0]
    assert pair["v"] is None and pair["i"] == 1


def test_set_membership_with_null(spark):
    df = spark.createDataFrame([("sp.",), (None,), ("a",)], "s string")
    assert {r.s for r in df.filter(rsem.not_in("s", ["sp."])).collect()} == {None, "a"}
    assert {r.s for r in df.filter(rsem.in_or_null("s", ["a"])).collect()} == {None, "a"}


def test_if_else_stays_null(spark):
    df = spark.createDataFrame([(1,), (3,), (None,)], "v int")
    got = [r[0] for r in df.select(rsem.if_else(F.col("v") > 2, F.lit("y"), F.lit("n"))).collect()]
    assert got == ["n", "y", None]


@pytest.mark.parametrize("n, label", [(None, None), (0, None), (1, 1.0), (2, 2.0), (3, 2.0),
                                      (4, 3.0)])
def test_study_class(spark, n, label):
    df = spark.createDataFrame([(n,)], "n long")
    assert df.select(binning.study_class("n")).first()[0] == label


def check_bins(spark, fn, cases):
    df = spark.createDataFrame([(float(x),) for x, _ in cases], "x double")
    assert [r[0] for r in df.select(fn(F.col("x"))).collect()] == [label for _, label in cases]


def test_bins_at_their_edges(spark):
    check_bins(spark, binning.fo_bin, [
        (0.10, "<.10"), (0.11, ".11-.20"), (0.2, ".11-.20"), (0.6, ".51-.60"), (0.99, ".91-.99"),
        (0.995, None), (1, "1"), (1.2, None)])
    check_bins(spark, lambda c: binning.fo_bin(c, faithful=True), [
        (0.25, ".21-.30"), (0.995, ".11-.20"), (1, "1"), (3, ".11-.20")])
    check_bins(spark, binning.studies_bin, [(1, "1"), (5, "2-5"), (9, "6-10"), (10, ">10")])
    check_bins(spark, binning.fish_bin, [
        (1, None), (2, "< 10"), (10, "10-50"), (50, "10-50"), (100, "51-100"), (500, None),
        (501, "501-1000"), (1500, "1001-1500"), (1501, ">1500")])
    check_bins(spark, binning.normalized_bin, [
        (0.5, None), (1, "< 10"), (9.9, "< 10"), (10, "10-50"), (25, "10-50"), (500, None)])
    check_bins(spark, binning.pollution_bin, [
        (0.5, None), (6.024, "10e0"), (31.2, "10e1"), (999, "10e2"), (1e4, "10e4"),
        (110895.2, "10e6"), (8335796.5, ">10e6")])
    check_bins(spark, binning.vulnerability_class, [
        (20, "low"), (20.1, "low-moderate"), (80, "high-very high"), (81, "very high")])
    check_bins(spark, binning.commercial_class, [(0, "None"), (.01, "None"), (.25, "Minor"),
                                                 (.26, "Commercial")])


def test_names(spark):
    df = spark.createDataFrame([("Gadus morhua",), ("Gadus",), ("Aa bb cc",), (None,)], "b string")
    rows = df.select(text.genus("b"), text.species("b"), text.abbreviate("b")).collect()
    assert [tuple(r) for r in rows] == [
        ("Gadus", "morhua", "G. morhua"), ("Gadus", None, "G.NA"), ("Aa", "bb", "A. bb cc"),
        (None, None, None)]
    tips = spark.createDataFrame([("Gadus_morhua_ott12",), ("mrcaott1",)], "t string")
    assert [r[0] for r in tips.select(text.clean_tip("t")).collect()] == ["Gadus morhua", None]


def test_recodes(spark):
    df = spark.createDataFrame(
        [("estuarine", None), ("marine", "coastal"), ("marine", "oceanic"), ("marine", None),
         (None, "coastal")], "w string, a string")
    got = [r[0] for r in df.select(recode.adjacency_water("w", "a")).collect()]
    assert got == ["estuarine", "coastal", "oceanic", None, None]
    codes = spark.createDataFrame([("NAST E",), ("MEDI",), (None,)], "c string")
    assert [r[0] for r in codes.select(recode.repair_province("c")).collect()] == [
        "NASE", "MEDI", None]
    assert [r[0] for r in codes.select(recode.coastal_flag("c")).collect()] == [0, 1, None]
    assert len(recode.COASTAL_PROVINCES) == 31
    gear = spark.createDataFrame([("rapido trawl",), ("beach seine",), ("pot",)], "e string")
    assert [r[0] for r in gear.select(recode.gear("e")).collect()] == ["trawling", "seines", None]
    base = spark.createDataFrame([("Benthic foraging",), ("x",)], "f string")
    assert [r[0] for r in base.select(recode.with_baseline("f", "Benthic foraging")).collect()
            ] == ["aaBenthic foraging", "x"]


def test_quality_flags_treat_null_as_absent(spark):
    df = spark.createDataFrame(
        [("3", None, "no", "yes", 0.1), ("1", "FTIR", "yes", None, None)],
        "method_type string, polymer_confirmation string, blanks_used string,"
        " clean_lab_procedures_used string, smallest_detection_size_limits_mm double")
    rows = df.select(*[c.alias(n) for n, c in recode.quality_flags().items()]).collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0, 1, 1, 2), (0, 1, 1, 0, 0, 2)]


def test_log_of_zero_is_null(spark):
    df = spark.createDataFrame([(0.0,), (100.0,)], "x double")
    assert [r[0] for r in df.select(rsem.log_or_null("x", base10=True)).collect()] == [None, 2.0]
