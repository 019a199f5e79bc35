"""Class bins of the summary tables and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions.rsem import ColumnLike, _c, cut, last_match, level_index

INF = float("inf")

# --- fixed values: bin labels and map level orders -----------------------------------

FO_MAP_LEVELS = ("NA", "<.10", ".11-.20", ".21-.30", ".31-.40", ".41-.50", ".71-.80", "1")
STUDY_MAP_LEVELS = ("NA", "1", "2-5", "6-10", ">10")
FISH_MAP_LEVELS = ("NA", "< 10", "10-50", "51-100", "101-500", "501-1000", "1001-1500", ">1500")

# ------------------------------------------------------------------------------------


def study_class(n: ColumnLike) -> Column:
    """1 = one study, 2 = two or three, 3 = more."""
    return cut(n, [0, 1, 3, INF], [1.0, 2.0, 3.0])


def commercial_class(share: ColumnLike) -> Column:
    return cut(share, [-INF, 0.01, 0.25, INF], ["None", "Minor", "Commercial"])


def vulnerability_class(score: ColumnLike) -> Column:
    return cut(score, [-INF, 20, 40, 60, 80, INF],
               ["low", "low-moderate", "moderate-high", "high-very high", "very high"])


def fo_bin(fo: ColumnLike, faithful: bool = False) -> Column:
    """Decile label of a frequency of occurrence.

    The published rule writes 20 for .20 in its second line; ``faithful`` keeps that
    slip, whose net effect is that (.99, 1) and values above 1 are labelled .11-.20.
    """
    x = _c(fo)
    rules = [(x <= 0.10, "<.10"), ((x > 0.10) & (x <= (20 if faithful else 0.20)), ".11-.20")]
    for k in range(2, 10):
        lo, hi = k / 10, (0.99 if k == 9 else (k + 1) / 10)
        rules.append(((x > lo) & (x <= hi), f".{k}1-.{99 if k == 9 else (k + 1) * 10}"))
    rules.append((x == 1, "1"))
    return last_match(rules)


def studies_bin(n: ColumnLike) -> Column:
    """Study-count label; exactly 10 falls in the open top class."""
    x = _c(n)
    return last_match([
        (x == 1, "1"), ((x > 1) & (x <= 5), "2-5"), ((x > 5) & (x <= 10), "6-10"),
        (x >= 10, ">10")])


def _size_rules(x: Column) -> list[tuple[Column, str]]:
    return [
        ((x >= 10) & (x <= 50), "10-50"), ((x > 50) & (x <= 100), "51-100"),
        ((x > 100) & (x < 500), "101-500"), ((x > 500) & (x <= 1000), "501-1000"),
        ((x > 1000) & (x <= 1500), "1001-1500"), (x > 1500, ">1500")]


def fish_bin(n: ColumnLike) -> Column:
    """Individuals label; exactly 500 and counts up to 1 have none."""
    x = _c(n)
    return last_match([((x > 1) & (x < 10), "< 10"), *_size_rules(x)])


def normalized_bin(v: ColumnLike) -> Column:
    """Label of frequency times individuals; exactly 500 and values below 1 have none."""
    x = _c(v)
    return last_match([((x >= 1) & (x < 25), "< 10"), *_size_rules(x)])


def pollution_bin(v: ColumnLike) -> Column:
    """Power-of-ten label; 1e5 to 1e6 is "10e6" because the later assignment wins."""
    x = _c(v)
    rules = [((x >= 10.0 ** k) & (x < 10.0 ** (k + 1)), f"10e{k}") for k in range(6)]
    return last_match([*rules, (rules[5][0], "10e6"), (x >= 1e6, ">10e6")])


def risk_quadrant(fo: ColumnLike, n: ColumnLike, fo_cut: float = 0.25, n_cut: int = 10) -> Column:
    """Incidence by sample size: the four corners of the risk plot."""
    high, rich = _c(fo) >= fo_cut, _c(n) >= n_cut
    return (F.when(high & rich, "high incidence, data rich")
            .when(high & ~rich, "high incidence, data poor")
            .when(~high & rich, "low incidence, data rich")
            .when(~high & ~rich, "low incidence, data poor"))


def map_level(label: ColumnLike, levels: tuple[str, ...]) -> Column:
    """Position of a bin label on a map legend; labels off the legend are null."""
    return level_index(label, levels)
