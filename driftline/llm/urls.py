"""URL filter: allow and block rules, and a ratio of two character models for the rest.

A rule names a host with its subdomains and a path prefix; the longest fitting rule decides.
Where none fits, two smoothed variable-order Markov models (up to three symbols of context,
Witten-Bell interpolation) learned from all URLs that the rules accept and reject are compared:
the log-likelihood difference per symbol against a threshold that balances the two error rates on
the ruled URLs.  Symbols come from an alphabet of 40, so a model has at most 40^4 counts,
whatever the number of URLs.

The models read the whole URL after its scheme, query and fragment included; rules and output have host and path.

Defined cases: a URL without ``://`` has empty host and path and is scored on all of its text; a null URL is
scored as an empty string; repeated rows are judged alike; without URLs of both verdicts the score is 0 and
the threshold 0, so that all others are allowed; a score equal to the threshold is allowed; of equally good thresholds the middle is
taken; a very long URL is scored whole; an empty table gives no rows; only page_id and url are read, other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import ascii_lower, byte_chunks, table

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
ORDER, N_SYMBOLS, BINS = 3, 40, 2000
START, END, OTHER = 37, 38, 39

_SYMBOL = np.full(256, OTHER, np.int64)
_SYMBOL[97:123] = np.arange(26)
_SYMBOL[65:91] = np.arange(26)
_SYMBOL[48:58] = 26                                   # any digit
for _i, _c in enumerate("/.-_?=&%~:"):
    _SYMBOL[ord(_c)] = 27 + _i


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; ``rules`` is a short, fixed list."""
    name = verdict = None
    for kind, rule in sorted(rules, key=lambda r: -len(r[1])):
        top, slash, rest = rule.partition("/")
        fits = ((host == top) | host.endswith("." + top)) & path.startswith(slash + rest)
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return name, verdict


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each symbol with its context into a 40^4 table, and the text of each.

    Every text is followed by an end symbol and starts after three start symbols.
    """
    n = offsets.size - 1
    size = np.diff(offsets) + 1 + ORDER
    at = np.concatenate([[0], np.cumsum(size)])
    symbols = np.full(at[-1], START, np.int64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    symbols[np.arange(data.size) - offsets[row] + at[row] + ORDER] = _SYMBOL[data]
    symbols[at[1:] - 1] = END
    code = symbols[ORDER:].copy()
    for k in range(1, ORDER + 1):
        code += symbols[ORDER - k:symbols.size - k] * N_SYMBOLS ** k
    real = np.ones(symbols.size, bool)
    for k in range(ORDER):
        real[at[:-1] + k] = False
    owner = np.repeat(np.arange(n), np.diff(offsets) + 1)
    return code[real[ORDER:]], owner


def count_grams(urls: DataFrame) -> DataFrame:
    """(kind, code, n) over all rows of ``urls`` (text, kind 0 or 1)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, N_SYMBOLS ** (ORDER + 1)), np.int64)
        for b in batches:
            kind = b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in byte_chunks(b.column(0)):
                code, owner = codes(data, offs)
                np.add.at(total, (kind[lo:hi][owner], code), 1)
        k, c = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(c), pa.array(total[k, c])],
                                         ["kind", "code", "n"])

    return (urls.select("text", "kind").mapInArrow(count, "kind int, code long, n long")
            .groupBy("kind", "code").agg(F.sum("n").alias("n")))


def smooth(counts: np.ndarray) -> np.ndarray:
    """Probabilities of the last symbol after up to three others, by Witten-Bell interpolation."""
    p = np.full(N_SYMBOLS, 1 / N_SYMBOLS)
    for k in range(ORDER + 1):
        n = counts.reshape(-1, *[N_SYMBOLS] * (k + 1)).sum(0).astype(float)
        total, kinds = n.sum(-1, keepdims=True), (n > 0).sum(-1, keepdims=True)
        # the context one symbol shorter drops the oldest symbol, the first axis
        p = np.where(total > 0, (n + kinds * p) / np.maximum(total + kinds, 1), p)
    return p


def _model(counted: list) -> np.ndarray | None:
    counts = np.zeros((2, N_SYMBOLS ** (ORDER + 1)), np.int64)
    for kind, code, n in counted:
        counts[kind, code] = n
    if (counts.sum(1) == 0).any():
        return None
    return (np.log(smooth(counts[1])) - np.log(smooth(counts[0]))).ravel().astype(np.float32)


def ratio(texts: DataFrame, model: np.ndarray | None) -> DataFrame:
    """``texts`` with ``score``: log-likelihood difference of ``text`` per symbol."""
    if model is None:
        return texts.withColumn("score", F.lit(0.0))
    shared = texts.sparkSession.sparkContext.broadcast(model)      # 40^4 floats: 10 MB

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        out = np.zeros(len(text))
        for lo, hi, data, offs in byte_chunks(pa.array(text, pa.large_string(), from_pandas=True)):
            code, owner = codes(data, offs)
            sums = np.bincount(owner, shared.value[code].astype(float), hi - lo)
            out[lo:hi] = sums / (np.diff(offs) + 1)
        return pd.Series(out)

    return texts.withColumn("score", scored("text"))


def threshold(scored: DataFrame) -> float:
    """Score that balances the error rates of ``scored`` (kind, score), to 1/100."""
    bins = np.zeros((2, 2 * BINS + 1))
    for kind, b, n in (scored.groupBy("kind", F.least(F.greatest(F.floor(F.col("score") * 100), F.lit(-BINS)), F.lit(BINS))
                                      .cast("int").alias("b")).agg(F.count("*").alias("n")).collect()):
        bins[kind, b + BINS] = n
    if (bins.sum(1) == 0).any():
        return 0.0
    share = bins / bins.sum(1, keepdims=True)
    missed = np.concatenate([[0], np.cumsum(share[1])])              # accepted URLs below the cut
    passed = 1 - np.concatenate([[0], np.cumsum(share[0])])          # rejected URLs from the cut on
    error = missed + passed
    best = np.flatnonzero(error <= error.min() + 1e-12)
    cuts = (np.arange(error.size) - BINS) / 100
    return float((cuts[best[0]] + cuts[best[-1]]) / 2)


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of ``pages`` (page_id, url)."""
    host, path = host_path(F.col("url"))
    at = F.instr("url", "://")
    text = F.coalesce(F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise(F.col("url")), F.lit(""))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), text.alias("text"))
    rule, ruled = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), ruled.alias("ruled"))
    taught = (rows.where("ruled is not null")
              .select("text", (F.col("ruled") == "allow").cast("int").alias("kind")))
    model = _model(count_grams(taught).collect())                    # at most 2 x 40^4 rows
    cut = threshold(ratio(taught, model))
    return ratio(rows, model).select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("score") >= cut, "allow").otherwise("block")).alias("verdict"), "score")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every url of ``pages``."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))


QUERIES = {"op5_urls": op5_urls}
