"""Language identification by interpolated Kneser-Ney character models, one per language.

Texts are read as symbols: letters in lower case, any run of other characters as one space, one space
before and after.  n-grams of up to ORDER symbols are counted per language.  The longest n-grams
keep their counts; shorter ones count their different left neighbours (the text's start is one).
With discount D = n1 / (n1 + 2 n2) per language and order,

    p(w | h) = max(c(hw) - D, 0) / c(h.) + D kinds(h.) / c(h.) * p(w | h without its first symbol),

down to a uniform share for each symbol.  The counts are Spark aggregations.  The model is one sorted
array of 64-bit n-gram hashes per order, with a row per n-gram that holds, for each language, the first
term (of the n-gram as hw) and the factor of the second (of the n-gram as h); a bucket index of
the leading bits stands in for the first steps of the binary search.

A text gets the language of least cross-entropy per symbol.  Part of the learning rows is kept from
the counts and calibrates, whole and in short pieces: the text is ``rejected`` where its cross-entropy lies above REJECT_AT of
those of its language at its length, and ``score`` is the fitted probability that the language is right.

The model is learnt from about SAMPLE characters, spread evenly over the languages: rows are taken by a
seeded hash of id and text, at the share that gives this number.  So it has at most ORDER * SAMPLE
n-grams and 8 bytes per n-gram and language, whatever the corpus; the broadcast is bounded by that.

Defined cases: a null text or one without letters is ``und`` with score 0 and rejected; rows with null
language teach nothing; rows with a null id are learnt from and scored (not held out); repeated rows are
learnt from and scored each; ties of cross-entropy go to the first language by name; with one language
the margin is 0; an empty table gives no rows, and without learning rows all is ``und``; very long texts
are read whole, in blocks that carry the last ORDER - 1 symbols over; columns of ``documents`` beside
those named pass through as a struct and cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import GOLDEN, M1, held_out, mix, table
from driftline.session import cut_lineage

ORDER = 5
#: Characters learnt from, over all languages.
SAMPLE = 4_000_000
#: Share of the learning rows that calibrate, in sixteenths.
CALIBRATE = 4
#: Quantile of own-language cross-entropy above which a text is rejected.
REJECT_AT = 0.995
SEED = 11
#: Symbols per block of scoring.
BLOCK = 1 << 15

_ENTRY = "lang string, n int, g long, ctx long, suf long, cnt long, start int"


# --- symbols ------------------------------------------------------------------------------------

_tables: dict[str, np.ndarray] = {}


def _symbol_table() -> np.ndarray:
    """Code point to symbol: lower-case letter, or 32."""
    if "map" not in _tables:
        out = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _tables["map"] = out
    return _tables["map"]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row and the offset of each text; without letters a text is one space."""
    size = np.array([len(t) + 2 for t in texts], np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    codes = np.frombuffer("".join(["\n" + t + "\n" for t in texts]).encode("utf-32-le", "replace"), np.uint32)
    sym = _symbol_table()[codes]
    keep = sym != 32
    keep[1:] |= keep[:-1].copy()                # a space is kept after a letter
    keep[start[:-1]] = True                     # and at the start of a text
    kept = np.concatenate([[0], np.cumsum(keep)])
    return sym[keep], kept[start]


def text_runs(texts: list, limit: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``limit`` characters (one text at least), with the place of the first."""
    first, size, run = 0, 0, []
    for i, t in enumerate(texts):
        run.append(t or "")
        size += len(run[-1])
        if size >= limit:
            yield first, run
            first, size, run = i + 1, 0, []
    if run:
        yield first, run


def gram_hashes(sym: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams ending at each symbol, n = 1 to ORDER; only [n-1:] is meaningful for n."""
    with np.errstate(over="ignore"):
        single = mix((sym.astype(np.uint64) + np.uint64(1)) * GOLDEN)
        out = [single]
        for _ in range(1, ORDER):
            prev = out[-1]
            h = np.empty_like(prev)
            h[1:] = (prev[:-1] ^ (prev[:-1] >> np.uint64(29))) * M1 + single[1:]
            h[:1] = single[:1]
            out.append(h)
    return out


# --- counts -------------------------------------------------------------------------------------

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("g", pa.int64()), ("ctx", pa.int64()),
                        ("suf", pa.int64()), ("cnt", pa.int64()), ("start", pa.int32())])

    def counted(lang: str, texts: list[str]) -> Iterator[pa.RecordBatch]:
        sym, offs = symbols(texts)
        hashes = gram_hashes(sym)
        place = np.arange(sym.size) - np.repeat(offs[:-1], np.diff(offs))
        place[np.repeat(np.diff(offs) == 1, np.diff(offs))] = -1        # no letters
        for n in range(1, ORDER + 1):
            ends = np.flatnonzero(place >= n - 1)
            if ends.size == 0:
                return
            g, at, inverse, cnt = np.unique(hashes[n - 1][ends], return_index=True, return_inverse=True, return_counts=True)
            start = np.bincount(inverse, place[ends] == n - 1, at.size) > 0
            at = ends[at]
            none = np.zeros(at.size, np.uint64)
            ctx, suf = (hashes[n - 2][at - 1], hashes[n - 2][at]) if n > 1 else (none, none)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * at.size, pa.string()), pa.array(np.full(at.size, n, np.int32)),
                 *[pa.array(v.view(np.int64)) for v in (g, ctx, suf)], pa.array(cnt.astype(np.int64)),
                 pa.array(start.astype(np.int32))], schema=schema)

    for b in batches:
        langs = np.array(b.column(0).to_pylist())
        for lang in np.unique(langs):
            texts = b.column(1).take(pa.array(np.flatnonzero(langs == lang))).to_pylist()
            for _, run in text_runs(texts, 1 << 20):
                yield from counted(str(lang), run)


def gram_terms(rows: DataFrame) -> DataFrame:
    """(lang, n, g, alpha, gamma) of the n-grams of ``rows`` (lang, text), and of the empty one as n = 0."""
    raw = cut_lineage(rows.select("lang", "text").mapInArrow(_count, _ENTRY).groupBy("lang", "n", "g").agg(
        F.min("ctx").alias("ctx"), F.min("suf").alias("suf"), F.sum("cnt").alias("cnt"), F.max("start").alias("start")))
    lefts = (raw.where("n > 1").groupBy("lang", (F.col("n") - 1).alias("n"), F.col("suf").alias("g"))
             .agg(F.count("*").alias("kinds")))
    counted = cut_lineage(raw.join(lefts, ["lang", "n", "g"], "left").select(
        "lang", "n", "g", "ctx",
        F.when(F.col("n") == ORDER, F.col("cnt")).otherwise(F.coalesce("kinds", F.lit(0)) + F.col("start")).alias("c")))
    few = counted.where("c in (1, 2)").groupBy("lang", "n").agg(
        F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"))
    discount = counted.select("lang", "n").distinct().join(few, ["lang", "n"], "left").select(
        "lang", "n", F.least(F.greatest(F.coalesce(F.col("n1") / (F.col("n1") + 2 * F.col("n2")), F.lit(0.5)), F.lit(0.05)),
                             F.lit(0.95)).alias("d"))
    heads = counted.groupBy("lang", "n", "ctx").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
    heads = cut_lineage(heads.join(discount, ["lang", "n"]))
    alpha = counted.join(heads, ["lang", "n", "ctx"]).select(
        "lang", "n", "g", ((F.col("c") - F.col("d")) / F.col("total")).alias("alpha"))
    gamma = heads.select("lang", (F.col("n") - 1).alias("n"), F.col("ctx").alias("g"),
                         (F.col("d") * F.col("kinds") / F.col("total")).alias("gamma"))
    return alpha.join(gamma, ["lang", "n", "g"], "full")


# --- the model ----------------------------------------------------------------------------------

@dataclass
class Order:
    """Sorted hashes of one order, the rows of their terms and an index of their leading bits."""

    keys: np.ndarray        # ends with a greatest value as stop
    index: np.ndarray
    shift: np.uint64
    alpha: np.ndarray       # (n-grams + 1, languages); the last row is that of missing n-grams
    gamma: np.ndarray

    def rows(self, h: np.ndarray) -> np.ndarray:
        at = self.index[(h >> self.shift).astype(np.int64)]
        found = self.keys[at]
        todo = np.flatnonzero(found < h)
        while todo.size:
            at[todo] += 1
            found[todo] = self.keys[at[todo]]
            todo = todo[found[todo] < h[todo]]
        at[found != h] = self.alpha.shape[0] - 1
        return at


@dataclass
class Model:
    langs: list[str]
    base: float                         # share of each symbol below the unigrams
    top: np.ndarray                     # factor of the uniform share, per language
    orders: list[Order]
    limits: np.ndarray | None = None    # per language and length class: mean and reject limit of cross-entropy
    weights: np.ndarray | None = None   # of the logistic calibration

    def entropies(self, sym: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Mean bits per symbol after the first, per text and language."""
        many, wide = offs.size - 1, len(self.langs)
        total = np.zeros((many, wide))
        for lo in range(0, sym.size, BLOCK):
            a, z = max(0, lo - ORDER + 1), min(sym.size, lo + BLOCK)
            own = np.searchsorted(offs, np.arange(a, z), "right") - 1
            place = np.arange(a, z) - offs[own]
            hashes = gram_hashes(sym[a:z])
            p = np.broadcast_to((self.base * self.top).astype(np.float32), (z - a, wide))
            before = None
            for n, order in enumerate(self.orders, 1):
                none = order.alpha.shape[0] - 1
                at = order.rows(hashes[n - 1])
                at[(place < n - 1) | (np.arange(z - a) < n - 1)] = none
                if n > 1:
                    last = self.orders[n - 2]
                    p[1:] *= np.take(last.gamma, before[:-1], 0)
                p = p + np.take(order.alpha, at, 0)
                before = at
            scored = (place > 0) & (np.arange(a, z) >= lo)
            bits = -np.log2(p[scored])
            own = own[scored]
            for k in range(wide):
                total[:, k] += np.bincount(own, bits[:, k], many)
        return total / np.maximum(1, np.diff(offs) - 1)[:, None]


def build(terms: pa.Table) -> Model:
    """The model's arrays of the table (lang, n, g, alpha, gamma)."""
    langs = sorted(set(terms.column("lang").to_pylist()))
    place = {name: i for i, name in enumerate(langs)}
    lang = np.array([place[v] for v in terms.column("lang").to_pylist()], np.int64)
    n = terms.column("n").to_numpy()
    g = terms.column("g").to_numpy().view(np.uint64)
    alpha = np.nan_to_num(terms.column("alpha").to_numpy(zero_copy_only=False).astype(float), nan=0.0)
    gamma = terms.column("gamma").to_numpy(zero_copy_only=False).astype(float)
    gamma = np.where(np.isnan(gamma), 1.0, gamma)
    orders = []
    for k in range(1, ORDER + 1):
        own = n == k
        keys, row = np.unique(g[own], return_inverse=True)
        a = np.zeros((keys.size + 1, len(langs)), np.float32)
        c = np.ones((keys.size + 1, len(langs)), np.float32)
        a[row, lang[own]] = alpha[own]
        c[row, lang[own]] = gamma[own]
        bits = max(1, int(keys.size).bit_length())
        shift = np.uint64(64 - bits)
        index = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << shift)
        orders.append(Order(np.append(keys, np.uint64(2**64 - 1)), index.astype(np.int64), shift, a, c))
    top = np.ones(len(langs), np.float32)
    top[lang[n == 0]] = gamma[n == 0]
    return Model(langs, 1.0 / max(1, orders[0].alpha.shape[0] - 1), top, orders)


def learning_rows(documents: DataFrame, fold: Column, sample: int = SAMPLE) -> DataFrame:
    """(lang, text, tune) of a seeded choice of rows outside ``fold``, of about ``sample`` characters in all."""
    rows = documents.where(~fold & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id", "text", F.lit(SEED)).alias("h"))
    sizes = rows.groupBy("lang").agg(F.sum(F.char_length("text")).alias("size"))
    sizes = cut_lineage(sizes)
    each = sample / max(1, sizes.count())
    share = sizes.select("lang", F.least(F.lit(1.0), F.lit(each) / F.greatest("size", F.lit(1))).alias("share"))
    return rows.join(share, "lang").where(F.pmod(F.col("h"), F.lit(1 << 20)) <= F.col("share") * (1 << 20)).select(
        "lang", "text", (F.pmod(F.shiftrightunsigned("h", 40), F.lit(16)) < CALIBRATE).alias("tune"))


# --- calibration --------------------------------------------------------------------------------

#: Length classes end at these numbers of symbols.
_LENGTHS = np.array([32, 128, 512])


def _features(best: np.ndarray, margin: np.ndarray, size: np.ndarray, lang: np.ndarray, model: Model) -> np.ndarray:
    kind = np.searchsorted(_LENGTHS, size, "right")
    mean, limit = model.limits[lang, kind, 0], model.limits[lang, kind, 1]
    over = np.clip((best - mean) / np.maximum(limit - mean, 0.05), -4, 8)
    return np.stack([np.ones_like(best), np.clip(margin, 0, 4), np.minimum(margin, 4) * np.log2(size + 1.0), over], 1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression with smoothed targets, which keep separable data finite."""
    pos, neg = y.sum(), y.size - y.sum()
    t = np.where(y, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [0.1] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (t - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _judged(model: Model, texts: list) -> tuple[np.ndarray, ...]:
    """Best language (-1: none), its cross-entropy, margin to the next and number of symbols."""
    lang = np.full(len(texts), -1)
    best, margin = np.zeros(len(texts)), np.zeros(len(texts))
    size = np.zeros(len(texts), np.int64)
    if not model.langs:
        return lang, best, margin, size
    for first, run in text_runs(texts):
        sym, offs = symbols(run)
        bits = model.entropies(sym, offs)
        part = slice(first, first + len(run))
        size[part] = np.diff(offs)
        lang[part] = np.where(size[part] > 1, bits.argmin(1), -1)
        best[part] = bits.min(1)
        if bits.shape[1] > 1:
            margin[part] = np.partition(bits, 1, 1)[:, 1] - best[part]
    return lang, best, margin, size


def pieces(text: str) -> list[str]:
    """The text and short cuts of it, which show what little text can tell."""
    at = zlib.crc32(text.encode("utf-8", "replace"))
    return [text, *(text[at % max(1, len(text) - k):][:k] for k in (3, 6, 12, 25, 50, 100))]


def calibrate(spark: SparkSession, model: Model, rows: DataFrame) -> Model:
    """The model with reject limits and score weights from ``rows`` (lang, text), which it did not count."""
    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([("own", pa.int32()), ("lang", pa.int32()), ("best", pa.float64()), ("margin", pa.float64()),
                        ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {name: i for i, name in enumerate(shared.value.langs)}
        for b in batches:
            cuts = [pieces(t) for t in b.column(1).to_pylist()]
            lang, best, margin, size = _judged(shared.value, [t for c in cuts for t in c])
            own = np.repeat([place.get(v, -1) for v in b.column(0).to_pylist()], [len(c) for c in cuts]).astype(np.int32)
            keep = lang >= 0
            yield pa.RecordBatch.from_arrays([pa.array(v[keep]) for v in (
                own, lang.astype(np.int32), best, margin, size)], schema=schema)

    seen = rows.select("lang", "text").mapInArrow(
        run, "own int, lang int, best double, margin double, size long").toArrow()      # rows of the sample only
    shared.unpersist()
    own, lang, best, margin, size = (seen.column(i).to_numpy() for i in range(5))
    kinds = _LENGTHS.size + 1
    limits = np.zeros((len(model.langs), kinds, 2))
    right = own == lang
    kind = np.searchsorted(_LENGTHS, size, "right")
    everywhere = best[right] if right.any() else np.array([8.0])
    for i in range(len(model.langs)):
        mine = right & (lang == i)
        whole = best[mine] if mine.any() else everywhere
        for k in range(kinds):
            part = best[mine & (kind == k)]
            part = part if part.size >= 20 else whole
            limits[i, k] = part.mean(), max(np.quantile(part, REJECT_AT), part.mean() + 3 * part.std()) + 0.05
    model.limits = limits
    model.weights = (_logistic(_features(best, margin, size, lang, model), right) if best.size
                     else np.array([0.0, 1.0, 1.0, -1.0]))
    return model


def fit(documents: DataFrame, fold: Column, sample: int = SAMPLE) -> Model:
    """Language models of the rows of ``documents`` outside ``fold``, calibrated."""
    rows = cut_lineage(learning_rows(documents, fold, sample))
    terms = gram_terms(rows.where("not tune"))
    model = build(terms.select("lang", "n", "g", "alpha", "gamma").toArrow())       # at most ORDER * SAMPLE n-grams
    return calibrate(documents.sparkSession, model, rows.where("tune"))


_VERDICT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                         T.StructField("bits", T.DoubleType()), T.StructField("margin", T.DoubleType()),
                         T.StructField("rejected", T.BooleanType())])


def identify(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``rows`` as struct ``row`` with struct ``lid``: lang_pred, score, bits, margin and rejected."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(_VERDICT)
    def judge(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        lang, best, margin, size = _judged(m, texts.tolist())
        known = lang >= 0
        score, over = np.zeros(len(texts)), np.ones(len(texts), bool)
        if known.any():
            x = _features(best[known], margin[known], size[known], lang[known], m)
            score[known] = 1 / (1 + np.exp(-np.clip(x @ m.weights, -30, 30)))
            over[known] = x[:, 3] > 1
        return pd.DataFrame({"lang_pred": [m.langs[i] if i >= 0 else "und" for i in lang], "score": score,
                             "bits": np.where(known, best, np.nan), "margin": np.where(known, margin, np.nan),
                             "rejected": over})

    return rows.select(F.struct("*").alias("row"), F.col(text).alias("_text")).select("row", judge("_text").alias("lid"))


def op11_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    fold = held_out(F.col("doc_id"), 4, 2)
    model = fit(docs, fold)
    return identify(docs.select("doc_id", "text"), model).select(
        "row.doc_id", held_out(F.col("row.doc_id"), 4, 2).alias("held_out"), "lid.lang_pred", "lid.score",
        F.when(F.isnan("lid.bits"), None).otherwise(F.col("lid.bits")).alias("bits"), "lid.rejected")


QUERIES = {"op11_langid": op11_langid}
