import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import frame
from driftline.llm import langid

SYLLABLES = {"en": ["the", "ing", "and", "ou", "th", "er"], "de": ["sch", "ung", "ein", "ü", "ch", "er"],
             "fr": ["eau", "ion", "é", "ou", "le", "que"]}


def prose(lang, seed, n):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def plain_symbols(text):
    out = " "
    for ch in text + " ":
        ch = (ch.lower() if len(ch.lower()) == 1 else ch) if ch.isalpha() else " "
        if ch != " " or out[-1] != " ":
            out += ch
    return out if out.strip() else " "


class Plain:
    """Interpolated Kneser-Ney on dictionaries of strings."""

    def __init__(self, texts, alphabet):
        self.base, cnt, left = 1 / alphabet, Counter(), defaultdict(set)
        for t in map(plain_symbols, texts):
            if t == " ":
                continue
            for n in range(1, langid.ORDER + 1):
                for i in range(len(t) - n + 1):
                    cnt[t[i:i + n]] += 1
                    left[t[i:i + n]].add(t[i - 1] if i else "^")
        self.c = {g: cnt[g] if len(g) == langid.ORDER else len(left[g]) for g in cnt}
        self.d, self.total, self.kinds = {}, Counter(), Counter()
        for n in range(1, langid.ORDER + 1):
            of = Counter(v for g, v in self.c.items() if len(g) == n)
            d = of[1] / (of[1] + 2 * of[2]) if of[1] + of[2] else 0.5
            self.d[n] = min(max(d, 0.05), 0.95)
        for g, v in self.c.items():
            self.total[len(g), g[:-1]] += v
            self.kinds[len(g), g[:-1]] += 1

    def bits(self, text):
        t, out = plain_symbols(text), 0.0
        for i in range(1, len(t)):
            p = self.base
            for n in range(1, langid.ORDER + 1):
                if i < n - 1:
                    break
                g, h = t[i - n + 1:i + 1], t[i - n + 1:i]
                if self.total[n, h]:
                    p = (max(self.c.get(g, 0) - self.d[n], 0) + self.d[n] * self.kinds[n, h] * p) / self.total[n, h]
            out -= math.log2(p)
        return out / max(1, len(t) - 1)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, prose(lang, i, 30 + i % 40), lang) for i, lang in enumerate(sorted(SYLLABLES) * 60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")), rows


def test_entropies_equal_those_of_dictionaries(spark, corpus):
    df, rows = corpus
    texts = defaultdict(list)
    for i, t, lang in rows[:90]:
        texts[lang].append(t)
    terms = langid.gram_terms(spark.createDataFrame(rows[:90], "doc_id long, text string, lang string").repartition(3))
    model = langid.build(terms.select("lang", "n", "g", "alpha", "gamma").toArrow())
    alphabet = len({c for _, t, _ in rows[:90] for c in plain_symbols(t)})
    plain = {lang: Plain(texts[lang], alphabet) for lang in texts}
    asked = [rows[100][1], rows[101][1], "x", "The  THE?!the", "", "12 34", "é" * 50, "ein\nund zwanzig" * 9000]
    sym, offs = langid.symbols(asked)
    found = model.entropies(sym, offs)
    want = [[plain[lang].bits(t) for lang in model.langs] for t in asked]
    assert np.allclose(found, want, rtol=2e-5, atol=1e-6)


def test_symbols_and_lookup():
    sym, offs = langid.symbols(["Ab, c!", "", " 9 ", "  x"])
    parts = ["".join(map(chr, sym[a:z])) for a, z in zip(offs[:-1], offs[1:])]
    assert parts == [" ab c ", " ", " ", " x "]
    terms = pa.table({"lang": ["a", "a", "b"], "n": pa.array([1, 1, 1], pa.int32()), "g": [5, -7, 5],
                      "alpha": [0.5, 0.25, 0.125], "gamma": [None, 0.5, None]})
    order = langid.build(terms).orders[0]
    rows = order.rows(np.array([5, 6, 2**64 - 7, 0], np.uint64))
    assert order.alpha[rows].tolist() == [[0.5, 0.125], [0, 0], [0.25, 0], [0, 0]]


def test_held_out_texts_and_calibration(spark, corpus):
    df, rows = corpus
    model = langid.fit(df, F.col("doc_id") % 4 == 2)
    asked = [(i, t, lang) for i, t, lang in rows if i % 4 == 2] + [(900, "zzyx qqvv wwkk jjzz " * 10, "en")]
    out = langid.identify(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model).collect()
    got = {r.row.doc_id: r for r in out}
    assert all(r.lid.lang_pred == r.row.lang and r.lid.score > 0.8 for r in out if r.row.doc_id != 900)
    assert got[900].lid.rejected and sum(r.lid.rejected for r in out) <= 1 + 0.05 * len(out)
    short = langid.identify(spark.createDataFrame([(1, "er")], "doc_id long, text string"), model).head()
    assert short.lid.score < min(r.lid.score for r in out if r.row.doc_id != 900)


def test_odd_rows(spark, docs, no_docs, clashing):
    fold = F.coalesce(F.col("doc_id") % 4 == 2, F.lit(False))
    out = langid.identify(docs, langid.fit(docs, fold)).collect()
    assert len(out) == docs.count()
    for r in out:
        letters = any(c.isalpha() for c in r.row.text or "")
        assert (r.lid.lang_pred == "und") == (not letters) and 0 <= r.lid.score <= 1
        assert letters or r.lid.score == 0 and r.lid.rejected
    again = langid.identify(clashing, langid.fit(clashing, fold)).collect()
    key = lambda r: repr((r.row.doc_id, r.row.text, r.lid))
    assert sorted(map(key, again)) == sorted(map(key, out))
    assert langid.identify(no_docs, langid.fit(no_docs, fold)).count() == 0
    unlearnt = langid.identify(frame(spark, [(1, "some words")]), langid.fit(no_docs, fold)).head()
    assert (unlearnt.lid.lang_pred, unlearnt.lid.score) == ("und", 0.0)


def test_ties_go_to_the_first_language(spark):
    rows = [(i, prose("en", i // 2, 40), ["b", "a"][i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    terms = langid.gram_terms(df.select("lang", "text")).toArrow()
    lang, *_ = langid._judged(langid.build(terms.select(["lang", "n", "g", "alpha", "gamma"])), [rows[0][1], rows[7][1]])
    assert lang.tolist() == [0, 0]


def test_the_sample_is_spread_over_languages(spark, corpus):
    df, _ = corpus
    taken = langid.learning_rows(df, F.lit(False), 6000).groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()
    assert len(taken) == 3 and all(500 < r.n < 4000 for r in taken)
