import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from conftest import documents, frame, words
from driftline.llm import ngram
from driftline.llm.common import held_out


def scored(df):
    from pyspark.sql import functions as F
    rows = df.select("doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    m = ngram.train(rows.where(~F.col("held_out")))
    return m, ngram.score(rows, m).collect()


def plain(rows):
    """Base scores and a dictionary walk over the same smoothed n-grams."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    texts = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    taught = [t for t, h in zip(texts, held) if not h]
    c = Counter(w for t in taught for w in t)
    n, v = sum(c.values()), len(c)
    two = Counter((a, b) for t in taught for a, b in zip([None, *t], t))
    three = Counter((a, b, w) for t in taught for a, b, w in zip([None, *t], t, t[1:]))
    two = {k: x for k, x in two.items() if x >= ngram.LEAST}
    three = {k: x for k, x in three.items() if x >= ngram.LEAST}
    floor = lambda w: (c[w] + 1) / (n + v + 1)
    p2 = {k: (x - ngram.DISCOUNT) / c[k[0]] for k, x in two.items()}
    p3 = {k: (x - ngram.DISCOUNT) / two[k[:2]] for k, x in three.items()}

    def fail(prob, history, lower):
        arcs = [k for k in prob if k[:-1] == history]
        return max(1 - sum(prob[k] for k in arcs), 1e-12) / max(1 - sum(lower(k) for k in arcs), 1e-12)
    f1 = {h: fail(p2, (h,), lambda k: floor(k[-1])) for h in {k[0] for k in p2}}
    f2 = {h: fail(p3, h, lambda k: p2[k[1:]]) for h in {k[:2] for k in p3}}

    def p(u, a, w, first):
        if not first and (u, a, w) in p3:
            return p3[u, a, w]
        back = f2.get((u, a), 1) if not first else 1
        if (a, w) in p2:
            return back * p2[a, w]
        return back * f1.get(a, 1) * floor(w)
    out = []
    for (i, _), h, t in zip(rows, held, texts):
        base = sum(math.log10(floor(w)) for w in t)
        score, u, a = 0.0, None, None
        for k, w in enumerate(t):
            score += math.log10(p(u, a, w, k == 0))
            u, a = a, w
        out.append((i, h, len(t), sum(c[w] > 0 for w in t), n, base, score))
    return out, (p, c, floor)


def test_scores_match_a_dictionary_walk(docs):
    rows = documents() * 2                                                # repeated rows count twice
    m, got = scored(docs.union(docs))
    expected, _ = plain(rows)
    key = lambda r: repr((r[0], r[2], round(r[5], 6)))
    got = sorted((tuple(r) for r in got), key=key)
    expected = sorted(expected, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    np.testing.assert_allclose([r[5:7] for r in got], [r[5:7] for r in expected], rtol=0, atol=1e-6)


def test_each_state_sums_to_one():
    rows = [(i, t) for i, t in documents() if t and len(t) < 2000]
    _, (p, c, floor) = plain(rows)
    words = list(c)
    unknown = floor("never seen")
    for u, a in [(None, b"an"), (b"er", b"er"), (b"st", b"ou")]:
        total = sum(p(u, a, w, False) for w in words)
        share = p(u, a, "never seen", False)
        assert abs(total + share - 1) < 1e-6, (u, a, total, share, unknown)


def test_no_training_rows(spark, no_docs):
    m, got = scored(no_docs)
    assert got == [] and m.tokens == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    _, got = scored(frame(spark, [(held, "only held out"), (held, None)]))
    assert sorted((r.n_tokens, r.n_known, r.base_score, r.score) for r in got) == [(1, 0, 0, 0), (4, 0, 0, 0)]


def test_rare_arcs_stay_in_a_large_corpus(spark, monkeypatch):
    """A pair seen twice among many tokens is an arc, on one part or many and with no n-gram hot."""
    monkeypatch.setattr(ngram, "PART", 64)
    monkeypatch.setattr(ngram, "HOT_SHARE", 50)
    rows = [(i, " ".join(f"w{(i * 31 + k * k * 7) % 211}" for k in range(300))) for i in range(100)]
    taught = [i for i in range(1000, 1020) if zlib.crc32(str(i).encode()) % 7 != 2][:2]
    rows += [(i, "seldom paired words follow here") for i in taught]
    m, got = scored(frame(spark, rows))
    _, expected = None, plain(rows)[0]
    got, expected = ({r[0]: r[5:7] for r in x} for x in (map(tuple, got), expected))
    for i in expected:
        np.testing.assert_allclose(got[i], expected[i], rtol=0, atol=1e-6)
    assert got[taught[0]][1] > got[taught[0]][0] + 10


def test_walk_carries_its_state_from_block_to_block(monkeypatch):
    rng = np.random.default_rng(3)
    floor, low, high = -rng.random((3, 400)) - 0.1
    two = np.where(rng.random(400) < 0.6, -rng.random(400), 0)
    three = np.where((rng.random(400) < 0.5) & (two < 0) & (np.append(0, two[:-1]) < 0), -rng.random(400), 0)
    whole = ngram.walk(-0.5, floor, two, three, low, high)
    total = 0.0
    for i in range(400):
        after_pair = i > 0 and two[i - 1] < 0
        back = low[i - 1] if i else -0.5
        total += three[i] or (high[i - 1] if after_pair else 0) + (two[i] or back + floor[i])
    assert abs(whole - total) < 1e-9
    monkeypatch.setattr(ngram, "BLOCK", 7)
    assert ngram.walk(-0.5, floor, two, three, low, high) == whole


def test_clashing_columns_and_a_very_long_text(spark, docs, clashing):
    key = lambda r: (repr(r.doc_id), r.n_tokens, round(r.base_score, 6), round(r.score, 6))
    assert sorted(map(key, scored_rows(clashing))) == sorted(map(key, scored_rows(docs)))
    rows = [(0, "a bc def " * 120_000), (1, "a bc"), (2, "def a")]        # a megabyte, over several blocks
    got = {r.doc_id: r for r in scored_rows(frame(spark, rows))}
    expected = {r[0]: r for r in plain(rows)[0]}
    assert got[0].n_tokens == 360_001
    for i in got:
        np.testing.assert_allclose([got[i].base_score, got[i].score], expected[i][5:7], rtol=1e-9)


def scored_rows(df):
    return scored(df)[1]


def test_a_chunk_is_cut_into_runs():
    """The tokens of a chunk, in a fraction of the memory that the chunk as one run takes."""
    texts = [words(k, 400).encode() for k in range(100)] * 10
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    peaks, tokens = [], []
    ngram._tokens(data[:5], np.array([0, 5]))
    for cut in (lambda: [ngram._tokens(data, offs)], lambda: ngram._runs(data, offs)):
        tracemalloc.start()
        tokens.append(cut())
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    (whole, at), runs = tokens[0][0], tokens[1]
    assert len(runs) > 3 and (np.concatenate([t for t, _ in runs]) == whole).all()
    assert (np.concatenate([np.diff(o) for _, o in runs]) == np.diff(at)).all()
    assert peaks[1] < peaks[0] / 2


def test_rows_of_answers_come_in_small_batches(spark, docs, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, cut = spark.conf.get(key), ngram.cut_lineage
    monkeypatch.setattr(ngram, "cut_lineage", lambda df: (seen.append((df.columns, int(spark.conf.get(key)))), cut(df))[1])
    scored(docs)
    assert spark.conf.get(key) == before
    assert {rows for columns, rows in seen if "seq" in columns or "score" in columns} == {ngram.BATCH}


def test_counting_takes_texts_and_packed_rows_in_small_batches(spark, docs, monkeypatch):
    """Tables of words, bigrams and trigrams: few rows at once, and whole counts however often a task emits."""
    monkeypatch.setattr(ngram, "FLUSH", 40)
    key, seen, cut = "spark.sql.execution.arrow.maxRecordsPerBatch", [], ngram.cut_lineage

    def noted(df):
        seen.append((df.columns, int(spark.conf.get(key))))
        return cut(df)
    monkeypatch.setattr(ngram, "cut_lineage", noted)
    m = ngram.train(docs.select("doc_id", "text"))
    counted = [rows for columns, rows in seen if columns == ["w", "n"] or {"a", "b", "n"} <= set(columns)]
    assert counted == [ngram.BATCH] * 3
    texts = [(t or "").encode().lower().split() for _, t in documents()]
    words = Counter(w for t in texts for w in [*t, None])
    two = Counter(g for t in texts for g in zip([None, *t], [*t, None]))
    three = Counter(g for t in texts for g in zip([None, *t], t, [*t[1:], None]))
    kept = [x for grams in (two, three) for x in grams.values() if x >= ngram.LEAST]
    arcs = [ngram._joined(pa.array([r.n]), np.int64) for r in m.arcs.collect()]
    assert sorted(np.concatenate(arcs).tolist()) == sorted([*words.values(), *kept])


def test_packed_trigrams_have_no_failure_weights():
    rows = [np.arange(3, dtype=np.uint64), np.arange(2, dtype=np.uint64)]
    keys, n, fail = ngram._arcs(*(pa.array(x, pa.binary()) for x in (
        [k.tobytes() for k in rows], [k.astype(np.int64).tobytes() for k in rows], [None, np.array([0.5, -1]).tobytes()])))
    assert keys.tolist() == n.tolist() == [0, 1, 2, 0, 1] and fail.tolist() == [0, 0, 0, 0.5, -1]
