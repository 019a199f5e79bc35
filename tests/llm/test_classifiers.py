import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import frame
from driftline.llm import quality, toxicity
from driftline.llm.common import training_rows

SF = "/root/testdata/sf0.01"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def marks():
    return dict(duckdb.sql(f"SELECT doc_id, max(quality) FROM '{SF}/labels.parquet' GROUP BY 1").fetchall()), \
        dict(duckdb.sql(f"SELECT doc_id, max(toxic) FROM '{SF}/labels.parquet' GROUP BY 1").fetchall())


def test_quality_on_held_out_rows(spark, marks):
    rows = quality.op4_quality(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    told = [(marks[0][r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in marks[0]]
    assert sum(y == p for y, p in told) >= 0.95 * len(told)
    bad = [r.score for r in rows if marks[0].get(r.doc_id) == 0 and r.held_out]
    good = [r.score for r in rows if marks[0].get(r.doc_id) == 1 and r.held_out]
    assert sum(g > b for g in good for b in bad) >= 0.92 * len(good) * len(bad)


def test_toxicity_leaves_clean_rows_alone(spark, marks):
    rows = toxicity.op8_toxicity(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    clean = [r.predicted for r in rows if marks[1].get(r.doc_id) == 0]
    assert sum(clean) <= 0.01 * len(clean)
    toxic = [r.predicted for r in rows if marks[1].get(r.doc_id) == 1]
    assert sum(toxic) >= 0.6 * len(toxic)


def test_odd_rows_and_labels(spark, docs, no_docs, clashing):
    told = labels(spark, [(1, 1, 0), (1, 1, 1), (4, 0, 0), (None, 1, 1), (3, None, None), (9, 7, 7), (999, 1, 1)])
    for df in (docs, no_docs, clashing):
        model = quality.fit(df, told)
        out = quality.score(df.select("doc_id", "text"), model).collect()
        assert len(out) == df.count() and all(0 <= r.score <= 1 for r in out)
        lexicon, w = toxicity.fit(df, told)
        out = toxicity.score(df.select("doc_id", "text"), lexicon, w).collect()
        assert len(out) == df.count() and all(0 <= r.score <= 1 for r in out)
    none = labels(spark, [])
    assert {r.score for r in quality.score(docs, quality.fit(docs, none)).select("score").collect()} == {0.5}


def test_quality_learns_from_every_labelled_row(spark):
    """One labelled row more or less changes the model, however many there are."""
    told = spark.range(14000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    texts = told.select("doc_id", F.when(F.col("quality") == 1, "Some plain words, and more.").otherwise("## 77 $$ 3").alias("text"))
    texts = texts.withColumn("text", F.concat("text", F.repeat(F.lit(" x"), (F.col("doc_id") % 37).cast("int"))))
    whole = quality.fit(texts, told)
    taught = told.where(~quality.held_out(F.col("doc_id"), 4, 2)).orderBy("doc_id").limit(20).collect()
    for row in taught[::9]:
        assert abs(quality.fit(texts, told.where(F.col("doc_id") != row.doc_id))["mean"] - whole["mean"]).max() > 0


def test_training_rows_are_bounded_and_outside_the_fold(spark, docs):
    told = labels(spark, [(i, i % 2, 0) for i in range(40)])
    rows = training_rows(docs, told, "quality", F.col("doc_id") == 5, 3).select("doc_id", "y").distinct().collect()
    assert sum(r.y for r in rows) == 3 and len(rows) == 6 and 5 not in {r.doc_id for r in rows}


def distance(a, b):
    """Edits of insertion, deletion, substitution and swap, no part edited twice."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if i * j == 0}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_matches_edit_distance():
    import random
    terms = {"trash": 1, "moron": 1, "ass": 0, "worthless": 2, "thrush": 1}
    lexicon, rng = toxicity.FuzzyLexicon(terms), random.Random(4)
    words = ["", "trash", "tarsh", "trsh", "trassh", "tr4sh", "rash", "as", "ass", "worthles", "wrothles", "thrash"]
    for _ in range(1500):
        w = list(rng.choice(list(terms)))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k:k + rng.randint(0, 1)] = rng.choice(["", "a", "s", "o"])
        words.append("".join(w))
    for w in words:
        best = [distance(w, t) for t, slack in terms.items() if distance(w, t) <= slack]
        assert lexicon.match(w) == (0 if not best else 1 if min(best) == 0 else 2), w


def test_stems_and_quotation():
    lexicon = toxicity.FuzzyLexicon({"moron": 1}, ["lowei"])
    assert [lexicon.match(w) for w in ("lowei", "loweixyz", "lowe", "moron", "morons")] == [1, 1, 0, 1, 2]
    reader = toxicity.Reader(lexicon)
    abuse, quoted = reader.features("you are a moron today"), reader.features('the sign had "you moron" on it')
    reported = reader.features("she said moron is a bad word")
    assert abuse[1] > 0 and abuse[3] == 0 and quoted[1] == 0 and quoted[3] > 0 and reported[3] > 0
    assert toxicity.PRIOR @ abuse > toxicity.PRIOR @ quoted
    assert reader.features("") == reader.features("nothing here") == [1.0, 0, 0, 0, 0, 0, 0]


def test_learned_lexicon_catches_misspellings(spark):
    bad = ["grubby", "wretched", "vile"]
    rows, told = [], []
    for i in range(160):
        body = " ".join(f"w{(i * 7 + k * k) % 97}" for k in range(30)).split()
        if i % 2:
            body[i % 29:i % 29] = [bad[i // 2 % 3]]
        rows.append((i, " ".join(body)))
        told.append((i, 1, i % 2))
    rows += [(1000, "w1 w2 grubyb w3"), (1001, "w1 wretchd w2"), (1002, "w5 w6 w7"), (1003, "W1 VILE. w2")]
    df = frame(spark, rows)
    lexicon, w = toxicity.fit(df, labels(spark, told))
    assert set(lexicon.terms) == set(bad)
    got = {r.doc_id: r.score for r in toxicity.score(df.where("doc_id >= 1000"), lexicon, w).collect()}
    assert got[1000] >= 0.5 and got[1001] >= 0.5 and got[1003] >= 0.5 and got[1002] < 0.5
