from collections import Counter

import pytest

import corpus_pipeline
from conftest import frame, words
from driftline.llm import forest, mixing, quality, repeats, templates
from driftline.session import cut_lineage

SF = "/root/testdata/sf0.001"


def test_each_stage_does_what_its_operator_finds(spark):
    docs = cut_lineage(spark.read.parquet(f"{SF}/documents.parquet"))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "repeat_dedup", "decontamination", "target_mix"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        out = cut_lineage(stage(spark, rows, SF))
        if name != "target_mix":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        if name == "quality_classifier":
            model = quality.fit(rows, spark.read.parquet(f"{SF}/labels.parquet"))
            assert ids(out) == ids(quality.score(rows, model).where("score >= 0.7"))
            assert 0.6 * rows.count() < out.count() < rows.count()
        elif name == "near_dedup":
            assert ids(out) == ids(forest.near_duplicates(rows, 5, 80).where("kept"))
        elif name == "repeat_dedup":
            want = {r.doc_id: r.cut.kept.decode(errors="ignore") for r in repeats.remove_repeats(rows, 250, 50).select("row.doc_id", "cut").collect()}
            assert {r.doc_id: r.text for r in out.collect()} == want
            assert all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "decontamination":
            bad = {r.doc_id for r in templates.leaks(rows, bench).collect()}
            assert ids(out) == [i for i in ids(rows) if i not in bad]
        else:
            assert Counter(ids(out)) == Counter(ids(mixing.mixed_documents(spark, rows)))
        rows = out
    assert corpus_pipeline.run(spark, SF).count() == rows.count()


@pytest.mark.parametrize("case", ["docs", "no_docs", "clashing"])
def test_odd_rows_pass_every_stage(spark, case, request):
    rows = request.getfixturevalue(case)
    for name, stage in corpus_pipeline.STAGES:
        out = cut_lineage(stage(spark, rows, SF))
        if name != "target_mix":
            assert out.columns == rows.columns
        if name == "quality_classifier":            # keep all, so that the later stages see the odd rows
            continue
        rows = out


def test_cut_characters_go_whole(spark):
    """Two characters that share their last byte lose it to the repeat, and with it the rest."""
    shared = "é" + " é" * 300
    assert "è".encode()[1:] == "Ũ".encode()[1:]
    rows = frame(spark, [(1, words(1, 3) + " è" + shared), (2, words(2, 4) + " Ũ" + shared)])
    out = {r.doc_id: r for r in corpus_pipeline.repeat_dedup(spark, rows, SF).collect()}
    assert {i: r.text for i, r in out.items()} == {1: words(1, 3) + " ", 2: words(2, 4) + " "}
    assert all(r.n_chars == len(r.text) for r in out.values())
