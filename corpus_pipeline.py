"""Corpus pipeline: reject, deduplicate, cut repeats, decontaminate, mix.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return
the columns of ``documents`` as they came, the last adds domain, n_tokens and epoch.  ``run``
writes each stage's rows to the shared folder and reads them back for the next.

Defined cases are those of the operators: null texts count as empty, null ids are ids, repeated rows
are treated alike (near-duplicates keep one), an empty table passes through as no rows, and
columns beside doc_id, text, lang, source and n_chars are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import forest, mixing, quality, repeats, templates
from driftline.llm.common import table
from driftline.session import cut_lineage

#: Near duplicates: words of a shingle and percent of similarity.
SHINGLE_WORDS, SIMILAR = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the Bradley-Terry classifier accepts."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    rows = quality.score(docs.select(F.struct("*").alias("row"), "text"), model)
    return rows.where(F.col("score") >= quality.ACCEPT).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest id."""
    return forest.without_near_copies(docs, SHINGLE_WORDS, SIMILAR).select(docs.columns)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their passages of over 50 words that occur elsewhere; a character cut in two goes."""
    cut = repeats.remove_repeats(docs, repeats.PASSAGE, repeats.PASSAGE_WORDS)
    text = (F.when(F.col("cut.n_removed") > 0, F.regexp_replace(F.col("cut.kept").cast("string"), "\uFFFD", ""))
            .otherwise(F.col("row.text")))
    new = {"text": text, "n_chars": F.coalesce(F.char_length(text), F.lit(0)).cast("long")}
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak no benchmark item."""
    return templates.without_leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows chosen for the target weights, one per epoch."""
    return mixing.mixed_documents(spark, docs)


STAGES = [("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("repeat_dedup", repeat_dedup),
          ("decontamination", decontamination), ("target_mix", target_mix)]

#: The learned and hashed stages have no SQL; tests check each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
