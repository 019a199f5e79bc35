"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

A token budget flows down a tree of levels (domain, language, source).  Each node shares its
budget among its children by weight; a child that holds less than its share gives the rest to
its siblings, and only a node that is short as a whole leaves budget to its own siblings.
Each leaf then takes whole seeded epochs and a token-prefix of the next one.

The prefix is found without ordering a leaf: tokens are summed per leaf and leading digits
of the order key, and only the bucket in which the budget ends is sorted.

Defined cases: null levels are the node ``unknown``; rows without words (null, empty) are never
selected; rows with one id and level share an order key and enter or leave together; a null
id is ordered by the text; nodes of weight 0 or less get nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.llm.common import WORD, table
from driftline.session import cut_lineage

DOMAINS = ("web", "books", "forum", "code")
WEIGHTS: dict[tuple[str, ...], float] = {
    ("web",): 4, ("books",): 3, ("forum",): 2, ("code",): 1,
    **{(d, lang): w for d in DOMAINS for lang, w in (("en", 5), ("de", 2), ("fr", 2), ("es", 1))},
}
SHARE, MAX_EPOCHS, SEED = 0.5, 4, 2024
#: Rows wanted in a bucket of the order key; it steers the work, never the result.
BUCKET_ROWS = 2000


def domain_of(source: Column) -> Column:
    """Domain by the number at the end of a source's name; ``unknown`` without one."""
    number = F.try_to_number(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("999999999"))
    arms = F.lit("unknown")
    for i, name in enumerate(DOMAINS):
        arms = F.when(number % len(DOMAINS) == i, name).otherwise(arms)
    return arms


def share_out(nodes: DataFrame, parent: list[str], budget: str, cap: str, weight: str,
              out: str) -> DataFrame:
    """Split each parent's ``budget`` over its children: min(cap, weight x level).

    The level is the largest of (budget - caps before) / (weights from here on) along the
    children ordered by cap / weight.
    """
    live = F.col(weight) > 0
    part = W.partitionBy(*parent)
    order = part.orderBy(F.when(live, F.col(cap) / F.col(weight)).asc_nulls_last(), F.col(out + "_name"))
    before = F.coalesce(F.sum(F.when(live, F.col(cap))).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.when(live, F.col(weight))).over(order.rowsBetween(0, W.unboundedFollowing))
    level = F.when(live, (F.col(budget) - before) / rest)
    return (nodes.withColumn("_level", level)
            .withColumn("_level", F.max("_level").over(part))
            .withColumn(out, F.when(live, F.least(F.col(cap).cast("double"), F.col(weight) * F.col("_level")))
                        .otherwise(0.0))
            .drop("_level"))


def _weights(spark: SparkSession, weights: dict[tuple[str, ...], float], depth: int) -> DataFrame | None:
    rows = [(k, float(w)) for k, w in weights.items() if len(k) == depth]
    if not rows:
        return None
    quoted = ", ".join("(" + ", ".join("'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'" for p in k)
                       + f", {w!r}D)" for k, w in rows)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t({', '.join(f'_l{i}' for i in range(depth))}, _w)")


def leaf_budgets(leaves: DataFrame, depth: int, weights: dict[tuple[str, ...], float],
                 share: float, max_epochs: int) -> DataFrame:
    """Budget per leaf from ``leaves`` (_l0 .., _tokens); unlisted nodes weigh 1."""
    spark = leaves.sparkSession
    cols = [f"_l{i}" for i in range(depth)]
    up = leaves.agg(F.sum("_tokens").alias("_all"))
    above = up.select(F.least(F.floor(F.col("_all") * share).cast("double"),
                              (F.col("_all") * max_epochs).cast("double")).alias("_b"))
    for k in range(1, depth + 1):
        nodes = leaves.groupBy(*cols[:k]).agg(F.sum(F.col("_tokens") * max_epochs).alias("_cap"))
        named = _weights(spark, weights, k)
        nodes = nodes.withColumn("_w", F.lit(1.0)) if named is None else (
            nodes.join(named, cols[:k], "left").withColumn("_w", F.coalesce("_w", F.lit(1.0))))
        nodes = nodes.join(above, cols[:k - 1]) if k > 1 else nodes.join(above)
        above = (share_out(nodes.withColumn("_n_name", F.col(cols[k - 1])), cols[:k - 1], "_b", "_cap", "_w", "_n")
                 .select(*cols[:k], F.col("_n").alias("_b")))
    return above.join(leaves, cols).select(
        *cols, "_docs", "_tokens", F.floor(F.col("_b") + 1e-6).cast("long").alias("_budget"))


def mix(documents: DataFrame, levels: list[Column], weights: dict[tuple[str, ...], float],
        share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
        names: tuple[str, ...] = ("domain", "lang", "source")) -> DataFrame:
    """Rows of ``documents`` chosen for the mix, one per epoch, with n_tokens, epoch and ``names``.

    ``share`` is the budget as a part of all tokens.  Columns of the input that bear an added
    column's name are replaced.
    """
    depth = len(levels)
    cols = [f"_l{i}" for i in range(depth)]
    rows = (documents.select(F.struct("*").alias("_row"), F.col("text").alias("_text"), F.col("doc_id").alias("_id"),
                             *[F.coalesce(c, F.lit("unknown")).alias(n) for n, c in zip(cols, levels)])
            .withColumn("_t", F.regexp_count("_text", F.lit(WORD)).cast("long")).where("_t > 0"))
    leaves = cut_lineage(rows.groupBy(*cols).agg(F.count("*").alias("_docs"), F.sum("_t").alias("_tokens")))
    plan = cut_lineage(leaf_budgets(leaves, depth, weights, share, max_epochs).select(
        *cols, "_docs", F.expr("_budget div _tokens").alias("_whole"), F.expr("_budget % _tokens").alias("_rest")))
    most = plan.agg(F.max("_docs")).first()[0] or 0
    digits = 1
    while most > BUCKET_ROWS * 16 ** digits:
        digits += 1
    keyed = (rows.join(plan, cols)
             .withColumn("_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_whole").cast("string"),
                                                   F.coalesce(F.col("_id").cast("string"), F.md5("_text")))))
             .withColumn("_bucket", F.substring("_key", 1, digits)))
    ordered = W.partitionBy(*cols).orderBy("_bucket")
    sums = (keyed.groupBy(*cols, "_bucket", "_rest").agg(F.sum("_t").alias("_sum"))
            .withColumn("_upto", F.sum("_sum").over(ordered)))
    last = sums.where("_upto > _rest and _upto - _sum <= _rest").select(
        *cols, "_bucket", (F.col("_upto") - F.col("_sum")).alias("_before"))
    last = cut_lineage(last)
    inside = (keyed.join(last, [*cols, "_bucket"])
              .withColumn("_upto", F.col("_before") + F.sum("_t").over(W.partitionBy(*cols).orderBy("_key")))
              .where("_upto <= _rest").groupBy(*cols).agg(F.max("_key").alias("_cut")))
    cuts = cut_lineage(last.join(inside, cols, "left").select(
        *cols, F.coalesce("_cut", F.col("_bucket")).alias("_cut")))
    chosen = (keyed.join(cuts, cols, "left")
              .withColumn("_times", F.col("_whole") + (F.col("_key") <= F.col("_cut")).cast("long"))
              .where("_times > 0")
              .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1))))
    added = {"n_tokens": F.col("_t"), "epoch": F.col("epoch"),
             **{n: F.col(c) for n, c in zip(names, cols)}}
    kept = [F.col(f"_row.`{c}`").alias(c) for c in documents.columns if c not in added]
    return chosen.select(*kept, *[c.alias(n) for n, c in added.items()])


def mixed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix(docs, [domain_of(F.col("source")), F.col("lang"), F.col("source")], WEIGHTS)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of ``documents``: doc_id, domain, lang, source, n_tokens, epoch."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixed_documents(spark, docs).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


# --- checking SQL -----------------------------------------------------------------------

_W1 = " ".join(f"WHEN '{k[0]}' THEN {float(w)}" for k, w in WEIGHTS.items() if len(k) == 1)
_W2 = "".join(f" WHEN l0 = '{k[0]}' AND l1 = '{k[1]}' THEN {float(w)}" for k, w in WEIGHTS.items() if len(k) == 2)


def _level_sql(cols: list[str], name: str, above: str, weight: str) -> str:
    parent, own = ", ".join(cols[:-1]), ", ".join(cols)
    part = f"PARTITION BY {parent}" if parent else ""
    join = f"JOIN {above} USING ({parent})" if parent else f"CROSS JOIN {above}"
    return f"""
{name}n AS (SELECT {own}, cap, CAST({weight} AS DOUBLE) AS w, b
  FROM (SELECT {own}, sum(tokens * {MAX_EPOCHS}) AS cap FROM leaves GROUP BY {own}) {join}),
{name}v AS (SELECT *, (b - coalesce(sum(cap) OVER ({part} ORDER BY cap / w, {cols[-1]}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER ({part} ORDER BY cap / w, {cols[-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM {name}n),
{name} AS (SELECT {own}, least(CAST(cap AS DOUBLE), w * max(lv) OVER ({part})) AS b FROM {name}v)"""


def mix_sql(source: str = "documents", columns: str = "doc_id") -> str:
    """DuckDB SQL for ``mixed_documents`` over ``source``."""
    arms = " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DOMAINS))
    return f"""
WITH rows0 AS (SELECT *, coalesce(CASE TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % {len(DOMAINS)}
    {arms} END, 'unknown') AS l0, coalesce(lang, 'unknown') AS l1, coalesce(source, 'unknown') AS l2,
    CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS t FROM {source}),
rows1 AS (SELECT * FROM rows0 WHERE t > 0),
leaves AS (SELECT l0, l1, l2, CAST(sum(t) AS BIGINT) AS tokens FROM rows1 GROUP BY ALL),
root AS (SELECT least(CAST(floor(sum(tokens) * CAST({SHARE} AS DOUBLE)) AS DOUBLE), CAST(sum(tokens) * {MAX_EPOCHS} AS DOUBLE)) AS b FROM leaves),
{_level_sql(["l0"], "a1", "root", f"CASE l0 {_W1} ELSE 1.0 END")},
{_level_sql(["l0", "l1"], "a2", "a1", f"CASE{_W2} ELSE 1.0 END")},
{_level_sql(["l0", "l1", "l2"], "a3", "a2", "1.0")},
plan AS (SELECT l0, l1, l2, CAST(floor(b + 1e-6) AS BIGINT) // tokens AS whole, CAST(floor(b + 1e-6) AS BIGINT) % tokens AS rest
  FROM a3 JOIN leaves USING (l0, l1, l2)),
keyed AS (SELECT *, md5('{SEED}:' || CAST(whole AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), md5(text))) AS k
  FROM rows1 JOIN plan USING (l0, l1, l2)),
cut AS (SELECT *, whole + CASE WHEN sum(t) OVER (PARTITION BY l0, l1, l2 ORDER BY k) <= rest THEN 1 ELSE 0 END AS times FROM keyed)
SELECT {columns}, l0 AS domain, l1 AS lang, l2 AS source, t AS n_tokens, CAST(e AS BIGINT) AS epoch
FROM (SELECT *, unnest(range(times)) AS e FROM cut WHERE times > 0)"""


QUERIES = {"op7_mixing": op7_mixing}
ORACLES = {"op7_mixing": mix_sql()}
