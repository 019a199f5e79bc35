"""Queries over taxonomy trees and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import recode
from driftline.operators import names, taxonomy
from driftline.plans.registry import query, r
from driftline.sources import starschema
from driftline.sources.starschema import _choose, for_check, for_spark

_EDGES = starschema.taxonomy_edges


def over_tree(body: str) -> str:
    return f"{starschema.taxonomy_sql()} {body}"


@query("tree_heights", over_tree(f"""SELECT tree_id, node, label,
    CASE lev WHEN 0 THEN 'root' WHEN 3 THEN 'tip' ELSE 'node' END AS type,
    {r("edge_length", "edge_length")}, {r("max_height - root_dist", "edge_height")},
    {r("max_height", "max_height")} FROM info"""))
def tree_heights(spark, sf_dir):
    return taxonomy.node_info(_EDGES(spark, sf_dir))


GRAFEN = """sqrt((below - 1)::DOUBLE / (max(below) OVER (PARTITION BY tree_id) - 1)::DOUBLE)"""


@query("tree_grafen", over_tree(f""", h AS (SELECT *, {GRAFEN} AS height
    FROM edges JOIN below USING (tree_id, node)) SELECT h.tree_id, h.node, h.parent, h.label,
    h.lev = 3 AS is_tip, {r("h.height", "height")},
    {r("coalesce(p.height - h.height, 0)", "edge_length")}
    FROM h LEFT JOIN h p ON h.tree_id = p.tree_id AND h.parent = p.node"""))
def tree_grafen(spark, sf_dir):
    return taxonomy.grafen_lengths(_EDGES(spark, sf_dir))


@query("tree_ladder", over_tree("""SELECT tree_id, node, parent, label, below, row_number() OVER
    (PARTITION BY tree_id, parent ORDER BY below DESC, label, node) AS position
    FROM edges JOIN below USING (tree_id, node)"""))
def tree_ladder(spark, sf_dir):
    return taxonomy.ladderize(_EDGES(spark, sf_dir))


@query("tree_label", over_tree("""SELECT e.tree_id, e.node, e.parent, e.edge_length, e.lev = 3 AS
    is_tip, CASE WHEN e.lev = 2 THEN 'NodE' || row_number() OVER (PARTITION BY e.tree_id, e.lev
    ORDER BY e.node) ELSE e.label END AS label FROM edges e"""))
def tree_label(spark, sf_dir):
    """The nodes between type and name lose their labels and are numbered."""
    e = _EDGES(spark, sf_dir)
    middle = F.size(F.split("node", "/")) == 3
    return taxonomy.fill_labels(e.withColumn("label", F.when(middle, "").otherwise(
        F.col("label"))))


@query("tree_member", over_tree("""SELECT DISTINCT q.tree_id, q.label, CAST(EXISTS (SELECT 1 FROM
    edges e WHERE e.tree_id = q.tree_id AND e.label = q.label) AS INT) AS in_tree FROM (
    SELECT 'T' || CAST((p_size + 1) % 5 AS VARCHAR) AS tree_id,
    p_type || '/' || p_brand || '/' || p_name AS label FROM part) q"""))
def tree_member(spark, sf_dir):
    """Names of each part looked up in the next tree."""
    asked = starschema.table(spark, sf_dir, "part").select(
        F.concat(F.lit("T"), ((F.col("p_size") + 1) % 5).cast("string")).alias("tree_id"),
        F.concat_ws("/", "p_type", "p_brand", "p_name").alias("label")).distinct()
    return taxonomy.membership(_EDGES(spark, sf_dir), asked)


def _dear_tips(spark, sf_dir):
    """Tips with at least one expensive part."""
    return (starschema.table(spark, sf_dir, "part").filter("p_retailprice > 980")
            .select(F.expr(starschema._TREE).alias("tree_id"),
                    F.concat_ws("/", F.expr(starschema._TREE), "p_type", "p_brand", "p_name")
                    .alias("node")))


DEAR_SQL = f""", dear AS (SELECT DISTINCT {starschema._TREE} AS tree_id,
    {starschema._TREE} || '/' || p_type || '/' || p_brand || '/' || p_name AS node
    FROM part WHERE p_retailprice > 980)"""


@query("tree_induced", over_tree(f"""{DEAR_SQL},
    kept AS (SELECT DISTINCT c.tree_id, c.node FROM closure c JOIN dear d
      ON c.tree_id = d.tree_id AND c.tip = d.node),
    kids AS (SELECT e.tree_id, e.parent AS node, count(*) AS kids FROM edges e
      SEMI JOIN kept USING (tree_id, node) GROUP BY ALL),
    stay AS (SELECT e.* FROM edges e SEMI JOIN kept USING (tree_id, node)
      LEFT JOIN kids USING (tree_id, node) WHERE lev = 3 OR kids > 1),
    up AS (SELECT s.tree_id, s.node, max(a.lev) AS up_lev FROM stay s JOIN stay a
      ON s.tree_id = a.tree_id AND a.lev < s.lev
      AND (a.lev = 0 OR starts_with(s.node, a.node || '/')) GROUP BY ALL)
    SELECT s.tree_id, s.node, s.label, a.node AS parent,
    round(CASE WHEN a.node IS NULL THEN 0 ELSE i.root_dist - ia.root_dist END, 6) AS edge_length
    FROM stay s LEFT JOIN up USING (tree_id, node)
    LEFT JOIN stay a ON a.tree_id = s.tree_id AND a.lev = up_lev
      AND (a.lev = 0 OR starts_with(s.node, a.node || '/'))
    JOIN info i ON i.tree_id = s.tree_id AND i.node = s.node
    LEFT JOIN info ia ON ia.tree_id = a.tree_id AND ia.node = a.node"""))
def tree_induced(spark, sf_dir):
    return taxonomy.induced_subtree(_EDGES(spark, sf_dir), _dear_tips(spark, sf_dir))


@query("tree_mrca", over_tree("""SELECT tree_id, arg_max(node, lev) AS mrca,
    max(k) AS n_tips FROM (SELECT c.tree_id, c.node, e.lev, count(*) AS k,
      max(count(*)) OVER (PARTITION BY c.tree_id) AS all_k FROM closure c JOIN leaf l ON c.tip = l.n3
      AND c.tree_id = l.tree_id JOIN edges e ON e.tree_id = c.tree_id AND e.node = c.node
      WHERE l.br = 'Brand#7' AND (l.ty = 'PROMO' OR l.tree_id IN ('T3', 'T4'))
      GROUP BY c.tree_id, c.node, e.lev) WHERE k = all_k GROUP BY tree_id"""))
def tree_mrca(spark, sf_dir):
    """Common ancestor of one brand's tips, within one type or across types."""
    e = _EDGES(spark, sf_dir)
    part = F.split("node", "/")
    wanted = e.filter((F.size(part) == 4) & (F.get(part, F.lit(2)) == "Brand#7")
                      & ((F.get(part, F.lit(1)) == "PROMO") | F.col("tree_id").isin("T3", "T4")))
    return taxonomy.common_ancestor(e, wanted.select("tree_id", "node"))


ANCHORS_SQL = """, anchors AS (SELECT tree_id, ty || '/' || br || '/' || na AS anchor, n3 AS node,
      2 AS lev FROM leaf WHERE na LIKE 'hot %'),
    cuts AS (SELECT a.tree_id, a.anchor, a.node, e.edge_length / 2 AS cut, 'fork' ||
      row_number() OVER (PARTITION BY a.tree_id ORDER BY a.anchor) AS fork
      FROM anchors a JOIN edges e USING (tree_id, node))"""


@query("tree_add_tips", over_tree(f"""{ANCHORS_SQL}
    SELECT e.tree_id, e.node, coalesce(fork, parent) AS parent, e.label,
      round(coalesce(cut, edge_length, 0), 6) AS edge_length FROM edges e
      LEFT JOIN cuts USING (tree_id, node)
    UNION ALL SELECT c.tree_id, fork, e.parent, fork, round(e.edge_length - cut, 6) FROM cuts c
      JOIN edges e USING (tree_id, node)
    UNION ALL SELECT tree_id, unnest(['new ' || anchor, 'second ' || anchor]), fork,
      unnest(['new ' || anchor, 'second ' || anchor]), round(cut, 6) FROM cuts
    UNION ALL SELECT tree_id, 'under ' || label, node, 'under ' || label,
      round(max_height - root_dist, 6) FROM info WHERE lev = 1"""))
def tree_add_tips(spark, sf_dir):
    """Two new tips beside each tip of one name group, one below each type."""
    e = _EDGES(spark, sf_dir)
    part = F.split("node", "/")
    hot = e.filter((F.size(part) == 4) & F.get(part, F.lit(3)).startswith("hot "))
    types = e.filter(F.size(part) == 2)

    def anchor(df, word):
        return df.select("tree_id", F.col("label").alias("anchor"),
                         F.concat(F.lit(word + " "), "label").alias("new_tip"),
                         F.lit(None).cast("double").alias("edge_length"),
                         F.col("label").alias("seq"))

    rows = anchor(hot, "new").unionByName(anchor(hot, "second")).unionByName(
        anchor(types, "under"))
    return taxonomy.add_tips(e, rows)


@query("tree_attach", over_tree("""SELECT e.tree_id, e.node, e.parent, e.label, e.lev = 3 AS is_tip,
    n_total, n_rows FROM edges e LEFT JOIN (SELECT p_type || '/' || p_brand || '/' || p_name AS
    label, CAST(sum(l_quantity) AS BIGINT) AS n_total, count(*) AS n_rows FROM lineitem JOIN part
    ON l_partkey = p_partkey GROUP BY ALL) s ON e.lev = 3 AND e.label = s.label"""))
def tree_attach(spark, sf_dir):
    items = starschema.table(spark, sf_dir, "lineitem").join(
        starschema.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    stats = items.groupBy(F.concat_ws("/", "p_type", "p_brand", "p_name").alias("taxon")).agg(
        F.sum("l_quantity").cast("long").alias("n_total"), F.count(F.lit(1)).alias("n_rows"))
    return taxonomy.attach(_EDGES(spark, sf_dir), stats, "taxon")


_TIPS = [*recode.FAMILY_TIP_NAMES, *recode.ORDER_TIP_NAMES, "Mugilidae", "Soleidae"]
_RAW_LABEL = _choose(f"l_partkey % {len(_TIPS)}", _TIPS)
_TIP_TABLE = {**recode.FAMILY_TIP_NAMES, **recode.ORDER_TIP_NAMES}


@query("tip_relabel", f"""SELECT raw_label, CASE raw_label
    {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _TIP_TABLE.items())} ELSE raw_label END AS label,
    count(*) AS n_rows FROM (SELECT {for_check(_RAW_LABEL)} AS raw_label
    FROM lineitem) GROUP BY ALL""")
def tip_relabel(spark, sf_dir):
    df = starschema.table(spark, sf_dir, "lineitem").select(
        F.expr(for_spark(_RAW_LABEL)).alias("raw_label"))
    out = taxonomy.relabel(df.withColumn("label", F.col("raw_label")), _TIP_TABLE)
    return out.groupBy("raw_label", "label").agg(F.count(F.lit(1)).alias("n_rows"))


_NAME = f"concat(p_name, {_choose('p_size % 25', [chr(97 + i) for i in range(25)])})"
_ASKED = f"""CASE p_partkey % 6 WHEN 0 THEN {_NAME} WHEN 1 THEN upper({_NAME})
    WHEN 2 THEN replace({_NAME}, ' ', '_')
    WHEN 3 THEN concat(substring({_NAME}, 1, 2), substring({_NAME}, 4, 99))
    WHEN 4 THEN concat({_NAME}, 'x') ELSE concat('zzz', {_NAME}) END"""
_FLAG = "CASE WHEN p_name LIKE 'old %' THEN 'INCERTAE_SEDIS_INHERITED' ELSE '' END"


@query("name_resolve", f"""WITH tax AS (SELECT {for_check(_NAME)} AS label, min({starschema._TREE}) AS node,
    min({_FLAG}) AS flags FROM part GROUP BY 1),
    asked AS (SELECT DISTINCT {for_check(_ASKED)} AS query FROM part),
    pairs AS (SELECT query, label, node, flags, CAST(levenshtein(replace(lower(query), '_', ' '),
      lower(label)) AS INT) AS distance FROM asked, tax
      WHERE abs(length(query) - length(label)) <= 1)
    SELECT query, label, node, flags, distance FROM (SELECT *, row_number() OVER (PARTITION BY
    query ORDER BY distance, label, node) AS rn FROM pairs WHERE distance <= 1)
    WHERE rn = 1 AND flags <> 'INCERTAE_SEDIS_INHERITED'""")
def name_resolve(spark, sf_dir):
    part = starschema.table(spark, sf_dir, "part")
    known = part.groupBy(F.expr(for_spark(_NAME)).alias("label")).agg(
        F.min(F.expr(starschema._TREE)).alias("node"), F.min(F.expr(_FLAG)).alias("flags"))
    return names.resolve_names(part.select(F.expr(for_spark(_ASKED)).alias("query")), known)
