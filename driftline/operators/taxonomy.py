"""Rooted trees held as edge tables, many trees in one table.

Columns: ``tree_id, node, parent`` (null for a root), ``label``, ``edge_length``
(length of the edge above the node).  Every operator touches all trees at once.  Facts
about ancestors and descendants come from pointer doubling: after k joins a node has
seen 2^k levels, so a tree of depth d takes about log2(d) rounds on tables that never
grow beyond one row per node.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators import ranking
from driftline.session import cut_lineage

KEY = ["tree_id", "node"]


def _rounds(edges: DataFrame) -> int:
    """Rounds that pointer doubling can take at most on a tree of these nodes."""
    most = edges.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0
    return int(most).bit_length() + 2


def _still(open_rows: DataFrame, left: int) -> bool:
    """Whether rows are left to follow; parents that form a cycle never end and raise."""
    if open_rows.isEmpty():
        return False
    if left <= 0:
        raise ValueError(f"parents form a cycle, for example at {open_rows.first()}")
    return True


def node_metrics(edges: DataFrame, count: Column | None = None) -> DataFrame:
    """Per node: ``depth`` (edges to the root), ``root_dist``, ``below``.

    ``below`` sums ``count`` over the node and its descendants; by default tips count 1.
    """
    tips = _is_tip(edges)
    own = F.when(F.col("is_tip"), 1).otherwise(0) if count is None else count
    has_parent = F.col("parent").isNotNull()
    state = cut_lineage(tips.select(
        *KEY, "is_tip", F.col("parent").alias("jump"),
        F.when(has_parent, 1).otherwise(0).cast("long").alias("depth"),
        F.when(has_parent, F.coalesce("edge_length", F.lit(0.0))).otherwise(0.0)
        .alias("root_dist"),
        own.cast("long").alias("below")))
    left = _rounds(edges)
    while _still(state.filter(F.col("jump").isNotNull()).select(*KEY), left):
        left -= 1
        up = _looked_up(state, "jump", _jump="jump", _depth="depth", _dist="root_dist")
        gained = (state.filter(F.col("jump").isNotNull())
                  .groupBy("tree_id", F.col("jump").alias("node"))
                  .agg(F.sum("below").alias("_gain")))
        state = cut_lineage(
            _look_up(state, "jump", up).join(gained, KEY, "left")
            .select(*KEY, "is_tip", F.col("_jump").alias("jump"),
                    (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
                    (F.col("root_dist") + F.coalesce("_dist", F.lit(0.0))).alias("root_dist"),
                    (F.col("below") + F.coalesce("_gain", F.lit(0))).alias("below")))
    return state.drop("jump")


def _looked_up(state: DataFrame, pointer: str, **columns: str) -> DataFrame:
    """The columns of every node, keyed for ``_look_up``."""
    return state.select(F.col("tree_id").alias("_tree"), F.col("node").alias("_at"),
                        *[F.col(c).alias(a) for a, c in columns.items()])


def _look_up(state: DataFrame, pointer: str, target: DataFrame) -> DataFrame:
    """Join each row to the node it points at.

    Rows that point nowhere would all meet in one partition under a null key, so they
    are keyed by themselves and get nulls.
    """
    names = [c for c in target.columns if c not in ("_tree", "_at")]
    joined = state.join(target, (F.col("tree_id") == F.col("_tree"))
                        & (F.coalesce(pointer, "node") == F.col("_at")), "left")
    return joined.select(*state.columns, *[F.when(F.col(pointer).isNotNull(), F.col(c)).alias(c)
                                           for c in names])


def _is_tip(edges: DataFrame) -> DataFrame:
    inner = (edges.filter(F.col("parent").isNotNull())
             .select("tree_id", F.col("parent").alias("node")).distinct()
             .withColumn("_inner", F.lit(True)))
    return (edges.drop("is_tip").join(inner, KEY, "left")
            .withColumn("is_tip", F.col("_inner").isNull()).drop("_inner"))


def membership(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Names (``tree_id, label``) with a flag telling whether the tree has them."""
    there = edges.select("tree_id", "label").distinct().withColumn("_there", F.lit(1))
    return (names.join(there, ["tree_id", "label"], "left")
            .withColumn("in_tree", F.coalesce("_there", F.lit(0))).drop("_there"))


def induced_subtree(edges: DataFrame, tips: DataFrame) -> DataFrame:
    """The subtree that connects the wanted tips (``tree_id, node``).

    Nodes with one remaining child are spliced out and their edge lengths added up;
    the root is the common ancestor of the wanted tips.
    """
    wanted = tips.select(*KEY).distinct().withColumn("_want", F.lit(True))
    marked = cut_lineage(edges.join(wanted, KEY, "left").select(
        *KEY, "parent", "label", "edge_length", F.col("parent").alias("jump"),
        F.coalesce("_want", F.lit(False)).alias("keep")))
    left = _rounds(edges)
    while _still(marked.filter(F.col("jump").isNotNull()).select(*KEY), left):
        left -= 1
        up = _looked_up(marked, "jump", _jump="jump")
        reached = (marked.filter(F.col("keep") & F.col("jump").isNotNull())
                   .select("tree_id", F.col("jump").alias("node")).distinct()
                   .withColumn("_hit", F.lit(True)))
        marked = cut_lineage(
            _look_up(marked, "jump", up).join(reached, KEY, "left")
            .select(*KEY, "parent", "label", "edge_length", F.col("_jump").alias("jump"),
                    (F.col("keep") | F.coalesce("_hit", F.lit(False))).alias("keep")))
    kept = marked.filter("keep").select(*KEY, "parent", "label", "edge_length")
    children = kept.groupBy("tree_id", F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("_kids"))
    forks = kept.join(children, KEY, "left").join(wanted, KEY, "left").withColumn(
        "stays", F.col("_want").isNotNull() | (F.col("_kids") > 1))
    state = cut_lineage(forks.select(*KEY, "label", "stays", F.col("parent").alias("up"),
                                     F.coalesce("edge_length", F.lit(0.0)).alias("edge_length"))
                        .withColumn("open", F.col("up").isNotNull()))
    left = _rounds(edges)
    while _still(state.filter("open").select(*KEY), left):
        left -= 1
        above = _looked_up(state, "up", _stays="stays", _up="up", _len="edge_length")
        # a node that stays ends the walk of those below it; others pass their own target on
        step = F.col("open") & ~F.col("_stays")
        state = cut_lineage(
            _look_up(state, "up", above)
            .select(*KEY, "label", "stays", F.when(step, F.col("_up")).otherwise(F.col("up"))
                    .alias("up"),
                    F.when(step, F.col("edge_length") + F.col("_len"))
                    .otherwise(F.col("edge_length")).alias("edge_length"),
                    (step & F.col("_up").isNotNull()).alias("open")))
    return state.filter("stays").select(
        *KEY, F.col("up").alias("parent"), "label",
        F.when(F.col("up").isNotNull(), F.col("edge_length")).otherwise(0.0)
        .alias("edge_length"))


def common_ancestor(edges: DataFrame, tips: DataFrame) -> DataFrame:
    """Deepest node above all wanted tips of each tree."""
    wanted = tips.select(*KEY).distinct().withColumn("_want", F.lit(1))
    totals = (edges.join(wanted, KEY).groupBy("tree_id").agg(F.count(F.lit(1)).alias("_k")))
    counted = node_metrics(edges.join(wanted, KEY, "left"),
                           F.coalesce(F.col("_want"), F.lit(0)))
    return (counted.join(totals, "tree_id").filter(F.col("below") == F.col("_k"))
            .groupBy("tree_id").agg(F.max_by("node", "depth").alias("mrca"),
                                    F.max("_k").alias("n_tips")))


def fill_labels(edges: DataFrame, prefix: str = "NodE", start: int = 0) -> DataFrame:
    """Number the inner nodes that have no label, in node order per tree."""
    marked = _is_tip(edges)
    blank = ~F.col("is_tip") & (F.col("label").isNull() | F.col("label").isin("", "NA"))
    counter = ranking.rank_within(marked.filter(blank).select(*KEY), ["tree_id"], ["node"], "_m")
    return (marked.join(counter, KEY, "left")
            .withColumn("label", F.when(F.col("_m").isNotNull(),
                                        F.concat(F.lit(prefix), F.col("_m") + start))
                        .otherwise(F.col("label"))).drop("_m"))


def node_info(edges: DataFrame) -> DataFrame:
    """Type, edge length and height above the lowest tip level of every node."""
    m = node_metrics(edges)
    top = m.groupBy("tree_id").agg(F.max("root_dist").alias("max_height"))
    base = edges.select(*KEY, "parent", "label", "edge_length")
    return (base.join(m, KEY).join(cut_lineage(top), "tree_id").select(
        *KEY, "label",
        F.when(F.col("parent").isNull(), "root").when(F.col("is_tip"), "tip")
        .otherwise("node").alias("type"),
        F.when(F.col("parent").isNull(), 0.0)
        .otherwise(F.coalesce("edge_length", F.lit(0.0))).alias("edge_length"),
        (F.col("max_height") - F.col("root_dist")).alias("edge_height"), "max_height"))


def grafen_lengths(edges: DataFrame, power: float = 0.5) -> DataFrame:
    """Edge lengths from clade sizes: height = ((tips below - 1) / (tips - 1)) ^ power."""
    m = node_metrics(edges)
    total = cut_lineage(m.filter(F.col("depth") == 0)
                        .select("tree_id", F.col("below").alias("_tips")))
    height = cut_lineage(m.join(total, "tree_id").select(
        *KEY, "is_tip", F.pow(F.try_divide((F.col("below") - 1).cast("double"),
                                  (F.col("_tips") - 1).cast("double")),
                     F.lit(power)).alias("height")))
    above = height.select("tree_id", F.col("node").alias("parent"), F.col("height").alias("_up"))
    return (edges.select(*KEY, "parent", "label").join(height, KEY)
            .join(above, ["tree_id", "parent"], "left")
            .select(*KEY, "parent", "label", "is_tip", "height",
                    F.coalesce(F.col("_up") - F.col("height"), F.lit(0.0)).alias("edge_length")))


def ladderize(edges: DataFrame, right: bool = True) -> DataFrame:
    """Position of each node among its siblings, ordered by clade size."""
    sized = (edges.select(*KEY, "parent", "label")
             .join(node_metrics(edges).select(*KEY, "below"), KEY))
    size = F.desc("below") if right else F.asc("below")
    return ranking.rank_within(sized, ["tree_id", "parent"], [size, "label", "node"])


def relabel(edges: DataFrame, names: dict[str, str]) -> DataFrame:
    """Replace labels by a fixed table; others stay."""
    from driftline.functions import rsem
    return edges.withColumn("label", rsem.mapped("label", names, keep_other=True))


def attach(edges: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """Join a summary to the tips by label; inner nodes and unmatched tips get nulls."""
    tips = _is_tip(edges).select(*KEY, "parent", "label", "is_tip")
    return tips.join(summary.withColumnRenamed(key, "_key"),
                     F.col("is_tip") & (F.col("label") == F.col("_key")), "left").drop("_key")


def add_tips(edges: DataFrame, anchors: DataFrame,
             prefix: str = "fork", start: int = 1) -> DataFrame:
    """Graft new tips at anchors ``(tree_id, anchor, new_tip, edge_length, seq)``.

    An anchor is the label of a tip or inner node.  The first new tip at a tip anchor
    splits its edge, at ``edge_length`` above the tip or half way; more tips at the same anchor
    hang from the same new node.  At an inner node the new tip reaches down to the tip
    level, whatever length is asked.  Node keys must be strings: new nodes are keyed by their labels,
    ``prefix`` and a number from ``start`` on; a later call on the result starts at ``next_fork``.
    A new key that the tree already has is an error.
    """
    info = cut_lineage(node_info(edges))
    base = edges.select(*KEY, "parent", "label")
    labels = info.groupBy("tree_id", F.col("label").alias("anchor")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("node").alias("_node"),
        F.min("type").alias("_type"), F.min("edge_length").alias("_len"),
        F.min("edge_height").alias("_height"))
    asked = cut_lineage(anchors.join(labels, ["tree_id", "anchor"], "left"))
    problems = asked.groupBy("tree_id", "anchor").agg(
        F.min("_n").alias("n"),
        F.count_distinct(F.when(F.col("_type") == "tip", F.coalesce(F.col("edge_length"), F.lit(-1.0))))
        .alias("lengths"),
        F.max(F.when(F.col("_type") == "tip", F.col("edge_length") > F.col("_len")))
        .alias("too_long"))
    message = (F.when(F.col("n").isNull(), "anchor not in tree")
               .when(F.col("n") > 1, "anchor label occurs more than once")
               .when(F.col("too_long"), "edge length exceeds the edge of the anchor")
               .when(F.col("lengths") > 1, "different edge lengths at one anchor"))
    bad = problems.withColumn("message", message).filter(F.col("message").isNotNull()).head(1)
    if bad:
        raise ValueError(f"{bad[0]['message']}: {bad[0]['anchor']} (tree {bad[0]['tree_id']})")

    at_tip = asked.filter(F.col("_type") == "tip")
    splits = at_tip.groupBy("tree_id", F.col("_node").alias("node")).agg(
        F.min("seq").alias("seq"),
        F.coalesce(F.max("edge_length"), F.max("_len") / 2).alias("_cut"))
    splits = cut_lineage(ranking.rank_within(splits, ["tree_id"], ["seq"], "_m").select(
        *KEY, "_cut", F.concat(F.lit(prefix), F.col("_m") + (start - 1)).alias("_new")))
    whole = base.join(info.select(*KEY, "edge_length"), KEY).join(splits, KEY, "left")
    old = whole.select(*KEY, F.coalesce("_new", "parent").alias("parent"), "label",
                       F.coalesce("_cut", "edge_length").alias("edge_length"))
    forks = whole.filter(F.col("_new").isNotNull()).select(
        "tree_id", F.col("_new").alias("node"), "parent", F.col("_new").alias("label"),
        (F.col("edge_length") - F.col("_cut")).alias("edge_length"))
    grafts = (asked.join(splits.withColumnRenamed("node", "_node"), ["tree_id", "_node"], "left")
              .select("tree_id", F.col("new_tip").alias("node"),
                      F.coalesce("_new", "_node").alias("parent"),
                      F.col("new_tip").alias("label"),
                      F.coalesce("_cut", "_height").alias("edge_length")))
    added = forks.select(*KEY).unionByName(grafts.select(*KEY))
    clash = (added.groupBy(*KEY).count().filter("count > 1").select(*KEY)
             .unionByName(added.join(base, KEY, "left_semi"))).head(1)
    if clash:
        raise ValueError(f"key already in use: {clash[0]['node']} (tree {clash[0]['tree_id']})")
    return old.unionByName(forks).unionByName(grafts)


def next_fork(edges: DataFrame, prefix: str = "fork") -> int:
    """First fork number that no node of ``edges`` bears: ``start`` of the next ``add_tips``."""
    number = F.regexp_extract("node", f"^{re.escape(prefix)}([0-9]+)$", 1)
    last = edges.filter(number != "").agg(F.max(number.cast("long"))).first()[0]
    return (last or 0) + 1
