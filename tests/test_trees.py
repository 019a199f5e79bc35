"""Tree operators against brute force on random and very deep trees."""

import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import names, taxonomy
from driftline.session import cut_lineage

SCHEMA = "tree_id string, node string, parent string, label string, edge_length double"


def random_tree(tree_id, n, seed, chain=0):
    rng = random.Random(seed)
    rows, nodes = [(tree_id, "n0", None, "L0", None)], ["n0"]
    for i in range(1, n):
        parent = nodes[-1] if i <= chain else rng.choice(nodes)
        rows.append((tree_id, f"n{i}", parent, f"L{i}", rng.randint(1, 9) / 2))
        nodes.append(f"n{i}")
    return rows


@pytest.fixture(scope="module")
def forest(spark):
    rows = random_tree("A", 40, 1) + random_tree("B", 70, 2, chain=35) + random_tree("C", 2, 3)
    return rows, spark.createDataFrame(rows, SCHEMA)


class Brute:
    def __init__(self, rows):
        self.parent = {(t, n): p for t, n, p, _, _ in rows}
        self.length = {(t, n): e or 0.0 for t, n, _, _, e in rows}
        self.inner = {(t, p) for t, _, p, _, _ in rows if p}

    def path(self, t, n):
        out = [n]
        while self.parent[t, out[-1]]:
            out.append(self.parent[t, out[-1]])
        return out

    def tips(self, t):
        return [n for (k, n) in self.parent if k == t and (k, n) not in self.inner]


def test_metrics_and_grafen(forest):
    rows, df = forest
    b = Brute(rows)
    graf = {(r["tree_id"], r["node"]): r for r in taxonomy.grafen_lengths(df).collect()}
    info = {(r["tree_id"], r["node"]): r for r in taxonomy.node_info(df).collect()}
    for r in taxonomy.node_metrics(df).collect():
        t, n = r["tree_id"], r["node"]
        path = b.path(t, n)
        assert r["depth"] == len(path) - 1
        assert r["root_dist"] == pytest.approx(sum(b.length[t, m] for m in path[:-1]))
        below = sum(n in b.path(t, tip) for tip in b.tips(t))
        assert r["below"] == below
        total = len(b.tips(t))
        if total > 1:
            assert graf[t, n]["height"] == pytest.approx(((below - 1) / (total - 1)) ** 0.5)
        far = max(sum(b.length[t, m] for m in b.path(t, tip)[:-1]) for tip in b.tips(t))
        assert info[t, n]["edge_height"] == pytest.approx(far - r["root_dist"])


def test_induced_subtree_and_common_ancestor(forest, spark):
    rows, df = forest
    b = Brute(rows)
    rng = random.Random(9)
    want = {t: rng.sample(b.tips(t), k) for t, k in (("A", 5), ("B", 4), ("C", 1))}
    tips = spark.createDataFrame([(t, n) for t, ns in want.items() for n in ns],
                                 "tree_id string, node string")
    got = {(r["tree_id"], r["node"]): r for r in taxonomy.induced_subtree(df, tips).collect()}
    mrca = {r["tree_id"]: r["mrca"] for r in taxonomy.common_ancestor(df, tips).collect()}
    for t, ns in want.items():
        paths = [b.path(t, n) for n in ns]
        shared = [m for m in paths[0] if all(m in p for p in paths)]
        assert mrca[t] == shared[0]
        kept = {m for p in paths for m in p[:p.index(shared[0]) + 1]}
        stay = {m for m in kept if m in ns or
                sum(b.parent[t, c] == m for c in kept if c != shared[0]) > 1}
        assert {n for k, n in got if k == t} == stay
        for n in stay:
            above = [m for m in b.path(t, n)[1:] if m in stay]
            row = got[t, n]
            assert row["parent"] == (above[0] if above else None)
            if above:
                p = b.path(t, n)
                assert row["edge_length"] == pytest.approx(
                    sum(b.length[t, m] for m in p[:p.index(above[0])]))


def test_ladder_and_labels(forest):
    rows, df = forest
    sizes = {(r["tree_id"], r["node"]): r["below"] for r in taxonomy.node_metrics(df).collect()}
    ladder = taxonomy.ladderize(df).collect()
    groups = {}
    for r in ladder:
        groups.setdefault((r["tree_id"], r["parent"]), []).append((r["position"], r["node"]))
    for (t, _), children in groups.items():
        order = [sizes[t, n] for _, n in sorted(children)]
        assert order == sorted(order, reverse=True)
    blank = df.withColumn("label", F.when(F.col("node").isin("n0", "n1"), "").otherwise("x"))
    got = taxonomy.fill_labels(blank, start=3).filter("label like 'NodE%'").collect()
    assert {(r["tree_id"], r["node"], r["label"]) for r in got} >= {
        ("A", "n0", "NodE4"), ("B", "n0", "NodE4"), ("B", "n1", "NodE5"), ("C", "n0", "NodE4")}


SMALL = [("T", "r", None, "r", None), ("T", "i", "r", "i", 1.0), ("T", "a", "i", "a", 2.0),
         ("T", "b", "i", "b", 2.0), ("T", "c", "r", "c", 3.0)]
ANCHOR = "tree_id string, anchor string, new_tip string, edge_length double, seq int"


def test_add_tips(spark):
    tree = spark.createDataFrame(SMALL, SCHEMA)
    anchors = spark.createDataFrame([
        ("T", "c", "c2", None, 1), ("T", "a", "a2", 0.5, 2), ("T", "c", "c3", None, 3),
        ("T", "i", "i2", None, 4)], ANCHOR)
    got = {r["node"]: (r["parent"], r["edge_length"])
           for r in taxonomy.add_tips(tree, anchors, prefix="New").collect()}
    assert got["c"] == ("New1", 1.5) and got["c2"] == ("New1", 1.5) == got["c3"]
    assert got["New1"] == ("r", 1.5)
    assert got["a"] == ("New2", 0.5) and got["a2"] == ("New2", 0.5)
    assert got["New2"] == ("i", 1.5) and got["i2"] == ("i", 2.0)
    assert got["b"] == ("i", 2.0) and got["r"][0] is None and len(got) == 11


@pytest.mark.parametrize("rows, message", [
    ([("T", "zz", "n", None, 1)], "not in tree"),
    ([("T", "a", "n", 5.0, 1)], "exceeds"),
    ([("T", "a", "n", 0.5, 1), ("T", "a", "m", 0.7, 2)], "different"),
])
def test_add_tips_refuses(spark, rows, message):
    with pytest.raises(ValueError, match=message):
        taxonomy.add_tips(spark.createDataFrame(SMALL, SCHEMA),
                          spark.createDataFrame(rows, ANCHOR))


def test_add_tips_refuses_repeated_label(spark):
    twice = SMALL + [("T", "d", "r", "a", 3.0)]
    with pytest.raises(ValueError, match="more than once"):
        taxonomy.add_tips(spark.createDataFrame(twice, SCHEMA),
                          spark.createDataFrame([("T", "a", "n", None, 1)], ANCHOR))


def test_membership_and_attach(spark):
    tree = spark.createDataFrame(SMALL, SCHEMA)
    asked = spark.createDataFrame([("T", "a"), ("T", "q"), ("U", "a")],
                                  "tree_id string, label string")
    got = {(r["tree_id"], r["label"]): r["in_tree"]
           for r in taxonomy.membership(tree, asked).collect()}
    assert got == {("T", "a"): 1, ("T", "q"): 0, ("U", "a"): 0}
    stats = spark.createDataFrame([("a", 4), ("i", 9)], "name string, n int")
    hung = {r["label"]: r["n"] for r in taxonomy.attach(tree, stats, "name").collect()}
    assert hung == {"a": 4, "b": None, "c": None, "i": None, "r": None}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_names_match_brute_force(spark):
    rng = random.Random(4)
    known = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 6)))
                    for _ in range(60)})
    asked = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 7)))
                    for _ in range(150)})
    tax = spark.createDataFrame([(k, i, "INCERTAE_SEDIS_INHERITED" if i % 7 == 0 else None)
                                 for i, k in enumerate(known)],
                                "label string, node long, flags string")
    q = spark.createDataFrame([(a.upper(),) for a in asked] + [("",), (None,)], "query string")
    got = {r["query"]: (r["label"], r["distance"])
           for r in names.resolve_names(q, tax).collect()}
    expected = {}
    for a in asked:
        best = min((edits(a, k), k, i) for i, k in enumerate(known))
        if best[0] <= 1 and best[2] % 7:
            expected[a.upper()] = (best[1], best[0])
    assert got == expected


def test_names_within_two_edits(spark):
    tax = spark.createDataFrame([("Gadus morhua", "n1", None), ("Salmo trutta", "n2", None)],
                                "label string, node string, flags string")
    asked = ["gadus_morhva", "gads morhu", "slamo trutta", "salmo tru", "gadus", "ga"]
    q = spark.createDataFrame([(a,) for a in asked], "query string")
    got = {k: {r["query"]: (r["node"], r["distance"]) for r in names.resolve_names(q, tax, edits=k).collect()}
           for k in (1, 2)}
    assert got[1] == {"gadus_morhva": ("n1", 1)}
    assert got[2] == {"gadus_morhva": ("n1", 1), "gads morhu": ("n1", 2), "slamo trutta": ("n2", 2)}


def test_add_tips_twice_numbers_on(spark):
    tree = spark.createDataFrame(SMALL, SCHEMA)
    tip = taxonomy.node_info(tree).filter("type = 'tip'").orderBy("label").select("label", "tree_id").first()
    ask = "tree_id string, anchor string, new_tip string, edge_length double, seq long"
    def one(name):
        return spark.createDataFrame([(tip["tree_id"], tip["label"], name, None, 1)], ask)
    once = cut_lineage(taxonomy.add_tips(tree, one("x1")))
    assert taxonomy.next_fork(tree) == 1 and taxonomy.next_fork(once) == 2
    with pytest.raises(ValueError, match="already in use"):
        taxonomy.add_tips(once, one("x2"))
    with pytest.raises(ValueError, match="already in use"):
        taxonomy.add_tips(once, one("x1"), start=2)
    twice = taxonomy.add_tips(once, one("x2"), start=2)
    keys = [(r["tree_id"], r["node"]) for r in twice.collect()]
    assert len(set(keys)) == len(keys) == tree.count() + 4


def test_a_cycle_of_parents_is_an_error(spark):
    rows = [("t", str(k), str((k + 1) % 5), str(k), 1.0) for k in range(5)]
    tree = spark.createDataFrame(rows, "tree_id string, node string, parent string, label string, edge_length double")
    with pytest.raises(ValueError, match="cycle"):
        taxonomy.node_metrics(tree)
