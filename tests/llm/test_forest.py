import pytest

from conftest import documents, edited, frame, words
from driftline.llm import forest


def plain(rows, width, percent):
    """Component and set size of each row, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        grams = [tuple(w[k:k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [tuple(w)] * bool(w)
        sets.append(frozenset(grams))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = (min(ids) if ids else None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id is not None and doc_id == component))
    return sorted(out, key=repr)


def found(df, width, percent, **options):
    out = forest.near_duplicates(df.select("doc_id", "text"), width, percent, **options)
    return sorted(map(tuple, out.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


@pytest.mark.parametrize("width", [2, 5])
def test_groups_match_all_pairs(docs, width):
    assert found(docs, width, 80) == plain(documents(), width, 80)


def test_chain_and_crowd(spark):
    """A chain of small edits, and many texts around one that none links to each other."""
    rows, text = [], words(1, 150)
    for k in range(25):
        rows.append((k, text))
        text = edited(text, k, 6)
    base = words(2, 150)
    rows += [(100 + k, edited(base, 1000 + k, 9 + k % 6)) for k in range(120)]
    assert found(frame(spark, rows), 2, 80) == plain(rows, 2, 80)


@pytest.mark.parametrize("tasks", ["3", "40"])
def test_crowd_larger_than_the_reach(spark, tasks):
    """One template, hardly any links, and a reach of one row; regions are cut between many tasks."""
    base = words(5, 120)
    rows = [(k, edited(base, 3000 + k, 9 + k % 5)) for k in range(300)]
    rows += [(1000 + k, edited(rows[k * 7][1], 9000 + k, 3 + k % 9)) for k in range(40)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        assert found(frame(spark, rows), 2, 80, reach=1) == plain(rows, 2, 80)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_join_beyond_the_reach_is_exact(spark):
    """The exact join alone finds all links between labels, and no group of one label."""
    base = words(6, 100)
    rows = [(k, edited(base, 500 + k, k % 14)) for k in range(150)]
    sets = [sorted({hash(g) for g in zip(t.split(), t.split()[1:])}) for _, t in rows]
    data = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "uid long, s array<long>")
    near = spark.createDataFrame([(k, k % 3) for k in range(0, 150, 2)], "node long, label long")
    label = {k: k % 3 for k in range(0, 150, 2)}
    want = {(a, b) for b in range(150) for a in range(b) if label.get(a, a) != label.get(b, b)
            and 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))}
    got = forest.beyond_reach(data.select("uid"), data, near, 80)
    exact = forest.confirmed(got, data, 80)
    assert want == {(r.a, r.b) for r in exact.collect()}
    one = near.select("node").union(data.select("uid")).distinct().selectExpr("node", "1L AS label")
    assert forest.beyond_reach(data.select("uid"), data, one, 80).count() == 0


def test_empty_table(no_docs):
    assert found(no_docs, 2, 80) == []


def test_one_row_of_each_group_stays(docs, clashing):
    rows = forest.without_near_copies(docs, 5, 80)
    groups = forest.near_duplicates(docs.select("doc_id", "text"), 5, 80)
    wordless = groups.where("n_shingles = 0").count()
    assert rows.columns == docs.columns
    assert rows.count() == groups.where("n_shingles > 0").select("label").distinct().count() + wordless
    assert forest.without_near_copies(clashing, 5, 80).count() == rows.count()
    assert rows.where("doc_id = 7").count() == 1 and rows.where("text is null").count() == 2


@pytest.mark.parametrize("block", [512, 16])
def test_crowds_give_links_only(spark, monkeypatch, block):
    """No pair that does not link leaves the exact join, whatever the blocks, parts and tiles; a second crowd and loners are apart."""
    monkeypatch.setattr(forest, "BLOCK", block)
    monkeypatch.setattr(forest, "TILE", 64)
    monkeypatch.setattr(forest, "PART_SHINGLES", 700)
    texts = [edited(words(6, 100), 500 + k, k % 14) for k in range(120)] + [edited(words(8, 90), k, 4 + k % 9) for k in range(60)]
    texts += [words(700 + k, 30) for k in range(10)]
    sets = [{hash(g) for g in zip(t.split(), t.split()[1:])} for t in texts]
    data = spark.createDataFrame([(k, sorted(s)) for k, s in enumerate(sets)], "uid long, s array<long>")
    near = spark.createDataFrame([(k, 500 + k % 5) for k in range(0, 150, 2)], "node long, label long")
    label = {k: 500 + k % 5 for k in range(0, 150, 2)}
    want = {(a, b, len(sets[a] & sets[b])) for b in range(190) for a in range(b) if label.get(a, a) != label.get(b, b)
            and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    links = forest.beyond_reach(data.select("uid"), data, near, 80)
    got = links.collect()
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert ", i#" in plan.split("FlatMapGroupsInArrow")[1].split("hashpartitioning(")[1].split(")")[0]      # not one task per crowd
    assert len(want) > 100 and len(got) == len(want) and set(map(tuple, got)) == want
    none = forest.beyond_reach(data.select("uid").limit(0), data, near, 80)
    assert none.count() == 0
