import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import types as T

from driftline.llm import trie

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """All nodes from dictionaries of tuples."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    words = lambda s: len(re.findall(r"[^\x20\x09-\x0D]+", s))
    kids, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = leaves.get(node, 0) or 1
        saved[node] = saved.get(node, 0) + ((len(members[node]) - 1) * words(node[-1][1]) if node else 0)
        if node:
            up = node[:-1]
            kids[up] = kids.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[node]
            saved[up] = saved.get(up, 0) + saved[node]
    out = []
    for node, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if built[c] == node)))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), kids.get(node, 0),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(seed, convs, alphabet=3, longest=7):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), "word " * rng.randint(0, alphabet - 1) + "end")
            for c in rng.sample(range(-30, 4 * convs), convs) for t in range(rng.randint(1, longest))]


def found(spark, rows, parts=3, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    out = trie.prefix_trie(df, **options)
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"limit": 40}, {"limit": 3, "room": 2, "piece": 2}, {"limit": 0}])
def test_equals_dictionaries(spark, options):
    rows = rows_of(1, 150)
    assert found(spark, rows, **options) == plain(rows)


def test_common_first_turn_and_common_conversation(spark):
    rows = rows_of(2, 60)
    for c in range(1000, 1300):
        same = [(c, 0, "user", "a common first turn"), (c, 1, "assistant", "and its answer"), (c, 2, "user", "thanks")]
        rows += same if c % 2 else same[:1] + [(c, 1, "assistant", f"answer {c}"), (c, 2, "user", "thanks"), (c, 3, "x", "y")]
    want = plain(rows)
    assert found(spark, rows, limit=50, room=8, piece=7) == want
    assert found(spark, rows, parts=17) == want


def test_long_conversation_over_many_partitions(spark):
    rows = [(40, t, "user", f"turn {t % 5}") for t in range(900)] + [(41, t, "user", f"turn {t % 5}") for t in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark, rows, parts=6, limit=100, room=3) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_odd_rows(spark):
    rows = [(None, 0, "user", "nobody"), (0, None, "user", "null turn first"), (0, 0, None, None), (0, 1, "", ""),
            (1, 5, "user", "tab\tand\x0bline \x0c end"), (2, 0, "user", "short"), (20, 1, "a", "x"), (20, 1, "a", "x"),
            (21, 1, "a", "x"), (22, 7, "a", " x y"), (-5, 0, "user", "negative"), (39, 0, "é", "w " * 200_000)]
    rows += [(60 + k, t, "user", "same") for k in range(8) for t in range(2)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS c", "2 AS d", "3 AS k1", "4 AS size", "5 AS pid")
    assert sorted(map(tuple, trie.prefix_trie(df).collect()), key=repr) == plain(rows)


def test_checking_sql_says_the_same(spark):
    rows = rows_of(3, 80)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({trie.ORACLES['op13_trie']})").fetchall()
    assert sorted(got, key=repr) == plain(rows)


def test_queue_spills_and_keeps_order():
    rng, queue, items = random.Random(4), trie.SpillingQueue(5), []
    for _ in range(200):
        items.append((rng.randint(-3, 0), rng.randint(-9, 9), rng.randint(0, 2), rng.randint(0, 5), rng.randint(0, 5)))
        queue.push(items[-1])
    assert queue.file is not None
    for key in sorted({m[:3] for m in items}):
        assert sorted(queue.pop_at(key)) == sorted(m[3:] for m in items if m[:3] == key)
    assert queue.empty()
