"""Prefix trie of conversations, its subtree totals found by time-forward processing.

Conversation c begins with the first h turns of conversation c - c % 20, h = crc32(c) % 4, and goes on with
its own turns after its first h.  A node is a sequence of first turns that some rebuilt conversation
has; it is named by two 64-bit sums of hashes of (position, role, text), which are running sums
along a conversation, so a node's parent is named by a subtraction.

Totals go from the deepest nodes up.  Nodes are sorted (externally) by shard and falling depth; a
node takes the messages sent to it from a priority queue, adds its own part, and sends the total to its
parent.  The queue holds QUEUE messages in memory and keeps the rest in sorted runs in a file that the
task owns and that goes with it.  Shards are whole subtrees: a node whose members have more than
``limit`` turns from it on is heavy, a light node under a heavy one is the root of a shard.  So a
first turn or a conversation that a third of all share is cut up below the nodes it makes heavy.
The totals of shard roots are added up per heavy parent, and the heavy nodes (at most rows / limit
per depth) are processed in the same way.

Turns are numbered, and hashes added up, by one global sort with totals carried from partition to
partition, so that one conversation may hold any number of turns.  The digest of a node's ends is
sequential by definition: sorted ids are joined into pieces by all tasks, and one task per node
hashes its pieces as they stream by.

Defined cases: rows with null conversation take no part; null role or text is empty; turns of equal
number (null first) are in the order of a hash of role and text, repeated rows are turns of their own;
a negative id has the remainder of the same sign; very long texts are only hashed and counted; an empty
table gives no rows; columns beside the four are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import WORD, table
from driftline.session import cut_lineage

#: Turns that make a node heavy, at least; and parts of all turns that do.
LEAST_SHARD, SHARDS = 4096, 1024
#: Messages of a queue in memory.
QUEUE = 1 << 17
#: Ids of a piece of a digest.
PIECE = 4096
LONGEST_PREFIX, STEP = 3, 20

_NODE = ["d", "k1", "k2"]
_WRAP = Decimal(1 << 63)


# --- rebuilt conversations ----------------------------------------------------------------------

def _carried(rows: DataFrame, value: dict[str, Column]) -> DataFrame:
    """``rows`` (c, pid, mid, ...) with running sums of ``value`` over each c in the order of pid and mid.

    Sums run inside (pid, c); only a c that continues in a later partition needs the totals before.
    """
    inside = Window.partitionBy("pid", "c").orderBy("mid").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({n: F.sum(v).over(inside) for n, v in value.items()})
    per = Window.partitionBy("c")
    before = per.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("c", "pid").agg(*[F.sum(v).alias(n) for n, v in value.items()])
    offsets = cut_lineage(parts.withColumn("many", F.count("*").over(per)).where("many > 1").select(
        "c", "pid", *[F.sum(n).over(before).alias(f"{n}_0") for n in value]))
    out = local.join(offsets, ["c", "pid"], "left")
    return out.withColumns({n: F.col(n) + F.coalesce(f"{n}_0", F.lit(0)) for n in value}).drop(*[f"{n}_0" for n in value])


def _lane(seed: int, d: Column, h1: Column, h2: Column) -> Column:
    return F.xxhash64(F.lit(seed), d.cast("long"), h1, h2).cast("decimal(20,0)")


def prefixes(conversations: DataFrame) -> DataFrame:
    """(c, d, k1, k2, p1, p2, w, size): the nodes on the path of each rebuilt conversation.

    k1, k2 name the node and p1, p2 its parent (null: root), w counts the words of the last text,
    and size is the number of turns of the rebuilt conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(31), role, text).alias("h1"), F.xxhash64(F.lit(32), role, text).alias("h2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("w"))
    ordered = cut_lineage(turns.orderBy("c", F.asc_nulls_first("turn"), "h1", "h2").drop("turn")
                          .withColumn("mid", F.monotonically_increasing_id())
                          .withColumn("pid", F.shiftright("mid", 33)))
    numbered = cut_lineage(_carried(ordered, {"pos": F.lit(1).cast("long")}))
    own = F.crc32(F.col("c").cast("string").cast("binary")) % (LONGEST_PREFIX + 1)
    convs = cut_lineage(numbered.groupBy("c").agg(
        F.max("pos").alias("len"),
        F.array_sort(F.collect_list(F.when(F.col("pos") <= LONGEST_PREFIX, F.struct("pos", "h1", "h2", "w")))).alias("head"))
        .withColumn("h", own))
    bases = convs.where(F.col("c") % STEP == 0).select(F.col("c").alias("base"), "head")
    lent = convs.drop("head").withColumn("base", F.col("c") - F.col("c") % STEP).join(bases, "base", "left").select(
        "c", "len", "h", F.slice(F.coalesce("head", F.array().cast(convs.schema["head"].dataType)), F.lit(1),
                                 F.col("h").cast("int")).alias("lent"))
    total = lambda k, seed: F.aggregate(
        F.slice("lent", F.lit(1), k), F.lit(0).cast("decimal(38,0)"),
        lambda acc, x: (acc + _lane(seed, x["pos"], x["h1"], x["h2"])).cast("decimal(38,0)"))
    nb = F.size("lent")
    lent = cut_lineage(lent.select("c", "h", "lent", nb.alias("nb"), total(nb, 1).alias("b1"), total(nb, 2).alias("b2"),
                                   (nb + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("size")))

    rest = numbered.select("c", "pid", "mid", "pos", "h1", "h2", "w").join(lent.drop("lent"), "c").where("pos > h")
    rest = rest.withColumn("d", F.col("pos") - F.col("h") + F.col("nb")).withColumns(
        {f"l{s}": _lane(s, F.col("d"), F.col("h1"), F.col("h2")) for s in (1, 2)})
    rest = cut_lineage(rest.select("c", "pid", "mid", "d", "l1", "l2", "w", "b1", "b2", "size"))
    rest = _carried(rest, {"s1": F.col("l1"), "s2": F.col("l2")}).select(
        "c", "d", *[(F.col(f"s{s}") + F.col(f"b{s}")).cast("decimal(38,0)").alias(f"s{s}") for s in (1, 2)],
        "l1", "l2", "w", "size")
    first = lent.select("c", "size", F.explode(F.transform("lent", lambda x: F.struct(
        x["pos"].alias("d"), total(x["pos"].cast("int"), 1).alias("s1"), total(x["pos"].cast("int"), 2).alias("s2"),
        _lane(1, x["pos"], x["h1"], x["h2"]).alias("l1"), _lane(2, x["pos"], x["h1"], x["h2"]).alias("l2"),
        x["w"].alias("w")))).alias("x")).select("c", "x.*", "size")
    name = lambda s: F.pmod(s, F.lit(_WRAP)).cast("long")
    paths = rest.union(first.select(*rest.columns)).select(
        "c", F.col("d").cast("long").alias("d"), name(F.col("s1")).alias("k1"), name(F.col("s2")).alias("k2"),
        name(F.col("s1") - F.col("l1")).alias("p1"), name(F.col("s2") - F.col("l2")).alias("p2"),
        "w", F.col("size").cast("long").alias("size"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = lent.select("c", zero.alias("d"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"),
                       zero.alias("w"), F.col("size").cast("long").alias("size"))
    return paths.union(root)


# --- time-forward processing --------------------------------------------------------------------

class SpillingQueue:
    """Least-first queue of messages (depth, k1, k2, leaves, saved); the overflow lies in sorted runs of a file."""

    _ITEM = struct.Struct("<5q")

    def __init__(self, room: int = QUEUE):
        self.room, self.heap, self.heads, self.file = room, [], [], None

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.room:
            if self.file is None:
                self.file = tempfile.TemporaryFile()        # the task's own; gone when the task ends
            self.heap.sort()
            self.file.seek(0, 2)
            start = self.file.tell()
            for lo in range(0, len(self.heap), 4096):
                self.file.write(b"".join(self._ITEM.pack(*m) for m in self.heap[lo:lo + 4096]))
            self._follow(self._run(start, self.file.tell()))
            self.heap = []

    def _run(self, at: int, end: int) -> Iterator[tuple]:
        while at < end:
            self.file.seek(at)
            data = self.file.read(min(end - at, 256 * self._ITEM.size))
            at += len(data)
            yield from self._ITEM.iter_unpack(data)

    def _follow(self, run: Iterator[tuple]) -> None:
        item = next(run, None)
        if item is not None:
            heapq.heappush(self.heads, (item, id(run), run))

    def pop_at(self, key: tuple) -> Iterator[tuple[int, int]]:
        """(leaves, saved) of the messages to ``key``, which must be the least or absent."""
        while self.heap and self.heap[0][:3] == key:
            yield heapq.heappop(self.heap)[3:]
        while self.heads and self.heads[0][0][:3] == key:
            item, _, run = heapq.heappop(self.heads)
            self._follow(run)
            yield item[3:]

    def empty(self) -> bool:
        return not self.heap and not self.heads


_TOTALS = pa.schema([("d", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_children", pa.int64()),
                     ("n_leaves", pa.int64()), ("saved", pa.int64())])
_TASK = ["s0", "s1", "s2", "up", "k1", "k2", "p1", "p2", "own", "in_children", "in_leaves", "in_saved"]


def time_forward(nodes: DataFrame, room: int = QUEUE) -> DataFrame:
    """(d, k1, k2, n_children, n_leaves, saved) of ``nodes``, totals going up inside each shard.

    ``nodes`` has the shard s0, s1, s2 (null parts allowed), up (minus the depth), the names, the node's
    own part, and what its children outside the shard add.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, queue = None, SpillingQueue(room)
        for b in batches:
            out = []
            for s0, s1, s2, up, k1, k2, p1, p2, own, children, leaves, saved in zip(*[c.to_pylist() for c in b.columns]):
                if (s0, s1, s2) != shard:
                    shard, queue = (s0, s1, s2), SpillingQueue(room)
                for more, part in queue.pop_at((up, k1, k2)):
                    children, leaves, saved = children + 1, leaves + more, saved + part
                leaves, saved = leaves or 1, saved + own
                out.append((-up, k1, k2, children, leaves, saved))
                if p1 is not None and (-up, k1, k2) != shard:
                    queue.push((up + 1, p1, p2, leaves, saved))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else
                                             [pa.array([], pa.int64())] * 6, schema=_TOTALS)

    ordered = nodes.select(*_TASK).repartition("s0", "s1", "s2").sortWithinPartitions("s0", "s1", "s2", "up", "k1", "k2")
    return ordered.mapInArrow(run, ", ".join(f"{n} long" for n in _TOTALS.names))


# --- digests ------------------------------------------------------------------------------------

def end_digests(paths: DataFrame, piece: int = PIECE) -> DataFrame:
    """(d, k1, k2, ends): digest of the sorted ids of the conversations that end at each node."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []

        def close():
            if ids:
                out.append((*key, ids[0], ",".join(map(str, ids))))

        def flush():
            cols = list(zip(*out)) if out else [[]] * 5
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string())],
                                              [*_NODE, "first", "ids"])
        for b in batches:
            for *node, c in zip(*[col.to_pylist() for col in b.columns]):
                if node != key or len(ids) >= piece:
                    close()
                    key, ids = node, []
                ids.append(c)
            yield flush()
            out.clear()
        close()
        yield flush()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out = []
            for *node, ids in zip(*[col.to_pylist() for col in b.columns]):
                if node != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _digests(out)
        yield _digests([(*key, state.hexdigest())] if key is not None else [])

    ends = paths.where("d = size").select(*_NODE, "c")
    pieces = ends.repartitionByRange(*_NODE, "c").sortWithinPartitions(*_NODE, "c").mapInArrow(
        join, "d long, k1 long, k2 long, first long, ids string")
    return pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").select(*_NODE, "ids").mapInArrow(
        digest, "d long, k1 long, k2 long, ends string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())],
                                      [*_NODE, "ends"])


# --- the trie -----------------------------------------------------------------------------------

def prefix_trie(conversations: DataFrame, limit: int | None = None, room: int = QUEUE, piece: int = PIECE) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = cut_lineage(prefixes(conversations))
    nodes = cut_lineage(paths.groupBy(*_NODE).agg(
        F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
        F.max("w").alias("w"), F.sum(F.col("size") - F.col("d") + 1).alias("weight")))
    if limit is None:
        whole = nodes.where("d = 0").select("weight").head()
        limit = max(LEAST_SHARD, (whole.weight if whole else 0) // SHARDS)
    heavy = cut_lineage(nodes.where(F.col("weight") > limit))
    light = nodes.where(F.col("weight") <= limit)
    # the first light node on a conversation's path is the root of its shard
    shards = cut_lineage(paths.join(heavy.select(*_NODE), _NODE, "left_anti").groupBy("c").agg(
        F.min(F.struct(*_NODE)).alias("s")).select("c", F.col("s.d").alias("s0"), F.col("s.k1").alias("s1"), F.col("s.k2").alias("s2")))
    zero = F.lit(0).cast("long")
    task = light.join(shards, F.col("conv_id") == F.col("c")).select(
        "s0", "s1", "s2", (-F.col("d")).alias("up"), "k1", "k2", "p1", "p2",
        ((F.col("n_convs") - 1) * F.col("w")).alias("own"),
        zero.alias("in_children"), zero.alias("in_leaves"), zero.alias("in_saved"))
    totals = cut_lineage(time_forward(task, room))
    # what the roots of shards pass on, added up per heavy parent
    above = heavy.select((F.col("d") + 1).alias("d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"))
    given = (light.join(above, ["d", "p1", "p2"]).select(*_NODE, "p1", "p2").join(totals, _NODE)
             .groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
             .agg(F.count("*").alias("in_children"), F.sum("n_leaves").alias("in_leaves"), F.sum("saved").alias("in_saved")))
    none = F.lit(None).cast("long")
    tops = heavy.join(cut_lineage(given), _NODE, "left").select(
        none.alias("s0"), none.alias("s1"), none.alias("s2"), (-F.col("d")).alias("up"), "k1", "k2", "p1", "p2",
        ((F.col("n_convs") - 1) * F.col("w")).alias("own"),
        *[F.coalesce(n, zero).alias(n) for n in ("in_children", "in_leaves", "in_saved")])
    totals = totals.union(time_forward(tops, room))

    # parents' names: heavy parents have many children, so they are looked up apart
    slim = lambda df, name: df.select((F.col("d") + 1).alias("d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                                      F.col("conv_id").alias(name))
    named = cut_lineage(nodes.join(slim(heavy, "high"), ["d", "p1", "p2"], "left"))
    low = (named.where("high IS NULL").join(slim(light, "parent"), ["d", "p1", "p2"], "left"))
    whole = low.unionByName(named.where("high IS NOT NULL").withColumn("parent", F.col("high")))
    empty = hashlib.sha256(b"").hexdigest()
    return (whole.join(totals, _NODE).join(end_digests(paths, piece), _NODE, "left").select(
        "conv_id", F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(empty)).alias("ends_sha256")))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


_ORACLE = r"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
                lambda a, x: list_reduce([1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[],
                  lambda b, y: xor(b >> 1, CASE WHEN b & 1 = 1 THEN 3988292384 ELSE 0 END), xor(a, x)),
                4294967295::BIGINT), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM turns)),
parts AS (
  SELECT v.c, 0 AS own, t.pos, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c - v.c % 20 AND t.pos <= v.h
  UNION ALL
  SELECT v.c, 1, t.pos, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c AND t.pos > v.h),
rebuilt AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d,
         sha256(role || chr(0) || text) AS key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w
  FROM parts),
paths AS (
  SELECT c, d, string_agg(key, ' ') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path, w FROM rebuilt
  UNION ALL SELECT c, 0, '', 0 FROM convs),
sized AS (SELECT *, max(d) OVER (PARTITION BY c) AS size FROM paths),
nodes AS (
  SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(w) AS saved,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = size), '')) AS ends
  FROM sized GROUP BY d, path),
links AS (
  SELECT n.d, n.path, p.conv_id AS parent
  FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = CASE WHEN n.d = 1 THEN '' ELSE left(n.path, 65 * (n.d - 1) - 1) END),
kids AS (
  SELECT d - 1 AS d, CASE WHEN d = 1 THEN '' ELSE left(path, 65 * (d - 1) - 1) END AS path, count(*) AS n
  FROM nodes WHERE d > 0 GROUP BY 1, 2),
below AS (
  SELECT a.d, a.path, sum(n.saved) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
  FROM nodes n JOIN sized a ON a.c = n.conv_id AND a.d <= n.d LEFT JOIN kids k ON k.d = n.d AND k.path = n.path
  GROUP BY a.d, a.path)
SELECT n.conv_id, n.d AS depth, l.parent AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children,
       b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN links l USING (d, path) LEFT JOIN kids k USING (d, path) JOIN below b USING (d, path)
"""

QUERIES = {"op13_trie": op13_trie}
ORACLES = {"op13_trie": _ORACLE}
