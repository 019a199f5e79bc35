"""Near-duplicate groups by an LSH forest of MinHash signatures.

Texts of equal shingle sets are one class.  A class has 128 MinHash bytes; each of 32 trees orders
all classes by the signature from another starting place on, in one range-partitioned sort.
Neighbours in an order that share a prefix of four places or more are candidates, each with the
few that follow it: where a region is sparse these are all that share the shortest prefix, and
where it is crowded they are those of the longest common prefix, so depth adapts to the region
and no group is paired off.  The two best candidates of each class are confirmed on full shingle
sets.  A second pass over the classes that had candidates looks much further along each order,
but only at neighbours in other components than the row's own, and confirms all that could link:
two sets share no shingle that only one class has, and no more of the others than the smaller
count in each of 256 buckets, which bounds their similarity closely.  Both passes name the classes
that share a prefix with rows they did not meet, for lack of reach or because two tasks share the region.  The
second pass takes in those of the first, and those of the second meet in crowds that share rare
shingles, block by block (``beyond_reach``), so no reach loses a link.  A pair at the threshold of 0.8 shares four places in some tree with a chance of 1 - 5e-8.

Defined cases: null, empty and blank texts have no shingles and are groups of their own; a text with
fewer words than a shingle is one shingle; repeated rows are one class; a null id never names
a group unless all ids of the group are null, and such rows are not kept; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.llm.common import byte_chunks, counter, mix, pair_hash, table, word_hashes
from driftline.llm.components import components
from driftline.session import cut_lineage

TREES, DEPTH, KEY = 32, 4, 32
PLACES = TREES * DEPTH
#: Following neighbours in an order in the first and second pass, agreeing places of a key that a
#: candidate needs, and candidates of each class, then of each two parts, confirmed in the first pass.
NEIGHBOURS, FAR_NEIGHBOURS, AGREE, BEST = 6, 256, 18, 2
BITS, BUCKETS = 23, 256
#: In place of a candidate: the class did not meet all rows of its prefix.
UNSEEN = -1
#: Classes and shingles of a block of a crowd, shingles in a tile of its matrix, and in a part when they are counted.
BLOCK, BLOCK_SHINGLES, TILE, PART_SHINGLES = 512, 1 << 18, 1 << 12, 1 << 20

_MULTIPLIERS = counter(PLACES, 3)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a chunk."""
    words, at = word_hashes(data, offsets)
    grams = words
    for k in range(1, min(width, words.size)):
        grams = pair_hash(grams[:-1], words[k:])
    for i in range(offsets.size - 1):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= width:
            yield np.unique(grams[a:b - width + 1])
        elif b > a:
            whole = words[a:a + 1]
            for k in range(1, b - a):
                whole = pair_hash(whole, words[a + k:a + k + 1])
            yield pair_hash(whole, np.array([b - a], np.uint64))       # never equals a full shingle
        else:
            yield np.zeros(0, np.uint64)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Size, two 64-bit set hashes and MinHash bytes of each set; empty sets have zeros."""
    size = np.array([s.size for s in sets], np.int64)
    h1, h2 = np.zeros(size.size, np.uint64), np.zeros(size.size, np.uint64)
    bytes_ = np.zeros((size.size, PLACES), np.uint8)
    full = np.flatnonzero(size)
    if full.size:
        every = np.concatenate([sets[i] for i in full])
        at = np.concatenate([[0], np.cumsum(size[full])[:-1]])
        with np.errstate(over="ignore"):
            h1[full] = np.add.reduceat(mix(every), at)
            h2[full] = np.add.reduceat(mix(~every), at)
            for k in range(PLACES):
                bytes_[full, k] = mix(np.minimum.reduceat(every * _MULTIPLIERS[k], at)) >> np.uint64(56)
    return size, h1.view(np.int64), h2.view(np.int64), bytes_


def measure(rows: DataFrame, width: int) -> DataFrame:
    """doc_id, h (hash of the text), size, h1, h2, sig of each row of ``rows`` (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in byte_chunks(b.column(2)):
                size, h1, h2, sig = signatures(list(shingle_sets(data, offs, width)))
                sig = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PLACES), hi - lo, [None, pa.py_buffer(sig.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(size),
                                                  pa.array(h1), pa.array(h2), sig.cast(pa.binary())],
                                                 ["doc_id", "h", "size", "h1", "h2", "sig"])
    return rows.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, h long, size long, h1 long, h2 long, sig binary")


def candidates(classes: DataFrame, reach: int, percent: int) -> DataFrame:
    """(a, b, agree) with a < b: neighbours in the sorted orders of ``classes`` (uid, label, size, hist, sig).

    A row meets up to ``reach`` following rows as long as they share its prefix; rows of
    one label are not paired, nor sets that cannot meet the threshold, given their sizes and their
    ``hist`` (counts, in buckets, of the shingles that others may have; empty for unknown).
    A class ``a`` that shares a prefix with rows it did not meet has a row with b = UNSEEN: those further
    off than the reach, and the first and last region of a task, which may go on in another.
    """
    keys = (classes.select("uid", "label", "size", "hist", F.concat("sig", "sig").alias("twice"),
                           F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
            .select(F.col("tree").cast("byte").alias("tree"),
                    F.substring("twice", F.col("tree") * DEPTH + 1, F.lit(KEY)).alias("key"), "uid", "label",
                    F.col("size").cast("int").alias("size"), "hist"))
    # The class id is part of the order, so equal keys may span partitions.
    ordered = keys.repartitionByRange("tree", "key", "uid").sortWithinPartitions("tree", "key", "uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lead = None, None

        def unseen(uids: np.ndarray) -> pa.RecordBatch:
            uids = np.unique(uids)
            return pa.RecordBatch.from_arrays([pa.array(uids), pa.array(np.full(uids.size, UNSEEN)),
                                               pa.array(np.zeros(uids.size, np.int32))], ["a", "b", "agree"])

        for b in batches:
            if b.num_rows == 0:
                continue
            raw = b.column(1)
            key = np.frombuffer(raw.buffers()[2], np.uint8)
            start = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset]
            now = [key[start:start + b.num_rows * KEY].reshape(-1, KEY),
                   *(np.asarray(b.column(k)).astype(np.int64) for k in (0, 2, 3, 4)), _histogram(b.column(5))]
            if held is None:
                lead = now[1][0], now[0][0, :DEPTH]
            if lead is not None:                                     # the region the task starts with
                same = (now[1] == lead[0]) & (now[0][:, :DEPTH] == lead[1]).all(1)
                yield unseen(now[2][same])
                lead = lead if same.all() else None
            old = 0
            if held is not None:                                     # the last rows of the batch before
                old = held[1].size
                now = [np.concatenate(p) for p in zip(held, now)]
            key, tree, uid, label, size, hist = now
            lo = np.arange(uid.size)
            for step in range(1, reach + 2):
                lo = lo[lo < uid.size - step]
                lo = lo[(tree[lo] == tree[lo + step]) & (key[lo, :DEPTH] == key[lo + step, :DEPTH]).all(1)]
                if lo.size == 0:
                    break
                if step > reach:
                    yield unseen(np.concatenate([uid[lo], uid[lo + step]]))
                    break
                x = lo[(lo + step >= old) & (label[lo] != label[lo + step])]
                both = np.minimum(size[x], size[x + step])
                x = x[100 * both >= percent * (size[x] + size[x + step] - both)]
                agree = (key[x] == key[x + step]).sum(1)
                x, agree = x[agree >= AGREE], agree[agree >= AGREE]
                if hist.shape[1]:
                    each = np.minimum(hist[x], hist[x + step])
                    both = np.where((each == 255).any(1), np.minimum(size[x], size[x + step]), each.sum(1, dtype=np.int64))
                    could = 100 * both >= percent * (size[x] + size[x + step] - both)
                    x, agree = x[could], agree[could]
                if x.size:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(uid[x], uid[x + step])), pa.array(np.maximum(uid[x], uid[x + step])),
                         pa.array(agree.astype(np.int32))], ["a", "b", "agree"])
            held = [part[-reach - 1:] for part in now]
        if held is not None:                                         # the region the task ends with
            same = (held[1] == held[1][-1]) & (held[0][:, :DEPTH] == held[0][-1, :DEPTH]).all(1)
            yield unseen(held[2][same])

    return (ordered.mapInArrow(run, "a long, b long, agree int")
            .groupBy("a", "b").agg(F.sum("agree").alias("agree")))


def _histogram(column: pa.Array) -> np.ndarray:
    """Bucket counts of each row; no columns where the rows are empty.  255 stands for any larger count."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(len(column), -1) if raw else np.zeros((len(column), 0), np.uint8)


def _bucket_counts(sets: list[np.ndarray]) -> np.ndarray:
    row = np.repeat(np.arange(len(sets)), [s.size for s in sets])
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    flat = row * BUCKETS + (every & np.uint64(BUCKETS - 1)).astype(np.int64)
    return np.bincount(flat, minlength=len(sets) * BUCKETS).reshape(len(sets), BUCKETS).astype(np.uint32)


def _shareable(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """(uid, hist): bucket counts of each set without the shingles that no other set has."""
    own = (sets.select("uid", F.explode("s").alias("g")).groupBy("g").agg(F.count("*").alias("n"), F.min("uid").alias("uid"))
           .where("n = 1").groupBy("uid").agg(F.collect_list(F.col("g").bitwiseAND(BUCKETS - 1).cast("short")).alias("own")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hist = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, BUCKETS).copy()
            for i in range(b.num_rows):
                if b.column(2)[i].is_valid:
                    hist[i] -= np.bincount(np.asarray(b.column(2)[i].values), minlength=BUCKETS).astype(np.uint32)
            hist = np.minimum(hist, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h.tobytes() for h in hist], pa.binary())], ["uid", "hist"])

    return (classes.select("uid").join(sets.select("uid", "hist"), "uid").join(own, "uid", "left")
            .select("uid", "hist", "own").mapInArrow(run, "uid long, hist binary"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose sets (uid, s) meet in ``percent`` % of their union."""
    left = sets.select(F.col("uid").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("uid").alias("b"), F.col("s").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            sa, sb = b.column(2), b.column(3)
            for i in range(b.num_rows):
                x, y = np.asarray(sa[i].values), np.asarray(sb[i].values)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                out.append(100 * common >= percent * (x.size + y.size - common))
            keep = pa.array(out, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return (pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
            .mapInArrow(run, "a long, b long"))


def beyond_reach(classes: DataFrame, sets: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """(a, b, agree): all pairs of ``classes`` (uid) between labels of ``near`` that link, and the shingles they share.

    Two linked sets share more than ``percent`` % of each, so they share one of the rarest shingles of
    each, and only shingles that several labels have can be shared.  Classes that share a rare shingle, in one
    step or several, are a crowd, and links lie within crowds.  A crowd is dealt into blocks of bounded
    size, and each two blocks are compared in one group, whose matrix products count what all pairs share.
    """
    labels = near.select(F.col("node").alias("uid"), "label")
    rows = cut_lineage(classes.join(sets.select("uid", "s"), "uid").join(labels, "uid", "left")
                       .select("uid", F.coalesce("label", "uid").alias("label"), F.size("s").alias("size"), "s"))
    least = F.ceil(F.col("size") * percent / 100).cast("int")
    open_ = cut_lineage(_between_labels(rows).withColumn("v", F.size("g")).where(F.col("v") >= least))
    rare = (open_.select("uid", F.explode(F.slice(F.sort_array(F.arrays_zip("n", "g")), 1, F.col("v") - least + 1)).alias("t"))
            .select("uid", F.col("t.g").alias("g")))
    stars = rare.groupBy("g").agg(F.min("uid").alias("a"), F.count("*").alias("n")).where("n > 1").select("g", "a")
    crowds = components(rare.join(stars, "g").select("a", F.col("uid").alias("b")).distinct())
    joined = open_.join(crowds.select(F.col("node").alias("uid"), F.col("label").alias("crowd")), "uid")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("v") / BLOCK_SHINGLES)).cast("int")
    large = joined.groupBy("crowd").agg(blocks.alias("blocks"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    dealt = (joined.join(large, "crowd").withColumn("own", F.pmod(F.xxhash64("uid"), "blocks").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("crowd", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     "own", "uid", "label", "size", "g"))

    def linked(group: pa.Table) -> pa.Table:
        """Links of two blocks, or of one."""
        own, uid, label, size = (group[c].to_numpy() for c in ("own", "uid", "label", "size"))
        left, right = (np.flatnonzero(own == group[c][0].as_py()) for c in ("i", "j"))
        same = left.size == own.size
        values, row = _flat(group["g"])
        u, at, n = np.unique(values, return_inverse=True, return_counts=True)
        often = n > 1
        place = np.cumsum(often) - 1
        keep = often[at]
        at, row = place[at[keep]], row[keep]
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
        both = np.zeros((left.size, right.size), np.float32)
        for lo in range(0, int(often.sum()), TILE):
            x = slice(*np.searchsorted(at, [lo, lo + TILE]))
            has = np.zeros((own.size, TILE), np.float32)
            has[row[x], at[x] - lo] = 1
            both += has[left] @ has[right].T
        close = ((100 + percent) * both.astype(np.int64) >= percent * (size[left][:, None].astype(np.int64) + size[right])) \
            & (label[left][:, None] != label[right])
        if same:
            close = np.triu(close, 1)
        x, y = np.nonzero(close)
        a, b = uid[left[x]], uid[right[y]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "agree": both[x, y].astype(np.int32)})

    # Dealt by all three, since a grouping after the join on crowds would leave a crowd in one task.
    return dealt.repartition("crowd", "i", "j").groupBy("crowd", "i", "j").applyInArrow(linked, "a long, b long, agree int")


def _flat(lists: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists and the row of each."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    return np.asarray(lists.flatten()), np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))


def _between_labels(rows: DataFrame) -> DataFrame:
    """``rows`` (uid, label, size, s) with g, the shingles that several labels have, and n, the rows that have each.

    The shingles of a row travel as packed lists, one for each part of all shingles.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = max(8, total // PART_SHINGLES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, row = _flat(b.column(2))
            key = row * parts + (values.view(np.uint64) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            row, part = key[starts] // parts, key[starts] % parts
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)),
                 pa.ListArray.from_arrays(pa.array(np.append(starts, key.size).astype(np.int32)), pa.array(values[order]))],
                ["part", "uid", "label", "s"])

    def count(group: pa.Table) -> pa.Table:
        values, row = _flat(group["s"])
        order = np.argsort(values, kind="stable")
        g, at = values[order], row[order]
        starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        label, n = group["label"].to_numpy()[at], np.diff(np.append(starts, g.size))
        several = np.minimum.reduceat(label, starts) < np.maximum.reduceat(label, starts)
        keep = np.repeat(several, n)
        g, at, n = g[keep], at[keep], np.repeat(n, n)[keep].astype(np.int32)
        order = np.argsort(at, kind="stable")
        which, starts = np.unique(at[order], return_index=True)
        bounds = pa.array(np.append(starts, at.size).astype(np.int32))
        return pa.table({"uid": group["uid"].to_numpy()[which], "g": pa.ListArray.from_arrays(bounds, pa.array(g[order])),
                         "n": pa.ListArray.from_arrays(bounds, pa.array(n[order]))})

    found = (rows.select("uid", "label", "s").mapInArrow(deal, "part int, uid long, label long, s array<long>")
             .groupBy("part").applyInArrow(count, "uid long, g array<long>, n array<int>")
             .groupBy("uid").agg(F.collect_list(F.struct("g", "n")).alias("m")))
    return rows.drop("s").join(found.select("uid", F.flatten("m.g").alias("g"), F.flatten("m.n").alias("n")), "uid")


def near_duplicates(rows: DataFrame, width: int, percent: int, reach: int = FAR_NEIGHBOURS) -> DataFrame:
    """doc_id, h, n_shingles, component_id, kept and label of each row of ``rows`` (doc_id, text).

    Rows are linked whose sets of ``width``-word shingles have a Jaccard similarity of
    ``percent`` % or more; a component is named by its smallest id, whose row is kept.  ``h`` hashes the text, ``label`` is
    one number per component and null without shingles.  ``reach`` parts the work between the forest's
    second pass and the exact join; it does not bear on the rows.
    """
    measured = cut_lineage(measure(rows, width))
    classes = cut_lineage(measured.where("size > 0").groupBy("size", "h1", "h2")
                          .agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "sig")).alias("m"))
                          .select(F.monotonically_increasing_id().alias("uid"), "size", "h1", "h2",
                                  F.col("m.doc_id").alias("first"), F.col("m.sig").alias("sig")))
    alone = classes.select("uid", F.col("uid").alias("label"), "size", F.lit(b"").alias("hist"), "sig")
    met = cut_lineage(candidates(alone, NEIGHBOURS, percent))
    pairs = _met(met)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("uid")).union(_unseen(met)).distinct()
    wanted = cut_lineage(nodes.join(classes, "uid"))
    sets = cut_lineage(_sets(rows, wanted, width))

    ends = pairs.select("a", "b", "agree", F.explode(F.array("a", "b")).alias("end"))
    best = W.partitionBy("end").orderBy(F.desc("agree"), F.xxhash64("a", "b"))
    first = (ends.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= BEST)
             .select("a", "b").distinct())
    first = cut_lineage(first)
    near = components(confirmed(first, sets, percent))
    hist = cut_lineage(_shareable(wanted, sets))

    def across(near: DataFrame, reach: int) -> DataFrame:
        """Candidates between different labels of ``near`` that could link."""
        labels = near.select(F.col("node").alias("uid"), "label")
        rows = wanted.select("uid", "size", "sig").join(hist, "uid").join(labels, "uid", "left")
        rows = rows.withColumn("label", F.coalesce("label", "uid"))
        return cut_lineage(candidates(cut_lineage(rows), reach, percent))

    by_parts = W.partitionBy("la", "lb").orderBy(F.desc("agree"), F.xxhash64("a", "b"))

    def by_best(mates: DataFrame, near: DataFrame) -> DataFrame:
        """``near`` after the best of the candidates ``mates`` between each two of its parts."""
        some = cut_lineage(_between(mates, near).withColumn("_r", F.row_number().over(by_parts)).where(F.col("_r") <= BEST))
        return _merge(near, confirmed(some, sets, percent).join(some.select("a", "b", "la", "lb"), ["a", "b"]))

    # Groups may still lie in parts: the best candidates of each two parts come next.
    near = by_best(_met(across(near, NEIGHBOURS)).join(first, ["a", "b"], "left_anti"), near)
    open_ = across(near, reach)
    near = _merge(near, _between(confirmed(_met(open_), sets, percent), near))
    rest = cut_lineage(beyond_reach(_unseen(open_), sets, near, percent))
    labels = _merge(near, _between(rest, near))
    grouped = classes.join(labels, classes["uid"] == labels["node"], "left").select(
        "size", "h1", "h2", "first", F.coalesce("label", "uid").alias("label"))
    grouped = cut_lineage(grouped)
    # Written before the join, so that Spark may split the rows of a large component.
    names = grouped.groupBy("label").agg(F.min("first").alias("component_id"))
    names = cut_lineage(names)
    named = grouped.join(names, "label").select("size", "h1", "h2", "label", "component_id")
    out = measured.select("doc_id", "h", "size", "h1", "h2").join(named, ["size", "h1", "h2"], "left")
    component = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "h", F.col("size").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "label")


def _met(found: DataFrame) -> DataFrame:
    return found.where(F.col("b") != UNSEEN)


def _unseen(found: DataFrame) -> DataFrame:
    return found.where(F.col("b") == UNSEEN).select(F.col("a").alias("uid"))


def _between(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose ends have different labels la < lb in ``near`` (node, label)."""
    a = near.select(F.col("node").alias("a"), F.col("label").alias("la"))
    b = near.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    ends = (pairs.join(a, "a", "left").join(b, "b", "left")
            .withColumns({"la": F.coalesce("la", "a"), "lb": F.coalesce("lb", "b")}).where("la <> lb"))
    return ends.withColumns({"la": F.least("la", "lb"), "lb": F.greatest("la", "lb")})


def _merge(near: DataFrame, links: DataFrame) -> DataFrame:
    """``near`` (node, label) after also joining the labels ``links`` (la, lb)."""
    far = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    far = far.select(F.col("node").alias("part"), F.col("label").alias("top"))
    moved = near.join(far, near["label"] == far["part"], "left").select("node", F.coalesce("top", "label").alias("label"))
    # labels of classes that had no links before
    new = far.join(near, far["part"] == near["node"], "left_anti").select(F.col("part").alias("node"), F.col("top").alias("label"))
    return cut_lineage(moved.union(new))


def without_near_copies(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """``documents`` with one row of each near-duplicate group, that of the smallest id.

    Null ids come last; among texts of one id the one of least hash stays, and one of equal
    rows.  Rows without words are groups of their own, so all of them stay.
    """
    groups = cut_lineage(near_duplicates(documents.select("doc_id", "text"), width, percent))
    row = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")
    worded = groups.where("n_shingles > 0").groupBy("label").agg(F.min(row).alias("m")).select("m.doc_id", "m.h")
    times = groups.groupBy("doc_id", "h").agg(F.count("*").alias("n"), F.max("n_shingles").alias("words"))
    kept = times.where("words = 0").select("doc_id", "h", F.lit(False).alias("one")).union(
        times.where("words > 0").join(worded.withColumnsRenamed({"doc_id": "wi", "h": "wh"}),
                                      F.col("doc_id").eqNullSafe(F.col("wi")) & (F.col("h") == F.col("wh")))
        .select("doc_id", "h", (F.col("n") > 1).alias("one")))
    kept = cut_lineage(kept.select(F.col("doc_id").alias("ki"), F.col("h").alias("kh"), "one"))
    rows = documents.select(F.col("doc_id").cast("long").alias("k"), F.xxhash64("text").alias("h"), F.struct("*").alias("row"))
    hit = rows.join(kept, F.col("k").eqNullSafe(F.col("ki")) & (F.col("h") == F.col("kh")))
    again = hit.where("one").withColumn("r", F.row_number().over(W.partitionBy("k", "h").orderBy(F.lit(1)))).where("r = 1")
    return hit.where("not one").select("row.*").union(again.select("row.*"))


def _sets(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(uid, s, hist): full shingle sets of the classes ``wanted`` and their counts in buckets.

    A bitmap of fixed size over the wanted ids keeps other texts from being shuffled; the join decides.
    """
    spot = F.shiftrightunsigned(F.xxhash64(F.coalesce("first", F.lit(-1))), 64 - BITS)
    places = wanted.select(spot.alias("p")).distinct().toArrow()["p"].to_numpy()          # at most 2^23
    bitmap = np.zeros(1 << BITS, bool)
    bitmap[places] = True
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            b = b.filter(pa.array(marks[np.asarray(b.column(1))]))
            for lo, hi, data, offs in byte_chunks(b.column(2)):
                sets = list(shingle_sets(data, offs, width))
                size, h1 = _set_hashes(sets)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)),
                    pa.array(np.concatenate(sets).view(np.int64)))
                hist = pa.array([h.tobytes() for h in _bucket_counts(sets)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(h1), lists, hist],
                                                 ["first", "h1", "s", "hist"])

    found = (rows.select(F.col("doc_id").cast("long").alias("first"), F.coalesce("text", F.lit("")).alias("text"))
             .select("first", spot.alias("p"), "text").mapInArrow(run, "first long, h1 long, s array<long>, hist binary"))
    match = wanted.select("uid", F.col("h1").alias("wh"), F.col("first").alias("wf"))
    return (found.join(match, (F.col("h1") == F.col("wh")) & F.col("first").eqNullSafe(F.col("wf")))
            .select("uid", "s", "hist").dropDuplicates(["uid"]))


def _set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([s.size for s in sets], np.int64)
    h1 = np.zeros(size.size, np.uint64)
    full = np.flatnonzero(size)
    if full.size:
        every = np.concatenate([sets[i] for i in full])
        h1[full] = np.add.reduceat(mix(every), np.concatenate([[0], np.cumsum(size[full])[:-1]]))
    return size, h1.view(np.int64)


def op10_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of two-word shingles are 80 % alike."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 2, 80).drop("h", "label")


QUERIES = {"op10_forest": op10_forest}
