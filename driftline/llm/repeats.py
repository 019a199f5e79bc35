"""Exact removal of long repeated byte strings by a sparse enhanced suffix array.

Let ``needs`` be the lengths asked for, W the least and R the greatest of them.  Every string of W bytes holds
an anchor: the 64-byte gram of least hash among its W - 63 grams, a choice that depends on the string
alone.  Equal strings hold equal anchors at equal places, so only suffixes that start at anchors
whose gram occurs twice are needed, and each gram is a group of its own.  Anchors with equal
surroundings (R - 64 bytes before, R from it on) are one class.

Where a gram has several classes, their suffixes are sorted, the common prefixes of neighbours give
the interval tree by a scan with a stack, and in each interval of v common bytes the left extensions
are compared among all its members: a member whose longest left agreement within the interval is u
repeats as far as u + v reaches the length asked for.  All occurrences of each maximal repeat are
found, not neighbours alone.  The repeats of a class all contain its anchor, so together they are one
run from the farthest start to the farthest end, and each occurrence meets one row.

A gram with more classes than one task should hold is handled exactly by halving: the windows
around an anchor form a block, a block whose joined bytes occur twice is repeated throughout, one
whose shared bytes occur once is not repeated at all, and others are cut in two; one member of each
repeated block stays on as witness for the others.

Defined cases: null is empty; texts under the length lose nothing; matches never cross rows, and rows
that repeat a text count as occurrences; rows with equal id and text are cut alike, and so are ties of
anchors; a null id is an id; very long texts are read whole; an empty table gives no rows; all columns
of the rows pass through inside a struct, so that names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import WORD, byte_chunks, counter, mix, table
from driftline.session import cut_lineage, drop_tables

LENGTH, GRAM = 400, 64
#: A passage is a repeated run of this many bytes that holds over this many words.
PASSAGE, PASSAGE_WORDS = 250, 50
#: Classes of one gram that a task may hold: under 2 R bytes each.
GROUP = 8192

_BYTE = counter(256, 21)
_BASE = counter(1, 22)[0]
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, 0 to n."""
    if "up" not in _powers or _powers["up"].size <= n:
        size = 1 << int(n + 1).bit_length()
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                run = np.full(size, base, np.uint64)
                run[0] = 1
                _powers[name] = np.cumprod(run)
    return _powers["up"], _powers["down"]


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, reach: int) -> tuple[np.ndarray, ...]:
    """Row, place, gram hash, surroundings hash and size of the surroundings of every anchor of a chunk."""
    n = data.size
    none = np.zeros(0, np.int64)
    empty = none, none, none.view(np.uint64), none.view(np.uint64), none
    if n < window:
        return empty
    up, down = _power(n)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
        last = n - GRAM + 1
        grams = mix((sums[GRAM:] - sums[:last]) * down[:last])
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(last, dtype=np.uint64)
    many, width = window - GRAM + 1, 1
    while 2 * width <= many:                                         # least of 1, 2, 4, ... grams
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:least.size - (many - width)], least[many - width:])
    # windows that fit in their row
    row = np.repeat(np.arange(offsets.size - 1), np.diff(offsets))
    start = np.arange(least.size)
    place = (least[row[start] == row[start + window - 1]] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if place.size == 0:
        return empty
    place = place[np.concatenate([[True], place[1:] != place[:-1]])]
    own = row[place]
    lo = np.maximum(offsets[own], place - (reach - GRAM))
    hi = np.minimum(offsets[own + 1], place + reach)
    with np.errstate(over="ignore"):
        whole = (sums[hi] - sums[lo]) * down[lo]
        around = mix(whole + mix(((place - lo) * 65536 + hi - place).astype(np.uint64)))
    return own, place - offsets[own], grams[place], around, hi - lo


def find_anchors(rows: DataFrame, window: int, reach: int) -> DataFrame:
    """(g, c, k1, k2, at, size): gram, surroundings, row key, place and size of the surroundings of every anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in byte_chunks(b.column(2)):
                own, at, gram, around, size = anchors(data, offs, window, reach)
                take = pa.array(lo + own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(around.view(np.int64)), b.column(0).take(take),
                     b.column(1).take(take), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32))],
                    ["g", "c", "k1", "k2", "at", "size"])
    return rows.select("k1", "k2", "text").mapInArrow(run, "g long, c long, k1 long, k2 long, at int, size int")


def surroundings(rows: DataFrame, wanted: DataFrame, reach: int) -> DataFrame:
    """(g, c, left, right) of the anchors ``wanted`` (g, c, k1, k2, at); left is read backwards."""
    asked = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("g", "c", "at")).alias("asked"))
    hit = rows.join(asked, ["k1", "k2"]).select("text", "asked")
    before = reach - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text = b.column(0)[i].as_py().encode()
                asked = b.column(1)[i].values
                at = asked.field("at").to_pylist()
                for lo in range(0, len(at), 4096):          # a long text's in parts
                    yield pa.RecordBatch.from_arrays(
                        [asked.field("g").slice(lo, 4096), asked.field("c").slice(lo, 4096),
                         pa.array([text[max(0, p - before):p][::-1] for p in at[lo:lo + 4096]], pa.binary()),
                         pa.array([text[p:p + reach] for p in at[lo:lo + 4096]], pa.binary())], ["g", "c", "left", "right"])

    return hit.mapInArrow(run, "g long, c long, left binary, right binary")


# --- the interval tree of one gram --------------------------------------------------------------

def _common(texts: list[bytes], width: int) -> np.ndarray:
    """Length of the common prefix of each text and the next."""
    m = len(texts)
    grid = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(m, width)
    size = np.array([len(t) for t in texts])
    differ = np.concatenate([grid[1:] != grid[:-1], np.ones((m - 1, 1), bool)], 1)
    return np.minimum(differ.argmax(1), np.minimum(size[1:], size[:-1]))


def intervals(prefix: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Intervals (v, first, last) of a suffix array by its common prefixes, found with a stack."""
    stack = [(0, 0)]
    for i, v in enumerate([*prefix.tolist(), -1], 1):
        first = i - 1
        while stack and stack[-1][0] > v:
            depth, first = stack.pop()
            if depth > 0:
                yield depth, first, i - 1
        if not stack or stack[-1][0] < v:
            stack.append((v, first))


def repeats_of(lefts: list[bytes], rights: list[bytes], needs: tuple[int, ...]) -> np.ndarray:
    """(need, member, side): how far repeats reach before and from the anchor, for texts sorted by ``rights``; 0: none."""
    m, reach = len(rights), max(needs)
    prefix = _common(rights, reach)
    order = sorted(range(m), key=lefts.__getitem__)
    agree = _common([lefts[i] for i in order], reach - GRAM)
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    most = int(agree.max(initial=0))
    best = np.full((len(needs), m), -1)
    out = np.zeros((len(needs), m, 2), np.int64)
    for v, first, last in intervals(prefix):
        if v < GRAM or most + v < min(needs):
            continue
        places = np.sort(rank[first:last + 1])
        between = np.minimum.reduceat(agree, places[:-1])
        # the last segment of reduceat runs to the end of the array
        between[-1] = agree[places[-2]:places[-1]].min()
        longest = np.maximum(np.concatenate([[-1], between]), np.concatenate([between, [-1]]))
        for k, need in enumerate(needs):
            # Inner intervals come first: an outer one adds something only to a longer left extension.
            wider = (longest >= max(0, need - v)) & (longest > best[k, places])
            hit = places[wider]
            best[k, hit] = longest[wider]
            out[k, hit, 0] = np.maximum(out[k, hit, 0], longest[wider])
            out[k, hit, 1] = np.maximum(out[k, hit, 1], v)
    back = np.empty_like(out)
    back[:, order] = out
    return back


def _run_names(needs: tuple[int, ...]) -> list[str]:
    return [f"{side}{k}" for k in range(len(needs)) for side in ("a", "z")]


def tree_repeats(around: DataFrame, needs: tuple[int, ...]) -> DataFrame:
    """(g, c, a0, z0, ...): per need the repeated bytes [at + a, at + z) of each class, null if none."""
    ordered = around.repartition("g").sortWithinPartitions("g", "right", "c")
    names = ["g", "c", *_run_names(needs)]
    schema = pa.schema([(n, pa.int64() if n in ("g", "c") else pa.int32()) for n in names])

    def solve(held):
        rows = [r for i, r in enumerate(held) if i == 0 or r[1] != held[i - 1][1] or r[3] != held[i - 1][3]]
        if len(rows) < 2:
            return
        found = repeats_of([r[2] for r in rows], [r[3] for r in rows], needs)
        for member in np.flatnonzero(found[:, :, 1].any(0)):
            runs = [(-int(u), int(v)) if v else (None, None) for u, v in found[:, member]]
            yield rows[member][0], rows[member][1], *[x for run in runs for x in run]

    def packed(rows):
        cols = list(zip(*rows)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            out = []
            for r in zip(*[c.to_pylist() for c in b.columns]):
                if held and held[-1][0] != r[0]:
                    out.extend(solve(held))
                    held = []
                    if len(out) > 20_000:
                        yield packed(out)
                        out = []
                held.append(r)
            yield packed(out)
        yield packed(list(solve(held)) if held else [])

    return ordered.mapInArrow(run, ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'int'}" for f in schema))


# --- grams of many classes ------------------------------------------------------------------------

def halving_repeats(around: DataFrame, needs: tuple[int, ...]) -> DataFrame:
    """(need, g, c, a, z): repeated bytes of each length of ``needs`` and more, for grams of any number of classes.

    ``around`` holds each class once.  A block [lo, hi] stands for the windows that begin lo to hi bytes
    before the anchor; all lengths share the rounds.
    """
    sized = around.select("g", "c", "left", "right", F.length("left").alias("nl"), F.length("right").alias("nr"))
    key = ["need", "g", "lo", "hi"]
    blocks = sized.select("g", "c", F.explode(F.array(*map(F.lit, needs))).alias("need")).select(
        "need", "g", "c", F.lit(0).alias("lo"), (F.col("need") - GRAM).alias("hi"))
    found = None
    while True:
        fit = (blocks.join(sized, ["g", "c"])
               .where((F.col("lo") <= F.col("nl")) & (F.col("need") - F.col("hi") <= F.col("nr"))))
        whole = (F.col("hi") <= F.col("nl")) & (F.col("need") - F.col("lo") <= F.col("nr"))
        keyed = cut_lineage(fit.select(
            *key, "c", F.when(whole, F.xxhash64("g", "lo", "hi", F.expr("substring(left, 1, hi)"),
                                                F.expr("substring(right, 1, need - lo)"))).alias("all"),
            F.xxhash64("g", "lo", "hi", F.expr("substring(left, 1, lo)"),
                       F.expr("substring(right, 1, need - hi)")).alias("core")))
        # Both kinds of key are counted in one job, and written before the joins, so that Spark may split
        # the rows of a frequent block.
        kinds = keyed.select(*key, "c", F.explode(F.array(
            F.struct(F.lit(0).alias("kind"), F.col("all").alias("h")),
            F.struct(F.lit(1).alias("kind"), F.col("core").alias("h")))).alias("x")).where("x.h is not null")
        often = cut_lineage(kinds.groupBy(*key, "x.kind", "x.h").agg(
            F.count("*").alias("n"), F.min("c").alias("witness")).where("n > 1").drop("n"))
        alls = often.where("kind = 0").select(*key, F.col("h").alias("all"), "witness")
        cores = often.where("kind = 1").select(*key, F.col("h").alias("core"))
        state = cut_lineage(keyed.join(cores, [*key, "core"]).join(alls, [*key, "all"], "left")
                            .select(*key, "c", "witness"))
        drop_tables(keyed, often)
        hit = state.where("witness is not null").select(
            "need", "g", "c", (-F.col("hi")).alias("a"), (F.col("need") - F.col("lo")).alias("z"))
        found = hit if found is None else found.union(hit)
        open_ = state.where("lo < hi and (witness is null or witness = c)")
        if open_.limit(1).count() == 0:
            return found
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        blocks = open_.select("need", "g", "c", F.explode(F.array(
            F.struct(F.col("lo").alias("lo"), mid.alias("hi")),
            F.struct((mid + 1).alias("lo"), F.col("hi").alias("hi")))).alias("b")).select("need", "g", "c", "b.lo", "b.hi")


# --- rows -----------------------------------------------------------------------------------------

def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k1"), F.xxhash64("text").alias("k2"),
                            F.coalesce("text", F.lit("")).alias("text"))


def repeated_spans(documents: DataFrame, needs: tuple[int, ...] = (LENGTH,), group: int = GROUP) -> DataFrame:
    """(k1, k2, spans0, ...): per need the byte ranges [a, z) of each row that repeat, unmerged; rows without are absent."""
    rows, window, reach = _keyed(documents), min(needs), max(needs)
    names = _run_names(needs)
    every = cut_lineage(find_anchors(rows, window, reach))
    # Written first, so that the join deals both sides anew and Spark may split a frequent gram.
    often = cut_lineage(every.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"))
    twice = cut_lineage(every.join(often, "g"))
    drop_tables(every, often)
    classes = cut_lineage(twice.groupBy("g", "c").agg(F.count("*").alias("n"), F.max("size").alias("size"),
                                                      F.min(F.struct("k1", "k2", "at")).alias("one")))
    full = classes.where("n > 1").select("g", "c", *[
        F.when(F.col("size") >= need, F.lit(end).cast("int")).alias(f"{side}{k}")
        for k, need in enumerate(needs) for side, end in (("a", GRAM - reach), ("z", reach))])
    kinds = cut_lineage(classes.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    around = cut_lineage(surroundings(rows, classes.join(kinds, "g").select("g", "c", "one.*"), reach).join(kinds, "g"))
    part = cut_lineage(full.union(tree_repeats(around.where(F.col("kinds") <= group).select("g", "c", "left", "right"), needs)))
    large = around.where(F.col("kinds") > group)
    if large.limit(1).count():
        found = halving_repeats(large.dropDuplicates(["g", "c"]), needs)
        part = part.union(found.select("g", "c", *[
            F.when(F.col("need") == needs[int(n[1:])], F.col(n[0])).alias(n) for n in names]))
    # Each class's repeats contain its anchor: one run, so the join makes a row per occurrence.
    spans = cut_lineage(part.groupBy("g", "c").agg(*[(F.min if n[0] == "a" else F.max)(n).alias(n) for n in names]))
    drop_tables(around, classes, kinds)
    out = cut_lineage(twice.join(spans, ["g", "c"]).select("k1", "k2", *[
        F.when(F.col(f"z{k}").isNotNull(), F.struct(
            F.greatest(F.col("at") + F.col(f"a{k}"), F.lit(0)).alias("a"),
            (F.col("at") + F.col(f"z{k}")).alias("z"))).alias(f"spans{k}") for k in range(len(needs))])
        .groupBy("k1", "k2").agg(*[F.collect_set(f"spans{k}").alias(f"spans{k}") for k in range(len(needs))]))
    drop_tables(twice, spans)
    return out


def _merged(spans, size: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted((s["a"], min(s["z"], size)) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


_WORDS = re.compile(WORD.encode())


def whole_words(raw: bytes, a: int, z: int) -> int:
    """Words of ``raw`` that lie in [a, z) as a whole."""
    found = [m.span() for m in _WORDS.finditer(raw, a, z)]
    cut = [bool(found) and found[0][0] == a > 0 and _WORDS.match(raw[a - 1:a]) is not None,
           bool(found) and found[-1][1] == z < len(raw) and _WORDS.match(raw[z:z + 1]) is not None]
    return max(0, len(found) - sum(cut))


def repeated_runs(raw: bytes, spans, words: int = 0) -> list[tuple[int, int]]:
    """Maximal repeated runs of a text, those with over ``words`` whole words if any are asked for."""
    runs = _merged(spans, len(raw)) if spans is not None else []
    return [r for r in runs if whole_words(raw, *r) > words] if words else runs


_CUT = T.StructType([T.StructField("kept", T.BinaryType()), T.StructField("n_removed", T.LongType()),
                     T.StructField("n_spans", T.LongType())])


def _cut(words: int):
    @F.pandas_udf(_CUT)
    def cut(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        kept, removed, runs = [], [], []
        for t, s in zip(text, spans):
            raw = t.encode()
            merged = repeated_runs(raw, s, words)
            ends = [0, *(x for span in merged for x in span), len(raw)]
            kept.append(b"".join(raw[ends[i]:ends[i + 1]] for i in range(0, len(ends), 2)))
            removed.append(len(raw) - len(kept[-1]))
            runs.append(len(merged))
        return pd.DataFrame({"kept": kept, "n_removed": removed, "n_spans": runs})
    return cut


@F.pandas_udf(T.LongType())
def _passages(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([len(repeated_runs(t.encode(), s, PASSAGE_WORDS)) for t, s in zip(text, spans)], dtype="int64")


def with_spans(documents: DataFrame, needs: tuple[int, ...], group: int = GROUP) -> DataFrame:
    """Each row of ``documents`` as struct ``row``, its ``text`` (null: empty) and the repeated ranges spans0, ..."""
    spans = repeated_spans(documents, needs, group)
    rows = documents.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k1"),
                            F.xxhash64("text").alias("k2"))
    return rows.join(spans, ["k1", "k2"], "left").select(
        "row", F.coalesce("row.text", F.lit("")).alias("text"), *[f"spans{k}" for k in range(len(needs))])


def remove_repeats(documents: DataFrame, length: int = LENGTH, words: int = 0, group: int = GROUP) -> DataFrame:
    """Each row of ``documents`` as struct ``row``, with ``cut``: its kept bytes, n_removed and n_spans.

    Removed are the maximal runs of bytes covered by strings of ``length`` bytes that occur elsewhere;
    with ``words``, those runs only that hold more whole words than that.
    """
    return with_spans(documents, (length,), group).select("row", _cut(words)("text", "spans0").alias("cut"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of each document without its strings of 400 bytes that occur elsewhere.

    ``n_passages`` counts its repeated runs of PASSAGE bytes and over PASSAGE_WORDS words, which the
    same pass finds and leaves in place.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_spans(docs, (LENGTH, PASSAGE)).select(
        "row.doc_id", F.octet_length("text").cast("long").alias("n_bytes"), _cut(0)("text", "spans0").alias("cut"),
        _passages("text", "spans1").alias("n_passages"))
    return found.select("doc_id", "n_bytes", "cut.n_removed", "cut.n_spans", F.sha2("cut.kept", 256).alias("kept_sha256"),
                        "n_passages")


QUERIES = {"op3_repeats": op3_repeats}
