"""Language-model scores from a weighted backoff automaton over smoothed n-grams.

Every bigram and trigram seen at least twice is an arc, whatever the size of the corpus: arcs are a
partitioned table that grows with the input.  States are histories of at most two words.  A state
lacking an arc for the next word follows its failure arc, which multiplies by the backoff weight that
makes the state's probabilities sum to one, to the state of the shorter history; the state without
history gives every word, seen or not, its add-one probability.

Training counts the n-grams and finds the failure weights by grouped joins.  An arc is stored as the count of its
n-gram with the failure weight of the state it leads to; its probability is that count, discounted, over the
count of the history, which the walk has just passed.  Scoring cuts the texts into chunks.  Each chunk asks for
the arcs of its distinct n-grams in one equality join, and then walks its texts from left to right: the state is
carried from token to token, failure arcs are followed where an arc is lacking, log-probabilities add up.

N-grams travel as packed arrays, each to the part its 64-bit hash names; the number of parts grows with
the corpus.  Tasks sum equal n-grams first, and look up those of at least 1/2^20 of all tokens in a small
table, so none is hot in a part.  A bitmap of fixed size keeps n-grams without an arc from travelling;
the join decides.

Defined cases: a null text is empty and has the end token alone; a null id is taught, not held out;
repeated rows each count and are each scored; without training rows every token has
probability 1; an empty table gives no rows; a very long text is one chunk, walked block by block; nothing
depends on the order of rows, so ties need no rule; only doc_id and text are read, other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import byte_chunks, held_out, mix, pair_hash, table, word_hashes
from driftline.session import cut_lineage, drop_tables, small_batches

LEAST, DISCOUNT = 2, 0.75
#: N-grams (histories in a join) of at least one in so many tokens are looked up, not shuffled.
HOT_SHARE, HOT_JOIN = 2 ** 20, 2 ** 16
#: Tokens of a part, bits of the bitmap, n-grams of a packed row.
PART, MARK_BITS, PACK = 2 ** 19, 27, 512
#: log2 of the number of parts in which words are counted.
WORD_PARTS = 10
#: Bytes of text in a chunk and in a run of a chunk (one text at least), tokens that a walk turns into Python values at once.
CHUNK, RUN, BLOCK = 1 << 22, 1 << 19, 1 << 16
#: Rows of an Arrow batch while packed rows travel.
BATCH = 1 << 10
#: Texts are scored in so many slices, one after the other, which bounds what lies on disk.
SLICES = 3
#: Distinct keys a counting task holds before it emits them.
FLUSH = 1 << 20
END = mix(np.array([0xE2D], np.uint64))[0]
_PIECE = 1 << 16


@dataclass
class Model:
    """Sums over the training texts and the arcs of the automaton."""
    tokens: int
    kinds: int
    parts: int              # log2 of the number of parts
    arcs: DataFrame         # p, keys, n, fail: packed arcs by part (fail null: all 0), those of hot n-grams with p < 0


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of some texts with an end token after each, and the texts' offsets."""
    hashes, at = word_hashes(data, offs)
    ends = at[1:] + np.arange(offs.size - 1)
    out = np.empty(hashes.size + ends.size, np.uint64)
    word = np.ones(out.size, bool)
    word[ends] = False
    out[word], out[ends] = hashes, END
    return out, np.concatenate([[0], ends + 1])


def _runs(data: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tokens and offsets of the runs of a chunk of texts."""
    column = pa.Array.from_buffers(pa.large_binary(), offs.size - 1, [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(data.tobytes())])
    return [_tokens(*run) for _, _, *run in byte_chunks(column, RUN)]


def token_stream(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and offsets of runs of texts."""
    return (_tokens(data, offs) for _, _, data, offs in byte_chunks(column, RUN))


def _find(table_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, -1 where absent."""
    if table_.size == 0:
        return np.full(keys.shape, -1, np.int64)
    at = np.searchsorted(table_, keys)
    at[at == table_.size] = 0
    return np.where(table_[at] == keys, at, -1)


def _before(tokens: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Words before the tokens; a text begins after an end token."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[offs[:-1]] = END
    return before


def _thirds(tokens: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Places that end a trigram."""
    inner = np.ones(tokens.size, bool)
    inner[offs[:-1]] = False
    return np.flatnonzero(inner)


def _grams(tokens: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bigram hashes, places that end a trigram, and trigram hashes."""
    two, third = pair_hash(_before(tokens, offs), tokens), _thirds(tokens, offs)
    return two, third, pair_hash(two[third - 1], two[third])


def _flagged(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the leading bits of each key are marked in a packed bitmap."""
    place = (keys >> np.uint64(64 - MARK_BITS)).astype(np.int64)
    return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)


def _summed(k: np.ndarray, n: np.ndarray | None, *of: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, their counts (sums of ``n``), and what ``of`` has for each."""
    order = np.argsort(k) if of or n is not None else None
    k = np.sort(k) if order is None else k[order]
    starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    total = np.diff(np.append(starts, k.size)) if n is None else np.add.reduceat(n[order], starts)
    if of:
        order = order[starts]
    return k[starts], total, *(x[order] for x in of)


def _distinct(*keys: np.ndarray) -> np.ndarray:
    """Sorted distinct values; a sort is many times faster here than the hashing of ``np.unique``."""
    k = np.sort(np.concatenate(keys))
    return k[np.append(True, k[1:] != k[:-1])] if k.size else k


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value for each stretch of ``values`` between ``bounds``."""
    values = np.ascontiguousarray(values)
    offsets = pa.py_buffer((bounds * values.itemsize).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), bounds.size - 1, [None, offsets, pa.py_buffer(values.tobytes())])


def _stretches(p: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal values of a sorted array, none longer than a packed row."""
    starts = np.flatnonzero(np.diff(p, prepend=-1)) if p.size else np.zeros(0, np.int64)
    place = np.arange(p.size) - np.repeat(starts, np.diff(np.append(starts, p.size)))
    return np.append(np.flatnonzero(place % PACK == 0), p.size)


def _joined(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _arcs(keys: pa.Array, n: pa.Array, fail: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed arcs as arrays; rows without failure weights hold trigrams, which lead to no longer state."""
    weights = b"".join(bytes(size) if f is None else f for f, size in zip(fail.to_pylist(), pc.binary_length(keys).to_pylist()))
    return _joined(keys, np.uint64), _joined(n, np.int64), np.frombuffer(weights, float)


def _parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batches cut where their first column, by which rows are sorted, changes."""
    for b in batches:
        p = np.asarray(b.column(0))
        starts = np.flatnonzero(np.diff(p, prepend=p[:1] - 1))
        for lo, hi in zip(starts, np.append(starts[1:], p.size)):
            yield int(p[lo]), b.slice(lo, hi - lo)


def _key(columns: list[np.ndarray]) -> np.ndarray:
    return columns[0] if len(columns) == 1 else pair_hash(*columns)


def _counted(texts: DataFrame, width: int, columns, parts: int, rows, schema: str) -> DataFrame:
    """Table of the n-grams of all ``texts``, each counted in the part that its key names.

    ``columns(tokens, offs)`` has ``width`` columns that name the n-grams of a run of texts (a word, or a pair);
    ``rows(key, n, *columns)`` gives the table's batches for the distinct n-grams of a part, sorted by key.
    """
    names = [*"ab"[:width], "n"]

    def emit(held):
        whole = [np.concatenate(x) for x in zip(*held)]
        held.clear()
        k, n, *whole = _summed(_key(whole), None, *(whole if width > 1 else ()))
        whole = whole or [k]
        p = (k >> np.uint64(64 - parts)).astype(np.int32)
        bounds = _stretches(p)
        return pa.RecordBatch.from_arrays([pa.array(p[bounds[:-1]]), *(_packed(x, bounds) for x in (*whole, n))], ["p", *names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for tokens, offs in token_stream(batch.column(0)):
                held.append(columns(tokens, offs))
                size += held[-1][0].size
                if size > 2 * FLUSH:
                    yield emit(held)
                    size = 0
        if size:
            yield emit(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            *whole, n = (np.concatenate(x) for x in zip(*held))
            held.clear()
            yield from rows(*_summed(_key(whole), n, *whole))
        held, part = [], None
        for p, b in _parts_of(batches):
            if p != part and held:
                yield from out()
            part = p
            held.append([*(_joined(b.column(1 + i), np.uint64) for i in range(width)), _joined(b.column(1 + width), np.int64)])
        if held:
            yield from out()

    with small_batches(texts.sparkSession, BATCH):                     # packed rows have up to some KB, and so have texts
        return cut_lineage(texts.select("text").mapInArrow(read, ", ".join(["p int", *(f"{x} binary" for x in names)]))
                           .repartition("p").sortWithinPartitions("p").mapInArrow(add, schema))


def _batches(names: list[str], *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, columns[0].size, 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(x[lo:lo + (1 << 16)].view(np.int64)) for x in columns], names)


def count_words(texts: DataFrame) -> DataFrame:
    """(w, n): count of each word hash over all rows of ``texts``, end tokens included."""
    return _counted(texts, 1, lambda tokens, offs: (tokens,), WORD_PARTS,
                    lambda k, n, *_: _batches(["w", "n"], k, n), "w long, n long")


def count_bigrams(texts: DataFrame, parts: int) -> DataFrame:
    """(k, a, b, n) of the bigrams seen LEAST times, which have words a and b."""
    def rows(k, n, a, b):
        x = np.flatnonzero(n >= LEAST)
        return _batches(["k", "a", "b", "n"], k[x], a[x], b[x], n[x])
    return _counted(texts, 2, lambda tokens, offs: (_before(tokens, offs), tokens), parts, rows, "k long, a long, b long, n long")


def count_trigrams(texts: DataFrame, parts: int, tokens: int, marks: np.ndarray) -> DataFrame:
    """Trigrams seen LEAST times: as rows (a, b, n) with the hashes of their bigrams, and packed as arcs (p, keys, counts).

    ``marks`` has the bigrams seen LEAST times; no other is part of such a trigram.
    """
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    def columns(tokens, offs):
        two, third = pair_hash(_before(tokens, offs), tokens), _thirds(tokens, offs)
        good = _flagged(shared.value, two)
        third = third[good[third - 1] & good[third]]
        return two[third - 1], two[third]

    def rows(k, n, a, b):
        x = np.flatnonzero(n >= LEAST)
        k, n, a, b = k[x], n[x], a[x], b[x]
        for batch in _batches(["a", "b", "n"], a, b, n):
            gone = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int32()), gone, gone, *batch.columns], names)
        often = n * HOT_SHARE >= tokens
        for x, p in ((~often, k >> np.uint64(64 - parts)), (often, np.full(k.size, -2))):
            bounds = _stretches(p[x].astype(np.int32))
            if bounds.size > 1:
                none = [pa.nulls(bounds.size - 1, pa.int64())] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p[x][bounds[:-1]].astype(np.int32)), _packed(k[x], bounds), _packed(n[x], bounds), *none], names)

    names = ["p", "keys", "counts", "a", "b", "n"]
    return _counted(texts, 2, columns, parts, rows, "p int, keys binary, counts binary, a long, b long, n long")


def marked(keys: DataFrame, packed: bool) -> np.ndarray:
    """Packed bitmap of the leading bits of ``keys`` (one column), which lie together in few tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << MARK_BITS - 3, np.uint8)
        for b in batches:
            k = _joined(b.column(0), np.uint64) if packed else np.asarray(b.column(0)).view(np.uint64)
            place = _distinct(k >> np.uint64(64 - MARK_BITS)).astype(np.int64)
            np.bitwise_or.at(seen, place >> 3, (128 >> (place & 7)).astype(np.uint8))
        pieces = seen.reshape(-1, _PIECE >> 3)
        for i in np.flatnonzero(pieces.any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pieces[i].tobytes()])], ["i", "bits"])

    out = np.zeros((1 << MARK_BITS - 3) // (_PIECE >> 3) * (_PIECE >> 3), np.uint8).reshape(-1, _PIECE >> 3)
    for i, bits in keys.mapInArrow(run, "i int, bits binary").toLocalIterator():
        out[i] |= np.frombuffer(bits, np.uint8)
    return out.ravel()


def _lookup(big: DataFrame, key: str, small: DataFrame, hot: Column) -> DataFrame:
    """``big`` with the columns of ``small`` for its ``key``; keys that are ``hot`` in the few rows of a small table."""
    often = F.broadcast(small.where(hot))                              # at most HOT_JOIN rows
    return big.join(often, key).unionByName(
        big.join(F.broadcast(small.where(hot).select(key)), key, "left_anti").join(small.where(~hot), key))


def _failure(kept: str, n: str, free: str) -> Column:
    """Failure weight of a state seen ``n`` times, given the sums over its arcs; 0 where it has none."""
    left = F.greatest(1 - F.col(kept) / F.col(n), F.lit(1e-12))
    return F.coalesce(F.log10(left / F.greatest(1 - F.col(free), F.lit(1e-12))), F.lit(0.0)).alias("fail")


def train(texts: DataFrame) -> Model:
    """Model of all rows of ``texts``.  Tables go as soon as their successors are written."""
    counts = count_words(texts)
    total = counts.agg(F.sum("n"), F.count("*")).first()
    n, kinds = int(total[0] or 0), int(total[1])
    parts = max(4, (n // PART).bit_length())
    bigrams = count_bigrams(texts, parts)
    trigrams = count_trigrams(texts, parts, n, marked(bigrams.select("k"), False))
    hot = F.col("m") * HOT_JOIN >= n
    kept = F.col("n") - DISCOUNT

    often = counts.where(F.col("n") >= LEAST)                          # an n-gram seen LEAST times has no other words
    floors = often.select(F.col("w").alias("b"), F.col("n").alias("m"), ((F.col("n") + 1) / F.lit(float(n + kinds + 1))).alias("floor"))
    sums = _lookup(bigrams.select("a", "b", "n"), "b", floors, hot).groupBy("a").agg(F.sum(kept).alias("s"), F.sum("floor").alias("f"))
    words = cut_lineage(often.join(sums, often["w"] == sums["a"], "left").select("w", "n", _failure("s", "n", "f"))
                        .union(counts.where(F.col("n") < LEAST).select("w", "n", F.lit(0.0))))
    two = cut_lineage(_lookup(bigrams.select("k", "a", "n"), "a", often.select(F.col("w").alias("a"), F.col("n").alias("m")), hot)
                      .select("k", "n", (kept / F.col("m")).alias("p2")))
    drop_tables(bigrams, counts)

    # the count of the history, by which the sum of discounted counts is divided, is there once the sums meet the bigrams
    three = _lookup(trigrams.where("keys is null").select("a", "b", "n"), "b", two.select(F.col("k").alias("b"), F.col("n").alias("m"), "p2"), hot)
    sums = cut_lineage(three.groupBy(F.col("a").alias("k")).agg(F.sum(kept).alias("s"), F.sum("p2").alias("f")))
    arcs = (words.withColumnRenamed("w", "k")
            .union(two.join(sums, "k", "left").select("k", "n", _failure("s", "n", "f"))))
    arcs = arcs.select(F.when(F.col("n") * HOT_SHARE >= n, -2).otherwise(F.shiftrightunsigned("k", 64 - parts)).cast("int").alias("p"),
                       "k", "n", "fail")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, k, n, fail = (x.to_numpy() for x in b.columns)
            bounds = _stretches(p)
            yield pa.RecordBatch.from_arrays([pa.array(p[bounds[:-1]]), *(_packed(x, bounds) for x in (k, n, fail))],
                                             ["p", "keys", "n", "fail"])

    # hot n-grams are dealt by their key: they are one part of the table, not one task
    arcs = cut_lineage(arcs.repartition("p", F.when(F.col("p") < 0, F.col("k") % 64)).sortWithinPartitions("p")
                       .mapInArrow(pack, "p int, keys binary, n binary, fail binary")
                       .union(trigrams.where("keys is not null").select("p", "keys", "counts", F.lit(None).cast("binary"))))
    drop_tables(trigrams, sums, two, words)
    return Model(n, kinds, parts, arcs)


def _hot_arcs(arcs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = arcs.where("p < 0").select("keys", "n", "fail").toArrow().combine_chunks()        # at most 3 x 2^20 n-grams
    keys, n, fail = _arcs(*(rows[c] for c in ("keys", "n", "fail")))
    order = np.argsort(keys)
    return keys[order], n[order], fail[order]


def walk(start: float, floor: np.ndarray, two: np.ndarray, three: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    """Log-probability of one text, token by token from the state of the end token.

    For each token: what it has without history, the arcs from the states of one and of two words (0 where there is
    none), and the failure weights of the states that it and its bigram name.
    """
    total, short, long = 0.0, start, None                              # failure weights of the state and of its suffix
    for lo in range(0, floor.size, BLOCK):
        for word, arc2, arc3, next_short, next_long in zip(*(x[lo:lo + BLOCK].tolist() for x in (floor, two, three, low, high))):
            if long is not None and arc3:
                total += arc3
            else:
                if long is not None:
                    total += long                                      # to the state of one word
                total += arc2 if arc2 else short + word                # or on to the state without history
            short, long = next_short, next_long if arc2 else None
    return total


def score(rows: DataFrame, m: Model) -> DataFrame:
    """``rows`` (doc_id, held_out, text) with n_tokens, n_known, train_tokens, base_score, score."""
    context = rows.sparkSession.sparkContext
    rest = m.arcs.where("p >= 0")
    with small_batches(rows.sparkSession, BATCH):
        hot, marks = context.broadcast(_hot_arcs(m.arcs)), context.broadcast(marked(rest.select("keys"), True))
    size, parts = float(np.log10(m.tokens + m.kinds + 1)), m.parts
    fields = ["ids", "nulls", "held", "data", "offs"]
    names = ["p", "chunk", "seq", "keys", *fields]

    def asked(u: np.ndarray, often: np.ndarray) -> np.ndarray:
        """Those of some distinct n-grams, none of them hot, that may have an arc in the partitioned table."""
        return u[(often < 0) & _flagged(marks.value, u)]

    def wanted(tokens: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Distinct n-grams of a run of texts to ask for, in ascending order."""
        two, _, three = _grams(tokens, offs)
        u = _distinct(tokens, two, three)
        return asked(u, _find(hot.value[0], u))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of texts (p -1), and the n-grams whose arcs each asks for, in ascending order, by part."""
        from pyspark import TaskContext
        chunk = TaskContext.get().partitionId() << 40
        for b in batches:
            for lo, hi, data, offs in byte_chunks(b.column(2), CHUNK):
                ids, held = b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo)
                whole = [ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8),
                         held.to_numpy(zero_copy_only=False).astype(np.uint8), data, offs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1], pa.int32()), pa.array([chunk]), pa.array([-1], pa.int32()), pa.array([b""]),
                     *(pa.array([x.tobytes()]) for x in whole)], names)
                keys = _distinct(*(wanted(*run) for run in _runs(data, offs)))
                bounds = _stretches((keys >> np.uint64(64 - parts)).astype(np.int32))
                k = bounds.size - 1
                if keys.size:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((keys[bounds[:-1]] >> np.uint64(64 - parts)).astype(np.int32)), pa.array(np.full(k, chunk)),
                         pa.array(np.arange(k, dtype=np.int32)), _packed(keys, bounds), *[pa.nulls(k, pa.binary())] * len(fields)], names)
                chunk += 1

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts (0: no arc) and failure weights of the n-grams asked for, in their order."""
        part, held, own = None, [], None
        for p, b in _parts_of(batches):
            if p != part:
                part, held, own = p, [], None
            split = int(np.searchsorted(np.asarray(b.column(1)), 0))       # arcs come first
            if split:
                t = b.slice(0, split)
                held.append(_arcs(*(t.column(c) for c in (3, 4, 5))))
            b = b.slice(split)
            if b.num_rows == 0:
                continue
            if own is None:
                own = [np.concatenate(x) for x in zip(*held)] or [np.zeros(0, t) for t in (np.uint64, np.int64, float)]
                order = np.argsort(own[0])
                own = [np.append(x[order], x.dtype.type(0)) for x in own]    # the last one stands for none
            sizes = pc.binary_length(b.column(3)).to_numpy() >> 3
            at = _find(own[0][:-1], _joined(b.column(3), np.uint64))
            bounds = np.append(0, np.cumsum(sizes))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), _packed(own[1][at].astype(np.int32), bounds), _packed(own[2][at], bounds)],
                                             ["chunk", "seq", "n", "fail"])

    def scored(whole: list[np.ndarray], answers: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        ids, nulls, held, data, offs = whole
        runs = [placed(*run) for run in _runs(data, offs)]
        keys = _distinct(*(asked(u, often) for *_, u, _, often in runs))
        n = np.append(np.frombuffer(b"".join(x for x, _ in answers), np.int32), np.int32(0))       # the last one stands for none
        fail = np.append(np.frombuffer(b"".join(x for _, x in answers), float), 0.0)
        out = [np.concatenate(x) for x in zip(*(walked(*run, keys, n, fail) for run in runs))]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=nulls.astype(bool)), pa.array(held.astype(bool)), *map(pa.array, out)],
            ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    def placed(tokens: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
        """Offsets of the texts of a run, where trigrams end, distinct n-grams, each token's place among them, and that among the hot."""
        two, third, three = _grams(tokens, offs)
        k = np.concatenate([tokens, two, three])
        order = np.argsort(k)
        k, at = k[order], np.empty(k.size, np.int32)
        new = np.append(True, k[1:] != k[:-1])
        at[order] = np.cumsum(new, dtype=np.int32) - 1
        u = k[new]
        return offs, third, u, at, _find(hot.value[0], u).astype(np.int32)

    def walked(offs: np.ndarray, third: np.ndarray, u: np.ndarray, at: np.ndarray, often: np.ndarray,
               keys: np.ndarray, n: np.ndarray, fail: np.ndarray) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and score of each text of a run, given the arcs of its chunk."""
        place = _find(keys, u)
        n, fail = n[place].astype(np.int64), fail[place]
        for x, own in zip((n, fail), hot.value[1:]):
            x[often >= 0] = own[often[often >= 0]]
        t, begin = int(offs[-1]), offs[:-1]
        one, two, low, high = n[at[:t]], n[at[t:2 * t]], fail[at[:t]], fail[at[t:2 * t]]
        three = np.zeros(t, np.int64)
        three[third] = n[at[2 * t:]]
        end = offs[1] - 1                                              # the end token's own place
        floor = np.log10(one + 1.0) - size

        def arc(count, history):
            out, x = np.zeros(t), np.flatnonzero(count)
            out[x] = np.log10(count[x] - DISCOUNT) - np.log10(history[x])
            return out
        before = np.append(one[end], one[:-1])
        before[begin] = one[end]
        arcs = floor, arc(two, before), arc(three, np.append(0, two[:-1])), low, high
        total = [walk(low[end], *(x[lo:hi] for x in arcs)) for lo, hi in zip(begin, offs[1:])]
        return np.diff(offs), np.add.reduceat((one > 0).astype(np.int64), begin), np.add.reduceat(floor, begin), np.array(total, float)

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Walks of the texts of each chunk, once the answers that follow them are there."""
        kinds = [np.int64, np.uint8, np.uint8, np.uint8, np.int64]
        now, whole, answers = None, None, []
        for chunk, b in _parts_of(batches):
            if chunk != now:
                if whole is not None:
                    yield scored(whole, answers)
                now, whole, answers = chunk, [np.frombuffer(b.column(4 + k)[0].as_py(), t) for k, t in enumerate(kinds)], []
                b = b.slice(1)                                         # the texts come first
            answers += zip(b.column(2).to_pylist(), b.column(3).to_pylist())
        if whole is not None:
            yield scored(whole, answers)

    binary, none = ", ".join(f"{f} binary" for f in fields), F.lit(None).cast("binary")

    def sliced(texts: DataFrame) -> DataFrame:
        chunks = cut_lineage(texts.mapInArrow(read, f"p int, chunk long, seq int, keys binary, {binary}"))
        sides = (rest.select("p", F.lit(-1).cast("long").alias("chunk"), F.lit(-1).alias("seq"), "keys", "n", "fail")
                 .union(chunks.where("p >= 0").select("p", "chunk", "seq", "keys", none, none)))
        answers = cut_lineage(sides.repartition("p").sortWithinPartitions("p", "chunk")
                              .mapInArrow(meet, "chunk long, seq int, n binary, fail binary"))
        whole = (chunks.where("p < 0").select("chunk", "seq", none.alias("n"), none.alias("fail"), *fields)
                 .union(answers.select("*", *[none] * len(fields))))
        out = cut_lineage(whole.repartition("chunk").sortWithinPartitions("chunk", "seq").mapInArrow(
            traverse, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"))
        drop_tables(chunks, answers)
        return out

    texts = rows.select(F.col("doc_id").cast("long"), "held_out", "text")
    with small_batches(rows.sparkSession, BATCH):                      # a packed row has up to some KB
        out = reduce(DataFrame.union, [sliced(texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SLICES)) == i)) for i in range(SLICES)])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(m.tokens).cast("long").alias("train_tokens"),
                      "base_score", "score")


def op2_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and add-one scores of every document, learned from those not held out."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    model = train(rows.where(~F.col("held_out")))
    out = score(rows, model)
    drop_tables(model.arcs)
    return out


QUERIES = {"op2_ngram": op2_ngram}
