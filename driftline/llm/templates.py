"""Benchmark decontamination by templates, which also finds questions with other parameters.

Words become template tokens: numbers, names (capitalised inside a sentence) and units (after a
number) turn into typed placeholders, others are lower-cased without marks.  A run of names is one
placeholder, and so is a number with its unit, joined or apart.  Windows of eight
tokens, three of them words at least, are hash-joined between texts and benchmark items.  Windows that
match at one offset, or in one narrow band of offsets (so nearly in order), count together: a text leaks an item if they are a
large enough part of the item's windows and the slots agree, that is, each value that the item repeats has one
counterpart in the text.  Windows of eight words as they stand are joined and counted in the same way, so that
copies of items that are mostly slots are found too.

Only windows whose hash is marked in a bitmap of fixed size, filled from the benchmark, leave a
reading task; the join then decides.  The benchmark may have any size.

Defined cases: null and empty texts or items match nothing; an item of fewer than eight tokens is
one window over all of it and matches when the text has it in one window of that length; a sentence
of four or more words that are all capitalised has no names; null
item ids are ignored, repeated ones are one item of the longest of their texts' windows; rows that
repeat id and text are one; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import byte_chunks, counter, mix, table
from driftline.session import cut_lineage

#: Tokens of a window, words among them, share of an item's windows, share of repeated values that agree.
WINDOW, LEAST_WORDS, COVER, AGREE = 8, 3, 0.3, 0.75
#: Width of a band of offsets that count together; any two that are half of it apart or less share one.
DRIFT = 32
BITS = 22
CACHE = 300_000

# --- fixed values: units and number words ---------------------------------------------------
UNITS = frozenset("""% kg g mg lb lbs oz t km m cm mm mi mile miles ft foot feet inch inches yd yard yards
    l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours
    day days week weeks month months year years mph km/h m/s hz w kw v usd eur dollar dollars cent cents
    euro euros pound pounds degree degrees °c °f gb mb kb""".split())
NUMBER_WORDS = frozenset("""zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen
    fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety
    hundred thousand million billion half third quarter dozen""".split())
# --------------------------------------------------------------------------------------------

_MARKS = re.compile(r"^[^\w%°$€£+-]+|[^\w%°$€£]+$")
_NUMBER = re.compile(r"[+\-$€£]*\d[\d.,:/]*")
_POWERS = counter(64, 9)
NUM, NAME, UNIT, LITERAL = (mix(np.array([k], np.uint64))[0] for k in (101, 102, 103, 104))
ENDS, CAPITAL, NUMERIC, UNITWORD, NUMUNIT, LETTERS = 1, 2, 4, 8, 16, 32
TITLE_WORDS = 4


def _run(words: np.ndarray) -> np.uint64:
    """Hash of several words as one value."""
    with np.errstate(over="ignore"):
        return (words * _POWERS[np.arange(words.size) % _POWERS.size]).sum(dtype=np.uint64)


class Tokens(dict):
    """Raw token -> place in the arrays of word hashes and flags; filled on first sight."""

    def __init__(self):
        super().__init__()
        self.hashes, self.flags = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint8)

    def __missing__(self, raw: bytes) -> int:
        token = raw.decode("utf-8", "replace")
        if token.isalpha() and token.islower():
            word, flag = token, NUMERIC if token in NUMBER_WORDS else 0
        else:
            word = _MARKS.sub("", token)
            flag = ENDS if token.rstrip("\"'”»)]")[-1:] in (".", "!", "?", ":") else 0
            if word[:1].isupper():
                flag |= CAPITAL
            lead = _NUMBER.match(word)
            word = word.lower()
            if lead:
                rest = word[lead.end():]
                flag |= NUMERIC if not rest else NUMUNIT if rest in UNITS else 0
            elif word in NUMBER_WORDS:
                flag |= NUMERIC
        if word in UNITS:
            flag |= UNITWORD
        if word[:1].isalpha():
            flag |= LETTERS
        place = len(self)
        if place == self.flags.size:
            self.hashes, self.flags = np.resize(self.hashes, 2 * place), np.resize(self.flags, 2 * place)
        self.hashes[place] = xxhash.xxh3_64_intdigest(word)
        if flag & NUMUNIT:                                             # as the number and the unit apart
            self.hashes[place] = _run(np.array([xxhash.xxh3_64_intdigest(x) for x in (word[:lead.end()], rest)], np.uint64))
        self.flags[place] = flag
        self[raw] = place
        return place


def template(text: bytes, seen: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template token hashes, whether each is a slot, and the hashes of the words themselves."""
    raw = text.split()
    if len(seen) > CACHE:
        seen.clear()
    at = np.fromiter(map(seen.__getitem__, raw), np.int64, len(raw))
    if at.size == 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint64)
    words, flags = seen.hashes[at], seen.flags[at]
    inside = np.zeros(at.size, bool)
    inside[1:] = (flags[:-1] & ENDS) == 0
    number = (flags & NUMERIC) > 0
    both = (flags & NUMUNIT) > 0
    unit = np.zeros(at.size, bool)
    unit[1:] = number[:-1] & ((flags[1:] & UNITWORD) > 0)
    sentence = np.cumsum(~inside) - 1
    letters, capital = (flags & LETTERS) > 0, (flags & CAPITAL) > 0
    title = (np.bincount(sentence, letters & ~capital) == 0) & (np.bincount(sentence, letters) >= TITLE_WORDS)
    name = inside & capital & ~number & ~both & ~title[sentence]
    out = words.copy()
    out[name], out[number], out[unit] = NAME, NUM, UNIT
    out[both] = NUM ^ UNIT
    return out, name | number | unit | both, words


def window_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    n = tokens.size - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total += tokens[k:k + n] * _POWERS[k]
        return mix(total + np.uint64(size))


def collapsed(tokens: np.ndarray, slot: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A ``template`` with runs of names, and numbers with their units, as one token each."""
    more = np.zeros(tokens.size, bool)
    name, unit = slot & (tokens == NAME), slot & (tokens == UNIT)
    more[1:] = name[1:] & name[:-1] | unit[1:] & ~unit[:-1]
    if not more.any():
        return tokens, slot, words
    heads = np.flatnonzero(~more)
    out, values = tokens[heads], words[heads]
    ends = np.append(heads[1:], tokens.size)
    for k in np.flatnonzero(ends - heads > 1):
        values[k] = _run(words[heads[k]:ends[k]])
        if out[k] == NUM:
            out[k] = NUM ^ UNIT
    return out, slot[heads], values


def _windows(text: bytes, seen: Tokens, sizes: tuple[tuple[int, int], ...]) -> Iterator[tuple]:
    """(kind, size, hashes, slot flags, words, windows worth matching) of one text.

    ``sizes`` are pairs of a kind, 0 for templates and 1 for words as they stand, and a size.
    """
    tokens, slot, words = template(text, seen)
    whole = words, np.zeros(words.size, bool), words
    kinds = collapsed(tokens, slot, words), whole
    for kind, size in sizes:
        tokens, slot, words = kinds[kind]
        size = size or min(WINDOW, tokens.size)
        hashes = window_hashes(tokens, size) if size else tokens
        if hashes.size:
            if kind:
                hashes, good = mix(hashes + LITERAL), np.ones(hashes.size, bool)
            else:
                sums = np.concatenate([[0], np.cumsum(~slot)])
                good = sums[size:] - sums[:-size] >= min(LEAST_WORDS, size)
            yield kind, size, hashes, slot, words, good


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, kind, w, at, windows, size, offsets, vals) of every window of ``items`` (item_id, text)."""
    schema = "item_id long, kind int, w long, at int, windows int, size int, offsets array<int>, vals array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Tokens()
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for kind, size, hashes, slot, words, good in _windows(text.encode(), seen, ((0, 0), (1, 0))):
                    for i in np.flatnonzero(good):
                        offs = np.flatnonzero(slot[i:i + size])
                        rows.append((item, kind, int(hashes.view(np.int64)[i]), int(i), int(good.sum()), size,
                                     offs.tolist(), words.view(np.int64)[i + offs].tolist()))
            cols = zip(*rows) if rows else [[]] * 8
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)],
                                             [f.split()[0] for f in schema.split(", ")])

    return (items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
            .mapInArrow(run, schema).withColumn("windows", F.max("windows").over(_by_item())))


def _by_item():
    from pyspark.sql import Window
    return Window.partitionBy("item_id", "kind")


def text_windows(rows: DataFrame, bitmap: np.ndarray, sizes: tuple[tuple[int, int], ...]) -> DataFrame:
    """(doc_id, h, at, w, vals) of the windows of ``rows`` (doc_id, h, text) marked in ``bitmap``."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)          # 2^22 bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, marks = Tokens(), np.unpackbits(shared.value).astype(bool)
        for b in batches:
            row, at, w, vals = [], [], [], []
            for lo, hi, data, offs in byte_chunks(b.column(2)):
                whole = data.tobytes()
                for i in range(hi - lo):
                    for _, size, hashes, slot, words, good in _windows(whole[offs[i]:offs[i + 1]], seen, sizes):
                        hit = np.flatnonzero(marks[hashes >> np.uint64(64 - BITS)] & good)
                        for k in hit:
                            row.append(lo + i)
                            at.append(k)
                            w.append(hashes.view(np.int64)[k])
                            vals.append(words.view(np.int64)[k:k + size][slot[k:k + size]])
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(at, pa.int32()),
                                              pa.array(w, pa.int64()), pa.array(vals, pa.list_(pa.int64()))],
                                             ["doc_id", "h", "at", "w", "vals"])

    return rows.mapInArrow(run, "doc_id long, h long, at int, w long, vals array<long>")


def _alignments(shift: Column) -> Column:
    """What a match counts towards: its offset, and two bands that overlap by half."""
    bands = [F.struct(F.lit(k).alias("way"), F.floor((shift + k * DRIFT / 2 - DRIFT / 2) / DRIFT).cast("int").alias("place")) for k in (1, 2)]
    return F.array(F.struct(F.lit(0).alias("way"), shift.cast("int").alias("place")), *bands)


def leaks(documents: DataFrame, items: DataFrame, cover: float = COVER, agree: float = AGREE) -> DataFrame:
    """Leaked items by text: doc_id, h, item_id, windows, item_windows, cover, slots_agree, changed.

    ``h`` hashes the text; with doc_id it names the row.  ``changed`` tells that some slot has
    another value than in the item.
    """
    bench = cut_lineage(item_windows(items))
    places = bench.select(F.shiftrightunsigned("w", 64 - BITS).alias("p")).distinct().toArrow()["p"].to_numpy()
    bitmap = np.zeros(1 << BITS, bool)                                 # at most 2^22 rows came
    bitmap[places] = True
    sizes = tuple(sorted((r["kind"], r["size"]) for r in bench.select("kind", "size").distinct().collect()))     # 16 at most
    texts = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    found = text_windows(texts, np.packbits(bitmap), sizes).distinct()
    key = ["doc_id", "h", "item_id", "kind", "shift"]
    pairs = cut_lineage(found.join(bench.withColumnRenamed("at", "item_at").withColumnRenamed("vals", "item_vals"), "w")
                        .withColumn("shift", F.explode(_alignments(F.col("at") - F.col("item_at")))))
    aligned = (pairs.groupBy(*key).agg(F.countDistinct("item_at").alias("windows"), F.max("windows").alias("item_windows"))
               .where(F.col("windows") >= F.greatest(F.lit(1.0), cover * F.col("item_windows"))))
    slots = (pairs.select(*key, "item_at", F.explode(F.arrays_zip("offsets", "item_vals", "vals")).alias("s"))
             .select(*key, (F.col("item_at") + F.col("s.offsets")).alias("slot"), F.col("s.item_vals").alias("iv"), F.col("s.vals").alias("dv"))
             .groupBy(*key, "iv").agg(F.min("dv").alias("lo"), F.max("dv").alias("hi"), F.min("slot").alias("s0"), F.max("slot").alias("s1"))
             .groupBy(*key).agg(F.avg(F.when(F.col("s0") < F.col("s1"), (F.col("lo") == F.col("hi")).cast("double"))).alias("slots_agree"),
                                F.max((F.col("lo") != F.col("iv")) | (F.col("hi") != F.col("iv"))).alias("changed")))
    on = [aligned[c].eqNullSafe(slots[c]) for c in key]
    judged = aligned.join(slots, on, "left").select(
        *[aligned[c] for c in key], "windows", "item_windows", F.coalesce("slots_agree", F.lit(1.0)).alias("slots_agree"),
        F.coalesce("changed", F.lit(False)).alias("changed")).where(F.col("slots_agree") >= agree)
    best = F.max(F.struct("windows", "slots_agree", (~F.col("changed")).alias("same"), "item_windows")).alias("m")
    return judged.groupBy("doc_id", "h", "item_id").agg(best).select(
        "doc_id", "h", "item_id", F.col("m.windows").alias("windows"), F.col("m.item_windows").alias("item_windows"),
        (F.col("m.windows") / F.col("m.item_windows")).alias("cover"), F.col("m.slots_agree").alias("slots_agree"),
        (~F.col("m.same")).alias("changed"))


def without_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``documents`` that leak no item; columns as they are."""
    bad = cut_lineage(leaks(documents, items).select(F.col("doc_id").alias("_bad_id"), F.col("h").alias("_bad_h")).distinct())
    return documents.join(bad, documents["doc_id"].cast("long").eqNullSafe(bad["_bad_id"])
                          & (F.xxhash64(documents["text"]) == bad["_bad_h"]), "left_anti")


def op1_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items leaked by documents: doc_id, item_id and the evidence."""
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"),
                 table(spark, sf_dir, "benchmark").select("item_id", "text")).drop("h")


QUERIES = {"op1_templates": op1_templates}
