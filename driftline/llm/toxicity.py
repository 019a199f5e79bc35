"""Toxicity scores from misspelling-tolerant lexicon hits and their context windows.

The lexicon is learned from a bounded sample of labelled rows: words that mark toxic texts, and word
stems under which only such words occur.  It is a trie; its product with Levenshtein automata
(insertion, deletion, substitution and swap of neighbours, one error for terms of five letters on)
is determinised state by state as words need it.  A term whose near spellings turn up in
clean texts is matched exactly only.

Each hit is judged in a window of words: quotation marks around it and reporting words speak
for quotation, words of address for abuse.  A logistic model over the counts of hits of each sort,
with a prior that holds where the sample says nothing, gives the score.

Defined cases: null and empty texts have no hits; a null id is scored, never taught; repeated
rows are scored alike; without toxic labels the lexicon is empty and scores stay low.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import held_out, table, training_rows
from driftline.session import cut_lineage

#: Labelled rows per class for the fit; texts a term must mark; log odds it must have.
SAMPLE, LEAST_TEXTS, LEAST_ODDS = 5000, 4, 2.5
#: Letters from which on one error is allowed; terms under a stem; letters of a stem.
FUZZY_LETTERS, STEM_TERMS, STEM_LETTERS = 5, 6, 4
WINDOW, CACHE = 8, 400_000
#: Clean sampled texts in which a stem, or near spellings of a term, may occur.
CONFUSED = 2

# --- fixed values: context words -----------------------------------------------------------
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes word term slur "
                      "sagte schrieb nannte zitat wort dit écrit appelé citation mot dijo escribió llamó cita".split())
ADDRESS = frozenset("you your you're yourself u ur du dich dir euch ihr tu te toi vous vos usted ustedes ti".split())
OPENING, CLOSING = "\"“„«‹‘'", "\"”“»›’'"
# -------------------------------------------------------------------------------------------

_STRIP = re.compile(r"^[\W_]+|[\W_]+$")
#: Offset, hits as abuse, those misspelled, quoted, quoted misspelled, share of words, address.
PRIOR = np.array([-3.0, 3.0, -0.5, 0.4, 0.0, 0.5, 0.5])
N_FEATURES = PRIOR.size


def clean(token: str) -> str:
    """Lower-case word without marks at its ends."""
    return _STRIP.sub("", token)


class FuzzyLexicon:
    """Terms with a tolerance each, and stems; ``match`` finds the best-fitting one of a word.

    ``match`` gives 0 for no match, 1 for an exact term or stem, 2 for a misspelled term.
    """

    def __init__(self, terms: dict[str, int], stems: Iterable[str] = ()):
        self.terms, self.stems = dict(terms), tuple(stems)
        # a node: children, tolerance of the term ending here (-1: none), largest below, stem
        self.child: list[dict[str, int]] = [{}]
        self.ends, self.below, self.stem = [-1], [0], [False]
        for word, slack in [*self.terms.items(), *((s, None) for s in self.stems)]:
            node = 0
            for ch in word:
                if ch not in self.child[node]:
                    self.child[node][ch] = len(self.child)
                    self.child.append({})
                    self.ends.append(-1)
                    self.below.append(0)
                    self.stem.append(False)
                node = self.child[node][ch]
                self.below[node] = max(self.below[node], slack or 0)
            if slack is None:
                self.stem[node] = True
            else:
                self.ends[node] = max(self.ends[node], slack)
            self.below[0] = max(self.below[0], slack or 0)
        self.names: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.result: list[int] = []
        self.start = self._state({(0, 0, "")})

    def __reduce__(self):
        return FuzzyLexicon, (self.terms, self.stems)

    def _state(self, positions: set) -> int:
        """Number of the determinised state; a position is (node, errors, letter still owed)."""
        todo = list(positions)
        while todo:                                                  # letters left out of the word
            node, e, owed = todo.pop()
            if not owed:
                for nxt in self.child[node].values():
                    if e < self.below[nxt] and (nxt, e + 1, "") not in positions:
                        positions.add((nxt, e + 1, ""))
                        todo.append((nxt, e + 1, ""))
        key = frozenset(positions)
        if key not in self.names:
            self.names[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            fits = [e for node, e, owed in key if not owed and (e <= self.ends[node] or (e == 0 and self.stem[node]))]
            whole = any(self.stem[node] and e == 0 and not owed for node, e, owed in key)
            self.result.append(3 if whole else 0 if not fits else 1 if min(fits) == 0 else 2)
        return self.names[key]

    def _step(self, state: int, ch: str) -> int:
        out = set()
        for node, e, owed in self.sets[state]:
            if owed:
                if ch == owed:
                    out.add((node, e, ""))
                continue
            nxt = self.child[node].get(ch)
            if nxt is not None:
                out.add((nxt, e, ""))
            if e < self.below[node]:
                out.add((node, e + 1, ""))                           # one letter too many
            for other, to in self.child[node].items():
                if other != ch and e < self.below[to]:
                    out.add((to, e + 1, ""))                         # another letter
                    after = self.child[to].get(ch)
                    if after is not None and e < self.below[after]:
                        out.add((after, e + 1, other))               # two letters swapped
        to = self._state(out) if out else -1
        self.moves[state][ch] = to
        return to

    def match(self, word: str) -> int:
        state, moves = self.start, self.moves
        for ch in word:
            to = moves[state].get(ch)
            if to is None:
                to = self._step(state, ch)
            if to < 0:
                return 0
            if self.result[to] == 3:
                return 1                                             # a stem takes any ending
            state = to
        return min(self.result[state], 2)

    def nearest(self, word: str) -> list[str]:
        """Terms within their tolerance of ``word``, itself excluded."""
        state = self.start
        for ch in word:
            to = self.moves[state].get(ch)
            state = self._step(state, ch) if to is None else to
            if state < 0:
                return []
        ends = {node for node, e, owed in self.sets[state] if not owed and 0 < e <= self.ends[node]}
        return [t for t in self.terms if self._node(t) in ends] if ends else []

    def _node(self, word: str) -> int:
        node = 0
        for ch in word:
            node = self.child[node][ch]
        return node


class Reader:
    """Hits of a lexicon in texts; words seen before are remembered up to a bound."""

    def __init__(self, lexicon: FuzzyLexicon):
        self.lexicon, self.seen, self.hot = lexicon, {}, set()

    def hits(self, text: str) -> tuple[list[str], list[int]]:
        tokens = text.lower().split()
        kinds = set(tokens)
        fresh = kinds.difference(self.seen)
        if len(self.seen) + len(fresh) > CACHE:
            self.seen, self.hot, fresh = {}, set(), kinds
        for t in fresh:
            got = self.seen[t] = self.lexicon.match(clean(t))
            if got:
                self.hot.add(t)
        if self.hot.isdisjoint(kinds):
            return tokens, []
        hot = self.hot
        return tokens, [i for i, t in enumerate(tokens) if t in hot]

    def features(self, text: str) -> list[float]:
        tokens, at = self.hits(text)
        if not at:
            return [1.0, 0, 0, 0, 0, 0, 0]
        abuse, quoted, address = [0, 0], [0, 0], 0
        for i in at:
            near = self.seen[tokens[i]] == 2
            window = tokens[max(0, i - WINDOW):i + WINDOW + 1]
            said = in_quotes(tokens, i) or not REPORTING.isdisjoint(map(clean, window))
            (quoted if said else abuse)[near] += 1
            address += not ADDRESS.isdisjoint(map(clean, window))
        return [1.0, math.log1p(sum(abuse)), math.log1p(abuse[1]), math.log1p(quoted[0]), math.log1p(quoted[1]),
                math.log1p(100 * sum(abuse) / len(tokens)), float(address > 0)]


def in_quotes(tokens: list[str], i: int) -> bool:
    """Whether a quotation opens before word ``i`` (or on it) and closes after it within the window."""
    def opens(t):
        return t[:1] in OPENING and bool(t)

    def closes(t):
        return t.rstrip(".,;:!?")[-1:] in CLOSING and bool(t.rstrip(".,;:!?"))
    left = next((k for k in range(i, max(-1, i - WINDOW - 1), -1) if opens(tokens[k]) or (k < i and closes(tokens[k]))), None)
    if left is None or not opens(tokens[left]):
        return False
    return any(closes(tokens[k]) for k in range(i, min(len(tokens), i + WINDOW + 1)))


def learn_lexicon(sample: DataFrame) -> FuzzyLexicon:
    """Lexicon from the labelled ``sample`` (text, y); what it gathers is bounded by the sample."""
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(1):
        return FuzzyLexicon({})

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, before, y = [], [], []
            for text, mark in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens = [clean(t) for t in text.lower().split()]
                own = dict(zip(tokens, ["", *tokens]))
                w.extend(own)
                before.extend(zlib.crc32(t.encode()) for t in own.values())
                y.extend([mark] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(before, pa.int64()), pa.array(y, pa.int32())],
                                             ["w", "before", "y"])

    # A word counts once per word before it, so that copies of a text are not evidence anew.
    kinds = (sample.select("text", "y").mapInArrow(words, "w string, before long, y int")
             .groupBy("w", "before").agg(F.max("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
             .groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    kinds = cut_lineage(kinds.where((F.col("bad") >= LEAST_TEXTS) | (F.col("good") == 0)))
    odds = F.log((F.col("bad") + 0.5) / (n[1] + 1)) - F.log((F.col("good") + 0.5) / (n.get(0, 0) + 1))
    # Chance alone would bring fewer than one such word: the log likelihood ratio exceeds log(words).
    part = n[1] / (n[1] + n.get(0, 0))
    bad, good = F.col("bad").cast("double"), F.col("good").cast("double")
    ratio = (bad * F.log(bad / ((bad + good) * part))
             + F.when(good > 0, good * F.log(good / ((bad + good) * max(1 - part, 1e-9)))).otherwise(0.0))
    marks = kinds.where((F.col("bad") >= LEAST_TEXTS) & (odds >= LEAST_ODDS) & (F.length("w") >= 3)
                        & (ratio >= math.log(max(2, kinds.count()))))
    terms = sorted(r["w"] for r in marks.select("w").collect())
    lexicon = FuzzyLexicon({t: int(len(t) >= FUZZY_LETTERS) for t in terms})
    starts: dict[str, int] = {}
    for t in terms:
        for k in range(STEM_LETTERS, len(t)):
            starts[t[:k]] = starts.get(t[:k], 0) + 1
    stems = {s for s, k in starts.items() if k >= STEM_TERMS}
    lists = sample.sparkSession.sparkContext.broadcast((lexicon, frozenset(stems)))

    # Clean texts withdraw a term's tolerance and a stem.
    def confused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, stems = lists.value
        reader = Reader(lexicon)
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                own = {clean(t) for t in text.lower().split()}
                out.extend({"-" + w[:k] for w in own for k in range(STEM_LETTERS, len(w) + 1) if w[:k] in stems})
                tokens, at = reader.hits(text)
                near = {tokens[i] for i in at if reader.seen[tokens[i]] == 2}
                out.extend({t for w in near for t in lexicon.nearest(clean(w))})
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["name"])

    wrong = {r["name"] for r in sample.where("y = 0").select("text").mapInArrow(confused, "name string")
             .groupBy("name").count().where(F.col("count") > CONFUSED).collect()}
    sound = {s for s in stems if "-" + s not in wrong}
    return FuzzyLexicon({t: int(len(t) >= FUZZY_LETTERS and t not in wrong) for t in terms},
                        sorted(s for s in sound if not any(s[:k] in sound for k in range(STEM_LETTERS, len(s)))))


def fit(documents: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> tuple[FuzzyLexicon, np.ndarray]:
    """Lexicon and weights from at most ``bound`` labelled rows per class outside the held-out fold."""
    fold = held_out(F.col("doc_id"), 5, 0)
    sample = cut_lineage(training_rows(documents, labels, "toxic", fold, bound).select("doc_id", "text", "y"))
    lexicon = learn_lexicon(sample)
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for b in batches:
            x = [reader.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1), b.column(2)], ["x", "y", "doc_id"])

    rows = sample.select("text", "y", "doc_id").mapInArrow(measured, "x array<double>, y int, doc_id long").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("y", "ascending")])
    w = PRIOR.copy()
    if len(rows):
        x = np.asarray(rows["x"].combine_chunks().flatten()).reshape(-1, N_FEATURES)
        y = rows["y"].to_numpy().astype(float)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
            grad = x.T @ (p - y) + (w - PRIOR)
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(w.size), grad)
            w = w - step * min(1.0, 2 / (np.linalg.norm(step) + 1e-12))
            if np.abs(step).max() < 1e-8:
                break
    return lexicon, w


def score(documents: DataFrame, lexicon: FuzzyLexicon, weights: np.ndarray, column: str = "score") -> DataFrame:
    """``documents`` with a toxicity score from 0 to 1; a column of that name is replaced."""
    shared = documents.sparkSession.sparkContext.broadcast((lexicon, weights))   # bounded by the sample

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon, w = shared.value
        reader = Reader(lexicon)
        for texts in batches:
            x = np.array([reader.features(t) for t in texts]).reshape(-1, N_FEATURES)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w, -500, 500))))

    return documents.withColumn(column, scored(F.coalesce("text", F.lit(""))))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon, weights = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, lexicon, weights).select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
