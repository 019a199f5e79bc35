"""Model terms, and the design table that the iterative fits read.

A design is built in two passes over the cohort.  Rows with equal model columns are
merged first (their counts add up, so nothing is lost); the merged table is written
once, sorted and packed in blocks, and every later pass reads only that.  Scaling constants
and level lists come from the merged table.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.ranking import quantiles
from driftline.session import cut_lineage, short_methods

MAX_LEVELS = 2000


@dataclass(frozen=True)
class Numeric:
    """Numeric main effect; ``scale`` standardises it over the cohort."""
    col: str
    scale: bool = True

    @property
    def name(self) -> str:
        return f"scale({self.col})" if self.scale else self.col


@dataclass(frozen=True)
class Factor:
    """Categorical main effect with treatment contrasts against the baseline."""
    col: str
    baseline: str | None = None

    @property
    def name(self) -> str:
        return self.col


@dataclass(frozen=True)
class Interaction:
    """Product of two main effects, which must be in the model too."""
    a: Numeric | Factor
    b: Numeric | Factor

    @property
    def name(self) -> str:
        return f"{self.a.name}:{self.b.name}"


@dataclass(frozen=True)
class Smooth:
    """Penalised cubic spline of a column, one curve per level of ``by``."""
    col: str
    by: str | None = None
    knots: int = 10

    @property
    def name(self) -> str:
        return f"s({self.col}{', by=' + self.by if self.by else ''})"


Term = Numeric | Factor | Interaction | Smooth


@dataclass
class Curve:
    """One smooth curve: where its columns sit and how to evaluate it."""
    label: str
    low: float
    high: float
    knots: np.ndarray
    transform: np.ndarray          # knot columns -> columns with unit penalty
    linear: int                    # position of its straight-line column
    raw: slice                     # positions of its knot columns


@dataclass(frozen=True)
class Part:
    """How a dense column follows from a row: a product of functions of its numbers, within factor levels."""
    functions: tuple[tuple[int, float, float, float | None], ...] = ()   # number, shift, scale, knot
    marks: tuple[tuple[int, int], ...] = ()                              # factor, level


@dataclass
class Design:
    """Merged rows in packed blocks (see ``_packed``) and what the columns mean.

    ``absorbed`` names a random factor with too many levels for the driver.  A block then holds
    all rows of its levels; levels with very many rows (``hot``) are kept among ``levels`` instead.
    """
    rows: DataFrame
    names: list[str]               # dense columns, knot columns last
    term_columns: dict[str, list[int]]
    levels: dict[str, list[str]]
    n_obs: int
    log_constant: float
    curves: list[Curve] = field(default_factory=list)
    n_fixed: int = 0
    absorbed: str | None = None
    parts: list[Part] = field(default_factory=list)      # per dense column
    places: list[int] = field(default_factory=list)      # per random factor, its place in the blocks
    bounds: np.ndarray | None = None                     # largest size of each dense column

    @property
    def hot(self) -> bool:
        """Whether frequent levels of the absorbed factor stand among ``levels``, as its last entry."""
        return self.absorbed in self.levels

    @property
    def level_counts(self) -> list[int]:
        return [len(v) for v in self.levels.values()]

    def fixed_columns(self, terms: Sequence[str]) -> list[int]:
        return [0, *sorted(chain.from_iterable(self.term_columns[t] for t in terms))]


def _log_factorial(x: Column) -> Column:
    """log(x!) for x >= 0: Stirling's series at x + 8, walked back by the recurrence."""
    z = x + 8.0
    back = x + 1.0
    for j in range(2, 8):
        back = back * (x + float(j))
    series = (1.0 / 12 - (1.0 / 360 - (1.0 / 1260 - 1.0 / (1680 * z * z)) / (z * z)) / (z * z)) / z
    return ((z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series) - F.log(back)


def log_choose(n: Column, k: Column) -> Column:
    """Log binomial coefficient."""
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def _knot_basis(knots: np.ndarray) -> np.ndarray:
    """Map from |x - knot|^3 columns to columns with an identity penalty.

    Columns are made free of constant and straight line, then scaled by the inverse root
    of the integrated squared second derivative.
    """
    omega = np.abs(knots[:, None] - knots[None, :]) ** 3 / 12.0
    line = np.column_stack([np.ones_like(knots), knots])
    free = np.linalg.svd(line, full_matrices=True)[0][:, 2:]
    value, vector = np.linalg.eigh(free.T @ omega @ free)
    keep = value > 1e-10 * value.max()
    return free @ vector[:, keep] / np.sqrt(value[keep])


def build_design(df: DataFrame, fixed: Sequence[Term], random: Sequence[str] = (),
                 positive: str | None = "NwP", trials: str = "N",
                 response: Column | None = None, weight: Column | None = None,
                 max_levels: int = MAX_LEVELS) -> Design:
    """Design of a binomial model (``positive`` of ``trials``) or, with ``response``, a
    Gaussian one.  The cohort must be complete in all model columns.

    When the factors have more than ``max_levels`` levels together, the largest random
    factor is absorbed: its effects stay distributed (see ``absorbed``)."""
    cols = list(dict.fromkeys(chain(
        (c for t in fixed for c in ([t.a.col, t.b.col] if isinstance(t, Interaction)
                                    else [t.col, *([t.by] if isinstance(t, Smooth) and t.by
                                                   else [])])), random)))
    if response is None:
        df = df.filter(F.col(trials) > 0)
        a, n = F.col(positive).cast("double"), F.col(trials).cast("double")
        yy, constant = F.lit(0.0), log_choose(n, a)
    else:
        w = F.lit(1.0) if weight is None else weight.cast("double")
        y = response.cast("double")
        df = df.withColumns({"_y": y, "_wt": w}).dropna(subset=["_y", "_wt"]).filter("_wt > 0")
        a, n, yy = F.col("_wt") * F.col("_y"), F.col("_wt"), F.col("_wt") * F.col("_y") ** 2
        constant = F.log("_wt")
    with short_methods(df.sparkSession):
        cells = cut_lineage(df.groupBy(*cols).agg(
            F.sum(a).alias("a"), F.sum(n).alias("n"), F.sum(yy).alias("yy"),
            F.sum(constant).alias("constant"),
            F.count(F.lit(1)).alias("rows")))

    numeric = {t.col for t in _mains(fixed) if isinstance(t, Numeric)} | {
        t.col for t in fixed if isinstance(t, Smooth)}
    factors = list(dict.fromkeys(chain(
        (t.col for t in _mains(fixed) if isinstance(t, Factor)),
        (t.by for t in fixed if isinstance(t, Smooth) and t.by), random)))
    stats = []
    for c in numeric:
        x = F.col(c).cast("double")
        stats += [F.sum(x * F.col("rows")).alias(f"s1_{c}"), F.min(x).alias(f"lo_{c}"),
                  F.max(x).alias(f"hi_{c}"),
                  F.sum(x * x * F.col("rows")).alias(f"s2_{c}")]
    moments = cells.agg(F.sum("rows").alias("rows"), F.sum("constant").alias("constant"),
                        *stats).first()
    n_obs = moments["rows"]
    if not n_obs:
        raise ValueError("the cohort has no complete rows")
    counted, found = None, {}
    for c in factors:
        one = cells.groupBy(F.col(c).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("m"))
        one = one.select(F.lit(c).alias("factor"), "level", "m").filter("level IS NOT NULL")
        counted = one if counted is None else counted.unionAll(one)
    if factors:
        counted = cut_lineage(counted)
        found = {r["factor"]: (r["count"], r["m"]) for r in counted.groupBy("factor").agg(
            F.count(F.lit(1)).alias("count"), F.sum("m").alias("m")).collect()}
    absorbed, total = None, sum(found[c][0] for c in factors)
    if total > max_levels and random:
        absorbed = max(random, key=lambda c: found[c][0])
        total -= found[absorbed][0]
        random = [c for c in random if c != absorbed]
        factors = [c for c in factors if c != absorbed]
    if total > max_levels:
        raise ValueError(f"more than {max_levels} factor levels besides the absorbed factor")
    levels = {c: [] for c in factors}
    for r in (counted.filter(F.col("factor").isin(factors)).collect() if factors else ()):
        levels[r["factor"]].append(r["level"])
    levels = {c: sorted(v) for c, v in levels.items()}
    numbers, kept, frequent = sorted(numeric), list(factors), []
    if absorbed:
        most = max(HOT_ROWS, found[absorbed][1] // HOT_LEVELS)
        frequent = sorted(r["level"] for r in counted.filter((F.col("factor") == absorbed) & (F.col("m") > most)).collect())
        if frequent:
            levels[absorbed], random, kept = frequent, [*random, absorbed], [*kept, absorbed]
    # the fewer levels, the earlier a factor stands in the order of the rows
    kept.sort(key=lambda c: (len(levels[c]), c))

    def number(t: Numeric) -> tuple[int, float, float, None]:
        if not t.scale:
            return numbers.index(t.col), 0.0, 1.0, None
        mean = moments[f"s1_{t.col}"] / n_obs
        var = (moments[f"s2_{t.col}"] - n_obs * mean ** 2) / max(n_obs - 1, 1)
        return numbers.index(t.col), float(mean), math.sqrt(max(var, 0.0)) or 1.0, None

    def columns(t: Numeric | Factor) -> list[tuple[str, Part]]:
        if isinstance(t, Numeric):
            return [(t.name, Part((number(t),)))]
        base = t.baseline or levels[t.col][0]
        return [(f"{t.col}{v}", Part(marks=((kept.index(t.col), i),)))
                for i, v in enumerate(levels[t.col]) if v != base]

    dense: list[tuple[str, Part]] = [("(Intercept)", Part())]
    owner: dict[str, list[int]] = {}
    waiting: list[tuple[str, np.ndarray, float, float, tuple, int]] = []
    for t in fixed:
        at = len(dense)
        if isinstance(t, Interaction):
            dense += [(f"{na}:{nb}", Part(tuple(sorted(ca.functions + cb.functions, key=str)),
                                          tuple(sorted({*ca.marks, *cb.marks}))))
                      for na, ca in columns(t.a) for nb, cb in columns(t.b)]
        elif isinstance(t, Smooth):
            low, high = float(moments[f"lo_{t.col}"]), float(moments[f"hi_{t.col}"])
            distinct = cells.select(t.col).distinct()
            probs = [i / (t.knots - 1) for i in range(t.knots)]
            knots = np.unique((np.array(quantiles(distinct, [], t.col, probs).first()[0]) - low)
                              / ((high - low) or 1.0))
            x = (numbers.index(t.col), low, (high - low) or 1.0)
            for i, v in enumerate(levels[t.by]) if t.by else [(0, None)]:
                label = f"s({t.col})" + (f":{t.by}{v}" if v is not None else "")
                inside = ((kept.index(t.by), i),) if v is not None else ()
                waiting.append((label, knots, low, high, (x, inside), len(dense)))
                dense.append((f"{label}.line", Part(((*x, None),), inside)))
        else:
            dense += columns(t)
        owner[t.name] = list(range(at, len(dense)))
    n_fixed, curves = len(dense), []
    for label, knots, low, high, (x, inside), line in waiting:
        raw = slice(len(dense), len(dense) + len(knots))
        dense += [(f"{label}.{j}", Part(((*x, float(k)),), inside)) for j, k in enumerate(knots)]
        curves.append(Curve(label, low, high, knots, _knot_basis(knots), line, raw))

    sizes = [max(abs(moments[f"lo_{c}"]), abs(moments[f"hi_{c}"])) for c in numbers]
    bounds = np.array([math.prod(((sizes[c] + abs(shift)) / scale if knot is None else 1.0)
                                 for c, shift, scale, knot in part.functions) for _, part in dense])
    wide = cells.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(numbers)],
                        *[F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(kept)],
                        "a", "n", "yy", F.col("rows").cast("double").alias("rows"),
                        *([F.col(absorbed).cast("string").alias("h")] if absorbed else []))
    # one number sorts faster than texts
    if absorbed:
        # a level lies in one partition; frequent levels are spread by their other columns
        often = F.col("h").isin(frequent) if frequent else F.lit(False)
        wide = wide.withColumn("k", F.when(~often, F.xxhash64("h"))).repartition(
            F.col("h"), F.when(often, F.xxhash64(*wide.columns)).otherwise(0)).sortWithinPartitions("k")
    elif kept:
        key, span = F.lit(0).cast("long"), 1
        for i, c in enumerate(kept):
            if len(levels[c]) > MANY_LEVELS or span * (len(levels[c]) + 1) >= 1 << 62:
                break
            span *= len(levels[c]) + 1
            place = F.array_position(F.array(*[F.lit(v) for v in levels[c]]), F.col(f"f{i}"))
            key = key * (len(levels[c]) + 1) + F.coalesce(place, F.lit(0))
        wide = wide.withColumn("k", key).repartitionByRange("k").sortWithinPartitions("k")
    rows = cut_lineage(wide.mapInArrow(_packed(len(numbers), [levels[c] for c in kept], bool(absorbed)),
                                       "block binary"))
    return Design(rows, [name for name, _ in dense], owner, {c: levels[c] for c in random},
                  n_obs, moments["constant"], curves, n_fixed, absorbed,
                  [part for _, part in dense], [kept.index(c) for c in random], bounds)


#: An absorbed factor's level with more merged rows than this, and than a 500th of all, is kept with the coefficients.
HOT_ROWS, HOT_LEVELS = 1 << 16, 500
#: Rows in a block; if a factor is absorbed, up to the end of the level.
BLOCK_ROWS = 1 << 14


def _packed(n_numbers: int, levels: Sequence[Sequence[str]], absorbed: bool):
    """Packs rows in blocks: numbers, codes of the factors' levels, sums, and where each absorbed level begins.

    Rows of a frequent level have no absorbed level, and no key ``k``; they come first, if a block has any."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def block(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            size = table.num_rows
            numbers = np.array([table.column(f"v{i}").to_numpy() for i in range(n_numbers)]).reshape(n_numbers, size)
            codes = np.array([pc.fill_null(pc.index_in(table.column(f"f{i}"), value_set=pa.array(v, pa.string())), -1)
                              .to_numpy() for i, v in enumerate(levels)], np.int32).reshape(len(levels), size)
            sums = np.array([table.column(c).to_numpy() for c in ("a", "n", "yy", "rows")])
            first, names = np.zeros(0, int), []
            if absorbed:
                h = table.column("h").combine_chunks().dictionary_encode()
                code = h.indices.to_numpy()
                code = np.where(pc.is_null(table.column("k")).to_numpy(), -1, code)
                order = np.argsort(code, kind="stable")         # levels whose keys agree are set apart
                numbers, codes, sums, code = numbers[:, order], codes[:, order], sums[:, order], code[order]
                first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]) & (code >= 0))
                names = [h.dictionary[int(c)].as_py() for c in code[first]]
            blob = pickle.dumps([*([_tight(v) for v in m] for m in (numbers, codes, sums)), first, names], protocol=5)
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["block"])

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            count += batch.num_rows
            if count < BLOCK_ROWS:
                continue
            table, count = pa.concat_tables(held), 0
            if absorbed:
                last = table.column("k")[-1].as_py()
                held = []
                if last is not None:
                    cut = pc.index(table.column("k"), pa.scalar(last, pa.int64())).as_py()
                    held, table = [table.slice(cut)], table.slice(0, cut)
                    count = held[0].num_rows
                if table.num_rows:
                    yield block(table)
            else:
                held = []
                for lo in range(0, table.num_rows, BLOCK_ROWS):
                    yield block(table.slice(lo, BLOCK_ROWS))
        if held and sum(t.num_rows for t in held):
            yield block(pa.concat_tables(held))
    return pack


def _tight(v: np.ndarray) -> np.ndarray:
    """The same numbers in fewer bytes, where they allow it."""
    if v.size and np.isfinite(v).all() and np.abs(v).max() < 1 << 24:
        for kind in (np.int8, np.int16, np.float32):
            if np.abs(v).max() <= (127 if kind == np.int8 else 32767 if kind == np.int16 else 1 << 24):
                small = v.astype(kind)
                if np.array_equal(small, v):
                    return small
    return v


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The blocks of a table that ``_packed`` wrote: numbers, codes, sums, beginnings and names of absorbed levels."""
    for batch in batches:
        for blob in batch.column("block"):
            numbers, codes, sums, first, names = pickle.loads(blob.as_buffer())
            size = len(sums[0])
            yield (np.array(numbers, float).reshape(len(numbers), size), np.array(codes, np.int32).reshape(len(codes), size),
                   np.array(sums, float), first, names)


def dense_columns(parts: Sequence[Part], numbers: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The columns named by ``parts`` for all rows of a block, one after the other."""
    known: dict[tuple, np.ndarray] = {}
    out = np.empty((len(parts), numbers.shape[1]))
    for to, part in zip(out, parts):
        for f in part.functions:
            if f not in known:
                column, shift, scale, knot = f
                known[f] = x = (numbers[column] - shift) / scale
                if knot is not None:
                    x = np.abs(x - knot)
                    known[f] = x * x * x
        for mark in part.marks:
            if mark not in known:
                known[mark] = (codes[mark[0]] == mark[1]).astype(float)
        factors = [known[f] for f in (*part.functions, *part.marks)]
        to[:] = factors[0] if factors else 1.0
        for more in factors[1:]:
            to *= more
    return out


def _mains(fixed: Sequence[Term]) -> list[Numeric | Factor]:
    out = []
    for t in fixed:
        out += [t.a, t.b] if isinstance(t, Interaction) else [] if isinstance(t, Smooth) else [t]
    return out


@dataclass
class Request:
    """Coefficients at which a pass should evaluate one model."""
    columns: np.ndarray            # dense columns of the model
    coef: np.ndarray               # raw coefficients: dense columns, then all levels


@dataclass
class Sums:
    """Information matrix, score and log-likelihood at the requested coefficients."""
    info: np.ndarray
    score: np.ndarray
    value: float


#: Bytes of sums that a task may hold in one pass.
PASS_BYTES = 1 << 28


def evaluate(design: Design, requests: dict[int, Request], family: str) -> dict[int, Sums]:
    """As few passes over the design as the memory for the requests' sums allows."""
    levels, out, batch, held = sum(design.level_counts), {}, {}, 0
    for key, req in requests.items():
        size = 8 * (len(req.columns) + levels + 1) ** 2
        if batch and held + size > PASS_BYTES:
            out |= _one_pass(design, batch, family)
            batch, held = {}, 0
        batch[key] = req
        held += size
    return out | (_one_pass(design, batch, family) if batch else {})


#: Levels from which the largest factor is summed by level instead of in columns of its own.
MANY_LEVELS = 64
#: Numbers in a piece of rows times requests or column pairs; it should fit a core's cache.
PIECE = 1 << 17


def _one_pass(design: Design, requests: dict[int, Request], family: str) -> dict[int, Sums]:
    """One pass over the design for all requests together.

    Rows lie sorted by their factors.  In a run of rows that agree in them a column is 0 or a function of the
    numbers, and few such functions differ; a run's sums are taken for these, for all requests in one matrix
    product, and added where each column stands.  Spark adds the tasks' sums by request.  The driver receives
    one small system per request.

    Families: ``binomial``; ``gaussian`` (information X'WX, score X'Wy, value y'Wy at any
    coefficients); ``rows`` (X'X over the original rows).
    """
    counts = design.level_counts
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(int)
    many = int(np.argmax(counts)) if counts and max(counts) > MANY_LEVELS and not design.absorbed else None
    few = [k for k in range(len(counts)) if k != many]
    used = np.unique(np.concatenate([r.columns for r in requests.values()])).astype(int)
    base = dict(zip(few, len(used) + np.concatenate([[0], np.cumsum([counts[k] for k in few])]).astype(int)))
    parts = [design.parts[j] for j in used] + [Part(marks=((design.places[k], i),)) for k in few for i in range(counts[k])]
    width = len(parts)
    keys, levels = list(requests), counts[many] if many is not None else 0
    # coefficients per request, and where each stands in the request's own order
    coef, far, places = np.zeros((width, len(keys))), np.zeros((levels, len(keys))), []
    for i, key in enumerate(keys):
        req, m = requests[key], len(requests[key].columns)
        place = np.concatenate([np.searchsorted(used, req.columns), *[
            width + np.arange(counts[k]) if k == many else base[k] + np.arange(counts[k]) for k in range(len(counts))]]).astype(int)
        near = place < width
        coef[place[near], i] = req.coef[near]
        if many is not None:
            far[:, i] = req.coef[m + starts[many]:m + starts[many + 1]]
        places.append(place)
    upper = np.triu_indices(width)
    paired = len(keys) >= 4                 # products of column pairs pay if several requests share them
    n_keys, shortest = len(keys), 64 if len(keys) >= 32 else 512
    many_at = design.places[many] if many is not None else None
    # factors that make up the runs, in the order by which the rows are sorted
    sorted_by = [k for k in range(1 + max((f for p in parts for f, _ in p.marks), default=-1)) if k != many_at]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info, score, value = np.zeros((n_keys, len(upper[0]))), np.zeros((n_keys, width)), np.zeros(n_keys)
        cross = np.zeros((n_keys, levels, width + 2))       # products with the columns, weight, score
        shapes: dict[tuple, tuple] = {}

        def shape(known: tuple[int, ...]) -> tuple:
            """Of a run whose first factors have the ``known`` levels: its differing columns, and which stand where."""
            if known not in shapes:
                apart: dict[Part, list[int]] = {}
                for j, p in enumerate(parts):
                    if all(known[sorted_by.index(f)] == v for f, v in p.marks if f in sorted_by[:len(known)]):
                        left = tuple((f, v) for f, v in p.marks if f not in sorted_by[:len(known)])
                        apart.setdefault(Part(p.functions, left), []).append(j)
                live = np.array([j for at in apart.values() for j in at], int)
                of = np.array([i for i, at in enumerate(apart.values()) for _ in at], int)
                pairs = np.triu_indices(len(apart))
                number = np.zeros((len(apart),) * 2, int)
                number[pairs] = np.arange(len(pairs[0]))
                number = np.maximum(number, number.T)
                order = np.argsort(live)
                live, of = live[order], of[order]
                i, j = np.triu_indices(len(live))
                row, col = live[i], live[j]
                shapes[known] = (list(apart), live, of, pairs, row * width - row * (row - 1) // 2 + col - row,
                                 number[of[i], of[j]])
            return shapes[known]

        for numbers, codes, (a_all, n_all, yy, rows), _, _ in blocks(batches):
            size, runs, depth = len(a_all), np.array([0]), 0
            starts_run = np.zeros(size, bool)
            starts_run[:1] = True
            for k, f in enumerate(sorted_by, 1):
                starts_run[1:] |= codes[f, 1:] != codes[f, :-1]
                if starts_run.sum() * shortest > size:
                    break
                runs, depth = np.flatnonzero(starts_run), k
            for lo, hi in zip(runs, [*runs[1:], size]):
                apart, live, of, pairs, at, number = shape(tuple(codes[f, lo] for f in sorted_by[:depth]))
                own = np.zeros((len(apart), n_keys))
                np.add.at(own, of, coef[live])
                long = max(64, PIECE // max(n_keys, len(pairs[0]) if paired else len(apart)))
                if many is not None:
                    order = lo + np.argsort(codes[many_at, lo:hi], kind="stable")
                    one = [v[order] for v in (a_all, n_all, yy, rows, codes[many_at])]
                    num, cod = numbers[:, order], codes[:, order]
                else:
                    one, num, cod = [v[lo:hi] for v in (a_all, n_all, yy, rows)], numbers[:, lo:hi], codes[:, lo:hi]
                run_info = np.zeros((n_keys, len(pairs[0])))
                run_score = np.zeros((n_keys, len(apart)))
                for cut in range(0, hi - lo, long):
                    sl = slice(cut, cut + long)
                    by_column, a, n = dense_columns(apart, num[:, sl], cod[:, sl]), one[0][sl, None], one[1][sl, None]
                    d = by_column.T
                    if family == "binomial":
                        eta = d @ own
                        if many is not None:
                            eta += far[one[4][sl]]
                        odds = np.exp(np.clip(eta, -40, 40, out=eta))
                        value += a[:, 0] @ eta
                        rest = np.add(odds, 1.0)
                        value -= n[:, 0] @ np.log(rest)
                        np.divide(odds, rest, out=odds)
                        odds *= n                               # the mean
                        w, r = odds / rest, a - odds
                    elif family == "gaussian":
                        w, r = np.repeat(n, n_keys, 1), np.repeat(a, n_keys, 1)
                        value += one[2][sl].sum()
                    else:
                        w = r = np.repeat(one[3][sl, None], n_keys, 1)
                        value += w.sum(axis=0)
                    run_score += r.T @ d
                    if paired:
                        run_info += w.T @ (by_column[pairs[0]] * by_column[pairs[1]]).T
                    if many is not None:
                        here = one[4][sl]
                        first = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
                    for i in range(n_keys if many is not None or not paired else 0):
                        wd = w[:, i, None] * d
                        if not paired:
                            run_info[i] += (d.T @ wd)[pairs]
                        if many is not None:
                            sums = np.add.reduceat(np.column_stack([wd, w[:, i], r[:, i]]), first, axis=0)
                            cross[i, here[first][:, None], live] += sums[:, of]
                            cross[i, here[first], width:] += sums[:, -2:]
                info[:, at] += run_info[:, number]
                score[:, live] += run_score[:, of]
        flat = np.concatenate([info, score, value[:, None], cross.reshape(n_keys, -1)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_keys)), pa.array([v.tobytes() for v in flat], pa.binary())],
                                         ["id", "v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(v.as_buffer())
                total[key] = total[key] + part if key in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()),
                                          pa.array([v.tobytes() for v in total.values()], pa.binary())], ["id", "v"])

    sums = (design.rows.mapInArrow(partial, "id long, v binary").repartition("id")
            .mapInArrow(added, "id long, v binary").toArrow())
    out = {}
    for i, v in zip(sums.column("id").to_pylist(), sums.column("v").to_pylist()):
        flat, place, size = np.frombuffer(v), places[i], width + levels
        info, score = np.zeros((size, size)), np.zeros(size)
        info[upper] = flat[:len(upper[0])]
        score[:width], value = flat[len(upper[0]):len(upper[0]) + width], flat[len(upper[0]) + width]
        by_level = flat[len(upper[0]) + width + 1:].reshape(levels, width + 2)
        info[:width, width:] = by_level[:, :width].T
        info[np.arange(width, size), np.arange(width, size)] = by_level[:, width]
        score[width:] = by_level[:, width + 1]
        info = info + np.triu(info, 1).T
        out[keys[i]] = Sums(info[np.ix_(place, place)], score[place], float(value))
    if not out:                             # a design without any partition
        out = {k: Sums(np.zeros((len(p), len(p))), np.zeros(len(p)), 0.0) for k, p in zip(keys, places)}
    return out
