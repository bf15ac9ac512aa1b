"""Gradient boosting on binned features, one histogram aggregate a tree level, for many models at once.

Every feature is cut into at most MOST_BINS bins: one for each value where there are so few, else at sketched quantiles. Rows
become blocks of byte codes. A model (Run) trains on the rows of some parts; at each level, each block adds up gradient and count by node,
feature and bin, Spark sums these over the blocks, and splits are chosen from the sums, whose number depends on the models
alone. All runs grow in the same passes, each at its own level, so that a sweep needs as many passes as its
longest run. Predictions so far are written down with the blocks every REFRESH trees.

A table of at most SMALL_ROWS rows (counted first) is a few megabytes of codes: these go to the tasks, a run to each, and
the same steps happen there without passes. A larger table whose rows have at most SMALL_ROWS different codes (counted too) needs no passes
either: rows with the same codes are in one node at every step, so that the number and the target's sum of those that each tree draws are all a fit asks for.
Spark adds these up once, for all trees, and they travel to the runs in the order of the trees, while rows stay where they are. All ways
give the same trees bit by bit: gradients are whole multiples of a unit, so that sums do not depend on the order of rows or blocks, and
rows are drawn by a hash of their values.

Second-order boosting on squared error, L1 and L2 penalties on leaves, row and column sampling, learned directions for
missing values, optional early stopping on the rows of other parts.
"""

from __future__ import annotations

import copy
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .forests import Forest

MOST_BINS, MISSING, BINS = 255, 255, 256
#: Rows of a block; rows of a table that tasks get whole, as codes; trees between two written states.
BLOCK_ROWS, SMALL_ROWS, REFRESH = 65_536, 200_000, 20
#: Gradients have so many bits below the range of the target.
BITS = 30
#: Sums of one pass (runs x nodes x features x bins) at most.
MOST_SUMS = 50_000_000


@dataclass(frozen=True)
class Params:
    n_estimators: int = 250
    max_depth: int = 3
    learning_rate: float = 0.05
    subsample: float = 0.7
    colsample: float = 0.85
    min_child_weight: float = 6.0
    reg_alpha: float = 0.1
    reg_lambda: float = 2.0
    early_stopping: int = 0
    seed: int = 42


@dataclass(frozen=True)
class Run:
    """One model: its features, settings, and the parts of the rows that it trains on and is stopped by. Rows with a missing value are left out where `complete`."""

    name: str
    features: tuple[str, ...]
    params: Params
    parts: frozenset[int]
    held: frozenset[int] = frozenset()
    complete: bool = True


@dataclass
class Bins:
    """A feature's bins: their lowest values, and whether each holds one value only."""

    lowest: np.ndarray
    exact: bool

    def codes(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float32)
        at = np.searchsorted(self.lowest, v, side="right") - (1 if self.exact else 0)
        return np.where(np.isnan(v), MISSING, np.clip(at, 0, MOST_BINS - 1)).astype(np.uint8)

    def cut(self, i: int, j: int) -> float:
        """The value that separates bin i from the next one in use, j."""
        if not self.exact:
            return float(self.lowest[j - 1])
        middle = np.float32((float(self.lowest[i]) + float(self.lowest[j])) / 2)
        return float(middle) if middle > self.lowest[i] else float(self.lowest[j])

    @staticmethod
    def of(values: np.ndarray, exact: bool) -> Bins:
        return Bins(np.unique(np.asarray(values, np.float32)), exact)


def bins_of(rows: DataFrame, features: list[str]) -> dict[str, Bins]:
    """Bins of all features: two aggregates over (feature, value) rows, of mergeable sketches and of sets that a sketch of their size lets be small.

    One aggregate for all features keeps the plan as small for forty as for one; partial sketches, not values, are shuffled.
    """
    if not features:
        return {}
    values = rows.select(F.posexplode(F.array(*[F.col(f).cast("float") for f in features])).alias("f", "v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    probabilities = F.split(F.lit(",".join(str(k / MOST_BINS) for k in range(1, MOST_BINS))), ",").cast("array<double>")
    sketched = {r["f"]: r for r in values.groupBy("f").agg(F.approx_count_distinct("v", 0.02).alias("n"), F.percentile_approx("v", probabilities, F.lit(10_000)).alias("cuts")).collect()}
    few = [i for i, r in sketched.items() if r["n"] <= MOST_BINS * 1.2]
    sets = {r["f"]: r["known"] for r in values.filter(F.col("f").isin(few)).groupBy("f").agg(F.collect_set("v").alias("known")).collect()} if few else {}
    exact = {i for i, known in sets.items() if len(known) <= MOST_BINS}
    return {f: Bins.of(sets[i], True) if i in exact else Bins.of(sketched[i]["cuts"], False) if i in sketched else Bins.of([], True) for i, f in enumerate(features)}


@dataclass
class Block:
    codes: np.ndarray  # features x rows
    y: np.ndarray
    part: np.ndarray
    key: np.ndarray

    @property
    def n(self) -> int:
        return len(self.y)

    def some(self, rows: np.ndarray) -> Block:
        return Block(self.codes[:, rows], self.y[rows], self.part[rows], self.key[rows])


def members(block: Block, run: Run, columns: np.ndarray, held: bool = False) -> np.ndarray:
    """Places of the run's rows (or of those held out from it)."""
    ok = np.isin(block.part, list(run.held if held else run.parts)) & ~np.isnan(block.y)
    if run.complete:
        ok &= (block.codes[columns] != MISSING).all(axis=0)
    return np.flatnonzero(ok)


def _mixed(key: np.ndarray, *by: int) -> np.ndarray:
    x = key.astype(np.uint64)
    with np.errstate(over="ignore"):
        for b in by:
            x = (x ^ np.uint64(b + 1)) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            x = x * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
    return x


def drawn(key: np.ndarray, p: Params, tree: int) -> np.ndarray:
    """The rows that a tree sees: each by a hash of its values, the seed and the tree."""
    if p.subsample >= 1:
        return np.ones(len(key), bool)
    return _mixed(key, p.seed, tree) < np.uint64(min(p.subsample * 2.0**64, 2.0**64 - 2048))


def histograms(codes: np.ndarray, node: np.ndarray, g: np.ndarray, n_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradients and counts, nodes x features x bins; rows of a negative node take no part."""
    on = np.flatnonzero(node >= 0)
    base, w = node[on] * BINS, g[on].astype(float)
    size = n_nodes * BINS
    sums, counts = np.empty((len(codes), size), np.int64), np.empty((len(codes), size), np.int64)
    for f, column in enumerate(codes):
        at = base + column[on]
        sums[f] = np.bincount(at, weights=w, minlength=size)  # whole numbers below 2^53
        counts[f] = np.bincount(at, minlength=size)
    shape = (len(codes), n_nodes, BINS)
    return sums.reshape(shape).transpose(1, 0, 2), counts.reshape(shape).transpose(1, 0, 2)


def _soft(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


@dataclass
class Tree:
    """A tree over codes: column -1 marks a leaf."""

    column: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    default_left: list[bool] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)

    def add(self, value: float, cover: float, depth: int) -> int:
        for column, v in ((self.column, -1), (self.bin, 0), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.default_left, True), (self.value, value), (self.cover, cover), (self.depth, depth)):
            column.append(v)
        return len(self.column) - 1

    def step(self, codes: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Each row one level down, if its node is split."""
        column = np.array(self.column)[node]
        code = codes[np.maximum(column, 0), np.arange(len(node))]
        left = np.where(code == MISSING, np.array(self.default_left)[node], code <= np.array(self.bin)[node])
        return np.where(column < 0, node, np.where(left, np.array(self.left)[node], np.array(self.right)[node]))

    def walk(self, codes: np.ndarray) -> np.ndarray:
        node = np.zeros(codes.shape[1], np.int64)
        for _ in range(max(self.depth, default=0)):
            node = self.step(codes, node)
        return node


class Growth:
    """The state of one run between sums: what it asks for (frontier) and what it makes of the answer."""

    def __init__(self, run: Run, columns: np.ndarray, bins: list[Bins]):
        self.run, self.p, self.columns, self.bins = run, run.params, columns, bins
        self.trees: list[Tree] = []
        self.tree, self.frontier = Tree(), []
        self.base, self.unit, self.done = 0.0, 1.0, False
        self.best, self.best_round = math.inf, -1

    def measured(self, n: int, low: float, high: float) -> None:
        whole = 2.0 ** math.ceil(math.log2(high - low)) if n and high > low else 1.0
        self.n, self.unit = n, whole / 2**BITS
        self.low = math.floor(low / whole) * whole if n else 0.0  # the same for most parts of a table
        self.done = not n or self.p.n_estimators < 1

    def begin(self, total: int) -> None:
        self.base = self.low + total * self.unit / self.n if self.n else 0.0
        self.open()

    def open(self) -> None:
        p, f = self.p, len(self.columns)
        rng = np.random.default_rng((p.seed, len(self.trees)))
        self.picked = np.sort(rng.choice(f, max(1, int(f * p.colsample)), replace=False)) if p.colsample < 1 else np.arange(f)
        self.tree, self.frontier = Tree(), [-1]  # the root, whose sums are not known yet

    def used(self) -> np.ndarray:
        """Columns that the tree at hand looks at."""
        return self.columns[self.picked]

    def whole(self, y: np.ndarray) -> np.ndarray:
        return np.rint((y - self.low) / self.unit)

    def gradient(self, pred: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.whole(pred) - self.whole(y)

    def _value(self, g: float, h: float) -> float:
        weight = h + self.p.reg_lambda
        return -float(_soft(g * self.unit, self.p.reg_alpha) / weight) * self.p.learning_rate if weight else 0.0

    def _score(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return _soft(g * self.unit, self.p.reg_alpha) ** 2 / (h + self.p.reg_lambda)

    def light(self, since: int) -> Growth:
        """What tasks need: without the trees whose values the blocks hold."""
        out = copy.copy(self)
        out.trees = [None] * min(since, len(self.trees)) + self.trees[since:]
        return out

    def feed(self, sums: np.ndarray, counts: np.ndarray) -> None:
        """Splits the nodes of the frontier by their sums (frontier x used columns x bins) and opens the next level, or closes the tree."""
        p = self.p
        g_all, n_all = sums[:, 0].sum(axis=1), counts[:, 0].sum(axis=1)
        if self.frontier == [-1]:
            self.frontier = [self.tree.add(self._value(int(g_all[0]), int(n_all[0])), float(n_all[0]), 0)]
        h = counts[:, :, :MOST_BINS]
        gl, hl = np.cumsum(sums[:, :, :MOST_BINS], axis=2), np.cumsum(h, axis=2)
        # cuts after a bin in use, with one in use beyond it; few of all bins where nodes are small
        node_of, c_of, i_of = np.nonzero((h > 0) & (hl < hl[:, :, -1:]))
        gl, hl = gl[node_of, c_of, i_of], hl[node_of, c_of, i_of]
        g_m, h_m = sums[node_of, c_of, MISSING], counts[node_of, c_of, MISSING]
        ways = []
        for to_left in (True, False):
            a, ha = (gl + g_m, hl + h_m) if to_left else (gl, hl)
            b, hb = g_all[node_of] - a, n_all[node_of] - ha
            ok = (ha >= p.min_child_weight) & (hb >= p.min_child_weight) & (ha > 0) & (hb > 0) & (to_left | (h_m > 0))
            gain = np.full(len(ok), -np.inf)
            gain[ok] = self._score(a[ok], ha[ok]) + self._score(b[ok], hb[ok]) - self._score(g_all, np.maximum(n_all, 1))[node_of[ok]]
            ways.append(gain)
        bounds, coming = np.searchsorted(node_of, np.arange(len(self.frontier) + 1)), []
        for k, node in enumerate(self.frontier):
            own = slice(bounds[k], bounds[k + 1])
            if own.start == own.stop:
                continue
            # the first of equal gains: by column, missing values to the left before to the right, by bin
            top = [own.start + int(w[own].argmax()) for w in ways]
            way = int((ways[1][top[1]], -c_of[top[1]]) > (ways[0][top[0]], -c_of[top[0]]))
            if not ways[way][top[way]] > 1e-12:
                continue
            c, i = int(c_of[top[way]]), int(i_of[top[way]])
            j = int(np.flatnonzero(h[k, c, i + 1 :])[0]) + i + 1
            t, column = self.tree, int(self.used()[c])
            g_left, n_left = int(sums[k, c, : i + 1].sum()), int(counts[k, c, : i + 1].sum())
            if way == 0:
                g_left, n_left = g_left + int(sums[k, c, MISSING]), n_left + int(counts[k, c, MISSING])
            t.column[node], t.bin[node], t.cut[node], t.default_left[node] = column, int(i), self.bins[column].cut(int(i), j), way == 0
            depth = t.depth[node] + 1
            for side, gs, ns in (("left", g_left, n_left), ("right", int(g_all[k]) - g_left, int(n_all[k]) - n_left)):
                child = t.add(self._value(gs, ns), float(ns), depth)
                getattr(t, side)[node] = child
                if depth < p.max_depth and ns >= 2:
                    coming.append(child)
        self.frontier = coming

    def close(self) -> None:
        self.trees.append(self.tree)
        self.tree, self.frontier = Tree(), []
        if len(self.trees) >= self.p.n_estimators:
            self.done = True

    def stopped_by(self, error: float, n: int) -> None:
        """Keeps the best round by the error on the rows held out, and stops when it lies `early_stopping` rounds back."""
        rmse, k = math.sqrt(error / n) if n else math.inf, len(self.trees) - 1
        if rmse < self.best:
            self.best, self.best_round = rmse, k
        elif k - self.best_round >= self.p.early_stopping:
            self.done = True

    def forest(self) -> Forest:
        trees = self.trees[: self.best_round + 1] if self.p.early_stopping and self.run.held and self.best_round >= 0 else self.trees
        place = {int(c): i for i, c in enumerate(self.columns)} | {-1: -1}
        rows = [(k, m, place[t.column[m]], t.cut[m], t.left[m], t.right[m], t.default_left[m], t.value[m], t.cover[m]) for k, t in enumerate(trees) for m in range(len(t.column))]
        return Forest(list(self.run.features), self.base, rows)


def grow_here(growth: Growth, block: Block) -> Forest:
    """A run on one block in memory."""
    own = block.some(members(block, growth.run, growth.columns))
    early = growth.p.early_stopping and growth.run.held
    other = block.some(members(block, growth.run, growth.columns, held=True)) if early else None
    growth.measured(own.n, float(own.y.min(initial=np.inf)), float(own.y.max(initial=-np.inf)))
    if not own.n:
        return growth.forest()
    growth.begin(int(growth.whole(own.y).astype(np.int64).sum()))
    pred, seen = np.full(own.n, growth.base), np.full(other.n if early else 0, growth.base)
    while not growth.done:
        growth.open()
        tree = growth.tree
        g, on, node = growth.gradient(pred, own.y), drawn(own.key, growth.p, len(growth.trees)), np.zeros(own.n, np.int64)
        codes = own.codes[growth.used()]
        while growth.frontier:
            place = np.full(len(tree.column) + 1, -1)
            place[growth.frontier if growth.frontier != [-1] else [0]] = np.arange(len(growth.frontier))
            growth.feed(*histograms(codes, np.where(on, place[node], -1), g, len(growth.frontier)))
            node = tree.step(own.codes, node)
        pred += np.array(tree.value)[node]
        growth.close()
        if early:
            seen += np.array(tree.value)[tree.walk(other.codes)]
            growth.stopped_by(math.fsum((seen - other.y) ** 2), other.n)
    return growth.forest()


BLOCK_SCHEMA = "n int, codes binary, y binary, part binary, key binary, pred binary"


def blocks_of(rows: DataFrame, target: str, features: list[str], bins: dict[str, Bins]) -> DataFrame:
    """The rows (part, target, features) as blocks of codes."""
    keyed = rows.select(F.col("part").cast("int").alias("part"), F.col(target).cast("double").alias("y"), F.xxhash64(target, *features).alias("key"), *[F.col(f).cast("float").alias(f"f{i}") for i, f in enumerate(features)])
    known = [bins[f] for f in features]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            column = lambda c, kind: t.column(c).to_numpy().astype(kind)
            codes = np.stack([b.codes(column(f"f{i}", np.float32)) for i, b in enumerate(known)]) if known else np.zeros((0, n), np.uint8)
            part = np.where(t.column("part").is_valid().to_numpy(), t.column("part").fill_null(0).to_numpy(), -1).astype(np.int32)
            data = [codes.tobytes(), column("y", float).tobytes(), part.tobytes(), column("key", np.int64).tobytes(), b""]
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *[pa.array([d], pa.binary()) for d in data]], names=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield block()
                held, n = [], 0
        if n:
            yield block()

    return keyed.mapInArrow(run, BLOCK_SCHEMA)


def _block(row: dict) -> Block:
    n = row["n"]
    return Block(np.frombuffer(row["codes"], np.uint8).reshape(-1, n), np.frombuffer(row["y"]), np.frombuffer(row["part"], np.int32), np.frombuffer(row["key"], np.int64))


def _joined(rows: list) -> Block:
    parts = [_block(r) for r in rows]
    return Block(np.concatenate([b.codes for b in parts], axis=1), *[np.concatenate([getattr(b, c) for b in parts]) for c in ("y", "part", "key")])


def fit_runs(rows: DataFrame, target: str, runs: list[Run], small_rows: int = SMALL_ROWS, refresh: int = REFRESH) -> dict[str, Forest]:
    """A forest for each run. rows has the target, all features and `part`, a number that tells which runs train on a row."""
    features = sorted({f for r in runs for f in r.features})
    if not runs:
        return {}
    slim = rows.select("part", target, *features)
    bins = bins_of(slim, features)
    place = {f: i for i, f in enumerate(features)}
    growths = [Growth(r, np.array([place[f] for f in r.features], int), [bins[f] for f in features]) for r in runs]
    blocks = checkpoint(blocks_of(slim, target, features, bins))
    n = blocks.agg(F.sum("n")).first()[0] or 0
    if n <= small_rows:
        forests = _in_tasks(blocks, growths) if n else [g.forest() for g in growths]
    else:
        forests = _by_codes(blocks, growths, small_rows) or _in_passes(blocks, growths, refresh)
    return {r.name: f for r, f in zip(runs, forests, strict=True)}


def _in_tasks(blocks: DataFrame, growths: list[Growth]) -> list[Forest]:
    """At most SMALL_ROWS rows, as codes: every task gets them and grows one run."""
    spark = blocks.sparkSession
    packed = [r.asDict() for r in blocks.select("n", "codes", "y", "part", "key").collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _joined(packed)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                forest = grow_here(growths[i], block)
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([pickle.dumps((forest.base, forest.rows))], pa.binary())], names=["run", "forest"])

    got = spark.range(0, len(growths), 1, len(growths)).mapInArrow(run, "run long, forest binary").collect()  # a model each
    made = {r["run"]: pickle.loads(r["forest"]) for r in got}
    return [Forest(list(g.run.features), *made[i]) for i, g in enumerate(growths)]


#: Vectors in a record of sums; sums (vectors x trees) that a task holds at once.
PIECE, MOST_CELLS = 256, 4_000_000


@dataclass(frozen=True)
class Draw:
    """What sums over drawn rows depend on, besides the rows: the draws, and the whole numbers that stand for the target."""

    params: Params
    low: float
    unit: float

    @staticmethod
    def of(g: Growth) -> Draw:
        return Draw(Params(seed=g.p.seed, subsample=g.p.subsample) if g.p.subsample < 1 else Params(seed=0, subsample=1.0), g.low, g.unit)


def _hashed(b: Block) -> np.ndarray:
    h = _mixed(b.part.astype(np.int64).view(np.uint64), 0)
    for c in b.codes:
        h = _mixed(h + c, 1)
    return h.view(np.int64)


def _added(at: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of whole numbers by place, also beyond 2^53."""
    if float(np.abs(v).sum(dtype=float)) < 2.0**52:
        return np.bincount(at, weights=v, minlength=size).astype(np.int64)
    high, low = v >> 26, v & (2**26 - 1)
    return (np.bincount(at, weights=high, minlength=size).astype(np.int64) << 26) + np.bincount(at, weights=low, minlength=size).astype(np.int64)


def _vectors(blocks: DataFrame, most: int) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray] | None:
    """The different (part, codes) as a block in the order of their hashes, with their numbers of rows and lowest and highest targets; None if there are more than `most`."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _block(row)
                b = b.some(np.flatnonzero(~np.isnan(b.y)))
                h, first, place, n = np.unique(_hashed(b), return_index=True, return_inverse=True, return_counts=True)
                low, high = np.full(len(h), np.inf), np.full(len(h), -np.inf)
                np.minimum.at(low, place, b.y)
                np.maximum.at(high, place, b.y)
                codes = pa.array([c.tobytes() for c in b.codes[:, first].T], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(b.part[first]), codes, pa.array(n), pa.array(low), pa.array(high)], names=["h", "part", "codes", "n", "low", "high"])

    every = blocks.mapInArrow(found, "h long, part int, codes binary, n long, low double, high double")
    merged = every.groupBy("h", "part", "codes").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    got = merged.limit(most + 1).toArrow().sort_by("h")  # `most` rows of codes at most
    h = got.column("h").to_numpy()
    if not 0 < len(h) <= most or (np.diff(h) == 0).any():  # two vectors of one hash
        return None
    codes = np.frombuffer(b"".join(got.column("codes").to_pylist()), np.uint8).reshape(len(h), -1).T
    n, low, high = (got.column(c).to_numpy() for c in ("n", "low", "high"))
    return Block(np.ascontiguousarray(codes), np.zeros(len(h)), got.column("part").to_numpy(), h), n, low, high


def _drawn_sums(blocks: DataFrame, h: np.ndarray, rows: np.ndarray, draws: dict[Draw, int]) -> DataFrame:
    """(kind, tree, first, n, s): for each Draw and tree, numbers of drawn rows and sums of their targets, of PIECE vectors from `first` on; tree -1 has all rows. Records of one place add up."""
    width = sum(t for t in draws.values()) + len(draws)
    parts = max(2 * blocks.sparkSession.sparkContext.defaultParallelism, -(-len(h) * width // MOST_CELLS))
    share = rows.sum() / parts
    chunk = np.minimum((np.cumsum(rows) - rows) // share, np.arange(len(h))).astype(np.int64)
    chunk = np.maximum(chunk, np.arange(len(h)) // -(-MOST_CELLS // width))  # neither too many rows nor too many vectors
    starts = np.flatnonzero(np.diff(chunk, prepend=-1))
    ends = np.r_[starts[1:], len(h)]
    split = np.maximum(1, np.rint(np.add.reduceat(rows, starts) / share)).astype(np.int64)  # a vector of very many rows goes to several tasks
    base = np.r_[0, np.cumsum(split)]
    of_task = np.repeat(np.arange(len(starts)), split)
    of_vector = np.repeat(np.arange(len(starts)), ends - starts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _block(row)
                b = b.some(np.flatnonzero(~np.isnan(b.y)))
                at = np.searchsorted(h, _hashed(b))
                c = of_vector[at]
                task = base[c] + (_mixed(b.key, 7) % split[c].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(task.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(b.y), pa.array(b.key)], names=["task", "at", "y", "key"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch in batches:
            if not batch.num_rows:
                continue
            task, at, y, key = (batch.column(i).to_numpy() for i in range(4))
            if first is None:
                first, end = int(starts[of_task[task[0]]]), int(ends[of_task[task[0]]])
                size = end - first
                n = [np.zeros((t + 1, size), np.int64) for t in draws.values()]
                s = [np.zeros((t + 1, size), np.int64) for t in draws.values()]
            at = at - first
            for k, (d, trees) in enumerate(draws.items()):
                v = np.rint((y - d.low) / d.unit)
                for t in range(-1, trees):
                    own = drawn(key, d.params, t) if t >= 0 else slice(None)
                    n[k][t + 1] += np.bincount(at[own], minlength=size)
                    s[k][t + 1] += np.bincount(at[own], weights=v[own], minlength=size).astype(np.int64)  # whole numbers below 2^53
        if first is None:
            return
        places = list(range(0, size, PIECE))
        for k, trees in enumerate(draws.values()):
            for t in range(-1, trees):
                packed = [[a[k][t + 1, i : i + PIECE].tobytes() for i in places] for a in (n, s)]
                m = len(places)
                yield pa.RecordBatch.from_arrays([pa.array([k] * m, pa.int32()), pa.array([t] * m, pa.int32()), pa.array([first + i for i in places], pa.int32()), *[pa.array(x, pa.binary()) for x in packed]], names=["kind", "tree", "first", "n", "s"])

    dealt = blocks.mapInArrow(deal, "task int, at int, y double, key long")
    return dealt.repartitionById(int(base[-1]), F.col("task")).mapInArrow(add, "kind int, tree int, first int, n binary, s binary")


class _Counted:
    """A run that grows over vectors of codes instead of rows."""

    def __init__(self, growth: Growth, vectors: Block):
        self.growth, self.at = growth, members(vectors, growth.run, growth.columns)
        self.codes = vectors.codes[:, self.at]

    def begin(self, s: np.ndarray) -> None:
        self.growth.begin(int(s[self.at].sum()))
        self.pred = np.full(len(self.at), self.growth.base)

    def grow(self, n: np.ndarray, s: np.ndarray) -> None:
        """One tree over the rows drawn: n of each vector, whose targets sum up to s."""
        growth = self.growth
        growth.open()
        tree, many = growth.tree, n[self.at]
        g, node = many * growth.whole(self.pred).astype(np.int64) - s[self.at], np.zeros(len(self.at), np.int64)
        codes, on = self.codes[growth.used()], np.flatnonzero(many)
        g, many = g[on], many[on]
        codes = codes[:, on]
        while growth.frontier:
            place = np.full(len(tree.column) + 1, -1)
            place[growth.frontier if growth.frontier != [-1] else [0]] = np.arange(len(growth.frontier))
            growth.feed(*counted_histograms(codes, place[node[on]], g, many, len(growth.frontier)))
            node = tree.step(self.codes, node)
        self.pred += np.array(tree.value)[node]
        growth.close()


def counted_histograms(codes: np.ndarray, node: np.ndarray, g: np.ndarray, n: np.ndarray, n_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """The histograms of vectors that stand for n rows each, with gradients summed up to g."""
    on = np.flatnonzero(node >= 0)
    base, g, n, size = node[on] * BINS, g[on], n[on], n_nodes * BINS
    both = [np.stack([_added(base + column[on], v, size) for column in codes]).reshape(len(codes), n_nodes, BINS).transpose(1, 0, 2) for v in (g, n)]
    return both[0], both[1]


def _by_codes(blocks: DataFrame, growths: list[Growth], most: int) -> list[Forest] | None:
    """Forests from sums by the different codes of rows; None where there are more than `most`, or a run is stopped by rows held out."""
    if any(g.p.early_stopping and g.run.held for g in growths):
        return None
    found = _vectors(blocks, most)
    if found is None:
        return None
    vectors, rows, low, high = found
    for g in growths:
        at = members(vectors, g.run, g.columns)
        g.measured(int(rows[at].sum()), float(low[at].min(initial=np.inf)), float(high[at].max(initial=-np.inf)))
    open_ = [i for i, g in enumerate(growths) if not g.done]
    if not open_:
        for g in growths:
            if g.n:
                return None  # models without trees
        return [g.forest() for g in growths]
    draws: dict[Draw, int] = {}
    for i in open_:
        d = Draw.of(growths[i])
        draws[d] = max(draws.get(d, 0), growths[i].p.n_estimators if growths[i].p.subsample < 1 else 0)
    kinds = {d: k for k, d in enumerate(draws)}
    # runs that ask for the same sums share them, as many tasks as there are cores
    spark = blocks.sparkSession
    cost = lambda i: growths[i].p.n_estimators * len(growths[i].columns) * growths[i].p.max_depth
    target = sum(map(cost, open_)) / max(1, spark.sparkContext.defaultParallelism)
    tasks: list[tuple[int, list[int]]] = []
    for d, k in kinds.items():
        own, load = sorted((i for i in open_ if Draw.of(growths[i]) == d), key=cost, reverse=True), math.inf
        for i in own:
            if load + cost(i) > 1.2 * target:
                tasks.append((k, []))
                load = 0
            tasks[-1][1].append(i)
            load += cost(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, runs = None, []
        n, s = (np.zeros(vectors.n, np.int64) for _ in range(2))

        def use(tree: int) -> None:
            for r in runs:
                if tree < 0:
                    r.begin(s)
                    while not r.growth.done and r.growth.p.subsample >= 1:
                        r.grow(n, s)
                elif not r.growth.done:
                    r.grow(n, s)

        for batch in batches:
            for task, tree, first, more_n, more_s in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at is None:
                    runs = [_Counted(growths[i], vectors) for i in tasks[task][1]]
                elif at != (task, tree):
                    use(at[1])
                    n[:], s[:] = 0, 0
                at = task, tree
                for all_, more in ((n, more_n), (s, more_s)):
                    m = np.frombuffer(more, np.int64)
                    all_[first : first + len(m)] += m
        if at is not None:
            use(at[1])
            made = [pickle.dumps((f.base, f.rows)) for f in (r.growth.forest() for r in runs)]
            yield pa.RecordBatch.from_arrays([pa.array(tasks[at[0]][1], pa.int64()), pa.array(made, pa.binary())], names=["run", "forest"])

    sums = _drawn_sums(blocks, vectors.key, rows, draws)
    assigned = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(tasks)], "task int, kind int")  # a row a task
    sent = sums.join(F.broadcast(assigned), "kind").select("task", "tree", "first", "n", "s")
    got = sent.repartitionById(len(tasks), F.col("task")).sortWithinPartitions("task", "tree", "first").mapInArrow(run, "run long, forest binary").collect()  # a model each
    made = {r["run"]: pickle.loads(r["forest"]) for r in got}
    return [Forest(list(g.run.features), *made[i]) if i in made else g.forest() for i, g in enumerate(growths)]


SUM_SCHEMA = "run int, node int, feature int, bin int, g long, n long, e double, low double, high double"
_SUM_NAMES = [x.split()[0] for x in SUM_SCHEMA.split(", ")]


def _sum_rows(columns: list) -> pa.RecordBatch:
    kinds = [pa.int32()] * 4 + [pa.int64()] * 2 + [pa.float64()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_SUM_NAMES)


def _one(run: int, kind: int, g: int = 0, n: int = 0, e: float = 0.0, low: float = math.inf, high: float = -math.inf) -> pa.RecordBatch:
    """A number of a run that is no histogram; `kind`, below zero, takes the node's place."""
    return _sum_rows([[run], [kind], [0], [0], [g], [n], [e], [low], [high]])


MEASURE, TOTAL, ERROR = -2, -3, -4


def _pass(blocks: DataFrame, each) -> list:
    """Runs `each` (row of a block -> record batches of sums) over the blocks and adds up what it gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from each(row)

    summed = blocks.mapInArrow(run, SUM_SCHEMA).groupBy("run", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n"), F.sum("e").alias("e"), F.min("low").alias("low"), F.max("high").alias("high"))
    return summed.toArrow()


def _predicted(growth: Growth, since: int, block: Block, stored: np.ndarray | None) -> np.ndarray:
    pred = stored.copy() if stored is not None else np.full(block.n, growth.base)
    for t in growth.trees[since:]:
        pred += np.array(t.value)[t.walk(block.codes)]
    return pred


def _in_passes(blocks: DataFrame, growths: list[Growth], refresh: int) -> list[Forest]:
    most = sum(2 ** max(0, g.p.max_depth - 1) * len(g.columns) * BINS for g in growths)
    if most > MOST_SUMS:
        raise ValueError(f"{most} sums in a pass; fit fewer runs at once")

    def measure(row):
        b = _block(row)
        for i, g in enumerate(growths):
            y = b.y[members(b, g.run, g.columns)]
            yield _one(i, MEASURE, n=len(y), low=float(y.min(initial=np.inf)), high=float(y.max(initial=-np.inf)))

    for r in _pass(blocks, measure).to_pylist():
        growths[r["run"]].measured(r["n"], r["low"], r["high"])

    def total(row):
        b = _block(row)
        for i, g in enumerate(growths):
            if g.n:
                yield _one(i, TOTAL, g=int(g.whole(b.y[members(b, g.run, g.columns)]).astype(np.int64).sum()))

    for r in _pass(blocks, total).to_pylist():
        growths[r["run"]].begin(r["g"])

    since = 0  # trees of each run whose values the blocks hold

    while any(not g.done for g in growths):
        for g in growths:
            if not g.done and not g.frontier:
                g.open()
        stored_trees = since

        sent = [g.light(stored_trees) for g in growths]

        def level(row, stored_trees=stored_trees, sent=sent):
            b = _block(row)
            stored = np.frombuffer(row["pred"]).reshape(len(sent), -1) if row["pred"] else None
            for i, g in enumerate(sent):
                if g.done:
                    continue
                at = members(b, g.run, g.columns)
                own, held = b.some(at), stored[i][at] if stored is not None else None
                node = g.tree.walk(own.codes) if g.tree.column else np.zeros(own.n, np.int64)
                place = np.full(len(g.tree.column) + 1, -1)
                place[g.frontier if g.frontier != [-1] else [0]] = np.arange(len(g.frontier))
                node = np.where(drawn(own.key, g.p, len(g.trees)), place[node], -1)
                grad = g.gradient(_predicted(g, min(stored_trees, len(g.trees)), own, held), own.y)
                sums, counts = histograms(own.codes[g.used()], node, grad, len(g.frontier))
                m, f, c = np.nonzero(counts)
                if len(m):
                    nothing = np.zeros(len(m))
                    yield _sum_rows([np.full(len(m), i, np.int32), m.astype(np.int32), f.astype(np.int32), c.astype(np.int32), sums[m, f, c], counts[m, f, c], nothing, nothing, nothing])

        got = _pass(blocks, level)
        column = {c: got.column(c).to_numpy() for c in ("run", "node", "feature", "bin", "g", "n")}
        closed = []
        for i, g in enumerate(growths):
            if g.done:
                continue
            mine = column["run"] == i
            shape = (len(g.frontier), len(g.picked), BINS)
            sums, counts = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
            at = tuple(column[c][mine] for c in ("node", "feature", "bin"))
            sums[at], counts[at] = column["g"][mine], column["n"][mine]
            g.feed(sums, counts)
            if not g.frontier:
                g.close()
                closed.append(i)
        stopping = [i for i in closed if growths[i].p.early_stopping and growths[i].run.held]
        if stopping:

            sent = {i: growths[i].light(stored_trees) for i in stopping}

            def error(row, stored_trees=stored_trees, sent=sent, width=len(growths)):
                b = _block(row)
                stored = np.frombuffer(row["pred"]).reshape(width, -1) if row["pred"] else None
                for i, g in sent.items():
                    at = members(b, g.run, g.columns, held=True)
                    own = b.some(at)
                    pred = _predicted(g, min(stored_trees, len(g.trees)), own, stored[i][at] if stored is not None else None)
                    yield _one(i, ERROR, n=own.n, e=math.fsum((pred - own.y) ** 2))

            for r in _pass(blocks, error).to_pylist():
                growths[r["run"]].stopped_by(r["e"], r["n"])
        least = min((len(g.trees) for g in growths if not g.done), default=0)
        if least - since >= refresh:
            blocks, since = _written(blocks, growths, since, least), least
    return [g.forest() for g in growths]


def _written(blocks: DataFrame, growths: list[Growth], since: int, to: int) -> DataFrame:
    """The blocks with the values of each run's first `to` trees, written down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _block(row)
                stored = np.frombuffer(row["pred"]).reshape(len(growths), -1) if row["pred"] else None
                new = np.empty((len(growths), b.n))
                for i, g in enumerate(growths):
                    new[i] = stored[i] if stored is not None else g.base
                    for t in g.trees[since:to]:
                        new[i] += np.array(t.value)[t.walk(b.codes)]
                row["pred"] = new.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([row["n"]], pa.int32()), *[pa.array([row[c]], pa.binary()) for c in ("codes", "y", "part", "key", "pred")]], names=["n", "codes", "y", "part", "key", "pred"])

    return checkpoint(blocks.mapInArrow(run, BLOCK_SCHEMA))
