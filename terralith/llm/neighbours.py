"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search on it.

The graph holds DEGREE neighbours of each distinct vector. It starts from blocks of vectors on the same sides of
random hyperplanes and improves by rounds: a node's new and old neighbours, and those that list it, are
compared with each other, and each keeps its best. Rounds are joins: nodes are dealt to homes (a few thousand
nodes each); a home learns which vectors its nodes' comparisons need and gets each once. Proposals are merged
within a task before they travel, so that a task sends a node DEGREE of them at most.

Queries walk the graph greedily from their own node: the best nodes of a query's pool that were not yet
expanded give their neighbours, whose inner products are computed, until no better node is met. Each walk ends by
itself, when every node of its pool is expanded; only the others go on.

Vectors of different length are lifted by one component to equal length for the graph (the usual reduction of
inner product search); scores are inner products of the original vectors in double precision.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose
number of components is not the table's most frequent one, nor null ids. Rows that repeat an id count once (the
smallest vector). Equal vectors are one node; ties go to the smaller id, so only a node's smallest ids can
matter, k + 1 of them. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, checkpoint, mix, release

DEGREE, SAMPLE, ROUNDS, SETTLED = 48, 24, 10, 0.002
HOME_NODES, BLOCK, TREES = 6000, 256, 3
#: Bound of the sample that places the hyperplanes.
FIT_SAMPLE = 10_000
POOL, BEAM = 128, 64
#: Entry points of every walk besides its own node.
ENTRIES = 64
SEED = 5
STATE = "home int, id long, vec binary, ids binary, sims binary, fresh binary"
_STATE = pa.schema([("home", pa.int32()), ("id", pa.int64()), ("vec", pa.binary()), ("ids", pa.binary()), ("sims", pa.binary()), ("fresh", pa.binary())])
PROPOSED = "home int, target binary, other binary, sim binary"
_PROPOSED = pa.schema([("home", pa.int32()), ("target", pa.binary()), ("other", pa.binary()), ("sim", pa.binary())])


def between_rounds(df: DataFrame) -> DataFrame:
    """A checkpoint that also drops the size estimated for the plan behind it.

    A checkpoint hands that estimate on, and a cogroup multiplies those of its sides: after ten rounds it is a number
    of millions of digits, on which the driver spends minutes and hundreds of megabytes.
    """
    kept = checkpoint(df)
    spark = kept.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), spark)


def home_of(ids: np.ndarray, homes: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U64)) % U64(homes)).astype(np.int64)


def _lists(column: pa.ChunkedArray | pa.Array, dtype: str) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype) for b in column.to_pylist()]


def best(target: np.ndarray, other: np.ndarray, sim: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `keep` best different others of each target, ordered by target, then nearest first."""
    order = np.lexsort((other, target))
    target, other, sim = target[order], other[order], sim[order]
    once = np.r_[True, (target[1:] != target[:-1]) | (other[1:] != other[:-1])] if len(target) else np.zeros(0, bool)
    target, other, sim = target[once], other[once], sim[once]
    order = np.lexsort((-sim, target))  # stable: equal ones stay in the order of `other`
    target, other, sim = target[order], other[order], sim[order]
    first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, np.int64)
    rank = np.arange(len(target)) - np.repeat(first, np.diff(np.r_[first, len(target)]))
    top = rank < keep
    return target[top], other[top], sim[top]


def proposals(target: np.ndarray, other: np.ndarray, sim: np.ndarray, homes: int) -> pa.Table:
    target, other, sim = best(target, other, sim, DEGREE)
    home = home_of(target, homes)
    order = np.argsort(home, kind="stable")
    cut = np.searchsorted(home[order], np.arange(homes + 1))
    rows = [(h, target[r].tobytes(), other[r].tobytes(), sim[r].astype("<f4").tobytes()) for h in range(homes) if len(r := order[cut[h] : cut[h + 1]])]
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PROPOSED)], schema=_PROPOSED)


def usable(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): rows that take part, v as array<double>."""
    v = F.col(vec_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).select("n")
    return rows.join(F.broadcast(common), F.size("v") == F.col("n")).groupBy("vec_id").agg(F.min("v").alias("v"))  # common: one row


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(id, v, ids): each distinct vector with its smallest id and its k + 1 smallest ids, pre-selected under a salt."""
    salted = rows.withColumn("h", F.xxhash64("v")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    some = salted.withColumn("r", F.row_number().over(Window.partitionBy("h", "v", "salt").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    few = some.groupBy("h", "v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))  # 64 * (k + 1) ids at most
    return few.select(F.col("ids")[0].alias("id"), "v", "ids")


def as_bytes(nodes: DataFrame, homes: int, longest: float) -> DataFrame:
    """STATE without neighbours: the vector in single precision, lifted to equal length where lengths differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)
            x = np.array(b.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(len(ids), -1)
            lift = np.sqrt(np.maximum(0, longest**2 - (x * x).sum(axis=1)))
            x = np.c_[x, lift].astype("<f4")
            empty = [b""] * len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(home_of(ids, homes), pa.int32()), pa.array(ids), pa.array([r.tobytes() for r in x], pa.binary()), *(pa.array(empty, pa.binary()) for _ in range(3))], schema=_STATE)

    return nodes.select("id", "v").mapInArrow(run, STATE)


def first_proposals(state: DataFrame, count: int, homes: int) -> DataFrame:
    """Each vector's best within its block, for several sets of hyperplanes placed at the medians of a sample."""
    some = state.select("id", "vec").orderBy(F.xxhash64("id")).limit(FIT_SAMPLE).collect()  # bounded
    sample = np.stack([np.frombuffer(r["vec"], "<f4") for r in some])
    bits = int(np.clip(np.ceil(np.log2(max(1, count / BLOCK))), 0, 30))
    planes = np.random.default_rng(SEED).normal(size=(TREES, sample.shape[1], bits)).astype(np.float32)
    medians = np.stack([np.median(sample @ p, axis=0) if bits else np.zeros(0) for p in planes])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack(_lists(b.column(1), "<f4"))
                for t in range(TREES):
                    side = (x @ planes[t] > medians[t]).astype(np.int64) @ (1 << np.arange(bits)) if bits else np.zeros(len(x), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(side * TREES + t, pa.int64()), b.column(0), b.column(1)], names=["leaf", "id", "vec"])

    def compare(table: pa.Table) -> pa.Table:
        ids, x = table.column("id").to_numpy(), np.stack(_lists(table.column("vec"), "<f4"))
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        keep = min(DEGREE, len(ids) - 1)
        near = np.argpartition(-s, max(keep - 1, 0), axis=1)[:, :keep]
        return proposals(np.repeat(ids, keep), ids[near].reshape(-1), np.take_along_axis(s, near, axis=1).reshape(-1), homes)

    dealt = state.select("id", "vec").mapInArrow(deal, "leaf long, id long, vec binary")
    sizes = dealt.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    blocks = dealt.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")))
    return blocks.groupBy("leaf", "block").applyInArrow(compare, PROPOSED)


def merge(state: DataFrame, proposed: DataFrame) -> DataFrame:
    """The state with each node's best of its neighbours and the proposals; new ones are fresh."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _STATE.empty_table()
        ids, old, sims, fresh = left.column("id").to_numpy(), _lists(left.column("ids"), "<i8"), _lists(left.column("sims"), "<f4"), _lists(left.column("fresh"), "u1")
        count = [len(o) for o in old]
        t0, o0, s0 = np.repeat(ids, count), np.concatenate(old), np.concatenate(sims).astype(np.float64)
        more = [np.concatenate(x) if (x := _lists(right.column(c), d)) else np.zeros(0, d) for c, d in (("target", "<i8"), ("other", "<i8"), ("sim", "<f4"))]
        # known neighbours come first among equals, so that they do not turn fresh again
        target, other, sim = best(np.r_[t0, more[0]], np.r_[o0, more[1]], np.r_[s0, more[2].astype(np.float64)], DEGREE)
        known = np.rec.fromarrays([t0, o0])
        now = np.rec.fromarrays([target, other])
        order = np.argsort(known)
        at = np.minimum(np.searchsorted(known[order], now), max(0, len(known) - 1))
        is_old = known[order][at] == now if len(known) else np.zeros(len(now), bool)
        flags = np.ones(len(now), dtype="u1")
        if len(known):
            flags[is_old] = np.concatenate(fresh)[order][at[is_old]]
        cut_lo, cut_hi = np.searchsorted(target, ids, "left"), np.searchsorted(target, ids, "right")
        pick = lambda x, d: pa.array([x[a:b].astype(d).tobytes() for a, b in zip(cut_lo, cut_hi, strict=True)], pa.binary())
        return pa.table([left.column("home"), left.column("id"), left.column("vec"), pick(other, "<i8"), pick(sim, "<f4"), pick(flags, "u1")], schema=_STATE)

    return state.groupBy("home").cogroup(proposed.groupBy("home")).applyInArrow(run, STATE)


def _priority(a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(a.view(U64) + U64(turn * 2 + 1)) ^ (b.view(U64) * U64(0x9E3779B97F4A7C15)))


def _first(group: np.ndarray, priority: np.ndarray, keep: int) -> np.ndarray:
    """Indices of the `keep` rows of smallest priority of each group."""
    order = np.lexsort((priority, group))
    g = group[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
    return order[rank < keep]


def sampled(ids: np.ndarray, lists: list[np.ndarray], fresh: list[np.ndarray], turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, neighbour, freshness of the sampled edges of a batch, and their places in the joined lists."""
    count = [len(x) for x in lists]
    owner, other = np.repeat(ids, count), np.concatenate(lists)
    flag = np.concatenate(fresh)
    p = _priority(owner, other, turn)
    picked = np.concatenate([at[_first(owner[at], p[at], SAMPLE)] for at in (np.flatnonzero(flag == 1), np.flatnonzero(flag == 0))])
    return owner[picked], other[picked], flag[picked], picked


def local_joins(state: DataFrame, homes: int, turn: int) -> DataFrame:
    """One round: proposals from comparing each node's sampled neighbours, in both directions."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            u, w, flag, _ = sampled(b.column("id").to_numpy(zero_copy_only=False), _lists(b.column("ids"), "<i8"), _lists(b.column("fresh"), "u1"), turn)
            back = np.concatenate([at[_first(w[at], _priority(w[at], u[at], turn), SAMPLE)] for at in (np.flatnonzero(flag == 1), np.flatnonzero(flag == 0))])
            owner, other, kind = np.r_[u, w[back]], np.r_[w, u[back]], np.r_[flag, flag[back] + 2]
            home = home_of(owner, homes)
            rows = []
            for h in np.unique(home):
                r = np.flatnonzero(home == h)
                rows.append((int(h), owner[r].tobytes(), other[r].tobytes(), kind[r].astype("u1").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["home", "owner", "other", "kind"])

    def edges_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner, other, kind = (np.concatenate(_lists(table.column(c), d)) for c, d in (("owner", "<i8"), ("other", "<i8"), ("kind", "u1")))
        p = _priority(owner, other, turn)
        kept = [np.flatnonzero(kind < 2)] + [at[_first(owner[at], p[at], SAMPLE)] for at in (np.flatnonzero(kind == 3), np.flatnonzero(kind == 2))]
        kept = np.concatenate(kept)
        return owner[kept], other[kept], kind[kept] & 1

    def needs(table: pa.Table) -> pa.Table:
        return requests(edges_of(table)[1], table.column("home")[0].as_py(), homes)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _PROPOSED.empty_table()
        owner, other, new = edges_of(left)
        ids, vec, worst = received(right)
        at = np.searchsorted(ids, other)
        by = np.lexsort((-new.astype(np.int8), owner))
        owner, at, new = owner[by], at[by], new[by]
        cut = np.r_[np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]), len(owner)]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held, out = 0, []
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            fresh = np.unique(at[lo:hi][new[lo:hi] == 1])
            if not len(fresh):
                continue
            old = np.setdiff1d(at[lo:hi][new[lo:hi] == 0], fresh)
            c = np.r_[fresh, old]
            s = vec[fresh] @ vec[c].T
            for mine, theirs, ok in ((fresh, c, s > worst[fresh][:, None]), (c, fresh, (s > worst[c][None, :]).T)):
                i, j = np.nonzero(ok)
                x, y = mine[i], theirs[j]
                real = x != y
                found.append((x[real], y[real], (s[i, j] if mine is fresh else s.T[i, j])[real]))
                held += len(found[-1][0])
            if held > 2_000_000:
                out.append(best(*(np.concatenate(z) for z in zip(*found, strict=True)), DEGREE))
                found, held = [], 0
        if found:
            out.append(best(*(np.concatenate(z) for z in zip(*found, strict=True)), DEGREE))
        if not out:
            return _PROPOSED.empty_table()
        x, y, s = (np.concatenate(z) for z in zip(*out, strict=True))
        return proposals(ids[x], ids[y], s, homes)

    sent = state.select("id", "ids", "fresh").mapInArrow(send, "home int, owner binary, other binary, kind binary")
    wanted = sent.groupBy("home").applyInArrow(needs, REQUEST)
    vectors = wanted.groupBy("home").cogroup(state.groupBy("home")).applyInArrow(give_vectors, REPLY)
    return sent.groupBy("home").cogroup(vectors.groupBy("home")).applyInArrow(join, PROPOSED)


REQUEST = "home int, asker int, ids binary"
_REQUEST = pa.schema([("home", pa.int32()), ("asker", pa.int32()), ("ids", pa.binary())])
REPLY = "home int, ids binary, counts binary, data binary, worst binary"
_REPLY = pa.schema([("home", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("data", pa.binary()), ("worst", pa.binary())])


def requests(ids: np.ndarray, asker: int, homes: int) -> pa.Table:
    """What a home asks the others for: one row for each of them, with the ids."""
    ids = np.unique(ids)
    at = home_of(ids, homes)
    order = np.argsort(at, kind="stable")
    cut = np.searchsorted(at[order], np.arange(homes + 1))
    rows = [(h, asker, ids[r].tobytes()) for h in range(homes) if len(r := order[cut[h] : cut[h + 1]])]
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_REQUEST)], schema=_REQUEST)


def _picked(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    known = right.column("id").to_numpy()
    order = np.argsort(known)
    for asker, raw in zip(left.column("asker").to_pylist(), left.column("ids").to_pylist(), strict=True):
        ids = np.frombuffer(raw, "<i8")
        yield asker, ids, order[np.searchsorted(known[order], ids)]


def give_vectors(left: pa.Table, right: pa.Table) -> pa.Table:
    """Answers requests with vectors, and with the similarity that a proposal to each must exceed."""
    if not left.num_rows:
        return _REPLY.empty_table()
    vec = np.stack(_lists(right.column("vec"), "<f4"))
    worst = np.array([s[-1] if len(s) == DEGREE else -np.inf for s in _lists(right.column("sims"), "<f4")], dtype="<f4")
    rows = [(asker, ids.tobytes(), b"", vec[at].tobytes(), worst[at].tobytes()) for asker, ids, at in _picked(left, right)]
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_REPLY)], schema=_REPLY)


def give_lists(left: pa.Table, right: pa.Table) -> pa.Table:
    """Answers requests with neighbour lists."""
    if not left.num_rows:
        return _REPLY.empty_table()
    lists = right.column("ids").to_pylist()
    rows = []
    for asker, ids, at in _picked(left, right):
        some = [lists[i] for i in at.tolist()]
        rows.append((asker, ids.tobytes(), np.array([len(x) // 8 for x in some], dtype="<u4").tobytes(), b"".join(some), b""))
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_REPLY)], schema=_REPLY)


def received(replies: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, their vectors and thresholds."""
    ids = np.concatenate(_lists(replies.column("ids"), "<i8"))
    vec = np.concatenate(_lists(replies.column("data"), "<f4")).reshape(len(ids), -1)
    worst = np.concatenate(_lists(replies.column("worst"), "<f4"))
    ids, at = np.unique(ids, return_index=True)
    return ids, vec[at], worst[at]


def settle(state: DataFrame, turn: int) -> DataFrame:
    """Marks the edges that a round has used as no longer fresh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists, fresh = _lists(b.column("ids"), "<i8"), _lists(b.column("fresh"), "u1")
            *_, picked = sampled(b.column("id").to_numpy(zero_copy_only=False), lists, fresh, turn)
            flat = np.concatenate(fresh).copy()
            flat[picked] = 0
            cut = np.split(flat, np.cumsum([len(x) for x in lists])[:-1])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([c.tobytes() for c in cut], pa.binary())], schema=_STATE)

    return state.mapInArrow(run, STATE)


def to_unit(nodes: DataFrame, top: float) -> tuple[DataFrame, float]:
    """The vectors times a power of two that brings the largest component, `top`, below 1, and the length of the longest.

    The graph and the walks work in single precision, where products of very long or very short vectors would be infinite or 0. No digit
    is lost but of components 1e38 times smaller than the largest.
    """
    e = -math.frexp(top)[1]
    first, rest = math.ldexp(1.0, e // 2), math.ldexp(1.0, e - e // 2)  # either is finite where their product may not be
    scaled = nodes.withColumn("v", F.transform("v", lambda x: x * F.lit(first) * F.lit(rest)))
    return scaled, float(scaled.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0])


def build(nodes: DataFrame, count: int, longest: float) -> tuple[DataFrame, int]:
    """The neighbour graph (STATE) of distinct vectors (id, v)."""
    homes = max(1, -(-count // HOME_NODES))
    start = between_rounds(as_bytes(nodes, homes, longest))
    state = between_rounds(merge(start, first_proposals(start, count, homes)))
    for turn in range(ROUNDS):
        state = between_rounds(merge(settle(state, turn), local_joins(state, homes, turn)))
        fresh = state.agg(F.sum(F.length(F.replace(F.hex("fresh"), F.lit("00"), F.lit(""))) / 2)).first()[0] or 0
        release(state.sparkSession)
        if fresh < SETTLED * count * DEGREE:
            break
    return state, homes


def longest_nodes(state: DataFrame) -> list[int]:
    """ENTRIES nodes of the longest original vectors (the least lift), ties by a hash: large inner products end there."""

    def lift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([float(v[-1]) for v in _lists(b.column(1), "<f4")], pa.float32())], names=["id", "lift"])

    found = state.select("id", "vec").mapInArrow(lift, "id long, lift float").orderBy(F.round("lift", 3), F.xxhash64("id")).limit(ENTRIES).collect()
    return [r["id"] for r in found]


def search(state: DataFrame, queries: DataFrame, homes: int) -> DataFrame:
    """Greedy walks: (query, ids) with the POOL nearest nodes met from the query's own node and the entry points on."""
    entries = np.array(sorted(longest_nodes(state)), dtype="<i8")
    pool = "home int, query long, vec binary, ids binary, sims binary, done binary, open int"
    names = [x.split()[0] for x in pool.split(", ")]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The walk begins at the query's own node. The lift belongs to the nodes: a query's is 0, so that products are those of the original vectors."""
        for b in batches:
            if b.num_rows:
                ids = b.column("id").to_numpy(zero_copy_only=False)
                vec = np.stack(_lists(b.column("vec"), "<f4"))
                vec[:, -1] = 0
                vec = np.ldexp(vec, -np.frexp(np.abs(vec).max(axis=1, keepdims=True))[1])  # short queries keep their digits; the order of their products stays
                cells = lambda x: pa.array(x, pa.binary())
                seeds = [np.r_[i, entries[entries != i]].astype("<i8") for i in ids]
                unseen = [np.full(len(x), -np.inf, "<f4").tobytes() for x in seeds]
                yield pa.RecordBatch.from_arrays([b.column("home"), b.column("id"), cells([v.tobytes() for v in vec]), cells([x.tobytes() for x in seeds]), cells(unseen), cells([bytes(len(x)) for x in seeds]), pa.array([1] * len(ids), pa.int32())], names=names)

    def frontier(done: np.ndarray) -> np.ndarray:
        return np.flatnonzero(done == 0)[: BEAM + 1]

    def asks(table: pa.Table) -> pa.Table:
        want = [i[frontier(d)] for i, d in zip(_lists(table.column("ids"), "<i8"), _lists(table.column("done"), "u1"), strict=True)]
        return requests(np.concatenate(want), table.column("home")[0].as_py(), homes)

    def reached(table: pa.Table) -> pa.Table:
        """The nodes that the frontier's neighbours add to a home's queries."""
        return requests(np.concatenate([entries, *_lists(table.column("data"), "<i8")]), table.column("home")[0].as_py(), homes)

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select(names)
        is_list = pc.equal(right.column("what"), 0)
        lists: dict[int, np.ndarray] = {}
        for ids, counts, data in zip(*(right.filter(is_list).column(c).to_pylist() for c in ("ids", "counts", "data")), strict=True):
            cut = np.cumsum(np.frombuffer(counts, "<u4").astype(np.int64))[:-1]
            lists.update(zip(np.frombuffer(ids, "<i8").tolist(), np.split(np.frombuffer(data, "<i8"), cut), strict=True))
        vectors = right.filter(pc.invert(is_list))
        vid, x, _ = received(vectors) if vectors.num_rows else (np.zeros(0, np.int64), None, None)
        out_i, out_s, out_d, out_c = [], [], [], []
        for query, vec, ids, sims, done in zip(left.column("query").to_pylist(), _lists(left.column("vec"), "<f4"), _lists(left.column("ids"), "<i8"), _lists(left.column("sims"), "<f4"), _lists(left.column("done"), "u1"), strict=True):
            go = frontier(done)
            met = np.unique(np.concatenate([lists[i] for i in ids[go].tolist()])) if len(go) else np.zeros(0, np.int64)
            seeds = ids[np.isneginf(sims) & (ids != query)]  # entry points have no score yet
            known = ~np.isneginf(sims) | (ids == query)
            met = np.union1d(np.setdiff1d(met, np.r_[ids, query]), seeds)
            done = done.copy()
            done[go] = 1
            s = x[np.searchsorted(vid, met)] @ vec if len(met) else np.zeros(0, np.float32)
            ids, sims, done = np.r_[ids[known], met], np.r_[sims[known], s], np.r_[done[known], np.isin(met, seeds).astype("u1")]
            top = np.lexsort((ids, -sims))[:POOL]
            out_c.append(int((done[top] == 0).any()))
            out_i.append(ids[top].tobytes())
            out_s.append(sims[top].astype("<f4").tobytes())
            out_d.append(done[top].astype("u1").tobytes())
        return pa.table([left.column("home"), left.column("query"), left.column("vec"), *(pa.array(c, pa.binary()) for c in (out_i, out_s, out_d)), pa.array(out_c, pa.int32())], names=names)

    now = between_rounds(state.join(queries, "id", "left_semi").mapInArrow(start, pool))
    ended = []
    while True:  # pools only improve, and each walk expands a node at least
        near = now.groupBy("home").applyInArrow(asks, REQUEST).groupBy("home").cogroup(state.groupBy("home")).applyInArrow(give_lists, REPLY)
        wanted = near.groupBy("home").applyInArrow(reached, REQUEST)
        vectors = wanted.groupBy("home").cogroup(state.groupBy("home")).applyInArrow(give_vectors, REPLY)
        given = near.withColumn("what", F.lit(0)).unionByName(vectors.withColumn("what", F.lit(1)))
        now = between_rounds(now.groupBy("home").cogroup(given.groupBy("home")).applyInArrow(step, pool))
        ended.append(now.filter("open = 0").select("query", "ids"))
        now = now.filter("open = 1")
        release(state.sparkSession)
        if not now.limit(1).count():
            break
    return reduce(DataFrame.unionByName, ended)


def nearest(table: DataFrame, is_query: Column, *, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row with is_query (a condition on vec_id), its k nearest other rows found."""
    rows = usable(table, id_col, vec_col)
    nodes = checkpoint(distinct_vectors(rows, k))
    size = nodes.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
    asked = rows.filter(is_query).withColumnRenamed("vec_id", "query_id")
    found_schema = "query_id long, rank int, vec_id long, score double"
    if not size["n"]:
        return table.sparkSession.createDataFrame([], found_schema)
    # queries by node: equal vectors walk once
    by_node = asked.join(nodes.select("v", "id"), "v").select("query_id", "id")
    scaled, longest = to_unit(nodes, float(size["top"]))
    state, homes = build(scaled, size["n"], longest)
    pools = search(state, by_node.select("id").distinct(), homes)

    def open_pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lists = [np.union1d(x, q) for q, x in zip(b.column(0).to_pylist(), _lists(b.column(1), "<i8"), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(x) for x in lists]), pa.int64()), pa.array(np.concatenate(lists), pa.int64())], names=["id", "node"])

    pairs = pools.mapInArrow(open_pool, "id long, node long")  # POOL + 1 rows for each walked node, itself included
    full = nodes.select("id", F.col("v").alias("qv"))
    other = nodes.select(F.col("id").alias("node"), F.col("v").alias("ov"), "ids")
    dot = F.aggregate(F.zip_with("qv", "ov", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = pairs.join(full, "id").join(other, "node").select("id", "ids", dot.alias("score"))
    ranked = by_node.join(scored, "id").select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
