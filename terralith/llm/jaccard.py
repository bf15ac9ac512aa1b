"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word shingles (five words). Equal texts are joined first, so that everything after works on
distinct texts. Min-hash values are cut into bands; texts that share a band are candidates. For these the
values are compared a few at a time, and a pair is dropped as soon as the posterior probability (uniform prior)
that its similarity reaches the threshold falls below a tolerance. The pairs that are left, and no others, are
verified exactly on their shingle sets.

The members of a band are cut into chunks, and a task meets two chunks at most, whatever the band's size. No pair
is ever a row: a block's surviving pairs travel as one packed row, a text's set goes once to each block that
has a surviving pair of it, and verification returns link counts and edges that span the block.

Equal texts are told by two 64-bit hashes and the length. Shingles are 64-bit hashes of their words.

Cases: a null or empty text has no shingle and no link, and is a class of its own. A text of one to four words
has one shingle, all its words; very long texts are compared whole. Rows that repeat id and text count as copies. A
null id is larger than any, and stays null. Empty tables give empty tables. Only the id and the text are read;
one_of_each returns all columns, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SIMILARITY, U64, checkpoint, give_back, mix, partitions, shingles, slices, unused, word_hashes
from .graph import components

HASHES, BANDS, BAND_ROWS, STEP = 128, 20, 3, 16
TOLERANCE = 1e-6
#: Texts of one chunk of a band's members, and shingles (with repeats) of one.
CHUNK, CHUNK_SHINGLES = 512, 1 << 20
_RNG = np.random.default_rng(20_240_229)
_XOR = _RNG.integers(0, 2**63, HASHES, dtype=np.int64).astype(U64)
_MULTIPLY = _RNG.integers(0, 2**63, HASHES, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def signatures(bounds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Min-hash values (rows x HASHES, 32 bits) of shingle sequences; rows without shingles stay at the maximum."""
    out = np.full((len(bounds) - 1, HASHES), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        starts = bounds[:-1][full]
        with np.errstate(over="ignore"):
            for k in range(HASHES):
                out[full, k] = (np.minimum.reduceat((hashes ^ _XOR[k]) * _MULTIPLY[k], starts) >> U64(32)).astype(np.uint32)
    return out


def least_matches(threshold: float = SIMILARITY, tolerance: float = TOLERANCE) -> np.ndarray:
    """For n compared values: the fewest matches at which P(similarity >= threshold) is not below the tolerance."""
    out = np.zeros(HASHES + 1, dtype=np.int64)
    for n in range(1, HASHES + 1):
        total, m = 0.0, -1  # the posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum
        while total < tolerance and m < n:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def prune(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Indices of the pairs that survive the incremental comparison."""
    alive, same = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for at in range(0, HASHES, STEP):
        same = same + (sig[a[alive], at : at + STEP] == sig[b[alive], at : at + STEP]).sum(axis=1)
        kept = same >= least[at + STEP]
        alive, same = alive[kept], same[kept]
        if not len(alive):
            break
    return alive


def band_keys(sig: np.ndarray) -> np.ndarray:
    """rows x BANDS: a 64-bit key of each band, different for each band."""
    with np.errstate(over="ignore"):
        out = np.empty((len(sig), BANDS), dtype=U64)
        for k in range(BANDS):
            h = np.full(len(sig), U64(k + 1))
            for v in sig[:, k * BAND_ROWS : (k + 1) * BAND_ROWS].T:
                h = mix(h * U64(0x9E3779B97F4A7C15) + v.astype(U64))
            out[:, k] = h
    return out


def spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a forest with the components of the given pairs."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := root.setdefault(x, x)) != x:
            root[x] = root.setdefault(p, p)
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows that come sorted by the keys, several groups at a time."""
    try:
        yield from _grouped(batches, keys)
    finally:
        give_back()


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    names = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        cols = [batch.column(names.index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        if held:
            last = held[-1]
            change[0] = any(last.column(names.index(k))[last.num_rows - 1].as_py() != c[0] for k, c in zip(keys, cols, strict=True))
        at = np.flatnonzero(change)
        if len(at):
            if held or at[-1]:
                yield pa.Table.from_batches([*held, batch.slice(0, int(at[-1]))])
            held = [batch.slice(int(at[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, dtype=bool)
    for k in keys:
        c = table.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.r_[0, np.flatnonzero(change), table.num_rows]


def pairs_in(chunk: np.ndarray, first: int, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one block: within a chunk, or across two."""
    if i == j:
        a, b = np.triu_indices(len(chunk), 1)
    else:
        x, y = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        a, b = np.repeat(x, len(y)), np.tile(y, len(x))
    return a + first, b + first


def text_keys(text: Column) -> list[Column]:
    """Two hashes of a text: `node`, its vertex in the graph, and `check`, which tells texts of one vertex apart."""
    return [F.xxhash64(text).alias("node"), F.xxhash64(F.lit(17), F.length(text), text).alias("check")]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), *text_keys(text), text.alias("text"))


def sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, node, check, size, sig): size is the number of shingles with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            sig_bounds, hashes = shingles(*word_hashes(batch.column(3)), SHINGLE_WORDS)
            sig = signatures(sig_bounds, hashes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(sig_bounds), pa.int64()), pa.array([r.tobytes() for r in sig], pa.binary())], names=["id", "node", "check", "size", "sig"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "id long, node long, check long, size long, sig binary")


def distinct_texts(signed: DataFrame) -> DataFrame:
    """(vertex, node, check, least, copies, size, sig) of each different text. Where texts share a node, their vertices come from both hashes."""
    texts = checkpoint(signed.groupBy("node", "check").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.max("size").alias("size"), F.first("sig").alias("sig")))
    shared = texts.groupBy("node").agg(F.count("*").alias("_n")).filter("_n > 1")
    if not shared.limit(1).count():
        return texts.withColumn("vertex", F.col("node"))
    return checkpoint(texts.join(shared, "node", "left").withColumn("vertex", F.when(F.col("_n").isNull(), F.col("node")).otherwise(F.xxhash64("node", "check"))).drop("_n"))


BLOCK = "key long, bi int, bj int"


def candidates(texts: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(key, bi, bj, vertices, pairs): the pairs of texts that share a band and survive the pruning, one row for each block of two chunks; pairs are packed places in vertices."""
    least = least_matches(threshold, tolerance)

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint32).reshape(-1, HASHES)
            keys = band_keys(sig)
            node, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, BANDS)), pa.array(np.repeat(size, BANDS)), pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(node)))], names=["vertex", "size", "key", "band"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["key", "bi", "bj"]):
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, HASHES)
            keys = band_keys(sig)
            vertex, band, chunk, key, bi, bj = (table.column(c).to_numpy() for c in ("vertex", "band", "chunk", "key", "bi", "bj"))
            bounds = group_bounds(table, ["key", "bi", "bj"])
            left: list[tuple[np.ndarray, np.ndarray]] = []
            some: list[tuple[np.ndarray, np.ndarray]] = []
            held = 0
            for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                some.append(pairs_in(chunk[first:last], first, bi[first], bj[first]))
                held += len(some[-1][0])
                if held > 50_000 or last == bounds[-1]:
                    a, b = (np.concatenate(x) for x in zip(*some, strict=True))
                    some, held = [], 0
                    for at in range(0, len(a), 50_000):
                        x, y = a[at : at + 50_000], b[at : at + 50_000]
                        owned = (keys[x] == keys[y]).argmax(axis=1) == band[x]  # a pair counts in the first band it shares
                        x, y = x[owned], y[owned]
                        kept = prune(sig, x, y, least)
                        left.append((x[kept], y[kept]))
            if not left:
                continue
            a, b = (np.concatenate(x) for x in zip(*left, strict=True))
            block = np.searchsorted(bounds, a, side="right") - 1
            cut = np.searchsorted(block, np.arange(len(bounds)))
            rows = []
            for k in np.unique(block).tolist():
                at, pair = np.unique(np.c_[a[cut[k] : cut[k + 1]], b[cut[k] : cut[k + 1]]], return_inverse=True)
                f = bounds[k]
                rows.append((int(key[f]), int(bi[f]), int(bj[f]), vertex[at].tolist(), pair.astype("<u2").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["key", "bi", "bj", "vertices", "pairs"])

    banded = texts.select("vertex", "size", "sig").mapInArrow(bands, "vertex long, size long, key long, band int")
    shared = banded.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).filter("n > 1")
    members = banded.drop("size").join(shared, "key").join(texts.select("vertex", "sig"), "vertex")
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / CHUNK), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int")
    dealt = members.withColumn("_n", chunks).withColumn("chunk", F.pmod(F.xxhash64(F.lit(11), "vertex"), F.col("_n")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("bi", F.least("chunk", "_o")).withColumn("bj", F.greatest("chunk", "_o"))
    dealt = dealt.select("key", "bi", "bj", "vertex", "band", "chunk", "sig").repartition(partitions(texts.sparkSession), "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return dealt.mapInArrow(compare, f"{BLOCK}, vertices array<long>, pairs binary")


def common_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs of sorted sets."""
    if len(a) <= 32:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = df > 1
    column, owner = (np.cumsum(often) - 1)[column][often[column]], owner[often[column]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out, wide = np.zeros((len(sets), len(sets)), dtype=np.float32), 2048
    for at in range(0, int(often.sum()), wide):
        lo, hi = np.searchsorted(column, [at, at + wide])
        x = np.zeros((len(sets), wide), dtype=np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        out += x @ x.T
    return np.rint(out[a, b]).astype(np.int64)


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(vertex, copies, set): each text's distinct shingle hashes in order, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            to, hashes = shingles(*word_hashes(batch.column(2)), SHINGLE_WORDS)
            sets = [np.unique(hashes[x:y]).tobytes() for x, y in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["vertex", "copies", "set"])

    return texts.select("vertex", "copies", "text").mapInArrow(run, "vertex long, copies long, set binary")


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Exact links among the candidate pairs: edges (a, b) that span them, and rows (a, null, documents, texts) that count a's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["key", "bi", "bj"]):
            vertex, copies = (table.column(c).to_numpy() for c in ("vertex", "copies"))
            data = table.column("data").to_pylist()
            bounds = group_bounds(table, ["key", "bi", "bj"])
            rows: list[tuple] = []
            for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                a, b = np.frombuffer(data[first], "<u2").astype(np.int64).reshape(-1, 2).T  # the block's pairs come first
                sets = [np.frombuffer(x, U64) for x in data[first + 1 : last]]
                size = np.array([len(s) for s in sets])
                near = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
                a, b = a[near], b[near]
                if not len(a):
                    continue
                both = common_counts(sets, a, b)
                linked = both >= threshold * (size[a] + size[b] - both) - 1e-9
                a, b = a[linked], b[linked]
                own, many = vertex[first + 1 : last], copies[first + 1 : last]
                texts = np.bincount(np.r_[a, b], minlength=len(own))
                documents = np.bincount(np.r_[a, b], weights=np.r_[many[b], many[a]], minlength=len(own))
                rows += [(int(own[k]), None, int(documents[k]), int(texts[k])) for k in np.flatnonzero(texts)]
                rows += [(x, y, 0, 0) for x, y in spanning(own[a], own[b])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b", "documents", "texts"])

    block = ["key", "bi", "bj"]
    members = pairs.select(*block, F.posexplode("vertices").alias("at", "vertex")).join(sets, "vertex").select(*block, "at", "vertex", "copies", F.col("set").alias("data"))
    heads = pairs.select(*block, F.lit(-1).alias("at"), F.lit(0).cast("long").alias("vertex"), F.lit(0).cast("long").alias("copies"), F.col("pairs").alias("data"))
    dealt = members.unionByName(heads).repartition(partitions(pairs.sparkSession), *block).sortWithinPartitions(*block, "at")
    return dealt.mapInArrow(run, "a long, b long, documents long, texts long")


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each document: doc_id, class_id (the smallest id linked to it by any chain), copy_of (the smallest id of the same text), n_links (documents of similarity >= threshold, copies too), n_text_links (different texts), text_hash, and stays: true for the rows of one document of each class."""
    texts = distinct_texts(sign(docs, id_col, text_col))
    full = texts.filter("size > 0")
    pairs = checkpoint(candidates(full, threshold, tolerance))
    # one row for each distinct text that is in a pair: among copies, a row of the smallest id
    asked = pairs.select(F.explode("vertices").alias("vertex")).distinct().join(full.select("vertex", "node", "check", "least", "copies"), "vertex")
    own = keyed(docs, id_col, text_col)
    same = (own["node"] == asked["node"]) & (own["check"] == asked["check"]) & own["id"].eqNullSafe(asked["least"])
    with_text = own.join(asked, same).select("vertex", "copies", "text").dropDuplicates(["vertex"])
    found = checkpoint(verify(pairs, shingle_sets(with_text), threshold))
    final = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "vertex")
    links = found.filter("b is null").groupBy(F.col("a").alias("vertex")).agg(F.sum("documents").alias("documents"), F.sum("texts").alias("texts"))
    placed = full.select("vertex", "node", "check", "least", "copies").join(final, "vertex", "left").join(links, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    # null ids come last
    classes = placed.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "vertex")).alias("first"))
    known = placed.join(classes, "root").select(
        "node", "check", F.col("first.least").alias("class_id"), F.col("least").alias("copy_of"), (F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_text_links"), (F.col("first.vertex") == F.col("vertex")).alias("leads"),
    )
    out = own.select("id", "node", "check").join(known, ["node", "check"], "left")
    alone = F.col("leads").isNull()  # a text without words
    return out.select(
        F.col("id").alias("doc_id"),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"),
        F.col("node").alias("text_hash"),
        F.col("check").alias("text_check"),
        (alone | (F.col("leads") & F.col("id").eqNullSafe(F.col("class_id")))).alias("stays"),
    )


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay when each class keeps one document, that of the smallest id; of rows that repeat id and text one stays."""
    own, node, check = names = unused(docs, "_id", "_node", "_check")
    joined = jaccard_join(docs, id_col=id_col, text_col=text_col, **options)
    stays = joined.filter("stays").select(F.col("doc_id").alias("stay_id"), F.col("text_hash").alias("stay_node"), F.col("text_check").alias("stay_check")).distinct()
    hashes = text_keys(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select("*", F.col(id_col).cast("long").alias(own), *[h.alias(n) for h, n in zip(hashes, (node, check), strict=True)])
    same = rows[own].eqNullSafe(stays["stay_id"]) & (rows[node] == stays["stay_node"]) & (rows[check] == stays["stay_check"])
    return rows.join(stays, same, "left_semi").dropDuplicates(names).drop(*names)
