"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents, in an order given by a hash, form one sequence of words that is cut into blocks. A
source's target gives the exact number of draws, its quota; the last draw takes only the words that the target
still asks for. A binary tree over the output shards splits the vector of quotas: at each node the left half's
share of every source is one multivariate-hypergeometric draw, seeded by the node's place, so that any worker can
walk any path of the tree alone. The tree gives each shard its own range of each source's draws, and a draw's block
is its place under a keyed permutation of the source's blocks: ranges are disjoint, and a block comes again only
after the whole source was drawn. Within a shard the pieces are ordered by a hash.

Blocks are long (BLOCK_WORDS), so that few documents are cut: those at the edge of a drawn and an undrawn block.

Cases: a null or empty text has size 0 and is never drawn; a very long text spans many blocks. A null source is a
source of its own, the last. A source without words has target 0. Repeated rows each hold their own words; null ids
stay null. An empty table gives an empty table. Only the named columns are read; assemble returns all columns,
whatever their names. Sources are metadata: their table, one row each, goes to the driver and is refused beyond
MOST_SOURCES.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, checkpoint, mix as mix64, words_of

SHARE, MOST_REPEATS = 1.5, 2.0
WEIGHTS = (3.0, 1.0, 2.0)
BLOCK_WORDS, MOST_BLOCKS = 2048, 1 << 28
SHARD_BLOCKS = 64
MOST_SOURCES = 100_000
BUCKET_ROWS, MOST_BUCKETS = 512, 65_536
SEED = 20_240_501


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST_REPEATS) -> list[float]:
    """Words for each source: the total by weight; what exceeds `most` times a source's size goes to the others by weight, until none exceeds it."""
    total, capped = share * sum(sizes), [False] * len(sizes)
    while True:
        rest = total - sum(most * s for s, c in zip(sizes, capped, strict=True) if c)
        open_w = sum(w for w, c in zip(weights, capped, strict=True) if not c)
        out = [most * s if c else rest * w / open_w for s, w, c in zip(sizes, weights, capped, strict=True)]
        over = [not c and t > most * s for t, s, c in zip(out, sizes, capped, strict=True)]
        if not any(over):
            return out
        capped = [c or o for c, o in zip(capped, over, strict=True)]


def permuted(block: np.ndarray, blocks: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of the numbers below `blocks`: four Feistel rounds, walked on while the result lies beyond."""
    half = np.array([max(1, (int(n - 1).bit_length() + 1) // 2) for n in np.unique(blocks)], dtype=U64)[np.unique(blocks, return_inverse=True)[1]]
    out, todo = block.astype(U64), np.arange(len(block))
    while len(todo):
        h, k = half[todo], key[todo].astype(U64)
        low, x = (U64(1) << h) - U64(1), out[todo]
        left, right = x >> h, x & low
        for turn in range(4):
            left, right = right, left ^ (mix64(right ^ mix64(k + U64(turn + 1))) & low)
        out[todo] = left << h | right
        todo = todo[out[todo] >= blocks[todo].astype(U64)]
    return out.astype(np.int64)


@dataclass
class Plan:
    """What the draw depends on: for each source its size, target, block length, number of blocks, quota, key, and the words that its last draw takes."""

    names: list[str | None]
    sizes: list[int]
    target: list[float]
    block: list[int]
    blocks: list[int]
    quota: list[int]
    last: list[int]
    key: list[int]
    shards: int
    seed: int

    def node(self, depth: int, index: int, left: int, counts: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng([self.seed, depth, index])
        return rng.multivariate_hypergeometric(counts, left, method="marginals")

    def shard_of(self, source: np.ndarray, draw: np.ndarray) -> np.ndarray:
        """The shard that owns each draw of a source; walks only the paths that the given draws take."""
        out = np.zeros(len(source), dtype=np.int64)

        def walk(depth: int, index: int, shards: int, counts: np.ndarray, rows: np.ndarray, draw: np.ndarray) -> None:
            if not len(rows):
                return
            if shards == 1:
                out[rows] = index
                return
            left = self.node(depth, index, int(counts.sum()) // 2, counts)
            goes = draw < left[source[rows]]
            walk(depth + 1, 2 * index, shards // 2, left, rows[goes], draw[goes])
            walk(depth + 1, 2 * index + 1, shards // 2, counts - left, rows[~goes], draw[~goes] - left[source[rows[~goes]]])

        walk(0, 0, self.shards, np.array(self.quota, dtype=np.int64), np.arange(len(source)), draw)
        return out


def quota_of(size: int, block: int, words: int, place: int) -> tuple[int, int]:
    """Draws that take so many words, and the words of the last one. `place` is the turn, within each pass, of the source's last and shorter block."""
    if not words:
        return 0, 0
    blocks = -(-size // block)
    passes, rest = divmod(words, size)
    lacking = blocks * block - size

    def before(turn: int) -> int:
        return turn * block - (lacking if turn > place else 0)

    turn = min(rest // block, blocks)
    while before(turn) < rest:
        turn += 1
    if rest == 0:
        return passes * blocks, block if place != blocks - 1 else block - lacking
    return passes * blocks + turn, rest - before(turn - 1)


def plan_of(names: list, sizes: list[int], weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, seed: int = SEED) -> Plan:
    each = [weights[i % len(weights)] for i in range(len(sizes))]
    target = targets(sizes, each, share, most)
    floor = -(-sum(sizes) // MOST_BLOCKS)
    block = [max(1, min(max(floor, BLOCK_WORDS), s)) for s in sizes]
    blocks = [-(-s // b) for s, b in zip(sizes, block, strict=True)]
    key = [int(k) for k in np.random.default_rng(seed).integers(0, 2**62, len(sizes))]
    quota, last = [], []
    for s, b, n, t, k in zip(sizes, block, blocks, target, key, strict=True):
        place = int(permuted(np.array([n - 1]), np.array([n]), np.array([k]))[0]) if n else 0
        q, w = quota_of(s, b, min(round(t), math.floor(most * s)), place)
        quota.append(q)
        last.append(w)
    shards = 1 << max(0, math.ceil(math.log2(max(1, sum(quota) / SHARD_BLOCKS))))
    return Plan(names, sizes, target, block, blocks, quota, last, key, shards, seed)


def sized(docs: DataFrame, *, id_col: str, text_col: str, source_col: str, seed: int, carried: list[str]) -> DataFrame:
    key = F.xxhash64(F.lit(seed), F.col(id_col))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.size(words_of(F.col(text_col).cast("string"))).cast("long").alias("size"),
        key.alias("_key"),
        *[F.col(c).alias(f"_c_{c}") for c in carried],
    )


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carried: tuple[str, ...] = (), weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """Each row with its size, source_size, target and pieces: array of (shard, place, epoch, first word, words), plus the carried columns as _c_*."""
    slim = checkpoint(sized(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, carried=[]))
    found = slim.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    plan = plan_of([r["source"] for r in found], [int(r["size"]) for r in found], weights, share, most, seed)
    buckets = max(16, min(MOST_BUCKETS, sum(r["n"] for r in found) // BUCKET_ROWS))

    bucket = F.pmod(F.col("_key"), F.lit(buckets))
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("_source")  # null is a source too
    rows = sized(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, carried=list(carried)) if carried else slim
    rows = rows.select("*", bucket.alias("_bucket"), name)
    sums = slim.groupBy(name, bucket.alias("_bucket")).agg(F.sum("size").alias("_words"))
    ahead = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row for each bucket
    first = sums.select("_source", "_bucket", F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_first"))
    inner = Window.partitionBy("_source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_within", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(first, ["_source", "_bucket"])
    placed = placed.withColumn("_start", F.col("_first") + F.col("_within")).drop("_first", "_within", "_key", "_bucket", "_source")

    piece = pa.struct([(c, pa.int64()) for c in ("shard", "place", "epoch", "first", "words")])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan  # goes with the task: MOST_SOURCES entries at most
        index = {n: i for i, n in enumerate(p.names)}
        sizes, block, blocks, quota, last, key = (np.array(x, dtype=np.int64) for x in (p.sizes, p.block, p.blocks, p.quota, p.last, p.key))
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            s = np.array([index[x] for x in column["source"].to_pylist()], dtype=np.int64)
            start, size = (column[c].to_numpy(zero_copy_only=False) for c in ("_start", "size"))
            b0, b1 = start // block[s], (start + size - 1) // block[s]
            count = np.where(size > 0, b1 - b0 + 1, 0)
            row = np.repeat(np.arange(len(s)), count)
            b = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + b0[row]
            sr = s[row]
            turns = permuted(b, blocks[sr], key[sr])
            times = np.maximum(0, -(-(quota[sr] - turns) // np.maximum(blocks[sr], 1)))
            rep = np.repeat(np.arange(len(row)), times)
            epoch = np.arange(len(rep)) - np.repeat(np.cumsum(times) - times, times)
            turn = epoch * blocks[sr[rep]] + turns[rep]
            # the last draw of a source takes only the first words of its block
            lo = np.maximum(start[row], b * block[sr])[rep]
            upto = b[rep] * block[sr[rep]] + np.where(turn == quota[sr[rep]] - 1, last[sr[rep]], block[sr[rep]])
            words = np.minimum((start[row] + size[row])[rep], upto) - lo
            some = np.flatnonzero(words > 0)
            rep, epoch, turn, lo, words = rep[some], epoch[some], turn[some], lo[some], words[some]
            shard = p.shard_of(sr[rep], turn)
            with np.errstate(over="ignore"):
                place = (mix64((turn + 1).astype(U64) ^ mix64(sr[rep].astype(U64) + U64(p.seed))) >> U64(1)).astype(np.int64)
            cut = np.searchsorted(row[rep], np.arange(len(s) + 1))
            pieces = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in (shard, place, epoch, lo - start[row[rep]], words)], fields=list(piece)))
            kept = [n for n in batch.schema.names if n != "_start"]
            yield pa.RecordBatch.from_arrays([*(column[n] for n in kept), pa.array(sizes[s]), pa.array(np.array(p.target, dtype=float)[s]), pieces], names=[*kept, "source_size", "target", "pieces"])

    schema = placed.drop("_start").selectExpr("*", "cast(0 as long) source_size", "cast(0 as double) target", "cast(null as array<struct<shard: bigint, place: bigint, epoch: bigint, first: bigint, words: bigint>>) pieces").schema
    return placed.mapInArrow(draw, schema)


def digest(mixed: DataFrame) -> DataFrame:
    """The contract's columns: the pieces become the number of words taken; then the words that each shard takes, as shard:place:words in the mix's order."""
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda acc, x: acc + x["words"])
    placed = F.array_join(F.transform(F.array_sort("pieces"), lambda x: F.concat_ws(":", x["shard"], x["place"], x["words"])), " ")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), placed.alias("placed"))


def assemble(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself, in the columns of docs, with `shard`: one row for each document and epoch, its taken words in order.

    A document that is taken whole keeps its text as it is; of others, each run of taken words is kept, joined by
    single spaces, and runs are joined by line ends. n_chars, where present, follows the text. Rows lie by shard,
    in the shard's shuffled order.
    """
    names = docs.columns
    mixed = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, carried=tuple(names), **options)
    runs = F.expr("transform(array_sort(array_distinct(transform(pieces, p -> p.epoch))), e -> struct(e as epoch, filter(pieces, p -> p.epoch = e) as own))")
    rows = mixed.withColumn("_run", F.explode(runs)).withColumn("_own", F.expr("array_sort(transform(_run.own, p -> struct(p.first, p.words, p.shard, p.place)))"))
    words = words_of(F.col(f"_c_{text_col}"))
    whole = F.expr("aggregate(_own, 0L, (a, p) -> a + p.words)") == F.col("size")
    # a piece that begins where the one before ends belongs to its run
    cut = F.array_join(F.transform("_own", lambda p, i: F.concat(F.when(i == 0, F.lit("")).when(p["first"] == F.get(F.col("_own"), i - 1)["first"] + F.get(F.col("_own"), i - 1)["words"], F.lit(" ")).otherwise(F.lit("\n")), F.array_join(F.slice(F.col("_words"), (p["first"] + 1).cast("int"), p["words"].cast("int")), " "))), "")
    rows = rows.withColumn("_words", F.when(whole, F.array().cast("array<string>")).otherwise(words))
    rows = rows.withColumn("_text", F.when(whole, F.col(f"_c_{text_col}")).otherwise(cut))
    out = []
    for c in names:
        if c == text_col:
            out.append(F.col("_text").alias(c))
        elif c == "n_chars":
            out.append(F.length("_text").cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"_c_{c}").alias(c))
    shard, place = F.col("_own")[0]["shard"], F.col("_own")[0]["place"]
    spread = F.pmod(shard * 64 + F.pmod(place, F.lit(64)), F.lit(1 << 40))  # a shard's rows may go to 64 tasks; place orders them
    return rows.select(*out, shard.alias("shard"), place.alias("place"), spread.alias("_spread")).repartition("_spread").sortWithinPartitions("shard", "place").drop("_spread")
