"""What the text operators share: words, hashes, bounded batches and checkpoints."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than ASCII white space, in Spark's and in Python's notation.
WORD_SEPARATOR = r"[\x20\x09-\x0D]+"
SHINGLE_WORDS = 5
SIMILARITY = 0.8
U64 = np.uint64
#: Odd multipliers of the rolling word hash and of the mixer (the latter are splitmix64's fixed values).
ROLL = 0x9E3779B97F4A7C55
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. Only where all is one process, as in tests, may it be unset."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="terralith-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder; reliable, so that lost executors lose nothing."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Between rounds: lets Spark's cleaner drop shuffle files and checkpoints that no table needs any more (it acts when the driver's garbage is collected)."""
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that no column of the table has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of a sample for each piece that it cuts, and pieces at most.
SAMPLED, MOST_PIECES = 4, 65_536


def sortable(number: Column) -> Column:
    """A long as 17 characters in the order of the numbers, null first."""
    return F.when(number.isNull(), F.lit("0" * 17)).otherwise(F.concat(F.lit("1"), F.lpad(F.hex(number.bitwiseXOR(F.lit(-(2**63)).cast("long"))), 16, "0")))


def cut_points(rows: DataFrame, key: Column, pieces: int) -> list[str]:
    """Keys (strings without a comma) that cut the rows in the order of the key into about so many even pieces, whatever its distribution.

    They come from a sample by hash of SAMPLED keys for each piece, MOST_PIECES pieces at most. Ties are not cut.
    """
    pieces = min(pieces, MOST_PIECES)
    if pieces < 2:
        return []
    keys = rows.select(key.alias("k"))
    n = keys.count()
    share = min(1.0, SAMPLED * pieces / max(1, n))
    # the number of the row in the scan spreads the sample over ties too; the sample only places the cuts
    some = keys.filter(F.pmod(F.xxhash64("k", F.monotonically_increasing_id()), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy("k").limit(2 * SAMPLED * MOST_PIECES).collect()
    return sorted({some[i * len(some) // pieces]["k"] for i in range(1, pieces)}) if some else []


def piece_of(key: Column, cuts: list[str]) -> Column:
    """How many of the sorted cuts are not above the key, by binary search in a constant array."""
    if not cuts:
        return F.lit(0)
    known, steps = F.split(F.lit(",".join(cuts)), ","), F.array(*[F.lit(1 << b) for b in range(len(cuts).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(known, at + step - 1) <= key, at + step).otherwise(at))


def words_of(text: Column) -> Column:
    """array<string>: the words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SEPARATOR), lambda w: w != "")


def give_back() -> None:
    """Returns freed memory to the system, so that a reused Python worker starts its next task small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, of about so many bytes of text each; a longer text comes alone, whole."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            text = batch.column(batch.schema.get_field_index(column))
            ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
                yield batch.slice(at, to - at)
                at = to
    finally:
        give_back()


def split_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of many texts: bounds of each text in the word sequence (n + 1), dictionary index of each word, dictionary."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    flat = lists.flatten()
    counts = np.diff(lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64))
    full = pc.greater(pc.binary_length(flat), 0)
    kept = full.to_numpy(zero_copy_only=False)
    if not kept.all():
        owner = np.repeat(np.arange(len(counts)), counts)[kept]
        counts = np.bincount(owner, minlength=len(counts))
        flat = flat.filter(full)
    coded = flat.dictionary_encode()
    bounds = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=bounds[1:])
    return bounds, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each text and a 64-bit hash of each word."""
    bounds, at, words = split_words(text)
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()), dtype=U64, count=len(words))
    return bounds, each[at] if len(each) else np.zeros(0, dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(MIX_A)
        x = (x ^ (x >> U64(27))) * U64(MIX_B)
        return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=U64)
    with np.errstate(over="ignore"):
        out[1:] = U64(base & (2**64 - 1))
        np.multiply.accumulate(out, out=out)
    return out[:n]


_INVERSE = pow(ROLL, -1, 2**64)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of the words [i, i + width) for each i that allows it, over one sequence or many joined ones."""
    n = len(words)
    if n < width:
        return np.zeros(0, dtype=U64)
    out = np.empty(n - width + 1, dtype=U64)
    step = 1 << 20
    with np.errstate(over="ignore"):
        for at in range(0, n - width + 1, step):
            part = words[at : min(n, at + step + width - 1)]
            sums = np.zeros(len(part) + 1, dtype=U64)
            np.cumsum(part * _powers(ROLL, len(part)), out=sums[1:])
            m = len(part) - width + 1
            out[at : at + m] = (sums[width:] - sums[:m]) * _powers(_INVERSE, m)
    return mix(out)


def shingles(bounds: np.ndarray, words: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and hashes of each text's word shingles, with repeats. A text of fewer words has one, of all its words; an empty one none."""
    n = np.diff(bounds)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    to = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(count, out=to[1:])
    every = window_hashes(words, width)
    at = np.arange(to[-1]) + np.repeat(bounds[:-1] - to[:-1], count)
    out = every[np.minimum(at, max(len(every) - 1, 0))] if len(every) else np.zeros(to[-1], dtype=U64)
    for i in np.flatnonzero((n > 0) & (n < width)):
        out[to[i]] = xxhash.xxh3_64_intdigest(words[bounds[i] : bounds[i + 1]].tobytes(), seed=int(n[i]))
    return to, out
