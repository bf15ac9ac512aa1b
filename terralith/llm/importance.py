"""Target-distribution importance resampling over hashed word runs.

Features are all runs of 1 to `orders` consecutive words; a feature's bucket is the CRC-32 of its words joined by one space,
modulo `buckets`. No run is ever written out. A CRC is linear over GF(2): appending n bytes to a text maps its CRC by a fixed
32 x 32 bit matrix, the n-th power of the one of a zero byte, and adds the CRC of what is appended. Each different word's CRC is
computed once a batch; a run's is its shorter run's, shifted by the length of a space and the next word, plus the CRC of these.

Work: a pass over each side counts buckets (an array a task, `buckets` sums in all, which is what the driver and the tasks
of the next pass get); a second pass over the corpus weighs each document by the gains of its buckets. What is written down is a
row of numbers a document. Drawing is by Gumbel-perturbed scores: those that can be among the drawn are put in order by ranges
of (score, id), and a row's place is the number of rows in the ranges before its own and its place there.

Cases: a null text, and one without words, has no features and weight 0. A null id is hashed as an empty one and comes after the
others in ties. Repeated rows are documents of their own; rows of equal score and id are told apart by their features and then by
place. Very long texts are batches of their own. An empty table gives an empty table; an empty target gives
gains by its prior alone. Columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, partitions, slices

BUCKETS, ORDERS = 10_000, 3
#: Documents of fewer words are never drawn; the share drawn of the others, in percent.
LEAST_WORDS, PERCENT = 20, 5
#: Lower case of word bytes (digits, ASCII letters, all beyond ASCII), 0 for the others.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320

Matrix = tuple[int, ...]


def apply(matrix: Matrix, vector: int) -> int:
    """The product over GF(2): the sum of the columns that the vector's bits pick."""
    out = 0
    for column in matrix:
        if vector & 1:
            out ^= column
        vector >>= 1
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(apply(a, column) for column in b)


@lru_cache(maxsize=64)
def _power_of_two(k: int) -> Matrix:
    """What 2^k zero bits after a text do to its CRC."""
    if k == 0:
        return (POLYNOMIAL, *(1 << b for b in range(31)))
    half = _power_of_two(k - 1)
    return product(half, half)


@lru_cache(maxsize=4096)
def shift_tables(n: int) -> np.ndarray:
    """What n zero bytes after a text do to its CRC: 4 x 256 numbers, one for each value of each byte, to be added."""
    matrix: Matrix = tuple(1 << b for b in range(32))
    for k in range(n.bit_length()):
        if n >> k & 1:
            matrix = product(_power_of_two(k + 3), matrix)
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte, 1 << bit : 2 << bit] = out[byte, : 1 << bit] ^ np.uint32(matrix[8 * byte + bit])
    return out


def shifted(tables: np.ndarray, which: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """CRCs after as many zero bytes as the table of each one says."""
    flat, base = tables.reshape(-1), which * 1024
    out = flat[base + (crc & 255)]
    for byte in (1, 2, 3):
        out ^= flat[base + 256 * byte + (crc >> np.uint32(8 * byte) & 255)]
    return out


def words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Bounds of each text in the word sequence, the number of each word in the list of different words, and that list."""
    n = len(text)
    bounds = np.frombuffer(text.buffers()[1], np.int32, n + 1 + text.offset)[text.offset :].astype(np.int64)
    raw = np.frombuffer(text.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    low = _LOWER[raw]
    full = low != 0
    starts = full.copy()
    starts[1:] &= ~full[:-1]
    heads = bounds[:-1][bounds[:-1] < len(raw)]
    starts[heads] = full[heads]  # a word never goes on from one text into the next
    at = np.flatnonzero(starts)
    kept = low[full]
    offsets = np.r_[np.cumsum(full)[at] - 1, len(kept)].astype(np.int64) if len(at) else np.zeros(1, np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
    return np.searchsorted(at, bounds), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def run_crcs(bounds: np.ndarray, word: np.ndarray, known: list[bytes], orders: int = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1 to `orders` words: where the runs start in the word sequence, and their CRCs."""
    own = np.fromiter((zlib.crc32(w) for w in known), np.uint32, len(known))
    lengths, which = np.unique(np.fromiter(map(len, known), np.int64, len(known)), return_inverse=True)
    with_space = np.stack([shift_tables(int(n) + 1) for n in lengths]) if len(known) else np.zeros((1, 4, 256), np.uint32)
    alone = np.stack([shift_tables(int(n)) for n in lengths]) if len(known) else with_space
    after_space = shifted(alone, which, np.full(len(known), zlib.crc32(b" "), np.uint32)) ^ own if len(known) else own
    at, crc = np.arange(len(word)), own[word]
    ends = np.repeat(bounds[1:], np.diff(bounds))
    for k in range(orders):
        if k:
            goes_on = at + k < ends[at]
            at, crc = at[goes_on], crc[goes_on]
            following = word[at + k]
            crc = shifted(with_space, which[following], crc) ^ after_space[following]
        yield at, crc


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[bytes]]]:
    for batch in slices(batches, "text", 2 << 20):
        yield batch, *words(batch.column(batch.schema.get_field_index("text")).fill_null(""))


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, orders: int = ORDERS) -> np.ndarray:
    """How many features of all texts are in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, bounds, word, known in _texts(batches):
            for _, crc in run_crcs(bounds, word, known, orders):
                total += np.bincount(crc % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in found.collect():  # one for each bucket at most
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed share in the target to that in the corpus."""
    s, t = corpus.astype(float), target.astype(float)
    n = len(corpus)
    return np.floor(1000 * np.log((t + 1) * (float(corpus.sum()) + n) / ((s + 1) * (float(target.sum()) + n)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", orders: int = ORDERS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds, word, known in _texts(batches):
            weight, n = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for at, crc in run_crcs(bounds, word, known, orders):
                sums = np.r_[0, np.cumsum(gain[crc % buckets])]
                to = np.searchsorted(at, bounds)
                weight += np.diff(sums[to])
                n += np.diff(to)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """The rows with `rank`: 1 to `most` by score, largest first, ties by doc_id; null beyond and where `drawable` is false.

    The rows must be written down (a checkpoint), so that they are the same each time. Only those that an approximate quantile
    leaves in reach are put in order; should it leave too few, all are.
    """
    spark = rows.sparkSession
    if not most:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    able = rows.filter("drawable")
    n, low = able.agg(F.count("*"), F.percentile_approx("score", F.lit(max(0.0, 1 - 1.1 * PERCENT / 100)), F.lit(1000))).first()
    reach = F.col("drawable") & (F.col("score") >= F.lit(low if low is not None else 0))
    if rows.filter(reach).count() < most:
        reach = F.col("drawable")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("line")]
    lined = rows.filter(reach).withColumn("line", F.monotonically_increasing_id())
    placed = checkpoint(lined.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("line", F.monotonically_increasing_id()))
    part, place = F.shiftright("line", 33), F.col("line").bitwiseAND((1 << 33) - 1)
    before, so_far = {}, 0
    for row in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # one for each partition
        before[row["part"]] = so_far
        so_far += row["n"]
    starts = F.broadcast(spark.createDataFrame(list(before.items()) or [(0, 0)], "part long, before long"))  # as many rows
    rank = F.col("before") + F.col("place") + 1
    first = placed.withColumns({"part": part, "place": place}).join(starts, "part").select(*rows.columns, F.when(rank <= most, rank).alias("rank"))
    return first.unionByName(rows.filter(~F.coalesce(reach, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", seed: int = 42, least_words: int = LEAST_WORDS, percent: int = PERCENT, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; ranks 1, 2, 3... are those drawn."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    weighed = weigh(docs, gain, id_col, text_col).withColumns({"score": F.col("weight") + gumbel.cast("long"), "drawable": F.col("n_words") >= least_words})
    rows = checkpoint(weighed)
    most = percent * rows.filter("drawable").count() // 100
    return ranked(rows, most).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
