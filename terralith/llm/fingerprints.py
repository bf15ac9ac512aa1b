"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's shingles of five words.
Sketches of parts merge into the sketch of the whole, and estimate resemblance (Jaccard), containment and the
number of distinct shingles. Where a text has no more than k shingles, all of these are exact.

Cases: a null text counts as empty. A text of one to four words has one shingle, all its words; an empty one
has an empty sketch; very long texts are sketched whole. Two empty sketches are alike (1), an empty and a full one are
not (0). Equal texts have equal sketches, repeated rows equal rows. Ids may be any long; null ids come last and stay
null. A single document is its own next one; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, cut_points, piece_of, sortable, unused, words_of

K = 128
#: Neighbour search: rows of one range of ids (there are common.MOST_PIECES ranges at most; the table of their tops is broadcast), and the characters of a tie that ranges tell apart.
RANGE_ROWS, TIE_CHARS = 512, 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, width: int = SHINGLE_WORDS) -> Column:
    """array<long>: the hash of each word shingle, with repeats."""
    hashes = F.transform(words_of(text), lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        n = F.size(h)
        rolling = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))
        return F.when(n >= width, rolling).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(hashes, of)


def sketch(text: Column, k: int = K, width: int = SHINGLE_WORDS) -> Column:
    return F.slice(F.array_sort(F.array_distinct(shingle_hashes(text, width))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts taken together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets: the share of the merged sketch that both have."""

    def of(u: Column) -> Column:
        common = F.size(F.array_intersect(F.array_intersect(u, a), b))
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(common / F.greatest(F.size(u), F.lit(1)))

    return let(merge(a, b, k), of)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash's place in the hash range."""
    last = F.get(a, F.lit(k - 1)).cast("double")
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / ((last + 2.0**63) / 2.0**64))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's distinct shingles that b has too; 1 for an empty a."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / F.greatest(distinct_shingles(a, k), F.lit(1.0))))


def as_text(a: Column) -> Column:
    """A sketch as hexadecimal digits, 16 for each hash."""
    return F.concat_ws("", F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")))


def merge_groups(parts: DataFrame, key: str, column: str = "sketch", k: int = K, fan_in: int = 256) -> DataFrame:
    """One sketch for each key. A sketch's hashes are ranked by a salted pre-selection first, so that no task meets all parts of a large key."""
    rows = parts.select(key, F.explode(column).alias("h")).distinct().withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(fan_in)))
    some = rows.withColumn("r", F.row_number().over(Window.partitionBy(key, "salt").orderBy("h"))).filter(F.col("r") <= k)
    merged = some.groupBy(key).agg(F.slice(F.array_sort(F.collect_list("h")), 1, k).alias(column))  # fan_in * k hashes at most
    return parts.select(key).distinct().join(merged, key, "left").withColumn(column, F.coalesce(column, F.array().cast("array<bigint>")))


def with_next(docs: DataFrame, carried: list[str], *, id_col: str = "doc_id", tie: str = "text", prefix: str = "next_", enrich: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Adds the carried columns of the next row by descending id (after the last: the first), ties by descending `tie`, null ids last.

    enrich adds columns to the rows before they are carried; it is applied once, after the range tops are picked.

    Rows are cut into even ranges of (id, tie) that are sorted apart. The top of each range is added to the range
    above it, so that one shuffle of the rows is enough and no task sees more than a range.
    """
    key, range_, ghost, up = unused(docs, "_key", "_range", "_ghost", "_up")
    at = F.concat(sortable(F.col(id_col).cast("long")), F.hex(F.encode(F.substring(F.coalesce(F.col(tie), F.lit("")), 1, TIE_CHARS), "UTF-8")))
    cuts = cut_points(docs, at, -(-docs.count() // RANGE_ROWS))
    rows = docs.withColumn(key, at).withColumn(range_, piece_of(F.col(key), cuts))
    tops = docs.select(at.alias(key)).groupBy(piece_of(F.col(key), cuts).alias(range_)).agg(F.max(key).alias(key))
    order = Window.orderBy(F.col(range_).asc())  # over one row for each range: common.MOST_PIECES at most
    above = tops.select(key, F.coalesce(F.lead(range_).over(order), F.first(range_).over(order)).alias(up))
    ghosts = rows.join(F.broadcast(above), key).withColumn(range_, F.col(up)).drop(up)
    every = enrich(rows.withColumn(ghost, F.lit(0)).unionByName(ghosts.withColumn(ghost, F.lit(1))))
    w = Window.partitionBy(range_).orderBy(F.col(ghost), F.col(id_col).desc_nulls_last(), F.col(tie).desc())
    for c in carried:
        every = every.withColumn(prefix + c, F.lead(c).over(w))
    return every.filter(F.col(ghost) == 0).drop(key, range_, ghost)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id, text (empty for null), sketch."""
    return slim(docs, id_col, text_col).withColumn("sketch", sketch(F.col("text"), k))


def slim(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def compare_with_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """The contract's columns: each text, its edited text, and how alike their fingerprints and the next document's are."""
    rows = with_next(slim(docs), ["text", "sketch"], enrich=lambda df: df.withColumn("sketch", sketch(F.col("text"), k)))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), k)).withColumn("edited_sha256", F.sha2("edited", 256))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("distinct_shingles"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("contained_in_edited"),
    )
