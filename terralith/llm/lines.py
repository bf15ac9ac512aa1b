"""Line de-duplication: a suffix array over line-id sequences by distributed prefix doubling.

A line's id is a 64-bit hash of its text without outer white space; blank lines are no part of the sequences.
Lines that occur once end every repeat, so only lines that repeat are sorted; what follows a repeated line, if
not repeated itself, is a terminator of its own. Ranks are places in the suffix array: step k orders suffixes by
2^k lines, and splits each group of equal rank by the rank 2^k lines on. A group of two or more suffixes at step
k is an interval of the array whose longest common prefix is 2^k or more. Ranks within a group come from sums
over sub-ranges of the second key, so that a line in a third of all documents loads no single task.

An interval of at least min_lines marks a repeated run: its first member in the order of (doc_id, line) stays,
and the lines of every later member are deleted. An interval of a single line does so too if the line has at least
min_chars characters, so that boilerplate lines go, but not the short lines that texts share by chance. Overlapping
marks join to the maximal runs. Intervals are found at powers of two lines; a longer common prefix in between has all
its lines marked by the overlapping intervals below it.

Cases: a null text has no lines and stays null. Rows that repeat id and text are one document and are treated
alike; rows that repeat an id only are told apart by their text. A null id counts as the largest id, and as another
one than any. Very long texts are cut whole. Empty tables give empty tables. Further columns are carried along,
whatever their names; those with the names that are added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, partitions, release, slices, unused

#: A repeated run counts from so many lines on, a single line from so many characters on.
MIN_LINES, MIN_CHARS = 2, 60
NO_ID = 2**63 - 1
#: Sub-ranges of a second key within a group, and buckets of the first order.
SUBRANGES, BUCKETS = 256, 4096
OUTER = " \t\x0b\x0c\r"


def document_keys(id_col: str, text: Column) -> tuple[Column, Column]:
    """The id, and a hash that tells documents of one id apart, and those without an id from those of the largest."""
    key = F.col(id_col).cast("long")
    return F.coalesce(key, F.lit(NO_ID)), F.when(key.isNull(), F.xxhash64(text, F.lit(1))).otherwise(F.xxhash64(text))


def line_table(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, th, line, h, wide): one row for each line that is not blank, numbered within its document; wide tells lines of min_chars and more."""
    text = F.col(text_col).cast("string")
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(OUTER))), lambda x: x != "")
    hashes = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) >= min_chars).alias("wide")))
    key, th = document_keys(id_col, text)
    keyed = docs.select(key.alias("id"), th.alias("th"), hashes.alias("hs"))
    return keyed.select("id", "th", F.posexplode("hs").alias("line", "x")).select("id", "th", "line", "x.h", "x.wide")


def _running(counts: DataFrame, group: list[str], order: str, sub: Column) -> DataFrame:
    """Adds `before`: the sum of n over smaller `order` within the group, by way of sub-ranges."""
    parts = counts.withColumn("_sub", sub)
    sums = parts.groupBy(*group, "_sub").agg(F.sum("n").alias("_n"))
    # one row for each sub-range of a group; without a group, over the BUCKETS of the whole table
    ahead = Window.partitionBy(*group).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*group, "_sub", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*group, "_sub").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_in", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(base, [*group, "_sub"]).withColumn("before", F.col("_base") + F.col("_in")).drop("_sub", "_in", "_base")


def first_ranks(lines: DataFrame) -> DataFrame:
    """(id, th, line, rank, n, first, wide) of the lines whose id repeats: rank counts the lines of smaller id, n those of the same, first is the first of these."""
    counts = lines.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "line")).alias("first")).filter("n > 1")
    bucket = F.shiftright("h", 52) + 2048
    ranks = _running(counts, [], "h", bucket).select("h", F.col("before").alias("rank"), "n", "first")
    return lines.join(ranks, "h").select("id", "th", "line", "rank", "n", "first", "wide")


def double(ranked: DataFrame, step: int, total: int) -> DataFrame:
    """The ranks by 2 * step lines, from those by step lines."""
    live = ranked.filter("n > 1")
    later = ranked.select("id", "th", (F.col("line") - step).alias("line"), F.col("rank").alias("second"))
    # what ends here has a terminator of its own: a negative key from a hash of its place, before all ranks
    ends = F.lit(-1) - F.shiftrightunsigned(F.xxhash64("id", "th", "line"), 2)
    keyed = live.drop("n", "first").join(later, ["id", "th", "line"], "left").withColumn("second", F.coalesce("second", ends))
    counts = keyed.groupBy("rank", "second").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "line")).alias("first"))
    wide = max(1, -(-total // SUBRANGES))
    sub = F.when(F.col("second") < 0, F.shiftright("second", 54)).otherwise(F.floor(F.col("second") / wide).cast("long"))
    new = _running(counts, ["rank"], "second", sub).select("rank", "second", (F.col("rank") + F.col("before")).alias("new"), "n", "first")
    moved = keyed.join(new, ["rank", "second"]).select("id", "th", "line", F.col("new").alias("rank"), "n", "first")
    return ranked.filter("n <= 1").unionByName(moved).coalesce(partitions(ranked.sparkSession))


def later_members(ranked: DataFrame, length: int) -> DataFrame:
    """(id, th, line, length) of all but the first member of each interval, for suffixes ranked by `length` lines."""
    return ranked.filter((F.col("n") > 1) & (F.struct("id", "th", "line") > F.col("first"))).select("id", "th", "line", F.lit(length).alias("length"))


def combined(ranked: DataFrame, step: int, length: int) -> DataFrame:
    """Ranks for `length` lines, step < length < 2 * step: by the first and the last `step` lines of them. Only equality counts."""
    later = ranked.filter("n > 1").select("id", "th", (F.col("line") - (length - step)).alias("line"), F.col("rank").alias("second"))
    keyed = ranked.filter("n > 1").drop("n", "first").join(later, ["id", "th", "line"])
    groups = keyed.groupBy("rank", "second").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "line")).alias("first"))
    return keyed.join(groups.filter("n > 1"), ["rank", "second"]).select("id", "th", "line", "rank", "n", "first")


def repeated_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """The suffix array of all repeating suffixes (id, th, line, rank, n), and the later copies (id, th, line, length).

    length is the deepest interval that a later copy lies in: one line, min_lines or a power of two.
    """
    # rows that repeat a document are taken once
    lines = line_table(docs, id_col, text_col, min_chars).dropDuplicates(["id", "th", "line"])
    ranked = checkpoint(first_ranks(lines))
    total, step = ranked.count(), 1
    found = [later_members(ranked if min_lines == 1 else ranked.filter("wide"), 1)]
    ranked = ranked.drop("wide")
    while True:
        if step < min_lines < 2 * step:
            found.append(later_members(combined(ranked, step, min_lines), min_lines))
        ranked = checkpoint(double(ranked, step, total))
        step *= 2
        if step >= min_lines:
            found.append(later_members(ranked, step))
        release(ranked.sparkSession)
        if not ranked.filter("n > 1").limit(1).count():
            break
    marks = found[0]
    for more in found[1:]:
        marks = marks.unionByName(more)
    return ranked, marks.groupBy("id", "th", "line").agg(F.max("length").alias("length"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the later copies of repeated line runs deleted from the text, and n_lines, n_lines_removed, n_runs, longest_run (lines of the longest deleted run) added."""
    _, marks = repeated_runs(docs, id_col=id_col, text_col=text_col, min_lines=min_lines, min_chars=min_chars)
    added = ["n_lines", "n_lines_removed", "n_runs", "longest_run"]
    base = docs.drop(*added)
    own_id, own_th, own_marks = unused(base, "_id", "_th", "_marks")
    own = marks.groupBy(F.col("id").alias(own_id), F.col("th").alias(own_th)).agg(F.collect_list(F.struct("line", "length")).alias(own_marks))  # a document's own lines
    key, th = document_keys(id_col, F.col(text_col).cast("string"))
    joined = base.select("*", key.alias(own_id), th.alias(own_th)).join(own, [own_id, own_th], "left").select(*base.columns, own_marks)
    at = base.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts, more = [], []
            for text, marks in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                all_lines = text.split("\n") if text is not None else []
                full = [i for i, x in enumerate(all_lines) if x.strip(OUTER)]
                steps = np.zeros(len(full) + 1, dtype=np.int64)
                for m in marks or ():
                    steps[m["line"]] += 1
                    steps[min(m["line"] + m["length"], len(full))] -= 1
                gone = np.cumsum(steps)[: len(full)] > 0
                edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
                drop = {full[i] for i in np.flatnonzero(gone)}
                texts.append(text if text is None or not drop else "\n".join(x for i, x in enumerate(all_lines) if i not in drop))
                more.append((len(full), len(drop), len(edge) // 2, int((edge[1::2] - edge[::2]).max(initial=0))))
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int32()) for c in zip(*more, strict=True))], names=[*batch.schema.names[:-1], *added])

    schema = base.withColumn(text_col, F.col(text_col).cast("string")).select("*", *[F.lit(0).alias(c) for c in added]).schema
    return joined.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(cut, schema)


def digest(kept: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_lines_removed, n_runs and the checksum of the text left."""
    return kept.select("doc_id", "n_lines", "n_lines_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
