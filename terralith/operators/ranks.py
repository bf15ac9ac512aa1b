"""Ranks and running counts that no single task has to sort: values go to buckets cut at their quantiles, buckets are summed, and only a bucket is ordered at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

BUCKETS = 1024


def before(df: DataFrame, group: list[str], value: str, n: str | None = None, ties: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """Adds `before`: the sum of n (or the number of rows) that come earlier in the group by (value, ties). Values must not be NULL.

    The cuts are approximate quantiles of each group's values, so that outliers leave the buckets even; what is
    counted within and before a bucket is exact. The cuts are written down: computed again from parts that arrive in another order they
    may differ, and rows would be counted in one bucket and placed in another.
    """
    count = F.col(n) if n else F.lit(1)
    v = F.col(value).cast("double")
    cuts = checkpoint(df.groupBy(*group).agg(F.percentile_approx(v, [k / buckets for k in range(1, buckets)], 16 * buckets).alias("_cuts")))  # one row for each group
    spread = df.join(cuts, group) if group else df.crossJoin(F.broadcast(cuts))
    steps = F.array(*[F.lit(1 << b) for b in range(buckets.bit_length() - 1, -1, -1)])
    bucket = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(F.col("_cuts"), at + step - 1) <= v, at + step).otherwise(at))  # cuts not above the value
    rows = spread.withColumn("_b", bucket).withColumn("_n", count.cast("long")).drop("_cuts")
    sums = rows.groupBy(*group, "_b").agg(F.sum("_n").alias("_s"))
    over = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # `buckets` rows at most
    base = sums.select(*group, "_b", F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*group, "_b").orderBy(value, *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_in", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(base, [*group, "_b"])
    return out.withColumn("before", F.col("_base") + F.col("_in")).drop("_b", "_n", "_in", "_base")


def even_parts(df: DataFrame, value: str, parts: int, ties: tuple[str, ...] = (), name: str = "fold") -> DataFrame:
    """Adds a part from 1 on: rows in the order of (value, ties), cut so that sizes differ by one at most, larger parts first."""
    total = df.agg(F.count("*").alias("_total"))  # one row
    ranked = before(df, [], value, ties=ties).crossJoin(F.broadcast(total))
    small = F.floor(F.col("_total") / parts).cast("long")
    more = F.col("_total") % parts
    edge = more * (small + 1)
    r = F.col("before")
    part = F.when(r < edge, F.floor(r / (small + 1))).otherwise(more + F.floor((r - edge) / F.greatest(small, F.lit(1)))) + 1
    return ranked.withColumn(name, part.cast("int")).drop("before", "_total")
