"""Running flux by port and day: the same plan over a batch table and over a stream.

The integration of whole ports over a stream is exact for any cut into batches and any order of rows: each batch leaves
its own totals by port and day (day_totals), which merge by sums, and integrate_totals makes the ports of what has been
left so far. No state is held between batches, and no row is ever too late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import FLUX_TO_ANNUAL, clip


def daily_flux(flux: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Count and clamped mean of each port and window; on a stream, rows later than `late` are dropped and closed windows are emitted once."""
    rows = flux.withWatermark("t", late) if flux.isStreaming else flux
    return rows.groupBy(F.window("t", width), "port").agg(F.count("*").alias("n"), F.avg(clip(F.col("flux"), -2.0, 50.0)).alias("mean_flux"))


def write_daily(flux: DataFrame, path: str, checkpoint: str):
    """Appends closed windows to a Parquet table; started with what is there now and ended after it."""
    out = daily_flux(flux).select(F.col("window.start").alias("start"), "port", "n", "mean_flux")
    return out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def day_totals(flux: DataFrame, keys: tuple[str, ...] = ("port",), *, low: float = -2.0, high: float = 50.0) -> DataFrame:
    """Count and sum of the clamped flux of each port and day. Rows without time, flux or port are left out; no rows give an empty table."""
    rows = flux.filter(F.col("t").isNotNull() & F.col("flux").isNotNull() & F.col(keys[-1]).isNotNull())
    return rows.groupBy(*keys, F.to_date("t").alias("day")).agg(F.count("*").alias("n"), F.sum(clip(F.col("flux"), low, high)).alias("total"))


def merged(totals: DataFrame, keys: tuple[str, ...] = ("port",)) -> DataFrame:
    """One row for each port and day of the totals of many batches; written anew, it takes the place of many small files."""
    return totals.groupBy(*keys, "day").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def integrate_totals(totals: DataFrame, keys: tuple[str, ...] = ("port",), *, least_days: int = 150, least_span: int = 180) -> DataFrame:
    """The annual rate of each port with enough days and span, from totals by port and day: the rows of operators.ingest.integrate_flux.

    Equal to it but for the rounding of sums; totals of one day may come in any number of parts."""
    days = merged(totals, keys)
    out = days.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.count("*").alias("n_days"),
        F.datediff(F.max("day"), F.min("day")).alias("span_days"),
        (F.sum("total") / F.sum("n")).alias("mean_flux"),
    )
    return out.filter((F.col("n_days") >= least_days) & (F.col("span_days") >= least_span)).withColumn("rs_annual", F.col("mean_flux") * F.lit(FLUX_TO_ANNUAL))


def write_totals(flux: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("port",)):
    """Leaves each batch's totals below path, in a folder of the batch's number: a batch that runs again after a failure replaces its own. Started with what is there now and ended after it."""

    def leave(batch: DataFrame, number: int) -> None:
        day_totals(batch, keys).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return flux.writeStream.foreachBatch(leave).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
