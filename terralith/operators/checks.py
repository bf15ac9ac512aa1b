"""Data-quality gates: one aggregate row per artefact, turned into rows of (gate, name, pass, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats


def gate(df: DataFrame, name: str, measures: dict[str, Column], checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Aggregates once; each check is (condition on the measures, detail). Unknown conditions fail."""
    row = df.agg(*[c.alias(k) for k, c in measures.items()])
    entries = F.array(*[F.struct(F.lit(name).alias("gate"), F.lit(k).alias("name"), F.coalesce(c, F.lit(False)).alias("pass"), d.cast("string").alias("detail")) for k, (c, d) in checks.items()])
    return row.select(F.explode(entries).alias("_e")).select("_e.*")


def tally(checks: DataFrame) -> DataFrame:
    return checks.groupBy("gate").agg(F.count_if("pass").alias("n_pass"), F.count("*").alias("n"), F.bool_and("pass").alias("all_pass"))


def require(checks: DataFrame) -> None:
    """Raises with the names of failed checks (a few rows for each gate)."""
    failed = [f"{r['gate']}/{r['name']}: {r['detail']}" for r in checks.filter(~F.col("pass")).collect()]
    if failed:
        raise AssertionError("; ".join(failed))


def base_raster_gate(cells: DataFrame, width: int, height: int, value: str = "v", low: float = 0.0, high: float = 5.0) -> DataFrame:
    v = F.col(value)
    measures = {"n": F.count("*"), "finite": F.count(v), "w": F.max("col") + 1, "h": F.max("row") + 1, "lo": F.min(v), "hi": F.max(v), "mean": F.avg(v), "std": F.stddev_samp(v)}
    c = F.col
    return gate(cells, "base_raster", measures, {
        "has_rows": (c("n") > 0, c("n")),
        "has_values": (c("finite") > 0, c("finite")),
        "width": (c("w") == width, c("w")),
        "height": (c("h") == height, c("h")),
        "minimum": (c("lo") >= low, F.round(c("lo"), 4)),
        "maximum": (c("hi") <= high, F.round(c("hi"), 4)),
        "mean_in_range": (c("mean").between(low, high), F.round(c("mean"), 4)),
        "spread": (c("std") > 0.01, F.round(c("std"), 4)),
    })


def spot_checks(cells: DataFrame, spots: DataFrame, value: str = "v", reach: int = 10, least_share: float = 0.25) -> DataFrame:
    """(spot, mean, share, pass): the patch around each spot against its direction: below, above or between bounds."""
    near = (F.col("row").between(F.col("at_row") - reach, F.col("at_row") + reach)) & (F.col("col").between(F.col("at_col") - reach, F.col("at_col") + reach))
    patch = cells.join(F.broadcast(spots), near).groupBy("spot", "direction", "low", "high").agg(F.avg(value).alias("mean"), (F.count(value) / F.count("*")).alias("share"))  # spots: a handful of places
    m = F.col("mean")
    meets = F.when(F.col("direction") == "below", m < F.col("low")).when(F.col("direction") == "above", m > F.col("high")).otherwise(m.between(F.col("low"), F.col("high")))
    return patch.select("spot", "mean", "share", F.coalesce(meets & (F.col("share") >= least_share), F.lit(False)).alias("pass"))


def zoom_steps(sizes: DataFrame, low: float = 1.5, high: float = 8.0) -> DataFrame:
    """Growth from each zoom level to the next, and whether it is in bounds. One row for each level."""
    step = F.lead("bytes").over(Window.orderBy("zoom")) / F.col("bytes")
    return sizes.withColumn("step", step).withColumn("ok", F.coalesce(F.col("step").between(low, high), F.lit(True)))


def quantile_distance(a: DataFrame, b: DataFrame, value: str, at: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Largest difference of the quantiles of two tables."""
    names = {f"_{k}": x for k, x in enumerate(at)}
    q = lambda df, n: stats.exact_quantiles(df, value, names).select(F.array(*names).alias(n))
    return q(a, "_a").crossJoin(F.broadcast(q(b, "_b"))).select(F.array_max(F.zip_with("_a", "_b", lambda x, y: F.abs(x - y))).alias("distance"))


def tile_gate(tiles: DataFrame, levels: int, least: int, most: int, most_bytes: int) -> DataFrame:
    c = F.col
    measures = {"n": F.count("*"), "lo": F.min("zoom"), "hi": F.max("zoom"), "levels": F.countDistinct("zoom"), "bytes": F.sum("bytes")}
    return gate(tiles, "tiles", measures, {
        "count": (c("n").between(least, most), c("n")),
        "levels": ((c("levels") == levels) & (c("lo") == 0) & (c("hi") == levels - 1), F.concat_ws("-", c("lo").cast("string"), c("hi").cast("string"))),
        "bytes": (c("bytes") < most_bytes, c("bytes")),
    })


def picture_gate(pixels: DataFrame, least_seen: int, least_colours: int) -> DataFrame:
    c = F.col
    high, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    sat = (high - low) / (high + F.lit(1e-6))
    near, far = F.abs(c("ratio") - 1) < 0.02, (c("ratio") < 0.85) | (c("ratio") > 1.15)
    seen = c("a") > 0
    measures = {"seen": F.count_if(seen), "colours": F.countDistinct(F.when(seen, F.struct("r", "g", "b"))), "near": F.avg(F.when(seen & near, sat)), "far": F.avg(F.when(seen & far, sat))}
    return gate(pixels, "picture", measures, {"visible": (c("seen") > least_seen, c("seen")), "colours": (c("colours") > least_colours, c("colours")), "pale_centre": (c("near") < c("far"), F.concat_ws("/", F.round("near", 3).cast("string"), F.round("far", 3).cast("string")))})


def inputs_gate(files: DataFrame, wanted: DataFrame, least_bytes: int = 1024) -> DataFrame:
    """(name, pass, detail) for wanted files against a listing of (path, length)."""
    found = files.filter(F.col("length") > least_bytes).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    return wanted.join(found, "file", "left").select(F.lit("inputs").alias("gate"), F.col("file").alias("name"), F.col("length").isNotNull().alias("pass"), F.coalesce(F.col("length").cast("string"), F.lit("missing")).alias("detail"))


def table_gate(df: DataFrame, name: str, required: tuple[str, ...], least_rows: int, source: str | None = None, generated: str = "synthetic") -> DataFrame:
    """Rows, columns, complete target rows and real sources of an input table."""
    c, have = F.col, set(df.columns)
    missing = [k for k in required if k not in have]
    measures = {"n": F.count("*"), "complete": F.count_if(F.lit(True) if missing else F.forall(F.array(*[c(k).isNotNull() for k in required]), lambda x: x)), "made": F.count_if(c(source).contains(generated)) if source else F.lit(0)}
    return gate(df, name, measures, {
        "rows": (c("n") >= least_rows, c("n")),
        "columns": (F.lit(not missing), F.lit(", ".join(missing) or "all")),
        "complete": ((c("complete") > 0) & F.lit(not missing), c("complete")),
        "real_sources": (c("made") == 0, c("made")),
    })


def comparison_gate(pixels: DataFrame, a: tuple[str, str, str] = ("r", "g", "b"), b: tuple[str, str, str] = ("r2", "g2", "b2"), alpha: str = "a", value: str = "v", value2: str = "v2", most_difference: float = 60.0, least_correlation: float = 0.7, least_seen: float = 0.3) -> DataFrame:
    """Two pictures of one map, pixel by pixel: mean colour difference and correlation of their values where the first is visible, and the visible share."""
    c, seen = F.col, F.col(alpha) > 0
    apart = sum((F.abs(c(x) - c(y)) for x, y in zip(a, b, strict=True)), F.lit(0)) / 3
    measures = {"difference": F.avg(F.when(seen, apart)), "correlation": F.abs(F.corr(F.when(seen, c(value)), F.when(seen, c(value2)))), "share": F.avg(seen.cast("double"))}
    return gate(pixels, "comparison", measures, {
        "mean_difference": (c("difference") < most_difference, F.round(c("difference"), 4)),
        "correlation": (c("correlation") > least_correlation, F.round(c("correlation"), 4)),
        "coverage": (c("share") > least_seen, F.round(c("share"), 4)),
    })


def coverage_gate(tiles: DataFrame, wanted: DataFrame, least_share: float = 0.95) -> DataFrame:
    """Whether the tiles (zoom, tx, ty, bytes) hold those wanted (zoom, tx, ty), with some content each."""
    held = tiles.filter(F.col("bytes") > 0).select("zoom", "tx", "ty").distinct().withColumn("held", F.lit(1))
    c = F.col
    measures = {"n": F.count("*"), "share": F.count("held") / F.count("*")}
    return gate(wanted.distinct().join(held, ["zoom", "tx", "ty"], "left"), "coverage", measures, {"wanted": (c("n") > 0, c("n")), "held": (c("share") >= least_share, F.round(c("share"), 4))})


def seam_gate(seams: DataFrame, inner: DataFrame, tiles: DataFrame, *, pairs: int = 30, most_difference: float = 30.0, most_ratio: float = 2.5, least_seen: float = 0.5) -> DataFrame:
    """Whether neighbouring tiles meet (seams and inner as raster.seams and raster.inner_differences give them, tiles as pixels with alpha `a`).

    A seam counts where so many visible pairs meet, or all do where none has as many. They pass if the largest difference is small, or their mean is
    not far above that of neighbouring pixels inside tiles. No seams at all fail, and so does a ratio that is unknown or 0.
    """
    d, full = F.col("difference"), F.col("pairs") >= pairs
    across = seams.agg(F.coalesce(F.max(F.when(full, d)), F.max(d)).alias("largest"), F.coalesce(F.avg(F.when(full, d)), F.avg(d)).alias("across"), F.count_if(full).alias("n_full"), F.count("*").alias("n_seams"))
    within = inner.agg(F.avg("difference").alias("within"))
    seen = tiles.agg(F.avg((F.col("a") > 0).cast("double")).alias("seen"))
    row = across.crossJoin(F.broadcast(within)).crossJoin(F.broadcast(seen))  # one row each
    c, ratio = F.col, F.max("across") / F.max("within")
    measures = {"largest": F.max("largest"), "ratio": ratio, "n_full": F.max("n_full"), "n_seams": F.max("n_seams"), "seen": F.max("seen")}
    smooth = F.coalesce(c("largest") < most_difference, F.lit(False)) | F.coalesce((c("ratio") > 0) & (c("ratio") < most_ratio), F.lit(False))
    return gate(row, "seams", measures, {
        "seams": (c("n_seams") > 0, F.concat_ws("/", c("n_full").cast("string"), c("n_seams").cast("string"))),
        "continuity": (smooth, F.concat_ws("/", F.round("largest", 4).cast("string"), F.round("ratio", 4).cast("string"))),
        "coverage": (c("seen") > least_seen, F.round(c("seen"), 4)),
    })
