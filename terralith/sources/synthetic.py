"""Generated sites and grids: every value comes from a hash of its row, so that any partitioning gives the same table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators.raster import make_grid


def uniform(key: Column, stream: int, seed: int) -> Column:
    """A number in [0, 1) from a key: 53 bits of a 64-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(stream), F.lit(seed)), 11) / F.lit(float(2**53))


def normal(key: Column, stream: int, seed: int, sd: float = 1.0) -> Column:
    """A normal deviate by the Box-Muller transform."""
    r = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - uniform(key, 2 * stream, seed)))
    return r * F.cos(uniform(key, 2 * stream + 1, seed) * 6.283185307179586) * sd


#: Each covariate's least and greatest value, and how it leans on warmth and on wetness (both between -1 and 1).
COVARIATES: dict[str, tuple[float, float, float, float]] = {
    "bio01": (-20.0, 30.0, 3.0, 0.0),
    "bio04": (60.0, 1500.0, -2.6, -0.6),
    "bio05": (2.0, 42.0, 2.2, -0.5),
    "bio06": (-45.0, 24.0, 2.8, 0.4),
    "bio12": (40.0, 3600.0, 0.8, 2.6),
    "bio14": (0.0, 280.0, 0.3, 2.4),
    "bio15": (15.0, 140.0, 0.6, -1.8),
    "bio17": (2.0, 900.0, 0.3, 2.5),
    "soc": (1.0, 90.0, -1.3, 1.1),
    "nitrogen": (0.1, 9.0, -1.1, 1.0),
    "phh2o": (3.8, 9.2, 0.2, -1.9),
    "clay": (20.0, 700.0, 0.5, 0.4),
    "sand": (40.0, 900.0, -0.2, -0.7),
    "silt": (20.0, 700.0, -0.3, 0.3),
    "bdod": (0.8, 1.8, 0.7, -0.8),
    "cec": (3.0, 75.0, -0.6, 0.6),
    "npp": (60.0, 1700.0, 1.4, 1.9),
    "lst_day": (-8.0, 45.0, 2.4, -0.6),
    "lst_night": (-30.0, 27.0, 2.7, 0.3),
}


def _covariates(df: DataFrame, key: Column, seed: int, spread: float = 0.5) -> DataFrame:
    """Every covariate is its range, run through by a logistic curve over warmth, wetness and noise of its own."""
    lat = F.col("latitude")
    warmth = F.cos(F.radians(lat)) * 2.2 - 1.2 + normal(key, 1, seed, 0.2 * spread)
    # wet at the equator and in the westerlies, dry between
    wetness = F.cos(F.radians(lat * 6)) * 0.6 + normal(key, 2, seed, 0.6 * spread)
    df = df.withColumns({"_warm": scalar.clip(warmth, -1.0, 1.0), "_wet": scalar.clip(wetness, -1.0, 1.0)})
    made = {}
    for k, (name, (low, high, by_warmth, by_wetness)) in enumerate(COVARIATES.items(), 3):
        lean = F.col("_warm") * by_warmth + F.col("_wet") * by_wetness + normal(key, k, seed, spread)
        made[name] = F.lit(low) + F.lit(high - low) / (F.lit(1.0) + F.exp(-lean))
    df = df.withColumns(made).withColumn("landcover", F.floor(uniform(key, 901, seed) * 16 + 1).cast("float"))
    c = F.col
    return df.withColumns({"c_n_ratio": scalar.ratio(c("soc"), c("nitrogen")), "clay_sand_ratio": scalar.ratio(c("clay"), c("sand")), "aridity_demartonne": scalar.aridity(c("bio12"), c("bio01")), "lst_diurnal_range": scalar.diurnal_range(c("lst_day"), c("lst_night"))})


def sites(spark: SparkSession, n: int = 3000, seed: int = 42) -> DataFrame:
    """A training table: three quarters in Asia, one in the US, with a respiration that grows with warmth, wetness and carbon and is largest in neutral soils."""
    k = F.col("id")
    asia = k < int(0.75 * n)
    box = lambda s, low, high: F.lit(float(low)) + uniform(k, s, seed) * (high - low)
    longitude, latitude = F.when(asia, box(951, 35, 175)).otherwise(box(952, -122, -70)), F.when(asia, box(953, -5, 70)).otherwise(box(954, 28, 48))
    base = spark.range(n).select("id", F.concat(F.lit("site_"), k.cast("string")).alias("site_id"), F.lit("synthetic").alias("source"), longitude.alias("longitude"), latitude.alias("latitude"))
    df = _covariates(base, k, seed)
    c = F.col
    growth = F.exp(c("bio01") / 25) * (F.lit(0.25) + c("bio12") / (c("bio12") + 900)) * (F.lit(0.6) + c("soc") / (c("soc") + 40) * 0.8)
    rs = growth * 400 / (F.lit(1.0) + F.pow((c("phh2o") - 6.8) / 4, 2)) * F.exp(normal(k, 961, seed, 0.25))
    return df.withColumns({"rs_annual": rs, "log_rs_annual": F.ln(rs)}).drop("id", "_warm", "_wet")


def grid(spark: SparkSession, resolution: float = 1.0, seed: int = 7) -> DataFrame:
    cells = make_grid(spark, 35.5 - resolution / 2, -4.5 - resolution / 2, 175.5 - resolution / 2, 70.5 - resolution / 2, resolution)
    return _covariates(cells, F.xxhash64("row", "col"), seed, spread=0.3).drop("_warm", "_wet")


def anomaly_field(cells: DataFrame, seed: int = 11, bumps: int = 8, waves: int = 5) -> DataFrame:
    """A smooth field around 1: bumps of alternating sign at hashed places of the map, and waves of hashed directions, clamped to [0.5, 1.5]."""
    lon, lat, key = F.col("longitude"), F.col("latitude"), F.lit(seed)
    total = F.lit(1.0)
    for k in range(bumps):
        at = lambda s, low, high: F.lit(float(low)) + uniform(key, 10 * k + s, seed) * (high - low)  # noqa: E731, B023
        total = total + scalar.bump(lon, at(0, 35, 175), at(1, 200, 900)) * scalar.bump(lat, at(2, -5, 70), at(3, 100, 500)) * (0.2 if k % 2 else -0.2)
    for k in range(waves):
        turn = uniform(key, 1000 + k, seed) * 6.283185307179586
        total = total + F.sin((lon * F.cos(turn) + lat * F.sin(turn)) / (4.0 + 3 * k) + turn) * (0.08 / waves * 2)
    return cells.withColumn("anomaly", scalar.clip(total, 0.5, 1.5).cast("float"))
