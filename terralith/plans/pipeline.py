"""The stages from sites to an anomaly map, composed lazily: each stage is a function over DataFrames.

build_target -> extract -> train -> validate -> predict -> composite. Only model fitting acts at once; the rest is
one plan, in which prediction and baseline are two columns of a single pass over the grid.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, scalar
from ..operators import ingest, models, raster, stats
from ..sources import synthetic

TARGET = "log_rs_annual"


def build_target(*sources: DataFrame) -> DataFrame:
    """Sites of all sources, cleaned, tagged and one to a cell."""
    rows = ingest.union_sources(*[ingest.filter_sites(s) for s in sources])
    tagged = rows.withColumn("log_rs_annual", F.ln("rs_annual")).withColumn("region", geo.region_of(F.col("longitude"), F.col("latitude")))
    return ingest.dedup_cells(tagged)


def engineer(df: DataFrame) -> DataFrame:
    """Adds the engineered features whose inputs are there."""
    have, c = set(df.columns), F.col
    made = {
        "c_n_ratio": ({"soc", "nitrogen"}, lambda: scalar.ratio(c("soc"), c("nitrogen"))),
        "clay_sand_ratio": ({"clay", "sand"}, lambda: scalar.ratio(c("clay"), c("sand"))),
        "ph_optimality": ({"phh2o"}, lambda: scalar.ph_optimality(c("phh2o"))),
        "aridity_demartonne": ({"bio12", "bio01"}, lambda: scalar.aridity(c("bio12"), c("bio01"))),
        "lst_diurnal_range": ({"lst_day", "lst_night"}, lambda: scalar.diurnal_range(c("lst_day"), c("lst_night"))),
    }
    return df.withColumns({k: f() for k, (needs, f) in made.items() if needs <= have})


def extract(points: DataFrame, layers: DataFrame, grid: raster.Grid, names: list[str]) -> DataFrame:
    """Points with all layers (one wide cell table, one join), soil in physical units, engineered features added."""
    out = raster.sample(points, layers, grid, names)
    soil = scalar.soil_units({n: F.col(n) for n in names if n in scalar.SOIL_SCALE})
    return engineer(out.withColumns({k: v for k, v in soil.items()}))


def with_blocks(df: DataFrame, size: float = geo.BLOCK_DEG) -> DataFrame:
    return df.withColumn("block", geo.block_id(F.col("longitude"), F.col("latitude"), size))


def train(df: DataFrame, configs: dict, transfer: DataFrame | None = None, folds: int = 5, block_deg: float = geo.BLOCK_DEG, target: str = TARGET) -> DataFrame:
    """Spatial-block cross-validation of every configuration, and its transfer to another region as fold 0."""
    rows = with_blocks(df, block_deg)
    return models.sweep(rows, stats.fold_ids(rows, folds), target, configs, transfer)


def validate(runs: DataFrame) -> DataFrame:
    """One row for each configuration: mean and spread over the folds, transfer, and the gap between both."""
    cv, us = F.col("fold") > 0, F.col("fold") == 0
    out = runs.groupBy("config").agg(F.avg(F.when(cv, F.col("r2"))).alias("cv_r2"), F.stddev_pop(F.when(cv, F.col("r2"))).alias("cv_r2_std"), F.avg(F.when(cv, F.col("rmse"))).alias("cv_rmse"), F.max(F.when(us, F.col("r2"))).alias("transfer_r2"), F.max(F.when(us, F.col("bias"))).alias("transfer_bias"))
    return out.withColumn("gap", F.col("cv_r2") - F.col("transfer_r2"))


def composite(df: DataFrame, grid: DataFrame, features: list[str], params: models.Params, baseline: list[str] | None = None, baseline_params: models.Params = models.BASELINE_PARAMS, match_rows: bool = False, target: str = TARGET) -> DataFrame:
    """The grid with prediction, climate baseline and their ratio. match_rows: the baseline sees only rows the full model sees."""
    base = list(baseline or models.BASELINE)
    if len(base) < 3:
        raise ValueError("a baseline needs three features at least")
    full = models.fit(df, features, target, params)
    seen = df.na.drop(subset=features) if match_rows else df
    return models.anomaly(grid, full, models.fit(seen, base, target, baseline_params))


@dataclass
class Demo:
    """A smoke run on generated tables: cross-validation, transfer, and the anomaly of a coarse grid."""

    spark: SparkSession
    rows: int = 3000
    rounds: int = 60
    resolution: float = 2.0

    def sites(self) -> DataFrame:
        return engineer(synthetic.sites(self.spark, self.rows)).withColumn("region", geo.region_of(F.col("longitude"), F.col("latitude")))

    def metrics(self) -> DataFrame:
        s = self.sites()
        quick = models.smaller(models.Params(), self.rounds)
        return validate(train(s.filter("region = 'asia'"), {"climate": (models.CLIMATE, quick)}, s.filter("region = 'us'"), folds=4, block_deg=10.0))

    def anomaly(self) -> DataFrame:
        s = self.sites().filter("region = 'asia'")
        quick = models.smaller(models.Params(), self.rounds)
        return composite(s, engineer(synthetic.grid(self.spark, self.resolution)), [*models.CLIMATE, "npp"], quick, baseline_params=models.smaller(models.BASELINE_PARAMS, self.rounds))


STAGES: dict[str, Callable] = {"build_target": build_target, "extract": extract, "train": train, "validate": validate, "composite": composite}


def dispatch(stage: str, *args, **options) -> DataFrame:
    """A stage by name; unknown names are refused."""
    if stage not in STAGES:
        raise ValueError(f"no stage {stage}; there are {', '.join(STAGES)}")
    return STAGES[stage](*args, **options)
