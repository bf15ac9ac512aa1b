"""Nested lookup documents: one per grid cell, with model blocks, leading features and feature values."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import round_half_even

# Display names of features.
DISPLAY = {
    "bio01": "Mean annual temperature", "bio04": "Temperature seasonality", "bio05": "Max temp of warmest month", "bio06": "Min temp of coldest month",
    "bio12": "Annual precipitation", "bio14": "Precip of driest month", "bio15": "Precip seasonality", "bio17": "Precip of driest quarter", "npp": "MODIS NPP",
    "lst_day": "MODIS LST (day)", "lst_night": "MODIS LST (night)", "lst_diurnal_range": "LST diurnal range", "soc": "Soil organic carbon", "nitrogen": "Soil nitrogen",
    "phh2o": "Soil pH (H2O)", "clay": "Soil clay fraction", "sand": "Soil sand fraction", "silt": "Soil silt fraction", "bdod": "Soil bulk density",
    "cec": "Cation exchange capacity", "c_n_ratio": "C:N ratio", "clay_sand_ratio": "Clay:sand ratio", "ph_optimality": "pH optimality", "aridity_demartonne": "Aridity (de Martonne)",
}


def display_name(feature: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in DISPLAY.items() for x in pair]), feature), feature)


def leading(features: list[str], prefix: str = "", n: int = 3) -> Column:
    """The n features of largest absolute value of a row, as (feature, label, value), ties by place in the list."""
    entries = F.array(*[F.struct((-F.abs(F.col(prefix + f))).alias("_o"), F.lit(i).alias("_i"), F.lit(f).alias("feature"), display_name(F.lit(f)).alias("label"), round_half_even(F.col(prefix + f), 4).alias("value")) for i, f in enumerate(features)])
    return F.transform(F.slice(F.array_sort(entries), 1, n), lambda e: F.struct(e["feature"].alias("feature"), e["label"].alias("label"), e["value"].alias("value")))


def model_block(pred: str, features: list[str], baseline: str | None = None, attribution_prefix: str = "", digits: int = 1) -> Column:
    """A model's part of a document: rounded prediction, baseline and anomaly, leading features, feature values."""
    fields = [round_half_even(F.col(pred), 4).alias("pred_log_rs")]
    if baseline:
        fields += [round_half_even(F.col(baseline), 4).alias("pred_climate_log_rs"), round_half_even(F.exp(F.col(pred) - F.col(baseline)), 4).alias("anomaly")]
    values = F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.array(*[round_half_even(F.col(f), digits) for f in features]))
    return F.struct(*fields, leading(features, attribution_prefix).alias("top3"), values.alias("features"))


def cell_document(cells: DataFrame, key: str, biome: str, pred: str, features: list[str], baseline: str | None = None) -> DataFrame:
    return cells.select(key, F.col(biome).alias("biome"), model_block(pred, features, baseline).alias("fnpp"))


def as_json_lines(documents: DataFrame) -> DataFrame:
    return documents.select(F.to_json(F.struct(*documents.columns)).alias("value"))


def header(grid: dict, models: dict, cells: int, version: str = "atlas_lookup.v3") -> str:
    """The document's head, compact; the cells follow as JSON lines."""
    return json.dumps({"schema_version": version, "grid": {**grid, "n_cells": cells}, "models": models}, separators=(",", ":"))
