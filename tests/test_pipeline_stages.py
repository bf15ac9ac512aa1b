"""The stages composed on generated tables."""

import pytest
from pyspark.sql import functions as F

from terralith.operators import models, raster
from terralith.plans import pipeline
from terralith.sources import synthetic


def test_demo(spark):
    demo = pipeline.Demo(spark, rows=1200, rounds=30, resolution=8.0)
    m = demo.metrics().first()
    assert m["cv_r2"] > 0.2 and m["transfer_r2"] is not None and abs(m["gap"] - (m["cv_r2"] - m["transfer_r2"])) < 1e-9
    a = demo.anomaly().agg(F.min("anomaly").alias("lo"), F.max("anomaly").alias("hi"), F.count("anomaly").alias("n"), F.count("*").alias("all")).first()
    assert 0.2 < a["lo"] < a["hi"] < 5 and a["n"] == a["all"]


def test_extract_and_target(spark):
    sites = synthetic.sites(spark, 100).select(F.col("site_id"), F.col("source"), "longitude", "latitude", F.lit(500.0).alias("rs_annual"))
    target = pipeline.build_target(sites, sites)
    assert target.count() == sites.count()  # the second source falls in the same cells
    grid = raster.Grid(-180.0, 90.0, 10.0, 10.0, 36, 18)
    layers = spark.range(36 * 18).select(F.floor(F.col("id") / 36).cast("int").alias("row"), (F.col("id") % 36).cast("int").alias("col"), F.lit(120.0).alias("soc"), F.lit(0.0).alias("nitrogen"))
    out = pipeline.extract(target, layers, grid, ["soc", "nitrogen"]).select("soc", "nitrogen", "c_n_ratio").distinct().collect()
    assert [(round(r["soc"], 4), r["nitrogen"], r["c_n_ratio"]) for r in out] == [(12.0, None, None)]


def test_dispatch(spark):
    with pytest.raises(ValueError, match="no stage"):
        pipeline.dispatch("fly")
    with pytest.raises(ValueError, match="three features"):
        pipeline.composite(synthetic.sites(spark, 50), synthetic.grid(spark, 20.0), ["bio01"], models.Params(5), ["bio01"])
