"""Queries that fit and apply models. Tree models are beyond SQL; ridge and mean predictors are not."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import functions as F

from ..functions import climate, geo, scalar
from ..operators import boosting, documents, forests, ingest, models, stats
from ..registry import query
from ..session import checkpoint, shared_folder
from ..sources import kept, synthetic
from . import pipeline
from .views import view

FEATURES = ["bio01", "bio04", "bio05", "bio06", "bio12", "bio14", "bio15", "bio17"]
BASE = ["bio01", "bio04", "bio12", "bio14", "bio15"]
#: The published settings of the climate features and of the baseline.
FULL = models.CONFIGS["F_climate_only"][1]
BASELINE = models.BASELINE_PARAMS


def covariates(df):
    """Smooth fields over positions for every covariate of the published models: warmth falls towards the poles, wetness changes in belts, and waves take the place of noise."""
    lon, lat = F.col("longitude"), F.col("latitude")
    wave = lambda k: F.sin(lon / (k + 2) + k) * F.cos(lat / (k + 3))
    made = df.withColumns({"_warm": F.cos(F.radians(lat)) * 2.2 - 1.2 + wave(1) * 0.2, "_wet": F.cos(F.radians(lat * 6)) * 0.6 + wave(2) * 0.4})
    fields = {}
    for k, (name, (low, high, by_warmth, by_wetness)) in enumerate(synthetic.COVARIATES.items(), 3):
        fields[name] = F.lit(low) + F.lit(high - low) / (F.lit(1.0) + F.exp(-(F.col("_warm") * by_warmth + F.col("_wet") * by_wetness + wave(k) * 0.3)))
    landcover = F.floor((wave(1) + 1) * 7.99 + 1).cast("int")  # 1 to 16
    return pipeline.engineer(made.withColumns(fields).withColumn("landcover", landcover).drop("_warm", "_wet"))


def training(spark, sf):
    # a small file with many rows is one task's; what follows costs far more than the rows' way to all cores
    dealt = view(spark, sf, "v_sites").repartition(2 * spark.sparkContext.defaultParallelism, "rec")
    sites = covariates(dealt).withColumn("site_id", F.concat("source", F.lit("_"), F.col("rec").cast("string")))
    lon, lat = F.col("longitude"), F.col("latitude")
    target = F.col("bio01") / 25 + F.ln(F.lit(0.25) + F.col("bio12") / (F.col("bio12") + 900)) + 6 + F.col("rs_annual") * 2e-5
    # written down once: filters on these fields would otherwise repeat their expressions through the whole plan
    return checkpoint(sites.withColumn("log_rs", target).withColumn("region", geo.region_of(lon, lat)).withColumn("block", geo.block_id(lon, lat)))


def with_landcover(sites):
    """The sites with a column for each land-cover class of at least ten of them, and the names of these columns."""
    classes = [r["landcover"] for r in sites.groupBy("landcover").count().filter("count >= 10").orderBy("landcover").collect()]  # sixteen at most
    return checkpoint(sites.select("*", *scalar.one_hot(F.col("landcover"), classes))), [f"lc_{c:02d}" for c in classes]


def grid(spark):
    from ..operators.raster import make_grid

    return checkpoint(covariates(make_grid(spark, 25.0, -10.0, 180.0, 80.0, 2.0)))


@query("mean_predictor", "with a as (select avg(rs_annual) as m from v_sites where source = 'srdb') select round(1 - sum((rs_annual - m) ** 2) / (var_pop(rs_annual) * count(*)), 9) as r2, count(*) as n from v_sites, a where source = 'cosore'")
def _(spark, sf):
    s = view(spark, sf, "v_sites")
    mean = s.filter("source = 'srdb'").agg(F.avg("rs_annual").alias("m"))
    rows = s.filter("source = 'cosore'").crossJoin(F.broadcast(mean))
    return rows.agg(F.round(stats.r2(F.col("rs_annual"), F.col("m")), 9).alias("r2"), F.count("*").alias("n"))


@query("ridge_two_features", """with s as (select count(*) as n, avg(bio12) as my, avg(bio01) as m1, avg(bio14) as m2, stddev_pop(bio01) as s1, stddev_pop(bio14) as s2, covar_pop(bio01, bio14) as c12, covar_pop(bio01, bio12) as c1y, covar_pop(bio14, bio12) as c2y from v_feat),
k as (select *, n + 1e1 as d, n * c12 / (s1 * s2) as r, n * c1y / s1 as a, n * c2y / s2 as b from s), w as (select *, (d * a - r * b) / (d * d - r * r) as w1, (d * b - r * a) / (d * d - r * r) as w2 from k)
select round(w1 / s1, 6) as bio01, round(w2 / s2, 6) as bio14, round(my - w1 / s1 * m1 - w2 / s2 * m2, 5) as intercept from w""")
def _(spark, sf):
    feats = ["bio01", "bio14"]
    sums = stats.ridge_sums(view(spark, sf, "v_feat"), feats, "bio12").first().asDict()  # one row of sums
    c = stats.solve_ridge(sums, feats, 10.0)
    return spark.range(1).select(F.round(F.lit(c["bio01"]), 6).alias("bio01"), F.round(F.lit(c["bio14"]), 6).alias("bio14"), F.round(F.lit(c["intercept"]), 5).alias("intercept"))


#: Replicates of the published intervals.
REPLICATES = 2_000


@query("tree_sweep")
def _(spark, sf):
    """Every published configuration but the one with land cover (full_modis), on five folds of blocks and in transfer."""
    t = training(spark, sf)
    configs = {c: v for c, v in models.CONFIGS.items() if c != "Full_MODIS"}
    return models.sweep(t.filter("region = 'asia'"), stats.fold_ids(t), "log_rs", configs, t.filter("region = 'us'"))


@query("tree_stratified_transfer")
def _(spark, sf):
    t = training(spark, sf).filter("region <> 'other'")
    zone = climate.zone_letter(F.col("bio05"), F.col("bio06"), F.col("bio12"), F.col("bio14"))
    return models.stratified_transfer(t.withColumn("zone", zone), "zone", F.col("region") == "us", FEATURES, "log_rs", FULL, 20, 10, pooled="all_zones")


@query("tree_attributions")
def _(spark, sf):
    t = training(spark, sf)
    model = models.fit(t.filter("region = 'asia'"), FEATURES, "log_rs", FULL)
    return models.overall_attributions(t, model)


def full_and_baseline(sites):
    both = models.fit_all(sites, {"full": (FEATURES, FULL), "baseline": (BASE, BASELINE)}, "log_rs")
    return both["full"], both["baseline"]


@query("anomaly_grid")
def _(spark, sf):
    full, base = full_and_baseline(training(spark, sf).filter("region = 'asia'"))
    return models.anomaly(grid(spark), full, base).select("row", "col", "longitude", "latitude", "log_rs_pred", "log_rs_climate", "rs_pred", "anomaly")


@query("zone_models")
def _(spark, sf):
    zone = climate.zone_letter(F.col("bio05"), F.col("bio06"), F.col("bio12"), F.col("bio14"))
    t = training(spark, sf).withColumn("zone", zone)
    return models.zone_predictions(t, grid(spark).withColumn("zone", zone), "zone", FEATURES, "log_rs", ["row", "col"], FULL)


@query("region_models")
def _(spark, sf):
    t = training(spark, sf).filter("region <> 'other'")
    trees = models.fit_groups(t, "region", FEATURES, "log_rs", FULL)
    return trees.groupBy("region").agg(F.countDistinct("tree").alias("n_trees"), F.count("*").alias("n_nodes"), F.first("base").alias("base"))


@query("atlas_lookup")
def _(spark, sf):
    from ..operators.neighbours import nearest_reference

    t = training(spark, sf).filter("region = 'asia'")
    full, base = full_and_baseline(t)
    cells = models.attribute_wide(models.anomaly(grid(spark), full, base), full, "phi_").withColumn("cell", F.col("row") * 1000 + F.col("col"))
    cells = nearest_reference(cells, ingest.dedup_cells(t).select("site_id", "longitude", "latitude"), "cell", "site_id")
    code = climate.zone_code(F.col("bio01"), F.col("bio12"), F.col("bio14"), F.col("bio17"))
    docs = cells.select(F.round("latitude", 2).alias("lat"), F.round("longitude", 2).alias("lon"), documents.model_block("log_rs_pred", FEATURES, "log_rs_climate", "phi_").alias("fnpp"), code.alias("koppen_code"), climate.zone_label(code).alias("koppen"), F.rint("distance_km").cast("int").alias("nearest_train_km"))
    return documents.as_json_lines(docs)


@query("block_comparison")
def _(spark, sf):
    t = training(spark, sf)
    asia = t.filter("region = 'asia'").drop("block").withColumnRenamed("rec", "block")
    folds = stats.kfold_ids(asia, "block").withColumnRenamed("rec", "block")
    return models.sweep(asia, folds, "log_rs", models.BLOCKS, t.filter("region = 'us'"))


@query("full_modis")
def _(spark, sf):
    sites, classes = with_landcover(training(spark, sf))
    features, params = models.CONFIGS["Full_MODIS"]
    kept = tuple(f for f in features if not f.startswith("lc_") or f in classes)
    return models.sweep(sites.filter("region = 'asia'"), stats.fold_ids(sites), "log_rs", {"Full_MODIS": (kept, params), "F_NPP": models.CONFIGS["F_NPP"]}, sites.filter("region = 'us'"), REPLICATES)


@query("region_attributions")
def _(spark, sf):
    return models.group_attributions(training(spark, sf).filter("region <> 'other'"), "region", FEATURES, "log_rs", FULL)


@query("dual_anomaly")
def _(spark, sf):
    named = {"climate": "F_climate_only", "all": "B_heavier_reg"}
    wanted = {n: models.CONFIGS[c] for n, c in named.items()} | {"baseline": (models.BASELINE, BASELINE)}
    fitted = models.fit_all(training(spark, sf).filter("region = 'asia'"), wanted, "log_rs")
    out = models.anomalies(grid(spark), {n: fitted[n] for n in named}, fitted["baseline"])
    return out.select("row", "col", "longitude", "latitude", *[f"{k}_{n}" for n in named for k in ("log_rs", "anomaly")], "log_rs_baseline")


def modis_grid(spark, sf, folder, features=None):
    """The grid scored by the configuration with land cover, kept under the fingerprint of sites, settings and code."""
    sites, classes = with_landcover(training(spark, sf).filter("region = 'asia'"))
    published, params = models.CONFIGS["Full_MODIS"]
    used = [f for f in features or published if not f.startswith("lc_") or f in classes]
    key = kept.fingerprint([sites.select("log_rs", *used)], {"features": used, "params": asdict(params), "target": "log_rs"}, [boosting, forests])

    def make():
        cells = grid(spark)
        cells = cells.select("*", *scalar.one_hot(F.col("landcover"), [int(c[3:]) for c in classes]))
        return models.score(cells.select("row", "col", "longitude", "latitude", *used), {"log_rs_pred": models.fit(sites, used, "log_rs", params)}).drop(*used)

    return kept.kept(folder, "full-modis-grid", key, make)


@query("full_modis_grid")
def _(spark, sf):
    return modis_grid(spark, sf, f"{shared_folder(spark).rstrip('/')}/kept")
