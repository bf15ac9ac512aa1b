"""Models over tables: sweeps, transfers, groups, zones, anomalies and attributions of boosted trees, ridge and mean predictors.

Fits go through boosting.fit_runs (all models of a query at once, histograms summed by Spark). What a fit gives, a forest of a
few thousand nodes, travels to the rows: grids and test rows are scored where they lie, and metrics are aggregates
of the scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from . import stats
from .boosting import Bins, Block, Growth, Params, Run, fit_runs, grow_here
from .forests import TREE_SCHEMA, Forest

__all__ = ["TREE_SCHEMA", "Forest", "Params", "Ridge", "fit", "fit_forest", "fit_groups", "sweep"]


@dataclass(frozen=True)
class Ridge:
    """A ridge regression on standardised features, as another kind of model in a sweep."""

    alpha: float = 10.0
    early_stopping: int = 0


# The feature sets and settings of the published configurations.
CLIMATE = ("bio01", "bio04", "bio05", "bio06", "bio12", "bio14", "bio15", "bio17")
SOIL = ("soc", "nitrogen", "phh2o", "clay", "sand", "silt", "bdod", "cec")
ENGINEERED = ("c_n_ratio", "clay_sand_ratio", "ph_optimality", "aridity_demartonne")
PRODUCTIVITY = ("npp", "lst_day", "lst_night", "lst_diurnal_range")
BASELINE = ("bio01", "bio04", "bio12", "bio14", "bio15")
CONFIGS: dict[str, tuple[tuple[str, ...], Params]] = {
    "A_baseline": (SOIL + CLIMATE + ENGINEERED, Params()),
    "B_heavier_reg": (SOIL + CLIMATE + ENGINEERED, Params(min_child_weight=8, reg_alpha=2.0, reg_lambda=8.0)),
    "C_shallow_more": (SOIL + CLIMATE + ENGINEERED, Params(n_estimators=400, max_depth=2, learning_rate=0.04, reg_lambda=4.0)),
    "D_drop_overfit": (tuple(f for f in SOIL + CLIMATE + ENGINEERED if f not in ("clay", "sand", "silt", "clay_sand_ratio")), Params()),
    "E_climate_plus_transferring_soil": (CLIMATE + ("phh2o", "ph_optimality", "bdod", "cec", "aridity_demartonne"), Params()),
    "F_climate_only": (CLIMATE, Params(n_estimators=200)),
    "F_NPP": (CLIMATE + PRODUCTIVITY, Params(subsample=0.85, min_child_weight=4, reg_alpha=0.5)),
}
#: Land-cover classes take part as one-hot columns lc_NN, those with at least ten sites.
CONFIGS["Full_MODIS"] = (SOIL + CLIMATE + ENGINEERED + PRODUCTIVITY + tuple(f"lc_{c:02d}" for c in range(1, 17)), Params())
#: Feature blocks and kinds of models that the published diagnosis compares (fixed values too).
BLOCKS: dict[str, tuple[tuple[str, ...], Params | Ridge]] = {
    "all, default trees": (SOIL + CLIMATE + ENGINEERED, Params(n_estimators=400, max_depth=5, subsample=0.85, min_child_weight=1, reg_alpha=0.0, reg_lambda=1.0)),
    "all, shallow trees": (SOIL + CLIMATE + ENGINEERED, Params(n_estimators=200, colsample=1.0, min_child_weight=1, reg_alpha=0.0)),
    "all, ridge": (SOIL + CLIMATE + ENGINEERED, Ridge(10.0)),
    "climate, trees": (BASELINE, Params(n_estimators=200, subsample=1.0, colsample=1.0, min_child_weight=1, reg_alpha=0.0)),
    "climate, ridge": (BASELINE, Ridge(5.0)),
    "soil, trees": (SOIL, Params(n_estimators=200, subsample=1.0, colsample=1.0, min_child_weight=1, reg_alpha=0.0)),
}
BASELINE_PARAMS = Params(n_estimators=400, max_depth=4, subsample=0.85, colsample=1.0, min_child_weight=1, reg_alpha=0.0, reg_lambda=1.0)


def fit_forest(x: np.ndarray, y: np.ndarray, features: list[str], p: Params, held: tuple[np.ndarray, np.ndarray] | None = None) -> Forest:
    """One model of arrays in memory, as a task grows it; with `held` (features, target) and early_stopping, the trees after the best round are dropped."""
    both = [np.asarray(a, dtype=np.float32).reshape(-1, len(features)) for a in ((x, held[0]) if held else (x,))]
    every, target = np.concatenate(both), np.concatenate([y, held[1]] if held else [y]).astype(float)
    known = [np.unique(c[~np.isnan(c)]) for c in every.T]
    bins = [Bins.of(u, True) if len(u) <= 255 else Bins.of(np.quantile(u, np.arange(1, 255) / 255), False) for u in known]
    codes = np.stack([b.codes(c) for b, c in zip(bins, every.T, strict=True)]) if len(features) else np.zeros((0, len(target)), np.uint8)
    key = pd.util.hash_array(target) ^ np.arange(len(target), dtype=np.uint64)
    part = np.repeat(np.arange(len(both)), [len(b) for b in both])
    run = Run("", tuple(features), p, frozenset({0}), frozenset({1}) if held else frozenset(), complete=False)
    return grow_here(Growth(run, np.arange(len(features)), bins), Block(codes, target, part, key))


def metrics(y: np.ndarray, p: np.ndarray) -> dict[str, float]:
    sst = float(((y - y.mean()) ** 2).sum()) if len(y) else 0.0
    return {"r2": 1 - float(((y - p) ** 2).sum()) / sst if sst else float("nan"), "rmse": float(np.sqrt(np.mean((y - p) ** 2))), "mae": float(np.mean(np.abs(y - p))), "bias": float(np.mean(p - y)), "pred_std": float(np.std(p)), "obs_std": float(np.std(y))}


def metric_columns(y: str = "y", p: str = "p") -> list[Column]:
    """The same as aggregates."""
    e, sst = F.col(p) - F.col(y), F.var_pop(y) * F.count(y)
    r2 = F.when(sst > 0, 1 - F.sum(e * e) / sst).otherwise(F.lit(float("nan")))
    each = {"r2": r2, "rmse": F.sqrt(F.avg(e * e)), "mae": F.avg(F.abs(e)), "bias": F.avg(e), "pred_std": F.stddev_pop(p), "obs_std": F.stddev_pop(y)}
    return [c.alias(n) for n, c in each.items()]


def _matrix(pdf: pd.DataFrame, features: list[str]) -> np.ndarray:
    return pdf[features].to_numpy(dtype="float32", na_value=np.nan)


def complete(features: list[str] | tuple[str, ...], target: str | None) -> Column:
    """Whether a row has the target, if one is named, and all features (no null, no NaN)."""
    out = F.lit(True)
    for c in (*features,) if target is None else (target, *features):
        out = out & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return out


RUN_SCHEMA = "config string, fold int, n_features int, n_train int, n_test int, r2 double, rmse double, mae double, bias double, pred_std double, obs_std double, n_trees int"
Predictor = Callable[[np.ndarray], np.ndarray]


def ridge_predictions(x: np.ndarray, y: np.ndarray, new: np.ndarray, alpha: float) -> np.ndarray:
    """Predictions for new rows by the ridge that the rows (x, y) give, features standardised, the constant not penalised."""
    x, new = x.astype(float), new.astype(float)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = (x - mean) / scale
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return y.mean() + (new - mean) / scale @ beta


def _ridge(sums: list[dict], features: list[str], alpha: float) -> Predictor:
    """The ridge of several parts, from the sums of each."""
    c = stats.solve_ridge({k: sum(s[k] for s in sums) for k in sums[0]}, features, alpha)
    beta, constant = np.array([c[f] for f in features]), c["intercept"]
    return lambda x: x.astype(float) @ beta + constant


def predictions(rows: DataFrame, target: str, models: dict[tuple[str, int], tuple[list[str], Predictor]]) -> DataFrame:
    """(config, fold, y, p): each complete row of part k by every model (config, k), scored where it lies."""
    wanted = sorted({f for feats, _ in models.values() for f in feats})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            part, y = pdf["part"].to_numpy(), pdf[target].to_numpy(dtype=float, na_value=np.nan)
            for (config, k), (feats, predict) in models.items():
                own = (part == k) & ~np.isnan(y)
                if own.any():
                    x = _matrix(pdf[own], feats)
                    ok = ~np.isnan(x).any(axis=1)
                    if ok.any():
                        yield pd.DataFrame({"config": config, "fold": k, "y": y[own][ok], "p": predict(x[ok])})

    return rows.select("part", target, *wanted).mapInPandas(run, "config string, fold int, y double, p double")


def sweep(train: DataFrame, folds: DataFrame, target: str, configs: dict[str, tuple[tuple[str, ...], Params | Ridge]], transfer: DataFrame | None = None, replicates: int = 0, seed: int = 42) -> DataFrame:
    """Every configuration on every fold (fold >= 1), and, with a transfer table, on all training rows against it (fold 0).

    folds has (block, fold) and train a block column. All trees of all configurations and folds grow together. With
    replicates, ci_low and ci_high of r2 follow, from so many resamplings of the rows scored.
    """
    known = {c: ([f for f in feats if f in train.columns], p) for c, (feats, p) in configs.items()}
    names = sorted({f for feats, _ in known.values() for f in feats})
    rows = train.join(folds, "block").select(F.col("fold").cast("int").alias("part"), target, *names)
    if transfer is not None:
        rows = rows.unionByName(transfer.select(F.lit(0).alias("part"), target, *names))
    rows = checkpoint(rows)  # read by every pass below
    whole = {c: complete(feats, target) for c, (feats, _) in known.items()}
    counted = rows.groupBy("part").agg(*[F.count_if(ok).alias(c) for c, ok in whole.items()]).collect()  # one for each fold
    n = {c: {r["part"]: r[c] for r in counted if r[c]} for c in known}
    every = sorted({r["part"] for r in counted if r["part"]})
    runs, facts = {}, []
    for c, (feats, _) in known.items():
        for k in [*([0] if transfer is not None else []), *every]:
            own = frozenset(i for i in every if i != k)
            n_train = sum(n[c].get(i, 0) for i in own)
            if n_train and n[c].get(k):
                runs[c, k] = own
                facts.append((c, k, len(feats), n_train))
    trees = [Run(f"{c}\n{k}", tuple(known[c][0]), known[c][1], own, frozenset({k}) if known[c][1].early_stopping else frozenset()) for (c, k), own in runs.items() if isinstance(known[c][1], Params)]
    forests = fit_runs(rows, target, trees)
    models: dict[tuple[str, int], tuple[list[str], Predictor]] = {}
    sums: dict[tuple[str, ...], dict[int, dict]] = {}
    for (c, k), own in runs.items():
        feats, p = known[c]
        if isinstance(p, Ridge):
            if tuple(feats) not in sums:
                sums[tuple(feats)] = {r["part"]: r.asDict() for r in stats.ridge_sums(rows, feats, target, "part").collect()}  # one for each fold
            models[c, k] = feats, _ridge([{x: v for x, v in s.items() if x != "part"} for i, s in sums[tuple(feats)].items() if i in own], feats, p.alpha)
        else:
            models[c, k] = feats, forests[f"{c}\n{k}"].predict
    n_trees = {key: len(forests[f"{key[0]}\n{key[1]}"]._flat()["roots"]) if isinstance(known[key[0]][1], Params) else 0 for key in runs}
    scored = predictions(rows, target, models)
    spark = train.sparkSession
    table = spark.createDataFrame([(*f, n_trees[f[:2]]) for f in facts], "config string, fold int, n_features int, n_train int, n_trees int")
    out = scored.groupBy("config", "fold").agg(F.count("*").cast("int").alias("n_test"), *metric_columns()).join(F.broadcast(table), ["config", "fold"])  # a row a run
    columns = [x.split()[0] for x in RUN_SCHEMA.split(", ")]
    if not replicates:
        return out.select(*columns)
    spans = stats.resampled_r2(scored.select(F.concat_ws("\n", "config", F.col("fold").cast("string")).alias("group"), "y", "p"), replicates, seed)
    key = F.split("group", "\n")
    spans = spans.select(key[0].alias("config"), key[1].cast("int").alias("fold"), "ci_low", "ci_high")
    return out.join(spans, ["config", "fold"], "left").select(*columns, "ci_low", "ci_high")


def fit(train: DataFrame, features: list[str], target: str, params: Params = Params()) -> Forest:
    """One model of all complete rows."""
    return fit_all(train, {"": (list(features), params)}, target)[""]


def fit_all(train: DataFrame, models: dict[str, tuple[list[str] | tuple[str, ...], Params]], target: str) -> dict[str, Forest]:
    """Several models of the same rows, grown together; each sees the rows that have all its features."""
    names = sorted({f for feats, _ in models.values() for f in feats})
    return fit_runs(train.select(F.lit(0).alias("part"), target, *names), target, [Run(n, tuple(feats), p, frozenset({0})) for n, (feats, p) in models.items()])


#: Groups, zones and strata are classes; one model of each travels to the tasks.
MOST_GROUPS = 1_000


def _classes(df: DataFrame, column: str) -> list:
    """The different values of a column of classes, null left out; refused beyond MOST_GROUPS."""
    found = [r[0] for r in df.filter(F.col(column).isNotNull()).select(column).distinct().limit(MOST_GROUPS + 1).collect()]
    if len(found) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} values of {column}")
    return sorted(found)


def _number(column: str, classes: list) -> Column:
    """The place of the row's class in the list; null for a class that is not there."""
    return F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(column)).cast("int") - 1 if classes else F.lit(None).cast("int")


def forests_of_groups(train: DataFrame, group: str, features: list[str], target: str, params: Params = Params(), least: int = 1) -> dict:
    """{group: forest} of the groups with at least so many complete rows."""
    classes = _classes(train, group)
    ok = train.select("*", complete(features, target).alias("_ok"))
    n = {r[0]: r[1] for r in ok.groupBy(group).agg(F.count_if("_ok")).collect()}  # one for each class
    part = _number(group, classes)
    runs = [Run(str(i), tuple(features), params, frozenset({i})) for i, c in enumerate(classes) if n.get(c, 0) >= least]
    forests = fit_runs(train.select(part.alias("part"), target, *features), target, runs)
    return {classes[int(i)]: f for i, f in forests.items()}


def fit_groups(train: DataFrame, group: str, features: list[str], target: str, params: Params = Params()) -> DataFrame:
    """(group, base, tree rows): one model for each group."""
    forests = forests_of_groups(train, group, features, target, params)
    schema = f"{group} {train.schema[group].dataType.simpleString()}, base double, {TREE_SCHEMA}"
    return train.sparkSession.createDataFrame([(g, f.base, *(int(v) for v in r[:3]), float(r[3]), int(r[4]), int(r[5]), bool(r[6]), float(r[7]), float(r[8])) for g, f in forests.items() for r in f.rows], schema)


def score(df: DataFrame, models: dict[str, Forest]) -> DataFrame:
    """Adds a prediction column for each model in one pass; a row with a missing feature of a model gets NULL."""
    names = list(models)
    wanted = sorted({f for m in models.values() for f in m.features})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, m in models.items():
                x = _matrix(pdf, m.features)
                ok = ~np.isnan(x).any(axis=1)
                out = np.full(len(pdf), np.nan)
                out[ok] = m.predict(x[ok])
                pdf[n] = pd.Series(out, index=pdf.index).where(ok, None).astype("Float64").astype(object).where(ok, None)
            yield pdf

    missing = sorted(set(wanted) - set(df.columns))
    if missing:
        raise ValueError(f"missing features: {missing}")
    return df.mapInPandas(run, df.select("*", *[F.lit(None).cast("double").alias(n) for n in names]).schema)


def attribute(df: DataFrame, model: Forest, keys: list[str]) -> DataFrame:
    """(keys, feature, value): Shapley values of every complete row, long."""
    kept = df.select(*keys, *model.features).na.drop(subset=model.features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 5000):
                part = pdf.iloc[at : at + 5000]
                phi = model.attributions(_matrix(part, model.features))
                out = pd.concat([part[keys].reset_index(drop=True), pd.DataFrame(phi, columns=model.features)], axis=1)
                yield out.melt(id_vars=keys, var_name="feature", value_name="value")

    return kept.mapInPandas(run, kept.select(*keys, F.lit("").alias("feature"), F.lit(0.0).alias("value")).schema)


def attribute_wide(df: DataFrame, model: Forest, prefix: str = "phi_") -> DataFrame:
    """The rows with a Shapley value column for each feature of the model, in one pass; NULL where a feature is missing."""
    names = [prefix + f for f in model.features]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 5000):
                part = pdf.iloc[at : at + 5000]
                x = _matrix(part, model.features)
                ok = ~np.isnan(x).any(axis=1)
                phi = np.full(x.shape, np.nan)
                phi[ok] = model.attributions(x[ok])
                values = phi.astype(object)
                values[~ok] = None
                yield pd.concat([part, pd.DataFrame(values, columns=names, index=part.index)], axis=1)

    return df.mapInPandas(run, df.select("*", *[F.lit(None).cast("double").alias(n) for n in names]).schema)


def importance_ranks(attributions: DataFrame) -> DataFrame:
    """(feature, importance, rank): mean absolute attribution, largest first. One row for each feature."""
    mean = attributions.groupBy("feature").agg(F.avg(F.abs(F.col("value"))).alias("importance"))
    return mean.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


def mean_attributions(rows: DataFrame, group: str, features: list[str], target: str | None, forests: dict) -> DataFrame:
    """(group, n, feature, importance): the mean absolute Shapley value over all complete rows of each group, by the group's model. Rows of the same features are counted and attributed once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, own in pdf.groupby(group):
                if name in forests:
                    n = own["_n"].to_numpy()
                    phi = n @ np.abs(forests[name].attributions(_matrix(own, features)))
                    yield pd.DataFrame({group: name, "feature": features, "total": phi, "n": n.sum()})

    kind = rows.schema[group].dataType.simpleString()
    counted = rows.filter(complete(features, target)).groupBy(group, *features).agg(F.count("*").alias("_n"))
    sums = counted.mapInPandas(run, f"{group} {kind}, feature string, total double, n long")
    return sums.groupBy(group, "feature").agg(F.sum("n").cast("int").alias("n"), (F.sum("total") / F.sum("n")).alias("importance"))


def overall_attributions(rows: DataFrame, model: Forest) -> DataFrame:
    """(feature, importance, rank): the mean absolute Shapley value over all rows that have the model's features, known target or not, largest first."""
    mean = mean_attributions(rows.select(F.lit("").alias("group"), *model.features), "group", model.features, None, {"": model})
    return importance_ranks(mean.select("feature", F.col("importance").alias("value")))  # one value a feature, its own mean


def group_attributions(train: DataFrame, group: str, features: list[str], target: str, params: Params = Params()) -> DataFrame:
    """(group, n, feature, importance, rank): one model for each group, and the mean absolute Shapley value of each feature over all the group's rows."""
    mean = mean_attributions(train, group, features, target, forests_of_groups(train, group, features, target, params))
    return mean.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("importance"), "feature"))).select(group, "n", "feature", "importance", "rank")  # a row a feature


def anomalies(grid: DataFrame, models: dict[str, Forest], baseline: Forest, baseline_name: str = "baseline") -> DataFrame:
    """The grid with log_rs_<name> and anomaly_<name> of several models over one baseline (log_rs_<baseline_name>), in one pass. Names must differ."""
    made = [f"log_rs_{n}" for n in (*models, baseline_name)] + [f"anomaly_{n}" for n in models]
    lower = [c.lower() for c in (*grid.columns, *made)]
    if twice := sorted({c for c in lower if lower.count(c) > 1}):
        raise ValueError(f"columns of one name: {twice}")
    out = score(grid, {f"log_rs_{n}": m for n, m in models.items()} | {f"log_rs_{baseline_name}": baseline})
    return out.withColumns({f"anomaly_{n}": F.exp(F.col(f"log_rs_{n}") - F.col(f"log_rs_{baseline_name}")) for n in models})


def anomaly(grid: DataFrame, full: Forest, baseline: Forest) -> DataFrame:
    """The grid with log_rs_pred, log_rs_climate and their ratio, in one pass."""
    out = score(grid, {"log_rs_pred": full, "log_rs_climate": baseline})
    return out.withColumn("rs_pred", F.exp("log_rs_pred")).withColumn("anomaly", F.exp(F.col("log_rs_pred") - F.col("log_rs_climate")))


STRATUM_SCHEMA = "stratum string, n_a int, n_b int, skipped boolean, r2 double, rmse double, ci_low double, ci_high double, excludes_zero boolean, top_feature string"


def stratified_transfer(df: DataFrame, stratum: str, is_test: Column, features: list[str], target: str, params: Params, least_a: int = 80, least_b: int = 30, replicates: int = 1000, pooled: str | None = None) -> DataFrame:
    """In each stratum: fit on one region, score the other, resample the fit; strata with too little support are skipped. `pooled` names a further row, of all strata together."""
    spark = df.sparkSession
    rows = df.select(F.col(stratum).cast("string").alias("stratum"), is_test.alias("test"), target, *features).filter("test is not null")
    strata = _classes(rows, "stratum")
    part = F.coalesce(_number("stratum", strata) * 2, F.lit(2 * len(strata))) + F.col("test").cast("int")  # rows without a stratum take part in the pooled row
    rows = rows.withColumn("part", part)
    n = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count_if(complete(features, target)).alias("n")).collect()}  # two for each stratum
    sets = {name: ([2 * i], [2 * i + 1]) for i, name in enumerate(strata)}
    if pooled is not None:
        sets[pooled] = ([2 * i for i in range(len(strata) + 1)], [2 * i + 1 for i in range(len(strata) + 1)])
    support = {name: tuple(sum(n.get(p, 0) for p in side) for side in parts) for name, parts in sets.items()}
    kept = {name: parts for name, parts in sets.items() if support[name][0] >= least_a and support[name][1] >= least_b}
    forests = fit_runs(rows, target, [Run(name, tuple(features), params, frozenset(parts[0])) for name, parts in kept.items()])
    facts = spark.createDataFrame([(name, *support[name], name not in kept) for name in sets], "stratum string, n_a int, n_b int, skipped boolean")
    models = {(name, p): (features, forests[name].predict) for name, parts in kept.items() for p in parts[1]}
    pairs = predictions(rows.filter("test"), target, models).select(F.col("config").alias("group"), "y", "p")
    measured = pairs.groupBy("group").agg(*[c for c in metric_columns()][:2])
    spans = stats.resampled_r2(pairs, replicates, params.seed)
    own = F.get(F.array(*[F.lit(s) for s in strata]), F.expr("part div 2").cast("int")) if strata else F.lit(None).cast("string")
    fitted_on = rows.filter("not test").withColumn("group", F.explode(F.filter(F.array(own, F.lit(pooled).cast("string")), lambda g: g.isNotNull())))
    mean = mean_attributions(fitted_on, "group", features, target, forests)
    order = F.struct(F.col("importance"), (-F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))).alias("place"), "feature")
    top = mean.groupBy("group").agg(F.max(order)["feature"].alias("top_feature"))
    out = facts
    for more in (measured, spans, top):
        out = out.join(more.withColumnRenamed("group", "stratum"), "stratum", "left")  # a row a stratum
    return out.withColumn("excludes_zero", (F.col("ci_low") > 0) | (F.col("ci_high") < 0)).select(*[x.split()[0] for x in STRATUM_SCHEMA.split(", ")])


def zone_predictions(train: DataFrame, grid: DataFrame, zone: str, features: list[str], target: str, keys: list[str], params: Params, least: int = 30) -> DataFrame:
    """(keys, zone, prediction): each zone's cells scored by the model of the zone's sites; zones with few sites give none."""
    forests = forests_of_groups(train, zone, features, target, params, least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.full(len(pdf), np.nan)
            x = _matrix(pdf, features)
            for name, model in forests.items():
                at = np.flatnonzero((pdf[zone] == name).to_numpy() & ~np.isnan(x).any(axis=1))
                out[at] = model.predict(x[at])
            yield pdf[[*keys, zone]].assign(prediction=pd.Series(out, index=pdf.index).astype(object).where(~np.isnan(out), None))

    return grid.select(*keys, zone, *features).mapInPandas(run, grid.select(*keys, zone, F.lit(None).cast("double").alias("prediction")).schema)


def settings(configs: dict[str, tuple[tuple[str, ...], Params]] = CONFIGS) -> list[dict]:
    return [{"config": c, "features": list(f), **asdict(p)} for c, (f, p) in configs.items()]


def smaller(p: Params, n_estimators: int) -> Params:
    return replace(p, n_estimators=n_estimators)
