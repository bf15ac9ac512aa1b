"""Boosting on histograms, flat forests and polynomial attributions against plain versions."""

import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.operators import boosting, models, stats
from terralith.operators.boosting import Params, Run

DATA = os.environ.get("TERRALITH_TEST_DATA", "/root/testdata/sf0.01")


def data(n, seed=0, missing=0.0, values=25):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 4)) * values / 6) / values * 6
    y = x[:, 0] + np.sin(2 * x[:, 1]) + 0.3 * x[:, 2] * (x[:, 0] > 0) + r.normal(size=n) * 0.1
    x[r.random(x.shape) < missing] = np.nan
    return x.astype(np.float32), y


def plain_fit(x, y, p):
    """Each split by trying every value of every column; predictions for x."""
    pred = np.full(len(y), y.mean())
    for _ in range(p.n_estimators):
        g, out = pred - y, np.zeros(len(y))
        score = lambda rows: (np.sign(s := g[rows].sum()) * max(abs(s) - p.reg_alpha, 0)) ** 2 / (len(rows) + p.reg_lambda) if len(rows) else 0.0  # noqa: E731, B023

        def grow(rows, depth, g=g, out=out, score=score):
            s = g[rows].sum()
            best = (1e-9, None)
            if depth < p.max_depth and len(rows) > 1:
                for c in range(x.shape[1]):
                    v = x[rows, c]
                    for low, high in itertools.pairwise(np.unique(v[~np.isnan(v)])):
                        for to_left in (True, False):
                            left = np.where(np.isnan(v), to_left, v < np.float32((float(low) + float(high)) / 2))
                            a, b = rows[left], rows[~left]
                            if min(len(a), len(b)) < p.min_child_weight:
                                continue
                            gain = score(a) + score(b) - score(rows)
                            if gain > best[0] + 1e-7:
                                best = (gain, (a, b))
            if best[1] is None:
                out[rows] = -np.sign(s) * max(abs(s) - p.reg_alpha, 0) / (len(rows) + p.reg_lambda) * p.learning_rate
            else:
                for part in best[1]:
                    grow(part, depth + 1)

        grow(np.arange(len(y)), 0)
        pred = pred + out
    return pred


@pytest.mark.parametrize("missing", [0.0, 0.2])
def test_fit_is_the_greedy_fit(missing):
    x, y = data(150, missing=missing)
    p = Params(n_estimators=6, max_depth=3, subsample=1.0, colsample=1.0, min_child_weight=4)
    forest = models.fit_forest(x, y, list("abcd"), p)
    assert np.allclose(forest.predict(x), plain_fit(x, y, p), atol=1e-7)


def plain_attributions(forest, x):
    """Shapley values by all coalitions: a feature outside goes both ways, by cover."""
    table = forest.table()

    def value(tree, row, known, node=0):
        t = tree.iloc[node]
        if t.feature < 0:
            return t.value
        if t.feature in known:
            v = row[int(t.feature)]
            left = t.default_left if np.isnan(v) else v < np.float32(t.threshold)
            return value(tree, row, known, int(t.left if left else t.right))
        return sum(value(tree, row, known, int(c)) * tree.iloc[int(c)].cover for c in (t.left, t.right)) / t.cover

    m = len(forest.features)
    out = np.zeros((len(x), m))
    for _, tree in table.groupby("tree"):
        tree = tree.sort_values("node")
        for i, row in enumerate(x):
            worth = {s: value(tree, row, s) for k in range(m + 1) for s in itertools.combinations(range(m), k)}
            for f in range(m):
                for s in worth:
                    if f not in s:
                        w = math.factorial(len(s)) * math.factorial(m - 1 - len(s)) / math.factorial(m)
                        out[i, f] += w * (worth[tuple(sorted((*s, f)))] - worth[s])
    return out


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_attributions_are_shapley_values(depth):
    x, y = data(300, 2, missing=0.1)
    forest = models.fit_forest(x, y, list("abcd"), Params(n_estimators=2, max_depth=depth, min_child_weight=2))
    phi = forest.attributions(x[:6])
    assert np.allclose(phi, plain_attributions(forest, x[:6]), atol=1e-9)
    assert np.allclose(forest.attributions(x).sum(axis=1) + forest.expectation(), forest.predict(x))
    assert models.Forest(["a"], 1.5).predict(x[:2, :1]).tolist() == [1.5, 1.5] and not models.Forest(["a"], 1.5).attributions(x[:2, :1]).any()


def table(spark, n=900, missing=0.05):
    x, y = data(n, 5, missing, values=400)
    rows = [(i % 3, None if i % 50 == 0 else float(t), *(None if np.isnan(v) else float(v) for v in row)) for i, (row, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "part int, y double, a float, b float, c float, d float")


RUNS = [
    Run("all", ("a", "b", "c", "d"), Params(n_estimators=5, max_depth=3), frozenset({0, 1, 2})),
    Run("with missing", ("a", "b"), Params(n_estimators=3, max_depth=4, colsample=0.5), frozenset({1, 2}), complete=False),
    Run("early", ("a", "c"), Params(n_estimators=7, max_depth=2, learning_rate=0.9, early_stopping=1), frozenset({0}), frozenset({1})),
    Run("nothing", ("a",), Params(n_estimators=3), frozenset({9})),
]


def test_passes_and_tasks_give_the_same_trees(spark, monkeypatch):
    df = table(spark)
    here = boosting.fit_runs(df.repartition(3), "y", RUNS)
    passes = boosting.fit_runs(df.repartition(5).orderBy("y"), "y", RUNS, small_rows=0, refresh=2)
    for r in RUNS:
        assert here[r.name].base == passes[r.name].base
        assert here[r.name].rows == passes[r.name].rows
    assert here["nothing"].rows == [] and 0 < len({r[0] for r in here["early"].rows}) <= 7
    assert len({r[0] for r in here["all"].rows}) == 5


def test_bins(spark):
    df = spark.range(2_000).select((F.col("id") % 10).cast("float").alias("few"), F.col("id").cast("float").alias("many"), F.lit(None).cast("float").alias("none"))
    bins = boosting.bins_of(df, ["few", "many", "none"])
    assert bins["few"].exact and bins["few"].lowest.tolist() == list(range(10)) and not bins["many"].exact and not len(bins["none"].lowest)
    codes = bins["many"].codes(np.arange(2_000, dtype=np.float32))
    assert codes.max() == 254 and np.bincount(codes).max() < 20 and bins["many"].codes(np.array([np.nan])).tolist() == [255]
    for i in (3, 100):  # what lies below a cut has the lower codes
        assert ((np.arange(2_000) < bins["many"].cut(i, i + 1)) == (codes <= i)).all()


def test_an_empty_table_and_no_runs(spark):
    empty = table(spark, 3).limit(0)
    assert boosting.fit_runs(empty, "y", RUNS)["all"].rows == [] and boosting.fit_runs(empty, "y", []) == {}


def test_sweep_metrics_are_those_of_its_models(spark):
    df = table(spark, 600, 0.0).withColumn("block", F.col("part")).drop("part")
    folds = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "block int, fold int")
    other = table(spark, 90, 0.0)
    configs = {"trees": (("a", "b", "zz"), Params(n_estimators=4)), "ridge": (("a", "c"), models.Ridge(2.0))}
    got = {(r.config, r.fold): r for r in models.sweep(df, folds, "y", configs, other, replicates=200).collect()}
    assert set(got) == {(c, k) for c in configs for k in range(4)}
    rows, others = df.na.drop().toPandas(), other.na.drop().toPandas()
    for k in range(4):
        a, b = (rows, others) if k == 0 else (rows[rows.block != k - 1], rows[rows.block == k - 1])
        want = models.metrics(b.y.to_numpy(), models.ridge_predictions(a[["a", "c"]].to_numpy(), a.y.to_numpy(), b[["a", "c"]].to_numpy(), 2.0))
        r = got["ridge", k]
        assert (r.n_train, r.n_test, r.n_features, r.n_trees) == (len(a), len(b), 2, 0)
        assert all(math.isclose(r[m], want[m], rel_tol=1e-6, abs_tol=1e-9) for m in want)
        t = got["trees", k]
        assert (t.n_train, t.n_test, t.n_features, t.n_trees) == (len(a), len(b), 2, 4) and t.ci_low <= t.r2 <= t.ci_high


def test_shares_of_a_replicate_add_up():
    sizes, total = [5, 0, 17, 1, 40], np.full(4_000, 63)
    parts = np.stack([stats.share_of((1, 2), sizes, k, total) for k in range(5)])
    assert (parts.sum(axis=0) == 63).all() and (parts[1] == 0).all()
    assert np.allclose(parts.mean(axis=1), sizes, atol=0.4)
    assert np.allclose(parts.var(axis=1), [s * (1 - s / 63) for s in sizes], rtol=0.12, atol=0.05)


def test_resampled_r2(spark):
    r = np.random.default_rng(1)
    y = r.normal(size=400) + 1000
    p = y + r.normal(size=400) * 0.5
    rows = [("g", float(a), float(b)) for a, b in zip(y, p, strict=True)] + [("one", 1.0, 2.0), ("g", None, 1.0)]
    df = spark.createDataFrame(rows, "group string, y double, p double").repartition(7)
    got = {x.group: x for x in stats.resampled_r2(df, 2_000).collect()}
    boot = [models.metrics(y[i], p[i])["r2"] for i in (r.integers(0, 400, 400) for _ in range(2_000))]
    assert math.isclose(got["g"].ci_low, np.quantile(boot, 0.025), abs_tol=0.02) and math.isclose(got["g"].ci_high, np.quantile(boot, 0.975), abs_tol=0.02)
    assert got["one"].ci_low is None


def test_anomalies_over_one_baseline(spark):
    df = table(spark, 300, 0.0)
    fitted = models.fit_all(df, {"climate": (("a", "b"), Params(5)), "all": (("a", "b", "c", "d"), Params(5)), "base": (("a",), Params(5))}, "y")
    both = {n: fitted[n] for n in ("climate", "all")}
    rows = models.anomalies(df, both, fitted["base"]).collect()
    assert len({r.log_rs_climate == r.log_rs_baseline for r in rows} - {True}) == 1  # not one model twice
    assert all(math.isclose(r[f"anomaly_{n}"], math.exp(r[f"log_rs_{n}"] - r.log_rs_baseline)) for r in rows for n in both)
    with pytest.raises(ValueError, match="one name"):
        models.anomalies(df, both, fitted["base"], "climate")


def test_sums_by_codes_give_the_same_trees(spark, monkeypatch):
    """More rows than a task gets, but few different codes: no passes, and the trees of the rows themselves, also where one vector has most of the rows."""
    r = np.random.default_rng(8)
    x = r.integers(0, 4, (4000, 3)).astype(np.float32)
    x[r.random(4000) < 0.4] = 1
    x[::37, 2] = np.nan
    y = x[:, 0] * 2 + r.normal(size=4000) + 1e3
    rows = [(int(i % 3), None if i % 90 == 0 else float(t), *(None if np.isnan(v) else float(v) for v in f)) for i, (f, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "part int, y double, a float, b float, c float").repartition(5)
    runs = [
        Run("all", ("a", "b", "c"), Params(n_estimators=6, min_child_weight=2), frozenset({0, 1, 2})),
        Run("some", ("a", "b"), Params(n_estimators=4, max_depth=4, subsample=0.85), frozenset({1}), complete=False),
        Run("whole", ("c", "a"), Params(n_estimators=3, subsample=1.0, colsample=1.0), frozenset({0, 2})),
        Run("nothing", ("a",), Params(n_estimators=3), frozenset({9})),
    ]
    here = boosting.fit_runs(df, "y", runs)
    passes = boosting.fit_runs(df, "y", runs, small_rows=0, refresh=2)
    monkeypatch.setattr(boosting, "PIECE", 7)
    monkeypatch.setattr(boosting, "_in_passes", None)
    codes = boosting.fit_runs(df.repartition(3), "y", runs, small_rows=1000)
    for run in runs:
        assert here[run.name].base == passes[run.name].base == codes[run.name].base
        assert here[run.name].rows == passes[run.name].rows == codes[run.name].rows
    assert len(here["all"].rows) > 30
    v, at = np.array([2**53 + 1, -(2**53) - 3, 5], np.int64), np.array([0, 1, 0])
    assert boosting._added(at, v, 2).tolist() == [2**53 + 6, -(2**53) - 3]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_sites_are_dealt_to_all_cores(spark):
    """However few parts the file has, every later step has work for all cores."""
    from terralith.plans.models import training

    sites = training(spark, DATA)
    assert sites.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sites.select("rec").distinct().count() == spark.read.parquet(f"{DATA}/customer.parquet").count()


def test_rows_of_equal_features_are_attributed_once(spark):
    x, y = data(60, 3)
    forest = models.fit_forest(x, y, list("abcd"), Params(n_estimators=3, min_child_weight=2))
    many = np.arange(60) % 4 + 1
    rows = [("g", float(t), *map(float, f)) for f, t, m in zip(x, y, many, strict=True) for _ in range(m)]
    df = spark.createDataFrame(rows, "g string, y double, a float, b float, c float, d float").repartition(4)
    out = models.mean_attributions(df, "g", list("abcd"), "y", {"g": forest})
    got = {r["feature"]: (r["n"], r["importance"]) for r in out.collect()}
    want = many @ np.abs(forest.attributions(x)) / many.sum()
    assert all(got[f][0] == many.sum() and math.isclose(got[f][1], w, rel_tol=1e-9) for f, w in zip("abcd", want, strict=True))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2  # rows first, sums then


def test_tree_attributions_take_every_site(spark, tmp_path, monkeypatch):
    from terralith import registry
    from terralith.plans import models as plans

    monkeypatch.setattr(plans, "FULL", Params(n_estimators=5))
    customers = spark.range(4500).selectExpr("id as c_custkey", "id % 901 + 60d as c_acctbal", "'AUTOMOBILE' as c_mktsegment")
    customers.write.parquet(str(tmp_path / "customer.parquet"))
    got = registry.QUERIES["tree_attributions"](spark, str(tmp_path)).collect()
    sites = plans.training(spark, str(tmp_path))
    forest = models.fit(sites.filter("region = 'asia'"), plans.FEATURES, "log_rs", plans.FULL)
    x = sites.select(*plans.FEATURES).toPandas().to_numpy(np.float32)
    want = dict(zip(plans.FEATURES, np.abs(forest.attributions(x)).mean(axis=0), strict=True))
    assert len(x) == 4500 and [r["rank"] for r in sorted(got, key=lambda r: (-want[r["feature"]], r["feature"]))] == list(range(1, 9))
    assert all(math.isclose(r["importance"], want[r["feature"]], rel_tol=1e-9) for r in got)


def test_overall_attributions_leave_out_only_rows_without_a_feature(spark):
    x, y = data(60, 3)
    forest = models.fit_forest(x, y, list("abcd"), Params(n_estimators=3, min_child_weight=2))
    rows = [tuple(map(float, f)) for f in x] + [(None, 1.0, 1.0, 1.0), (1.0, float("nan"), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a float, b float, c float, d float").repartition(3)
    got = {r["feature"]: r["importance"] for r in models.overall_attributions(df, forest).collect()}
    known = x[~np.isnan(x).any(axis=1)]
    assert np.allclose([got[f] for f in "abcd"], np.abs(forest.attributions(known)).mean(axis=0))
    assert models.overall_attributions(df.limit(0), forest).count() == 0
