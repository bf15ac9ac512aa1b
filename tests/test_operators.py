"""Truth tables, boundaries and properties of the operators."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terralith.functions import climate, geo, missing, scalar
from terralith.operators import checks, documents, ingest, models, neighbours, raster, stats
from terralith.sources import readers, sinks, synthetic

FEW = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first().asDict()


def lit(v, kind="double"):
    return F.lit(v).cast(kind)


@pytest.mark.parametrize(
    ("t", "p", "m", "q", "want"),
    [(None, 1, 1, 1, "?"), (20, 100, 0, 0, "BWh"), (5, 60, 0, 0, "BWk"), (20, 300, 0, 0, "BSh"), (5, 180, 0, 0, "BSk"), (18, 2000, 60, 0, "Af"), (25, 2000, 30, 0, "Am"), (25, 1000, 10, 0, "Aw"), (10, 1000, 0, 29, "Cwa"), (10, 1000, 0, 30, "Cfa"), (3, 900, 0, 49, "Dwa"), (3, 900, 0, 50, "Dfa"), (-3, 900, 0, 0, "Dfb"), (-38, 900, 0, 0, "Dfc"), (-39, 900, 0, 0, "ET")],
)
def test_zone_code(spark, t, p, m, q, want):
    assert one(spark, z=climate.zone_code(lit(t), lit(p), lit(m), lit(q)))["z"] == want


@pytest.mark.parametrize(("w", "c", "p", "m", "want"), [(None, 0, 0, 0, "unk"), (9.9, 0, 0, 0, "E"), (10, 0, 399, 29, "B"), (10, 0, 400, 29, "C"), (30, 18, 500, 50, "A"), (30, -3, 500, 50, "C"), (30, -3.1, 500, 50, "D")])
def test_zone_letter(spark, w, c, p, m, want):
    assert one(spark, z=climate.zone_letter(lit(w), lit(c), lit(p), lit(m)))["z"] == want


def test_scalars_at_boundaries(spark):
    r = one(
        spark,
        ph=scalar.ph_optimality(lit(14.0)), ph10=scalar.ph_optimality(lit(65.0)), none=scalar.ratio(lit(1.0), lit(-0.0)), dry=scalar.aridity(lit(5.0), lit(-10.0)),
        clip=scalar.clip(lit(None), 0.0, 1.0), half=geo.cell_id(lit(0.125), 0.05), block=geo.block_id(lit(-0.1), lit(4.9)), far=geo.haversine_km(lit(0.0), lit(0.0), lit(180.0), lit(0.0)),
        nums=F.to_json(scalar.floats_in(F.lit("a -1.5 b 2.25"))), soil=missing.positive_scaled(lit(0.0), 0.1), ext=missing.extreme_to_null(lit(2e9)),
    )
    assert r["ph"] == -7.5 and r["ph10"] == 0 and r["none"] is None and r["dry"] is None and r["clip"] is None
    assert r["half"] == 2 and r["block"] == -10_000 and math.isclose(r["far"], math.pi * 6371, rel_tol=1e-12)
    assert json.loads(r["nums"]) == [-1.5, 2.25] and r["soil"] is None and r["ext"] is None


def test_nan_never_stays(spark):
    df = spark.createDataFrame([(float("nan"), "NA"), (1.0, "x")], "a double, b string")
    out = missing.tokens_to_null(missing.nan_to_null(df)).collect()
    assert [tuple(r) for r in out] == [(None, None), (1.0, "x")]


def test_membership_keeps_missing(spark):
    df = spark.createDataFrame([("None",), ("Control",), ("Fert",), (None,)], "manipulation string")
    assert df.filter(missing.missing_or_in(F.col("manipulation"), ingest.UNMANIPULATED)).count() == 3


@FEW
@given(st.lists(st.tuples(st.floats(-179, 179), st.floats(-80, 80)), min_size=1, max_size=40))
def test_dedup_is_idempotent(spark, points):
    df = spark.createDataFrame([(i, "s", x, y) for i, (x, y) in enumerate(points)], "site_id int, source string, longitude double, latitude double")
    once = ingest.dedup_cells(df, 1.0)
    twice = ingest.dedup_cells(once, 1.0)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    cells = [(round(r["longitude"]), round(r["latitude"])) for r in once.collect()]
    assert len(cells) == len(set(cells))


def test_canonical_schema(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "k int, LAT double, Lon double, annual_RS double")
    assert ingest.canonical_sites(df, key="k").first().asDict() == {"site_id": "cosore_1", "source": "cosore", "longitude": 3.0, "latitude": 2.0, "rs_annual": 4.0}
    with pytest.raises(ValueError, match="rs_annual"):
        ingest.canonical_sites(df.drop("annual_RS"))
    with pytest.raises(ValueError, match="missing"):
        ingest.keep_present(df, ["nope"], [])


def test_folds_differ_by_one(spark):
    blocks = spark.range(558).select(F.col("id").alias("block"))
    sizes = sorted(r["n"] for r in stats.fold_ids(blocks).groupBy("fold").agg(F.count("*").alias("n")).collect())
    assert sizes == [111, 111, 112, 112, 112]


def test_r2_and_spearman(spark):
    df = spark.createDataFrame([(float(i), float(i), float(i) ** 3) for i in range(1, 30)], "y double, p double, m double")
    assert df.agg(stats.r2(F.col("y"), F.col("p")).alias("r")).first()["r"] == 1
    a = stats.spearman(df.withColumn("g", F.lit(1)), ["g"], "y", "m").first()["rho"]
    assert math.isclose(a, 1)
    assert df.agg(stats.r2(F.col("y"), F.col("m")).alias("r")).first()["r"] < 0


def test_bootstrap_draws_like_a_bootstrap(spark):
    n, reps = 400, 60
    d = spark.range(reps).withColumnRenamed("id", "rep").crossJoin(spark.range(n).withColumnRenamed("id", "k")).select("rep", stats.draw(F.col("rep"), F.col("k"), F.lit(n)).alias("i"))
    share = d.groupBy("rep").agg((F.countDistinct("i") / n).alias("s")).toPandas()["s"]
    assert abs(share.mean() - 0.632) < 0.02 and share.min() > 0.5


def test_bootstrap_deals_its_draws(spark, monkeypatch):
    n, reps = 5_000, 3
    r = np.random.default_rng(4)
    y = r.normal(size=n) + 1e4
    p = y + r.normal(size=n) * 0.5
    df = spark.createDataFrame([(7 * i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p, strict=True))], "id long, y double, p double").repartition(5)
    monkeypatch.setattr(stats, "PIECE", 700)  # several pieces and blocks
    monkeypatch.setattr(stats, "MOST_DRAWS", 0)
    boot = stats.bootstrap_r2(df, "id", reps)
    plan = boot._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "sequence(" not in plan  # neither the table nor a replicate in one place
    got = {x["rep"]: x["r2"] for x in boot.collect()}
    for rep in range(reps):
        i = stats.draw_numbers(rep, np.arange(n), n)
        want = 1 - ((y[i] - p[i]) ** 2).sum() / ((y[i] - y[i].mean()) ** 2).sum()
        assert math.isclose(got[rep], want, rel_tol=1e-9)
    d = spark.range(n).select(stats.draw(F.lit(2).cast("long"), F.col("id"), F.lit(n)).alias("i")).toPandas()["i"]
    assert d.tolist() == stats.draw_numbers(2, np.arange(n), n).tolist()
    assert stats.bootstrap_r2(df.filter("id < 0"), "id", reps).count() == 0


def test_ranks_of_values_that_change_when_computed_again(spark):
    def noise(batches):
        for pdf in batches:
            yield pdf.assign(p=np.random.default_rng().random(len(pdf)))

    df = spark.range(200).select(F.when(F.col("id") % 4 == 0, F.lit("x")).alias("g"), F.col("id").cast("double").alias("y"))
    got = {r["g"]: r["n"] for r in stats.spearman(df.mapInPandas(noise, "g string, y double, p double"), ["g"]).collect()}
    assert got == {None: 150, "x": 50}


def test_exact_quantiles_hold_no_table_in_one_place(spark):
    r = np.random.default_rng(3)
    rows = [(None if i % 5 == 0 else i % 3, None if i % 11 == 0 else float(round(v, 1))) for i, v in enumerate(r.normal(size=700) * 4)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(3)
    at = {"low": 0.05, "mid": 0.5, "high": 0.95, "top": 1.0}
    got = stats.exact_quantiles(df, "v", at, ("g",))
    want = df.groupBy("g").agg(*[F.percentile("v", q).alias(n) for n, q in at.items()])
    plain = lambda d: sorted((repr(x["g"]), *[round(x[n], 9) for n in at]) for x in d.collect())
    assert plain(got) == plain(want)
    for out in (got, stats.describe(df, "v"), stats.regression_metrics(df.withColumn("p", F.col("v") + 1), ["g"], "v", "p")):
        assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()
    none = stats.exact_quantiles(df.filter("v > 1e9"), "v", at).first()
    assert [none[n] for n in at] == [None] * 4
    d = stats.describe(df, "v").first()
    assert math.isclose(d["p25"], df.agg(F.percentile("v", 0.25)).first()[0], abs_tol=1e-12)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (1.1,), (None,)], "x double")
    assert {r["bin"]: r["n"] for r in stats.histogram(df, "x", 0.0, 1.0, 2).collect()} == {0: 1, 1: 2}


def test_flux_thresholds(spark):
    rows = [(1, f"2024-01-{d:02d} 00:00:00", 100.0) for d in range(1, 29)] + [(2, "2024-01-01 00:00:00", 1.0)]
    df = spark.createDataFrame(rows, "port int, t string, flux double").withColumn("t", F.to_timestamp("t"))
    got = ingest.integrate_flux(df, least_days=28, least_span=27).collect()
    assert [(r["port"], r["n_days"], r["mean_flux"]) for r in got] == [(1, 28, 50.0)]


def test_nearest_both_ways(spark, monkeypatch):
    rng = np.random.default_rng(1)
    cells = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-179, 179, 60), rng.uniform(-85, 85, 60), strict=True))], "cell int, longitude double, latitude double")
    refs = spark.createDataFrame([(i, float(x), float(y), i * 2) for i, (x, y) in enumerate(zip(rng.uniform(-179, 179, 80), rng.uniform(-85, 85, 80), strict=True))], "ref int, longitude double, latitude double, soc int")
    a = neighbours.nearest_reference(cells, refs, "cell", "ref", ("soc",)).collect()
    monkeypatch.setattr(neighbours, "MOST_BROADCAST", 5)
    b = neighbours.nearest_reference(cells, refs, "cell", "ref", ("soc",)).collect()
    assert sorted((r["cell"], r["ref"], r["soc"]) for r in a) == sorted((r["cell"], r["ref"], r["soc"]) for r in b)


def test_nearest_of_repeated_missing_and_tied_rows(spark, monkeypatch):
    """Both ways keep every row; ties go to the smaller key; a cell without a position or a key is a row like any other."""
    cells = spark.createDataFrame([(1, 10.0, 0.0), (1, 10.0, 0.0), (2, None, 5.0), (None, 179.9, 89.0), (3, -179.5, 0.2), (4, 60.0, -80.0)], "cell int, longitude double, latitude double")
    refs = spark.createDataFrame([(7, 9.0, 0.0, "b"), (5, 11.0, 0.0, "a"), (9, 179.5, 0.2, "c"), (11, -10.0, 88.0, None), (12, None, 1.0, "x"), (None, 10.0, 0.0, "y")], "ref int, longitude double, latitude double, name string")
    want = [(None, 11, None), (1, 5, "a"), (1, 5, "a"), (2, None, None), (3, 9, "c"), (4, 5, "a")]
    for most in (2_000, 0):
        monkeypatch.setattr(neighbours, "MOST_BROADCAST", most)
        got = neighbours.nearest_reference(cells, refs, "cell", "ref", ("name",)).collect()
        assert sorted(((r["cell"], r["ref"], r["name"]) for r in got), key=repr) == sorted(want, key=repr)
        none = neighbours.nearest_reference(cells, refs.limit(0), "cell", "ref").collect()
        assert len(none) == 6 and {r["ref"] for r in none} == {None}


def test_raster_pieces(spark):
    g = raster.make_grid(spark, 0.0, 0.0, 4.0, 2.0, 1.0)
    assert g.count() == 8
    cells = spark.createDataFrame([(r, c, float(r * 4 + c)) for r in range(4) for c in range(4)], "row int, col int, v double")
    top = raster.pyramid(cells, "v", 3).filter("level = 2").collect()
    assert [r["v"] for r in top] == [7.5]
    t = spark.createDataFrame([(0.5, 0.5), (3.0, 3.5), (9.0, 9.0)], "y double, x double")
    assert [r["v"] for r in raster.bilinear(t, cells, "v").orderBy("y").collect()] == [2.5, 15.0, None]
    pts = spark.createDataFrame([(0, 0.5, 1.5, 1.0), (1, 0.5, 1.5, 2.0), (2, 9.0, 9.0, 3.0)], "seq int, longitude double, latitude double, v double")
    grid = raster.Grid(0.0, 2.0, 1.0, 1.0, 4, 2)
    assert [tuple(r) for r in raster.rasterise(pts, grid, "v", ["seq"]).collect()] == [(0, 0, 2.0)]
    rows = {r["row"]: r["values"] for r in raster.dense_rows(cells.filter("not (row = 1 and col = 2)"), "v").collect()}
    assert rows[1] == [4.0, 5.0, None, 7.0]
    assert one(spark, a=geo.in_polygon(lit(0.5), lit(0.5), [(0, 0), (1, 0), (1, 1), (0, 1)]), b=geo.in_polygon(lit(1.5), lit(0.5), [(0, 0), (1, 0), (1, 1), (0, 1)])) == {"a": True, "b": False}


def test_forest_properties():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4)).astype(np.float32)
    x[rng.random(x.shape) < 0.05] = np.nan
    y = np.nan_to_num(x[:, 0]) * 2 + (np.nan_to_num(x[:, 1]) > 0) + rng.normal(0, 0.1, 400)
    p = models.Params(n_estimators=40, min_child_weight=3)
    f = models.fit_forest(x, y, list("abcd"), p)
    pred = f.predict(x)
    assert models.metrics(y, pred)["r2"] > 0.8
    phi = f.attributions(x[:50])
    assert np.allclose(phi.sum(axis=1) + f.expectation(), pred[:50], atol=1e-6)
    stump = models.fit_forest(np.array([[0.0], [1.0], [2.0], [3.0]]), np.array([0.0, 0.0, 1.0, 1.0]), ["x"], models.Params(1, 1, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0))
    assert stump.predict(np.array([[0.0], [3.0]])).tolist() == [0.0, 1.0] and stump.rows[0][3] == 1.5
    early = models.fit_forest(x[:200], y[:200], list("abcd"), models.Params(n_estimators=200, learning_rate=0.5, early_stopping=5), (x[200:], y[200:]))
    assert len({r[0] for r in early.rows}) < 200


def test_score_keeps_missing_rows(spark, tmp_path):
    s = synthetic.sites(spark, 300)
    m = models.fit(s, ["bio01", "bio12"], "log_rs_annual", models.Params(n_estimators=20))
    df = spark.createDataFrame([(1, 10.0, 900.0), (2, None, 900.0)], "k int, bio01 double, bio12 double")
    got = {r["k"]: r["p"] for r in models.score(df, {"p": m}).collect()}
    assert got[1] is not None and got[2] is None
    sinks.write_forest(spark, m, str(tmp_path / "m"))
    again = readers.read_forest(spark, str(tmp_path / "m"), ["bio01", "bio12"])
    x = np.array([[10.0, 900.0]])
    assert np.isclose(again.predict(x), m.predict(x)).all()
    with pytest.raises(ValueError, match="order"):
        readers.read_forest(spark, str(tmp_path / "m"), ["bio12", "bio01"])


def test_stratum_attributions_take_every_row(spark):
    # the 400 rows of smallest target are led by "a", the stratum as a whole by "b"
    rows = [(float(k < 400), float(k % 2), 5.0 * (k % 2) - 6.0 * (k < 400), False) for k in range(2000)]
    rows += [(float(k % 5 == 0), float(k % 2), 5.0 * (k % 2) - 6.0 * (k % 5 == 0), True) for k in range(60)]
    df = spark.createDataFrame([("z", *r) for r in rows], "zone string, a double, b double, y double, us boolean")
    got = models.stratified_transfer(df, "zone", F.col("us"), ["a", "b"], "y", models.Params(n_estimators=40, colsample=1.0), replicates=20).collect()
    assert [(r["n_a"], r["n_b"], r["top_feature"]) for r in got] == [(2000, 60, "b")]


def test_pooled_stratum_and_published_settings(spark):
    from terralith.plans import models as plans

    rows = [(z, float(k % 7), float(k % 7) + (z == "q"), k % 3 == 0) for z in ("p", "q", None) for k in range(60)]
    df = spark.createDataFrame(rows, "zone string, a double, y double, us boolean")
    got = models.stratified_transfer(df, "zone", F.col("us"), ["a"], "y", models.Params(n_estimators=5), 20, 10, 20, pooled="all").collect()
    assert {r["stratum"]: (r["n_a"], r["n_b"]) for r in got} == {"p": (40, 20), "q": (40, 20), "all": (120, 60)}
    assert plans.FULL == models.CONFIGS["F_climate_only"][1] and plans.BASELINE == models.BASELINE_PARAMS


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(100, 3)) * [1, 5, 0.1] + [3, 2, 1]
    y = x @ [1, -2, 3] + rng.normal(0, 0.1, 100)
    df = spark.createDataFrame(pd.DataFrame(np.c_[x, y], columns=list("abcy")))
    c = stats.solve_ridge(stats.ridge_sums(df, list("abc"), "y").first().asDict(), list("abc"), 5.0)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 5 * np.eye(3), z.T @ (y - y.mean())) / x.std(0)
    assert np.allclose([c[k] for k in "abc"], w)


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,NA,x\n2,3.5,nan\n")
    df = readers.read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"a": "double", "b": "double", "c": "string"}
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1.0, None, "x"), (2.0, 3.5, None)]
    with pytest.raises(FileNotFoundError):
        readers.read_csv(spark, str(tmp_path / "none.csv"))
    assert readers.read_first(spark, str(tmp_path)) is None
    for name, text in (("D1", "CSR_LATITUDE: 1\n# no\nCSR_SITE: a: b\nCSR_LATITUDE: 2\n"), ("TEST9", "CSR_LATITUDE: 7\n")):
        (tmp_path / "d" / name).mkdir(parents=True)
        (tmp_path / "d" / name / "DESCRIPTION.txt").write_text(text)
        (tmp_path / "d" / name / "data.csv").write_text("CSR_PORT,CSR_TIMESTAMP_BEGIN,CSR_FLUX_CO2\n1,0,2.5\n1,bad,3\n")
    got = {(r["dataset"], r["field"]): r["value"] for r in readers.read_descriptions(spark, str(tmp_path / "d/*/DESCRIPTION.txt")).collect()}
    assert got == {("D1", "CSR_LATITUDE"): "2", ("D1", "CSR_SITE"): "a: b"}
    flux = readers.read_flux(spark, str(tmp_path / "d/*/data.csv")).collect()
    assert [(r["dataset"], r["port"], r["flux"]) for r in flux] == [("D1", 1, 2.5)]
    layers = readers.registry(spark, str(tmp_path), "asia")
    assert layers.count() == 20
    (tmp_path / "soilgrids").mkdir()
    (tmp_path / "soilgrids" / "soc_5-15cm_asia_5km.tif").write_bytes(b"x" * 2000)
    assert [r["feature"] for r in readers.present_layers(layers, readers.listing(spark, str(tmp_path / "soilgrids"))).collect()] == ["soc"]
    (tmp_path / "ocp.txt").write_bytes(b"Jan. 5, 2026\r\nInit E = 1\r\n\r\nTime/sec, Potential/V\r\n\r\n0.1, -2.5e-1\r\n0.2, 0.3\r\n0.3, 0.")
    assert [(r["x"], r["y"]) for r in readers.read_traces(spark, str(tmp_path / "ocp.txt")).orderBy("x").collect()][:2] == [(0.1, -0.25), (0.2, 0.3)]
    assert readers.rings_of_wkt("POLYGON ((0 0, 1 0, 1 1, 0 0))") == readers.rings_of_geojson('{"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}')
    rgba = np.random.default_rng(0).integers(0, 255, (5, 7, 4)).astype(np.uint8)
    assert (readers.decode_png(sinks.encode_png(rgba)) == rgba).all()
    (tmp_path / "p.png").write_bytes(sinks.encode_png(rgba))
    assert readers.read_pictures(spark, str(tmp_path / "p.png")).count() == 35
    tif = sinks.geotiff(np.array([[1.0, np.nan]]), 0, 1, 1, 1)
    assert tif[:4] == b"II*\0" and np.frombuffer(__import__("zlib").decompress(tif[-len(tif) :][tif.rfind(b"x\x9c") :]), "<f4").tolist() == [1.0, -9999.0]
    assert sinks.markdown(spark.createDataFrame([(1, 0.12345, None)], "a int, b double, c string")).splitlines()[-1] == "| 1 | 0.123 |  |"
    assert sinks.write_if_absent(df, str(tmp_path / "w")) and not sinks.write_if_absent(df, str(tmp_path / "w"))
    px = spark.createDataFrame([(0, 0, 0, i, j, 1, 2, 3, 255) for i in range(2) for j in range(2)], "zoom int, tx int, ty int, ix int, iy int, r int, g int, b int, a int")
    blobs = sinks.tile_blobs(px, 2)
    assert sinks.write_mbtiles(blobs, str(tmp_path / "t.mbtiles"), "n") == 1 and json.loads(sinks.tilejson(blobs, "n", [0, 0, 1, 1], "u"))["maxzoom"] == 0
    assert sinks.geotiff_blocks(spark.createDataFrame([(0, 0, 1.0)], "row int, col int, v double"), "v", 0, 1, 1, 1, 4).count() == 1


def test_rasters_come_back(spark, tmp_path):
    v = np.arange(70 * 9, dtype=float).reshape(70, 9)
    v[3, 4] = np.nan
    (tmp_path / "a.tif").write_bytes(sinks.geotiff(v, 10.0, 50.0, 0.5, 0.25))
    got = {(r["row"], r["col"]): r for r in readers.read_geotiff(spark, str(tmp_path / "a.tif")).collect()}
    assert len(got) == v.size and got[3, 4]["value"] is None and got[69, 8]["value"] == v[69, 8]
    assert (got[0, 0]["longitude"], got[2, 3]["latitude"]) == (10.25, 50.0 - 2.5 * 0.25)
    some = readers.read_geotiff(spark, str(tmp_path / "a.tif"), window=(60, 2, 6, 3)).collect()
    assert sorted((r["row"], r["col"], r["value"]) for r in some) == [(r, c, v[r, c]) for r in range(60, 66) for c in range(2, 5)]
    rgba = np.random.default_rng(0).integers(0, 256, (5, 6, 4), dtype=np.uint8)
    for band in range(4):
        (_, _, x), *_ = readers.tiff_blocks(sinks.geotiff(rgba, 0, 1, 1, 1), band + 1)
        assert (x == rgba[:, :, band]).all()
    db = tmp_path / "t.mbtiles"
    sinks.write_mbtiles(spark.createDataFrame([(1, 0, 1, bytearray(b"x")), (0, 0, 0, bytearray(b"y"))], "zoom int, tx int, ty int, data binary"), str(db), "n")
    assert sorted((r["zoom"], r["tx"], r["ty"], bytes(r["data"])) for r in readers.read_mbtiles(spark, str(db)).collect()) == [(0, 0, 0, b"y"), (1, 0, 1, b"x")]


def test_lzw_of_rasters():
    def pack(data):  # the plain textbook encoder
        table, out, w = {bytes([i]): i for i in range(256)}, [(256, 9)], b""
        size, width = 258, 9
        for b in data:
            if w + bytes([b]) in table:
                w += bytes([b])
                continue
            out.append((table[w], width))
            table[w + bytes([b])] = size
            size += 1
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
            w = bytes([b])
        out += [(table[w], width), (257, 9 if size + 1 < 512 else 10 if size + 1 < 1024 else 11 if size + 1 < 2048 else 12)]
        bits = "".join(f"{c:0{n}b}" for c, n in out)
        bits += "0" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))

    for data in (b"aaaaaaa", b"-----A---B", bytes(range(256)) * 4, np.random.default_rng(1).integers(0, 9, 3000, dtype=np.uint8).tobytes()):
        assert readers.lzw_decode(pack(data)) == data


def test_ridge_among_the_models():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3)) * [1, 5, 0.1]
    y = x @ [1.0, -2.0, 3.0] + 4
    assert np.allclose(models.ridge_predictions(x, y, x[:5], 1e-9), y[:5])


def test_buckets_stay_even_beside_an_outlier(spark):
    df = spark.createDataFrame([(float(k % 700),) for k in range(3000)] + [(1e12,)], "v double")
    from terralith.operators import ranks

    got = sorted((r["v"], r["before"]) for r in ranks.before(df, [], "v", buckets=16).collect())
    assert [b for _, b in got] == list(range(3001))


def test_wide_attributions_equal_long_ones(spark):
    s = synthetic.sites(spark, 200)
    m = models.fit(s, ["bio01", "bio12"], "log_rs_annual", models.Params(n_estimators=10))
    rows = s.select("site_id", F.when(F.col("site_id") != "site_3", F.col("bio01")).alias("bio01"), "bio12")
    wide = {(r["site_id"], f): r[f"phi_{f}"] for r in models.attribute_wide(rows, m).collect() for f in m.features}
    long = {(r["site_id"], r["feature"]): r["value"] for r in models.attribute(rows, m, ["site_id"]).collect()}
    assert wide["site_3", "bio01"] is None and {k: v for k, v in wide.items() if v is not None} == long


def test_synthetic_is_stable(spark):
    a = synthetic.sites(spark, 200)
    b = synthetic.sites(spark, 200).repartition(7)
    assert sorted(map(tuple, a.select("site_id", "rs_annual").collect())) == sorted(map(tuple, b.select("site_id", "rs_annual").collect()))
    assert a.filter("longitude < 0").count() == 50
    field = synthetic.anomaly_field(raster.make_grid(spark, 25.0, -10.0, 180.0, 80.0, 5.0))
    assert field.agg(F.min("anomaly"), F.max("anomaly")).first()[0] >= 0.5
    assert synthetic.grid(spark, 10.0).count() > 0


def test_gates(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "row int, col int, v double")
    rows = checks.base_raster_gate(cells, 2, 1)
    assert checks.tally(rows).first()["all_pass"]
    with pytest.raises(AssertionError, match="width"):
        checks.require(checks.base_raster_gate(cells, 3, 1))
    doc = json.loads(documents.as_json_lines(documents.cell_document(cells.withColumn("b", F.lit("x")), "row", "b", "v", ["v", "col"])).first()[0])
    assert doc["fnpp"]["top3"][0]["feature"] == "v"
    assert json.loads(documents.header({"resolution_deg": 1}, {}, 3))["grid"]["n_cells"] == 3
    files = spark.createDataFrame([("/a/x.tif", 5000)], "path string, length long")
    wanted = spark.createDataFrame([("x.tif",), ("y.tif",)], "file string")
    assert {r["name"]: r["pass"] for r in checks.inputs_gate(files, wanted).collect()} == {"x.tif": True, "y.tif": False}


@FEW
@given(st.lists(st.tuples(st.integers(0, 2), st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=60))
def test_running_counts_and_parts(spark, rows):
    from terralith.operators import ranks

    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(rows)], "i int, g int, v double")
    got = {r["i"]: r["before"] for r in ranks.before(df, ["g"], "v", ties=("i",), buckets=7).collect()}
    for i, (g, v) in enumerate(rows):
        assert got[i] == sum((h == g) and (w, j) < (v, i) for j, (h, w) in enumerate(rows))
    parts = [r["fold"] for r in ranks.even_parts(df, "v", 5, ("i",)).orderBy("v", "i").collect()]
    assert parts == [int(k) + 1 for k, part in enumerate(np.array_split(np.arange(len(rows)), 5)) for _ in part]


def test_area_average(spark):
    r = np.random.default_rng(3)
    a = r.normal(size=(11, 7))
    a[r.random(a.shape) < 0.3] = np.nan
    a[:3, :3] = np.nan
    df = spark.createDataFrame([(i, j, None if np.isnan(a[i, j]) else float(a[i, j])) for i in range(11) for j in range(7)], "row int, col int, v double").repartition(3)
    for fr, fc in ((1.0, 1.0), (2.0, 3.0), (2.7, 1.4), (4.0, 6.5), (20.0, 30.0)):
        got = {(x.row, x.col): x.v for x in raster.area_average(df, "v", 11, 7, fr, fc).collect()}
        n, m = max(1, round(11 / fr)), max(1, round(7 / fc))
        assert set(got) <= {(i, j) for i in range(n) for j in range(m)}
        for i in range(n):
            for j in range(m):
                wr = np.clip(np.minimum(np.arange(11) + 1, (i + 1) * fr) - np.maximum(np.arange(11), i * fr), 0, None)
                wc = np.clip(np.minimum(np.arange(7) + 1, (j + 1) * fc) - np.maximum(np.arange(7), j * fc), 0, None)
                w = np.outer(wr, wc) * ~np.isnan(a)
                want = (w * np.nan_to_num(a)).sum() / w.sum() if w.sum() > 1e-9 else None
                assert got.get((i, j)) is want is None or np.isclose(got[i, j], want), (fr, fc, i, j)
    with pytest.raises(ValueError, match="smaller"):
        raster.area_average(df, "v", 11, 7, 0.5, 2.0)
    assert raster.area_average(df.limit(0), "v", 11, 7, 2.0, 2.0).count() == 0


def test_counts_of_frequent_values_and_the_table_of_a_sweep(spark):
    from terralith.operators import ingest, stats

    df = spark.createDataFrame([(v,) for v in [3, 3, 1, 1, 2, 2, 2, 9, None, None]], "v int")
    assert [tuple(r) for r in ingest.value_counts(df, "v", top=2, by_key=True).collect()] == [(1, 2), (2, 3)]  # 1 and 3 tie
    assert [tuple(r) for r in ingest.value_counts(df, "v", by_key=True).collect()] == [(1, 2), (2, 3), (3, 2), (9, 1)]
    assert ingest.value_counts(df.limit(0), "v", top=8, by_key=True).count() == 0
    runs = spark.createDataFrame([("a", 20, 0.5125, "x"), ("b", 8, 0.25, "x"), ("c", None, None, None)], "config string, n_features int, r2 double, _base string")
    got = {r["config"]: r for r in stats.configuration_table(runs, "b", ["r2"], "r2").collect()}
    assert (got["a"]["features_kind"], got["a"]["r2"], got["a"]["delta_r2"]) == ("all (incl. clay/sand/silt)", 0.512, 0.262)
    assert got["b"]["features_kind"] == "selected (8 features)" and got["b"]["delta_r2"] == 0 and got["c"]["features_kind"] is None and got["c"]["delta_r2"] is None
    assert {r["delta_r2"] for r in stats.configuration_table(runs, "none", ["r2"], "r2").collect()} == {None}
    assert stats.configuration_table(runs.limit(0), "b", ["r2"], "r2").count() == 0


def test_seam_gate(spark):
    from terralith.operators import checks

    kind = "axis string, ty int, tx int, pairs long, difference double"
    some = lambda *d: spark.createDataFrame([("down", 0, k, n, x) for k, (n, x) in enumerate(d)], kind)
    tiles = spark.createDataFrame([(255,), (255,), (0,)], "a int")
    said = lambda *args: {r["name"]: r["pass"] for r in checks.seam_gate(*args).collect()}
    assert said(some((40, 5.0), (3, 200.0)), some((9, 4.0)), tiles) == {"seams": True, "continuity": True, "coverage": True}  # the seam of three pairs does not count
    assert not said(some((40, 90.0)), some((9, 20.0)), tiles)["continuity"] and said(some((40, 90.0)), some((9, 60.0)), tiles)["continuity"]
    assert not said(some((3, 200.0)), some((9, 4.0)), tiles)["continuity"]  # no seam has enough pairs: all count
    assert said(some(), some(), tiles.limit(0)) == {"seams": False, "continuity": False, "coverage": False}
