"""Every registered query with SQL against DuckDB on the same tables."""

import datetime
import math
import os

import duckdb
import pytest

from terralith import registry
from terralith.operators import models

DATA = os.environ.get("TERRALITH_TEST_DATA", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{f}')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 9) + 0.0
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    want = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    rows = lambda rs, cols: sorted((tuple(plain(dict(zip(cols, r, strict=True))[c]) for c in order) for r in rs), key=repr)
    a, b = rows([tuple(r) for r in got.collect()], got.columns), rows(want.fetchall(), names)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-9, abs_tol=2e-6)) for p, q in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", ["downsample_by_area", "zoom_rasters"])
def test_sql_covers_rasters_of_any_height(spark, tmp_path, name):
    """A raster of 25,000 rows, one cell in each: the SQL gives every target row that the query gives."""
    part = spark.range(25_000).selectExpr("id * 50 + id * 7 % 50 as p_partkey", "cast(id % 23 + 1 as int) as p_size", "900 + id % 9973 / 1e2 as p_retailprice")
    part.write.parquet(str(tmp_path / "part.parquet"))
    c = duckdb.connect()
    c.execute(f"create view part as select * from read_parquet('{tmp_path}/part.parquet/*.parquet')")
    got = registry.QUERIES[name](spark, str(tmp_path))
    cursor = c.execute(registry.ORACLES[name])
    assert got.columns == [d[0] for d in cursor.description]
    a, b = ({tuple(r[:-1]): r[-1] for r in rows} for rows in (got.collect(), cursor.fetchall()))
    assert max(k[-2] for k in a) >= 2000 and a.keys() == b.keys()
    assert all(a[k] is b[k] is None or math.isclose(a[k], b[k], abs_tol=2e-6) for k in a)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_gives_whole_rows(spark, name):
    """Every row in full, each column once, and columns that follow from others."""
    got = registry.QUERIES[name](spark, DATA)
    assert len({c.lower() for c in got.columns}) == len(got.columns)
    rows = got.collect()
    assert rows
    if name == "dual_anomaly":
        assert any(r.log_rs_climate != r.log_rs_baseline for r in rows)
        assert all(math.isclose(r[f"anomaly_{n}"], math.exp(r[f"log_rs_{n}"] - r.log_rs_baseline)) for r in rows for n in ("climate", "all"))
    if name == "anomaly_grid":
        assert all(math.isclose(r.anomaly, math.exp(r.log_rs_pred - r.log_rs_climate)) and math.isclose(r.rs_pred, math.exp(r.log_rs_pred)) for r in rows)
    if name == "tree_sweep":
        assert {(r.config, r.fold) for r in rows} == {(c, k) for c in models.CONFIGS if c != "Full_MODIS" for k in range(6)}
    if name == "full_modis":
        assert all(r.ci_low <= r.r2 <= r.ci_high for r in rows)
