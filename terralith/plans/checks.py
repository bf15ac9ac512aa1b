"""Queries of the data-quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks
from ..registry import query
from ..session import table
from .rasters import cells, grid_of, pixels
from .views import view


@query("gate_base_raster", """with m as (select count(*) as n, count(v) as finite, max(c) + 1 as w, max(r) + 1 as h, min(v) as lo, max(v) as hi, avg(v) as mean, stddev_samp(v) as std from v_cells)
select 'base_raster' as gate, name, pass from m, lateral (values ('has_rows', n > 0), ('has_values', finite > 0), ('width', w = 50), ('height', h = n // 50), ('minimum', lo >= 0), ('maximum', hi <= 2000), ('mean_in_range', mean between 0 and 2000), ('spread', std > 0.01e0)) t(name, pass)""")
def _(spark, sf):
    return checks.base_raster_gate(cells(spark, sf), 50, grid_of(spark, sf).height, high=2000.0).select("gate", "name", "pass")


@query("gate_tally", "with m as (select count(*) filter (where a > 0) as seen, count(distinct (r, g, b)) filter (where a > 0) as colours, avg((greatest(r, g, b) - least(r, g, b)) / (greatest(r, g, b) + 1e-6)) filter (where a > 0 and abs(ratio - 1) < 2e-2) as near, avg((greatest(r, g, b) - least(r, g, b)) / (greatest(r, g, b) + 1e-6)) filter (where a > 0 and (ratio < 0.85e0 or ratio > 1.15e0)) as far from v_px) select 'picture' as gate, cast(seen > 1000 as bigint) + cast(colours > 100 as bigint) + cast(near < far as bigint) as n_pass, cast(3 as bigint) as n, seen > 1000 and colours > 100 and near < far as all_pass from m")
def _(spark, sf):
    return checks.tally(checks.picture_gate(pixels(spark, sf), 1000, 100))


@query("gate_spots", """with spots(spot, direction, at_row, at_col, low, high) as (values ('a', 'below', 10, 10, 1.5e3, 0e0), ('b', 'above', 20, 25, 0e0, 1.2e3), ('c', 'between', 30, 40, 1e3, 1.6e3)),
p as (select spot, direction, low, high, avg(v) as mean, count(v) / count(*) as share from v_cells, spots where r between at_row - 10 and at_row + 10 and c between at_col - 10 and at_col + 10 group by all)
select spot, round(mean, 6) as mean, round(share, 6) as share, (case direction when 'below' then mean < low when 'above' then mean > high else mean between low and high end) and share >= 0.25e0 as pass from p""")
def _(spark, sf):
    spots = spark.createDataFrame([("a", "below", 10, 10, 1500.0, 0.0), ("b", "above", 20, 25, 0.0, 1200.0), ("c", "between", 30, 40, 1000.0, 1600.0)], "spot string, direction string, at_row int, at_col int, low double, high double")
    return checks.spot_checks(cells(spark, sf), spots).select("spot", F.round("mean", 6).alias("mean"), F.round("share", 6).alias("share"), "pass")


@query("gate_tiles", "with t as (select cast(p_size % 7 as int) as zoom, p_partkey * 10 as bytes from part), m as (select count(*) as n, min(zoom) as lo, max(zoom) as hi, count(distinct zoom) as levels, sum(bytes) as bytes from t) select 'tiles' as gate, name, pass from m, lateral (values ('count', n between 300 and 5000000), ('levels', levels = 7 and lo = 0 and hi = 6), ('bytes', bytes < 1e12)) x(name, pass)")
def _(spark, sf):
    t = table(spark, sf, "part").select((F.col("p_size") % 7).cast("int").alias("zoom"), (F.col("p_partkey") * 10).alias("bytes"))
    return checks.tile_gate(t, 7, 300, 5_000_000, 10**12).select("gate", "name", "pass")


@query("gate_zoom_quantiles", "with q as (select [quantile_cont(v, 0.05), quantile_cont(v, 0.25), quantile_cont(v, 0.5), quantile_cont(v, 0.75), quantile_cont(v, 0.95)] as a from v_cells), d as (select avg(v) as v from v_cells group by floor(r / 2e0), floor(c / 2e0)), p as (select [quantile_cont(v, 0.05), quantile_cont(v, 0.25), quantile_cont(v, 0.5), quantile_cont(v, 0.75), quantile_cont(v, 0.95)] as b from d) select round(greatest(abs(a[1] - b[1]), abs(a[2] - b[2]), abs(a[3] - b[3]), abs(a[4] - b[4]), abs(a[5] - b[5])), 6) as distance from q, p")
def _(spark, sf):
    from ..operators.raster import downsample

    c = cells(spark, sf)
    return checks.quantile_distance(c, downsample(c, "v", 2), "v").select(F.round("distance", 6).alias("distance"))


@query("total_bytes", "select count(*) as n, cast(sum(octet_length(encode(p_name))) as bigint) as bytes from part")
def _(spark, sf):
    return table(spark, sf, "part").agg(F.count("*").alias("n"), F.sum(F.octet_length("p_name")).alias("bytes"))


@query("required_columns", "select 'rs_annual' as name, true as present union all select 'koppen', false")
def _(spark, sf):
    have = set(view(spark, sf, "v_sites").columns)
    return spark.createDataFrame([(c, c in have) for c in ("rs_annual", "koppen")], "name string, present boolean")


@query("gate_table", "with m as (select count(*) as n, count_if(rs_annual is not null and longitude is not null) as complete, count_if(contains(source, 'synthetic')) as made from v_sites) select 'sites' as gate, name, pass, detail from m, lateral (values ('rows', n >= 100, cast(n as varchar)), ('columns', true, 'all'), ('complete', complete > 0, cast(complete as varchar)), ('real_sources', made = 0, cast(made as varchar))) x(name, pass, detail)")
def _(spark, sf):
    return checks.table_gate(view(spark, sf, "v_sites"), "sites", ("rs_annual", "longitude"), 100, "source")


COMPARED_SQL = "with c as (select *, 255 - r as r2, g as g2, b as b2, r * 1e0 + g as v, g * 1e0 + b as v2 from v_px), m as (select avg(case when a > 0 then (abs(r - r2) + abs(g - g2) + abs(b - b2)) / 3e0 end) as d, abs(corr(case when a > 0 then v end, case when a > 0 then v2 end)) as k, avg(case when a > 0 then 1e0 else 0e0 end) as s from c) select 'comparison' as gate, name, pass from m, lateral (values ('mean_difference', d < 60), ('correlation', k > 0.7e0), ('coverage', s > 0.3e0)) x(name, pass)"


@query("gate_comparison", COMPARED_SQL)
def _(spark, sf):
    c = F.col
    pixels = view(spark, sf, "v_px").select("*", (255 - c("r")).alias("r2"), c("g").alias("g2"), c("b").alias("b2"), (c("r") * 1.0 + c("g")).alias("v"), (c("g") * 1.0 + c("b")).alias("v2"))
    return checks.comparison_gate(pixels).select("gate", "name", "pass")


@query("gate_coverage", "with t as (select distinct cast(p_size % 7 as int) as zoom, cast(p_partkey % 4 as int) as tx, cast(p_partkey % 3 as int) as ty from part), held as (select distinct cast(p_size % 7 as int) as zoom, cast(p_partkey % 4 as int) as tx, cast(p_partkey % 3 as int) as ty from part where p_partkey % 5 > 0), m as (select count(*) as n, count(h.zoom) / count(*) as share from t left join held h using (zoom, tx, ty)) select 'coverage' as gate, name, pass, detail from m, lateral (values ('wanted', n > 0, cast(n as varchar)), ('held', share >= 0.95e0, cast(round(share, 4) as varchar))) x(name, pass, detail)")
def _(spark, sf):
    c = F.col
    t = table(spark, sf, "part").select((c("p_size") % 7).cast("int").alias("zoom"), (c("p_partkey") % 4).cast("int").alias("tx"), (c("p_partkey") % 3).cast("int").alias("ty"), (c("p_partkey") % 5).alias("bytes"))
    return checks.coverage_gate(t, t.select("zoom", "tx", "ty"))


@query("gate_picture", "with m as (select count_if(a > 0) as seen, count(distinct case when a > 0 then r * 65536 + g * 256 + b end) as colours, avg(case when a > 0 and abs(ratio - 1) < 0.02e0 then (greatest(r, g, b) - least(r, g, b)) / (greatest(r, g, b) + 1e-6) end) as near, avg(case when a > 0 and (ratio < 0.85e0 or ratio > 1.15e0) then (greatest(r, g, b) - least(r, g, b)) / (greatest(r, g, b) + 1e-6) end) as far from v_px) select 'picture' as gate, name, pass from m, lateral (values ('visible', seen > 100), ('colours', colours > 50), ('pale_centre', coalesce(near < far, false))) x(name, pass)")
def _(spark, sf):
    return checks.picture_gate(view(spark, sf, "v_px"), 100, 50).select("gate", "name", "pass")
