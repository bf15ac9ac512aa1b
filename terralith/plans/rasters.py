"""Queries over rasters held as cell tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import checks, raster
from ..operators.raster import Grid
from ..registry import query
from .views import view



def cells(spark, sf):
    return view(spark, sf, "v_cells").select(F.col("r").alias("row"), F.col("c").alias("col"), "v", "code")


def pixels(spark, sf):
    return view(spark, sf, "v_px")


def grid_of(spark, sf) -> Grid:
    """The cell view laid over the Asian box, whatever its number of rows."""
    height = cells(spark, sf).agg(F.max("row")).first()[0] + 1
    return Grid(25.0, 80.0, 3.1, 90.0 / height, 50, height)


CELLS_SQL = "cells as (select r as row_no, c as col_no, v, code from v_cells), g as (select max(r) + 1 as h, 9e1 / (max(r) + 1) as yres from v_cells)"
PIXELS_SQL = "pix as (select * from v_px)"


@query("raster_sample", f"with {CELLS_SQL} select s.rec, c.v, coalesce(c.code, 255) as code from v_sites s cross join g left join cells c on cast(floor((8e1 - s.latitude) / g.yres) as int) = c.row_no and cast(floor((s.longitude - 25e0) / 3.1e0) as int) = c.col_no")
def _(spark, sf):
    return raster.sample(view(spark, sf, "v_sites").select("rec", "longitude", "latitude"), cells(spark, sf), grid_of(spark, sf), ["v", "code"], default={"code": 255}).select("rec", "v", "code")


@query("rasterise_last_wins", f"with {CELLS_SQL}, p as (select rec, rs_annual, h, cast(round_even((8e1 - latitude) / yres - 5e-1, 0) as int) as row_no, cast(round_even((longitude - 25e0) / 3.1e0 - 5e-1, 0) as int) as col_no from v_sites, g) select row_no, col_no, max_by(rs_annual, rec) as rs_annual from p where row_no between 0 and h - 1 and col_no between 0 and 49 group by 1, 2")
def _(spark, sf):
    return raster.rasterise(view(spark, sf, "v_sites"), grid_of(spark, sf), "rs_annual", ["rec"]).select(F.col("row").alias("row_no"), F.col("col").alias("col_no"), "rs_annual")


@query("raster_mask", f"with {CELLS_SQL} select row_no, count(case when code % 3 <> 0 then v end) as n, round(sum(case when code % 3 <> 0 then v end), 4) as total from cells group by row_no")
def _(spark, sf):
    c = cells(spark, sf)
    mask = c.select("row", "col", F.when(F.col("code") % 3 != 0, 1).otherwise(0).alias("mask"))
    return raster.masked(c.select("row", "col", "v"), mask, "v").groupBy(F.col("row").alias("row_no")).agg(F.count("v").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query("patch_mean", f"with {CELLS_SQL} select round(avg(v), 6) as mean, round(count(v) / count(*), 6) as share, count(v) / count(*) >= 0.25e0 as enough from cells where row_no between 10 and 30 and col_no between 15 and 35")
def _(spark, sf):
    w = raster.window_of(cells(spark, sf), 10, 30, 15, 35)
    share = F.count("v") / F.count("*")
    return w.agg(F.round(F.avg("v"), 6).alias("mean"), F.round(share, 6).alias("share"), (share >= 0.25).alias("enough"))


@query("block_means", f"with {CELLS_SQL} select cast(floor(row_no / 5e0) as int) as br, cast(floor(col_no / 7e0) as int) as bc, round(avg(v), 6) as mean, count(*) as n from cells, g where v is not null and row_no < h // 5 * 5 and col_no < 49 group by 1, 2 having count(*) > 5")
def _(spark, sf):
    return raster.block_means(cells(spark, sf), F.col("v"), (h := grid_of(spark, sf).height), 50, max(1, h // 5), 7).select("br", "bc", F.round("mean", 6).alias("mean"), "n")


@query("block_correlation", f"with {CELLS_SQL}, b as (select floor(row_no / 5e0) as br, floor(col_no / 5e0) as bc, avg(v) as a, avg(case when v is not null then code end) as b from cells, g where v is not null and row_no < h // 5 * 5 group by 1, 2 having count(*) > 5) select round(corr(a, b), 6) as corr, count(*) as n from b")
def _(spark, sf):
    c = cells(spark, sf).filter("v is not null")
    a = raster.block_means(c, F.col("v"), (h := grid_of(spark, sf).height), 50, max(1, h // 5), 10, name="a").drop("n")
    b = raster.block_means(c, F.col("code"), h, 50, max(1, h // 5), 10, name="b").drop("n")
    return a.join(b, ["br", "bc"]).agg(F.round(F.corr("a", "b"), 6).alias("corr"), F.count("*").alias("n"))


@query("raster_pyramid", f"""with {CELLS_SQL}, l0 as (select 0 as level, row_no, col_no, v from cells), l1 as (select 1, cast(floor(row_no / 2e0) as int), cast(floor(col_no / 2e0) as int), avg(v) from cells group by 2, 3),
l2 as (select 2, cast(floor(row_no / 4e0) as int), cast(floor(col_no / 4e0) as int), avg(v) from cells group by 2, 3) select level, row_no, col_no, round(v, 6) as v from (select * from l0 union all select * from l1 union all select * from l2)""")
def _(spark, sf):
    return raster.pyramid(cells(spark, sf), "v", 3).select("level", F.col("row").alias("row_no"), F.col("col").alias("col_no"), F.round("v", 6).alias("v"))


@query("downsample", f"with {CELLS_SQL} select cast(floor(row_no / 3e0) as int) as row_no, cast(floor(col_no / 3e0) as int) as col_no, round(avg(v), 6) as v from cells group by 1, 2")
def _(spark, sf):
    return raster.downsample(cells(spark, sf), "v", 3).select(F.col("row").alias("row_no"), F.col("col").alias("col_no"), F.round("v", 6).alias("v"))


def _area_sql(rows: str, cols: str, source: str = "cells", extra: str = "") -> str:
    """Every target against every source cell that it meets, by the lengths they share; as many target rows as the raster's height gives, its width is always 50."""
    return f"""select {extra}cast(t.i as int) as row_no, cast(u.j as int) as col_no, round(sum(wr * wc * v) / nullif(sum(case when v is not null then wr * wc end), 0), 6) as v from {source} c
  join (select i, r, least(r + 1, (i + 1) * {rows}) - greatest(r, i * {rows}) as wr from (select unnest(range(cast(greatest(1, round_even(h / {rows}, 0)) as bigint))) as i from g) join (select distinct row_no as r from cells) on r + 1 > i * {rows} and r < (i + 1) * {rows}) t on t.r = c.row_no and wr > 1e-12
  join (select j, k, least(k + 1, (j + 1) * {cols}) - greatest(k, j * {cols}) as wc from (select unnest(range(100)) as j) join (select distinct col_no as k from cells) on k + 1 > j * {cols} and k < (j + 1) * {cols} where j < greatest(1, round_even(50 / {cols}, 0))) u on u.k = c.col_no and wc > 1e-12 group by t.i, u.j"""


@query("downsample_by_area", f"with {CELLS_SQL} {_area_sql('2.3e0', '3.2e0')}")
def _(spark, sf):
    small = raster.area_average(cells(spark, sf), "v", grid_of(spark, sf).height, 50, 2.3, 3.2)
    return small.select(F.col("row").alias("row_no"), F.col("col").alias("col_no"), F.round("v", 6).alias("v"))


#: Resolutions of three zooms, in cells of the raster.
ZOOMS = {0: 11.0, 1: 5.5, 2: 2.75}


@query("zoom_rasters", f"with {CELLS_SQL} " + " union all ".join(_area_sql(f"{f}e0", f"{f}e0", extra=f"{z} as zoom, ") for z, f in ZOOMS.items()))
def _(spark, sf):
    levels = raster.zoom_levels(cells(spark, sf), "v", grid_of(spark, sf).height, 50, 1.0, ZOOMS)
    return levels.select("zoom", F.col("row").alias("row_no"), F.col("col").alias("col_no"), F.round("v", 6).alias("v"))


BILINEAR_SQL = """four as (select t.*, fy + dy as row_no, fx + dx as col_no, (case when dy = 1 then y - fy else 1 - (y - fy) end) * (case when dx = 1 then x - fx else 1 - (x - fx) end) as w
  from (select *, cast(floor(y) as int) as fy, cast(floor(x) as int) as fx from targets) t, (values (0), (1)) a(dy), (values (0), (1)) b(dx)),
v4 as (select four.*, cells.v from four left join cells using (row_no, col_no))"""


@query("bilinear_upsample", f"with {CELLS_SQL}, targets as (select a as ty, b as tx, a * 0.4e0 as y, b * 0.4e0 as x from (select unnest(range(h + h // 2)) as a from g), range(70) s(b)), {BILINEAR_SQL} select cast(ty as int) as ty, cast(tx as int) as tx, round(case when sum(case when v is not null then w end) > 0 then sum(w * v) / sum(case when v is not null then w end) end, 7) as v from v4 group by ty, tx")
def _(spark, sf):
    h = grid_of(spark, sf).height
    t = spark.range((h + h // 2) * 70).select(F.floor(F.col("id") / 70).cast("int").alias("ty"), (F.col("id") % 70).cast("int").alias("tx"))
    t = t.withColumn("y", F.col("ty") * F.lit(0.4)).withColumn("x", F.col("tx") * F.lit(0.4))
    return raster.bilinear(t, cells(spark, sf), "v").select("ty", "tx", F.round("v", 7).alias("v"))


@query("mercator_resample", f"""with {CELLS_SQL}, px as (select a as py, b as px from range(0, 256) r(a), range(0, 256) s(b)), ll as (select py, px, (px + 0.5e0) / 256 * 360 - 180 as lon, degrees(2 * atan(exp((0.5e0 - (py + 0.5e0) / 256) * 2 * pi())) - pi() / 2) as lat from px),
targets as (select py, px, (8e1 - lat) / yres - 0.5e0 as y, (lon - 25e0) / 3.1e0 - 0.5e0 as x from ll, g), {BILINEAR_SQL}
select cast(py as int) as py, cast(px as int) as px, round(sum(w * v) / sum(case when v is not null then w end), 7) as v from v4 group by py, px having sum(case when v is not null then w end) > 0""")
def _(spark, sf):
    out = raster.to_mercator(cells(spark, sf), grid_of(spark, sf), "v", 0)
    return out.filter("v is not null").select("py", "px", F.round("v", 7).alias("v"))


@query("world_tile", f"with {CELLS_SQL}, p as (select cast(floor((0.5e0 - ln(tan(pi() / 4 + radians(8e1 - (row_no + 0.5e0) * yres) / 2)) / (2 * pi())) * 256) as int) as py, cast(floor((25e0 + (col_no + 0.5e0) * 3.1e0 + 180) / 360 * 256) as int) as px, v from cells, g) select py, px, round(avg(v), 6) as v from p group by 1, 2 having avg(v) is not null")
def _(spark, sf):
    return raster.world_tile(cells(spark, sf), grid_of(spark, sf), "v").select("py", "px", F.round("v", 6).alias("v"))


@query("colourise_tiles", f"with {CELLS_SQL}, k as (select row_no, col_no, v is not null as seen, greatest(0e0, least(1e0, (v - 9e2) / 1e3)) as t from cells), c as (select *, case when not seen then 0 else cast(floor(case when t <= 0.25e0 then 103 + t * 444 when t <= 0.5e0 then 214 + (t - 0.25e0) * 132 when t <= 0.75e0 then 247 + (t - 0.5e0) * -720 else 67 + (t - 0.75e0) * -248 end) as int) end as r, case when seen then 255 else 0 end as a from k) select cast(floor(row_no / 16e0) as int) as ty, cast(floor(col_no / 16e0) as int) as tx, count(*) as n, count(*) filter (where a > 0) as n_seen, cast(sum(r) as bigint) as red from c group by 1, 2")
def _(spark, sf):
    c = raster.cut_tiles(raster.colourise(cells(spark, sf), "v", 900.0, 1900.0), 16, "row", "col")
    return c.groupBy("ty", "tx").agg(F.count("*").alias("n"), F.count_if(F.col("a") > 0).alias("n_seen"), F.sum("r").alias("red"))


@query("tile_seams", f"""with {PIXELS_SQL}, t as (select *, cast(floor(py / 1e1) as int) as ty, cast(floor(px / 1e1) as int) as tx, py % 10 as iy, px % 10 as ix from pix where a > 0),
d as (select 'down' as axis, l.ty, l.tx, (abs(l.r - f.r) + abs(l.g - f.g) + abs(l.b - f.b)) / 3e0 as d from t l join t f on f.ty = l.ty + 1 and f.tx = l.tx and f.ix = l.ix and l.iy = 9 and f.iy = 0
 union all select 'right', l.ty, l.tx, (abs(l.r - f.r) + abs(l.g - f.g) + abs(l.b - f.b)) / 3e0 from t l join t f on f.tx = l.tx + 1 and f.ty = l.ty and f.iy = l.iy and l.ix = 9 and f.ix = 0)
select axis, ty, tx, count(*) as pairs, round(avg(d), 6) as difference from d group by 1, 2, 3 having count(*) >= 4""")
def _(spark, sf):
    return raster.seams(raster.cut_tiles(pixels(spark, sf), 10), 10, least=4).select("axis", "ty", "tx", "pairs", F.round("difference", 6).alias("difference"))


@query("seam_ratio", f"""with {PIXELS_SQL}, t as (select *, cast(floor(py / 1e1) as int) as ty, cast(floor(px / 1e1) as int) as tx, py % 10 as iy, px % 10 as ix from pix where a > 0),
s as (select l.ty, l.tx, avg((abs(l.r - f.r) + abs(l.g - f.g) + abs(l.b - f.b)) / 3e0) as d from t l join t f on f.ty = l.ty + 1 and f.tx = l.tx and f.ix = l.ix and l.iy = 9 and f.iy = 0 group by 1, 2 having count(*) >= 4),
i as (select l.ty, l.tx, avg((abs(l.r - f.r) + abs(l.g - f.g) + abs(l.b - f.b)) / 3e0) as d from t l join t f on f.ty = l.ty and f.tx = l.tx and f.ix = l.ix and f.iy = l.iy + 1 group by 1, 2 having count(*) >= 4)
select round((select avg(d) from s), 6) as across, round((select avg(d) from i), 6) as within, round((select avg(d) from s) / (select avg(d) from i), 6) as ratio""")
def _(spark, sf):
    t = raster.cut_tiles(pixels(spark, sf), 10)
    across = raster.seams(t, 10, least=4).filter("axis = 'down'").agg(F.avg("difference").alias("a"))
    within = raster.inner_differences(t, least=4).filter("axis = 'down'").agg(F.avg("difference").alias("w"))
    return across.crossJoin(F.broadcast(within)).select(F.round("a", 6).alias("across"), F.round("w", 6).alias("within"), F.round(F.col("a") / F.col("w"), 6).alias("ratio"))


@query("gate_seams", f"""with {PIXELS_SQL}, t as (select *, cast(floor(py / 1e1) as int) as ty, cast(floor(px / 1e1) as int) as tx, py % 10 as iy, px % 10 as ix from pix where a > 0),
n as (select py + 1 as py, px, true as down, ty, tx, r, g, b from t union all select py, px + 1, false, ty, tx, r, g, b from t),
e as (select n.ty = t.ty and n.tx = t.tx as inside, down, n.ty, n.tx, (abs(n.r - t.r) + abs(n.g - t.g) + abs(n.b - t.b)) / 3e0 as d from n join t using (py, px)),
k as (select inside, down, ty, tx, count(*) as pairs, avg(d) as d from e group by 1, 2, 3, 4 having count(*) >= 4),
m as (select coalesce(max(d) filter (not inside and pairs >= 8), max(d) filter (not inside)) as largest, coalesce(avg(d) filter (not inside and pairs >= 8), avg(d) filter (not inside)) / avg(d) filter (inside) as ratio, count(*) filter (not inside) as n, (select avg(case when a > 0 then 1e0 else 0e0 end) from pix) as seen from k)
select 'seams' as gate, name, pass from m, lateral (values ('seams', n > 0), ('continuity', coalesce(largest < 30, false) or coalesce(ratio > 0 and ratio < 2.5e0, false)), ('coverage', coalesce(seen > 0.5e0, false))) x(name, pass)""")  # fmt: skip
def _(spark, sf):
    t = raster.cut_tiles(pixels(spark, sf), 10)
    return checks.seam_gate(raster.seams(t, 10, least=4), raster.inner_differences(t, least=4), t, pairs=8).select("gate", "name", "pass")


@query("stitch_tiles", f"with {PIXELS_SQL} select py - 10 as my, px - 20 as mx, r, a from pix where py between 10 and 29 and px between 20 and 39")
def _(spark, sf):
    return raster.stitch(raster.cut_tiles(pixels(spark, sf), 10), 1, 2, 2, 10).select(F.col("my").cast("int").alias("my"), F.col("mx").cast("int").alias("mx"), "r", "a")


@query("distinct_colours", f"with {PIXELS_SQL} select count(distinct (r, g, b)) filter (where a > 0) as n_colours, count(distinct (r, g, b)) filter (where (py * 50 + px) % 100 = 0) as n_strided, count(*) filter (where a > 0) as n_seen, round(avg(case when a > 0 then 1 else 0 end) * 100, 6) as coverage from pix")
def _(spark, sf):
    p = pixels(spark, sf)
    rgb = F.struct("r", "g", "b")
    return p.agg(F.countDistinct(F.when(F.col("a") > 0, rgb)).alias("n_colours"), F.countDistinct(F.when((F.col("py") * 50 + F.col("px")) % 100 == 0, rgb)).alias("n_strided"), F.count_if(F.col("a") > 0).alias("n_seen"), F.round(F.avg((F.col("a") > 0).cast("int")) * 100, 6).alias("coverage"))


@query("dense_grid", f"with {CELLS_SQL} select row_no, string_agg(coalesce(cast(v as varchar), '-'), ';' order by col_no) as row_values from (select r.row_no, k.col_no, c.v from (select distinct row_no from cells) r cross join (select distinct col_no from cells) k left join cells c on c.row_no = r.row_no and c.col_no = k.col_no and c.code % 2 = 0) group by row_no")
def _(spark, sf):
    d = raster.dense_rows(cells(spark, sf).withColumn("v", F.when(F.col("code") % 2 == 0, F.col("v"))), "v")
    return d.select(F.col("row").alias("row_no"), F.array_join(F.transform("values", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ";").alias("row_values"))


@query("grid_cells", "select cast(a as int) as row_no, cast(b as int) as col_no, 25.25e0 + b * 0.5e0 as longitude, -9.75e0 + a * 0.5e0 as latitude from range(180) r(a), range(310) s(b)")
def _(spark, sf):
    return raster.make_grid(spark, 25.0, -10.0, 180.0, 80.0, 0.5).select(F.col("row").alias("row_no"), F.col("col").alias("col_no"), "longitude", "latitude")


@query("flip_rows", f"with {CELLS_SQL} select h - 1 - row_no as row_no, col_no, v from cells, g where v is not null")
def _(spark, sf):
    return cells(spark, sf).filter("v is not null").select((F.lit(grid_of(spark, sf).height - 1) - F.col("row")).alias("row_no"), F.col("col").alias("col_no"), "v")


@query("polygon_mask", "select rec, (latitude >= 0 and latitude < 60 and longitude >= 30 + latitude / 2 and longitude < 150) as inside from v_sites")
def _(spark, sf):
    ring = [(30.0, 0.0), (150.0, 0.0), (150.0, 60.0), (60.0, 60.0)]
    s = view(spark, sf, "v_sites").withColumn("inside", geo.in_polygon(F.col("longitude"), F.col("latitude"), ring))
    return s.select("rec", "inside")


@query("crop_and_shrink", f"with {CELLS_SQL} select cast(floor((row_no - 4) / 4e0) as int) as row_no, cast(floor((col_no - 8) / 4e0) as int) as col_no, round(avg(v), 6) as v from cells, g where row_no between 4 and h - 5 and col_no between 8 and 39 group by 1, 2")
def _(spark, sf):
    w = raster.window_of(cells(spark, sf), 4, grid_of(spark, sf).height - 5, 8, 39).withColumns({"row": F.col("row") - 4, "col": F.col("col") - 8})
    return raster.downsample(w, "v", 4).select(F.col("row").alias("row_no"), F.col("col").alias("col_no"), F.round("v", 6).alias("v"))


@query("replace_zoom_level", "with t as (select cast(p_size % 7 as int) as zoom, p_partkey as tile, 'old' as data from part), z as (select * from t where zoom <> 0 union all select 0, 0, 'new') select zoom, count(*) as n, min(data) as data from z group by zoom")
def _(spark, sf):
    from ..session import table

    t = table(spark, sf, "part").select((F.col("p_size") % 7).cast("int").alias("zoom"), F.col("p_partkey").alias("tile"), F.lit("old").alias("data"))
    fresh = spark.range(1).select(F.lit(0).alias("zoom"), F.col("id").alias("tile"), F.lit("new").alias("data"))
    return raster.replace_level(t, 0, fresh).groupBy("zoom").agg(F.count("*").alias("n"), F.min("data").alias("data"))
