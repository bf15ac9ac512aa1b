"""Queries that join: nearest references, imputation, rankings, write-backs, comparisons, documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbours
from ..registry import query
from ..session import table
from .views import view

HAVERSINE_SQL = "2 * 6371e0 * asin(sqrt(least(1e0, sin(radians(r.lat - c.latitude) / 2) ** 2 + cos(radians(c.latitude)) * cos(radians(r.lat)) * sin(radians(r.lon - c.longitude) / 2) ** 2)))"
REFS_SQL = "refs as (select s_suppkey as ref, 25e0 + (s_suppkey * 37 % 150) as lon, -10e0 + (s_suppkey * 53 % 89) as lat, s_acctbal as soc from supplier)"


def refs(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("ref"), (F.lit(25.0) + k * 37 % 150).alias("longitude"), (F.lit(-10.0) + k * 53 % 89).alias("latitude"), F.col("s_acctbal").alias("soc"))


@query("nearest_site", f"with {REFS_SQL}, d as (select c.rec, r.ref, {HAVERSINE_SQL} as km from v_sites c, refs r) select rec, arg_min(ref, (km, ref)) as ref, round(min(km), 6) as distance_km from d group by rec")
def _(spark, sf):
    cells = view(spark, sf, "v_sites").select("rec", "longitude", "latitude")
    return neighbours.nearest_reference(cells, refs(spark, sf), "rec", "ref").select("rec", "ref", F.round("distance_km", 6).alias("distance_km"))


@query("nearest_imputation", f"with {REFS_SQL}, d as (select c.rec, c.rs_annual, c.source, r.ref, r.soc, {HAVERSINE_SQL} as km from v_sites c, refs r where r.soc > 0) select rec, case when source = 'cosore' then arg_min(soc, (km, ref)) else rs_annual end as soc from d group by rec, source, rs_annual")
def _(spark, sf):
    cells = view(spark, sf, "v_sites").select("rec", "longitude", "latitude", "source", "rs_annual")
    complete = refs(spark, sf).filter("soc > 0")
    found = neighbours.nearest_reference(cells, complete, "rec", "ref", ("soc",))
    return found.select("rec", F.when(F.col("source") == "cosore", F.col("soc")).otherwise(F.col("rs_annual")).alias("soc"))


@query("ranking_join", "with long as (select feature, stratum, value from v_feat unpivot (value for feature in (bio01, bio06, sand))), m as (select stratum, feature, avg(abs(value)) as importance from long where stratum in ('A', 'R') group by 1, 2), k as (select *, row_number() over (partition by stratum order by importance desc, feature) as rank from m) select a.feature, a.rank as rank_a, b.rank as rank_b, round(a.importance - b.importance, 6) as difference from k a join k b on a.feature = b.feature and a.stratum = 'A' and b.stratum = 'R'")
def _(spark, sf):
    from ..operators.models import importance_ranks

    f = view(spark, sf, "v_feat")
    side = lambda s: importance_ranks(f.filter(F.col("stratum") == s).unpivot([], ["bio01", "bio06", "sand"], "feature", "value"))
    a, b = side("A").select("feature", F.col("importance").alias("ia"), F.col("rank").alias("rank_a")), side("R").select("feature", F.col("importance").alias("ib"), F.col("rank").alias("rank_b"))
    return a.join(b, "feature").select("feature", "rank_a", "rank_b", F.round(F.col("ia") - F.col("ib"), 6).alias("difference"))


@query("zone_write_back", "with z as (select r, c, v * 1e1 as zone_value from v_cells where code % 4 = 1) select a.r as row_no, a.c as col_no, coalesce(z.zone_value, a.v) as v from v_cells a left join z on a.r = z.r and a.c = z.c")
def _(spark, sf):
    c = view(spark, sf, "v_cells")
    zone = c.filter("code % 4 = 1").select("r", "c", (F.col("v") * 10).alias("zone_value"))
    return c.join(zone, ["r", "c"], "left").select(F.col("r").alias("row_no"), F.col("c").alias("col_no"), F.coalesce("zone_value", "v").alias("v"))


@query("grid_difference", "select a.r as row_no, count(*) as n, round(sum(b.v - a.v), 6) as total from v_cells a join (select r - 1 as r, c, v from v_cells) b on a.r = b.r and a.c = b.c group by a.r")
def _(spark, sf):
    a = view(spark, sf, "v_cells")
    b = a.select((F.col("r") - 1).alias("r"), "c", F.col("v").alias("w"))
    return a.join(b, ["r", "c"]).groupBy(F.col("r").alias("row_no")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("w") - F.col("v")), 6).alias("total"))


@query("raster_compare", "select round(avg(abs(a.v - p.ratio * 1e3)), 6) as mean_difference, round(corr(a.v, p.ratio), 6) as corr, round(avg(case when p.a > 0 and a.v is not null then 1 else 0 end), 6) as common_share from v_cells a join v_px p on a.r = p.py and a.c = p.px")
def _(spark, sf):
    a, p = view(spark, sf, "v_cells"), view(spark, sf, "v_px")
    j = a.join(p.select(F.col("py").cast("int").alias("r"), F.col("px").alias("c"), "ratio", "a"), ["r", "c"])
    return j.agg(F.round(F.avg(F.abs(F.col("v") - F.col("ratio") * 1000)), 6).alias("mean_difference"), F.round(F.corr("v", "ratio"), 6).alias("corr"), F.round(F.avg(((F.col("a") > 0) & F.col("v").isNotNull()).cast("int")), 6).alias("common_share"))


@query("cooccurrence", "with a as (select landcover, count(*) as n from v_feat where stratum = 'A' and landcover < 12 group by 1), b as (select landcover, count(*) as n from v_feat where stratum = 'R' and landcover > 6 group by 1) select coalesce(a.landcover, b.landcover) as landcover, coalesce(a.n, 0) as n_a, coalesce(b.n, 0) as n_r from a full join b on a.landcover = b.landcover")
def _(spark, sf):
    f = view(spark, sf, "v_feat")
    a = (F.col("stratum") == "A") & (F.col("landcover") < 12)
    r = (F.col("stratum") == "R") & (F.col("landcover") > 6)
    return f.filter(a | r).groupBy("landcover").agg(F.count_if(a).alias("n_a"), F.count_if(r).alias("n_r"))


@query("metric_documents", "with m as (select stratum, count(*) as n, round(avg(y), 6) as mean_y from v_pred group by 1), s as (select stratum, arg_max(status, (k, status)) as top_status from (select stratum, status, count(*) as k from v_pred group by 1, 2) group by 1) select m.stratum, n, mean_y, top_status from m join s using (stratum)")
def _(spark, sf):
    p = view(spark, sf, "v_pred")
    m = p.groupBy("stratum").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("mean_y"))
    s = p.groupBy("stratum", "status").agg(F.count("*").alias("k")).groupBy("stratum").agg(F.max_by("status", F.struct("k", "status")).alias("top_status"))
    return m.join(s, "stratum")


@query("result_union", "select kind, name, value from (select 'stratum' as kind, stratum as name, round(avg(y), 6) as value, count(*) as n from v_pred group by 2 union all select 'status', status, round(avg(y), 6), count(*) from v_pred group by 2) where n > 3000")
def _(spark, sf):
    p = view(spark, sf, "v_pred")
    part = lambda c, kind: p.groupBy(F.col(c).alias("name")).agg(F.round(F.avg("y"), 6).alias("value"), F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    return part("stratum", "stratum").unionByName(part("status", "status")).filter("n > 3000").select("kind", "name", "value")


@query("nested_cells", """with t as (select id, stratum, y, p, list_sort([{'f': 'y', 'v': y}, {'f': 'p', 'v': p}, {'f': 'gap', 'v': abs(y - p)}]) as fs from v_pred)
select id, stratum as biome, round_even(y, 4) as pred, (case when abs(y) >= abs(p) and abs(y) >= abs(y - p) then 'y' when abs(p) >= abs(y - p) then 'p' else 'gap' end) as top_feature from t""")
def _(spark, sf):
    from ..operators.documents import cell_document

    docs = cell_document(view(spark, sf, "v_pred").withColumn("gap", F.abs(F.col("y") - F.col("p"))), "id", "stratum", "y", ["y", "p", "gap"])
    return docs.select("id", "biome", F.col("fnpp.pred_log_rs").alias("pred"), F.col("fnpp.top3")[0]["feature"].alias("top_feature"))


@query("zoom_steps", "with s as (select cast(p_size % 7 as int) as zoom, cast(sum(p_partkey % 100) as bigint) + (p_size % 7) * 1000000 as bytes from part group by 1, p_size % 7), l as (select zoom, bytes, lead(bytes) over (order by zoom) as following from s) select zoom, bytes, round(following / bytes, 6) as step, coalesce(following / bytes between 1.5e0 and 8, true) as ok from l")
def _(spark, sf):
    from ..operators.checks import zoom_steps

    p = table(spark, sf, "part")
    zoom = (F.col("p_size") % 7).cast("int")
    sizes = p.groupBy(zoom.alias("zoom")).agg(F.sum(F.col("p_partkey") % 100).alias("b")).select("zoom", (F.col("b") + F.col("zoom") * 1_000_000).alias("bytes"))
    return zoom_steps(sizes).select("zoom", "bytes", F.round("step", 6).alias("step"), "ok")
