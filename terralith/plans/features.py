"""Queries over feature tables: engineered features, climate zones, units, colours, tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import climate, geo, missing, scalar
from ..registry import query
from .views import view


def rounded(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


@query("engineered_features", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(soc / nullif(nitrogen, 0), 6) as c_n_ratio, round(clay / nullif(sand, 0), 6) as clay_sand_ratio,
  round(-abs((case when phh2o > 14 then phh2o / 10 else phh2o end) - 6.5e0), 6) as ph_optimality, bio12 / nullif(bio01 + 10, 0) as aridity, round(bio05 - bio06, 6) as diurnal_range, round(exp(bio01 / 1e1 - bio05 / 1e1), 6) as anomaly from v_feat""")
def _(spark, sf):
    f, c = view(spark, sf, "v_feat"), F.col
    return f.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(scalar.ratio(c("soc"), c("nitrogen")), 6).alias("c_n_ratio"), F.round(scalar.ratio(c("clay"), c("sand")), 6).alias("clay_sand_ratio"),
        F.round(scalar.ph_optimality(c("phh2o")), 6).alias("ph_optimality"), scalar.aridity(c("bio12"), c("bio01")).alias("aridity"),
        F.round(scalar.diurnal_range(c("bio05"), c("bio06")), 6).alias("diurnal_range"), F.round(scalar.anomaly_ratio(c("bio01") / 10, c("bio05") / 10), 6).alias("anomaly"),
    )


@query("soil_rescale", "select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(cast(case when cast(sand as float) > 0 then cast(sand as float) * cast(0.1 as float) end as double), 4) as sand, round(cast(case when cast(soc as float) > 0 then cast(soc as float) * cast(0.1 as float) end as double), 4) as soc from v_feat")
def _(spark, sf):
    units = scalar.soil_units({"sand": F.col("sand"), "soc": F.col("soc")})
    return view(spark, sf, "v_feat").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[F.round(v.cast("double"), 4).alias(k) for k, v in units.items()])


ZONE_SQL = """case when bio01 is null then '?'
 when bio12 < (bio01 * 10 + case when bio01 > 0 then 140 else 0 end) * 0.5e0 then case when bio01 >= 18 then 'BWh' else 'BWk' end
 when bio12 < bio01 * 10 + case when bio01 > 0 then 140 else 0 end then case when bio01 >= 18 then 'BSh' else 'BSk' end
 when bio01 >= 18 then case when bio14 >= 60 then 'Af' when bio14 >= 100 - bio12 / 25 then 'Am' else 'Aw' end
 when bio01 >= 10 then case when bio17 < 30 then 'Cwa' else 'Cfa' end
 when bio01 >= 3 then case when bio17 < 50 then 'Dwa' else 'Dfa' end
 when bio01 >= -3 then 'Dfb' when bio01 >= -38 then 'Dfc' else 'ET' end"""


@query("climate_zones", f"select {ZONE_SQL} as zone, count(*) as n, round(avg(bio12), 6) as rain from v_feat group by 1")
def _(spark, sf):
    zone = climate.zone_code(F.col("bio01"), F.col("bio12"), F.col("bio14"), F.col("bio17"))
    return view(spark, sf, "v_feat").groupBy(zone.alias("zone")).agg(F.count("*").alias("n"), F.round(F.avg("bio12"), 6).alias("rain"))


@query("climate_letters", "select case when bio05 is null or bio06 is null or bio12 is null or bio14 is null then 'unk' when bio05 < 10 then 'E' when bio12 < 400 and bio14 < 30 then 'B' when bio06 >= 18 then 'A' when bio06 >= -3 then 'C' else 'D' end as zone, count(*) as n from v_feat group by 1")
def _(spark, sf):
    return view(spark, sf, "v_feat").groupBy(climate.zone_letter(F.col("bio05"), F.col("bio06"), F.col("bio12"), F.col("bio14")).alias("zone")).agg(F.count("*").alias("n"))


@query("biomes", """select case when landcover in (1,2,3,4,5) then 'forest' when landcover in (6,7) then 'shrubland' when landcover in (8,9) then 'savanna' when landcover = 10 then 'grassland' when landcover = 11 then 'wetland' when landcover in (12,14) then 'cropland' when landcover = 16 then 'barren' else 'other' end as biome,
  count(*) as n, count(*) filter (where landcover not in (0, 17, 255)) as n_land from v_feat group by 1""")
def _(spark, sf):
    f = view(spark, sf, "v_feat")
    return f.groupBy(climate.biome(F.col("landcover")).alias("biome")).agg(F.count("*").alias("n"), F.count_if(climate.is_land(F.col("landcover"))).alias("n_land"))


NAMES_SQL = ", ".join(f"({code}, '{name}')" for code, name in climate.IGBP_NAMES.items())


@query("landcover_names", f"with names(code, label) as (values {NAMES_SQL}) select coalesce(n.label, 'Unclassified') as label, count(*) as n from v_feat f left join names n on f.landcover = n.code group by 1")
def _(spark, sf):
    return view(spark, sf, "v_feat").groupBy(climate.igbp_name(F.col("landcover")).alias("label")).agg(F.count("*").alias("n"))


@query("one_hot_classes", "with f as (select landcover from v_feat), big as (select landcover from f where landcover in (select landcover from f group by landcover having count(*) >= 10)) select 'lc_' || lpad(cast(landcover as varchar), 2, '0') as feature, cast(count(*) as double) as total from big group by 1")
def _(spark, sf):
    f = view(spark, sf, "v_feat")
    # the vocabulary of classes with support: at most one row for each class
    classes = sorted(r[0] for r in f.groupBy("landcover").agg(F.count("*").alias("n")).filter("n >= 10").collect())
    hot = scalar.one_hot(F.col("landcover"), classes)
    names = [f"lc_{c:02d}" for c in classes]
    return f.select(*hot).agg(*[F.sum(n).alias(n) for n in names]).unpivot([], names, "feature", "total")


@query("legend_classes", "select case when ratio is null then 'missing' when ratio >= 1.25e0 then 'far above' when abs(ratio - 1) < 2e-2 then 'as expected' when ratio >= 1 then 'above' when ratio > 0.75e0 then 'below' else 'far below' end as class, count(*) as n from v_px group by 1")
def _(spark, sf):
    return view(spark, sf, "v_px").groupBy(climate.legend_class(F.col("ratio")).alias("class")).agg(F.count("*").alias("n"))


@query("saturation_and_alpha", "select py, round(avg((greatest(r, g, b) - least(r, g, b)) / (greatest(r, g, b) + 1e-6)), 6) as saturation, round(avg(r * (a / 2.55e2) + 255 * (1 - a / 2.55e2)), 6) as red_on_white, round(avg((r - b) / 2.55e2), 6) as proxy from v_px group by py")
def _(spark, sf):
    r, g, b, a = (F.col(c).cast("double") for c in "rgba")
    return view(spark, sf, "v_px").groupBy("py").agg(F.round(F.avg(scalar.saturation(r, g, b)), 6).alias("saturation"), F.round(F.avg(scalar.over_white(r, a / 255.0)), 6).alias("red_on_white"), F.round(F.avg(scalar.red_blue_proxy(r, b)), 6).alias("proxy"))


@query("colour_ramp", """with x as (select px, py, greatest(0e0, least(1e0, (ratio - 5e-1) / 1e0)) as v from v_px)
select px, py, cast(floor(case when v <= 0.25e0 then 103 + v * 444 when v <= 0.5e0 then 214 + (v - 0.25e0) * 132 when v <= 0.75e0 then 247 + (v - 0.5e0) * -720 else 67 + (v - 0.75e0) * -248 end) as int) as r,
 cast(floor(case when v <= 0.25e0 then 0 + v * 384 when v <= 0.5e0 then 96 + (v - 0.25e0) * 604 when v <= 0.75e0 then 247 + (v - 0.5e0) * -400 else 147 + (v - 0.75e0) * -396 end) as int) as g from x""")  # fmt: skip
def _(spark, sf):
    r, g, _b = scalar.ramp(scalar.normalise(F.col("ratio"), 0.5, 1.5), scalar.DIVERGING)
    return view(spark, sf, "v_px").select("px", "py", r, g)


@query("xyz_tiles", "select rec, cast(floor((longitude + 180) / 3.6e2 * 64) as int) as x, cast(floor((1 - ln(tan(radians(latitude)) + 1 / cos(radians(latitude))) / pi()) / 2 * 64) as int) as y, round(6378137e0 * radians(longitude), 3) as mx, round(6378137e0 * ln(tan(pi() / 4 + radians(latitude) / 2)), 3) as my from v_sites")
def _(spark, sf):
    lon, lat, z = F.col("longitude"), F.col("latitude"), F.lit(6)
    return view(spark, sf, "v_sites").select("rec", geo.tile_x(lon, z).alias("x"), geo.tile_y(lat, z).alias("y"), F.round(geo.mercator_x(lon), 3).alias("mx"), F.round(geo.mercator_y(lat), 3).alias("my"))


@query("land_masks", """select rec, ((longitude between 25 and 145 and latitude between 5 and 78) or (longitude between 68 and 92 and latitude between 6 and 35) or (longitude between 95 and 142 and latitude between -10 and 7)
  or (longitude between 129 and 146 and latitude between 30 and 46) or (longitude between 117 and 127 and latitude between 4 and 20)) and not (longitude between 50 and 75 and latitude between -10 and 5)
  and not (longitude between 80 and 95 and latitude between 0 and 18 and not (longitude between 88 and 93 and latitude between 20 and 27))
  and not (longitude between 108 and 120 and latitude between 5 and 22 and not (longitude between 109 and 117 and latitude between 18 and 22)) as land from v_sites""")
def _(spark, sf):
    return view(spark, sf, "v_sites").select("rec", geo.coarse_land(F.col("longitude"), F.col("latitude")).alias("land"))


@query("sentinels", "select count(*) as n, count(case when v <> 905 then v end) as n_nodata, count(case when v between 950 and 1.8e3 then v end) as n_extreme, count(case when v > 1e3 then v end) as n_positive from v_cells")
def _(spark, sf):
    v = F.col("v")
    return view(spark, sf, "v_cells").agg(F.count("*").alias("n"), F.count(missing.nodata_to_null(v, 905.0)).alias("n_nodata"), F.count(missing.extreme_to_null(v, 950.0, 1800.0)).alias("n_extreme"), F.count(missing.positive_scaled(v - 1000, 1.0)).alias("n_positive"))


@query("text_functions", "select o_orderkey, lower(o_orderpriority) as lower_priority, split_part(o_orderpriority, '-', 2) as tail, starts_with(o_orderpriority, '1') as urgent, contains(o_orderpriority, 'NOT') as has_not, cast(regexp_extract(cast(o_totalprice as varchar), '^([0-9]+)', 1) as bigint) as whole, cast(epoch(o_orderdate) as bigint) as seconds, cast(date_diff('day', date '1995-01-01', cast(o_orderdate as date)) as int) as days from orders")
def _(spark, sf):
    from ..session import table

    o = table(spark, sf, "orders")
    p = F.col("o_orderpriority")
    return o.select("o_orderkey", F.lower(p).alias("lower_priority"), F.split_part(p, F.lit("-"), F.lit(2)).alias("tail"), F.startswith(p, F.lit("1")).alias("urgent"), F.contains(p, F.lit("NOT")).alias("has_not"), F.floor("o_totalprice").alias("whole"), F.unix_timestamp("o_orderdate").alias("seconds"), F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).alias("days"))


@query("json_paths", "select event_type, count(*) as n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as k_sum, count(*) filter (where coalesce(json_extract_string(props, '$.missing.r2'), 'none') = 'none') as n_default from events group by event_type")
def _(spark, sf):
    from ..session import table

    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"), F.count_if(scalar.path_or(F.col("props"), "$.missing.r2", "none") == "none").alias("n_default"))
