"""Queries over site tables and flux series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.missing import safe_number
from ..functions.scalar import FLUX_TO_ANNUAL
from ..operators import ingest as op
from ..registry import query
from ..session import table
from .views import view

REGION_SQL = "case when longitude between 25e0 and 180e0 and latitude between -10e0 and 80e0 then 'asia' when longitude between -125e0 and -66e0 and latitude between 24e0 and 50e0 then 'us' else 'other' end"
CLEAN_SQL = "rs_annual between 5e1 and 4.5e3 and latitude is not null and longitude is not null"
PLAIN_SQL = "(manipulation in ('None', 'Control', 'control') or manipulation is null)"
TARGET_SQL = f"""tagged as (
  select *, source || '_' || cast(rec as varchar) as site_id, ln(rs_annual) as log_rs_annual, {REGION_SQL} as region
  from v_sites where {CLEAN_SQL} and {PLAIN_SQL}
), target as (
  select * from (select *, row_number() over (partition by round_even(longitude / 5e-2, 0), round_even(latitude / 5e-2, 0) order by source, site_id) as rn from tagged) where rn = 1
)"""


def target(spark, sf):
    return op.build_target(view(spark, sf, "v_sites"))


@query("site_region_summary", f"with {TARGET_SQL} select region, count(*) as n, min(rs_annual) as rs_min, round(avg(rs_annual), 6) as rs_mean, round(quantile_cont(rs_annual, 0.5), 6) as rs_median, max(rs_annual) as rs_max, round(avg(log_rs_annual), 6) as log_mean from target group by region")
def _(spark, sf):
    rounded = lambda c: F.round(c, 6).alias(c)
    return op.region_summary(target(spark, sf)).select("region", "n", "rs_min", rounded("rs_mean"), rounded("rs_median"), "rs_max", rounded("log_mean"))


@query("site_cell_dedup", f"with {TARGET_SQL} select site_id, source, longitude, latitude, rs_annual, round(log_rs_annual, 9) as log_rs_annual, region from target")
def _(spark, sf):
    return target(spark, sf).select("site_id", "source", "longitude", "latitude", "rs_annual", F.round("log_rs_annual", 9).alias("log_rs_annual"), "region")


@query("site_filter_relaxed", f"""select 'strict' as filter, count(*) as n from v_sites where {CLEAN_SQL} and {PLAIN_SQL}
union all select 'relaxed', count(*) from v_sites where {CLEAN_SQL} and ({PLAIN_SQL} or trim(manipulation) in ('Baseline', 'Monitoring', 'Natural', 'Reference', 'Undisturbed', 'Observational'))""")  # fmt: skip
def _(spark, sf):
    sites = view(spark, sf, "v_sites")
    count = lambda name, df: df.agg(F.lit(name).alias("filter"), F.count("*").alias("n"))
    return count("strict", op.filter_sites(sites)).unionByName(count("relaxed", op.filter_sites(sites, relaxed=True)))


@query("site_sources_union", "select site_id, source, longitude, latitude, rs_annual, manipulation from (select 'srdb_' || cast(rec as varchar) as site_id, 'srdb' as source, longitude, latitude, rs_annual, manipulation from v_sites where source = 'srdb' union all select 'cosore_' || cast(rec as varchar), 'cosore', longitude, latitude, rs_annual, null from v_sites where source = 'cosore')")
def _(spark, sf):
    sites = view(spark, sf, "v_sites")
    srdb = sites.filter("source = 'srdb'").select(F.concat(F.lit("srdb_"), F.col("rec").cast("string")).alias("site_id"), F.lit("srdb").alias("source"), "longitude", "latitude", "rs_annual", "manipulation")
    cosore = op.canonical_sites(sites.filter("source = 'cosore'").select("rec", F.col("longitude").alias("Lon"), F.col("latitude").alias("CSR_LATITUDE"), F.col("rs_annual").alias("Annual_RS")), key="rec")
    return op.union_sources(srdb, cosore)


@query("site_regions_split", f"select region, count(*) as n, count(*) filter (where longitude < -5e1) as n_west from (select *, {REGION_SQL} as region from v_sites) where region in ('asia', 'us') group by region")
def _(spark, sf):
    tagged = view(spark, sf, "v_sites").withColumn("region", geo.region_of(F.col("longitude"), F.col("latitude")))
    return tagged.filter(F.col("region").isin("asia", "us")).groupBy("region").agg(F.count("*").alias("n"), F.count_if(F.col("longitude") < -50).alias("n_west"))


MEASURED = ("bio01", "bio05", "bio06", "bio12", "bio14", "bio17", "nitrogen", "soc", "clay", "sand", "phh2o", "landcover", "stratum", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
SHARES_SQL = ", ".join(f"count({c}) / count(*) as {c}" for c in MEASURED)


@query("column_completeness", f"select column_name, present_share from (select {SHARES_SQL} from v_feat) unpivot (present_share for column_name in ({', '.join(MEASURED)})) order by present_share, column_name limit 15")
def _(spark, sf):
    return op.top_rows(op.completeness(view(spark, sf, "v_feat").select(*MEASURED)), [F.col("present_share"), F.col("column_name")], 15)


@query("source_value_counts", "select manipulation, count(*) as n from v_sites where manipulation is not null group by manipulation")
def _(spark, sf):
    return op.value_counts(view(spark, sf, "v_sites"), "manipulation")


@query("safe_numeric_cast", "select count(*) as n, count(try_cast(left(o_orderpriority, 1) as double)) as n_number, count(try_cast(o_orderpriority as double)) as n_whole, count(*) filter (where try_cast(o_orderstatus as double) is null) as n_bad from orders")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return o.agg(F.count("*").alias("n"), F.count(safe_number(F.substring("o_orderpriority", 1, 1))).alias("n_number"), F.count(safe_number(F.col("o_orderpriority"))).alias("n_whole"), F.count_if(safe_number(F.col("o_orderstatus")).isNull()).alias("n_bad"))


@query("description_fields", """with lines as (
  select s_suppkey as k, 1 as line_no, 'CSR_LATITUDE: ' || cast(s_suppkey as varchar) as line from supplier union all select s_suppkey, 2, '# a comment: here' from supplier
  union all select s_suppkey, 3, '' from supplier union all select s_suppkey, 4, 'CSR_SITE_NAME: ' || s_name || ': north' from supplier union all select s_suppkey, 5, 'CSR_LATITUDE: 7' from supplier where s_suppkey % 3 = 0)
select k, trim(regexp_extract(line, '^([^:]*):', 1)) as field, max_by(trim(regexp_extract(line, '^[^:]*:(.*)$', 1)), line_no) as value from lines where trim(line) <> '' and not starts_with(trim(line), '#') and contains(line, ':') group by 1, 2""")  # fmt: skip
def _(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    row = lambda df, n, line: df.select("k", F.lit(n).alias("line_no"), line.alias("line"))
    lines = op.union_sources(
        row(s, 1, F.concat(F.lit("CSR_LATITUDE: "), F.col("k").cast("string"))), row(s, 2, F.lit("# a comment: here")), row(s, 3, F.lit("")),
        row(s, 4, F.concat(F.lit("CSR_SITE_NAME: "), "s_name", F.lit(": north"))), row(s.filter("k % 3 = 0"), 5, F.lit("CSR_LATITUDE: 7")),
    )
    return op.description_fields(lines, "k")


PORTS_SQL = f"""ports as (select port, count(*) as n, count(distinct cast(t as date)) as n_days, date_diff('day', min(cast(t as date)), max(cast(t as date))) as span_days,
  avg(greatest(-2e0, least(5e1, flux))) as mean_flux from v_flux where t is not null and flux is not null and port is not null group by port
  having count(distinct cast(t as date)) >= 25 and date_diff('day', min(cast(t as date)), max(cast(t as date))) >= 27),
rates as (select *, mean_flux * {FLUX_TO_ANNUAL!r} as rs_annual from ports)"""


def ports(spark, sf):
    return op.integrate_flux(view(spark, sf, "v_flux"), least_days=25, least_span=27)


@query("flux_ports", f"with {PORTS_SQL} select port, n, n_days, cast(span_days as int) as span_days, round(mean_flux, 6) as mean_flux, round(rs_annual, 4) as rs_annual from rates")
def _(spark, sf):
    return ports(spark, sf).select("port", "n", "n_days", "span_days", F.round("mean_flux", 6).alias("mean_flux"), F.round("rs_annual", 4).alias("rs_annual"))


@query("flux_ports_by_parts", f"with {PORTS_SQL} select port, n, n_days, cast(span_days as int) as span_days, round(mean_flux, 6) as mean_flux, round(rs_annual, 4) as rs_annual from rates")
def _(spark, sf):
    from ..streaming.flux import day_totals, integrate_totals

    # as a stream leaves them: seven batches, each with rows of all days
    parts = day_totals(view(spark, sf, "v_flux").withColumn("batch", F.pmod(F.xxhash64("port", "t", "flux"), F.lit(7))), ("batch", "port"))
    return integrate_totals(parts, least_days=25, least_span=27).select("port", "n", "n_days", "span_days", F.round("mean_flux", 6).alias("mean_flux"), F.round("rs_annual", 4).alias("rs_annual"))


@query("flux_sites", f"with {PORTS_SQL} select port % 20 as site, round(avg(rs_annual), 4) as rs_annual, count(*) as n_ports from rates group by 1 having avg(rs_annual) between 5e1 and 1.8e4")
def _(spark, sf):
    return op.site_means(ports(spark, sf), F.col("port") % 20, high=18_000.0).select("site", F.round("rs_annual", 4).alias("rs_annual"), "n_ports")


@query("flux_outcomes", f"""with {PORTS_SQL}, status as (select p.port, case when p.port % 11 = 0 then 'skip_meta' when r.port is null then 'no_qualifying' else 'ok' end as outcome from (select distinct port from v_flux) p left join rates r on p.port = r.port)
select count(*) filter (where outcome = 'ok') as n_ok, count(*) filter (where outcome = 'skip_meta') as n_skip_meta, count(*) filter (where outcome = 'no_qualifying') as n_no_qualifying from status""")  # fmt: skip
def _(spark, sf):
    found = view(spark, sf, "v_flux").select("port").distinct().join(ports(spark, sf).select("port", F.lit(True).alias("ok")), "port", "left")
    outcome = F.when(F.col("port") % 11 == 0, "skip_meta").when(F.col("ok"), "ok").otherwise("no_qualifying")
    return found.select(outcome.alias("o")).agg(F.count_if(F.col("o") == "ok").alias("n_ok"), F.count_if(F.col("o") == "skip_meta").alias("n_skip_meta"), F.count_if(F.col("o") == "no_qualifying").alias("n_no_qualifying"))


@query("flux_daily", "select cast(cast(t as date) as varchar) as day, port, count(*) as n, round(avg(greatest(-2e0, least(5e1, flux))), 6) as mean_flux from v_flux group by 1, 2")
def _(spark, sf):
    from ..streaming.flux import daily_flux

    return daily_flux(view(spark, sf, "v_flux")).select(F.to_date("window.start").cast("string").alias("day"), "port", "n", F.round("mean_flux", 6).alias("mean_flux"))


@query("seeded_sample", "select o_orderkey, o_totalprice from orders order by ((((o_orderkey * 48271 + 42) % 2147483647) * ((o_orderkey * 48271 + 42) % 2147483647)) % 2147483647 + ((o_orderkey * 48271 + 42) % 2147483647) * 16807 + 7) % 2147483647, o_orderkey limit 200")
def _(spark, sf):
    return op.exact_sample(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 200)


@query("stratum_support", "select stratum, count(*) filter (where status = 'F') as n_a, count(*) filter (where status = 'O') as n_b, count(*) filter (where status = 'F') < 1000 or count(*) filter (where status = 'O') < 990 as skipped from v_pred group by stratum")
def _(spark, sf):
    return op.stratum_support(view(spark, sf, "v_pred"), "stratum", F.col("status") == "F", F.col("status") == "O", 1000, 990)


@query("default_source", "select lower(coalesce(case when rec % 3 = 0 then null else upper(source) end, 'srdb')) as source, count(*) as n from v_sites group by 1")
def _(spark, sf):
    given = F.when(F.col("rec") % 3 != 0, F.upper("source"))
    return view(spark, sf, "v_sites").groupBy(F.lower(F.coalesce(given, F.lit("srdb"))).alias("source")).agg(F.count("*").alias("n"))
