"""Queries over observed and predicted values, features and their distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest, stats
from ..registry import query
from ..session import table
from .views import view


def rnd(*names: str, digits: int = 6):
    return [F.round(n, digits).alias(n) for n in names]


@query("describe_column", "select count(bio12) as n, round(avg(bio12), 6) as mean, round(stddev_samp(bio12), 6) as std, min(bio12) as min, round(quantile_cont(bio12, 0.25), 6) as p25, round(quantile_cont(bio12, 0.5), 6) as p50, round(quantile_cont(bio12, 0.75), 6) as p75, max(bio12) as max from v_feat")
def _(spark, sf):
    return stats.describe(view(spark, sf, "v_feat"), "bio12").select("n", *rnd("mean", "std"), "min", *rnd("p25", "p50", "p75"), "max")


@query("quantiles_and_factor", "select round(quantile_cont(y, 0.05), 9) as p05, round(quantile_cont(y, 0.5), 9) as p50, round(quantile_cont(y, 0.95), 9) as p95, round(quantile_cont(p, 0.5) / quantile_cont(y, 0.5), 9) as factor from v_pred")
def _(spark, sf):
    pred = view(spark, sf, "v_pred")
    q = stats.exact_quantiles(pred, "y", {"p05": 0.05, "p50": 0.5, "p95": 0.95}).crossJoin(F.broadcast(stats.exact_quantiles(pred, "p", {"pm": 0.5})))  # one row each
    return q.select(*rnd("p05", "p50", "p95", digits=9), F.round(F.col("pm") / F.col("p50"), 9).alias("factor"))


@query("conditional_shares", "select r as row_no, count(*) as n, round(avg(case when v < 1e3 then 1 else 0 end), 6) as low_share, round(avg(case when v > 1.5e3 then 1 else 0 end), 6) as high_share from v_cells group by r")
def _(spark, sf):
    return view(spark, sf, "v_cells").groupBy(F.col("r").alias("row_no")).agg(F.count("*").alias("n"), F.round(stats.share_of_all(F.col("v") < 1000), 6).alias("low_share"), F.round(stats.share_of_all(F.col("v") > 1500), 6).alias("high_share"))


@query("pearson_sign_flips", """with long as (select feature, value, bio12, stratum from v_feat unpivot (value for feature in (bio14, nitrogen, soc)) ),
c as (select feature, corr(value, bio12) filter (where stratum = 'A') as r_a, corr(value, bio12) filter (where stratum = 'R') as r_b from long where value is not null group by feature)
select feature, round(r_a, 6) as r_a, round(r_b, 6) as r_b, coalesce((r_a > 1e-3 and r_b < -1e-3) or (r_a < -1e-3 and r_b > 1e-3), false) as sign_flip from c""")
def _(spark, sf):
    return stats.pearson_by_feature(view(spark, sf, "v_feat"), ["bio14", "nitrogen", "soc"], "bio12", "stratum", "A", "R", 1e-3).select("feature", *rnd("r_a", "r_b"), "sign_flip")


@query("regression_metrics", """select stratum, count(*) as n, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(y)), 6) as r2, round(sqrt(avg((y - p) ** 2)), 6) as rmse, round(avg(abs(y - p)), 6) as mae, round(avg(p - y), 6) as bias,
 round(sqrt(avg((y - p) ** 2)) / (max(y) - min(y)), 6) as nrmse, round(quantile_cont(abs(exp(y) - exp(p)), 0.5), 3) as median_ae_linear, round(avg(abs(exp(y) - exp(p))), 3) as mae_linear, round(stddev_pop(p), 6) as pred_std, round(stddev_pop(y), 6) as obs_std from v_pred group by stratum""")
def _(spark, sf):
    return stats.regression_metrics(view(spark, sf, "v_pred"), ["stratum"]).select("stratum", "n", *rnd("r2", "rmse", "mae", "bias", "nrmse"), *rnd("median_ae_linear", "mae_linear", digits=3), *rnd("pred_std", "obs_std"))


@query("fold_averages", "with m as (select o_custkey % 5 as fold, status, 1 - sum((y - p) ** 2) / (var_pop(y) * count(y)) as r2 from v_pred group by 1, 2) select status, round(avg(r2), 6) as r2_mean, round(stddev_pop(r2), 6) as r2_std, count(*) as n_folds from m group by status")
def _(spark, sf):
    m = stats.regression_metrics(view(spark, sf, "v_pred").withColumn("fold", F.col("o_custkey") % 5), ["fold", "status"])
    return m.groupBy("status").agg(F.round(F.avg("r2"), 6).alias("r2_mean"), F.round(F.stddev_pop("r2"), 6).alias("r2_std"), F.count("*").alias("n_folds"))


@query("spearman_by_stratum", """with r as (select stratum, rank() over (partition by stratum order by y) + (count(*) over (partition by stratum, y) - 1) / 2e0 as ry, rank() over (partition by stratum order by p) + (count(*) over (partition by stratum, p) - 1) / 2e0 as rp from v_pred)
select stratum, round(corr(ry, rp), 6) as rho, count(*) as n from r group by stratum""")
def _(spark, sf):
    return stats.spearman(view(spark, sf, "v_pred"), ["stratum"]).select("stratum", *rnd("rho"), "n")


@query("tertile_confusion", "with e as (select quantile_cont(y, 1e0 / 3) as e1, quantile_cont(y, 2e0 / 3) as e2 from v_pred) select cast(y >= e1 as int) + cast(y >= e2 as int) as observed, cast(p >= e1 as int) + cast(p >= e2 as int) as predicted, count(*) as n from v_pred, e group by 1, 2")
def _(spark, sf):
    return stats.tertile_confusion(view(spark, sf, "v_pred"))




BOOT_SQL = """with base as (select y, p, row_number() over (order by id) - 1 as i from v_pred), m as (select count(*) as n from base),
d0 as (select rep, k, n, (k * 48271 + rep * 69621 + 42) % 2147483647 as x from range(50) a(rep), (select unnest(range(n)) as k, n from m)),
d1 as (select rep, n, ((x * x) % 2147483647 + x * (16807 % 65536) + rep * 7919 + 16807) % 2147483647 as x from d0),
d2 as (select rep, n, ((x * x) % 2147483647 + x * (39373 % 65536) + rep * 7919 + 39373) % 2147483647 as x from d1),
d3 as (select rep, ((x * x) % 2147483647 + x * (630360016 % 65536) + rep * 7919 + 630360016) % 2147483647 % n as i from d2),
b as (select rep, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) as r2 from d3 join base using (i) group by rep)
select round(quantile_cont(r2, 0.025), 6) as low, round(quantile_cont(r2, 0.5), 6) as median, round(quantile_cont(r2, 0.975), 6) as high, quantile_cont(r2, 0.025) > 0 or quantile_cont(r2, 0.975) < 0 as excludes_zero, count(*) as n from b"""


@query("bootstrap_interval", BOOT_SQL)
def _(spark, sf):
    boot = stats.bootstrap_r2(view(spark, sf, "v_pred"), "id", 50)
    return stats.interval(boot).select(*rnd("low", "median", "high"), "excludes_zero", "n")


@query("histogram_fixed_bins", "select cast(least(floor((y - 6) / (6e0 / 20)), 19) as int) as bin, count(*) as n from v_pred where y between 6 and 12 group by 1")
def _(spark, sf):
    return stats.histogram(view(spark, sf, "v_pred"), "y", 6.0, 12.0, 20)


@query("feature_drift", """with long as (select feature, value, stratum from v_feat unpivot (value for feature in (bio12, nitrogen, soc))),
a as (select feature, avg(value) as m0, stddev_samp(value) as s0, min(value) as lo, max(value) as hi from long where stratum = 'A' group by feature),
j as (select feature, avg(value) as m1, avg(case when value between lo and hi then 1 else 0 end) as covered, any_value(m0) as m0, any_value(s0) as s0 from long join a using (feature) where stratum <> 'A' group by feature)
select feature, round((m1 - m0) / greatest(s0, 1e-9), 6) as shift, round(covered, 6) as covered, abs((m1 - m0) / greatest(s0, 1e-9)) > 0.5e0 or covered < 0.9e0 as warn from j""")
def _(spark, sf):
    f = view(spark, sf, "v_feat")
    return stats.drift(f.filter("stratum = 'A'"), f.filter("stratum <> 'A'"), ["bio12", "nitrogen", "soc"]).select("feature", *rnd("shift", "covered"), "warn")


@query("missing_shares", "with long as (select feature, value from (select nitrogen, soc, case when landcover < 5 then null else clay end as clay from v_feat) unpivot include nulls (value for feature in (clay, nitrogen, soc))) select feature, count(*) filter (where value is null) as n_missing, round(avg(case when value is null then 1 else 0 end), 6) as share, min(value) as min, max(value) as max, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, avg(case when value is null then 1 else 0 end) > 0.2e0 as warn from long group by feature")
def _(spark, sf):
    f = view(spark, sf, "v_feat").select("nitrogen", "soc", F.when(F.col("landcover") >= 5, F.col("clay")).alias("clay"))
    return stats.missing_shares(f, ["clay", "nitrogen", "soc"]).select("feature", "n_missing", *rnd("share"), "min", "max", *rnd("mean", "std"), "warn")


@query("median_imputation", "with m as (select median(nitrogen) as mn from v_feat) select landcover, round(sum(coalesce(nitrogen, mn)), 6) as total, count(*) as n from v_feat, m group by landcover")
def _(spark, sf):
    f = stats.impute_medians(view(spark, sf, "v_feat").select("landcover", "nitrogen"), ["nitrogen"])
    return f.groupBy("landcover").agg(F.round(F.sum("nitrogen"), 6).alias("total"), F.count("*").alias("n"))


@query("texture_sums", "with s as (select coalesce(clay, 0) + coalesce(nitrogen, 0) + coalesce(soc, 0) as total from v_feat) select round(quantile_cont(total, 0.05), 6) as p05, round(quantile_cont(total, 0.5), 6) as p50, round(quantile_cont(total, 0.95), 6) as p95 from s")
def _(spark, sf):
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in ("nitrogen", "soc")), F.coalesce("clay", F.lit(0.0)))
    return stats.exact_quantiles(view(spark, sf, "v_feat").select(total.alias("total")), "total", {"p05": 0.05, "p50": 0.5, "p95": 0.95}).select(*rnd("p05", "p50", "p95"))


@query("raw_layer_percentiles", "select count(*) filter (where sand = 0) as n_zero, round(quantile_cont(sand, 0.05) filter (where sand > 0), 6) as p05, round(quantile_cont(sand, 0.5) filter (where sand > 0), 6) as p50, round(quantile_cont(sand, 0.95) filter (where sand > 0), 6) as p95 from v_feat")
def _(spark, sf):
    f = view(spark, sf, "v_feat").select("sand")
    q = stats.exact_quantiles(f.filter("sand > 0"), "sand", {"p05": 0.05, "p50": 0.5, "p95": 0.95})  # one row
    return f.agg(F.count_if(F.col("sand") == 0).alias("n_zero")).crossJoin(F.broadcast(q)).select("n_zero", *rnd("p05", "p50", "p95"))


@query("target_sanity", "select count(*) filter (where rs_annual <= 0) as n_not_positive, count(*) filter (where rs_annual < 50) as n_low, count(*) filter (where rs_annual > 5000) as n_high, min(rs_annual) as lowest, max(rs_annual) as highest from v_sites")
def _(spark, sf):
    r = F.col("rs_annual")
    return view(spark, sf, "v_sites").agg(F.count_if(r <= 0).alias("n_not_positive"), F.count_if(r < 50).alias("n_low"), F.count_if(r > 5000).alias("n_high"), F.min(r).alias("lowest"), F.max(r).alias("highest"))


@query("reference_ranges", """with t as (select soc as value, case landcover % 3 when 0 then '15-30 g/kg' when 1 then '<8 g/kg' else '12' end as ref from v_feat),
n as (select value, ref, try_cast(regexp_extract_all(ref, '([0-9]+(?:\\.[0-9]+)?)')[1] as double) as lo, coalesce(try_cast(regexp_extract_all(ref, '([0-9]+(?:\\.[0-9]+)?)')[2] as double), try_cast(regexp_extract_all(ref, '([0-9]+(?:\\.[0-9]+)?)')[1] as double)) as hi from t)
select ref, case when value <= 0 then 'NODATA' when value < lo / 2 or value > hi * 2 then 'off' else 'ok' end as flag, count(*) as n from n group by 1, 2""")
def _(spark, sf):
    ref = F.when(F.col("landcover") % 3 == 0, "15-30 g/kg").when(F.col("landcover") % 3 == 1, "<8 g/kg").otherwise("12")
    return view(spark, sf, "v_feat").select(ref.alias("ref"), "soc").groupBy("ref", stats.range_flags(F.col("soc"), F.col("ref")).alias("flag")).agg(F.count("*").alias("n"))


@query("provenance", "select bool_or(contains(source, 'synthetic')) as has_synthetic, bool_or(source in ('srdb', 'cosore')) as has_real from v_sites")
def _(spark, sf):
    return view(spark, sf, "v_sites").agg(F.bool_or(F.contains("source", F.lit("synthetic"))).alias("has_synthetic"), F.bool_or(F.col("source").isin("srdb", "cosore")).alias("has_real"))


@query("mean_abs_attribution", "with long as (select feature, value from v_feat unpivot (value for feature in (bio01, bio06, sand))), m as (select feature, avg(abs(value)) as importance from long group by feature) select feature, round(importance, 6) as importance, row_number() over (order by importance desc, feature) as rank from m")
def _(spark, sf):
    from ..operators.models import importance_ranks

    long = view(spark, sf, "v_feat").unpivot([], ["bio01", "bio06", "sand"], "feature", "value")
    return importance_ranks(long).select("feature", *rnd("importance"), "rank")


@query("top_per_group", "select stratum, id, y, rank from (select stratum, id, y, row_number() over (partition by stratum order by abs(y - p) desc, id) as rank from v_pred) where rank <= 3")
def _(spark, sf):
    return ingest.top_in_group(view(spark, sf, "v_pred"), "stratum", [F.desc(F.abs(F.col("y") - F.col("p"))), F.col("id")], 3).select("stratum", "id", "y", "rank")


FOLD_SQL = """blocks as (select distinct cast(floor(longitude / 5e0) * 10000 + floor(latitude / 5e0) as bigint) as block from v_sites), keyed as (select block, ((block + 3000000) * 48271 + 42) % 2147483647 as x from blocks),
folds as (select block, ntile(5) over (order by ((x * x) % 2147483647 + x * 16807 + 7) % 2147483647, block) as fold from keyed)"""


@query("block_folds", f"with {FOLD_SQL} select block, fold from folds")
def _(spark, sf):
    from ..functions.geo import block_id

    return stats.fold_ids(view(spark, sf, "v_sites").select(block_id(F.col("longitude"), F.col("latitude")).alias("block")))


@query("fold_splits", f"with {FOLD_SQL}, s as (select rec, rs_annual, cast(floor(longitude / 5e0) * 10000 + floor(latitude / 5e0) as bigint) as block from v_sites) select fold, 'validation' as part, count(*) as n from s join folds using (block) group by fold union all select f.fold, 'training', count(*) from (select distinct fold from folds) f, s where s.block not in (select block from folds g where g.fold = f.fold) group by f.fold")
def _(spark, sf):
    from ..functions.geo import block_id

    sites = view(spark, sf, "v_sites").withColumn("block", block_id(F.col("longitude"), F.col("latitude")))
    folds = stats.fold_ids(sites)
    per = sites.join(folds, "block").groupBy("fold").agg(F.count("*").alias("n"))
    # a row of fold f trains every other fold: the training size is the total less the fold
    total = per.agg(F.sum("n").alias("total"))
    training = per.crossJoin(F.broadcast(total)).select("fold", F.lit("training").alias("part"), (F.col("total") - F.col("n")).alias("n"))
    return per.select("fold", F.lit("validation").alias("part"), "n").unionByName(training)


@query("semi_anti_blocks", f"with {FOLD_SQL}, s as (select rec, cast(floor(longitude / 5e0) * 10000 + floor(latitude / 5e0) as bigint) as block from v_sites) select rec, block in (select block from folds where fold = 2) as held_out from s")
def _(spark, sf):
    from ..functions.geo import block_id

    sites = view(spark, sf, "v_sites").select("rec", block_id(F.col("longitude"), F.col("latitude")).alias("block"))
    held = stats.fold_ids(sites).filter("fold = 2").select("block")
    return sites.join(held, "block", "left_semi").select("rec", F.lit(True).alias("held_out")).unionByName(sites.join(held, "block", "left_anti").select("rec", F.lit(False).alias("held_out")))


@query("delta_to_baseline", "with m as (select stratum, avg(y) as metric from v_pred group by stratum), b as (select metric as base from m where stratum = '1-URGENT') select stratum, round(metric, 6) as metric, round(metric - base, 6) as delta, case when stratum = '1-URGENT' then 'baseline' else 'variant' end as kind from m, b")
def _(spark, sf):
    m = view(spark, sf, "v_pred").groupBy("stratum").agg(F.avg("y").alias("metric"))
    base = m.filter("stratum = '1-URGENT'").select(F.col("metric").alias("base"))  # one row
    return m.crossJoin(F.broadcast(base)).select("stratum", *rnd("metric"), F.round(F.col("metric") - F.col("base"), 6).alias("delta"), F.when(F.col("stratum") == "1-URGENT", "baseline").otherwise("variant").alias("kind"))


@query("random_folds", "with h as (select o_orderkey, (o_orderkey * 48271 + 42) % 2147483647 as x from orders) select fold, count(*) as n, cast(sum(o_orderkey) as bigint) as key_sum from (select o_orderkey, ntile(5) over (order by ((x * x) % 2147483647 + x * 16807 + 7) % 2147483647, o_orderkey) as fold from h) group by fold")
def _(spark, sf):
    return stats.kfold_ids(table(spark, sf, "orders"), "o_orderkey").groupBy("fold").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))


@query("configuration_table", """with runs as (select stratum as config, 4 * cast(left(stratum, 1) as bigint) as n_features, round_even(corr(y, p), 3) as transfer_r2, round_even(avg(p - y), 3) as transfer_bias, round_even(stddev_samp(p), 3) as pred_std from v_pred group by stratum)
select config, n_features, case when n_features = 20 then 'all (incl. clay/sand/silt)' else 'selected (' || n_features || ' features)' end as features_kind, transfer_r2, transfer_bias, pred_std,
  round_even(transfer_r2 - (select transfer_r2 from runs where config = '1-URGENT'), 3) as delta_transfer_r2 from runs""")  # fmt: skip
def _(spark, sf):
    runs = view(spark, sf, "v_pred").groupBy(F.col("stratum").alias("config")).agg(F.corr("y", "p").alias("transfer_r2"), F.avg(F.col("p") - F.col("y")).alias("transfer_bias"), F.stddev_samp("p").alias("pred_std"))
    runs = runs.withColumn("n_features", F.substring("config", 1, 1).cast("long") * 4)
    return stats.configuration_table(runs, "1-URGENT", ["transfer_r2", "transfer_bias", "pred_std"], "transfer_r2")


@query("frequent_classes", "select landcover, count(*) as n from v_feat where landcover is not null group by landcover order by n desc, landcover limit 8")
def _(spark, sf):
    return ingest.value_counts(view(spark, sf, "v_feat"), "landcover", top=8, by_key=True)
