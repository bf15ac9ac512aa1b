"""Statistics over tables of values: summaries, metrics of predictions, ranks, histograms, resampling, drift."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .ranks import before, even_parts

MERSENNE = 2**31 - 1
#: Multipliers of the resampling hash's rounds.
ROUND_KEYS = (16807, 39373, 630360016)
#: Draws of a bootstrap that are made at once; draws that meet in a block, about.
PIECE, MOST_DRAWS = 1 << 20, 1 << 22


def exact_quantiles(df: DataFrame, column: str, at: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, names of `at`): exact quantiles with linear interpolation, NULLs left out; without `by` one row, of NULLs if there is no value.

    Values are counted, counts are summed up by buckets of values, and the two values around each place are picked: no task holds
    all different values. The counts are written down, so that the passes over them see the same values.
    """
    group = ["_g"] if by else []  # a struct, which is no NULL where a group is
    keyed = df.filter(F.col(column).isNotNull()).select(*[F.struct(*by).alias(g) for g in group], F.col(column).alias("_v"))
    counts = checkpoint(keyed.groupBy(*group, "_v").agg(F.count("*").alias("_c")))
    total = counts.groupBy(*group).agg((F.sum("_c") - 1).alias("_last"))  # one row for each group
    ranked = before(counts, group, "_v", "_c")
    ranked = ranked.join(F.broadcast(total), group) if by else ranked.crossJoin(F.broadcast(total))
    k = F.col("before")
    holds = lambda place: F.max(F.when((k <= place) & (place < k + F.col("_c")), F.col("_v")))
    found = []
    for name, p in at.items():
        place = F.col("_last") * F.lit(float(p))
        found.append(F.struct(holds(F.floor(place)).alias("low"), holds(F.ceil(place)).alias("high"), F.max(place - F.floor(place)).alias("part")).alias(name))
    out = ranked.groupBy(*group).agg(*found)
    return out.select(*[F.col(f"_g.{c}") for c in by], *[(F.col(f"{n}.low") + (F.col(f"{n}.high") - F.col(f"{n}.low")) * F.col(f"{n}.part")).alias(n) for n in at])


def describe(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    out = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    q = exact_quantiles(df, column, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return out.crossJoin(F.broadcast(q)).select("n", "mean", "std", "min", "p25", "p50", "p75", "max")


def share_of_all(condition: Column) -> Column:
    """The share of rows that meet a condition; rows where it is unknown do not, but count."""
    return F.avg(F.coalesce(condition.cast("int"), F.lit(0)))


def r2(y: Column, p: Column) -> Column:
    """Coefficient of determination: 1 - SSE / SST, below 0 for a fit worse than the mean."""
    return F.lit(1.0) - F.sum(F.pow(y - p, 2)) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))


def regression_metrics(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """R2, RMSE, MAE, bias, NRMSE, median and linear absolute errors, spreads; one row for each group."""
    o, q = F.col(y), F.col(p)
    rows = df.filter(o.isNotNull() & q.isNotNull()).withColumn("_e", F.abs(F.exp(o) - F.exp(q)))
    rmse = F.sqrt(F.avg(F.pow(o - q, 2)))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), r2(o, q).alias("r2"), rmse.alias("rmse"), F.avg(F.abs(o - q)).alias("mae"), F.avg(q - o).alias("bias"),
        (rmse / F.nullif(F.max(o) - F.min(o), F.lit(0.0))).alias("nrmse"),
        F.avg("_e").alias("mae_linear"), F.stddev_pop(q).alias("pred_std"), F.stddev_pop(o).alias("obs_std"),
    )
    medians = exact_quantiles(rows, "_e", {"median_ae_linear": 0.5}, tuple(by))
    if by:
        medians = medians.withColumnsRenamed({c: f"_by_{c}" for c in by})
        same = [out[c].eqNullSafe(medians[f"_by_{c}"]) for c in by]
        out = out.join(F.broadcast(medians), same, "left")  # a row a group
    else:
        out = out.crossJoin(F.broadcast(medians))
    return out.select(*by, "n", "r2", "rmse", "mae", "bias", "nrmse", "median_ae_linear", "mae_linear", "pred_std", "obs_std")


def spearman(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Correlation of average ranks. Ranks come from counts of the distinct values, so that ties and large groups meet pre-aggregated.

    The rows are written down first: a value that is a sum may come out with another last bit when it is computed again, and would then not meet its rank.
    """
    group = ["_g"] if by else []  # a struct, which is no NULL where a group is
    rows = checkpoint(df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).select(*[F.struct(*by).alias(g) for g in group], y, p))
    out = rows
    for column, name in ((y, "_ry"), (p, "_rp")):
        counts = before(rows.groupBy(*group, column).agg(F.count("*").alias("n")), group, column, "n")
        out = out.join(counts.select(*group, column, (F.col("before") + (F.col("n") + 1) / 2).alias(name)), [*group, column])
    return out.groupBy(*group).agg(F.corr("_ry", "_rp").alias("rho"), F.count("*").alias("n")).select(*[F.col(f"_g.{c}") for c in by], "rho", "n")


def pearson_by_feature(df: DataFrame, features: list[str], target: str, region: str, a: str, b: str, margin: float = 0.05) -> DataFrame:
    """Correlation of each feature with the target in two regions, and whether the sign flips beyond a margin."""
    long = df.unpivot([target, region], features, "feature", "value").filter(F.col("value").isNotNull() & F.col(target).isNotNull())
    out = long.groupBy("feature").agg(*[F.corr(F.when(F.col(region) == r, F.col("value")), F.when(F.col(region) == r, F.col(target))).alias(n) for r, n in ((a, "r_a"), (b, "r_b"))])
    flips = ((F.col("r_a") > margin) & (F.col("r_b") < -margin)) | ((F.col("r_a") < -margin) & (F.col("r_b") > margin))
    return out.withColumn("sign_flip", F.coalesce(flips, F.lit(False)))


def tertile_confusion(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Counts of (observed, predicted) thirds; the edges are the observed thirds, an edge belongs above."""
    edges = exact_quantiles(df, y, {"a": 1 / 3, "b": 2 / 3}).select(F.array("a", "b").alias("_e"))  # one row
    third = lambda c: (F.col(c) >= F.col("_e")[0]).cast("int") + (F.col(c) >= F.col("_e")[1]).cast("int")
    return df.crossJoin(F.broadcast(edges)).groupBy(third(y).alias("observed"), third(p).alias("predicted")).agg(F.count("*").alias("n"))


def draw(rep: Column, k: Column, n: Column, seed: int = 42) -> Column:
    """A row number in [0, n) for draw k of replicate rep: rounds of a quadratic mix that any SQL engine can repeat."""
    m = F.lit(MERSENNE)
    x = (k * 48271 + rep * 69621 + seed) % m
    for key in ROUND_KEYS:
        x = (x * x % m + x * (key % 65536) + rep * 7919 + key) % m
    return x % n


def draw_numbers(rep: int, k: np.ndarray, n: int, seed: int = 42) -> np.ndarray:
    """The same for many draws of one replicate, as arrays."""
    x = (k * 48271 + rep * 69621 + seed) % MERSENNE
    for key in ROUND_KEYS:
        x = (x * x % MERSENNE + x * (key % 65536) + rep * 7919 + key) % MERSENNE
    return x % n


def bootstrap_r2(df: DataFrame, key: str, replicates: int, y: str = "y", p: str = "p", seed: int = 42) -> DataFrame:
    """R2 of each replicate: n draws with replacement.

    Rows are numbered and dealt into blocks of numbers. Draws are made a piece at a time and travel to their blocks packed,
    two bytes each; a block gives four sums for each replicate. Neither a replicate nor the table is ever in one place.
    """
    rows = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    numbered = checkpoint(before(rows.select(key, F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p")), [], key).select(F.col("before").alias("i"), "y", "p"))
    spark = df.sparkSession
    n, middle = numbered.agg(F.count("*"), F.avg("y")).first()  # one row; any value near the target keeps the squares small
    size = max(1_024, min(65_536, MOST_DRAWS // max(1, replicates)))
    pieces = max(1, -(-n // PIECE))

    def drawn(batches):
        for pdf in batches:
            for at in pdf["id"].tolist():
                rep, start = at // pieces, at % pieces * PIECE
                i = np.sort(draw_numbers(rep, np.arange(start, min(n, start + PIECE), dtype=np.int64), n, seed)) if n else np.zeros(0, np.int64)
                block, first = np.unique(i // size, return_index=True)
                packed = [part.astype(np.uint16).tobytes() for part in np.split(i % size, first[1:])] if len(i) else []
                yield pd.DataFrame({"block": block, "rep": np.full(len(block), rep), "at": packed})

    def summed(own: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        o, e = np.empty(size), np.empty(size)
        place = own["i"].to_numpy() % size
        o[place], e[place] = own["y"] - middle, (own["y"] - own["p"]) ** 2
        sums: dict[int, np.ndarray] = {}
        for rep, packed in zip(draws["rep"].tolist(), draws["at"], strict=True):
            at = np.frombuffer(packed, np.uint16)
            v = o[at]
            sums[rep] = sums.get(rep, 0.0) + np.array([len(at), v.sum(), (v * v).sum(), e[at].sum()])
        return pd.DataFrame([(rep, *s) for rep, s in sums.items()], columns=["rep", "n", "s1", "s2", "sse"])

    tasks = min(replicates * pieces, max(spark.sparkContext.defaultParallelism * 4, 1))
    draws = spark.range(0, replicates * pieces, 1, max(1, tasks)).mapInPandas(drawn, "block long, rep long, at binary")
    blocks = numbered.withColumn("block", F.floor(F.col("i") / size))
    each = blocks.groupBy("block").cogroup(draws.groupBy("block")).applyInPandas(summed, "rep long, n double, s1 double, s2 double, sse double")
    sums = each.groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2", "sse")])
    return sums.select("rep", (F.lit(1.0) - F.col("sse") / F.nullif(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.lit(0.0))).alias("r2"))


def interval(boot: DataFrame, column: str = "r2") -> DataFrame:
    q = F.percentile(column, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return boot.agg(q.alias("_q"), F.count(column).alias("n")).select(F.col("_q")[0].alias("low"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("high"), ((F.col("_q")[0] > 0) | (F.col("_q")[2] < 0)).alias("excludes_zero"), "n")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal bins; the last is closed, what lies outside is dropped, empty bins are absent."""
    b = F.least(F.floor((F.col(column) - low) / F.lit((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(column).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def drift(train: DataFrame, other: DataFrame, features: list[str], shift_at: float = 0.5, cover_at: float = 0.9) -> DataFrame:
    """For each feature: standardised shift of the mean, share of the other table within the training range, and a warning."""
    long = lambda df: df.unpivot([], features, "feature", "value").filter(F.col("value").isNotNull())
    base = long(train).groupBy("feature").agg(F.avg("value").alias("m0"), F.stddev_samp("value").alias("s0"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    out = long(other).join(F.broadcast(base), "feature").groupBy("feature").agg(  # base: one row for each feature
        F.first("m0").alias("m0"), F.first("s0").alias("s0"), F.avg("value").alias("m1"), F.avg(F.col("value").between(F.col("lo"), F.col("hi")).cast("int")).alias("covered")
    )
    shift = (F.col("m1") - F.col("m0")) / F.greatest(F.col("s0"), F.lit(1e-9))
    return out.select("feature", shift.alias("shift"), "covered", ((F.abs(shift) > shift_at) | (F.col("covered") < cover_at)).alias("warn"))


def missing_shares(df: DataFrame, features: list[str], warn_at: float = 0.2) -> DataFrame:
    long = df.unpivot([], features, "feature", "value")
    share = F.avg(F.col("value").isNull().cast("int"))
    return long.groupBy("feature").agg(F.count_if(F.col("value").isNull()).alias("n_missing"), share.alias("share"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), (share > warn_at).alias("warn"))


def impute_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values replaced by the column's exact median."""
    out = df
    for c in columns:
        out = out.crossJoin(F.broadcast(exact_quantiles(df, c, {f"_m_{c}": 0.5})))  # one row
    return out.select(*[F.coalesce(F.col(c), F.col(f"_m_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def range_flags(value: Column, text: Column, ph: bool = False) -> Column:
    """Compares a value with a reference range written as `lo-hi unit`, `<hi` or a number: off by a factor of two, or off a pH mid by 1.5."""
    numbers = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"))
    lo = F.try_element_at(numbers, F.lit(1)).cast("double")
    hi = F.coalesce(F.try_element_at(numbers, F.lit(2)).cast("double"), lo)
    off = F.abs(value - (lo + hi) / 2) > 1.5 if ph else (value < lo / 2) | (value > hi * 2)
    return F.when(value <= 0, "NODATA").when(off, "off").otherwise("ok")


def fold_ids(blocks: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """(block, fold): distinct blocks in a hashed order, cut into folds whose sizes differ by one at most.

    Blocks are cells of several degrees: a few thousand on the globe, whatever the number of rows.
    """
    k = F.col("block") + 3_000_000
    m = F.lit(MERSENNE)
    x = (k * 48271 + seed) % m
    order = (x * x % m + x * 16807 + 7) % m
    return blocks.select("block").distinct().select("block", F.ntile(folds).over(Window.orderBy(order, "block")).alias("fold"))


def kfold_ids(rows: DataFrame, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Folds of single rows, by a hashed order of their key."""
    from .ingest import hashed_order

    ordered = rows.select(key, hashed_order(F.col(key), seed).alias("_o"))
    return even_parts(ordered, "_o", folds, (key,)).select(key, "fold")


def ridge_sums(df: DataFrame, features: list[str], target: str, *by: str) -> DataFrame:
    """One row of sums (one for each group of `by`) that a ridge regression on standardised features is solved from: no row travels."""
    rows = df.na.drop(subset=[*features, target])
    sums = [F.count("*").alias("n"), F.sum(target).alias("y")]
    sums += [F.sum(c).alias(f"x_{c}") for c in features] + [F.sum(F.col(c) * F.col(target)).alias(f"xy_{c}") for c in features]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"xx_{a}_{b}") for i, a in enumerate(features) for b in features[i:]]
    return rows.groupBy(*by).agg(*sums)


def solve_ridge(sums: dict, features: list[str], alpha: float) -> dict[str, float]:
    """Coefficients in the units of the features, and `intercept`, from one row of ridge_sums."""
    n, k = sums["n"], len(features)
    mean = np.array([sums[f"x_{c}"] / n for c in features])
    cov = np.empty((k, k))
    for i, a in enumerate(features):
        for j in range(i, k):
            cov[i, j] = cov[j, i] = sums[f"xx_{a}_{features[j]}"] / n - mean[i] * mean[j]
    scale = np.sqrt(np.maximum(np.diag(cov), 0))
    scale[scale == 0] = 1.0
    xy = np.array([sums[f"xy_{c}"] / n for c in features]) - mean * sums["y"] / n
    beta = np.linalg.solve(cov / np.outer(scale, scale) * n + alpha * np.eye(k), xy / scale * n) / scale
    return dict(zip(features, beta.tolist(), strict=True)) | {"intercept": float(sums["y"] / n - mean @ beta)}


def share_of(seed: tuple[int, ...], sizes: list[int], at: int, total: np.ndarray) -> np.ndarray:
    """How many of each replicate's draws fall into part `at`: an exact multinomial over parts of these sizes, by a splitting tree.

    Halves share a replicate's draws by a binomial that is seeded by their place, so that every task finds its own
    share by as many steps as the tree is deep, and all shares add up.
    """
    before = np.r_[0, np.cumsum(sizes)]
    low, high = 0, len(sizes)
    while high - low > 1:
        middle = (low + high) // 2
        whole, left = int(before[high] - before[low]), int(before[middle] - before[low])
        taken = np.random.default_rng((*seed, low, high)).binomial(total, left / whole if whole else 0.0)
        total, (low, high) = (taken, (low, middle)) if at < middle else (total - taken, (middle, high))
    return total


def resampled_r2(pairs: DataFrame, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(group, ci_low, ci_high): the 95 % interval of r2 over bootstrap replicates of each group's (y, p) rows.

    One pass: a partition's share of each replicate's draws is an exact multinomial (share_of), drawn among its own rows, and
    gives four sums. Rows never travel; sums are groups x replicates x partitions before Spark adds them up.
    """
    rows = checkpoint(pairs.filter(F.col("y").isNotNull() & F.col("p").isNotNull()).select(F.col("group").cast("string").alias("group"), F.col("y").cast("double").alias("y"), F.col("p").cast("double").alias("p")))
    found = rows.groupBy("group", F.spark_partition_id().alias("at")).agg(F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("group", "at").collect()  # groups x partitions
    sizes: dict[str, dict[int, int]] = {}
    middle: dict[str, float] = {}
    for r in found:
        sizes.setdefault(r["group"], {})[r["at"]] = r["n"]
        middle.setdefault(r["group"], r["y"])  # any value near the target keeps the squares small
    number = {g: i for i, g in enumerate(sorted(sizes))}

    def run(batches):
        held: dict[str, list[np.ndarray]] = {}
        for pdf in batches:
            for group, own in pdf.groupby("group"):
                held.setdefault(group, []).append(own[["y", "p"]].to_numpy(float))
        here = TaskContext.get().partitionId()
        for group, parts in held.items():
            y, p = np.concatenate(parts).T
            places = sorted(sizes[group])
            draws = share_of((seed, number[group]), [sizes[group][k] for k in places], places.index(here), np.full(replicates, sum(sizes[group].values())))
            y0, e = y - middle[group], (y - p) ** 2
            rng = np.random.default_rng((seed, number[group], here, len(y)))
            out = np.empty((replicates, 4))
            for k, m in enumerate(draws.tolist()):
                i = rng.integers(0, len(y), m)
                v = y0[i]
                out[k] = m, v.sum(), (v * v).sum(), e[i].sum()
            yield pd.DataFrame({"group": group, "replicate": np.arange(replicates), **{c: out[:, j] for j, c in enumerate(("n", "sy", "syy", "sse"))}})

    sums = rows.mapInPandas(run, "group string, replicate int, n double, sy double, syy double, sse double").groupBy("group", "replicate").agg(*[F.sum(c).alias(c) for c in ("n", "sy", "syy", "sse")])
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    each = sums.select("group", F.when(sst > 0, 1 - F.col("sse") / sst).alias("r2"))
    return each.groupBy("group").agg(F.percentile("r2", F.lit(0.025)).alias("ci_low"), F.percentile("r2", F.lit(0.975)).alias("ci_high"))  # as many rows as replicates


def configuration_table(runs: DataFrame, baseline: str, metrics: list[str], compared: str, all_features: int = 20, digits: int = 3) -> DataFrame:
    """The report of a sweep (config, n_features, metrics): what kind of features each configuration has, metrics rounded half to even, and the rounded difference of one metric to the baseline's.

    A baseline that is absent leaves the difference empty; one that occurs twice counts with its largest value. Columns other than the named ones are not read.
    """
    many = F.col("n_features")
    kind = F.when(many == all_features, "all (incl. clay/sand/silt)").when(many.isNotNull(), F.format_string("selected (%d features)", many.cast("long")))
    out = runs.select("config", "n_features", kind.alias("features_kind"), *[F.bround(F.col(m), digits).alias(m) for m in metrics])
    base = out.agg(F.max(F.when(F.col("config") == baseline, F.col(compared))).alias("_base"))  # one row
    return out.crossJoin(F.broadcast(base)).withColumn(f"delta_{compared}", F.bround(F.col(compared) - F.col("_base"), digits)).drop("_base")
