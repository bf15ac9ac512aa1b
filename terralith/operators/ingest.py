"""Cleaning, tagging and de-duplicating site tables; integrating flux series; column and schema helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.missing import missing_or_in
from ..functions.scalar import FLUX_TO_ANNUAL, clip

RS_RANGE = (50.0, 4500.0)
UNMANIPULATED = ("None", "Control", "control")
# Further labels that mean no treatment, for the relaxed filter.
RELAXED = (
    "Collar depth", "Shallow Collars", "Deep Collars", "Sampling collars, SC", "Trenched collars", "Hydrogeomorphic setting", "No grazing",
    "Undrained, unplanted", "Observational", "Monitoring", "Baseline", "Natural", "Reference", "Undisturbed",
)
SYNONYMS = {"latitude": ("latitude", "lat", "csr_latitude"), "longitude": ("longitude", "lon", "csr_longitude"), "rs_annual": ("rs_annual", "annual_rs", "annual_flux_gc_m2_yr", "rs")}
CANONICAL = ("site_id", "source", "longitude", "latitude", "rs_annual")


def rename_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def keep_present(df: DataFrame, required: list[str], optional: list[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*required, *[c for c in optional if c in df.columns])


def features_of(df: DataFrame, dropped: set[str]) -> list[str]:
    """All columns but those dropped, in order."""
    return [c for c in df.columns if c not in dropped]


def first_present(df: DataFrame, *names: str) -> Column:
    """The first of several names that the table has."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    raise ValueError(f"none of {names}")


def canonical_sites(df: DataFrame, source: str = "cosore", key: str | None = None) -> DataFrame:
    """A site table in the canonical columns: as it is if it has them, else by their synonyms, whatever their case."""
    if set(CANONICAL) <= set(df.columns):
        return df.select(*CANONICAL)
    lower = {c.lower(): c for c in df.columns}
    found = {k: next((lower[s] for s in v if s in lower), None) for k, v in SYNONYMS.items()}
    if not all(found.values()):
        raise ValueError(f"no column for {sorted(k for k, v in found.items() if not v)}")
    ident = F.concat(F.lit(f"{source}_"), F.col(key).cast("string") if key else F.monotonically_increasing_id().cast("string"))
    return df.select(ident.alias("site_id"), F.lit(source).alias("source"), *[F.col(found[k]).cast("double").alias(k) for k in ("longitude", "latitude", "rs_annual")])


def filter_sites(df: DataFrame, relaxed: bool = False, low: float = RS_RANGE[0], high: float = RS_RANGE[1]) -> DataFrame:
    """Rows with a position and a plausible rate, without manipulation. relaxed: trimmed labels that mean no treatment count too."""
    out = df.na.drop(subset=["latitude", "longitude", "rs_annual"]).filter(F.col("rs_annual").between(low, high))
    if "manipulation" not in df.columns:
        return out
    kept = missing_or_in(F.col("manipulation"), UNMANIPULATED)
    if relaxed:
        label = F.trim("manipulation")
        kept = missing_or_in(label, (*UNMANIPULATED, "nan", "", *RELAXED))
    return out.filter(kept)


def tag_sites(df: DataFrame, key: str = "rec") -> DataFrame:
    """site_id, log rate and region added."""
    return df.withColumn("site_id", F.concat("source", F.lit("_"), F.col(key).cast("string"))).withColumn("log_rs_annual", F.ln("rs_annual")).withColumn("region", geo.region_of(F.col("longitude"), F.col("latitude")))


def dedup_cells(df: DataFrame, size: float = geo.CELL_DEG, order: tuple[str, ...] = ("source", "site_id")) -> DataFrame:
    """One row for each cell of the grid: the first by the given order.

    The choice is a minimum over the row, so that rows meet in a partial aggregate before they travel, not in a window.
    """
    cells = df.withColumn("_gx", geo.cell_id(F.col("longitude"), size)).withColumn("_gy", geo.cell_id(F.col("latitude"), size))
    row = F.struct(*[F.col(c) for c in df.columns])
    return cells.groupBy("_gx", "_gy").agg(F.min_by(row, F.struct(*[F.col(c) for c in order])).alias("_row")).select("_row.*")


def union_sources(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def build_target(sites: DataFrame, **options) -> DataFrame:
    return dedup_cells(tag_sites(filter_sites(sites, **options)))


def region_summary(sites: DataFrame) -> DataFrame:
    return sites.groupBy("region").agg(F.count("*").alias("n"), F.min("rs_annual").alias("rs_min"), F.avg("rs_annual").alias("rs_mean"), F.percentile("rs_annual", 0.5).alias("rs_median"), F.max("rs_annual").alias("rs_max"), F.avg("log_rs_annual").alias("log_mean"))


def completeness(df: DataFrame) -> DataFrame:
    """(column, present_share) for every column: one pass over the table."""
    one = df.agg(*[(F.count(F.col(c)) / F.count(F.lit(1))).alias(c) for c in df.columns])
    return one.unpivot([], list(df.columns), "column_name", "present_share")


def integrate_flux(flux: DataFrame, keys: tuple[str, ...] = ("port",), *, least_days: int = 150, least_span: int = 180, low: float = -2.0, high: float = 50.0) -> DataFrame:
    """Annual rate of each port with enough days and span: the mean of the clamped flux."""
    rows = flux.filter(F.col("t").isNotNull() & F.col("flux").isNotNull() & F.col(keys[-1]).isNotNull()).withColumn("_day", F.to_date("t"))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.countDistinct("_day").alias("n_days"),
        F.datediff(F.max("_day"), F.min("_day")).alias("span_days"),
        F.avg(clip(F.col("flux"), low, high)).alias("mean_flux"),
    )
    return out.filter((F.col("n_days") >= least_days) & (F.col("span_days") >= least_span)).withColumn("rs_annual", F.col("mean_flux") * F.lit(FLUX_TO_ANNUAL))


def site_means(ports: DataFrame, site: Column, low: float = RS_RANGE[0], high: float = RS_RANGE[1]) -> DataFrame:
    """The unweighted mean over a site's qualifying ports; implausible sites go."""
    return ports.groupBy(site.alias("site")).agg(F.avg("rs_annual").alias("rs_annual"), F.count("*").alias("n_ports")).filter(F.col("rs_annual").between(low, high))


def value_counts(df: DataFrame, column: str, top: int | None = None, by_key: bool = False) -> DataFrame:
    """Rows of each value that is not missing: of all values, or of the `top` most frequent (ties to the smaller value); by_key: in the order of the values."""
    out = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    if top is not None:
        out = top_rows(out, [F.desc("n"), F.asc(column)], top)
    return out.orderBy(column) if by_key else out


def description_fields(lines: DataFrame, key: str, line: str = "line", order: str = "line_no") -> DataFrame:
    """(key, field, value) from `name: value` lines: blank lines and comments are skipped, the last of a name wins."""
    text = F.trim(line)
    parts = lines.filter((text != "") & ~text.startswith("#") & F.col(line).contains(":"))
    field, value = F.trim(F.regexp_extract(line, r"^([^:]*):", 1)), F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1))
    return parts.groupBy(F.col(key), field.alias("field")).agg(F.max_by(value, F.col(order)).alias("value"))


def stratum_support(df: DataFrame, stratum: str, is_a: Column, is_b: Column, least_a: int, least_b: int) -> DataFrame:
    """Counts of two kinds in each stratum, missing ones 0, and whether the stratum is skipped."""
    out = df.groupBy(stratum).agg(F.count_if(is_a).alias("n_a"), F.count_if(is_b).alias("n_b"))
    return out.withColumn("skipped", (F.col("n_a") < least_a) | (F.col("n_b") < least_b))


def hashed_order(key: Column, seed: int) -> Column:
    """A portable pseudo-random order: one round of a quadratic mix below 2**31 - 1; keys must not be negative."""
    m = 2**31 - 1
    x = (key * 48271 + seed) % m
    return (x * x % m + x * 16807 + 7) % m


def exact_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same ones each time; a top-n, not a full sort."""
    return df.withColumn("_o", hashed_order(F.col(key), seed)).orderBy("_o", key).limit(n).drop("_o")


def top_rows(df: DataFrame, by: list[Column], n: int) -> DataFrame:
    return df.orderBy(*by).limit(n)


def top_in_group(df: DataFrame, group: str, by: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*by))).filter(F.col("rank") <= n)
