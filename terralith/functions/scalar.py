"""Scalar functions as column expressions: respiration, soil, features, clamps, colours, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import positive_scaled

# Molar mass of carbon (g), seconds in a year, and the factors from stored integers to soil units.
CARBON_G_PER_MOL, SECONDS_PER_YEAR = 12.011, 31_536_000.0
SOIL_SCALE = {"soc": 0.1, "nitrogen": 0.01, "phh2o": 0.1, "clay": 0.1, "sand": 0.1, "silt": 0.1, "bdod": 0.01, "cec": 0.1}
FLUX_TO_ANNUAL = CARBON_G_PER_MOL * SECONDS_PER_YEAR / 1e6


def log_target(rs: Column) -> Column:
    return F.ln(rs)


def back_transform(log_rs: Column) -> Column:
    return F.exp(log_rs)


def anomaly_ratio(log_pred: Column, log_baseline: Column) -> Column:
    """Prediction over baseline, both logarithmic: exp of the difference."""
    return F.exp(log_pred - log_baseline)


def annual_flux(umol: Column) -> Column:
    """From micromoles per square metre and second to grams of carbon per square metre and year."""
    return umol * F.lit(FLUX_TO_ANNUAL)


def clip(x: Column, low: float, high: float) -> Column:
    """Clamped to [low, high]; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def soil_units(columns: dict[str, Column]) -> dict[str, Column]:
    return {name: positive_scaled(c, SOIL_SCALE[name]).alias(name) for name, c in columns.items()}


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 (of either sign)."""
    return a / F.nullif(b, F.lit(0.0))


def ph_optimality(ph: Column, optimum: float = 6.5) -> Column:
    """Minus the distance from the best pH; values above 14 are pH * 10."""
    return -F.abs(F.when(ph > 14, ph / 10).otherwise(ph) - F.lit(optimum))


def aridity(bio12: Column, bio01: Column) -> Column:
    """De Martonne's index. At -10 degrees, where it is undefined, NULL."""
    return F.try_divide(bio12, bio01 + F.lit(10.0))


def diurnal_range(day: Column, night: Column) -> Column:
    return day - night


def one_hot(code: Column, classes: list[int], prefix: str = "lc_") -> list[Column]:
    """A float column for each class; a missing code is in none."""
    return [F.coalesce((code == c).cast("float"), F.lit(0.0).cast("float")).alias(f"{prefix}{c:02d}") for c in classes]


def bump(x: Column, centre: float, spread: float) -> Column:
    return F.exp(-F.pow(x - F.lit(centre), 2) / F.lit(spread))


def normalise(x: Column, low: float, high: float) -> Column:
    return (x - F.lit(low)) / F.lit(high - low)


def round_half_even(x: Column, digits: int = 0) -> Column:
    """Rounded half to even, as numeric libraries do; without digits on the double itself."""
    return F.rint(x) if digits == 0 else F.bround(x, digits)


def saturation(r: Column, g: Column, b: Column) -> Column:
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    return (high - low) / (high + F.lit(1e-6))


def over_white(channel: Column, alpha: Column) -> Column:
    """A channel (0-255) with its alpha (0-1) laid over white."""
    return channel * alpha + F.lit(255.0) * (F.lit(1.0) - alpha)


def red_blue_proxy(r: Column, b: Column) -> Column:
    return (r - b) / F.lit(255.0)


def ramp(x: Column, stops: list[tuple[float, tuple[int, int, int]]]) -> list[Column]:
    """Piecewise linear colour of x in [0, 1]: three channels, 0-255, rounded down."""
    x = clip(x, 0.0, 1.0)
    out = []
    for k, name in enumerate("rgb"):
        expr = F.lit(float(stops[-1][1][k]))
        for (a, ca), (b, cb) in reversed(list(zip(stops[:-1], stops[1:], strict=True))):
            expr = F.when(x <= b, F.lit(float(ca[k])) + (x - F.lit(a)) * F.lit((cb[k] - ca[k]) / (b - a))).otherwise(expr)
        out.append(F.when(x.isNotNull(), F.floor(expr)).cast("int").alias(name))
    return out


#: A diverging palette, dark red over white to dark blue.
DIVERGING = [(0.0, (103, 0, 31)), (0.25, (214, 96, 77)), (0.5, (247, 247, 247)), (0.75, (67, 147, 195)), (1.0, (5, 48, 97))]


def excludes_zero(low: Column, high: Column) -> Column:
    return (low > 0) | (high < 0)


def epoch_to_time(seconds: Column) -> Column:
    """A timestamp from seconds; what is no number gives NULL."""
    return F.timestamp_seconds(seconds.try_cast("double"))


def percent_change(log_difference: Column) -> Column:
    return F.exp(log_difference) - F.lit(1.0)


def floats_in(text: Column) -> Column:
    """All signed decimal numbers of a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+\.\d+)")), lambda x: x.cast("double"))


def path_or(document: Column, path: str, default: str) -> Column:
    """A nested value of a JSON text, or a default."""
    return F.coalesce(F.get_json_object(document, path), F.lit(default))


def zero_padded(number: Column, width: int = 2, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))
