"""Missing values: inside the engine they are NULL, never NaN. These builders keep it so at every boundary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that table readers take for a missing value.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every floating column with NaN replaced by NULL."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[F.nanvl(c, F.lit(None)).alias(c) if c in floats else F.col(c) for c in df.columns])


def tokens_to_null(df: DataFrame, tokens: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """Every text column with the tokens replaced by NULL."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[F.when(~F.col(c).isin(*tokens), F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns])


def all_present(names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names], F.lit(True))


def nodata_to_null(value: Column, nodata: float) -> Column:
    return F.nullif(value, F.lit(nodata))


def extreme_to_null(value: Column, low: float = -1e6, high: float = 1e9) -> Column:
    return F.when(value.between(low, high), value)


def positive_scaled(value: Column, scale: float) -> Column:
    """Non-positive becomes missing, the rest is scaled, in single precision."""
    v = value.cast("float")
    return F.when(v > 0, v * F.lit(scale).cast("float")).cast("float")


def safe_number(text: Column) -> Column:
    """The number a text holds, or NULL."""
    return text.try_cast("double")


def missing_or_in(value: Column, kept: tuple[str, ...]) -> Column:
    """Whether a value is one of those kept or missing (a NULL in the list of IN would lose rows)."""
    return value.isin(*kept) | value.isNull()
