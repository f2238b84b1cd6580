"""Schema walks and scalar Column builders shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def numeric_cols(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> list[str]:
    """Numeric columns (integral, fractional, decimal) in schema order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def categorical_cols(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> list[str]:
    """String and boolean columns. Dates are kept apart (see temporal_cols)."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in exclude
    ]


def temporal_cols(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, TEMPORAL_TYPES) and f.name not in exclude]


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(dtype_of(df, name), NUMERIC_TYPES)


def nan_to_null(c: Column) -> Column:
    """Spark keeps NaN and NULL apart; the operators treat both as missing."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def safe_div(a: Column, b: Column, zero: str = "null") -> Column:
    """a / b with an explicit convention for b == 0 (ANSI mode raises otherwise).

    zero = "null" -> NULL, "zero" -> 0.0, "eps" -> a / (b + 1e-6).
    """
    a = a.cast("double")
    b = b.cast("double")
    if zero == "eps":
        return a / (b + F.lit(1e-6))
    fallback = F.lit(0.0) if zero == "zero" else F.lit(None).cast("double")
    return F.when(b != 0, a / b).otherwise(fallback)


def skewness_unbiased(c: Column) -> Column:
    """Bias-corrected sample skewness G1 (pandas `.skew()`); Spark's `skewness` is g1."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_unbiased(c: Column) -> Column:
    """Bias-corrected excess kurtosis G2 (pandas `.kurtosis()`); Spark's `kurtosis` is excess g2."""
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def round_doubles(df: DataFrame, digits: int = 6, overrides: dict[str, int] | None = None) -> DataFrame:
    """Round every double column (result tables only; keeps oracle comparisons stable)."""
    overrides = overrides or {}
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f.name).cast("double"), overrides.get(f.name, digits)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
