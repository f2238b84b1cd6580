"""Shared kernel #1: per-column statistics, one row per column.

All columns are handled in one plan: the table is stacked to a long (column, integer, text, number) stream, every value
in its own type, and aggregated with one small set of aggregate functions keyed by column. One scan gives row counts,
NULLs and moments of all columns; a second one the typed distinct-value table, which is stored once and serves exact
distinct counts and exact quantiles. The generated code has the same size for 5 or 500 columns, partial aggregates are
combined map-side, and the shuffle carries one row per column (or distinct value) and task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvet.functions.core import NUMERIC_TYPES, kurtosis_unbiased, skewness_unbiased
from tabvet.session import materialize

NUMERIC_STATS = ("min", "max", "mean", "std", "var", "skew", "kurt", "sum")


def schema_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, dtype, position, is_numeric) from the schema -- metadata only."""
    fields = {f.name: f for f in df.schema.fields}
    rows = [(c, fields[c].dataType.simpleString(), i, isinstance(fields[c].dataType, NUMERIC_TYPES)) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string, position int, is_numeric boolean")


def typed_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, i, t, x) for every cell: integers in `i`, numbers other than integers and decimals in `x` only, decimals
    and other types as text in `t`; `x` has every numeric value as double. Missing (NULL, NaN) is NULL in all three."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for c in cols:
        kind, v = fields[c], F.col(f"`{c}`")
        x = v.cast("double") if isinstance(kind, NUMERIC_TYPES) else F.lit(None).cast("double")
        whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        floating = isinstance(kind, (T.FloatType, T.DoubleType))
        parts += [F.lit(c), v.cast("long") if whole else F.lit(None).cast("long"),
                  F.lit(None).cast("string") if whole or floating else v.cast("string"),
                  F.nanvl(x, F.lit(None).cast("double")) if floating else x]
    return df.select(F.stack(F.lit(len(cols)), *parts).alias("column", "i", "t", "x"))


def distinct_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """The stored typed distinct-value table (column, i, t, x, n); equal values in their own type are one row."""
    present = F.coalesce(F.col("i").cast("string"), F.col("t"), F.col("x").cast("string")).isNotNull()
    return materialize(typed_long(df, cols).where(present).groupBy("column", "i", "t", "x").agg(F.count(F.lit(1)).alias("n")))


def number_counts(table: DataFrame) -> DataFrame:
    """(column, value double, n) of the numeric columns of a distinct table."""
    return table.where("x is not null").groupBy("column", F.col("x").alias("value")).agg(F.sum("n").alias("n"))


def column_stats(df: DataFrame, cols: list[str] | None = None, numeric_stats: bool = True,
                 exact_distinct: bool = True, distinct: bool = True, table: DataFrame | None = None) -> DataFrame:
    """One row per column: column, dtype, position, is_numeric, n_rows, n_null, n_distinct, and
    for numeric columns min, max, mean, std (sample), var, skew, kurt (bias-corrected), sum.

    Missing = NULL, or NaN for floating columns. `exact_distinct=False` switches distinct
    counts to HyperLogLog++ (no distinct-value shuffle); `distinct=False` skips them; `table` is a
    distinct table of these columns that is there already.
    """
    cols = cols or df.columns
    meta = schema_table(df, cols)
    x = F.col("x")
    value = F.struct("i", "t", "x")
    present = F.col("i").isNotNull() | F.col("t").isNotNull() | x.isNotNull()
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count(F.when(present, 1)).alias("n_nonnull")]
    if numeric_stats:
        aggs += [F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                 F.var_samp(x).alias("var"), skewness_unbiased(x).alias("skew"), kurtosis_unbiased(x).alias("kurt"),
                 F.sum(x).alias("sum")]
    if distinct and not exact_distinct:
        aggs.append(F.approx_count_distinct(F.when(present, F.xxhash64(value))).alias("n_distinct"))
    stats = typed_long(df, cols).groupBy("column").agg(*aggs)
    if distinct and exact_distinct:
        table = distinct_table(df, cols) if table is None else table
        stats = stats.join(table.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct")), "column", "left")
    # every side table has one row per column: broadcast joins
    out = meta.join(F.broadcast(stats), "column", "left")
    rows = F.coalesce(F.col("n_rows"), F.lit(0)).cast("long")
    sel = [F.col("column"), F.col("dtype"), F.col("position"), F.col("is_numeric"), rows.alias("n_rows"),
           (rows - F.coalesce(F.col("n_nonnull"), F.lit(0))).cast("long").alias("n_null"),
           (F.coalesce(F.col("n_distinct"), F.lit(0)).cast("long") if distinct else F.lit(None).cast("long")).alias("n_distinct")]
    for s in NUMERIC_STATS:
        known = F.when(F.col("is_numeric"), F.col(s)) if numeric_stats else F.lit(None)
        sel.append(known.cast("double").alias(s))
    return out.select(*sel)
