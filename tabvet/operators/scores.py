"""Dataset-level scores, shape and meta-features, each one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.functions.core import numeric_cols
from tabvet.operators.colstats import column_stats
from tabvet.operators.profile import duplicate_rows, mean_abs_correlation, overview

# ---- fixed values: weights, limits and levels of the weighted quality score ----
MISSING_WEIGHT, IMBALANCE_LIMIT, IMBALANCE_PENALTY, DUPLICATE_PENALTY, ZERO_VARIANCE_PENALTY = 2, 3.0, 15, 10, 3
ROWS_FOR_BONUS, ROWS_BONUS, COLUMNS_FOR_BONUS, COLUMNS_BONUS, EXCELLENT, GOOD = 10000, 5, 15, 5, 80, 60


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """One row: classes, and the largest class's rows over the smallest one's (missing targets aside)."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("classes"), (F.max("n") / F.min("n")).alias("imbalance_ratio"))


def _flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("int"), F.lit(0))


def quality_score_weighted(df: DataFrame, target: str) -> DataFrame:
    """100 less weighted penalties (missing cells, class imbalance, duplicates, constant numbers), plus size bonuses."""
    cols = len(df.columns)
    constant = column_stats(df, numeric_cols(df), distinct=False).agg(F.coalesce(F.sum((F.col("std") == 0).cast("long")), F.lit(0)).alias("zero_variance"))
    one = overview(df).select("n_rows", "missing_pct").crossJoin(class_balance(df, target)) \
        .crossJoin(duplicate_rows(df).select("duplicate_pct")).crossJoin(constant)      # one row each
    score = (F.lit(100) - F.floor(F.col("missing_pct") * MISSING_WEIGHT)
             - _flag((F.col("classes") > 1) & (F.col("imbalance_ratio") > IMBALANCE_LIMIT)) * IMBALANCE_PENALTY
             - _flag(F.col("duplicate_pct") > 1) * DUPLICATE_PENALTY - F.col("zero_variance") * ZERO_VARIANCE_PENALTY
             + _flag(F.col("n_rows") > ROWS_FOR_BONUS) * ROWS_BONUS + (COLUMNS_BONUS if cols > COLUMNS_FOR_BONUS else 0))
    out = one.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long"))
    level = F.when(F.col("score") >= EXCELLENT, "Excellent").when(F.col("score") >= GOOD, "Good").otherwise("Fair")
    return out.select("missing_pct", "imbalance_ratio", "duplicate_pct", F.col("zero_variance").cast("long").alias("zero_variance"), "score", level.alias("level"))


def dataset_shape(df: DataFrame, target: str) -> DataFrame:
    """Size class, type counts, long text, class balance with its level, dimensionality and density."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    text = [c for c, k in kinds.items() if k == "string"]
    longest = [F.coalesce(F.max(F.length(c)), F.lit(0)) for c in text if c != target]
    has_text = (F.greatest(F.lit(0), F.lit(0), *longest) > 100).alias("has_text")
    one = overview(df).crossJoin(df.agg(has_text)).crossJoin(class_balance(df, target))     # one row each
    rows, ratio, cols = F.col("n_rows"), F.col("imbalance_ratio"), len(df.columns)
    size = F.when(rows < 1000, "tiny").when(rows < 10000, "small").when(rows < 100000, "medium").when(rows < 1000000, "large").otherwise("huge")
    level = F.when(ratio < 1.5, "balanced").when(ratio < 3, "slightly_imbalanced").when(ratio < 10, "imbalanced").otherwise("severely_imbalanced")
    return one.select(
        rows.cast("long").alias("n_rows"), F.lit(cols).cast("long").alias("n_columns"), size.alias("size_class"),
        F.col("n_numeric").cast("long").alias("numeric_count"), F.lit(len(text)).cast("long").alias("categorical_count"),
        F.lit(sum(k in ("date", "timestamp", "timestamp_ntz") for k in kinds.values())).cast("long").alias("datetime_count"), "has_text",
        F.col("classes").cast("long").alias("classes"), ratio.cast("double").alias("imbalance_ratio"), level.alias("imbalance_level"),
        F.lit("low" if cols < 10 else "medium" if cols < 50 else "high").alias("dimensionality"),
        F.round(1 - F.col("missing_pct") / 100, 2).alias("feature_density"), F.round(F.lit(cols) / rows, 4).alias("feature_ratio"))


def meta_features(df: DataFrame, target: str) -> DataFrame:
    """Eight numbers that describe a dataset; features are all columns but the target."""
    features = [c for c in df.columns if c != target]
    num = [c for c in numeric_cols(df) if c != target]
    zero = F.lit(0.0)
    one = overview(df).select("n_rows", "missing_pct").crossJoin(class_balance(df, target))     # one row each
    one = one.crossJoin(mean_abs_correlation(df, num)) if len(num) > 1 else one.withColumn("mean_abs_corr", zero)
    skew = column_stats(df, num, distinct=False).agg(F.avg(F.abs("skew")).alias("skewness")) if num else None
    one = one.crossJoin(skew) if skew is not None else one.withColumn("skewness", zero)
    return one.select(
        F.col("n_rows").cast("long").alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_cols"), F.lit(len(num)).cast("long").alias("n_numeric"),
        F.lit(len(features) - len(num)).cast("long").alias("n_categorical"), F.coalesce("imbalance_ratio", F.lit(1.0)).alias("class_imbalance"),
        F.coalesce("mean_abs_corr", zero).alias("mean_correlation"), F.coalesce("missing_pct", zero).alias("missing_percentage"),
        F.coalesce("skewness", zero).alias("skewness_mean"))
