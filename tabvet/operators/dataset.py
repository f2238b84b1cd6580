"""Dataset-level D operators: describe, fingerprint, stability before/after cleaning, cluster
profile. Each is a small number of wide aggregates; results have one row per column (or per
cluster x column)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.functions.core import nan_to_null, numeric_cols
from tabvet.operators.colstats import column_stats, distinct_table, number_counts
from tabvet.operators.longform import quantiles_from_counts


# ------------------------------------------------------------------ D2
def describe_all(df: DataFrame) -> DataFrame:
    """pandas `describe(include='all')` per column plus null %: count, unique / top / freq for
    non-numeric columns (top: most frequent, ties by smallest value), mean / std / min /
    quartiles / max for numeric columns."""
    num = numeric_cols(df)
    oth = [c for c in df.columns if c not in num]
    table = distinct_table(df, df.columns)  # of every column: distinct counts, quartiles and modes come from it
    st = column_stats(df, table=table).select("column", "position", "n_rows", "n_null", "n_distinct", "mean", "std", "min", "max")
    q = quantiles_from_counts(number_counts(table), [0.25, 0.5, 0.75]).groupBy("column").pivot("prob", [0.25, 0.5, 0.75]) \
        .agg(F.first("quantile")).toDF("column", "q25", "q50", "q75") if num else None
    most = F.min(F.struct((-F.col("n")).alias("n"), F.col("t").alias("mode"))).alias("m")
    m = table.where(F.col("column").isin(oth)).groupBy("column").agg(most).select("column", "m.mode", (-F.col("m.n")).alias("mode_count")) if oth else None
    t = st
    if q is not None:
        t = t.join(q, "column", "left")
    else:
        t = t.select("*", *[F.lit(None).cast("double").alias(c) for c in ("q25", "q50", "q75")])
    if m is not None:
        t = t.join(m, "column", "left")
    else:
        t = t.select("*", F.lit(None).cast("string").alias("mode"), F.lit(None).cast("long").alias("mode_count"))
    is_num = F.col("column").isin(num) if num else F.lit(False)
    return t.select(
        "column", "position", (F.col("n_rows") - F.col("n_null")).alias("count"),
        F.when(~is_num, F.col("n_distinct")).alias("unique"), F.when(~is_num, F.col("mode")).alias("top"),
        F.when(~is_num, F.col("mode_count")).alias("freq"),
        F.when(is_num, F.col("mean")).alias("mean"), F.when(is_num, F.col("std")).alias("std"),
        F.when(is_num, F.col("min")).alias("min"), "q25", "q50", "q75", F.when(is_num, F.col("max")).alias("max"),
        (F.col("n_null") * 100.0 / F.col("n_rows")).alias("null_pct"))


# ------------------------------------------------------------------ D26
def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """Order-independent content hash (sum of per-row xxhash64 as a 38-digit decimal, so equal
    multisets of rows hash equal however they are partitioned) and a SHA-256 of the shape,
    dtypes and numeric mean / std / min / max."""
    num = numeric_cols(df)
    h = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")
    stats = [F.struct(F.lit(c).alias("c"), F.avg(nan_to_null(F.col(c))).alias("mean"),
                      F.stddev_samp(nan_to_null(F.col(c))).alias("std"), F.min(nan_to_null(F.col(c))).alias("min"),
                      F.max(nan_to_null(F.col(c))).alias("max")) for c in num]
    schema = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    g = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).alias("_hs"), F.array(*stats).alias("_st") if stats
               else F.array().alias("_st"))
    return g.select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"),
        F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), F.lit(schema), F.col("_hs").cast("string")), 256)
        .alias("content_hash"),
        F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), F.lit(schema), F.to_json("_st")), 256).alias("stats_hash"))


# ------------------------------------------------------------------ D27
def stability_check(before: DataFrame, after: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Per numeric column present in both: mean / std (sample) before and after, relative shifts
    in % (absolute when the raw value is 0), stable when the mean shift <= threshold."""
    cols = [c for c in numeric_cols(before) if c in after.columns]

    def stats(df, tag):
        r = df.agg(*[F.avg(nan_to_null(F.col(c))).alias(f"m{i}") for i, c in enumerate(cols)],
                   *[F.stddev_samp(nan_to_null(F.col(c))).alias(f"s{i}") for i, c in enumerate(cols)])
        return r.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                                                     F.col(f"m{i}").alias(f"{tag}_mean"),
                                                     F.coalesce(F.col(f"s{i}"), F.lit(0.0)).alias(f"{tag}_std"))
                                            for i, c in enumerate(cols)])).alias("r")).select("r.*")

    t = stats(before, "raw").join(stats(after, "cleaned"), ["column", "position"])

    def shift(a, b):
        return F.when(F.col(a) != 0, F.abs(F.col(b) - F.col(a)) / F.abs(F.col(a))).otherwise(F.abs(F.col(b) - F.col(a)))

    return t.where(F.col("raw_mean").isNotNull()).select(
        "column", "position", "raw_mean", "cleaned_mean", (shift("raw_mean", "cleaned_mean") * 100).alias("mean_shift_pct"),
        "raw_std", "cleaned_std", (shift("raw_std", "cleaned_std") * 100).alias("std_shift_pct"),
        (shift("raw_mean", "cleaned_mean") <= threshold).alias("is_stable"))


def stability_summary(check: DataFrame) -> DataFrame:
    s = F.sum(F.col("is_stable").cast("int"))
    return check.agg(s.alias("stable_columns"), F.count(F.lit(1)).alias("total_columns")).select(
        "stable_columns", (F.col("total_columns") - F.col("stable_columns")).alias("unstable_columns"), "total_columns",
        (F.col("stable_columns") == F.col("total_columns")).alias("overall_stable"),
        F.round(F.col("stable_columns") * 100.0 / F.col("total_columns"), 1).alias("stability_score"))


# ------------------------------------------------------------------ D29
def cluster_profile(df: DataFrame, cluster: str, features: list[str], z_min: float = 0.5) -> DataFrame:
    """Per cluster and feature: cluster mean, z of the cluster mean against the overall mean and
    sample std, HIGH / LOW when |z| > 0.5, cluster size and share of rows."""
    overall = df.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(nan_to_null(F.col(c))).alias(f"om{i}") for i, c in enumerate(features)],
                     *[F.stddev_samp(nan_to_null(F.col(c))).alias(f"os{i}") for i, c in enumerate(features)])
    per = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"),
                                  *[F.avg(nan_to_null(F.col(c))).alias(f"cm{i}") for i, c in enumerate(features)])
    j = per.crossJoin(F.broadcast(overall))       # one-row overall statistics
    long = j.select(cluster, "size", "_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"cm{i}").alias("mean"), F.col(f"om{i}").alias("overall_mean"),
                 F.col(f"os{i}").alias("overall_std")) for i, c in enumerate(features)])).alias("r")).select(cluster, "size", "_n", "r.*")
    z = F.when(F.col("overall_std") > 0, (F.col("mean") - F.col("overall_mean")) / F.col("overall_std"))
    return long.select(F.col(cluster).alias("cluster"), "feature", "mean", z.alias("z"),
                       F.when(z > z_min, F.lit("HIGH")).when(z < -z_min, F.lit("LOW")).alias("level"),
                       "size", (F.col("size") / F.col("_n")).alias("size_share"))
