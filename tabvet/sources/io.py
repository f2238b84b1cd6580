"""A-series: readers, writers and catalogs. Every sink is a Spark writer into a folder (append
or overwrite per partition), every reader a Spark reader with an explicit schema where one is
known, so files written by many executors are read back by many executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.functions.core import numeric_cols
from tabvet.operators.colstats import column_stats
from tabvet.operators.profile import histogram, top_values
from tabvet.session import path_exists

PREDICTION_LOG_SCHEMA = ("ts timestamp, model string, version string, event_id long, prediction string, "
                         "confidence double, actual string")


# ------------------------------------------------------------------ A1 / A2 / A3
def read_csv(spark: SparkSession, path: str, schema: str | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """CSV with header; inferred types unless a schema is given."""
    r = spark.read.option("header", True).option("mode", mode)
    r = r.schema(schema) if schema else r.option("inferSchema", True)
    return r.csv(path)


def default_target(df: DataFrame, target: str | None = None) -> str:
    """The named target if present, else the last column."""
    return target if target and target in df.columns else df.columns[-1]


def dataset_catalog(df: DataFrame, name: str) -> DataFrame:
    """One row per column: dataset name, row count, column, position, dtype."""
    spark = df.sparkSession
    cols = spark.createDataFrame([(f.name, i, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
                                 "column string, position int, dtype string")
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return cols.crossJoin(n).select(F.lit(name).alias("dataset"), "n_rows", "column", "position", "dtype")


# ------------------------------------------------------------------ A4 / A5 / A10
def append_prediction_log(preds: DataFrame, path: str) -> None:
    """Append predictions as JSON lines partitioned by model and version."""
    preds.write.mode("append").partitionBy("model", "version").json(path)


def read_prediction_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION_LOG_SCHEMA).json(path)


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Append alert rows as JSON lines (batch); streams use a foreachBatch sink."""
    alerts.write.mode("append").json(path)


def save_leaderboard(board: DataFrame, path: str) -> None:
    board.coalesce(1).write.mode("overwrite").json(path)     # result-sized: one row per model


# ------------------------------------------------------------------ A6 / A7
def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (source path, whole text)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"),
                                                                 F.col("value").alias("text"))


def save_corpus(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").parquet(path)


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ------------------------------------------------------------------ D28 / A8
def drift_baseline(df: DataFrame, bins: int = 20, k: int = 10) -> dict[str, DataFrame]:
    """Per-column statistics, equi-width histograms (numeric) and top values."""
    num = numeric_cols(df)
    return {"stats": column_stats(df), "histogram": histogram(df, num, bins) if num else None,
            "top_values": top_values(df, [c for c in df.columns if c not in num], k)}


def save_baseline(baseline: dict[str, DataFrame], path: str, dataset: str) -> None:
    """One Parquet table per part, keyed by (dataset, column), partitioned by dataset."""
    for part, t in baseline.items():
        if t is not None:
            t.withColumn("dataset", F.lit(dataset)).write.mode("overwrite").partitionBy("dataset") \
                .option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{part}")


def load_baseline(spark: SparkSession, path: str, dataset: str) -> dict[str, DataFrame | None]:
    """The parts of a saved baseline; None for a part that was not saved. Read errors are raised."""
    def part(name: str) -> DataFrame | None:
        if not path_exists(spark, f"{path}/{name}"):
            return None
        return spark.read.parquet(f"{path}/{name}").where(F.col("dataset") == dataset).drop("dataset")

    return {name: part(name) for name in ("stats", "histogram", "top_values")}


# ------------------------------------------------------------------ A9
def export_metrics(metrics: DataFrame, name_col: str = "metric", value_col: str = "value",
                   labels: list[str] | None = None, fmt: str = "text") -> DataFrame:
    """`name{label="v",...} value` lines (Prometheus text) or one JSON object per row."""
    labels = labels or []
    if fmt == "json":
        return metrics.select(F.to_json(F.struct(*metrics.columns)).alias("line"))
    lab = F.concat_ws(",", *[F.format_string('%s="%s"', F.lit(c), F.col(c).cast("string")) for c in labels])
    head = F.concat(F.col(name_col), F.lit("{"), lab, F.lit("}")) if labels else F.col(name_col)
    return metrics.select(F.concat(head, F.lit(" "), F.format_string("%.6f", F.col(value_col).cast("double"))).alias("line"))
