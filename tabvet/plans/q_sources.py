"""Registered A-series queries: round trips through Spark writers and readers in the shared
checkpoint folder, the catalog and the metrics export (DuckDB oracles where the result is
defined by the tables alone)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabvet.functions.core import round_doubles
from tabvet.operators import evaluate as H
from tabvet.plans.fixtures import PRED_SQL, predictions
from tabvet.plans.q_text import CHUNKS_SQL, chunks_df
from tabvet.plans.registry import query
from tabvet.plans.sqlgen import with_
from tabvet.session import checkpoint_dir
from tabvet.sources import io as A
from tabvet.sources.tables import load_table


def _scratch(spark, tag: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@query("a1_read_csv")
def a1_read_csv(spark, d):
    p = _scratch(spark, "csv")
    load_table(spark, d, "orders").write.option("header", True).csv(p)
    return A.read_csv(spark, p)


@query("a2_default_target", "SELECT 'o_orderpriority' AS target")
def a2_default_target(spark, d):
    return spark.createDataFrame([(A.default_target(load_table(spark, d, "orders")),)], "target string")


@query("a3_dataset_catalog", """SELECT 'orders' AS dataset, (SELECT count(*) FROM orders) AS n_rows, c AS "column", p AS position, t AS dtype
FROM (VALUES ('o_orderkey', 0, 'bigint'), ('o_custkey', 1, 'bigint'), ('o_orderstatus', 2, 'string'), ('o_totalprice', 3, 'double'),
             ('o_orderdate', 4, 'timestamp_ntz'), ('o_orderpriority', 5, 'string')) v(c, p, t)""")
def a3_dataset_catalog(spark, d):
    return A.dataset_catalog(load_table(spark, d, "orders"), "orders")


@query("a4_prediction_log", f"""WITH {PRED_SQL}
SELECT model, count(*) AS n, CAST(sum(y_pred) AS BIGINT) AS n_positive FROM pred GROUP BY model""")
def a4_prediction_log(spark, d):
    p = _scratch(spark, "predlog")
    pr = predictions(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "model", F.lit("v1").alias("version"),
                                      "event_id", F.col("y_pred").cast("string").alias("prediction"),
                                      F.col("p").alias("confidence"), F.col("y_true").cast("string").alias("actual"))
    A.append_prediction_log(pr, p)
    log = A.read_prediction_log(spark, p)
    return log.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("prediction").cast("long")).alias("n_positive"))


@query("a5_append_alerts", """SELECT count(*) AS n FROM events WHERE event_type = 'error'""")
def a5_append_alerts(spark, d):
    p = _scratch(spark, "alerts")
    ev = load_table(spark, d, "events").where("event_type = 'error'")
    al = ev.select(F.col("ts").cast("string").alias("timestamp"), F.lit("high_error_rate").alias("alert_type"),
                   F.lit("CRITICAL").alias("severity"), F.col("event_id"))
    A.append_alerts(al, p)
    return spark.read.schema("timestamp string, alert_type string, severity string, event_id long").json(p) \
        .agg(F.count(F.lit(1)).alias("n"))


@query("a6_read_text_corpus")
def a6_read_text_corpus(spark, d):
    p = _scratch(spark, "corpus")
    load_table(spark, d, "documents").select("lang", "text").write.partitionBy("lang").text(p)
    return A.read_text_corpus(spark, p).select("source", F.length("text").alias("n_chars"))


@query("a7_corpus_roundtrip", with_(CHUNKS_SQL, "SELECT doc_id, source, chunk_start, chunk FROM chunks"))
def a7_corpus_roundtrip(spark, d):
    p = _scratch(spark, "chunks")
    A.save_corpus(chunks_df(spark, d), p)
    return A.load_corpus(spark, p)


@query("a8_baseline_roundtrip")
def a8_baseline_roundtrip(spark, d):
    p = _scratch(spark, "baseline")
    A.save_baseline(A.drift_baseline(load_table(spark, d, "orders")), p, "orders")
    b = A.load_baseline(spark, p, "orders")
    return round_doubles(b["stats"])


@query("d28_drift_baseline")
def d28_drift_baseline(spark, d):
    return round_doubles(A.drift_baseline(load_table(spark, d, "orders"))["histogram"])


@query("a9_export_metrics", f"""WITH {PRED_SQL}
SELECT printf('model_accuracy{{model="%s"}} %.6f', model, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END)) AS line
FROM pred GROUP BY model""")
def a9_export_metrics(spark, d):
    m = predictions(spark, d).groupBy("model").agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("value")).withColumn("metric", F.lit("model_accuracy"))
    return A.export_metrics(m, labels=["model"])


@query("a10_save_leaderboard")
def a10_save_leaderboard(spark, d):
    from tabvet.plans.q_evaluate import model_scores
    p = _scratch(spark, "board")
    A.save_leaderboard(H.leaderboard(model_scores(spark, d)), p)
    return spark.read.json(p)
