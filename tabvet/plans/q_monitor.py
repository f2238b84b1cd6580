"""Registered L-series queries (monitoring windows and alerts) with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.functions.core import round_doubles
from tabvet.operators import monitor as L
from tabvet.plans.fixtures import PRED_SQL, predictions
from tabvet.plans.q_drift import RETRAIN_METRICS_SQL, retrain_metrics
from tabvet.plans.registry import query
from tabvet.plans.sqlgen import r6, with_
from tabvet.sources.tables import load_table

LOG_SQL = [PRED_SQL, """log AS (SELECT event_id, ts, model, y_pred AS prediction, y_true AS actual,
   greatest(0.0, least(1.0, CASE WHEN y_pred = 1 THEN p ELSE 1 - p END)) AS confidence, y_pred = y_true AS correct FROM pred)"""]


def prediction_log(spark, d):
    p = predictions(spark, d)
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col("y_pred") == 1, F.col("p")).otherwise(1 - F.col("p"))))
    return p.select("event_id", "ts", "model", F.col("y_pred").alias("prediction"), F.col("y_true").alias("actual"),
                    conf.alias("confidence"), (F.col("y_pred") == F.col("y_true")).alias("correct"))


LAST_SQL = """last AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts DESC, event_id DESC) AS recency FROM log)"""


@query("l2_keep_last_n", with_(LOG_SQL + [LAST_SQL], f"""SELECT event_id, ts, model, prediction, actual, {r6("confidence")} AS confidence, correct,
  CAST(recency AS INTEGER) AS recency FROM last WHERE recency <= 100"""))
def l2_keep_last_n(spark, d):
    return round_doubles(L.keep_last_n(prediction_log(spark, d), 100))


@query("l3_confidence_anomalies", with_(LOG_SQL + [LAST_SQL, """w AS (SELECT *, avg(confidence) OVER (PARTITION BY model) AS m,
   stddev_pop(confidence) OVER (PARTITION BY model) AS s, count(*) OVER (PARTITION BY model) AS k FROM last WHERE recency <= 100)"""],
                                        f"""SELECT model, ts, event_id, {r6("confidence")} AS confidence, {r6("abs(m - confidence) / (s + 1e-10)")} AS anomaly_score
FROM w WHERE k >= 10 AND recency <= 10 AND confidence < m - 2 * s"""))
def l3_confidence_anomalies(spark, d):
    return round_doubles(L.confidence_anomalies(prediction_log(spark, d)))


@query("l3_latency_anomalies", f"""WITH last AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS recency FROM events),
w AS (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m, stddev_pop(value) OVER (PARTITION BY event_type) AS s,
  count(*) OVER (PARTITION BY event_type) AS k FROM last WHERE recency <= 100)
SELECT event_type, ts, event_id, value, {r6("abs(m - value) / (s + 1e-10)")} AS anomaly_score FROM w WHERE k >= 10 AND recency <= 10 AND value < m - 2 * s""")
def l3_latency_anomalies(spark, d):
    """The same window rule keyed by status over the raw `value` column (telemetry use)."""
    ev = load_table(spark, d, "events")
    return round_doubles(L.confidence_anomalies(ev, conf="value", key="event_type"))


@query("l4_class_imbalance_shift", with_(LOG_SQL + [LAST_SQL], f"""SELECT model, CAST(sum(n) AS BIGINT) AS total, {r6("min(n) * 1.0 / sum(n)")} AS min_share,
  min(n) * 1.0 / sum(n) < 0.05 AS imbalanced FROM (SELECT model, prediction, count(*) AS n FROM last WHERE recency <= 100 GROUP BY 1, 2)
GROUP BY model HAVING sum(n) >= 50"""))
def l4_class_imbalance_shift(spark, d):
    return round_doubles(L.class_imbalance_shift(prediction_log(spark, d)))


@query("l5_rolling_accuracy_drift", with_(LOG_SQL + [LAST_SQL], f"""SELECT model, {r6("acc")} AS recent_accuracy,
  {r6("CASE WHEN n < 100 THEN 0.0 ELSE greatest(0.0, 0.9 - acc) END")} AS drift FROM (
  SELECT model, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS acc, count(*) AS n FROM last WHERE recency <= 100 GROUP BY model)"""))
def l5_rolling_accuracy_drift(spark, d):
    return round_doubles(L.rolling_accuracy_drift(prediction_log(spark, d), 0.9))


@query("l6_prediction_volume", with_(LOG_SQL, f"""SELECT model, total, {r6("CASE WHEN h > 0 THEN total / h ELSE total END")} AS per_hour,
  {r6("acc")} AS accuracy, {r6("1 - acc")} AS error_rate, {r6("mc")} AS mean_confidence, first_ts, last_ts FROM (
  SELECT model, count(*) AS total, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS acc, avg(confidence) AS mc, min(ts) AS first_ts, max(ts) AS last_ts,
    (epoch(max(ts)) - epoch(min(ts))) / 3600.0 AS h FROM log GROUP BY model)"""))
def l6_prediction_volume(spark, d):
    return round_doubles(L.prediction_volume(prediction_log(spark, d)))


@query("l6_hourly_volume", with_(LOG_SQL, f"""SELECT model, date_trunc('hour', ts) AS hour, count(*) AS n,
  {r6("avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END)")} AS accuracy FROM log GROUP BY 1, 2"""))
def l6_hourly_volume(spark, d):
    return round_doubles(L.hourly_volume(prediction_log(spark, d)))


@query("l7_prediction_distribution", with_(LOG_SQL, "SELECT model, prediction, count(*) AS n FROM log GROUP BY 1, 2"))
def l7_prediction_distribution(spark, d):
    return L.prediction_distribution(prediction_log(spark, d))


@query("l1_metric_trend", with_(LOG_SQL + ["""h AS (SELECT model, date_trunc('day', ts) AS ts, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS accuracy FROM log GROUP BY 1, 2)""",
                                           """r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts DESC) AS rn FROM h)"""],
                                f"""SELECT model, {r6("latest")} AS latest, {r6("previous")} AS previous, {r6("latest - previous")} AS trend,
  CASE WHEN latest > 0.8 THEN 'good' WHEN latest > 0.7 THEN 'warning' ELSE 'critical' END AS health FROM (
  SELECT model, max(CASE WHEN rn = 1 THEN accuracy END) AS latest, max(CASE WHEN rn = 2 THEN accuracy END) AS previous FROM r WHERE rn <= 2 GROUP BY model)"""))
def l1_metric_trend(spark, d):
    log = prediction_log(spark, d)
    h = log.groupBy("model", F.date_trunc("day", "ts").alias("ts")).agg(
        F.avg(F.when(F.col("correct"), 1.0).otherwise(0.0)).alias("accuracy"))
    return round_doubles(L.metric_trend(h))


ALERTS_SQL = [PRED_SQL, RETRAIN_METRICS_SQL, """al AS (
  SELECT model, 'high_error_rate' AS alert_type, 'CRITICAL' AS severity,
    printf('Error rate %.2f%% exceeds threshold 5.00%%', error_rate * 100) AS message, error_rate AS value FROM met WHERE error_rate > 0.05
  UNION ALL SELECT model, 'data_drift', CASE WHEN drift_score > 0.5 THEN 'CRITICAL' ELSE 'WARNING' END,
    printf('Data drift detected (score: %.3f)', drift_score), drift_score FROM met WHERE drift_score > 0.3
  UNION ALL SELECT model, 'performance_degradation', 'WARNING', printf('Accuracy dropped from %.2f%% to %.2f%%', baseline_accuracy * 100, current_accuracy * 100),
    baseline_accuracy - current_accuracy FROM met WHERE baseline_accuracy - current_accuracy > 0.1
  UNION ALL SELECT model, 'model_staleness', 'INFO', 'Model is ' || CAST(age_days AS VARCHAR) || ' days old (threshold: 30 days)',
    CAST(age_days AS DOUBLE) FROM met WHERE age_days > 30)"""]


def alerts(spark, d):
    return L.threshold_alerts(retrain_metrics(spark, d))


@query("l9_threshold_alerts", with_(ALERTS_SQL, f"SELECT model, alert_type, severity, message, {r6('value')} AS value, FALSE AS resolved FROM al"))
def l9_threshold_alerts(spark, d):
    return round_doubles(alerts(spark, d))


@query("l8_alert_summary", with_(ALERTS_SQL, """SELECT count(*) AS total_alerts,
  CAST(sum(CASE WHEN severity = 'CRITICAL' THEN 1 ELSE 0 END) AS BIGINT) AS critical, CAST(sum(CASE WHEN severity = 'WARNING' THEN 1 ELSE 0 END) AS BIGINT) AS warning,
  CAST(sum(CASE WHEN severity = 'INFO' THEN 1 ELSE 0 END) AS BIGINT) AS info, CAST(0 AS BIGINT) AS resolved FROM al"""))
def l8_alert_summary(spark, d):
    return L.alert_summary(alerts(spark, d))


@query("l8_top_alerts", with_(ALERTS_SQL, f"""SELECT model, alert_type, severity, message, {r6('value')} AS value, FALSE AS resolved FROM al
ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END, model, alert_type LIMIT 3"""))
def l8_top_alerts(spark, d):
    return round_doubles(L.top_alerts(alerts(spark, d), 3, ["model", "alert_type"]))


@query("l10_system_health", with_(ALERTS_SQL, """SELECT count(*) AS total_alerts, CAST(sum(CASE WHEN severity = 'CRITICAL' THEN 1 ELSE 0 END) AS BIGINT) AS critical,
  CAST(sum(CASE WHEN severity = 'WARNING' THEN 1 ELSE 0 END) AS BIGINT) AS warning, CAST(sum(CASE WHEN severity = 'INFO' THEN 1 ELSE 0 END) AS BIGINT) AS info,
  CAST(0 AS BIGINT) AS resolved,
  CASE WHEN coalesce(sum(CASE WHEN severity = 'CRITICAL' THEN 1 ELSE 0 END), 0) = 0 THEN 'good'
       WHEN coalesce(sum(CASE WHEN severity = 'WARNING' THEN 1 ELSE 0 END), 0) = 0 THEN 'warning' ELSE 'critical' END AS overall_health FROM al"""))
def l10_system_health(spark, d):
    return L.system_health(alerts(spark, d))


JOBS_SQL = """jobs AS (SELECT user_id AS job_id, ts, 'm' || CAST(user_id % 3 AS VARCHAR) AS model,
  CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'pending' WHEN 'view' THEN 'running'
                  WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status FROM events)"""


@query("l11_retrain_queue", with_([JOBS_SQL], """SELECT job_id, arg_max(model, (ts, status)) AS model, arg_max(status, (ts, status)) AS status,
  max(ts) AS updated_at, count(*) AS n_events FROM jobs GROUP BY job_id"""))
def l11_retrain_queue(spark, d):
    ev = load_table(spark, d, "events")
    st = (F.when(F.col("event_type").isin("signup", "click"), "pending").when(F.col("event_type") == "view", "running")
          .when(F.col("event_type") == "purchase", "completed").otherwise("failed"))
    jobs = ev.select(F.col("user_id").alias("job_id"), "ts", F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
                     st.alias("status"))
    return L.retrain_queue(jobs)


@query("l13_set_ops", """WITH a AS (SELECT DISTINCT n_name AS value FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000),
b AS (SELECT DISTINCT n_name AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000)
SELECT value, 'union' AS op FROM (SELECT value FROM a UNION SELECT value FROM b)
UNION ALL SELECT value, 'intersect' FROM (SELECT value FROM a INTERSECT SELECT value FROM b)
UNION ALL SELECT value, 'a_except_b' FROM (SELECT value FROM a EXCEPT SELECT value FROM b)
UNION ALL SELECT value, 'b_except_a' FROM (SELECT value FROM b EXCEPT SELECT value FROM a)""")
def l13_set_ops(spark, d):
    nat = load_table(spark, d, "nation")
    cu = load_table(spark, d, "customer").where((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 9000))
    su = load_table(spark, d, "supplier").where(F.col("s_acctbal") > 5000)
    a = cu.join(F.broadcast(nat), cu.c_nationkey == nat.n_nationkey).select("n_name")      # nation: 25 rows
    b = su.join(F.broadcast(nat), su.s_nationkey == nat.n_nationkey).select("n_name")
    return L.set_ops(a, b, "n_name")
