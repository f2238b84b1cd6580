"""L-series: windows over prediction logs, alert rules and alert tables.

"Last N per model" uses `row_number() <= N`, which Spark plans with a map-side
WindowGroupLimit: every map task keeps at most N rows per model before the shuffle, so a
model holding a third of all rows never ships more than N rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabvet.operators.drift import percent

SEVERITY_ORDER = {"CRITICAL": 0, "WARNING": 1, "INFO": 2}


def keep_last_n(log: DataFrame, n: int = 100, key: str = "model", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """L2: the last n records per key (newest first by ts, then tie column)."""
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return log.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def confidence_anomalies(log: DataFrame, conf: str = "confidence", key: str = "model", ts: str = "ts", tie: str = "event_id",
                         window: int = 100, recent: int = 10, min_n: int = 10) -> DataFrame:
    """L3: among the newest `recent` records of the last `window`, confidences below mean - 2 * std_pop."""
    last = keep_last_n(log, window, key, ts, tie)
    wk = Window.partitionBy(key)
    s = last.select("*", F.avg(conf).over(wk).alias("mean_conf"), F.stddev_pop(conf).over(wk).alias("std_conf"),
                    F.count(F.lit(1)).over(wk).alias("n_window"))
    return s.where((F.col("n_window") >= min_n) & (F.col("recency") <= recent) &
                   (F.col(conf) < F.col("mean_conf") - 2 * F.col("std_conf"))) \
        .select(key, ts, tie, conf, (F.abs(F.col("mean_conf") - F.col(conf)) / (F.col("std_conf") + 1e-10)).alias("anomaly_score"))


def class_imbalance_shift(log: DataFrame, pred: str = "prediction", key: str = "model", ts: str = "ts", tie: str = "event_id",
                          window: int = 100, min_n: int = 50, floor: float = 0.05) -> DataFrame:
    """L4: per key, class shares of the last `window` predictions; imbalanced if any share < 5 %."""
    last = keep_last_n(log, window, key, ts, tie)
    c = last.groupBy(key, pred).agg(F.count(F.lit(1)).alias("n"))
    t = c.groupBy(key).agg(F.sum("n").alias("total"), F.min("n").alias("min_n"))
    return t.where(F.col("total") >= min_n).select(
        key, F.col("total").cast("long"), (F.col("min_n") / F.col("total")).alias("min_share"),
        (F.col("min_n") / F.col("total") < floor).alias("imbalanced"))


def rolling_accuracy_drift(log: DataFrame, training_accuracy: DataFrame | float = 0.9, correct: str = "correct",
                           key: str = "model", ts: str = "ts", tie: str = "event_id", window: int = 100) -> DataFrame:
    """Training accuracy - accuracy of the last `window` predictions, floored at 0; fewer rows -> 0."""
    last = keep_last_n(log, window, key, ts, tie)
    r = last.groupBy(key).agg(F.avg(F.col(correct).cast("double")).alias("recent_accuracy"), F.count(F.lit(1)).alias("n"))
    if isinstance(training_accuracy, DataFrame):
        r = r.join(F.broadcast(training_accuracy), key, "left")      # one row per model
        ta = F.coalesce(F.col("training_accuracy"), F.lit(0.9))
    else:
        ta = F.lit(float(training_accuracy))
    return r.select(key, "recent_accuracy", F.when(F.col("n") < window, 0.0)
                    .otherwise(F.greatest(F.lit(0.0), ta - F.col("recent_accuracy"))).alias("drift"))


def prediction_volume(log: DataFrame, key: str = "model", ts: str = "ts", correct: str = "correct",
                      conf: str = "confidence") -> DataFrame:
    """Total, per-hour rate over the observed span, accuracy, error rate, mean confidence, first/last ts."""
    g = log.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.avg(F.col(correct).cast("double")).alias("accuracy"),
                             F.avg(conf).alias("mean_confidence"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    hours = (F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))) / 3.6e9
    return g.select(key, "total", F.when(hours > 0, F.col("total") / hours).otherwise(F.col("total").cast("double")).alias("per_hour"),
                    "accuracy", (1 - F.col("accuracy")).alias("error_rate"), "mean_confidence", "first_ts", "last_ts")


def hourly_volume(log: DataFrame, key: str = "model", ts: str = "ts", correct: str = "correct") -> DataFrame:
    """L6 (batch window variant): counts and accuracy per key per tumbling hour."""
    return log.groupBy(key, F.window(F.col(ts).cast("timestamp"), "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy")) \
        .select(key, F.col("w.start").cast("timestamp_ntz").alias("hour"), "n", "accuracy")


def prediction_distribution(log: DataFrame, key: str = "model", pred: str = "prediction") -> DataFrame:
    """Class counts per key."""
    return log.groupBy(key, pred).agg(F.count(F.lit(1)).alias("n"))


def metric_trend(history: DataFrame, key: str = "model", ts: str = "ts", metric: str = "accuracy") -> DataFrame:
    """L1: latest - previous metric per key, with health good > 0.8, warning > 0.7, else critical."""
    w = Window.partitionBy(key).orderBy(F.col(ts).desc())
    r = history.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 2)
    g = r.groupBy(key).agg(F.max(F.when(F.col("_rn") == 1, F.col(metric))).alias("latest"),
                           F.max(F.when(F.col("_rn") == 2, F.col(metric))).alias("previous"))
    return g.select(key, "latest", "previous", (F.col("latest") - F.col("previous")).alias("trend"),
                    F.when(F.col("latest") > 0.8, "good").when(F.col("latest") > 0.7, "warning").otherwise("critical").alias("health"))


def threshold_alerts(metrics: DataFrame, key: str = "model", ts: str = "ts", error_rate: str = "error_rate",
                     drift: str = "drift_score", baseline: str = "baseline_accuracy", current: str = "current_accuracy",
                     age_days: str = "age_days", thresholds: dict | None = None) -> DataFrame:
    """Rule table -> alert rows (type, severity, message, value) via array(when(struct)) + explode."""
    t = {"error_rate": 0.05, "drift": 0.3, "drift_critical": 0.5, "performance_drop": 0.1, "model_age_days": 30}
    t.update(thresholds or {})

    def alert(cond: Column, typ: str, sev: Column, msg: Column, val: Column) -> Column:
        return F.when(cond, F.struct(F.lit(typ).alias("alert_type"), sev.alias("severity"), msg.alias("message"),
                                     val.cast("double").alias("value")))

    drop = F.col(baseline) - F.col(current)
    rules = F.array(
        alert(F.col(error_rate) > t["error_rate"], "high_error_rate", F.lit("CRITICAL"),
              F.concat(F.lit("Error rate "), percent(F.col(error_rate)), F.lit(" exceeds threshold "), percent(F.lit(t["error_rate"]))), F.col(error_rate)),
        alert(F.col(drift) > t["drift"], "data_drift",
              F.when(F.col(drift) > t["drift_critical"], "CRITICAL").otherwise("WARNING"),
              F.concat(F.lit("Data drift detected (score: "), F.format_string("%.3f", F.col(drift)), F.lit(")")), F.col(drift)),
        alert(drop > t["performance_drop"], "performance_degradation", F.lit("WARNING"),
              F.concat(F.lit("Accuracy dropped from "), percent(F.col(baseline)), F.lit(" to "), percent(F.col(current))), drop),
        alert(F.col(age_days) > t["model_age_days"], "model_staleness", F.lit("INFO"),
              F.concat(F.lit("Model is "), F.col(age_days).cast("int").cast("string"), F.lit(" days old (threshold: "),
                       F.lit(str(int(t["model_age_days"]))), F.lit(" days)")), F.col(age_days)),
    )
    return metrics.select(key, *([ts] if ts in metrics.columns else []), F.explode(F.array_compact(rules)).alias("a")) \
        .select("*", "a.*").drop("a").withColumn("resolved", F.lit(False))


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Total, per severity and resolved counts."""
    sev = F.col("severity")
    return alerts.agg(F.count(F.lit(1)).alias("total_alerts"),
                      *[F.sum((sev == s).cast("long")).alias(s.lower()) for s in ("CRITICAL", "WARNING", "INFO")],
                      F.sum(F.col("resolved").cast("long")).alias("resolved"))


def alerts_by_type(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("alert_type").agg(F.count(F.lit(1)).alias("n"))


def top_alerts(alerts: DataFrame, k: int = 10, tie: list[str] | None = None) -> DataFrame:
    """Most severe first (CRITICAL < WARNING < INFO), limit k."""
    rank = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "WARNING", 1).otherwise(2)
    return alerts.orderBy(rank, *[F.col(c) for c in (tie or [])]).limit(k)


def system_health(alerts: DataFrame) -> DataFrame:
    """Good when no critical alert, else warning when no warning alert, else critical."""
    s = alert_summary(alerts)
    return s.withColumn("overall_health", F.when(F.coalesce(F.col("critical"), F.lit(0)) == 0, "good")
                        .when(F.coalesce(F.col("warning"), F.lit(0)) == 0, "warning").otherwise("critical"))


def retrain_queue(events: DataFrame, job: str = "job_id", ts: str = "ts", status: str = "status", key: str = "model") -> DataFrame:
    """Latest status per job (max_by on time), pending jobs first."""
    return events.groupBy(job).agg(F.max_by(key, F.struct(ts, status)).alias(key), F.max_by(status, F.struct(ts, status)).alias(status),
                                   F.max(ts).alias("updated_at"), F.count(F.lit(1)).alias("n_events"))


def set_ops(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Union / intersect / except of two value sets, tagged."""
    va, vb = a.select(F.col(col).alias("value")).distinct(), b.select(F.col(col).alias("value")).distinct()
    return va.union(vb).distinct().withColumn("op", F.lit("union")) \
        .unionByName(va.intersect(vb).withColumn("op", F.lit("intersect"))) \
        .unionByName(va.exceptAll(vb).withColumn("op", F.lit("a_except_b"))) \
        .unionByName(vb.exceptAll(va).withColumn("op", F.lit("b_except_a")))
