"""Registered H-series queries (evaluation) and D22 with their DuckDB oracles.

Binary predictions and multiclass predictions are derived from `events` (see fixtures).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.functions.core import round_doubles
from tabvet.operators import evaluate as H
from tabvet.operators.profile import risk_flags
from tabvet.plans.fixtures import EVENT_CUT, MPRED_SQL, PRED_SQL, multiclass_predictions, predictions
from tabvet.plans.registry import query
from tabvet.plans.sqlgen import r6, with_
from tabvet.sources.tables import load_table

CM_SQL = [MPRED_SQL,
          "labels AS (SELECT y_true AS l FROM mpred UNION SELECT y_pred FROM mpred)",
          "cnt AS (SELECT y_true AS actual, y_pred AS predicted, count(*) AS c FROM mpred GROUP BY 1, 2)",
          """cm AS (SELECT a.l AS actual, b.l AS predicted, CAST(coalesce(c, 0) AS BIGINT) AS count
   FROM labels a CROSS JOIN labels b LEFT JOIN cnt ON cnt.actual = a.l AND cnt.predicted = b.l)"""]

REPORT_SQL = CM_SQL + [
    """ra AS (SELECT actual AS class, sum(count) AS support, sum(CASE WHEN actual = predicted THEN count ELSE 0 END) AS tp FROM cm GROUP BY 1)""",
    """rb AS (SELECT predicted AS class, sum(count) AS pred_total FROM cm GROUP BY 1)""",
    """rep AS (SELECT class, support, tp, pred_total - tp AS fp, support - tp AS fn,
     CASE WHEN pred_total > 0 THEN tp * 1.0 / pred_total ELSE 0.0 END AS prec,
     CASE WHEN support > 0 THEN tp * 1.0 / support ELSE 0.0 END AS rec FROM ra JOIN rb USING (class))""",
    """rep2 AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM rep)"""]


@query("h1_confusion_matrix", with_(CM_SQL, f"""SELECT actual, predicted, count,
  {r6("CASE WHEN sum(count) OVER (PARTITION BY actual) <> 0 THEN count * 1.0 / sum(count) OVER (PARTITION BY actual) ELSE 0.0 END")} AS share FROM cm"""))
def h1_confusion_matrix(spark, d):
    return round_doubles(H.confusion_matrix(multiclass_predictions(spark, d)))


@query("h1_binary_counts", with_([PRED_SQL], """SELECT
  CAST(sum(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS true_negatives,
  CAST(sum(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS false_positives,
  CAST(sum(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS false_negatives,
  CAST(sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS true_positives FROM pred"""))
def h1_binary_counts(spark, d):
    return H.binary_counts(predictions(spark, d))


@query("h2_class_report", with_(REPORT_SQL, f"""SELECT class, CAST(support AS BIGINT) AS support, CAST(tp AS BIGINT) AS true_positives,
  CAST(fp AS BIGINT) AS false_positives, CAST(fn AS BIGINT) AS false_negatives, {r6("prec")} AS precision, {r6("rec")} AS recall,
  {r6("f1")} AS f1_score, {r6("CASE WHEN support > 0 THEN fn * 1.0 / support ELSE 0.0 END")} AS miss_rate,
  {r6("CASE WHEN tp + fp > 0 THEN fp * 1.0 / (tp + fp) ELSE 0.0 END")} AS false_discovery_rate FROM rep2"""))
def h2_class_report(spark, d):
    return round_doubles(H.class_report(multiclass_predictions(spark, d)))


@query("h3_top_confusions", with_(CM_SQL, """SELECT actual, predicted, count FROM cm WHERE actual <> predicted AND count > 0
ORDER BY count DESC, actual, predicted LIMIT 3"""))
def h3_top_confusions(spark, d):
    return H.top_confusions(multiclass_predictions(spark, d), 3)


@query("h3_hardest_classes", with_(REPORT_SQL, f"""SELECT class, CAST(fp + fn AS BIGINT) AS error_burden,
  {r6("CASE WHEN support > 0 THEN fn * 1.0 / support ELSE 0.0 END")} AS miss_rate, {r6("prec")} AS precision, {r6("rec")} AS recall
FROM rep2 ORDER BY fp + fn DESC, CASE WHEN support > 0 THEN fn * 1.0 / support ELSE 0.0 END DESC, class LIMIT 3"""))
def h3_hardest_classes(spark, d):
    return round_doubles(H.hardest_classes(multiclass_predictions(spark, d), 3))


CONF = "greatest(0.0, least(1.0, CASE WHEN y_pred = 1 THEN p ELSE 1 - p END))"


@query("h4_confidence_risk", with_([PRED_SQL], f"""SELECT count(*) AS total_samples, CAST(sum(CASE WHEN y_true <> y_pred THEN 1 ELSE 0 END) AS BIGINT) AS total_errors,
  {r6("1 - sum(CASE WHEN y_true <> y_pred THEN 1 ELSE 0 END) * 1.0 / count(*)")} AS accuracy,
  {r6("sum(CASE WHEN y_true <> y_pred THEN 1 ELSE 0 END) * 1.0 / count(*)")} AS error_rate,
  {r6(f"avg({CONF})")} AS mean_confidence,
  CAST(sum(CASE WHEN {CONF} >= 0.8 AND y_true <> y_pred THEN 1 ELSE 0 END) AS BIGINT) AS overconfident_errors,
  CAST(sum(CASE WHEN {CONF} <= 0.6 AND y_true <> y_pred THEN 1 ELSE 0 END) AS BIGINT) AS uncertain_errors,
  {r6(f"CASE WHEN sum(CASE WHEN y_true <> y_pred THEN 1 ELSE 0 END) > 0 THEN sum(CASE WHEN {CONF} >= 0.8 AND y_true <> y_pred THEN 1 ELSE 0 END) * 1.0 / sum(CASE WHEN y_true <> y_pred THEN 1 ELSE 0 END) ELSE 0.0 END")} AS overconfident_error_rate
FROM pred"""))
def h4_confidence_risk(spark, d):
    return round_doubles(H.confidence_risk(predictions(spark, d)))


@query("h5_classification_metrics", with_(REPORT_SQL, f"""SELECT {r6("sum(tp) * 1.0 / sum(support)")} AS accuracy,
  {r6("sum(support * prec) / sum(support)")} AS precision_weighted, {r6("sum(support * rec) / sum(support)")} AS recall_weighted,
  {r6("sum(support * f1) / sum(support)")} AS f1_weighted FROM rep2"""))
def h5_classification_metrics(spark, d):
    return round_doubles(H.classification_metrics(multiclass_predictions(spark, d)))


@query("h6_roc_auc", with_([PRED_SQL], f"""SELECT model, {r6("CASE WHEN n_pos > 0 AND n_neg > 0 THEN (rs - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) ELSE 0.5 END")} AS roc_auc,
  CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg FROM (
  SELECT model, sum(CASE WHEN y_true = 1 THEN r ELSE 0 END) AS rs, sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END) AS n_pos,
         sum(CASE WHEN y_true = 1 THEN 0 ELSE 1 END) AS n_neg
  FROM (SELECT model, y_true, (rank() OVER (PARTITION BY model ORDER BY p) + rank() OVER (PARTITION BY model ORDER BY p) + count(*) OVER (PARTITION BY model, p) - 1) / 2.0 AS r FROM pred)
  GROUP BY model)"""))
def h6_roc_auc(spark, d):
    return round_doubles(H.roc_auc(predictions(spark, d), keys=["model"]))


@query("h6_roc_curve", with_([PRED_SQL], f"""SELECT threshold, {r6("CASE WHEN tn > 0 THEN fp * 1.0 / tn ELSE 0.0 END")} AS fpr,
  {r6("CASE WHEN tpos > 0 THEN tp * 1.0 / tpos ELSE 0.0 END")} AS tpr FROM (
  SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS tp,
         sum(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS fp, sum(pos) OVER () AS tpos, sum(neg) OVER () AS tn
  FROM (SELECT p AS threshold, sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y_true = 1 THEN 0 ELSE 1 END) AS neg FROM pred GROUP BY p))"""))
def h6_roc_curve(spark, d):
    return round_doubles(H.roc_curve(predictions(spark, d)))


BIN_REPORT_SQL = [PRED_SQL,
                  "labels AS (SELECT y_true AS l FROM pred UNION SELECT y_pred FROM pred)",
                  "cnt AS (SELECT y_true AS actual, y_pred AS predicted, count(*) AS c FROM pred GROUP BY 1, 2)",
                  """cm AS (SELECT a.l AS actual, b.l AS predicted, coalesce(c, 0) AS count FROM labels a CROSS JOIN labels b
   LEFT JOIN cnt ON cnt.actual = a.l AND cnt.predicted = b.l)"""] + REPORT_SQL[len(CM_SQL):]


@query("h7_extended_metrics", with_(BIN_REPORT_SQL + [
    "s AS (SELECT avg(rec) AS ba, sum(support) * 1.0 AS n, sum(tp) * 1.0 AS c, sum(support * pred_total) * 1.0 AS pt, sum(support * support) * 1.0 AS tt, sum(pred_total * pred_total) * 1.0 AS pp FROM rep2 JOIN rb USING (class))",
    "ll AS (SELECT avg(-(y_true * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y_true) * ln(1 - greatest(1e-15, least(1 - 1e-15, p))))) AS log_loss FROM pred)"],
    f"""SELECT {r6("ba")} AS balanced_accuracy,
  {r6("CASE WHEN sqrt((n * n - pp) * (n * n - tt)) > 0 THEN (c * n - pt) / sqrt((n * n - pp) * (n * n - tt)) ELSE 0.0 END")} AS mcc,
  {r6("CASE WHEN pt / (n * n) < 1 THEN (c / n - pt / (n * n)) / (1 - pt / (n * n)) ELSE 0.0 END")} AS cohen_kappa, {r6("log_loss")} AS log_loss FROM s, ll"""))
def h7_extended_metrics(spark, d):
    return round_doubles(H.extended_metrics(predictions(spark, d)))


@query("h8_regression_metrics", f"""SELECT {r6("avg(e * e)", 2)} AS mse, {r6("sqrt(avg(e * e))", 4)} AS rmse, {r6("avg(abs(e))", 4)} AS mae,
  {r6("1 - sum(e * e) / (var_pop(y) * count(*))")} AS r2
FROM (SELECT l_extendedprice AS y, l_extendedprice - l_extendedprice * (1 - l_discount) AS e FROM lineitem)""")
def h8_regression_metrics(spark, d):
    li = load_table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"),
                                                 (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("yhat"))
    return round_doubles(H.regression_metrics(li, "y", "yhat"), 6, {"mse": 2, "rmse": 4, "mae": 4})


@query("h10_calibration_error", with_([PRED_SQL,
                                       f"b AS (SELECT {CONF} AS conf, CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END AS ok FROM pred)",
                                       """bb AS (SELECT *, CASE WHEN conf <= 0 OR conf > 1 THEN NULL
     WHEN conf > CAST(ceil(conf * 10) AS INTEGER) * 0.1 THEN CAST(ceil(conf * 10) AS INTEGER) + 1
     WHEN conf <= (CAST(ceil(conf * 10) AS INTEGER) - 1) * 0.1 THEN CAST(ceil(conf * 10) AS INTEGER) - 1
     ELSE CAST(ceil(conf * 10) AS INTEGER) END AS bin FROM b)""",
                                       "per AS (SELECT bin, avg(ok) AS acc, avg(conf) AS c, count(*) AS k FROM bb WHERE bin IS NOT NULL GROUP BY bin)",
                                       "e AS (SELECT coalesce(sum(abs(acc - c) * k / (SELECT count(*) FROM b)), 0.0) AS ece FROM per)"],
                                      f"""SELECT {r6("ece")} AS ece, CASE WHEN ece < 0.05 THEN 'good' WHEN ece < 0.12 THEN 'moderate' ELSE 'poor' END AS level FROM e"""))
def h10_calibration_error(spark, d):
    return round_doubles(H.calibration_error(predictions(spark, d)))


FAIR_SQL = [PRED_SQL, """g AS (SELECT grp AS "group", count(*) AS n, sum(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS ok,
   sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y_true <> 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS fp,
   sum(CASE WHEN y_true = 1 AND y_pred <> 1 THEN 1 ELSE 0 END) AS fn, avg(CAST(y_pred AS DOUBLE)) AS positive_rate FROM pred GROUP BY grp)""",
            """fg AS (SELECT "group", CAST(n AS BIGINT) AS n, ok * 1.0 / n AS accuracy, CASE WHEN tp + fp > 0 THEN tp * 1.0 / (tp + fp) ELSE 0.0 END AS precision,
   CASE WHEN tp + fn > 0 THEN tp * 1.0 / (tp + fn) ELSE 0.0 END AS recall, positive_rate FROM g WHERE n >= 10)"""]


@query("h11_fairness_groups", with_(FAIR_SQL, f"""SELECT "group", n, {r6("accuracy")} AS accuracy, {r6("precision")} AS precision, {r6("recall")} AS recall,
  {r6("CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END")} AS f1, {r6("positive_rate")} AS positive_rate FROM fg"""))
def h11_fairness_groups(spark, d):
    return round_doubles(H.fairness_groups(predictions(spark, d), "grp"))


@query("h11_fairness_summary", with_(FAIR_SQL, f"""SELECT CAST(count(*) AS BIGINT) AS n_groups, {r6("max(accuracy) - min(accuracy)")} AS accuracy_gap,
  arg_min("group", (accuracy, "group")) AS worst_group, arg_max("group", (accuracy, "group")) AS best_group,
  {r6("CASE WHEN max(positive_rate) > 0 THEN min(positive_rate) / max(positive_rate) END")} AS disparate_impact,
  CASE WHEN max(accuracy) - min(accuracy) > 0.15 THEN 'CRITICAL' WHEN max(accuracy) - min(accuracy) > 0.08 THEN 'WARNING' ELSE 'LOW' END AS risk_level
FROM fg HAVING count(*) >= 2"""))
def h11_fairness_summary(spark, d):
    return round_doubles(H.fairness_summary(H.fairness_groups(predictions(spark, d), "grp")))


@query("h12_conformal", with_([PRED_SQL,
                               f"cal AS (SELECT 1 - CASE WHEN y_true = 1 THEN p ELSE 1 - p END AS s FROM pred WHERE ts < TIMESTAMP '{EVENT_CUT}')",
                               "nn AS (SELECT count(*) AS n FROM cal)",
                               "lv AS (SELECT n, CAST(ceil((n - 1) * least(1.0, greatest(0.0, ceil((n + 1) * (1 - 0.1)) / n))) AS BIGINT) AS rk FROM nn)",
                               "q AS (SELECT s AS q_hat FROM (SELECT s, row_number() OVER (ORDER BY s) - 1 AS rn FROM cal), lv WHERE rn = rk)",
                               f"""sets AS (SELECT y_true, CASE WHEN (1 - p >= 1 - q_hat) OR (p >= 1 - q_hat) THEN
       list_filter([0, 1], lambda k: CASE WHEN k = 0 THEN 1 - p ELSE p END >= 1 - q_hat)
     ELSE [CASE WHEN p > 1 - p THEN 1 ELSE 0 END] END AS ps FROM pred, q WHERE ts >= TIMESTAMP '{EVENT_CUT}')"""],
                              f"""SELECT 0.1 AS alpha, (SELECT n FROM nn) AS n_cal, {r6("(SELECT q_hat FROM q)")} AS q_hat, 0.9 AS target_coverage,
  {r6("avg(CASE WHEN list_contains(ps, y_true) THEN 1.0 ELSE 0.0 END)")} AS empirical_coverage, {r6("avg(len(ps))")} AS average_set_size FROM sets"""))
def h12_conformal(spark, d):
    p = predictions(spark, d)
    cut = F.lit(EVENT_CUT).cast("timestamp_ntz")
    q = H.conformal_fit(p.where(F.col("ts") < cut), alpha=0.1)
    cov = H.conformal_coverage(H.conformal_predict(p.where(F.col("ts") >= cut), q), alpha=0.1)
    return round_doubles(q.crossJoin(cov).select("alpha", "n_cal", "q_hat", "target_coverage", "empirical_coverage", "average_set_size"))


AB_SQL = [PRED_SQL, f"""a AS (SELECT CASE WHEN grp IN ('g0', 'g1') THEN 'A' ELSE 'B' END AS arm, count(*) AS n,
   sum(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS correct, avg({CONF}) AS mean_confidence FROM pred GROUP BY 1)""",
          "t AS (SELECT sum(n) AS nt, sum(correct) AS ct FROM a)",
          """ch AS (SELECT sum(power(greatest(abs(correct - n * ct * 1.0 / nt) - 0.5, 0.0), 2) / (n * ct * 1.0 / nt)
     + power(greatest(abs((n - correct) - n * (nt - ct) * 1.0 / nt) - 0.5, 0.0), 2) / (n * (nt - ct) * 1.0 / nt)) AS chi2 FROM a, t)"""]


@query("h14_ab_results", with_(AB_SQL, f"""SELECT arm, CAST(n AS BIGINT) AS n, {r6("correct * 1.0 / n")} AS accuracy, {r6("mean_confidence")} AS mean_confidence,
  {r6("chi2", 4)} AS chi2, chi2 > 3.841458820694124 AS significant,
  (SELECT arm FROM a ORDER BY correct * 1.0 / n DESC, arm DESC LIMIT 1) AS winner
FROM a, ch"""))
def h14_ab_results(spark, d):
    p = predictions(spark, d).withColumn("arm", F.when(F.col("grp").isin("g0", "g1"), "A").otherwise("B"))
    return round_doubles(H.ab_results(p, with_p=False), 6, {"chi2": 4})


MODEL_SCORES_SQL = """ms AS (SELECT model, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS accuracy,
   2.0 * sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) / nullif(2 * sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END)
     + sum(CASE WHEN y_true <> 1 AND y_pred = 1 THEN 1 ELSE 0 END) + sum(CASE WHEN y_true = 1 AND y_pred <> 1 THEN 1 ELSE 0 END), 0) AS f1
 FROM pred GROUP BY model)"""


def model_scores(spark, d):
    p = predictions(spark, d)
    tp = F.sum(((F.col("y_true") == 1) & (F.col("y_pred") == 1)).cast("long"))
    fp = F.sum(((F.col("y_true") != 1) & (F.col("y_pred") == 1)).cast("long"))
    fn = F.sum(((F.col("y_true") == 1) & (F.col("y_pred") != 1)).cast("long"))
    return p.groupBy("model").agg(F.avg(F.when(F.col("y_true") == F.col("y_pred"), 1.0).otherwise(0.0)).alias("accuracy"),
                                  F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)).alias("f1"))


@query("h16_leaderboard", with_([PRED_SQL, MODEL_SCORES_SQL], f"""SELECT model, {r6("accuracy")} AS accuracy, {r6("f1")} AS f1, rk AS rank, rk = 1 AS champion,
  CASE WHEN rk = 1 THEN 'gold' WHEN rk = 2 THEN 'silver' WHEN rk = 3 THEN 'bronze' END AS medal
FROM (SELECT *, CAST(row_number() OVER (ORDER BY f1 DESC, accuracy DESC, model) AS INTEGER) AS rk FROM ms)"""))
def h16_leaderboard(spark, d):
    return round_doubles(H.leaderboard(model_scores(spark, d)))


SEED_SQL = """seeds AS (SELECT model, event_id % 3 AS seed, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS score FROM pred GROUP BY 1, 2),
stab AS (SELECT model, avg(score) AS mean_score, stddev_pop(score) AS std_score, count(*) AS n_runs FROM seeds GROUP BY model)"""


def seed_scores(spark, d):
    p = predictions(spark, d)
    return p.groupBy("model", (F.col("event_id") % 3).alias("seed")).agg(
        F.avg(F.when(F.col("y_true") == F.col("y_pred"), 1.0).otherwise(0.0)).alias("score"))


@query("h17_seed_stability", with_([PRED_SQL, SEED_SQL], f"""SELECT model, {r6("mean_score")} AS mean_score, {r6("std_score")} AS std_score, n_runs,
  CASE WHEN std_score < 0.02 THEN 'high' ELSE 'low' END AS stability FROM stab"""))
def h17_seed_stability(spark, d):
    return round_doubles(H.seed_stability(seed_scores(spark, d)))


RISK_SQL = """rf AS (SELECT mn * 1.0 / tot AS minority_ratio, rows FROM
   (SELECT min(n) AS mn, sum(n) AS tot FROM (SELECT y_true, count(*) AS n FROM pred GROUP BY y_true)), (SELECT count(*) AS rows FROM pred))"""


@query("d22_risk_flags", with_([PRED_SQL, RISK_SQL], f"""SELECT {r6("minority_ratio")} AS minority_ratio, minority_ratio < 0.2 AS class_imbalance,
  CASE WHEN minority_ratio < 0.1 THEN 'high' WHEN minority_ratio < 0.2 THEN 'moderate' ELSE 'low' END AS imbalance_severity,
  CASE WHEN minority_ratio < 0.2 THEN 'F1-score' ELSE 'accuracy' END AS recommended_metric, rows, CAST(7 AS BIGINT) AS columns,
  CASE WHEN rows < 1000 THEN 'high' WHEN rows < 70 THEN 'moderate' ELSE 'low' END AS overfitting_risk FROM rf"""))
def d22_risk_flags(spark, d):
    return round_doubles(risk_flags(predictions(spark, d), "y_true"))


@query("h18_readiness_score", with_([PRED_SQL, MODEL_SCORES_SQL, SEED_SQL, RISK_SQL,
                                     """inp AS (SELECT (SELECT avg(f1) FROM ms) AS avg_f1,
     (SELECT avg(CASE WHEN std_score < 0.02 THEN 1.0 ELSE 0.0 END) FROM stab) AS stable_share,
     (SELECT minority_ratio < 0.2 FROM rf) AS class_imbalance,
     (SELECT count(*) = count(p) FROM pred) AS validation_ok)""",
                                     """sc AS (SELECT *, avg_f1 * 100 * 0.4 + stable_share * 100 * 0.3 + CASE WHEN class_imbalance THEN 50.0 ELSE 100.0 END * 0.2
     + CASE WHEN validation_ok THEN 100.0 ELSE 60.0 END * 0.1 AS prs FROM inp)"""],
                                    f"""SELECT {r6("avg_f1")} AS avg_f1, {r6("stable_share")} AS stable_share, class_imbalance, validation_ok, {r6("prs")} AS prs_score,
  CASE WHEN prs > 85 THEN 'READY_FOR_PROD' WHEN prs > 65 THEN 'ACCEPT_WITH_CAUTION' ELSE 'REJECT_EXPERIMENTAL' END AS decision FROM sc"""))
def h18_readiness_score(spark, d):
    ms = model_scores(spark, d).agg(F.avg("f1").alias("avg_f1"))
    st = H.seed_stability(seed_scores(spark, d)).agg(F.avg(F.when(F.col("stability") == "high", 1.0).otherwise(0.0)).alias("stable_share"))
    rf = risk_flags(predictions(spark, d), "y_true").select("class_imbalance")
    vo = predictions(spark, d).agg((F.count(F.lit(1)) == F.count("p")).alias("validation_ok"))
    return round_doubles(H.readiness_score(ms.crossJoin(st).crossJoin(rf).crossJoin(vo)))


@query("h20_decision", with_([PRED_SQL, RISK_SQL, """w AS (SELECT CAST(count(*) - count(p) AS BIGINT) AS n_warnings FROM pred)"""],
                             """SELECT CASE WHEN rows < 1000 THEN 'high' WHEN rows < 70 THEN 'moderate' ELSE 'low' END AS overfitting_risk, n_warnings,
  CASE WHEN (rows < 1000) OR n_warnings > 0 THEN 'ACCEPT_WITH_WARNINGS' ELSE 'ACCEPT' END AS final_decision,
  CASE WHEN n_warnings > 0 THEN 'Data validation warnings detected.' WHEN rows < 1000 THEN 'High overfitting risk detected.'
       ELSE 'Risks within acceptable limits.' END AS reason FROM rf, w"""))
def h20_decision(spark, d):
    p = predictions(spark, d)
    rf = risk_flags(p, "y_true").select("overfitting_risk")
    w = p.agg((F.count(F.lit(1)) - F.count("p")).cast("long").alias("n_warnings"))
    return H.decision(rf.crossJoin(w))


@query("h22_grade_models", with_([PRED_SQL, MODEL_SCORES_SQL], f"""SELECT model, {r6("accuracy")} AS accuracy, {r6("f1")} AS f1,
  CASE WHEN accuracy > 0.9 THEN 'EXCELLENT' WHEN accuracy > 0.8 THEN 'GOOD' WHEN accuracy > 0.7 THEN 'FAIR' ELSE 'POOR' END AS status,
  CASE WHEN accuracy > 0.8 THEN 'Deploy' ELSE 'Needs Optimization' END AS recommendation FROM ms"""))
def h22_grade_models(spark, d):
    return round_doubles(H.grade_models(model_scores(spark, d)))


@query("h22_model_comparison", with_([PRED_SQL, MODEL_SCORES_SQL], f"""SELECT model, {r6("accuracy")} AS accuracy, {r6("f1")} AS f1 FROM ms"""))
def h22_model_comparison(spark, d):
    ms = model_scores(spark, d)
    long = ms.select("model", F.expr("stack(2, 'accuracy', accuracy, 'f1', f1) AS (metric, value)"))
    return round_doubles(H.model_comparison(long))


@query("h13_ab_route")
def h13_ab_route(spark, d):
    """R: hash routing of every event's user into arms A/B (50/50)."""
    return H.ab_route(load_table(spark, d, "events"), "user_id", "exp1").groupBy("arm").agg(F.count(F.lit(1)).alias("n"))


@query("h15_bootstrap_compare")
def h15_bootstrap_compare(spark, d):
    """R: bootstrap of two prediction columns over every event row."""
    p = predictions(spark, d).withColumn("y_pred_b", F.when(F.col("p") >= 0.4, 1).otherwise(0))
    return round_doubles(H.bootstrap_compare(p, "y_pred", "y_pred_b"))


@query("h21_model_card")
def h21_model_card(spark, d):
    """R: one structured record of data profile, per-model metrics and stability."""
    p = predictions(spark, d)
    from tabvet.operators.profile import overview
    return H.model_card(overview(p), model_scores(spark, d), H.seed_stability(seed_scores(spark, d))).select("card_json")
