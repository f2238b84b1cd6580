"""H-series: model evaluation over a predictions table (y_true, y_pred, probability, keys).

Every metric is a conditional aggregate or a join of result-sized tables (classes x classes,
groups, arms). Rank-based metrics (AUC, ROC, conformal quantile) use the distributed
running-totals kernel over distinct scores instead of a global sort in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabvet.functions.stats import erfc_udf, t_sf_two_sided
from tabvet.operators.longform import running_totals


def _div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(0.0))


# ------------------------------------------------------------------ H1-H3
def confusion_matrix(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """H1: (actual, predicted, count, share) on the full label grid; share is row-normalised."""
    labels = df.select(F.col(y).alias("l")).union(df.select(F.col(p).alias("l"))).where(F.col("l").isNotNull()).distinct()
    grid = labels.select(F.col("l").alias("actual")).crossJoin(F.broadcast(labels.select(F.col("l").alias("predicted"))))
    counts = df.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.count(F.lit(1)).alias("count"))
    cm = grid.join(counts, ["actual", "predicted"], "left").withColumn("count", F.coalesce(F.col("count"), F.lit(0)).cast("long"))
    row = Window.partitionBy("actual")
    return cm.withColumn("share", _div(F.col("count"), F.sum("count").over(row)))


def binary_counts(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """H1 (binary): TN, FP, FN, TP in one aggregate."""
    return df.agg(*[F.sum(((F.col(y) == a) & (F.col(p) == b)).cast("long")).alias(n)
                    for n, a, b in (("true_negatives", 0, 0), ("false_positives", 0, 1),
                                    ("false_negatives", 1, 0), ("true_positives", 1, 1))])


def class_report(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """H2: per class support, TP, FP, FN, precision, recall, F1, miss rate, false discovery rate."""
    cm = confusion_matrix(df, y, p)
    a = cm.groupBy(F.col("actual").alias("class")).agg(
        F.sum("count").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0)).alias("tp"))
    b = cm.groupBy(F.col("predicted").alias("class")).agg(F.sum("count").alias("pred_total"))
    j = a.join(b, "class")
    tp, fp, fn = F.col("tp"), F.col("pred_total") - F.col("tp"), F.col("support") - F.col("tp")
    prec, rec = _div(tp, tp + fp), _div(tp, F.col("support"))
    return j.select("class", F.col("support").cast("long"), tp.cast("long").alias("true_positives"),
                    fp.cast("long").alias("false_positives"), fn.cast("long").alias("false_negatives"),
                    prec.alias("precision"), rec.alias("recall"),
                    F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0).alias("f1_score"),
                    _div(fn, F.col("support")).alias("miss_rate"), _div(fp, tp + fp).alias("false_discovery_rate"))


def top_confusions(df: DataFrame, k: int = 3, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """H3: largest off-diagonal cells (ties by actual, predicted)."""
    cm = confusion_matrix(df, y, p)
    return cm.where((F.col("actual") != F.col("predicted")) & (F.col("count") > 0)) \
        .orderBy(F.desc("count"), "actual", "predicted").limit(max(1, k)).select("actual", "predicted", "count")


def hardest_classes(df: DataFrame, k: int = 3, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """H3: classes ranked by error burden (FP + FN) then miss rate."""
    r = class_report(df, y, p)
    return r.select("class", (F.col("false_positives") + F.col("false_negatives")).alias("error_burden"),
                    "miss_rate", "precision", "recall") \
        .orderBy(F.desc("error_burden"), F.desc("miss_rate"), "class").limit(k)


# ------------------------------------------------------------------ H4 / H5 / H7
def confidence(p: Column, y_pred: Column) -> Column:
    """Confidence of the predicted label for a 1-D positive-class probability, clipped to [0, 1]."""
    c = F.when(y_pred == 1, p).otherwise(1 - p)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def confidence_risk(df: DataFrame, y: str = "y_true", p: str = "y_pred", prob: str = "p") -> DataFrame:
    """H4: totals, accuracy, mean confidence, over-confident (>= 0.8) and uncertain (<= 0.6) errors."""
    conf = confidence(F.col(prob), F.col(p))
    wrong = F.col(y) != F.col(p)
    r = df.agg(F.count(F.lit(1)).alias("total_samples"), F.sum(wrong.cast("long")).alias("total_errors"),
               F.avg(conf).alias("mean_confidence"),
               F.sum(((conf >= 0.8) & wrong).cast("long")).alias("overconfident_errors"),
               F.sum(((conf <= 0.6) & wrong).cast("long")).alias("uncertain_errors"))
    return r.select("total_samples", "total_errors",
                    (1 - F.col("total_errors") / F.col("total_samples")).alias("accuracy"),
                    (F.col("total_errors") / F.col("total_samples")).alias("error_rate"),
                    "mean_confidence", "overconfident_errors", "uncertain_errors",
                    _div(F.col("overconfident_errors"), F.col("total_errors")).alias("overconfident_error_rate"))


def classification_metrics(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """H5: accuracy and support-weighted precision / recall / F1."""
    r = class_report(df, y, p)
    w = r.agg(F.sum("support").alias("n"), F.sum(F.col("support") * F.col("precision")).alias("sp"),
              F.sum(F.col("support") * F.col("recall")).alias("sr"), F.sum(F.col("support") * F.col("f1_score")).alias("sf"),
              F.sum("true_positives").alias("correct"))
    return w.select((F.col("correct") / F.col("n")).alias("accuracy"), (F.col("sp") / F.col("n")).alias("precision_weighted"),
                    (F.col("sr") / F.col("n")).alias("recall_weighted"), (F.col("sf") / F.col("n")).alias("f1_weighted"))


def extended_metrics(df: DataFrame, y: str = "y_true", p: str = "y_pred", prob: str | None = "p", eps: float = 1e-15) -> DataFrame:
    """H7: balanced accuracy, Matthews correlation, Cohen's kappa (multiclass closed forms), log loss."""
    r = class_report(df, y, p).withColumn("pred_total", F.col("true_positives") + F.col("false_positives"))
    s = r.agg(F.avg("recall").alias("balanced_accuracy"), F.sum("support").alias("n"), F.sum("true_positives").alias("c"),
              F.sum(F.col("support") * F.col("pred_total")).alias("pt"), F.sum(F.col("support") * F.col("support")).alias("tt"),
              F.sum(F.col("pred_total") * F.col("pred_total")).alias("pp"))
    n, c = F.col("n").cast("double"), F.col("c").cast("double")
    mcc_den = F.sqrt((n * n - F.col("pp")) * (n * n - F.col("tt")))
    pe = F.col("pt") / (n * n)
    out = s.select("balanced_accuracy",
                   F.when(mcc_den > 0, (c * n - F.col("pt")) / mcc_den).otherwise(0.0).alias("mcc"),
                   F.when(pe < 1, (c / n - pe) / (1 - pe)).otherwise(0.0).alias("cohen_kappa"))
    if prob is not None:
        pc = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(prob)))
        ll = df.agg(F.avg(-(F.col(y) * F.log(pc) + (1 - F.col(y)) * F.log(1 - pc))).alias("log_loss"))
        out = out.crossJoin(ll)
    return out


# ------------------------------------------------------------------ H6
def roc_auc(df: DataFrame, y: str = "y_true", score: str = "p", keys: list[str] | None = None) -> DataFrame:
    """H6: binary ROC AUC per key (Mann-Whitney with tie-averaged ranks); 0.5 when one class is absent."""
    keys = keys or []
    k = keys or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(1))
    vc = base.groupBy(*k, F.col(score).cast("double").alias("s")).agg(
        F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) != 1).cast("long")).alias("neg"))
    rt = running_totals(vc, k, "s", ["neg"])
    contrib = rt.groupBy(*k).agg(
        F.sum(F.col("pos") * ((F.col("cum_neg") - F.col("neg")) + 0.5 * F.col("neg"))).alias("u"),
        F.max("tot_neg").alias("n_neg"))
    pos = vc.groupBy(*k).agg(F.sum("pos").alias("n_pos"))
    j = contrib.join(pos, k)
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos") * F.col("n_neg"))).otherwise(0.5)
    return j.select(*keys, auc.alias("roc_auc"), F.col("n_pos").cast("long"), F.col("n_neg").cast("long"))


def roc_curve(df: DataFrame, y: str = "y_true", score: str = "p") -> DataFrame:
    """H6: (threshold, fpr, tpr) at every distinct score (predict positive when score >= threshold)."""
    vc = df.groupBy(F.lit(1).alias("_all"), F.col(score).cast("double").alias("threshold")).agg(
        F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) != 1).cast("long")).alias("neg"))
    rt = running_totals(vc, ["_all"], "threshold", ["pos", "neg"])
    tp = F.col("tot_pos") - F.col("cum_pos") + F.col("pos")
    fp = F.col("tot_neg") - F.col("cum_neg") + F.col("neg")
    return rt.select("threshold", _div(fp, F.col("tot_neg")).alias("fpr"), _div(tp, F.col("tot_pos")).alias("tpr"))


# ------------------------------------------------------------------ H8
def regression_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """H8: MSE, RMSE, MAE, R^2 in one aggregate."""
    e = F.col(y) - F.col(yhat)
    s = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("sse"),
        F.var_pop(y).alias("vy"), F.count(F.lit(1)).alias("n"))
    return s.select("mse", F.sqrt("mse").alias("rmse"), "mae",
                    F.when(F.col("vy") > 0, 1 - F.col("sse") / (F.col("vy") * F.col("n"))).otherwise(0.0).alias("r2"))


# ------------------------------------------------------------------ H10
def calibration_bin(conf: Column, bins: int = 10) -> Column:
    """Index i (1-based) with edge[i-1] < conf <= edge[i], edges = k * (1/bins); conf <= 0 -> NULL."""
    step = 1.0 / bins
    b0 = F.ceil(conf * bins).cast("int")
    b1 = F.when(conf > b0 * step, b0 + 1).when(conf <= (b0 - 1) * step, b0 - 1).otherwise(b0)
    return F.when((conf <= 0) | (conf > 1), F.lit(None).cast("int")).otherwise(b1)


def calibration_error(df: DataFrame, y: str = "y_true", p: str = "y_pred", prob: str = "p", bins: int = 10) -> DataFrame:
    """Expected calibration error over (lo, hi] confidence bins; good < 0.05, moderate < 0.12."""
    conf = confidence(F.col(prob), F.col(p))
    base = df.select(conf.alias("conf"), (F.col(y) == F.col(p)).cast("double").alias("ok"))
    n = base.agg(F.count(F.lit(1)).alias("n"))
    per = base.withColumn("bin", calibration_bin(F.col("conf"), bins)).where(F.col("bin").isNotNull()) \
        .groupBy("bin").agg(F.avg("ok").alias("acc"), F.avg("conf").alias("c"), F.count(F.lit(1)).alias("k"))
    e = per.crossJoin(n).agg(F.sum(F.abs(F.col("acc") - F.col("c")) * F.col("k") / F.col("n")).alias("ece"))
    e = e.select(F.coalesce(F.col("ece"), F.lit(0.0)).alias("ece"))
    return e.withColumn("level", F.when(F.col("ece") < 0.05, "good").when(F.col("ece") < 0.12, "moderate").otherwise("poor"))


# ------------------------------------------------------------------ H11
def fairness_groups(df: DataFrame, group: str, y: str = "y_true", p: str = "y_pred", min_n: int = 10) -> DataFrame:
    """Per group (n >= 10) accuracy, precision, recall, F1 (positive class 1), positive rate."""
    g = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col(y) == F.col(p)).cast("long")).alias("ok"),
        F.sum(((F.col(y) == 1) & (F.col(p) == 1)).cast("long")).alias("tp"),
        F.sum(((F.col(y) != 1) & (F.col(p) == 1)).cast("long")).alias("fp"),
        F.sum(((F.col(y) == 1) & (F.col(p) != 1)).cast("long")).alias("fn"),
        F.avg(F.col(p).cast("double")).alias("positive_rate"))
    prec, rec = _div(F.col("tp"), F.col("tp") + F.col("fp")), _div(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.where(F.col("n") >= min_n).select(
        F.col("group").cast("string").alias("group"), F.col("n").cast("long"), (F.col("ok") / F.col("n")).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"),
        F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0).alias("f1"), "positive_rate")


def fairness_summary(groups: DataFrame) -> DataFrame:
    """Accuracy gap, worst / best group, disparate impact, risk level (CRITICAL > 0.15, WARNING > 0.08)."""
    s = groups.agg(F.count(F.lit(1)).alias("n_groups"), (F.max("accuracy") - F.min("accuracy")).alias("accuracy_gap"),
                   F.min_by("group", F.struct("accuracy", "group")).alias("worst_group"),
                   F.max_by("group", F.struct("accuracy", F.col("group"))).alias("best_group"),
                   F.min("positive_rate").alias("min_pr"), F.max("positive_rate").alias("max_pr"))
    return s.where(F.col("n_groups") >= 2).select(
        F.col("n_groups").cast("long"), "accuracy_gap", "worst_group", "best_group",
        F.when(F.col("max_pr") > 0, F.col("min_pr") / F.col("max_pr")).alias("disparate_impact"),
        F.when(F.col("accuracy_gap") > 0.15, "CRITICAL").when(F.col("accuracy_gap") > 0.08, "WARNING").otherwise("LOW").alias("risk_level"))


# ------------------------------------------------------------------ H12
def conformal_fit(cal: DataFrame, y: str = "y_true", prob: str = "p", alpha: float = 0.1) -> DataFrame:
    """q_hat = 'higher' quantile of 1 - p(true class) at ceil((n+1)(1-alpha))/n.

    The score at the selected rank is found through the distributed running-totals kernel.
    """
    sc = cal.select(F.lit(1).alias("_k"), (1 - F.when(F.col(y) == 1, F.col(prob)).otherwise(1 - F.col(prob))).alias("s"))
    vc = sc.groupBy("_k", "s").agg(F.count(F.lit(1)).alias("n"))
    rt = running_totals(vc, ["_k"], "s", ["n"])
    n = F.col("tot_n").cast("double")
    lvl = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.ceil((n + 1) * (1 - alpha)) / n))
    rank = F.ceil((n - 1) * lvl).cast("long")                      # numpy method='higher'
    hit = rt.where((F.col("cum_n") - F.col("n") <= rank) & (rank < F.col("cum_n")))
    return hit.select(F.lit(alpha).alias("alpha"), F.col("tot_n").cast("long").alias("n_cal"), F.col("s").alias("q_hat"))


def conformal_predict(df: DataFrame, qhat: DataFrame, prob: str = "p") -> DataFrame:
    """Prediction set {k : p_k >= 1 - q_hat}, or the argmax class when empty (binary probabilities)."""
    probs = F.array(1 - F.col(prob), F.col(prob))
    j = df.crossJoin(F.broadcast(qhat.select("q_hat")))            # one row
    idx = F.sequence(F.lit(0), F.lit(1))
    s = F.filter(idx, lambda k: probs[k] >= 1 - F.col("q_hat"))
    arg = F.when(F.col(prob) > 1 - F.col(prob), 1).otherwise(0)
    return j.withColumn("prediction_set", F.when(F.size(s) > 0, s).otherwise(F.array(arg))).drop("q_hat")


def conformal_coverage(sets: DataFrame, y: str = "y_true", alpha: float = 0.1) -> DataFrame:
    return sets.agg(F.avg(F.array_contains("prediction_set", F.col(y)).cast("double")).alias("empirical_coverage"),
                    F.avg(F.size("prediction_set").cast("double")).alias("average_set_size")) \
        .select(F.lit(1 - alpha).alias("target_coverage"), "empirical_coverage", "average_set_size")


# ------------------------------------------------------------------ H13 / H14 / H15
def ab_route(df: DataFrame, key: str, test: str = "ab", split: float = 0.5) -> DataFrame:
    """Deterministic arm assignment by hashing (key, test) -- stable across reruns and partitionings."""
    b = F.pmod(F.xxhash64(F.col(key), F.lit(test)), F.lit(10000))
    return df.withColumn("arm", F.when(b < int(split * 10000), "A").otherwise("B"))


def ab_results(df: DataFrame, arm: str = "arm", y: str = "y_true", p: str = "y_pred", prob: str = "p", with_p: bool = True) -> DataFrame:
    """Per arm n / accuracy / mean confidence, and the Yates-corrected 2x2 chi-square of
    (correct, wrong) x arm; p = erfc(sqrt(chi2 / 2)) for one degree of freedom. The winner is the arm with the
    better accuracy (the last arm on a tie), whether or not the difference is significant."""
    ok = (F.col(y) == F.col(p)).cast("long")
    a = df.groupBy(F.col(arm).alias("arm")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(ok).cast("double").alias("correct"),
                                                F.avg(confidence(F.col(prob), F.col(p))).alias("mean_confidence"))
    t = a.agg(F.sum("n").alias("n_tot"), F.sum("correct").alias("c_tot"))
    cells = a.crossJoin(t).select("arm", "n", "correct", "mean_confidence",
                                  (F.col("n") * F.col("c_tot") / F.col("n_tot")).alias("e_ok"),
                                  (F.col("n") * (F.col("n_tot") - F.col("c_tot")) / F.col("n_tot")).alias("e_bad"))
    def yates(o, e):
        return F.when(e > 0, F.pow(F.greatest(F.abs(o - e) - 0.5, F.lit(0.0)), 2) / e).otherwise(0.0)
    chi = cells.agg(F.sum(yates(F.col("correct"), F.col("e_ok")) + yates(F.col("n") - F.col("correct"), F.col("e_bad"))).alias("chi2"))
    out = a.crossJoin(chi).select("arm", F.col("n").cast("long").alias("n"), (F.col("correct") / F.col("n")).alias("accuracy"),
                                  "mean_confidence", "chi2")
    out = out.withColumn("significant", F.col("chi2") > 3.841458820694124)   # chi2(1) critical value at p = 0.05
    best = out.agg(F.max(F.struct("accuracy", "arm")).getField("arm").alias("winner"))   # one row
    out = out.crossJoin(best)
    if with_p:
        out = out.withColumn("p_value", erfc_udf(F.sqrt(F.col("chi2") / 2)))
    return out


def bootstrap_compare(df: DataFrame, a: str, b: str, y: str = "y_true", n_rep: int = 100, seed: int = 7, alpha: float = 0.05) -> DataFrame:
    """Bootstrap of two models' accuracies, two-sample t test over the replicates.

    A replicate depends only on how often each of the four outcomes (a right or wrong, b right or wrong) is drawn, so
    the rows are aggregated once into four counts. Drawing N rows with replacement is a Poisson count per outcome
    for the large totals at hand: count + sqrt(count) * z, z a hashed standard normal per (outcome, replicate), rounded
    and kept at 0 or above. Nothing depends on the partitioning. Equal means, or p not below alpha, give a tie.
    """
    right_a, right_b = (F.col(y) == F.col(a)).cast("int"), (F.col(y) == F.col(b)).cast("int")
    cells = df.where(right_a.isNotNull() & right_b.isNotNull()).groupBy(right_a.alias("ra"), right_b.alias("rb")).agg(F.count(F.lit(1)).alias("n"))
    reps = cells.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_rep - 1))))

    def uniform(salt: int) -> Column:
        return (F.pmod(F.xxhash64("ra", "rb", "rep", F.lit(seed), F.lit(salt)), F.lit(1 << 30)).cast("double") + 0.5) / float(1 << 30)

    z = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(2))
    drawn = reps.withColumn("w", F.greatest(F.lit(0.0), F.round(F.col("n") + F.sqrt("n") * z)))
    per = drawn.groupBy("rep").agg((F.sum(F.col("w") * F.col("ra")) / F.sum("w")).alias("acc_a"), (F.sum(F.col("w") * F.col("rb")) / F.sum("w")).alias("acc_b"))
    s = per.agg(F.avg("acc_a").alias("mean_a"), F.avg("acc_b").alias("mean_b"), F.var_samp("acc_a").alias("va"), F.var_samp("acc_b").alias("vb"),
                F.count(F.lit(1)).alias("k"))
    spread = F.sqrt((F.col("va") + F.col("vb")) / F.col("k"))
    s = s.withColumn("t_stat", F.when(spread > 0, (F.col("mean_a") - F.col("mean_b")) / spread))
    s = s.withColumn("p_value", t_sf_two_sided(F.col("t_stat"), (2 * F.col("k") - 2).cast("double")))
    winner = F.when(F.col("p_value") < alpha, F.when(F.col("t_stat") > 0, F.lit(a)).otherwise(F.lit(b))).otherwise(F.lit("tie"))
    return s.select("mean_a", "mean_b", "t_stat", "p_value", winner.alias("winner"))


# ------------------------------------------------------------------ H16-H22
def leaderboard(scores: DataFrame, model: str = "model", score: str = "f1", tie: str = "accuracy") -> DataFrame:
    """Models ranked by score (ties by secondary score, then name); champion and medals."""
    w = Window.orderBy(F.desc(score), F.desc(tie), F.asc(model))
    r = scores.withColumn("rank", F.row_number().over(w))
    return r.withColumn("champion", F.col("rank") == 1).withColumn(
        "medal", F.when(F.col("rank") == 1, "gold").when(F.col("rank") == 2, "silver").when(F.col("rank") == 3, "bronze"))


def seed_stability(scores: DataFrame, model: str = "model", score: str = "score", threshold: float = 0.02) -> DataFrame:
    """Mean and population std of the score over seeds; high stability if std < 0.02."""
    return scores.groupBy(model).agg(F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"),
                                     F.count(F.lit(1)).alias("n_runs")) \
        .withColumn("stability", F.when(F.col("std_score") < threshold, "high").otherwise("low"))


def readiness_score(df: DataFrame, avg_f1: str = "avg_f1", stable_share: str = "stable_share",
                    class_imbalance: str = "class_imbalance", validation_ok: str = "validation_ok") -> DataFrame:
    """0.4 performance + 0.3 stability + 0.2 fairness + 0.1 data quality, with the decision."""
    perf = F.col(avg_f1) * 100
    stab = F.col(stable_share) * 100
    fair = F.when(F.col(class_imbalance), 50.0).otherwise(100.0)
    qual = F.when(F.col(validation_ok), 100.0).otherwise(60.0)
    prs = perf * 0.4 + stab * 0.3 + fair * 0.2 + qual * 0.1
    return df.withColumn("prs_score", prs).withColumn(
        "decision", F.when(F.col("prs_score") > 85, "READY_FOR_PROD").when(F.col("prs_score") > 65, "ACCEPT_WITH_CAUTION")
        .otherwise("REJECT_EXPERIMENTAL"))


def decision(df: DataFrame, overfitting_risk: str = "overfitting_risk", n_warnings: str = "n_warnings") -> DataFrame:
    """ACCEPT unless high overfitting risk or validation warnings -> ACCEPT_WITH_WARNINGS."""
    warn = F.col(n_warnings) > 0
    over = F.col(overfitting_risk) == "high"
    return df.withColumn("final_decision", F.when(over | warn, "ACCEPT_WITH_WARNINGS").otherwise("ACCEPT")).withColumn(
        "reason", F.when(warn, "Data validation warnings detected.").when(over, "High overfitting risk detected.")
        .otherwise("Risks within acceptable limits."))


def grade_models(metrics: DataFrame, acc: str = "accuracy") -> DataFrame:
    """EXCELLENT > 0.9, GOOD > 0.8, FAIR > 0.7 else POOR; deploy when accuracy > 0.8."""
    a = F.col(acc)
    return metrics.withColumn("status", F.when(a > 0.9, "EXCELLENT").when(a > 0.8, "GOOD").when(a > 0.7, "FAIR").otherwise("POOR")) \
        .withColumn("recommendation", F.when(a > 0.8, "Deploy").otherwise("Needs Optimization"))


def model_comparison(long_metrics: DataFrame, model: str = "model", metric: str = "metric", value: str = "value") -> DataFrame:
    """Long (model, metric, value) -> wide model x metric table."""
    names = sorted(r[0] for r in long_metrics.select(metric).distinct().collect())   # metric names: a handful
    return long_metrics.groupBy(model).pivot(metric, names).agg(F.first(value))


def model_card(spark_df_profile: DataFrame, metrics: DataFrame, stability: DataFrame) -> DataFrame:
    """One structured record (profile summary, metrics per model, stability) as nested columns."""
    prof = spark_df_profile.agg(F.collect_list(F.struct(*spark_df_profile.columns)).alias("profile"))
    met = metrics.agg(F.collect_list(F.struct(*metrics.columns)).alias("metrics"))
    st = stability.agg(F.collect_list(F.struct(*stability.columns)).alias("stability"))
    return prof.crossJoin(met).crossJoin(st).withColumn("card_json", F.to_json(F.struct("profile", "metrics", "stability")))
