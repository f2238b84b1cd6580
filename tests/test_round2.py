"""Value tests of statistics, thresholds and texts; NULL strata, large ids and counts, partitionings."""

import math

import pytest
from pyspark.sql import functions as F

from tabvet.functions import stats as S
from tabvet.operators import drift as G
from tabvet.operators import evaluate as H
from tabvet.operators import features as FE
from tabvet.operators import infer as C
from tabvet.operators import monitor as L
from tabvet.operators import profile as P
from tabvet.operators import validate as B


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_large_ids_keep_their_type(spark):
    df = spark.range(2000).select((F.col("id") + (1 << 60)).alias("big"), (F.col("id") % 3).cast("decimal(30,10)").alias("dec"),
                                  F.expr("cast('9007199254740993.0000000001' as decimal(30,10)) + cast(id as decimal(20,0)) / cast(10 as decimal(2,0))").alias("close"))
    got = {r["column"]: r for r in rows(P.profile_columns(df))}
    assert got["big"]["n_distinct"] == 2000 and got["dec"]["n_distinct"] == 3 and got["close"]["n_distinct"] == 2000
    kinds = {r["column"]: r for r in rows(C.categorize_columns(df.select("big")))}
    assert "CATEGORICAL" not in str(kinds["big"])


def test_profile_scans_the_table_twice_at_most(spark, sf):
    plan = P.profile_columns(spark.read.parquet(f"{sf}/lineitem.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1  # the other scan went into the stored distinct table


def test_null_stratum_is_sampled(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 3).alias("s"))
    got = {r["s"]: r["count"] for r in rows(B.stratified_sample(df, ["s"], 0.2, F.xxhash64("id")).groupBy("s").count())}
    assert got == {None: 20, 1: 20, 2: 20}


def test_crosstab_known_values(spark):
    cells = [("a", "x", 12), ("a", "y", 5), ("b", "x", 3), ("b", "y", 20)]
    df = spark.createDataFrame(cells, "a string, b string, n int").withColumn("i", F.explode(F.sequence(F.lit(1), "n")))
    got = rows(P.crosstab_stats(df, "a", "b"))[0]
    n, e = 40, [17 * 15 / 40, 17 * 25 / 40, 23 * 15 / 40, 23 * 25 / 40]
    chi2 = sum((abs(o - x) - 0.5) ** 2 / x for (_, _, o), x in zip(cells, e))
    assert got["n"] == n and got["dof"] == 1 and math.isclose(got["chi2"], chi2, rel_tol=1e-9)
    assert math.isclose(got["p_value"], math.erfc(math.sqrt(chi2 / 2)), rel_tol=1e-6)


def test_crosstab_of_many_rows_does_not_overflow(spark):
    df = spark.range(6_000_000).select((F.col("id") % 2).alias("a"), (F.col("id") % 4 < 2).alias("b"))
    assert math.isclose(rows(P.crosstab_stats(df, "a", "b"))[0]["chi2"], 0.0, abs_tol=1e-3)


def test_p_values_known(spark):
    assert math.isclose(S.chi2_sf_scalar(3.841458820694124, 1), 0.05, rel_tol=1e-6)
    assert math.isclose(S.chi2_sf_scalar(9.487729036781154, 4), 0.05, rel_tol=1e-6)
    assert math.isclose(S.t_sf_two_sided_scalar(2.2281388519649385, 10), 0.05, rel_tol=1e-6)
    assert math.isclose(S.t_sf_two_sided_scalar(1.9599639845, 1e9), 0.05, rel_tol=1e-4)


def test_missingness_bias_needs_significance(spark):
    df = spark.range(400).select((F.col("id") * 1.0).alias("x"), F.when(F.col("id") >= 200, F.lit(1.0)).alias("y"),
                                 F.when(F.col("id") < 200, "low").otherwise("high").alias("c"))
    got = {r["other_col"]: r for r in rows(P.missingness_bias(df))}
    assert got["x"]["severity"] == got["c"]["severity"] == "CRITICAL" and got["x"]["p_value"] < 0.05 and got["c"]["kind"] == "categorical"
    few = spark.range(8).select((F.col("id") * 1.0).alias("x"), F.when(F.col("id") >= 4, F.lit(1.0)).alias("y"))
    assert rows(P.missingness_bias(few)) == []


def test_target_correlation_and_quality_levels(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("y"), (F.col("id") + 900 * ((F.col("id") * 7919) % 2)).cast("double").alias("x"))
    got = rows(P.target_correlations(df, "y", ["x"]))[0]
    assert got["strength"] == ("High" if abs(got["r"]) >= 0.5 else "Medium" if abs(got["r"]) >= 0.3 else "Low")
    half = spark.range(100).select(F.when(F.col("id") < 78, F.col("id")).alias("a"), F.when(F.col("id") < 78, F.col("id")).alias("b"))
    got = rows(P.quality_score_linear(half))[0]
    assert got["level"] == ("excellent" if got["score"] >= 90 else "good" if got["score"] >= 80 else "fair" if got["score"] >= 70 else "poor")


def test_ab_winner_is_named_without_significance(spark):
    data = [("A", 1, int(i < 6), 0.5) for i in range(10)] + [("B", 1, int(i < 5), 0.5) for i in range(10)]
    got = rows(H.ab_results(spark.createDataFrame(data, "arm string, y_true int, y_pred int, p double")))
    assert {r["winner"] for r in got} == {"A"} and not any(r["significant"] for r in got)


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.range(20_000).select(F.lit(1).alias("y_true"), (F.col("id") % 10 < 8).cast("int").alias("a"), (F.col("id") % 100 < 79).cast("int").alias("b"))
    one, many = (rows(H.bootstrap_compare(df.repartition(n), "a", "b"))[0] for n in (1, 7))
    assert all(math.isclose(one[k], many[k], rel_tol=1e-9) for k in ("mean_a", "mean_b", "t_stat")) and one["winner"] == many["winner"] == "a"
    assert one["p_value"] < 0.05
    same = rows(H.bootstrap_compare(df, "a", "a"))[0]
    assert same["winner"] == "tie"


def test_reasons_and_alert_texts_hold_the_values(spark):
    m = spark.createDataFrame([("m", 0.1234, 0.4567, 0.9, 0.7, 45)], "model string, error_rate double, drift_score double, baseline_accuracy double, current_accuracy double, age_days int")
    assert rows(G.should_retrain(m))[0]["reasons"] == (
        "High error rate: 12.34%; Data drift detected: 0.457; Performance drop: 90.00% → 70.00%; Model age: 45 days")
    texts = {r["alert_type"]: r["message"] for r in rows(L.threshold_alerts(m))}
    assert texts["high_error_rate"] == "Error rate 12.34% exceeds threshold 5.00%"
    assert texts["performance_degradation"] == "Accuracy dropped from 90.00% to 70.00%"


def test_rule_features_of_long_names_and_many_columns(spark):
    df = spark.range(1, 50).select(*[(F.col("id") * (i + 1) % 17 + 1).cast("double").alias(f"cust_total_{c}") for i, c in enumerate("abcdefg")])
    out, feats = FE.rule_features(df)
    names = [f[0] for f in feats]
    assert len(set(names)) == len(names) and sum(n.endswith("_squared") for n in names) == 7 and sum("_x_" in n for n in names) == 21
    assert FE.feature_summary(out, feats).count() == len(feats)
    assert len(FE.rule_features(df, limit=5)[1]) == 5


@pytest.mark.parametrize("y, p, want", [([0, 1, 1, 0, 1, 0], [0, 1, 0, 0, 1, 1], {(0, 1): 1, (1, 0): 1, (0, 0): 2, (1, 1): 2})])
def test_confusion_hand_vector(spark, y, p, want):
    got = rows(H.confusion_matrix(spark.createDataFrame(list(zip(y, p)), "y_true int, y_pred int")))
    assert {(r["actual"], r["predicted"]): r["count"] for r in got} == want
