"""Registered queries C7, C8, D20, H19, I17 on a table of measurements derived from `orders`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.functions.core import round_doubles
from tabvet.operators import ranges as C
from tabvet.operators.registry_log import first_rule
from tabvet.plans.registry import query
from tabvet.plans.sqlgen import r6, union_all, with_
from tabvet.sources.tables import load_table

#: column -> (SQL, semantic type by name or None, kind); the same arithmetic on both sides.
CLINIC = {
    "order_id": ("o_orderkey", None, "whole"),
    "patient_age": ("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 18 + o_custkey % 80 END", "age", "whole"),
    "bmi": ("15 + (o_orderkey % 30) * 1.5e0", "bmi", "double"),
    "pulse": ("CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 55 + (o_custkey % 50) * 1.0e0 END", "heart_rate", "double"),
    "fasting_glucose": ("60 + (o_orderkey % 500) * 2.0e0", "blood_glucose", "double"),
    "hba1c": ("4 + (o_custkey % 12) * 0.1e0", "hba1c", "double"),
    "smoker": ("o_orderkey % 2", None, "whole"),
    "grade": ("o_custkey % 5", None, "whole"),
    "total": ("o_totalprice", None, "double"),
    "status": ("o_orderstatus", None, "text"),
    "priority": ("o_orderpriority || '-' || (o_orderkey % 40)", None, "text"),
}
CLINIC_SQL = "t AS (SELECT " + ", ".join(f"{x} AS {c}" for c, (x, _, _) in CLINIC.items()) + " FROM orders)"


def clinic(spark, d):
    return load_table(spark, d, "orders").select(*[F.expr(x).alias(c) for c, (x, _, _) in CLINIC.items()])


def _type_sql(position: int, c: str) -> str:
    _, named, kind = CLINIC[c]
    text, number = kind == "text", kind != "text"
    rules = []
    if kind != "double":
        rules.append(f"WHEN count(DISTINCT {c}) = 2 AND bool_and(CAST({c} AS VARCHAR) IN ('0','1','true','false','yes','no','Yes','No','YES','NO')) THEN 'binary_flag'")
    if text:
        rules.append(f"WHEN count(DISTINCT {c}) <= 10 THEN 'categorical'")
    if kind != "double" and any(p in c.replace("_", "") for p in C.ID_PATTERNS):
        rules.append(f"WHEN count(DISTINCT {c}) = count({c}) THEN 'identifier'")
    last = f"'{named}'" if named else "'unknown'" if text else "'continuous'" if kind == "double" else f"CASE WHEN max({c}) - min({c}) > 10 THEN 'continuous' ELSE 'discrete' END"
    finding = "'generic'"
    if named and number:
        _, (lo, hi), (tlo, thi) = C.CLINICAL[named]
        finding = f"CASE WHEN min({c}) >= {lo} * 0.8 AND max({c}) <= {hi} * 1.2 THEN CASE WHEN avg({c}) BETWEEN {tlo} AND {thi} THEN 'typical' ELSE 'atypical' END ELSE 'by name' END"
    kind_sql = f"CASE {' '.join(rules)} ELSE {last} END" if rules else last
    return f"SELECT '{c}' AS \"column\", {position} AS position, {kind_sql} AS semantic_type, {finding} AS finding, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct FROM t"


@query("c7_clinical_types", with_([CLINIC_SQL], union_all([_type_sql(i, c) for i, c in enumerate(CLINIC)])))
def c7_clinical_types(spark, d):
    return C.clinical_types(clinic(spark, d))


_NAMED = {c: C.CLINICAL[kind][2] for c, (_, kind, _) in CLINIC.items() if kind}
_RISK_SQL = "r AS (" + union_all([
    f"SELECT '{c}' AS \"column\", CAST({lo} AS DOUBLE) AS low, CAST({hi} AS DOUBLE) AS high, avg(CASE WHEN {c} < {lo} OR {c} > {hi} THEN 1.0 WHEN {c} IS NOT NULL THEN 0.0 END) * 100 AS pct_outside FROM t"
    for c, (lo, hi) in _NAMED.items()]) + """),
k AS (SELECT *, CASE WHEN pct_outside IS NULL THEN 'unknown' WHEN pct_outside > 30 THEN 'critical' WHEN pct_outside > 15 THEN 'warning' ELSE 'normal' END AS risk FROM r)"""


@query("c8_range_risk", with_([CLINIC_SQL, _RISK_SQL], f"SELECT \"column\", low, high, {r6('pct_outside')} AS pct_outside, risk FROM k"))
def c8_range_risk(spark, d):
    df = clinic(spark, d)
    return round_doubles(C.range_risk(df, C.typical_ranges(C.clinical_types(df))))


_CELLS = " + ".join(f"count({c})" for c in CLINIC)


@query("d20_quality_score_ranges", with_([CLINIC_SQL, _RISK_SQL, f"m AS (SELECT ({_CELLS}) * 100.0 / (count(*) * {len(CLINIC)}) AS complete FROM t)",
       "v AS (SELECT count(*) AS typed, count(*) FILTER (WHERE risk = 'normal') AS valid FROM k)"],
    "SELECT round(complete * 0.4 + valid * 100.0 / typed * 0.6, 1) AS overall_score, round(complete, 1) AS completeness_score, round(valid * 100.0 / typed, 1) AS validity_score, "
    "typed AS typed_columns, typed - valid AS risk_warnings, CAST(0 AS BIGINT) AS identifier_gaps FROM m, v"))
def d20_quality_score_ranges(spark, d):
    return C.quality_score_ranges(clinic(spark, d))


@query("h19_readiness_checklist", with_([CLINIC_SQL,
       f"f AS (SELECT count(*) AS n, 100 - ({_CELLS}) * 100.0 / (count(*) * {len(CLINIC)}) AS missing FROM t)",
       "g AS (SELECT status, count(*) AS c FROM t GROUP BY status)",
       "b AS (SELECT min(c) FILTER (WHERE status IS NOT NULL) * 100.0 / sum(c) FILTER (WHERE status IS NOT NULL) AS least, coalesce(sum(c) FILTER (WHERE status IS NULL), 0) AS nulls FROM g)",
       """k AS (SELECT * FROM (VALUES (1, 'Model Trained', 'PASS', 20, 20), (3, 'Feature Count', 'PASS', 10, 10), (4, 'Model Performance', 'WARN', 10, 20), (8, 'Feature Documentation', 'PASS', 5, 5)) v(position, "check", status, points, most)
  UNION ALL SELECT 2, 'Data Quality', CASE WHEN missing < 5 THEN 'PASS' WHEN missing < 15 THEN 'WARN' ELSE 'FAIL' END, CASE WHEN missing < 5 THEN 15 WHEN missing < 15 THEN 8 ELSE 0 END, 15 FROM f
  UNION ALL SELECT 5, 'Sample Size', CASE WHEN n >= 1000 THEN 'PASS' WHEN n >= 500 THEN 'WARN' ELSE 'FAIL' END, CASE WHEN n >= 1000 THEN 10 WHEN n >= 500 THEN 5 ELSE 0 END, 10 FROM f
  UNION ALL SELECT 6, 'Target Variable', CASE WHEN nulls = 0 THEN 'PASS' ELSE 'WARN' END, CASE WHEN nulls = 0 THEN 10 ELSE 5 END, 10 FROM b
  UNION ALL SELECT 7, 'Class Balance', CASE WHEN least >= 20 THEN 'PASS' WHEN least >= 10 THEN 'WARN' ELSE 'FAIL' END, CASE WHEN least >= 20 THEN 10 WHEN least >= 10 THEN 5 ELSE 0 END, 10 FROM b)"""],
    'SELECT position, "check", status, points, most FROM k'))
def h19_readiness_checklist(spark, d):
    return C.readiness_checklist(clinic(spark, d), "status", "RandomForest", 0.8, documented=6)


_SIZES = [("n < 10", "tiny"), ("n < 14", "small"), ("n < 18", "medium"), ("n < 24", "large")]


@query("i17_recommend_architecture", """WITH g AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS k, avg(value) AS m FROM events GROUP BY user_id),
s AS (SELECT user_id, CASE WHEN n < 10 THEN 'tiny' WHEN n < 14 THEN 'small' WHEN n < 18 THEN 'medium' WHEN n < 24 THEN 'large' ELSE 'huge' END AS z,
  user_id % 9 AS categorical_count, user_id % 4 = 0 AS has_text, CASE user_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS dims,
  CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 5 < 3 THEN 2 ELSE k END AS classes, CASE WHEN m > 50 THEN 'good' ELSE 'poor' END AS q FROM g),
a AS (SELECT *, CASE WHEN classes IS NULL THEN 'regression' WHEN classes = 2 THEN 'binary' ELSE 'multiclass' END AS problem FROM s),
b AS (SELECT *, CASE problem WHEN 'binary' THEN CASE WHEN z = 'tiny' OR (z = 'small' AND q = 'poor') THEN 'LogisticRegression' WHEN z IN ('small', 'medium') AND dims = 'low' THEN 'RandomForest'
    WHEN z IN ('medium', 'large') AND categorical_count > 5 THEN 'LightGBM' WHEN z = 'large' AND dims = 'high' THEN 'XGBoost' WHEN has_text THEN 'NaiveBayes' ELSE 'RandomForest' END
  WHEN 'multiclass' THEN CASE WHEN z IN ('small', 'medium') THEN 'RandomForest' WHEN z = 'large' AND dims = 'high' THEN 'XGBoost' ELSE 'LightGBM' END
  ELSE CASE WHEN z IN ('small', 'medium') THEN 'RandomForest' WHEN z = 'large' THEN 'GradientBoosting' ELSE 'LightGBM' END END AS algorithm FROM a)
SELECT user_id, problem, algorithm, CASE WHEN problem = 'binary' THEN CASE algorithm WHEN 'LogisticRegression' THEN 'handle_missing,scale_features,remove_outliers'
    WHEN 'LightGBM' THEN 'handle_missing,encode_categorical,feature_selection' WHEN 'XGBoost' THEN 'handle_missing,feature_engineering,scale_features'
    WHEN 'NaiveBayes' THEN 'handle_missing,vectorize_text,encode_categorical' ELSE 'handle_missing,encode_categorical,scale_features' END
  WHEN problem = 'multiclass' THEN 'handle_missing,encode_categorical,feature_selection' ELSE 'handle_missing,scale_features,handle_outliers' END AS preprocessing,
  CASE WHEN problem = 'binary' THEN CASE WHEN q = 'good' THEN 0.95 ELSE 0.8 END WHEN problem = 'multiclass' THEN 0.9 ELSE 0.85 END::DOUBLE AS confidence,
  CASE algorithm WHEN 'LogisticRegression' THEN 'RandomForest,SVC' WHEN 'RandomForest' THEN 'XGBoost,LightGBM,GradientBoosting' WHEN 'XGBoost' THEN 'LightGBM,GradientBoosting'
    WHEN 'LightGBM' THEN 'XGBoost,GradientBoosting' WHEN 'GradientBoosting' THEN 'XGBoost,RandomForest' ELSE 'LogisticRegression,RandomForest' END AS alternatives FROM b""")
def i17_recommend_architecture(spark, d):
    """Each user's events stand for a dataset of their own."""
    g = load_table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("k"), F.avg("value").alias("m"))
    u = F.col("user_id")
    shapes = g.select("user_id", first_rule([(F.expr(c), s) for c, s in _SIZES], "huge").alias("size_class"), (u % 9).alias("categorical_count"), (u % 4 == 0).alias("has_text"),
                      first_rule([(u % 3 == 0, "low"), (u % 3 == 1, "medium")], "high").alias("dimensionality"),
                      F.when(u % 5 == 0, F.lit(None)).when(u % 5 < 3, 2).otherwise(F.col("k")).alias("classes"), F.when(F.col("m") > 50, "good").otherwise("poor").alias("quality_level"))
    return round_doubles(C.recommend_architecture(shapes)).select("user_id", "problem", "algorithm", "preprocessing", "confidence", "alternatives")
