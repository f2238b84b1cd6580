"""Registered D19 / D21 / D23 queries with their DuckDB oracles."""

from __future__ import annotations

from itertools import combinations

from tabvet.functions.core import round_doubles
from tabvet.operators import scores as S
from tabvet.plans.fixtures import LI_NUMERIC, LINEITEM_NULLS_SQL, lineitem_nulls
from tabvet.plans.registry import query
from tabvet.plans.sqlgen import r6, union_all, with_

COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate"]
BASE = [
    LINEITEM_NULLS_SQL,
    f"ov AS (SELECT count(*) AS n, ({' + '.join(f'count(*) - count({c})' for c in COLS)}) * 100.0 / (count(*) * {len(COLS)}) AS mp FROM li)",
    "cb AS (SELECT count(*) AS classes, max(k) * 1.0 / min(k) AS ratio FROM (SELECT count(*) AS k FROM li WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag))",
]


@query("d19_quality_score_weighted", with_([
    *BASE, f"dp AS (SELECT sum(k - 1) * 100.0 / sum(k) AS dup FROM (SELECT count(*) AS k FROM li GROUP BY {', '.join(COLS)}))",
    f"zv AS (SELECT sum(z) AS zv FROM ({union_all([f'SELECT CASE WHEN stddev_samp({c}) = 0 THEN 1 ELSE 0 END AS z FROM li' for c in LI_NUMERIC])}))",
    """s AS (SELECT *, greatest(0, least(100, 100 - floor(mp * 2) - CASE WHEN classes > 1 AND ratio > 3 THEN 15 ELSE 0 END
  - CASE WHEN dup > 1 THEN 10 ELSE 0 END - zv * 3 + CASE WHEN n > 10000 THEN 5 ELSE 0 END)) AS score FROM ov, cb, dp, zv)"""],
    f"""SELECT {r6("mp")} AS missing_pct, {r6("ratio")} AS imbalance_ratio, {r6("dup")} AS duplicate_pct, CAST(zv AS BIGINT) AS zero_variance,
  CAST(score AS BIGINT) AS score, CASE WHEN score >= 80 THEN 'Excellent' WHEN score >= 60 THEN 'Good' ELSE 'Fair' END AS level FROM s"""))
def d19_quality_score_weighted(spark, d):
    return round_doubles(S.quality_score_weighted(lineitem_nulls(spark, d), "l_returnflag"))


@query("d21_dataset_shape", with_(BASE, f"""SELECT n AS n_rows, CAST(11 AS BIGINT) AS n_columns,
  CASE WHEN n < 1000 THEN 'tiny' WHEN n < 10000 THEN 'small' WHEN n < 100000 THEN 'medium' WHEN n < 1000000 THEN 'large' ELSE 'huge' END AS size_class,
  CAST(8 AS BIGINT) AS numeric_count, CAST(2 AS BIGINT) AS categorical_count, CAST(1 AS BIGINT) AS datetime_count,
  (SELECT max(length(l_linestatus)) > 100 FROM li) AS has_text, classes, {r6("ratio")} AS imbalance_ratio,
  CASE WHEN ratio < 1.5 THEN 'balanced' WHEN ratio < 3 THEN 'slightly_imbalanced' WHEN ratio < 10 THEN 'imbalanced' ELSE 'severely_imbalanced' END AS imbalance_level,
  'medium' AS dimensionality, round(1 - mp / 100, 2) AS feature_density, round(CAST(11 AS DOUBLE) / n, 4) AS feature_ratio FROM ov, cb"""))
def d21_dataset_shape(spark, d):
    return round_doubles(S.dataset_shape(lineitem_nulls(spark, d), "l_returnflag"))


@query("d23_meta_features", with_([
    *BASE, f"co AS (SELECT avg(abs(r)) AS r FROM ({union_all([f'SELECT corr({a}, {b}) AS r FROM li' for a, b in combinations(LI_NUMERIC, 2)])}))",
    f"sk AS (SELECT avg(abs(s)) AS s FROM ({union_all([f'SELECT skewness({c}) AS s FROM li' for c in LI_NUMERIC])}))"],
    f"""SELECT n AS n_rows, CAST(11 AS BIGINT) AS n_cols, CAST(8 AS BIGINT) AS n_numeric, CAST(2 AS BIGINT) AS n_categorical,
  {r6("ratio")} AS class_imbalance, {r6("r")} AS mean_correlation, {r6("mp")} AS missing_percentage, {r6("s", 4)} AS skewness_mean FROM ov, cb, co, sk"""))
def d23_meta_features(spark, d):
    return round_doubles(S.meta_features(lineitem_nulls(spark, d), "l_returnflag"), 6, {"skewness_mean": 4})
