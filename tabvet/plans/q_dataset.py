"""Registered dataset-level D queries (describe, fingerprint, stability, cluster profile, leakage)
with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.functions.core import round_doubles
from tabvet.operators import clean as E
from tabvet.operators import dataset as DS
from tabvet.operators.leakage import leakage
from tabvet.plans.fixtures import LI_MEASURES, LINEITEM_NULLS_SQL, lineitem_nulls
from tabvet.plans.q_profile import LI_COLS
from tabvet.plans.registry import query
from tabvet.plans.sqlgen import r6, union_all, with_
from tabvet.sources.tables import load_table


# ------------------------------------------------------------------ D2
def _d2_sql() -> str:
    parts = []
    for i, (c, _, num) in enumerate(LI_COLS):
        if num:
            parts.append(f"""SELECT '{c}' AS "column", {i} AS position, count({c}) AS count, CAST(NULL AS BIGINT) AS "unique",
  CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, {r6(f'avg({c})')} AS mean, {r6(f'stddev_samp({c})')} AS std,
  {r6(f'min({c})')} AS min, {r6(f'quantile_cont({c}, 0.25)')} AS q25, {r6(f'quantile_cont({c}, 0.5)')} AS q50,
  {r6(f'quantile_cont({c}, 0.75)')} AS q75, {r6(f'max({c})')} AS max, {r6(f'(count(*) - count({c})) * 100.0 / count(*)')} AS null_pct FROM li""")
        else:
            top = f"(SELECT CAST({c} AS VARCHAR) AS v, count(*) AS k FROM li WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY k DESC, v LIMIT 1)"
            parts.append(f"""SELECT '{c}' AS "column", {i} AS position, count({c}) AS count, count(DISTINCT {c}) AS "unique",
  (SELECT v FROM {top}) AS top, (SELECT k FROM {top}) AS freq, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std,
  CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS q25, CAST(NULL AS DOUBLE) AS q50, CAST(NULL AS DOUBLE) AS q75,
  CAST(NULL AS DOUBLE) AS max, {r6(f'(count(*) - count({c})) * 100.0 / count(*)')} AS null_pct FROM li""")
    return with_([LINEITEM_NULLS_SQL], union_all(parts))


@query("d2_describe_all", _d2_sql())
def d2_describe_all(spark, d):
    return round_doubles(DS.describe_all(lineitem_nulls(spark, d)))


# ------------------------------------------------------------------ D26 (R: engine-specific hash)
@query("d26_dataset_fingerprint")
def d26_dataset_fingerprint(spark, d):
    return DS.dataset_fingerprint(load_table(spark, d, "orders"))


# ------------------------------------------------------------------ D27
def _d27_parts() -> str:
    parts = []
    for i, (c, _, num) in enumerate(LI_COLS):
        if not num:
            continue
        imputed = f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM li))" if c in LI_MEASURES else c
        parts.append(f"""SELECT '{c}' AS "column", {i} AS position, avg({c}) AS rm, avg({imputed}) AS cm,
  coalesce(stddev_samp({c}), 0) AS rs, coalesce(stddev_samp({imputed}), 0) AS cs FROM li""")
    return union_all(parts)


D27_SQL = with_([LINEITEM_NULLS_SQL, f"s AS ({_d27_parts()})",
                 """t AS (SELECT *, CASE WHEN rm <> 0 THEN abs(cm - rm) / abs(rm) ELSE abs(cm - rm) END AS ms,
                    CASE WHEN rs <> 0 THEN abs(cs - rs) / abs(rs) ELSE abs(cs - rs) END AS ss FROM s)"""],
                f"""SELECT "column", position, {r6('rm')} AS raw_mean, {r6('cm')} AS cleaned_mean, {r6('ms * 100')} AS mean_shift_pct,
  {r6('rs')} AS raw_std, {r6('cs')} AS cleaned_std, {r6('ss * 100')} AS std_shift_pct, ms <= 0.05 AS is_stable FROM t""")


def _d27(spark, d):
    before = lineitem_nulls(spark, d)
    return DS.stability_check(before, E.impute(before, "median", LI_MEASURES), 0.05)


@query("d27_stability_check", D27_SQL)
def d27_stability_check(spark, d):
    return round_doubles(_d27(spark, d))


@query("d27_stability_summary", f"""WITH c AS ({D27_SQL})
SELECT CAST(sum(CASE WHEN is_stable THEN 1 ELSE 0 END) AS BIGINT) AS stable_columns,
  CAST(count(*) - sum(CASE WHEN is_stable THEN 1 ELSE 0 END) AS BIGINT) AS unstable_columns, count(*) AS total_columns,
  sum(CASE WHEN is_stable THEN 1 ELSE 0 END) = count(*) AS overall_stable,
  round(sum(CASE WHEN is_stable THEN 1 ELSE 0 END) * 100.0 / count(*), 1) AS stability_score FROM c""")
def d27_stability_summary(spark, d):
    return DS.stability_summary(_d27(spark, d))


# ------------------------------------------------------------------ D29
D29_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("d29_cluster_profile", f"""WITH o AS (SELECT count(*) AS n, {', '.join(f'avg({c}) AS om_{c}, stddev_samp({c}) AS os_{c}' for c in D29_FEATS)} FROM lineitem),
g AS (SELECT l_returnflag AS cluster, count(*) AS size, {', '.join(f'avg({c}) AS cm_{c}' for c in D29_FEATS)} FROM lineitem GROUP BY 1),
l AS ({union_all([f"SELECT cluster, '{c}' AS feature, cm_{c} AS mean, CASE WHEN os_{c} > 0 THEN (cm_{c} - om_{c}) / os_{c} END AS z, size, size * 1.0 / n AS share FROM g, o" for c in D29_FEATS])})
SELECT cluster, feature, {r6('mean')} AS mean, {r6('z')} AS z, CASE WHEN z > 0.5 THEN 'HIGH' WHEN z < -0.5 THEN 'LOW' END AS level,
  size, {r6('share')} AS size_share FROM l""")
def d29_cluster_profile(spark, d):
    return round_doubles(DS.cluster_profile(load_table(spark, d, "lineitem"), "l_returnflag", D29_FEATS))


# ------------------------------------------------------------------ D31 / D32 / D33
def _leak_numeric_input(spark, d):
    li = load_table(spark, d, "lineitem")
    return li.select("l_quantity", "l_discount", F.col("l_extendedprice").alias("price_copy"),
                     (F.col("l_extendedprice") * 100 + 3).alias("price_cents"), F.col("l_extendedprice").alias("LExtended_Price"),
                     (F.col("l_extendedprice") + F.col("l_quantity")).alias("price_plus_qty"), "l_extendedprice")


LEAK_NUM_SQL = """SELECT 'price_copy' AS "column", 2 AS position, 'identical to target values' AS reason, '' AS detail
UNION ALL SELECT 'price_cents', 3, 'near-perfect correlation with target',
  'corr=' || printf('%.4f', (SELECT corr(l_extendedprice * 100 + 3, l_extendedprice) FROM lineitem))
UNION ALL SELECT 'LExtended_Price', 4, 'same semantic name as target', ''
UNION ALL SELECT 'price_plus_qty', 5, 'near-perfect correlation with target',
  'corr=' || printf('%.4f', (SELECT corr(l_extendedprice + l_quantity, l_extendedprice) FROM lineitem))
FROM (SELECT 1) WHERE (SELECT abs(corr(l_extendedprice + l_quantity, l_extendedprice)) FROM lineitem) >= 0.9999"""


@query("d31_leakage_numeric", LEAK_NUM_SQL)
def d31_leakage_numeric(spark, d):
    return leakage(_leak_numeric_input(spark, d), "l_extendedprice")


def _leak_class_input(spark, d):
    li = load_table(spark, d, "lineitem")
    code = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    return li.select("l_linestatus", "l_linenumber", code.alias("flag_code"), F.lower(F.col("l_returnflag")).alias("flag_lower"),
                     F.when(F.col("l_orderkey") % 1000 == 0, F.lit("X")).otherwise(F.col("l_returnflag")).alias("flag_noisy"),
                     "l_returnflag")


def _purity_sql(expr: str) -> str:
    return f"""(SELECT sum(k) * 1.0 / (SELECT count(*) FROM lineitem) FROM (SELECT max(k) AS k FROM (
  SELECT coalesce(CAST({expr} AS VARCHAR), '__NA__') AS v, l_returnflag, count(*) AS k FROM lineitem GROUP BY 1, 2) GROUP BY v))"""


NOISY = "CASE WHEN l_orderkey % 1000 = 0 THEN 'X' ELSE l_returnflag END"
LEAK_CLASS_SQL = f"""WITH p AS (SELECT {_purity_sql('l_linestatus')} AS p_ls, {_purity_sql("CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'N' THEN 2 ELSE 3 END")} AS p_code,
  {_purity_sql(NOISY)} AS p_noisy, {_purity_sql('l_linenumber')} AS p_ln)
SELECT 'l_linestatus' AS "column", 0 AS position, 'deterministic mapping to target' AS reason, 'purity=' || printf('%.3f', p_ls) AS detail FROM p WHERE p_ls >= 0.999
UNION ALL SELECT 'l_linenumber', 1, 'deterministic mapping to target', 'purity=' || printf('%.3f', p_ln) FROM p WHERE p_ln >= 0.999
UNION ALL SELECT 'flag_code', 2, 'deterministic mapping to target', 'purity=' || printf('%.3f', p_code) FROM p WHERE p_code >= 0.999
UNION ALL SELECT 'flag_lower', 3, 'identical to target values', ''
UNION ALL SELECT 'flag_noisy', 4, 'deterministic mapping to target', 'purity=' || printf('%.3f', p_noisy) FROM p WHERE p_noisy >= 0.999"""


@query("d33_leakage_mapping", LEAK_CLASS_SQL)
def d33_leakage_mapping(spark, d):
    return leakage(_leak_class_input(spark, d), "l_returnflag")


@query("d32_leakage_correlation", f"SELECT * FROM ({LEAK_NUM_SQL}) WHERE reason = 'near-perfect correlation with target'")
def d32_leakage_correlation(spark, d):
    return leakage(_leak_numeric_input(spark, d), "l_extendedprice").where(F.col("reason") == "near-perfect correlation with target")
