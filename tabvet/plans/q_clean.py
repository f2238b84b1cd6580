"""Registered E-series queries (imputation, anomaly labels, outlier drivers) with DuckDB oracles
where the operator is expressible in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.functions.core import round_doubles
from tabvet.operators import clean as E
from tabvet.plans.fixtures import LI_MEASURES, LINEITEM_NULLS_SQL, lineitem_nulls
from tabvet.plans.registry import query
from tabvet.plans.sqlgen import r6, union_all, with_
from tabvet.sources.tables import load_table

LI_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
          "l_returnflag", "l_linestatus", "l_shipdate"]


def _impute_sql(stat: str) -> str:
    sel = []
    for c in LI_ALL:
        if c in LI_MEASURES:
            fill = "0.0" if stat == "constant" else f"(SELECT {stat}({c}) FROM li)"
            sel.append(f"{r6(f'coalesce({c}, {fill})')} AS {c}")
        else:
            sel.append(c)
    return with_([LINEITEM_NULLS_SQL], f"SELECT {', '.join(sel)} FROM li")


@query("e1_impute_median", _impute_sql("median"))
def e1_impute_median(spark, d):
    return round_doubles(E.impute(lineitem_nulls(spark, d), "median", LI_MEASURES))


@query("e1_impute_mean", _impute_sql("avg"))
def e1_impute_mean(spark, d):
    return round_doubles(E.impute(lineitem_nulls(spark, d), "mean", LI_MEASURES))


@query("e1_impute_constant", _impute_sql("constant"))
def e1_impute_constant(spark, d):
    return round_doubles(E.impute(lineitem_nulls(spark, d), "constant", LI_MEASURES))


# ------------------------------------------------------------------ E2
def _cat_nulls(spark, d):
    li = load_table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     F.when(F.col("l_orderkey") % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
                     F.when(F.col("l_orderkey") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("l_linestatus")).alias("l_linestatus"))


CAT_NULLS_SQL = """c AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
  CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_linestatus END AS l_linestatus FROM lineitem)"""


def _mode_sql(c: str) -> str:
    return f"(SELECT {c} FROM c WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("e2_impute_mode", with_([CAT_NULLS_SQL], f"""SELECT l_orderkey, l_linenumber,
  coalesce(l_returnflag, {_mode_sql('l_returnflag')}) AS l_returnflag,
  coalesce(l_linestatus, {_mode_sql('l_linestatus')}) AS l_linestatus FROM c"""))
def e2_impute_mode(spark, d):
    return E.impute_mode(_cat_nulls(spark, d), ["l_returnflag", "l_linestatus"])


# ------------------------------------------------------------------ E5
@query("e5_imputation_report", with_([LINEITEM_NULLS_SQL], union_all([
    f"""SELECT '{c}' AS "column", CAST(count(*) - count({c}) AS BIGINT) AS missing_before, CAST(0 AS BIGINT) AS missing_after,
  CAST(count(*) - count({c}) AS BIGINT) AS imputed FROM li HAVING count(*) - count({c}) > 0""" for c in LI_ALL])))
def e5_imputation_report(spark, d):
    before = lineitem_nulls(spark, d)
    return E.imputation_report(before, E.impute(before, "median", LI_MEASURES))


# ------------------------------------------------------------------ E3 (R)
@query("e3_impute_iterative")
def e3_impute_iterative(spark, d):
    df = lineitem_nulls(spark, d).select("l_orderkey", "l_linenumber", *LI_MEASURES)
    return round_doubles(E.impute_iterative(df, LI_MEASURES, max_iter=10))


# ------------------------------------------------------------------ E6 / E9 (R)
def _forest(spark, d, contamination=0.1):
    df = load_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *LI_MEASURES)
    return E.isolation_forest(df, LI_MEASURES, contamination=contamination, key=["l_orderkey", "l_linenumber"])


@query("e6_isolation_forest")
def e6_isolation_forest(spark, d):
    return round_doubles(_forest(spark, d))


@query("e6_anomaly_report")
def e6_anomaly_report(spark, d):
    return round_doubles(E.anomaly_report(_forest(spark, d)))


@query("e9_vulnerability")
def e9_vulnerability(spark, d):
    return round_doubles(E.vulnerability(_forest(spark, d, contamination=0.05)))


# ------------------------------------------------------------------ E7 / E8
E7_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _drivers_sql() -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in E7_COLS)
    parts = [f"""SELECT '{c}' AS "column", avg(abs((coalesce({c}, m_{c}) - m_{c}) / s_{c})) AS z, max(s_{c}) AS s
FROM li, st WHERE l_quantity >= 48""" for c in E7_COLS]
    return with_([LINEITEM_NULLS_SQL, f"st AS (SELECT {stats} FROM li)", f"z AS ({union_all(parts)})"],
                 f"""SELECT "column", {r6('z')} AS mean_abs_z, CAST(row_number() OVER (ORDER BY z DESC, "column") AS INTEGER) AS rank
FROM z WHERE s > 0""")


@query("e7_outlier_drivers", _drivers_sql())
def e7_outlier_drivers(spark, d):
    df = lineitem_nulls(spark, d).withColumn("_flag", F.col("l_quantity") >= 48)
    return round_doubles(E.outlier_drivers(df, "_flag", E7_COLS))


@query("e8_top_anomalies", """SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 10""")
def e8_top_anomalies(spark, d):
    ev = load_table(spark, d, "events").select("event_id", "user_id", "value")
    return E.top_anomalies(ev, "value", 10, tie=["event_id"])
