"""Deterministic inputs derived from the driver tables, defined identically for Spark and DuckDB.

The tables carry no nulls, predictions or reference/current splits, so the registered queries
derive them with integer arithmetic (no engine-specific hash or random function). Each Spark
builder below has a SQL twin (`*_SQL`) used inside the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.sources.tables import load_table

CUT = "1998-01-01"          # reference / current split on l_shipdate
EVENT_CUT = "2024-01-16"    # reference / current split on events.ts


def lineitem_nulls(spark: SparkSession, d: str) -> DataFrame:
    li = load_table(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(F.col("l_orderkey") % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        F.when(F.col("l_orderkey") % 11 == 0, F.lit(None).cast("double")).otherwise(F.col("l_discount")).alias("l_discount"),
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


LINEITEM_NULLS_SQL = """li AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
         l_extendedprice,
         CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_discount END AS l_discount,
         l_tax, l_returnflag, l_linestatus, l_shipdate
  FROM lineitem)"""

LI_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem_split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li = load_table(spark, d, "lineitem")
    cut = F.lit(CUT).cast("timestamp_ntz")
    return li.where(F.col("l_shipdate") < cut), li.where(F.col("l_shipdate") >= cut)


SPLIT_SQL = f"""ref AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUT}'),
cur AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '{CUT}')"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Binary predictions table: y_true = error event, p = P(class 1), model / group keys."""
    ev = load_table(spark, d, "events")
    u = (F.col("event_id") * 7919 % 1000).cast("double") / 1000.0
    y = F.when(F.col("event_type") == "error", 1).otherwise(0)
    p = F.when(y == 1, F.lit(0.3) + F.lit(0.7) * u).otherwise(F.lit(0.7) * u)
    return ev.select(
        "event_id", "ts",
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.concat(F.lit("g"), (F.col("user_id") % 4).cast("string")).alias("grp"),
        y.alias("y_true"), p.alias("p"),
    ).withColumn("y_pred", F.when(F.col("p") >= 0.5, 1).otherwise(0))


PRED_SQL = """pred0 AS (
  SELECT event_id, ts, 'm' || CAST(user_id % 3 AS VARCHAR) AS model, 'g' || CAST(user_id % 4 AS VARCHAR) AS grp,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y_true,
         CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000.0 AS u
  FROM events),
pred AS (
  SELECT event_id, ts, model, grp, y_true, p, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS y_pred
  FROM (SELECT *, CASE WHEN y_true = 1 THEN 0.3 + 0.7 * u ELSE 0.7 * u END AS p FROM pred0))"""


def multiclass_predictions(spark: SparkSession, d: str) -> DataFrame:
    ev = load_table(spark, d, "events")
    rot = (F.when(F.col("event_type") == "click", "view").when(F.col("event_type") == "view", "purchase")
           .when(F.col("event_type") == "purchase", "signup").when(F.col("event_type") == "signup", "error")
           .otherwise("click"))
    yp = F.when(F.col("event_id") % 5 == 0, rot).when(F.col("event_id") % 7 == 0, F.lit("click")).otherwise(F.col("event_type"))
    return ev.select("event_id", F.col("event_type").alias("y_true"), yp.alias("y_pred"))


MPRED_SQL = """mpred AS (
  SELECT event_id, event_type AS y_true,
         CASE WHEN event_id % 5 = 0 THEN
                CASE event_type WHEN 'click' THEN 'view' WHEN 'view' THEN 'purchase' WHEN 'purchase' THEN 'signup'
                                WHEN 'signup' THEN 'error' ELSE 'click' END
              WHEN event_id % 7 = 0 THEN 'click' ELSE event_type END AS y_pred
  FROM events)"""
