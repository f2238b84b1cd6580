"""Registered B-series queries (selection, flags, row validation, filters, gate, sampling) with
their DuckDB oracles."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tabvet.functions import rules as R
from tabvet.functions.core import round_doubles
from tabvet.operators import infer as C
from tabvet.operators import validate as B
from tabvet.plans.q_infer import _categorize_sql
from tabvet.plans.registry import query
from tabvet.plans.sqlgen import r6
from tabvet.sources.tables import load_table

# ------------------------------------------------------------------ B1
LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("b1_select_numeric", f"SELECT {', '.join(c for c in LI_NUM if c != 'l_orderkey')} FROM lineitem")
def b1_select_numeric(spark, d):
    return B.select_numeric(load_table(spark, d, "lineitem"), exclude=["l_orderkey"])


@query("b1_select_categorical", "SELECT o_orderstatus, o_orderpriority FROM orders")
def b1_select_categorical(spark, d):
    return B.select_categorical(load_table(spark, d, "orders"))


# ------------------------------------------------------------------ B2
ORDERS_X = """(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
   1 AS const_col, CAST(NULL AS DOUBLE) AS empty_col FROM orders)"""
ORDERS_X_COLS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
                 ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"), ("const_col", "int"), ("empty_col", "double")]


def _orders_x(spark, d):
    return load_table(spark, d, "orders").withColumns({"const_col": F.lit(1), "empty_col": F.lit(None).cast("double")})


FLAGS_SQL = f"""WITH c AS ({_categorize_sql(ORDERS_X, ORDERS_X_COLS)})
SELECT "column", position, 'ALL_NULL' AS flag FROM c WHERE n_distinct = 0
UNION ALL SELECT "column", position, 'CONSTANT' AS flag FROM c WHERE n_distinct = 1
UNION ALL SELECT "column", position, 'ID' AS flag FROM c WHERE category = 'ID'"""


@query("b2_column_flags", FLAGS_SQL)
def b2_column_flags(spark, d):
    return B.column_flags(_orders_x(spark, d))


@query("b2_drop_flagged", f"""WITH x AS {ORDERS_X}
SELECT o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM x""")
def b2_drop_flagged(spark, d):
    df = _orders_x(spark, d)
    return B.drop_flagged(df, B.column_flags(df))


# ------------------------------------------------------------------ B3 / B4 / B5
# Validation fixture: key columns plus three constrained columns whose names hit domain rules.
VAL_KEYS = ["l_orderkey", "l_linenumber"]
VAL_COLS = ["quantity", "age", "fill_ratio"]


def _val_input(spark, d):
    li = load_table(spark, d, "lineitem")
    return li.select(
        *VAL_KEYS,
        (F.col("l_quantity") + F.col("l_discount")).alias("quantity"),
        F.when(F.col("l_orderkey") % 13 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("l_quantity") * 4 - 20).alias("age"),
        (F.round(F.col("l_discount") * 100) * 15 - 5).alias("fill_ratio"))


VAL_SQL = """v AS (SELECT l_orderkey, l_linenumber, l_quantity + l_discount AS quantity,
  CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_quantity * 4 - 20 END AS age,
  round(l_discount * 100) * 15 - 5 AS fill_ratio FROM lineitem)"""


def _constraint(name: str):
    """Domain constraint of a column name, found with Python's `re` (independent of the Spark rules)."""
    for label, pat in R.SEMANTIC_PATTERNS:
        if re.search(pat, name):
            return R.DOMAIN_CONSTRAINTS.get(label)
    return None


def _checks_sql(name: str) -> list[tuple[str, str]]:
    lo, hi, typ = _constraint(name)
    out = []
    if typ == "int":
        out.append((f"{name} IS NOT NULL AND {name} <> floor({name})", f"'{name}: Expected integer, got float'"))
    if lo is not None:
        out.append((f"{name} < {float(lo)}", f"'{name}: Value ' || CAST({name} AS VARCHAR) || ' below minimum {B._fmt_bound(lo)}'"))
    if hi is not None:
        out.append((f"{name} > {float(hi)}", f"'{name}: Value ' || CAST({name} AS VARCHAR) || ' above maximum {B._fmt_bound(hi)}'"))
    return out


def _validate_sql() -> str:
    checks = [c for n in VAL_COLS for c in _checks_sql(n)]
    arr = "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN {msg} END" for cond, msg in checks) + "], lambda x: x IS NOT NULL)"
    return f"""WITH {VAL_SQL}, e AS (SELECT l_orderkey, l_linenumber, {arr} AS errors FROM v)
SELECT l_orderkey, l_linenumber, CASE WHEN len(errors) > 0 THEN 'INVALID' ELSE 'VALID' END AS status,
  CASE WHEN len(errors) > 0 THEN array_to_string(errors[1:3], '; ') ELSE '-' END AS error_text,
  CAST(len(errors) AS INTEGER) AS n_errors, errors FROM e"""


def _validated(spark, d):
    df = _val_input(spark, d)
    cons = C.semantic_types(df.select(*VAL_COLS))
    return B.validate_rows(df, cons, keys=VAL_KEYS)


@query("b3_infer_row_schema")
def b3_infer_row_schema(spark, d):
    df = _val_input(spark, d)
    return B.infer_row_schema(df, C.semantic_types(df))


@query("b4_validate_rows", _validate_sql())
def b4_validate_rows(spark, d):
    return _validated(spark, d)


@query("b4_validation_report", f"""WITH r AS ({_validate_sql()})
SELECT count(*) AS n_rows, CAST(sum(CASE WHEN status = 'VALID' THEN 1 ELSE 0 END) AS BIGINT) AS n_valid,
  CAST(sum(CASE WHEN status = 'INVALID' THEN 1 ELSE 0 END) AS BIGINT) AS n_invalid,
  {r6("sum(CASE WHEN status = 'VALID' THEN 1 ELSE 0 END) * 100.0 / count(*)")} AS valid_pct,
  {r6("sum(CASE WHEN status = 'INVALID' THEN 1 ELSE 0 END) * 100.0 / count(*)")} AS invalid_pct FROM r""")
def b4_validation_report(spark, d):
    return round_doubles(B.validation_report(_validated(spark, d)))


def _violations_sql() -> str:
    parts = []
    for n in VAL_COLS:
        s = " + ".join(f"CASE WHEN {cond} THEN 1 ELSE 0 END" for cond, _ in _checks_sql(n))
        parts.append(f"SELECT '{n}' AS \"column\", CAST(sum({s}) AS BIGINT) AS n_violations FROM v")
    return f"""WITH {VAL_SQL}, c AS ({' UNION ALL '.join(parts)})
SELECT "column", n_violations FROM c WHERE n_violations > 0 ORDER BY n_violations DESC, "column" LIMIT 5"""


@query("b5_violation_summary", _violations_sql())
def b5_violation_summary(spark, d):
    return B.violation_summary(_validated(spark, d))


# ------------------------------------------------------------------ B6 / B7
@query("b6_filter_metadata", "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND source = 'src7'")
def b6_filter_metadata(spark, d):
    docs = load_table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return B.filter_metadata(docs, {"lang": "en", "source": "src7"})


@query("b6_filter_metadata_map", """SELECT doc_id, n_chars FROM documents WHERE lang = 'de' AND source = 'src3'""")
def b6_filter_metadata_map(spark, d):
    docs = load_table(spark, d, "documents").select(
        "doc_id", "n_chars", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"))
    return B.filter_metadata(docs, {"lang": "de", "source": "src3"}, metadata_col="metadata").select("doc_id", "n_chars")


ASOF = "2024-01-30 12:00:00"


@query("b7_recent", f"""SELECT event_id, ts, user_id, event_type, value FROM events
WHERE ts > TIMESTAMP '{ASOF}' - INTERVAL 36 HOUR AND event_type = 'error'""")
def b7_recent(spark, d):
    ev = load_table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return B.recent(ev, ASOF, hours=36, severity="error", severity_col="event_type")


# ------------------------------------------------------------------ B9
@query("b9_review_gate", f"""SELECT count(*) AS n_rows, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_flagged,
  {r6("sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) * 1.0 / count(*)")} AS flagged_share,
  sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) * 1.0 / count(*) > 0.2 AS requires_review FROM events""")
def b9_review_gate(spark, d):
    ev = load_table(spark, d, "events").select((F.col("event_type") == "error").alias("is_anomaly"))
    return round_doubles(B.review_gate(ev, "is_anomaly", threshold=0.2))


# ------------------------------------------------------------------ B10
@query("b10_stratified_sample", """WITH o AS (SELECT event_id, user_id, event_type, value, (event_id * 7919) % 10007 AS o FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY o, event_id, user_id, value) AS rn,
             count(*) OVER (PARTITION BY event_type) AS n FROM o)
SELECT event_id, user_id, event_type, value FROM r WHERE rn <= round(n * 0.1)""")
def b10_stratified_sample(spark, d):
    ev = load_table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return B.stratified_sample(ev, ["event_type"], 0.1, order=(F.col("event_id") * 7919) % 10007)
