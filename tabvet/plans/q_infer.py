"""Registered C-series queries (column typing) with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.functions import rules as R
from tabvet.functions.core import round_doubles
from tabvet.operators import infer as C
from tabvet.plans.registry import query
from tabvet.plans.sqlgen import r6, union_all
from tabvet.sources.tables import load_table

EVENTS_COLS = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
               ("value", "double"), ("props", "string")]
CUSTOMER_COLS = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                 ("c_mktsegment", "string")]
NUMERIC = {"bigint", "int", "double", "smallint", "tinyint", "float"}


def _case(name_sql: str, patterns) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({name_sql}, '{p}') THEN '{lab}'" for lab, p in patterns) + " ELSE NULL END"


def _lookup_sql(key: str, mapping: dict, default: str = "NULL") -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else repr(float(v))
    return "CASE " + " ".join(f"WHEN {key} = '{k}' THEN {lit(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


def _facts(table: str, cols) -> str:
    parts = []
    for i, (c, t) in enumerate(cols):
        s = t == "string"
        num = t in NUMERIC
        parts.append(f"""SELECT '{c}' AS "column", {i} AS position, '{t}' AS dtype, {str(num).upper()} AS is_numeric, count(*) AS n_rows,
  count(DISTINCT {c}) AS nd, {f'CAST(min({c}) AS DOUBLE)' if num else 'NULL'} AS mn, {f'CAST(max({c}) AS DOUBLE)' if num else 'NULL'} AS mx,
  {f"bool_or(contains({c}, '@') AND contains({c}, '.'))" if s else 'NULL'} AS has_email,
  {f"bool_or(starts_with({c}, 'http') OR starts_with({c}, 'www.'))" if s else 'NULL'} AS has_url,
  {f"bool_or(regexp_matches({c}, '^[\\d\\-\\+\\(\\)\\s]{{7,}}$'))" if s else 'NULL'} AS has_phone FROM {table}""")
    return union_all(parts)


def _semantic_sql(table: str, cols) -> str:
    cmin = {k: v[0] for k, v in R.DOMAIN_CONSTRAINTS.items() if v[0] is not None}
    cmax = {k: v[1] for k, v in R.DOMAIN_CONSTRAINTS.items() if v[1] is not None}
    ctyp = {k: v[2] for k, v in R.DOMAIN_CONSTRAINTS.items()}
    dom_list = ", ".join(f"'{k}'" for k in R.DOMAIN_CONSTRAINTS)
    ratio = "CASE WHEN n_rows > 0 THEN nd * 1.0 / n_rows ELSE 0.0 END"
    num_type = (f"CASE WHEN nd = 2 THEN 'binary_numeric' WHEN {ratio} < 0.02 AND nd <= 10 THEN 'ordinal' "
                "WHEN mn >= 0 AND mx <= 1 THEN 'probability_or_ratio' WHEN mn >= 0 AND mx <= 100 THEN 'percentage_or_score' "
                "WHEN mn >= 0 THEN 'positive_numeric' ELSE 'numeric' END")
    num_conf = (f"CASE WHEN nd = 2 THEN 0.9 WHEN {ratio} < 0.02 AND nd <= 10 THEN 0.75 WHEN mn >= 0 AND mx <= 1 THEN 0.7 "
                "WHEN mn >= 0 AND mx <= 100 THEN 0.6 ELSE 0.5 END")
    str_type = ("CASE WHEN has_email THEN 'email' WHEN has_url THEN 'url' WHEN has_phone THEN 'phone' WHEN nd = 2 THEN 'binary_category' "
                "WHEN nd <= 10 THEN 'low_cardinality_category' WHEN nd <= 50 THEN 'category' "
                f"WHEN {ratio} > 0.9 THEN 'identifier_or_text' ELSE 'categorical' END")
    str_conf = (f"CASE WHEN has_email OR has_url THEN 0.9 WHEN has_phone THEN 0.7 WHEN nd = 2 THEN 0.85 WHEN nd <= 10 THEN 0.7 "
                f"WHEN nd <= 50 THEN 0.6 WHEN {ratio} > 0.9 THEN 0.6 ELSE 0.5 END")
    temporal = "(starts_with(dtype, 'timestamp') OR dtype = 'date')"
    fb_type = (f"CASE WHEN is_numeric THEN {num_type} WHEN dtype = 'string' THEN {str_type} WHEN {temporal} THEN 'datetime' "
               "WHEN dtype = 'boolean' THEN 'boolean' ELSE 'unknown' END")
    fb_conf = (f"CASE WHEN is_numeric THEN {num_conf} WHEN dtype = 'string' THEN {str_conf} WHEN {temporal} OR dtype = 'boolean' THEN 0.95 "
               "ELSE 0.0 END")
    return f"""WITH f AS ({_facts(table, cols)}),
g AS (SELECT *, {_case('"column"', R.SEMANTIC_PATTERNS)} AS bn, {fb_type} AS fb_type, {fb_conf} AS fb_conf FROM f),
h AS (SELECT *, bn IN ({dom_list}) AS has_dom, is_numeric AND bn IS NULL AND fb_type = 'positive_numeric' AS pos FROM g)
SELECT "column", position, coalesce(bn, fb_type) AS detected_type,
  CASE WHEN bn IS NOT NULL THEN {_lookup_sql('bn', R.CATEGORY_MAP, "'Feature'")} ELSE 'Unknown' END AS category,
  round(CAST(CASE WHEN bn IS NOT NULL THEN 0.85 ELSE fb_conf END AS DOUBLE), 6) AS confidence,
  CASE WHEN bn IS NOT NULL THEN 'column_name_pattern' ELSE 'heuristics' END AS inferred_from,
  CASE WHEN has_dom THEN bn END AS domain,
  CASE WHEN has_dom THEN CAST({_lookup_sql('bn', cmin)} AS DOUBLE) WHEN pos THEN 0.0 END AS constraint_min,
  CASE WHEN has_dom THEN CAST({_lookup_sql('bn', cmax)} AS DOUBLE) END AS constraint_max,
  CASE WHEN has_dom THEN {_lookup_sql('bn', ctyp)} WHEN pos THEN 'float' END AS constraint_type
FROM h"""


@query("c1_semantic_types", _semantic_sql("events", EVENTS_COLS))
def c1_semantic_types(spark, d):
    return round_doubles(C.semantic_types(load_table(spark, d, "events")))


@query("c1_semantic_types_customer", _semantic_sql("customer", CUSTOMER_COLS))
def c1_semantic_types_customer(spark, d):
    return round_doubles(C.semantic_types(load_table(spark, d, "customer")))


def _any_sql(frags) -> str:
    return "(" + " OR ".join(f"contains(lower(\"column\"), '{f}')" for f in frags) + ")"


def _categorize_sql(table: str, cols) -> str:
    return f"""WITH f AS ({_facts(table, cols)})
SELECT "column", position, CAST(nd AS BIGINT) AS n_distinct, CASE
  WHEN {_any_sql(R.ID_PATTERNS)} AND nd > n_rows * 0.9 THEN 'ID'
  WHEN {_any_sql(R.TARGET_PATTERNS)} AND nd <= 10 THEN 'TARGET'
  WHEN {_any_sql(R.TEMPORAL_PATTERNS)} OR starts_with(dtype, 'timestamp') OR dtype = 'date' THEN 'TEMPORAL'
  WHEN is_numeric AND (nd < n_rows * 0.05 OR nd <= 20) THEN 'CATEGORICAL'
  WHEN is_numeric THEN 'CONTINUOUS'
  WHEN nd < n_rows * 0.05 OR nd <= 50 THEN 'CATEGORICAL'
  WHEN nd > n_rows * 0.9 THEN 'ID' ELSE 'CATEGORICAL' END AS category FROM f"""


@query("c3_categorize_columns", _categorize_sql("events", EVENTS_COLS))
def c3_categorize_columns(spark, d):
    return C.categorize_columns(load_table(spark, d, "events"))


PAGE_TEXT_COLS = ["url"]


@query("c4_value_patterns", "SELECT 'url' AS \"column\", " + ", ".join(
    f"{r6(f'avg(CASE WHEN regexp_matches(url, {chr(39)}{p}{chr(39)}) THEN 1.0 ELSE 0.0 END)')} AS share_{n.lower()}" for n, p in R.VALUE_PATTERNS)
    + ", " + "CASE " + " ".join(f"WHEN avg(CASE WHEN regexp_matches(url, '{p}') THEN 1.0 ELSE 0.0 END) > 0.8 THEN '{n}'" for n, p in R.VALUE_PATTERNS)
    + " ELSE NULL END AS pattern_type FROM pages WHERE url IS NOT NULL")
def c4_value_patterns(spark, d):
    return round_doubles(C.value_patterns(load_table(spark, d, "pages"), ["url"]))


@query("c5_value_range_types", """SELECT "column", CASE
  WHEN mn >= 0 AND mx <= 120 AND contains(lower("column"), 'age') THEN 'AGE'
  WHEN bin THEN 'BINARY' WHEN mn >= 0 AND mx <= 100 THEN 'PERCENTAGE_VALUE'
  WHEN mn >= 1900 AND mx <= 2100 AND integral THEN 'YEAR' ELSE 'GENERIC' END AS value_type FROM (
  SELECT 'doc_id' AS "column", min(doc_id) AS mn, max(doc_id) AS mx, bool_and(doc_id IN (0, 1)) AS bin, TRUE AS integral FROM labels
  UNION ALL SELECT 'quality', min(quality), max(quality), bool_and(quality IN (0, 1)), TRUE FROM labels
  UNION ALL SELECT 'toxic', min(toxic), max(toxic), bool_and(toxic IN (0, 1)), TRUE FROM labels)""")
def c5_value_range_types(spark, d):
    return C.value_range_types(load_table(spark, d, "labels"))


def _domain_sql(cols: list[str]) -> str:
    names = " ".join(c.lower() for c in cols)
    rows = []
    for i, (dom, kws) in enumerate(R.DOMAIN_KEYWORDS):
        for k in kws:
            rows.append(f"('{dom}', '{k}', {i})")
    return f"""WITH kw(domain, keyword, ord) AS (VALUES {", ".join(rows)}),
h AS (SELECT domain, ord, keyword, contains('{names}', keyword) AS hit FROM kw),
s AS (SELECT domain, min(ord) AS ord, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS score,
      list_sort(list(keyword) FILTER (WHERE hit)) AS matched_keywords FROM h GROUP BY domain),
t AS (SELECT CASE WHEN score > 0 THEN domain ELSE 'GENERAL' END AS primary_domain,
      CASE WHEN score > 0 THEN least(score / 3.0, 1.0) ELSE 0.0 END AS confidence FROM s ORDER BY score DESC, ord LIMIT 1)
SELECT domain, score, coalesce(matched_keywords, []) AS matched_keywords, primary_domain, {r6('confidence')} AS confidence FROM s, t"""


@query("c6_domain_profile", _domain_sql([c for c, _ in CUSTOMER_COLS]))
def c6_domain_profile(spark, d):
    return round_doubles(C.domain_profile(load_table(spark, d, "customer")))


def _hint_sql(cols) -> str:
    case = "CASE " + " ".join(f"WHEN contains(lower(\"column\"), '{k}') THEN '{dom}'" for dom, kws in R.DOMAIN_KEYWORDS for k in kws) + " ELSE NULL END"
    vals = ", ".join(f"('{c}', {i})" for i, c in enumerate(cols))
    return f"SELECT \"column\", position, {case} AS domain_hint FROM (VALUES {vals}) v(\"column\", position)"


@query("c6_domain_hints", _hint_sql([c for c, _ in EVENTS_COLS]))
def c6_domain_hints(spark, d):
    return C.domain_hints(load_table(spark, d, "events"))


@query("c9_target_candidates", f"""WITH f AS ({_facts("orders", [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                                                                  ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")])})
SELECT "column", position, (CASE WHEN regexp_matches("column", '{R.TARGET_NAME_PATTERN}') THEN 50 ELSE 0 END
  + CASE WHEN nd = 2 THEN 30 WHEN nd > 2 AND nd <= 10 THEN 20 ELSE 0 END + CASE WHEN "column" = 'o_orderpriority' THEN 10 ELSE 0 END) AS score FROM f""")
def c9_target_candidates(spark, d):
    return C.target_candidates(load_table(spark, d, "orders"))


@query("c10_task_type", """SELECT 'o_orderstatus' AS target, count(DISTINCT o_orderstatus) AS n_distinct, 'classification' AS task_type FROM orders
UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice), CASE WHEN count(DISTINCT o_totalprice) <= 20 THEN 'classification' ELSE 'regression' END FROM orders""")
def c10_task_type(spark, d):
    o = load_table(spark, d, "orders")
    return C.task_type(o, "o_orderstatus").unionByName(C.task_type(o, "o_totalprice"))


@query("c11_sensitive_columns", f"""WITH f AS ({_facts("customer", CUSTOMER_COLS)})
SELECT "column", position, CAST(nd AS BIGINT) AS n_distinct, CASE
  WHEN nd <= 10 AND nd >= 2 AND {_case('"column"', R.SENSITIVE_PATTERNS)} IS NOT NULL THEN {_case('"column"', R.SENSITIVE_PATTERNS)}
  WHEN nd <= 10 AND nd >= 2 AND nd <= 5 THEN 'demographic' END AS sensitive_type
FROM f WHERE "column" <> 'c_acctbal' AND sensitive_type IS NOT NULL""")
def c11_sensitive_columns(spark, d):
    return C.sensitive_columns(load_table(spark, d, "customer"), target="c_acctbal")
