"""Registered D-series queries (profiling) with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.functions.core import round_doubles
from tabvet.operators import profile as P
from tabvet.plans.fixtures import LI_MEASURES, LINEITEM_NULLS_SQL, lineitem_nulls
from tabvet.plans.registry import query
from tabvet.plans.sqlgen import r6, union_all, with_
from tabvet.sources.tables import load_table

# Column layout of the lineitem fixture: (name, spark dtype, numeric?)
LI_COLS = [("l_orderkey", "bigint", True), ("l_partkey", "bigint", True), ("l_suppkey", "bigint", True),
           ("l_linenumber", "int", True), ("l_quantity", "double", True), ("l_extendedprice", "double", True),
           ("l_discount", "double", True), ("l_tax", "double", True), ("l_returnflag", "string", False),
           ("l_linestatus", "string", False), ("l_shipdate", "timestamp_ntz", False)]
SK = {"skew": 4, "kurt": 4}


# ------------------------------------------------------------------ D1
def _d1_sql() -> str:
    parts = []
    for i, (c, t, num) in enumerate(LI_COLS):
        def s(expr, d=6):
            return r6(expr, d) if num else "CAST(NULL AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS "column", '{t}' AS dtype, {i} AS position, count(*) AS n_rows,
  CAST(count(*) - count({c}) AS BIGINT) AS n_null,
  {r6(f"(count(*) - count({c})) * 100.0 / count(*)")} AS null_pct,
  CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct,
  {r6(f"count(DISTINCT {c}) * 100.0 / count(*)")} AS distinct_pct,
  count(DISTINCT {c}) <= 1 AS is_constant,
  {s(f"min({c})")} AS min, {s(f"max({c})")} AS max, {s(f"avg({c})")} AS mean, {s(f"stddev_samp({c})")} AS std,
  {s(f"skewness({c})", 4)} AS skew, {s(f"kurtosis({c})", 4)} AS kurt, {s(f"quantile_cont({c}, 0.5)")} AS median
FROM li""")
    return with_([LINEITEM_NULLS_SQL], union_all(parts))


@query("d1_profile_columns", _d1_sql())
def d1_profile_columns(spark, d):
    return round_doubles(P.profile_columns(lineitem_nulls(spark, d)), 6, SK)


# ------------------------------------------------------------------ D3
def _d3_sql() -> str:
    parts = [f"""SELECT '{c}' AS "column", CAST(count(*) - count({c}) AS BIGINT) AS n_null,
  {r6(f"(count(*) - count({c})) * 100.0 / count(*)")} AS missing_pct, (count(*) - count({c})) > count(*) * 0.5 AS high_missing
FROM li""" for c, _, _ in LI_COLS]
    return with_([LINEITEM_NULLS_SQL], union_all(parts))


@query("d3_missing_summary", _d3_sql())
def d3_missing_summary(spark, d):
    return round_doubles(P.missing_summary(lineitem_nulls(spark, d)))


@query("d3_missing_totals", with_([LINEITEM_NULLS_SQL], f"""SELECT CAST(sum(nn) AS BIGINT) AS total_missing,
  {r6("sum(nn) * 100.0 / (max(n) * 11)")} AS missing_pct, CAST(sum(CASE WHEN nn > n * 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_high_missing
FROM ({union_all([f"SELECT count(*) - count({c}) AS nn, count(*) AS n FROM li" for c, _, _ in LI_COLS])})"""))
def d3_missing_totals(spark, d):
    return round_doubles(P.missing_totals(lineitem_nulls(spark, d)))


# ------------------------------------------------------------------ D4 / D5
DUP_COLS = [c for c, _, _ in LI_COLS]
DUP_SQL = "dup AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 10 = 0)"


def with_copies(spark, d):
    """The whole table and a second copy of the rows of every tenth order."""
    li = load_table(spark, d, "lineitem")
    return li.unionByName(li.where(F.col("l_orderkey") % 10 == 0))


@query("d4_duplicate_rows", with_([DUP_SQL], f"""SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicates,
  {r6("sum(n - 1) * 100.0 / sum(n)")} AS duplicate_pct
FROM (SELECT count(*) AS n FROM dup GROUP BY {", ".join(DUP_COLS)})"""))
def d4_duplicate_rows(spark, d):
    return round_doubles(P.duplicate_rows(with_copies(spark, d)))


@query("d5_drop_duplicates", with_([DUP_SQL], f"SELECT DISTINCT {', '.join(DUP_COLS)} FROM dup"))
def d5_drop_duplicates(spark, d):
    return P.drop_duplicates(with_copies(spark, d).select(*DUP_COLS))


# ------------------------------------------------------------------ D6 / D7
TOP_COLS = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax"]


@query("d6_top_values", f"""SELECT "column", value, n, rank FROM (
  SELECT "column", value, n, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value ASC) AS INTEGER) AS rank
  FROM ({union_all([f"SELECT '{c}' AS " + '"column"' + f", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 2" for c in TOP_COLS])}))
WHERE rank <= 10""")
def d6_top_values(spark, d):
    return P.top_values(load_table(spark, d, "lineitem"), TOP_COLS, 10)


@query("d7_class_distribution", f"""SELECT l_returnflag AS class, count(*) AS n, {r6("count(*) * 1.0 / sum(count(*)) OVER ()")} AS share
FROM lineitem GROUP BY l_returnflag""")
def d7_class_distribution(spark, d):
    return round_doubles(P.class_distribution(load_table(spark, d, "lineitem"), "l_returnflag"))


# ------------------------------------------------------------------ D8 / D9 / D12
def _d8_sql() -> str:
    parts = []
    for c in LI_MEASURES:
        parts.append(f"""SELECT '{c}' AS "column", q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper,
  (SELECT CAST(count(*) AS BIGINT) FROM li WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers,
  (SELECT count({c}) FROM li) AS n
FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM li)""")
    body = f"""SELECT "column", {r6("q1")} AS q1, {r6("q3")} AS q3, {r6("lower")} AS lower, {r6("upper")} AS upper, n_outliers,
  {r6("n_outliers * 100.0 / n")} AS outlier_pct FROM ({union_all(parts)})"""
    return with_([LINEITEM_NULLS_SQL], body)


@query("d8_iqr_outliers", _d8_sql())
def d8_iqr_outliers(spark, d):
    return round_doubles(P.iqr_outliers(lineitem_nulls(spark, d), LI_MEASURES))


@query("d9_skew_summary", with_([LINEITEM_NULLS_SQL], union_all(
    [f"""SELECT '{c}' AS "column", {r6(f"skewness({c})", 4)} AS skewness FROM li""" for c in LI_MEASURES])))
def d9_skew_summary(spark, d):
    return round_doubles(P.skew_summary(lineitem_nulls(spark, d), LI_MEASURES), 4)


@query("d12_box_stats", with_([LINEITEM_NULLS_SQL], union_all(
    [f"""SELECT '{c}' AS "column", {r6(f"quantile_cont({c}, 0.0)")} AS min, {r6(f"quantile_cont({c}, 0.25)")} AS q1,
  {r6(f"quantile_cont({c}, 0.5)")} AS median, {r6(f"quantile_cont({c}, 0.75)")} AS q3, {r6(f"quantile_cont({c}, 1.0)")} AS max FROM li"""
     for c in LI_MEASURES])))
def d12_box_stats(spark, d):
    return round_doubles(P.box_stats(lineitem_nulls(spark, d), LI_MEASURES))


# ------------------------------------------------------------------ D10 / D11
def _d10_sql(bins: int = 20) -> str:
    parts = []
    for c in LI_MEASURES:
        parts.append(f"""SELECT '{c}' AS "column", b.bin, m.lo, m.hi, m.n,
  (SELECT count(*) FROM li WHERE {c} IS NOT NULL AND
     (CASE WHEN m.hi = m.lo THEN 0 WHEN {c} = m.hi THEN {bins - 1}
           ELSE least(CAST(floor(({c} - m.lo) / ((m.hi - m.lo) / {bins})) AS INTEGER), {bins - 1}) END) = b.bin) AS cnt
FROM (SELECT min({c}) AS lo, max({c}) AS hi, count({c}) AS n FROM li) m, (SELECT CAST(range AS INTEGER) AS bin FROM range(0, {bins})) b""")
    body = f"""SELECT "column", bin, {r6(f"lo + bin * ((hi - lo) / {bins})")} AS bin_start,
  {r6(f"CASE WHEN bin = {bins - 1} THEN hi ELSE lo + (bin + 1) * ((hi - lo) / {bins}) END")} AS bin_end,
  CAST(cnt AS BIGINT) AS count, {r6("cnt * 1.0 / n")} AS share FROM ({union_all(parts)})"""
    return with_([LINEITEM_NULLS_SQL], body)


@query("d10_histogram", _d10_sql())
def d10_histogram(spark, d):
    return round_doubles(P.histogram(lineitem_nulls(spark, d), LI_MEASURES, 20))


@query("d11_histogram_by", """WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT l_returnflag AS class,
  CASE WHEN hi = lo THEN 0 WHEN l_extendedprice = hi THEN 9
       ELSE least(CAST(floor((l_extendedprice - lo) / ((hi - lo) / 10)) AS INTEGER), 9) END AS bin,
  count(*) AS count
FROM lineitem, m GROUP BY 1, 2""")
def d11_histogram_by(spark, d):
    return P.histogram_by(load_table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag", 10)


# ------------------------------------------------------------------ D13-D16
CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_net"]
CORR_SQL = LINEITEM_NULLS_SQL.replace("li AS (", "li0 AS (") + ",\nli AS (SELECT *, l_extendedprice * (1 - l_discount) AS l_net FROM li0)"


def corr_input(spark, d):
    li = lineitem_nulls(spark, d)
    return li.withColumn("l_net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
_PAIRS = P.correlation_pairs(CORR_COLS)
_CORR_LONG = union_all([f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM li" for a, b in _PAIRS])


@query("d13_correlation_matrix", with_([CORR_SQL], f"SELECT a, b, {r6('r')} AS r FROM ({_CORR_LONG})"))
def d13_correlation_matrix(spark, d):
    return round_doubles(P.correlation_matrix(corr_input(spark, d), CORR_COLS))


@query("d14_correlation_hypotheses", with_([CORR_SQL], f"""SELECT a, b, {r6('r')} AS r,
  CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate' ELSE 'weak' END AS strength,
  CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction,
  CASE WHEN abs(r) >= 0.7 THEN 'high' WHEN abs(r) >= 0.5 THEN 'medium' ELSE 'low' END AS priority
FROM ({_CORR_LONG}) WHERE abs(r) >= 0.3 ORDER BY abs(r) DESC, a, b LIMIT 20"""))
def d14_correlation_hypotheses(spark, d):
    return round_doubles(P.correlation_hypotheses(corr_input(spark, d), CORR_COLS))


@query("d15_target_correlations", with_([CORR_SQL], f"""SELECT feature, {r6('r')} AS r,
  CASE WHEN abs(r) >= 0.5 THEN 'High' WHEN abs(r) >= 0.3 THEN 'Medium' ELSE 'Low' END AS strength
FROM ({union_all([f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS r FROM li" for c in CORR_COLS if c != 'l_extendedprice'])})
WHERE abs(r) >= 0.2"""))
def d15_target_correlations(spark, d):
    return round_doubles(P.target_correlations(corr_input(spark, d), "l_extendedprice", CORR_COLS))


@query("d16_mean_abs_correlation", with_([CORR_SQL], f"SELECT {r6('avg(abs(r))')} AS mean_abs_corr FROM ({_CORR_LONG})"))
def d16_mean_abs_correlation(spark, d):
    return round_doubles(P.mean_abs_correlation(corr_input(spark, d), CORR_COLS))


# ------------------------------------------------------------------ D17 / D18 / D30
def _col_facts_sql() -> str:
    return union_all([f"""SELECT '{c}' AS c, {'TRUE' if t == 'string' else 'FALSE'} AS is_str, count(*) AS n,
  count(*) - count({c}) AS nn, count(DISTINCT {c}) AS nd FROM li""" for c, t, _ in LI_COLS])


def _d17_sql() -> str:
    facts = _col_facts_sql()
    body = f""", f AS ({facts}),
g AS (SELECT max(n) AS n_rows, sum(nn) AS total_missing,
        sum(CASE WHEN nn = n THEN 1 ELSE 0 END) AS n_all_null, sum(CASE WHEN nd <= 1 THEN 1 ELSE 0 END) AS n_constant,
        sum(CASE WHEN is_str AND nd > n * 0.95 THEN 1 ELSE 0 END) AS n_high_card,
        sum(CASE WHEN nn > n * 0.5 THEN 1 ELSE 0 END) AS n_high_missing FROM f),
dup AS (SELECT sum(k - 1) AS n_duplicates FROM (SELECT count(*) AS k FROM li GROUP BY ALL_COLS)),
s AS (SELECT *, CASE WHEN n_all_null > 0 THEN 1 ELSE 0 END AS critical,
        (CASE WHEN n_constant > 0 THEN 1 ELSE 0 END) + (CASE WHEN n_high_card > 0 THEN 1 ELSE 0 END)
        + (CASE WHEN n_duplicates > 0 THEN 1 ELSE 0 END) + (CASE WHEN n_high_missing > 0 THEN 1 ELSE 0 END) AS warnings,
        total_missing * 100.0 / (n_rows * 11) AS mp FROM g, dup),
t AS (SELECT *, greatest(0.0, least(100.0, 100.0 - critical * 20 - warnings * 5 - least(mp, 30.0))) AS score FROM s)
SELECT CAST(n_rows AS BIGINT) AS n_rows, CAST(11 AS BIGINT) AS n_columns, CAST(total_missing AS BIGINT) AS total_missing,
  {r6("mp")} AS missing_pct, CAST(n_duplicates AS BIGINT) AS n_duplicates, CAST(critical AS BIGINT) AS critical_issues,
  CAST(warnings AS BIGINT) AS warnings, {r6("score")} AS score,
  CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade
FROM t"""
    return "WITH " + LINEITEM_NULLS_SQL + body.replace("ALL_COLS", ", ".join(c for c, _, _ in LI_COLS))


@query("d17_quality_report", _d17_sql())
def d17_quality_report(spark, d):
    return round_doubles(P.quality_report(lineitem_nulls(spark, d)))


def _d18_sql() -> str:
    cols = ", ".join(c for c, _, _ in LI_COLS)
    return with_([LINEITEM_NULLS_SQL, f"f AS ({_col_facts_sql()})",
                  f"m AS (SELECT sum(nn) * 100.0 / (max(n) * 11) AS missing_pct FROM f)",
                  f"dp AS (SELECT sum(k - 1) * 100.0 / sum(k) AS duplicate_pct FROM (SELECT count(*) AS k FROM li GROUP BY {cols}))",
                  "s AS (SELECT missing_pct, duplicate_pct, greatest(0.0, 100.0 - 0.5 * missing_pct - 0.5 * duplicate_pct) AS score FROM m, dp)"],
                 f"""SELECT {r6("missing_pct")} AS missing_pct, {r6("duplicate_pct")} AS duplicate_pct, {r6("score")} AS score,
  CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 80 THEN 'good' WHEN score >= 70 THEN 'fair' ELSE 'poor' END AS level FROM s""")


@query("d18_quality_score_linear", _d18_sql())
def d18_quality_score_linear(spark, d):
    return round_doubles(P.quality_score_linear(lineitem_nulls(spark, d)))


@query("d30_overview", with_([LINEITEM_NULLS_SQL, f"f AS ({_col_facts_sql()})"],
                             f"""SELECT max(n) AS n_rows, CAST(11 AS BIGINT) AS n_columns, {r6("sum(nn) * 100.0 / (max(n) * 11)")} AS missing_pct,
  CAST(8 AS BIGINT) AS n_numeric FROM f"""))
def d30_overview(spark, d):
    return round_doubles(P.overview(lineitem_nulls(spark, d)))


# ------------------------------------------------------------------ D24 / D25
_D24_NUM = ["l_orderkey", "l_extendedprice", "l_discount", "l_tax"]


@query("d24_missingness_bias", f"""WITH m AS (SELECT l_orderkey, l_extendedprice, l_discount, l_tax, l_linestatus,
  CASE WHEN l_extendedprice > 50000 THEN 'big' ELSE 'small' END AS price_class,
  CASE WHEN l_extendedprice > 50000 THEN NULL ELSE l_quantity END AS q_mnar FROM lineitem),
num AS ({union_all([f"SELECT '{c}' AS other_col, corr(CASE WHEN q_mnar IS NULL THEN 1.0 ELSE 0.0 END, {c}) AS effect, count({c}) AS n FROM m" for c in _D24_NUM])}),
lng AS (SELECT q_mnar IS NULL AS a, 'l_linestatus' AS other_col, l_linestatus AS b FROM m UNION ALL SELECT q_mnar IS NULL, 'price_class', price_class FROM m),
o AS (SELECT other_col, a, b, count(*) AS o FROM lng GROUP BY ALL), ra AS (SELECT other_col, a, sum(o) AS ra FROM o GROUP BY ALL),
cb AS (SELECT other_col, b, sum(o) AS cb FROM o GROUP BY ALL), n AS (SELECT other_col, sum(o) AS n FROM o GROUP BY ALL),
x AS (SELECT ra.other_col, n.n, coalesce(o.o, 0) AS o, ra.ra * 1.0 * cb.cb / n.n AS e FROM ra JOIN cb USING (other_col) JOIN n USING (other_col)
      LEFT JOIN o ON o.other_col = ra.other_col AND o.a = ra.a AND o.b = cb.b),
cat AS (SELECT other_col, sqrt(sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e) / max(n)) AS effect, max(n) AS n FROM x GROUP BY other_col),
al AS (SELECT other_col, effect, n, 'numeric' AS kind FROM num UNION ALL SELECT other_col, effect, n, 'categorical' FROM cat)
SELECT 'q_mnar' AS missing_col, other_col, {r6("effect")} AS effect, CAST(n AS BIGINT) AS n, kind,
  CASE WHEN abs(effect) > 0.5 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM al WHERE abs(effect) > 0.3""")
def d24_missingness_bias(spark, d):
    """All effects above 0.3 have p near 0 at these row counts; p itself is value-tested in tests/."""
    li = load_table(spark, d, "lineitem").select(
        *_D24_NUM, "l_linestatus", F.when(F.col("l_extendedprice") > 50000, "big").otherwise("small").alias("price_class"),
        F.when(F.col("l_extendedprice") > 50000, F.lit(None).cast("double")).otherwise(F.col("l_quantity")).alias("q_mnar"))
    return round_doubles(P.missingness_bias(li).drop("p_value"))


@query("d25_crosstab", f"""WITH o AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2),
ga AS (SELECT DISTINCT a FROM o), gb AS (SELECT DISTINCT b FROM o),
ra AS (SELECT a, sum(o) AS ra FROM o GROUP BY a), cb AS (SELECT b, sum(o) AS cb FROM o GROUP BY b),
n AS (SELECT sum(o) AS n FROM o),
cells AS (SELECT ga.a, gb.b, coalesce(o.o, 0) AS o, ra.ra * cb.cb * 1.0 / n.n AS e
          FROM ga CROSS JOIN gb JOIN ra ON ra.a = ga.a JOIN cb ON cb.b = gb.b CROSS JOIN n
          LEFT JOIN o ON o.a = ga.a AND o.b = gb.b),
s AS (SELECT sum((o - e) * (o - e) / e) AS chi2, (SELECT count(*) FROM ga) AS r, (SELECT count(*) FROM gb) AS c, max(n.n) AS n FROM cells, n)
SELECT {r6("chi2", 4)} AS chi2, CAST((r - 1) * (c - 1) AS BIGINT) AS dof, CAST(n AS BIGINT) AS n,
  {r6("CASE WHEN least(r, c) - 1 > 0 THEN sqrt(chi2 / (n * (least(r, c) - 1))) END")} AS cramers_v,
  {r6("exp(-chi2 / 2)")} AS p_value FROM s""")
def d25_crosstab(spark, d):
    return round_doubles(P.crosstab_stats(load_table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"), 6, {"chi2": 4})
