"""Registered F-series queries (feature generation and selection) with their DuckDB oracles;
Spark ML operators (PCA, preprocessing, k-means) are rows-only checked."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

from pyspark.sql import functions as F
from pyspark.ml.functions import vector_to_array

from tabvet.functions.core import round_doubles
from tabvet.operators import features as FE
from tabvet.plans.fixtures import LI_MEASURES, LINEITEM_NULLS_SQL, lineitem_nulls
from tabvet.plans.registry import query
from tabvet.plans.sqlgen import r6, union_all, with_
from tabvet.sources.tables import load_table

KEYS = ["l_orderkey", "l_linenumber"]
F1_COLS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _li(spark, d):
    return load_table(spark, d, "lineitem")


def _q(c: str) -> str:
    return '"' + c + '"'


# ------------------------------------------------------------------ F1
def _f1_sql(keep: int = 10) -> str:
    z = {c: f"coalesce({c}, 0)" for c in F1_COLS}
    cands = []
    for a, b in combinations(F1_COLS, 2):
        cands.append((f"{a}_x_{b}", "product", a, b, f"{z[a]} * {z[b]}"))
        cands.append((f"{a}_div_{b}", "ratio", a, b,
                      f"least(greatest(CASE WHEN {z[b]} <> 0 THEN {z[a]} / {z[b]} ELSE 0.0 END, -1e6), 1e6)"))
    base = union_all([f"SELECT '{c}' AS col, stddev_samp({c}) AS sd, abs(corr({z[c]}, l_extendedprice)) AS r FROM lineitem"
                      for c in F1_COLS])
    cand = union_all([f"SELECT '{n}' AS feature, '{t}' AS type, '{a}' AS a, '{b}' AS b, {i} AS gen, stddev_pop({e}) AS sd, "
                      f"abs(corr({e}, l_extendedprice)) AS cr FROM lineitem" for i, (n, t, a, b, e) in enumerate(cands)])
    return f"""WITH base AS ({base}), bb AS (SELECT col, coalesce(r, 0) AS r FROM base WHERE sd > 0),
best AS (SELECT coalesce(max(r), 0) AS m FROM bb), cand AS ({cand}),
k AS (SELECT c.*, (SELECT m FROM best) AS m FROM cand c WHERE sd > 0 AND cr IS NOT NULL AND NOT isnan(cr) AND cr > (SELECT m FROM best) * 0.3),
r AS (SELECT k.*, row_number() OVER (ORDER BY cr DESC, gen) AS rank,
             cr - greatest(coalesce((SELECT r FROM bb WHERE col = k.a), 0), coalesce((SELECT r FROM bb WHERE col = k.b), 0)) AS imp FROM k)
SELECT feature, type, a, b, CAST(rank AS INTEGER) AS rank, {r6('cr')} AS correlation, {r6('imp')} AS improvement,
  {r6('m')} AS baseline_max FROM r WHERE rank <= {keep}"""


@query("f1_interactions", _f1_sql())
def f1_interactions(spark, d):
    return round_doubles(FE.interaction_candidates(_li(spark, d), F1_COLS, "l_extendedprice", keep=10))


# ------------------------------------------------------------------ F2
F2_COLS = ["l_quantity", "l_discount", "l_tax"]


def _f2_sql() -> str:
    out = []
    for deg in (1, 2):
        for combo in combinations_with_replacement(F2_COLS, deg):
            counts = {c: combo.count(c) for c in dict.fromkeys(combo)}
            name = " ".join(c if k == 1 else f"{c}^{k}" for c, k in counts.items())
            out.append(f"{r6(' * '.join(combo))} AS {_q(name)}")
    return f"SELECT {', '.join(KEYS)}, {', '.join(out)} FROM lineitem"


@query("f2_polynomial", _f2_sql())
def f2_polynomial(spark, d):
    return round_doubles(FE.polynomial(_li(spark, d), F2_COLS, 2, keys=KEYS))


# ------------------------------------------------------------------ F3
def _f3_sql() -> str:
    cols = LI_MEASURES
    n = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in cols)
    s = " + ".join(f"coalesce({c}, 0)" for c in cols)
    m2 = " + ".join(f"coalesce(({c} - mean) * ({c} - mean), 0)" for c in cols)
    m3 = " + ".join(f"coalesce(({c} - mean) * ({c} - mean) * ({c} - mean), 0)" for c in cols)
    return with_([LINEITEM_NULLS_SQL, f"a AS (SELECT l_orderkey, l_linenumber, {', '.join(cols)}, CAST({n} AS DOUBLE) AS n, "
                                      f"({s}) / ({n}) AS mean FROM li)",
                  f"b AS (SELECT *, {m2} AS m2, {m3} AS m3 FROM a)"],
                 f"""SELECT l_orderkey, l_linenumber, {', '.join(r6(c) + ' AS ' + c for c in cols)}, {r6('mean')} AS row_mean,
  {r6('CASE WHEN n > 1 THEN sqrt(m2 / (n - 1)) END')} AS row_std,
  {r6('least(' + ', '.join(cols) + ')')} AS row_min, {r6('greatest(' + ', '.join(cols) + ')')} AS row_max,
  {r6('CASE WHEN n > 2 THEN CASE WHEN m2 = 0 THEN 0.0 ELSE sqrt(n * (n - 1)) / (n - 2) * (m3 / n) / pow(m2 / n, 1.5) END END')} AS row_skew
FROM b""")


@query("f3_row_stats", _f3_sql())
def f3_row_stats(spark, d):
    df = lineitem_nulls(spark, d).select(*KEYS, *LI_MEASURES)
    return round_doubles(FE.row_stats(df, LI_MEASURES))


# ------------------------------------------------------------------ F4 / F5
LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("f4_top_variance", f"""WITH v AS ({union_all([f"SELECT '{c}' AS col, {i} AS pos, var_samp({c}) AS v FROM lineitem" for i, c in enumerate(LI_NUM)])})
SELECT col AS "column", {r6('v', 2)} AS variance, CAST(row_number() OVER (ORDER BY v DESC, pos) AS INTEGER) AS rank
FROM v QUALIFY rank <= 3""")
def f4_top_variance(spark, d):
    return round_doubles(FE.top_variance(_li(spark, d), 3, LI_NUM), 2)


F5_COLS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query("f5_pair_features", f"""SELECT {', '.join(KEYS)}, {', '.join(r6(c) + ' AS ' + c for c in F5_COLS[:3])},
  {r6('l_quantity * l_linenumber')} AS l_quantity_x_l_linenumber,
  {r6('CASE WHEN l_linenumber <> 0 THEN l_quantity / l_linenumber ELSE 0.0 END')} AS l_quantity_div_l_linenumber,
  {r6('l_quantity * l_discount')} AS l_quantity_x_l_discount,
  {r6('CASE WHEN l_discount <> 0 THEN l_quantity / l_discount ELSE 0.0 END')} AS l_quantity_div_l_discount,
  {r6('l_linenumber * l_discount')} AS l_linenumber_x_l_discount,
  {r6('CASE WHEN l_discount <> 0 THEN l_linenumber / l_discount ELSE 0.0 END')} AS l_linenumber_div_l_discount
FROM lineitem""")
def f5_pair_features(spark, d):
    df = _li(spark, d).select(*KEYS, *F5_COLS[:3])
    return round_doubles(FE.pair_features(df, F5_COLS))


# ------------------------------------------------------------------ F6
def _qbins_sql(cols, q, src: str, keys: list[str]) -> str:
    probs = ", ".join(str(i / q) for i in range(q + 1))
    edges = ", ".join(f"list_sort(list_distinct(quantile_cont({c}, [{probs}]))) AS e_{c}" for c in cols)
    codes = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN CAST(len(list_filter(e_{c}[2:len(e_{c}) - 1], lambda b: {c} > b)) AS INTEGER) END AS {c}_binned"
        for c in cols)
    return f"SELECT {', '.join(keys + [codes])} FROM {src}, (SELECT {edges} FROM {src}) e"


@query("f6_quantile_bins", _qbins_sql(LI_MEASURES, 5, "lineitem", KEYS))
def f6_quantile_bins(spark, d):
    return FE.quantile_bins(_li(spark, d), LI_MEASURES, 5, keys=KEYS)


# ------------------------------------------------------------------ F7
F7_COLS = LI_MEASURES + ["l_linenumber"]


@query("f7_guarded_log_sqrt", with_([LINEITEM_NULLS_SQL], f"""SELECT l_orderkey, l_linenumber, {', '.join(r6(c) + ' AS ' + c for c in LI_MEASURES)},
  {r6('ln(1 + l_extendedprice)')} AS l_extendedprice_log, {r6('sqrt(l_extendedprice)')} AS l_extendedprice_sqrt,
  {r6('sqrt(l_tax)')} AS l_tax_sqrt,
  {r6('ln(1 + l_linenumber)')} AS l_linenumber_log, {r6('sqrt(l_linenumber)')} AS l_linenumber_sqrt FROM li"""))
def f7_guarded_log_sqrt(spark, d):
    df = lineitem_nulls(spark, d).select("l_orderkey", *F7_COLS)
    return round_doubles(FE.guarded_log_sqrt(df, F7_COLS))


# ------------------------------------------------------------------ F8 / F10
def _domain_input(spark, d):
    return _li(spark, d).select(*KEYS, F.col("l_quantity").alias("weight"), (F.col("l_tax") * 10 + 1).alias("height"),
                                (F.col("l_extendedprice") * F.col("l_discount")).alias("debt"),
                                F.col("l_extendedprice").alias("income"))


DOMAIN_SQL = """dom AS (SELECT l_orderkey, l_linenumber, l_quantity AS weight, l_tax * 10 + 1 AS height,
  l_extendedprice * l_discount AS debt, l_extendedprice AS income FROM lineitem)"""


@query("f8_domain_features", with_([DOMAIN_SQL], f"""SELECT l_orderkey, l_linenumber, {r6('weight')} AS weight, {r6('height')} AS height,
  {r6('debt')} AS debt, {r6('income')} AS income, {r6('weight / (height * height)')} AS feat_bmi,
  {r6('CASE WHEN income <> 0 THEN debt / income END')} AS feat_debt_to_income,
  {r6('CASE WHEN income <> 0 THEN debt / income END')} AS feat_debt_div_income FROM dom"""))
def f8_domain_features(spark, d):
    out, _ = FE.rule_features(_domain_input(spark, d))
    return round_doubles(out)


@query("f10_feature_summary", with_([DOMAIN_SQL], """SELECT 'feat_bmi' AS feature, 'Body Mass Index = weight / height^2' AS formula,
  'weight, height' AS source_columns, count(weight / (height * height)) AS non_null_count,
  round(avg(weight / (height * height)), 4) AS mean, 0 AS position FROM dom
UNION ALL SELECT 'feat_debt_to_income', 'Debt-to-Income Ratio = debt / income', 'debt, income',
  count(CASE WHEN income <> 0 THEN debt / income END), round(avg(CASE WHEN income <> 0 THEN debt / income END), 4), 1 FROM dom
UNION ALL SELECT 'feat_debt_div_income', printf('debt / income (correlation: %.2f)', corr(debt, income)), 'debt, income',
  count(CASE WHEN income <> 0 THEN debt / income END), round(avg(CASE WHEN income <> 0 THEN debt / income END), 4), 2 FROM dom"""))
def f10_feature_summary(spark, d):
    out, feats = FE.rule_features(_domain_input(spark, d))
    return FE.feature_summary(out, feats)


# ------------------------------------------------------------------ F9
def _f9_sql() -> str:
    """Generic path on the four lineitem measures: squares; log1p where the minimum is > 0
    (l_quantity, l_extendedprice); products of all pairs; ratios where min |divisor| > 0
    (l_extendedprice only); no pair reaches |r| >= 0.5."""
    cols = LI_MEASURES
    sel = [f"{r6(c)} AS {c}" for c in cols]
    sel += [f"{r6(f'{c} * {c}', 2 if c == 'l_extendedprice' else 6)} AS feat_{c}_squared" for c in cols]
    sel += [f"{r6(f'ln(1 + {c})')} AS feat_log_{c}" for c in ("l_quantity", "l_extendedprice")]
    for i in range(3):
        for j in range(i + 1, 4):
            a, b = cols[i], cols[j]
            sel.append(f"{r6(f'{a} * {b}')} AS feat_{a}_x_{b}")
    sel.append(f"{r6('l_quantity / l_extendedprice')} AS feat_l_quantity_div_l_extendedprice")
    return f"SELECT {', '.join(sel)} FROM lineitem"


@query("f9_generic_features", _f9_sql())
def f9_generic_features(spark, d):
    out, _ = FE.rule_features(_li(spark, d).select(*LI_MEASURES))
    return round_doubles(out, 6, {"feat_l_extendedprice_squared": 2})


# ------------------------------------------------------------------ F11 / F12
def _anova_sql(cols, target, k) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS feature, ((sum(b) - sum(s) * sum(s) / sum(n)) / (count(*) - 1))
  / ((sum(q) - sum(b)) / (sum(n) - count(*))) AS f FROM (SELECT count(*) AS n, sum({c}) AS s, sum({c} * {c}) AS q,
  sum({c}) * sum({c}) / count(*) AS b FROM lineitem GROUP BY {target})""")
    return f"""WITH a AS ({union_all(parts)})
SELECT feature, {r6('f')} AS f_score, CAST(row_number() OVER (ORDER BY f DESC NULLS LAST, feature) AS INTEGER) AS rank FROM a QUALIFY rank <= {k}"""


@query("f11_select_anova", _anova_sql(LI_MEASURES, "l_returnflag", 2))
def f11_select_anova(spark, d):
    return round_doubles(FE.select_anova(_li(spark, d), LI_MEASURES, "l_returnflag", 2))


def _mi_sql(cols, target, bins=10) -> str:
    fill = ", ".join(f"coalesce({c}, 0) AS {c}" for c in cols)
    src = f"(SELECT {fill}, {target} AS _y FROM li)"
    binned = _qbins_sql(cols, bins, "f", ["_y"])
    parts = union_all([f"SELECT '{c}' AS feature, {i} AS position, {c}_binned AS bin, _y FROM b" for i, c in enumerate(cols)])
    return with_([LINEITEM_NULLS_SQL, f"f AS {src}", f"b AS ({binned})", f"l AS ({parts})",
                  "j AS (SELECT feature, position, bin, _y, count(*) AS n FROM l GROUP BY ALL)",
                  """m AS (SELECT feature, position, sum(n * 1.0 / nn * ln(n * nn * 1.0 / (nb * ny))) AS mi FROM (
  SELECT *, sum(n) OVER (PARTITION BY feature) AS nn, sum(n) OVER (PARTITION BY feature, bin) AS nb,
         sum(n) OVER (PARTITION BY feature, _y) AS ny FROM j) GROUP BY feature, position)"""],
                 f"""SELECT feature, position, {r6('greatest(mi, 0)')} AS mi,
  mi < 0.01 AND sum(CASE WHEN mi < 0.01 THEN 1 ELSE 0 END) OVER (ORDER BY position) <= {len(cols) // 3} AS "drop" FROM m""")


MI_COLS = LI_MEASURES + ["l_linenumber"]


@query("f12_mutual_information", _mi_sql(MI_COLS, "l_returnflag"))
def f12_mutual_information(spark, d):
    return round_doubles(FE.mutual_information(lineitem_nulls(spark, d), MI_COLS, "l_returnflag"))


# ------------------------------------------------------------------ F17
@query("f17_fixed_bins", """SELECT l_orderkey, l_linenumber, l_quantity * 2 AS age,
  CASE WHEN l_quantity * 2 > 0 AND l_quantity * 2 <= 30 THEN 'Young' WHEN l_quantity * 2 > 30 AND l_quantity * 2 <= 50 THEN 'Middle'
       WHEN l_quantity * 2 > 50 AND l_quantity * 2 <= 100 THEN 'Senior' END AS _age_group FROM lineitem""")
def f17_fixed_bins(spark, d):
    df = _li(spark, d).select(*KEYS, (F.col("l_quantity") * 2).alias("age"))
    return FE.fixed_bins(df, "age")


# ------------------------------------------------------------------ F15 / F16 / F18 (Spark ML, rows-only)
@query("f15_pca")
def f15_pca(spark, d):
    return round_doubles(FE.pca(_li(spark, d), LI_MEASURES, 2, keys=KEYS))


@query("f16_preprocess")
def f16_preprocess(spark, d):
    df = lineitem_nulls(spark, d).select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_returnflag")
    _, out = FE.preprocess(df, target="l_returnflag")
    return out.select(vector_to_array("features").alias("features"), "label")


@query("f18_kmeans")
def f18_kmeans(spark, d):
    return FE.kmeans(_li(spark, d), LI_MEASURES, keys=KEYS).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
