"""Registered G-series queries (drift) with their DuckDB oracles.

Reference = lineitem shipped before 1998-01-01, current = shipped on or after.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.functions.core import round_doubles
from tabvet.operators import drift as G
from tabvet.plans.fixtures import EVENT_CUT, PRED_SQL, SPLIT_SQL, lineitem_split, predictions
from tabvet.plans.registry import query
from tabvet.plans.sqlgen import r6, union_all, with_
from tabvet.sources.tables import load_table

DRIFT_COLS = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _long(side: str, flag: int | None = None) -> str:
    extra = f", {flag} AS side" if flag is not None else ""
    return union_all([f"""SELECT '{c}' AS "column", CAST({c} AS DOUBLE) AS value{extra} FROM {side} WHERE {c} IS NOT NULL"""
                      for c in DRIFT_COLS])


KS_CTES = [SPLIT_SQL,
           f"lng AS ({_long('ref', 0)} UNION ALL {_long('cur', 1)})",
           """vc AS (SELECT "column", value, sum(1 - side) AS n_ref, sum(side) AS n_cur FROM lng GROUP BY 1, 2)""",
           """cdf AS (SELECT "column", value, lead(value) OVER (PARTITION BY "column" ORDER BY value) AS next_value,
     sum(n_ref) OVER (PARTITION BY "column" ORDER BY value ROWS UNBOUNDED PRECEDING) * 1.0 / sum(n_ref) OVER (PARTITION BY "column") AS fr,
     sum(n_cur) OVER (PARTITION BY "column" ORDER BY value ROWS UNBOUNDED PRECEDING) * 1.0 / sum(n_cur) OVER (PARTITION BY "column") AS fc,
     sum(n_ref) OVER (PARTITION BY "column") AS tr, sum(n_cur) OVER (PARTITION BY "column") AS tc FROM vc)""",
           """ks0 AS (SELECT "column", max(abs(fr - fc)) AS d, CAST(max(tr) AS BIGINT) AS n_ref, CAST(max(tc) AS BIGINT) AS n_cur FROM cdf GROUP BY 1)""",
           """ks1 AS (SELECT *, sqrt(n_ref * n_cur * 1.0 / (n_ref + n_cur)) * d AS z FROM ks0)""",
           """ks AS (SELECT "column", d AS ks_stat, n_ref, n_cur,
     CASE WHEN z < 0.27 THEN 1.0 ELSE greatest(0.0, least(1.0, 2.0 * (SELECT sum(CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * z * z)) FROM range(1, 101) t(k)))) END AS p_value
   FROM ks1 WHERE n_ref >= 10 AND n_cur >= 10)"""]


@query("g1_ks_test", with_(KS_CTES, f"""SELECT "column", {r6("ks_stat")} AS ks_stat, {r6("p_value", 4)} AS p_value, n_ref, n_cur,
  p_value < 0.05 AS drifted FROM ks"""))
def g1_ks_test(spark, d):
    ref, cur = lineitem_split(spark, d)
    return round_doubles(G.ks_test(ref, cur, DRIFT_COLS), 6, {"p_value": 4})


SCORE_SQL = """sc AS (SELECT count(*) AS n_features, CAST(sum(CASE WHEN p_value < 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n_drifted FROM ks)"""


@query("g2_drift_score", with_(KS_CTES + [SCORE_SQL], f"""SELECT n_features, n_drifted,
  {r6("CASE WHEN n_features > 0 THEN n_drifted * 1.0 / n_features ELSE 0.0 END")} AS drift_share, n_drifted > 0 AS drift_detected FROM sc"""))
def g2_drift_score(spark, d):
    ref, cur = lineitem_split(spark, d)
    return round_doubles(G.drift_score(G.ks_test(ref, cur, DRIFT_COLS)))


@query("g3_drift_health", with_(KS_CTES + [SCORE_SQL], f"""SELECT n_features, n_drifted, {r6("s")} AS drift_share, n_drifted > 0 AS drift_detected,
  CASE WHEN s > 0.5 THEN 'CRITICAL' WHEN s > 0.2 THEN 'WARNING' WHEN s > 0 THEN 'CAUTION' ELSE 'HEALTHY' END AS health
FROM (SELECT *, CASE WHEN n_features > 0 THEN n_drifted * 1.0 / n_features ELSE 0.0 END AS s FROM sc)"""))
def g3_drift_health(spark, d):
    ref, cur = lineitem_split(spark, d)
    return round_doubles(G.drift_health(G.drift_score(G.ks_test(ref, cur, DRIFT_COLS))))


def _stats_sql(side: str, prefix: str) -> str:
    return union_all([f"""SELECT '{c}' AS "column", avg({c}) AS {prefix}_mean, stddev_samp({c}) AS {prefix}_std,
  CAST(min({c}) AS DOUBLE) AS {prefix}_min, CAST(max({c}) AS DOUBLE) AS {prefix}_max FROM {side}""" for c in DRIFT_COLS])


CMP_CTES = [f"sr AS ({_stats_sql('ref', 'ref')})", f"sc2 AS ({_stats_sql('cur', 'cur')})",
            'cs AS (SELECT * FROM sr JOIN sc2 USING ("column"))']


@query("g12_compare_stats", with_([SPLIT_SQL] + CMP_CTES, f"""SELECT "column", {", ".join(f"{r6(f'{p}_{s}')} AS {p}_{s}" for p in ("ref", "cur") for s in ("mean", "std", "min", "max"))},
  {r6("abs(cur_mean - ref_mean)")} AS mean_diff, {r6("abs(cur_std - ref_std)")} AS std_diff FROM cs"""))
def g12_compare_stats(spark, d):
    ref, cur = lineitem_split(spark, d)
    return round_doubles(G.compare_stats(ref, cur, DRIFT_COLS))


@query("g4_drift_severity", with_([c for c in KS_CTES[:-1]] + [KS_CTES[-1].replace("WHERE n_ref >= 10 AND n_cur >= 10", "")] + CMP_CTES,
                                  f"""SELECT "column", {r6("ref_mean")} AS baseline_mean, {r6("cur_mean")} AS new_mean, {r6("sh")} AS mean_shift,
  {r6("cur_std / (ref_std + 1e-6)")} AS std_ratio, {r6("coalesce(ks_stat, 0.0)")} AS ks_stat, {r6("p", 4)} AS ks_p_value,
  CASE WHEN sh > 0.2 OR p < 0.01 THEN 'CRITICAL' WHEN sh > 0.1 OR p < 0.05 THEN 'WARNING' ELSE 'OK' END AS severity,
  CASE WHEN sh > 0.2 OR p < 0.01 THEN 0 WHEN sh > 0.1 OR p < 0.05 THEN 1 ELSE 2 END AS severity_rank
FROM (SELECT cs.*, ks.ks_stat, coalesce(ks.p_value, 1.0) AS p, abs(cur_mean - ref_mean) / (ref_std + 1e-6) AS sh
      FROM cs LEFT JOIN ks USING ("column"))"""))
def g4_drift_severity(spark, d):
    ref, cur = lineitem_split(spark, d)
    return round_doubles(G.drift_severity(ref, cur, DRIFT_COLS), 6, {"ks_p_value": 4})


@query("g5_wasserstein", with_(KS_CTES[:4], f"""SELECT "column", {r6("sum(CASE WHEN next_value IS NOT NULL THEN abs(fr - fc) * (next_value - value) ELSE 0.0 END)", 4)} AS wasserstein
FROM cdf GROUP BY 1"""))
def g5_wasserstein(spark, d):
    ref, cur = lineitem_split(spark, d)
    return round_doubles(G.wasserstein(ref, cur, DRIFT_COLS), 4)


def _ubin(x: str, lo: str, hi: str, nb: str) -> str:
    return (f"CASE WHEN {x} < {lo} OR {x} > {hi} THEN NULL WHEN {hi} = {lo} THEN 0 WHEN {x} = {hi} THEN {nb} - 1 "
            f"ELSE least(CAST(floor(({x} - {lo}) / (({hi} - {lo}) / {nb})) AS BIGINT), {nb} - 1) END")


@query("g6_hellinger", with_([SPLIT_SQL, f"lr AS ({_long('ref')})", f"lc AS ({_long('cur')})",
                              """mm AS (SELECT a."column", lo, hi, greatest(5, CAST(floor(least(n_r, n_c) / 10) AS BIGINT)) AS nb
   FROM (SELECT "column", min(value) AS lo, max(value) AS hi, count(*) AS n_r FROM lr GROUP BY 1) a
   JOIN (SELECT "column", count(*) AS n_c FROM lc GROUP BY 1) b USING ("column"))""",
                              f"""cr AS (SELECT "column", bin, count(*) AS c_r FROM (SELECT lr."column", {_ubin('value', 'lo', 'hi', 'nb')} AS bin FROM lr JOIN mm USING ("column")) WHERE bin IS NOT NULL GROUP BY 1, 2)""",
                              f"""cc AS (SELECT "column", bin, count(*) AS c_c FROM (SELECT lc."column", {_ubin('value', 'lo', 'hi', 'nb')} AS bin FROM lc JOIN mm USING ("column")) WHERE bin IS NOT NULL GROUP BY 1, 2)""",
                              """j AS (SELECT coalesce(cr."column", cc."column") AS "column", coalesce(c_r, 0) AS c_r, coalesce(c_c, 0) AS c_c
   FROM cr FULL OUTER JOIN cc ON cr."column" = cc."column" AND cr.bin = cc.bin)""",
                              """s AS (SELECT "column", c_r * 1.0 / sum(c_r) OVER (PARTITION BY "column") AS p, c_c * 1.0 / sum(c_c) OVER (PARTITION BY "column") AS q FROM j)"""],
                             f"""SELECT "column", {r6("sqrt(sum(power(sqrt(p) - sqrt(q), 2))) / sqrt(2.0)")} AS hellinger FROM s GROUP BY 1"""))
def g6_hellinger(spark, d):
    ref, cur = lineitem_split(spark, d)
    return round_doubles(G.hellinger(ref, cur, DRIFT_COLS))


@query("g7_chi_square_drift", with_([SPLIT_SQL,
                                     "r AS (SELECT l_returnflag AS category, count(*) AS e0 FROM ref GROUP BY 1)",
                                     "c AS (SELECT l_returnflag AS category, count(*) AS o FROM cur GROUP BY 1)",
                                     "j AS (SELECT coalesce(r.e0, 0) AS e0, coalesce(c.o, 0) AS o FROM r FULL OUTER JOIN c ON r.category = c.category)",
                                     "t AS (SELECT sum(o) AS tot_o, sum(e0) AS tot_e, count(*) AS k FROM j)"],
                                    f"""SELECT 'l_returnflag' AS "column",
  {r6("CASE WHEN max(tot_e) = 0 THEN 0.0 ELSE sum(CASE WHEN e0 * tot_o * 1.0 / tot_e > 0 THEN power(o - e0 * tot_o * 1.0 / tot_e, 2) / (e0 * tot_o * 1.0 / tot_e) WHEN o > 0 THEN 'inf'::DOUBLE ELSE 0.0 END) END", 4)} AS chi2,
  CAST(max(k) - 1 AS BIGINT) AS dof FROM j, t"""))
def g7_chi_square_drift(spark, d):
    ref, cur = lineitem_split(spark, d)
    return round_doubles(G.chi_square_drift(ref, cur, "l_returnflag", with_p=False), 4)


PSI_PROBS = ", ".join(str(i / 10) for i in range(11))
PSI_CTES = [SPLIT_SQL, f"lr AS ({_long('ref')})", f"lc AS ({_long('cur')})",
            f"""ed AS (SELECT "column", list_sort(list_distinct(quantile_cont(value, [{PSI_PROBS}]))) AS edges FROM lr GROUP BY 1)""",
            """grid AS (SELECT "column", CAST(b.range AS INTEGER) AS bin, len(edges) >= 2 AS ok FROM ed, range(0, greatest(len(edges) - 1, 1)) b)""",
            """br AS (SELECT "column", bin, count(*) AS r FROM (SELECT lr."column", CASE WHEN value < edges[1] OR value > edges[len(edges)] THEN NULL
     WHEN value = edges[len(edges)] THEN len(edges) - 2 ELSE len(list_filter(edges, lambda e: e <= value)) - 1 END AS bin FROM lr JOIN ed USING ("column")) WHERE bin IS NOT NULL GROUP BY 1, 2)""",
            """bc AS (SELECT "column", bin, count(*) AS c FROM (SELECT lc."column", CASE WHEN value < edges[1] OR value > edges[len(edges)] THEN NULL
     WHEN value = edges[len(edges)] THEN len(edges) - 2 ELSE len(list_filter(edges, lambda e: e <= value)) - 1 END AS bin FROM lc JOIN ed USING ("column")) WHERE bin IS NOT NULL GROUP BY 1, 2)""",
            """pj AS (SELECT grid."column", grid.bin, ok, coalesce(r, 0) AS r, coalesce(c, 0) AS c FROM grid
     LEFT JOIN br ON br."column" = grid."column" AND br.bin = grid.bin LEFT JOIN bc ON bc."column" = grid."column" AND bc.bin = grid.bin)""",
            """ps AS (SELECT "column", ok, greatest(r * 1.0 / greatest(sum(r) OVER (PARTITION BY "column"), 1), 1e-8) AS rp,
     greatest(c * 1.0 / greatest(sum(c) OVER (PARTITION BY "column"), 1), 1e-8) AS cp FROM pj)""",
            """psi AS (SELECT "column", CASE WHEN bool_or(ok) THEN sum((cp - rp) * ln(cp / rp)) ELSE 0.0 END AS psi FROM ps GROUP BY 1)"""]


@query("g8_psi_quantile", with_(PSI_CTES, f"""SELECT "column", {r6("psi")} AS psi,
  CASE WHEN psi >= 0.25 THEN 'high' WHEN psi >= 0.1 THEN 'medium' ELSE 'low' END AS level FROM psi"""))
def g8_psi_quantile(spark, d):
    ref, cur = lineitem_split(spark, d)
    return round_doubles(G.psi_quantile(ref, cur, DRIFT_COLS))


@query("g9_psi_counts", with_([SPLIT_SQL, f"lr AS ({_long('ref')})", f"lc AS ({_long('cur')})",
                               """mm AS (SELECT "column", min(value) AS lo, max(value) AS hi, count(*) AS n FROM lr GROUP BY 1)""",
                               f"""hb AS (SELECT "column", bin, count(*) AS cnt FROM (SELECT lr."column", {_ubin('value', 'lo', 'hi', '10')} AS bin FROM lr JOIN mm USING ("column")) GROUP BY 1, 2)""",
                               """base AS (SELECT mm."column", CAST(b.range AS BIGINT) AS bin, coalesce(cnt, 0) * 1.0 / n AS share FROM mm CROSS JOIN range(0, 10) b
     LEFT JOIN hb ON hb."column" = mm."column" AND hb.bin = b.range)""",
                               f"""cb AS (SELECT lc."column", {_ubin('value', 'lo', 'hi', '10')} AS bin FROM lc JOIN mm USING ("column"))""",
                               """cc AS (SELECT "column", bin, count(*) AS cnt FROM cb GROUP BY 1, 2)""",
                               """ct AS (SELECT "column", count(*) AS tot FROM cb GROUP BY 1)""",
                               """j AS (SELECT base."column", CASE WHEN share = 0 THEN 1e-10 ELSE share END AS bp,
     CASE WHEN coalesce(cnt, 0) = 0 THEN 1e-10 ELSE coalesce(cnt, 0) * 1.0 / tot END AS cp
   FROM base LEFT JOIN cc ON cc."column" = base."column" AND cc.bin = base.bin LEFT JOIN ct ON ct."column" = base."column")"""],
                              f"""SELECT "column", {r6("sum((cp - bp) * ln(cp / bp))")} AS psi FROM j GROUP BY 1"""))
def g9_psi_counts(spark, d):
    ref, cur = lineitem_split(spark, d)
    base = G.histogram_shares(ref, DRIFT_COLS, 10).select("column", "bin", "lo", "hi", "share")
    return round_doubles(G.psi_counts(base, cur, DRIFT_COLS))


@query("g10_drift_suite", with_([c for c in KS_CTES[:-1]] + [KS_CTES[-1].replace("WHERE n_ref >= 10 AND n_cur >= 10", "")] + PSI_CTES[1:],
                                f"""SELECT {r6("ks_mean")} AS ks_mean, {r6("ks_max")} AS ks_max, ks_mean > 0.15 AS ks_drift, {r6("psi_mean")} AS psi_mean,
  {r6("psi_max")} AS psi_max, psi_mean > 0.1 AS psi_drift, {r6("o")} AS overall_score, o > 0.3 AS drift_detected
FROM (SELECT *, (least(ks_mean, 1.0) + least(psi_mean / 10, 1.0)) / 2 AS o FROM
  (SELECT avg(ks_stat) AS ks_mean, max(ks_stat) AS ks_max FROM ks), (SELECT avg(psi) AS psi_mean, max(psi) AS psi_max FROM psi))"""))
def g10_drift_suite(spark, d):
    ref, cur = lineitem_split(spark, d)
    return round_doubles(G.drift_suite(ref, cur, DRIFT_COLS))


@query("g11_feature_shift", with_([SPLIT_SQL] + CMP_CTES, f"""SELECT "column", {r6("z")} AS z_shift, {r6("cvs")} AS cv_shift, {r6("(z + cvs) / 2")} AS shift_score,
  (z + cvs) / 2 > 2.0 AS drifted FROM (SELECT "column", abs(cur_mean - ref_mean) / (ref_std + 1e-10) AS z,
  abs(cur_std / (abs(cur_mean) + 1e-10) - ref_std / (abs(ref_mean) + 1e-10)) / (ref_std / (abs(ref_mean) + 1e-10) + 1e-10) AS cvs FROM cs)"""))
def g11_feature_shift(spark, d):
    ref, cur = lineitem_split(spark, d)
    return round_doubles(G.feature_shift(ref, cur, DRIFT_COLS))


@query("g13_missing_columns", """SELECT column_name AS "column" FROM information_schema.columns
WHERE table_name = 'lineitem' AND column_name NOT IN ('l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity',
  'l_extendedprice', 'l_discount', 'l_returnflag', 'l_linestatus')""")
def g13_missing_columns(spark, d):
    li = load_table(spark, d, "lineitem")
    current_batch = li.drop("l_tax", "l_shipdate")      # a producer that stopped sending two fields
    return G.missing_columns(li, current_batch)


RETRAIN_METRICS_SQL = f"""met AS (SELECT model,
   1.0 - avg(CASE WHEN y_pred = y_true THEN 1.0 ELSE 0.0 END) AS error_rate,
   abs(avg(CASE WHEN ts >= TIMESTAMP '{EVENT_CUT}' THEN p END) - avg(CASE WHEN ts < TIMESTAMP '{EVENT_CUT}' THEN p END)) * 10 AS drift_score,
   avg(CASE WHEN ts < TIMESTAMP '{EVENT_CUT}' THEN CASE WHEN y_pred = y_true THEN 1.0 ELSE 0.0 END END) AS baseline_accuracy,
   avg(CASE WHEN ts >= TIMESTAMP '{EVENT_CUT}' THEN CASE WHEN y_pred = y_true THEN 1.0 ELSE 0.0 END END) AS current_accuracy,
   CAST(date_diff('day', CAST(min(ts) AS DATE), DATE '2024-02-20') AS INTEGER) AS age_days
 FROM pred GROUP BY model)"""


def retrain_metrics(spark, d):
    p = predictions(spark, d)
    cut = F.lit(EVENT_CUT).cast("timestamp_ntz")
    hit = F.when(F.col("y_pred") == F.col("y_true"), 1.0).otherwise(0.0)
    return p.groupBy("model").agg(
        (1.0 - F.avg(hit)).alias("error_rate"),
        (F.abs(F.avg(F.when(F.col("ts") >= cut, F.col("p"))) - F.avg(F.when(F.col("ts") < cut, F.col("p")))) * 10).alias("drift_score"),
        F.avg(F.when(F.col("ts") < cut, hit)).alias("baseline_accuracy"), F.avg(F.when(F.col("ts") >= cut, hit)).alias("current_accuracy"),
        F.datediff(F.lit("2024-02-20").cast("date"), F.min("ts").cast("date")).alias("age_days"))


@query("g14_should_retrain", with_([PRED_SQL, RETRAIN_METRICS_SQL], f"""SELECT model, {r6("error_rate")} AS error_rate, {r6("drift_score")} AS drift_score,
  {r6("baseline_accuracy")} AS baseline_accuracy, {r6("current_accuracy")} AS current_accuracy, age_days, reasons, reasons <> '' AS retrain FROM (
  SELECT *, concat_ws('; ', CASE WHEN error_rate > 0.1 THEN printf('High error rate: %.2f%%', error_rate * 100) END,
    CASE WHEN drift_score > 0.3 THEN printf('Data drift detected: %.3f', drift_score) END,
    CASE WHEN baseline_accuracy - current_accuracy > 0.15 THEN printf('Performance drop: %.2f%% → %.2f%%', baseline_accuracy * 100, current_accuracy * 100) END,
    CASE WHEN age_days > 30 THEN printf('Model age: %d days', age_days) END) AS reasons FROM met)"""))
def g14_should_retrain(spark, d):
    return round_doubles(G.should_retrain(retrain_metrics(spark, d)))


@query("g15_drift_trend", """WITH h AS (SELECT 'm' || CAST(user_id % 3 AS VARCHAR) AS model, date_trunc('day', ts) AS ts, avg(value) / 500.0 AS drift_score
  FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts DESC, drift_score DESC) AS rn FROM h
  WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 240 HOUR)
SELECT model, round(max(CASE WHEN rn = 1 THEN drift_score END), 6) AS latest, round(max(CASE WHEN rn = 2 THEN drift_score END), 6) AS previous,
  max(CASE WHEN rn = 1 THEN drift_score END) > max(CASE WHEN rn = 2 THEN drift_score END) AS increasing
FROM r WHERE rn <= 2 GROUP BY model""")
def g15_drift_trend(spark, d):
    ev = load_table(spark, d, "events")
    hist = ev.groupBy(F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
                      F.date_trunc("day", "ts").alias("ts")).agg((F.avg("value") / 500.0).alias("drift_score"))
    return round_doubles(G.drift_trend(hist, asof="2024-01-31 00:00:00", hours=240))
