"""G-series: distribution comparison of a reference and a current DataFrame, one row per feature.

All value-level statistics (KS, Wasserstein, quantile edges) run on the shared long-form
kernel: both sides are unpivoted, aggregated to distinct (column, value) counts, and prefix
sums are computed per (column, value-bucket) -- never one whole column in one task.
Per-feature side tables (edges, min/max, moments) have one row per column and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabvet.functions.core import nan_to_null, numeric_cols
from tabvet.functions.stats import chi2_sf, kolmogorov_sf
from tabvet.operators.colstats import column_stats
from tabvet.operators.longform import quantiles_from_counts, running_totals, unpivot
from tabvet.session import materialize


def _two_sided_counts(ref: DataFrame, cur: DataFrame, cols: list[str]) -> DataFrame:
    lr = unpivot(ref, cols).withColumn("_side", F.lit(0))
    lc = unpivot(cur, cols).withColumn("_side", F.lit(1))
    return lr.unionByName(lc).groupBy("column", "value").agg(
        F.sum((F.col("_side") == 0).cast("long")).alias("n_ref"),
        F.sum((F.col("_side") == 1).cast("long")).alias("n_cur"))


def ecdf_frame(ref: DataFrame, cur: DataFrame, cols: list[str], counts: DataFrame | None = None) -> DataFrame:
    """(column, value, F_ref, F_cur, next_value, n_ref_total, n_cur_total) at every distinct value; counts is the stored
    table of `_two_sided_counts`, if it is there already."""
    vc = _two_sided_counts(ref, cur, cols) if counts is None else counts
    rt = running_totals(vc, ["column"], "value", ["n_ref", "n_cur"], with_next=True, checkpoint=counts is None)
    return rt.select("column", "value", "next_value",
                     (F.col("cum_n_ref") / F.col("tot_n_ref")).alias("F_ref"),
                     (F.col("cum_n_cur") / F.col("tot_n_cur")).alias("F_cur"),
                     F.col("tot_n_ref").alias("n_ref"), F.col("tot_n_cur").alias("n_cur"))


def ks_test(ref: DataFrame, cur: DataFrame, cols: list[str] | None = None, alpha: float = 0.05,
            min_n: int = 10, counts: DataFrame | None = None) -> DataFrame:
    """G1: two-sample KS statistic and asymptotic p per numeric column; drifted if p < alpha.

    Columns with fewer than `min_n` values on either side are skipped (as in the reference).
    """
    cols = cols or [c for c in numeric_cols(ref) if c in cur.columns]
    e = ecdf_frame(ref, cur, cols, counts)
    ks = e.groupBy("column").agg(F.max(F.abs(F.col("F_ref") - F.col("F_cur"))).alias("ks_stat"),
                                 F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"))
    en = F.sqrt(F.col("n_ref") * F.col("n_cur") / (F.col("n_ref") + F.col("n_cur")))
    return ks.where((F.col("n_ref") >= min_n) & (F.col("n_cur") >= min_n)).select(
        "column", F.col("ks_stat").cast("double").alias("ks_stat"), kolmogorov_sf(en * F.col("ks_stat")).alias("p_value"),
        F.col("n_ref").cast("long").alias("n_ref"), F.col("n_cur").cast("long").alias("n_cur")
    ).withColumn("drifted", F.col("p_value") < alpha)


def drift_score(ks: DataFrame) -> DataFrame:
    """Share of drifted features; drift detected if any."""
    return ks.agg(F.count(F.lit(1)).alias("n_features"), F.sum(F.col("drifted").cast("long")).alias("n_drifted")) \
        .select("n_features", F.col("n_drifted").cast("long"),
                F.when(F.col("n_features") > 0, F.col("n_drifted") / F.col("n_features")).otherwise(0.0).cast("double").alias("drift_share")) \
        .withColumn("drift_detected", F.col("n_drifted") > 0)


def drift_health(score: DataFrame) -> DataFrame:
    """CRITICAL > 0.5, WARNING > 0.2, CAUTION > 0, else HEALTHY."""
    s = F.col("drift_share")
    return score.withColumn("health", F.when(s > 0.5, "CRITICAL").when(s > 0.2, "WARNING").when(s > 0, "CAUTION").otherwise("HEALTHY"))


def compare_stats(ref: DataFrame, cur: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """mean/std/min/max on both sides with absolute differences (two wide aggs, joined on column)."""
    cols = cols or [c for c in numeric_cols(ref) if c in cur.columns]
    a = column_stats(ref, cols, distinct=False).select("column", *[F.col(s).alias(f"ref_{s}") for s in ("mean", "std", "min", "max")])
    b = column_stats(cur, cols, distinct=False).select("column", *[F.col(s).alias(f"cur_{s}") for s in ("mean", "std", "min", "max")])
    j = a.join(b, "column")
    return j.select("column", *[F.col(f"{p}_{s}") for p in ("ref", "cur") for s in ("mean", "std", "min", "max")],
                    F.abs(F.col("cur_mean") - F.col("ref_mean")).alias("mean_diff"),
                    F.abs(F.col("cur_std") - F.col("ref_std")).alias("std_diff"))


def drift_severity(ref: DataFrame, cur: DataFrame, cols: list[str] | None = None, threshold: float = 0.1) -> DataFrame:
    """Mean shift in baseline-std units + KS p -> CRITICAL / WARNING / OK, sorted by severity."""
    cs = compare_stats(ref, cur, cols)
    ks = ks_test(ref, cur, cols, min_n=1)
    j = cs.join(ks, "column", "left")
    shift = F.abs(F.col("cur_mean") - F.col("ref_mean")) / (F.col("ref_std") + 1e-6)
    p = F.coalesce(F.col("p_value"), F.lit(1.0))
    sev = F.when((shift > threshold * 2) | (p < 0.01), "CRITICAL").when((shift > threshold) | (p < 0.05), "WARNING").otherwise("OK")
    return j.select("column", F.col("ref_mean").alias("baseline_mean"), F.col("cur_mean").alias("new_mean"),
                    shift.alias("mean_shift"), (F.col("cur_std") / (F.col("ref_std") + 1e-6)).alias("std_ratio"),
                    F.coalesce(F.col("ks_stat"), F.lit(0.0)).alias("ks_stat"), p.alias("ks_p_value"), sev.alias("severity")) \
        .withColumn("severity_rank", F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "WARNING", 1).otherwise(2))


def wasserstein(ref: DataFrame, cur: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """1-D earth mover's distance = integral of |F_ref - F_cur| between consecutive distinct values."""
    cols = cols or [c for c in numeric_cols(ref) if c in cur.columns]
    e = ecdf_frame(ref, cur, cols)
    return e.groupBy("column").agg(
        F.sum(F.when(F.col("next_value").isNotNull(),
                     F.abs(F.col("F_ref") - F.col("F_cur")) * (F.col("next_value") - F.col("value"))).otherwise(0.0)).alias("wasserstein"))


def _minmax(ref: DataFrame, cols: list[str]) -> DataFrame:
    return unpivot(ref, cols).groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"),
                                                    F.count(F.lit(1)).alias("n"))


def _uniform_bin(x: Column, lo: Column, hi: Column, nb: Column) -> Column:
    raw = F.floor((x - lo) / ((hi - lo) / nb)).cast("long")
    return (F.when((x < lo) | (x > hi), F.lit(None).cast("long")).when(hi == lo, F.lit(0).cast("long"))
            .when(x == hi, (nb - 1).cast("long")).otherwise(F.least(raw, (nb - 1).cast("long"))))


def hellinger(ref: DataFrame, cur: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Hellinger distance on equi-width bins over the reference range, bins = max(5, min(n)/10).

    Only observed bins are materialised (empty-empty bins contribute 0), joined full outer.
    """
    cols = cols or [c for c in numeric_cols(ref) if c in cur.columns]
    lr, lc = unpivot(ref, cols), unpivot(cur, cols)
    mm = lr.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n_r")) \
        .join(lc.groupBy("column").agg(F.count(F.lit(1)).alias("n_c")), "column") \
        .withColumn("nb", F.greatest(F.lit(5), F.floor(F.least("n_r", "n_c") / 10).cast("long")))
    bm = F.broadcast(mm)

    def counts(long, name):
        return long.join(bm, "column").withColumn("bin", _uniform_bin(F.col("value"), F.col("lo"), F.col("hi"), F.col("nb"))) \
            .where(F.col("bin").isNotNull()).groupBy("column", "bin").agg(F.count(F.lit(1)).alias(name))

    j = counts(lr, "c_r").join(counts(lc, "c_c"), ["column", "bin"], "full").fillna(0, ["c_r", "c_c"])
    w = Window.partitionBy("column")
    j = j.select("column", "bin", (F.col("c_r") / F.sum("c_r").over(w)).alias("p"), (F.col("c_c") / F.sum("c_c").over(w)).alias("q"))
    return j.groupBy("column").agg((F.sqrt(F.sum(F.pow(F.sqrt("p") - F.sqrt("q"), 2))) / F.sqrt(F.lit(2.0))).alias("hellinger"))


def chi_square_drift(ref: DataFrame, cur: DataFrame, col: str, with_p: bool = True) -> DataFrame:
    """categories = union of both sides; expected = ref counts rescaled to the current total.

    Expected 0 with observed > 0 gives an infinite statistic (reported as +inf, p = 0).
    """
    r = ref.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("category")).agg(F.count(F.lit(1)).alias("e0"))
    c = cur.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("category")).agg(F.count(F.lit(1)).alias("o"))
    j = r.join(c, "category", "full").fillna(0, ["e0", "o"])
    tot = j.agg(F.sum("o").alias("tot_o"), F.sum("e0").alias("tot_e"))      # one row
    cells = j.crossJoin(tot).select("o", F.when(F.col("tot_e") > 0, F.col("e0") * F.col("tot_o") / F.col("tot_e")).alias("e"), "tot_e")
    term = F.when(F.col("e") > 0, F.pow(F.col("o") - F.col("e"), 2) / F.col("e")) \
        .when(F.col("o") > 0, F.lit(float("inf"))).otherwise(0.0)
    s = cells.agg(F.sum(term).alias("chi2"), (F.count(F.lit(1)) - 1).alias("dof"), F.max("tot_e").alias("tot_e")) \
        .select(F.lit(col).alias("column"),
                F.when(F.col("tot_e") == 0, 0.0).otherwise(F.col("chi2")).cast("double").alias("chi2"),
                F.col("dof").cast("long").alias("dof"), F.col("tot_e"))
    if with_p:
        s = s.withColumn("p_value", F.when(F.col("tot_e") == 0, 1.0).otherwise(chi2_sf(F.col("chi2"), F.col("dof").cast("double"))))
    return s.drop("tot_e")


def quantile_edges(counts: DataFrame, bins: int = 10) -> DataFrame:
    """(column, edges array) -- unique exact quantiles at 0, 1/bins, ..., 1 of the values counted in (column, value, n)."""
    probs = [i / bins for i in range(bins + 1)]
    q = quantiles_from_counts(counts, probs)
    return q.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("prob", "quantile"))).alias("_q")) \
        .select("column", F.array_distinct(F.transform("_q", lambda s: s["quantile"])).alias("edges"))


def edge_bin(x: Column, edges: Column) -> Column:
    """np.histogram with explicit edges: [e_i, e_{i+1}), last bin closed; outside -> NULL."""
    nb = F.size(edges) - 1
    idx = F.size(F.filter(edges, lambda e: e <= x)) - 1
    return (F.when((x < edges[0]) | (x > F.element_at(edges, -1)), F.lit(None).cast("int"))
            .when(x == F.element_at(edges, -1), nb - 1).otherwise(idx))


def psi_quantile(ref: DataFrame, cur: DataFrame, cols: list[str] | None = None, bins: int = 10, eps: float = 1e-8,
                 counts: DataFrame | None = None) -> DataFrame:
    """PSI on reference-quantile bins; out-of-range values dropped; shares clipped at eps.

    Edges and bins come from the values' counts on both sides (`counts`, else made and stored here): a value is binned
    once, however many rows have it."""
    cols = cols or [c for c in numeric_cols(ref) if c in cur.columns]
    table = materialize(_two_sided_counts(ref, cur, cols)) if counts is None else counts
    edges = F.broadcast(quantile_edges(table.where("n_ref > 0").select("column", "value", F.col("n_ref").alias("n")), bins))   # one row per column, <= bins+1 edges
    binned = table.join(edges, "column").withColumn("bin", edge_bin(F.col("value"), F.col("edges"))).where(F.col("bin").isNotNull())
    by_bin = binned.groupBy("column", "bin").agg(F.sum("n_ref").alias("r"), F.sum("n_cur").alias("c"))

    grid = edges.select("column", F.explode(F.sequence(F.lit(0), F.greatest(F.size("edges") - 2, F.lit(0)))).alias("bin"),
                        (F.size("edges") >= 2).alias("ok"))
    j = grid.join(by_bin, ["column", "bin"], "left").fillna(0, ["r", "c"])
    w = Window.partitionBy("column")
    j = j.select("column", "bin", "ok",
                 F.greatest(F.col("r") / F.greatest(F.sum("r").over(w), F.lit(1)), F.lit(eps)).alias("rp"),
                 F.greatest(F.col("c") / F.greatest(F.sum("c").over(w), F.lit(1)), F.lit(eps)).alias("cp"))
    out = j.groupBy("column").agg(F.sum((F.col("cp") - F.col("rp")) * F.log(F.col("cp") / F.col("rp"))).alias("psi"),
                                  F.max("ok").alias("ok"))
    return out.select("column", F.when(F.col("ok"), F.col("psi")).otherwise(0.0).cast("double").alias("psi")) \
        .withColumn("level", F.when(F.col("psi") >= 0.25, "high").when(F.col("psi") >= 0.1, "medium").otherwise("low"))


def histogram_shares(df: DataFrame, cols: list[str], bins: int = 10) -> DataFrame:
    """Stored-baseline form (A8/D28): (column, bin, lo, hi, share) on equi-width bins."""
    long = unpivot(df, cols)
    mm = long.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"))
    c = long.join(F.broadcast(mm), "column").withColumn("bin", _uniform_bin(F.col("value"), F.col("lo"), F.col("hi"), F.lit(bins))) \
        .groupBy("column", "bin").agg(F.count(F.lit(1)).alias("cnt"))
    grid = mm.select("column", "lo", "hi", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return grid.join(c, ["column", "bin"], "left").select("column", "bin", "lo", "hi",
                                                         (F.coalesce(F.col("cnt"), F.lit(0)) / F.col("n")).alias("share"))


def psi_counts(base: DataFrame, cur: DataFrame, cols: list[str] | None = None, floor: float = 1e-10) -> DataFrame:
    """PSI of current data against a stored baseline histogram (column, bin, lo, hi, share).

    Current values are binned on the baseline's edges; zero shares are floored to 1e-10.
    """
    cols = cols or sorted({r[0] for r in base.select("column").distinct().collect()})
    edges = F.broadcast(base.select("column", "lo", "hi").distinct()
                        .join(base.groupBy("column").agg(F.count(F.lit(1)).alias("nb")), "column"))
    long = unpivot(cur, cols).join(edges, "column") \
        .withColumn("bin", _uniform_bin(F.col("value"), F.col("lo"), F.col("hi"), F.col("nb")))
    cc = long.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("cnt"))
    tot = long.groupBy("column").agg(F.count(F.lit(1)).alias("tot"))
    j = base.join(cc, ["column", "bin"], "left").join(tot, "column", "left")
    bp = F.when(F.col("share") == 0, floor).otherwise(F.col("share"))
    cp0 = F.coalesce(F.col("cnt"), F.lit(0)) / F.col("tot")
    cp = F.when(cp0 == 0, floor).otherwise(cp0)
    return j.groupBy("column").agg(F.sum((cp - bp) * F.log(cp / bp)).alias("psi"))


def drift_suite(ref: DataFrame, cur: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """KS mean/max (detect > 0.15), PSI mean/max (detect > 0.1) on the real baseline rows,
    overall = mean(min(KS mean, 1), min(PSI mean / 10, 1)), drift detected > 0.3."""
    cols = cols or [c for c in numeric_cols(ref) if c in cur.columns]
    counts = materialize(_two_sided_counts(ref, cur, cols))  # both measures read it
    ks = ks_test(ref, cur, cols, min_n=1, counts=counts).agg(F.avg("ks_stat").alias("ks_mean"), F.max("ks_stat").alias("ks_max"))
    ps = psi_quantile(ref, cur, cols, counts=counts).agg(F.avg("psi").alias("psi_mean"), F.max("psi").alias("psi_max"))
    j = ks.crossJoin(ps)
    overall = (F.least(F.col("ks_mean"), F.lit(1.0)) + F.least(F.col("psi_mean") / 10, F.lit(1.0))) / 2
    return j.select("ks_mean", "ks_max", (F.col("ks_mean") > 0.15).alias("ks_drift"), "psi_mean", "psi_max",
                    (F.col("psi_mean") > 0.1).alias("psi_drift"), overall.alias("overall_score")) \
        .withColumn("drift_detected", F.col("overall_score") > 0.3)


def feature_shift(ref: DataFrame, cur: DataFrame, cols: list[str] | None = None, threshold: float = 2.0) -> DataFrame:
    """Z-shift of the mean, CV shift, their mean; drifted if > threshold."""
    cs = compare_stats(ref, cur, cols)
    z = F.abs(F.col("cur_mean") - F.col("ref_mean")) / (F.col("ref_std") + 1e-10)
    cv_r = F.col("ref_std") / (F.abs(F.col("ref_mean")) + 1e-10)
    cv_c = F.col("cur_std") / (F.abs(F.col("cur_mean")) + 1e-10)
    cvs = F.abs(cv_c - cv_r) / (cv_r + 1e-10)
    return cs.select("column", z.alias("z_shift"), cvs.alias("cv_shift"), ((z + cvs) / 2).alias("shift_score")) \
        .withColumn("drifted", F.col("shift_score") > threshold)


def missing_columns(ref: DataFrame, cur: DataFrame) -> DataFrame:
    """Reference columns absent in the current data (schema set difference)."""
    spark = ref.sparkSession
    a = spark.createDataFrame([(c,) for c in ref.columns], "column string")
    b = spark.createDataFrame([(c,) for c in cur.columns], "column string")
    return a.join(b, "column", "left_anti")


def percent(x: Column) -> Column:
    """A share as a per cent text with two decimals."""
    return F.concat(F.format_string("%.2f", x * 100), F.lit("%"))


def should_retrain(metrics: DataFrame, error_rate: str = "error_rate", drift: str = "drift_score", baseline: str = "baseline_accuracy",
                   current: str = "current_accuracy", age_days: str = "age_days") -> DataFrame:
    """Retrain if error > 0.1, drift > 0.3, accuracy drop > 0.15 or model age > 30 days; the reasons give the values."""
    drop = F.col(baseline) - F.col(current)
    reasons = F.concat_ws("; ",
                          F.when(F.col(error_rate) > 0.1, F.concat(F.lit("High error rate: "), percent(F.col(error_rate)))),
                          F.when(F.col(drift) > 0.3, F.concat(F.lit("Data drift detected: "), F.format_string("%.3f", F.col(drift)))),
                          F.when(drop > 0.15, F.concat(F.lit("Performance drop: "), percent(F.col(baseline)), F.lit(" → "), percent(F.col(current)))),
                          F.when(F.col(age_days) > 30, F.concat(F.lit("Model age: "), F.col(age_days).cast("string"), F.lit(" days"))))
    return metrics.withColumn("reasons", reasons).withColumn("retrain", F.col("reasons") != "")


def drift_trend(history: DataFrame, key: str = "model", ts: str = "ts", score: str = "drift_score",
                asof=None, hours: int | None = None) -> DataFrame:
    """Latest vs previous drift score per key within the window; increasing flag."""
    h = history
    if asof is not None and hours is not None:
        h = h.where(F.col(ts) > F.lit(asof).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(hours)} HOURS"))
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(score).desc())
    r = h.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 2)
    return r.groupBy(key).agg(
        F.max(F.when(F.col("_rn") == 1, F.col(score))).alias("latest"),
        F.max(F.when(F.col("_rn") == 2, F.col(score))).alias("previous"),
        F.count(F.lit(1)).alias("_k")).select(
        key, "latest", "previous", (F.col("latest") > F.col("previous")).alias("increasing"))
