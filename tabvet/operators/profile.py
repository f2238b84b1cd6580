"""D-series: profiling, missingness, duplicates, value counts, histograms, correlations, quality scores."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabvet.functions.core import NUMERIC_TYPES, categorical_cols, nan_to_null, numeric_cols, safe_div
from tabvet.operators.colstats import column_stats, distinct_table, number_counts
from tabvet.functions.stats import chi2_sf, t_sf_two_sided
from tabvet.operators.longform import exact_quantiles, quantiles_from_counts, top_k_per_key, unpivot, value_counts


# ---------------------------------------------------------------- D1 / D9 / D12 / D30
def profile_columns(df: DataFrame, cols: list[str] | None = None, median: bool = True) -> DataFrame:
    """Per column nulls, null %, distinct, distinct %, constant flag and numeric moments + median."""
    cols = cols or df.columns
    table = distinct_table(df, cols)
    st = column_stats(df, cols, table=table)
    out = st.select(
        "column", "dtype", "position", "n_rows", "n_null",
        (F.col("n_null") * 100.0 / F.col("n_rows")).cast("double").alias("null_pct"),
        "n_distinct",
        (F.col("n_distinct") * 100.0 / F.col("n_rows")).cast("double").alias("distinct_pct"),
        (F.col("n_distinct") <= 1).alias("is_constant"),
        "min", "max", "mean", "std", "skew", "kurt",
    )
    num = [c for c in cols if isinstance(df.schema[c].dataType, NUMERIC_TYPES)]
    if median and num:
        med = quantiles_from_counts(number_counts(table), [0.5]).select("column", F.col("quantile").alias("median"))
        out = out.join(F.broadcast(med), "column", "left")   # one row per column
    else:
        out = out.withColumn("median", F.lit(None).cast("double"))
    return out


def skew_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Bias-corrected skewness per numeric column."""
    cols = cols or numeric_cols(df)
    return column_stats(df, cols, distinct=False).select("column", F.col("skew").alias("skewness"))


def box_stats(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Five-number summary per numeric column (exact quartiles)."""
    cols = cols or numeric_cols(df)
    q = exact_quantiles(unpivot(df, cols), [0.0, 0.25, 0.5, 0.75, 1.0])
    return q.groupBy("column").pivot("prob", [0.0, 0.25, 0.5, 0.75, 1.0]).agg(F.first("quantile")) \
        .toDF("column", "min", "q1", "median", "q3", "max")


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, missing % of cells, numeric column count."""
    cols = df.columns
    num = set(numeric_cols(df))
    miss = [F.sum(((F.col(c).isNull() | F.isnan(c)) if c in num else F.col(c).isNull()).cast("long")) for c in cols]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), sum(miss).alias("n_missing")).select(
        "n_rows", F.lit(len(cols)).cast("long").alias("n_columns"),
        (F.col("n_missing") * 100.0 / (F.col("n_rows") * len(cols))).cast("double").alias("missing_pct"),
        F.lit(len(num)).cast("long").alias("n_numeric"))


# ---------------------------------------------------------------- D3 / D4 / D5
def missing_summary(df: DataFrame) -> DataFrame:
    """D3: per-column missing count and %, plus whether the column is > 50 % missing."""
    st = column_stats(df, numeric_stats=False, distinct=False)
    return st.select("column", "n_null",
                     (F.col("n_null") * 100.0 / F.col("n_rows")).cast("double").alias("missing_pct"),
                     (F.col("n_null") > F.col("n_rows") * 0.5).alias("high_missing"))


def missing_totals(df: DataFrame) -> DataFrame:
    """D3 totals: missing cells, % of cells, number of columns > 50 % missing."""
    ms = missing_summary(df)
    n_cols = len(df.columns)
    return ms.agg(F.sum("n_null").cast("long").alias("total_missing"),
                  F.sum(F.col("high_missing").cast("long")).cast("long").alias("n_high_missing")) \
        .crossJoin(df.agg(F.count(F.lit(1)).alias("n_rows"))) \
        .select("total_missing", (F.col("total_missing") * 100.0 / (F.col("n_rows") * n_cols)).cast("double").alias("missing_pct"),
                "n_high_missing")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows repeating an earlier row (null equals null) and their %.

    groupBy over all columns: the shuffle carries one row per distinct row per partition;
    a hot duplicate group collapses to one partial count map-side.
    """
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.sum("_n").cast("long").alias("n_rows"), F.sum(F.col("_n") - 1).cast("long").alias("n_duplicates")) \
        .select("n_rows", "n_duplicates", (F.col("n_duplicates") * 100.0 / F.col("n_rows")).cast("double").alias("duplicate_pct"))


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Exact duplicate rows removed."""
    return df.dropDuplicates()


# ---------------------------------------------------------------- D6 / D7
def top_values(df: DataFrame, cols: list[str] | None = None, k: int = 10) -> DataFrame:
    """K most frequent values per column (ties by value ascending); rank 1 is the mode."""
    cols = cols or df.columns
    vc = value_counts(df, cols)
    return top_k_per_key(vc, "column", [F.desc("n"), F.asc("value")], k)


def mode_values(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return top_values(df, cols, 1).select("column", F.col("value").alias("mode"), F.col("n").alias("mode_count"))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Normalised value counts of the target (missing excluded)."""
    g = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    tot = g.agg(F.sum("n").alias("_tot"))
    return g.crossJoin(tot).select(F.col(target).alias("class"), "n", (F.col("n") / F.col("_tot")).cast("double").alias("share"))


# ---------------------------------------------------------------- D8
def iqr_outliers(df: DataFrame, cols: list[str] | None = None, k: float = 1.5) -> DataFrame:
    """Values beyond q1 - k*IQR or q3 + k*IQR per numeric column."""
    cols = cols or numeric_cols(df)
    long = unpivot(df, cols)
    q = exact_quantiles(long, [0.25, 0.75]).groupBy("column").pivot("prob", [0.25, 0.75]).agg(F.first("quantile")) \
        .toDF("column", "q1", "q3")
    b = q.select("column", "q1", "q3", (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lower"),
                 (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("upper"))
    cnt = long.join(F.broadcast(b), "column").groupBy("column").agg(
        F.sum(((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).cast("long")).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))
    return b.join(cnt, "column").select("column", "q1", "q3", "lower", "upper", F.col("n_outliers").cast("long"),
                                        (F.col("n_outliers") * 100.0 / F.col("n")).cast("double").alias("outlier_pct"))


# ---------------------------------------------------------------- D10 / D11
def bin_index(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """np.histogram equi-width bin: [a,b) except the last [a,b]; out of range -> NULL; lo == hi -> bin 0."""
    width = (hi - lo) / F.lit(bins)
    raw = F.floor((x - lo) / width).cast("int")
    return (F.when((x < lo) | (x > hi), F.lit(None).cast("int"))
            .when(hi == lo, F.lit(0))
            .when(x == hi, F.lit(bins - 1))
            .otherwise(F.least(raw, F.lit(bins - 1))))


def histogram(df: DataFrame, cols: list[str] | None = None, bins: int = 20) -> DataFrame:
    """Equi-width histogram per numeric column, zero-filled (left join onto the bin grid)."""
    cols = cols or numeric_cols(df)
    long = unpivot(df, cols)
    mm = long.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"))
    counts = long.join(F.broadcast(mm), "column").withColumn("bin", bin_index(F.col("value"), F.col("lo"), F.col("hi"), bins)) \
        .groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = mm.select("column", "lo", "hi", "n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    return grid.join(counts, ["column", "bin"], "left").select(
        "column", "bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
        (F.coalesce(F.col("count"), F.lit(0)) / F.col("n")).cast("double").alias("share"))


def histogram_by(df: DataFrame, feature: str, target: str, bins: int = 10) -> DataFrame:
    """Equi-width histogram of one feature split by target class."""
    x = nan_to_null(F.col(feature))
    base = df.select(x.alias("x"), F.col(target).alias("class")).where(F.col("x").isNotNull())
    mm = base.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return base.crossJoin(mm).withColumn("bin", bin_index(F.col("x"), F.col("lo"), F.col("hi"), bins)) \
        .groupBy("class", "bin").agg(F.count(F.lit(1)).alias("count"))


# ---------------------------------------------------------------- D13-D16
def correlation_pairs(cols: list[str]) -> list[tuple[str, str]]:
    return list(itertools.combinations(cols, 2))


def correlation_matrix(df: DataFrame, cols: list[str] | None = None, chunk: int = 400) -> DataFrame:
    """Pairwise-complete Pearson r, long form (a, b, r) over the upper triangle.

    One aggregate of p(p-1)/2 `corr` expressions (chunked to stay inside codegen limits).
    `corr` skips rows where either side is null, as pandas does.
    """
    cols = cols or numeric_cols(df)
    pairs = correlation_pairs(cols)
    xs = df.select(*[nan_to_null(F.col(c)).alias(c) for c in cols])
    parts = []
    for s in range(0, len(pairs), chunk):
        sub = pairs[s:s + chunk]
        wide = xs.agg(*[F.corr(a, b).alias(f"p{j}") for j, (a, b) in enumerate(sub)])
        parts.append(wide.select(F.inline(F.array(*[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{j}").cast("double").alias("r"))
            for j, (a, b) in enumerate(sub)]))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def correlation_hypotheses(df: DataFrame, cols: list[str] | None = None, min_abs: float = 0.3, k: int | None = None) -> DataFrame:
    """Pairs with |r| >= 0.3, strength (strong >= 0.7, moderate >= 0.5, weak) and direction; all pairs, or the top k by |r|."""
    cm = correlation_matrix(df, cols).where(F.abs("r") >= min_abs)
    ar = F.abs("r")
    out = cm.select("a", "b", "r",
                     F.when(ar >= 0.7, "strong").when(ar >= 0.5, "moderate").otherwise("weak").alias("strength"),
                     F.when(F.col("r") > 0, "positive").otherwise("negative").alias("direction"),
                     F.when(ar >= 0.7, "high").when(ar >= 0.5, "medium").otherwise("low").alias("priority"))
    return out if k is None else out.orderBy(F.desc(F.abs("r")), "a", "b").limit(k)


def target_correlations(df: DataFrame, target: str, cols: list[str] | None = None, min_abs: float = 0.2) -> DataFrame:
    """Features with |r| >= 0.2 against a numeric target, labelled High/Medium/Low."""
    cols = [c for c in (cols or numeric_cols(df)) if c != target]
    y = nan_to_null(F.col(target))
    wide = df.agg(*[F.corr(nan_to_null(F.col(c)), y).alias(f"c{i}") for i, c in enumerate(cols)])
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").cast("double").alias("r"))
                                           for i, c in enumerate(cols)])))
    ar = F.abs("r")
    return long.where(ar >= min_abs).select(
        "feature", "r", F.when(ar >= 0.5, "High").when(ar >= 0.3, "Medium").otherwise("Low").alias("strength"))


def mean_abs_correlation(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Mean |r| over the upper triangle."""
    return correlation_matrix(df, cols).agg(F.avg(F.abs("r")).alias("mean_abs_corr"))


# ---------------------------------------------------------------- D17 / D18
def _grade(score: Column) -> Column:
    return (F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F"))


def quality_report(df: DataFrame) -> DataFrame:
    """Issue counts and the 100 - 20*critical - 5*warning - min(missing %, 30) score with grade."""
    cols = df.columns
    st = column_stats(df, numeric_stats=False)
    str_cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    flags = st.agg(
        F.sum((F.col("n_null") == F.col("n_rows")).cast("int")).alias("n_all_null"),
        F.sum((F.col("n_distinct") <= 1).cast("int")).alias("n_constant"),
        F.sum(((F.col("n_distinct") > F.col("n_rows") * 0.95) & F.col("column").isin(str_cols)).cast("int")).alias("n_high_card"),
        F.sum((F.col("n_null") > F.col("n_rows") * 0.5).cast("int")).alias("n_high_missing"),
        F.sum("n_null").alias("total_missing"), F.max("n_rows").alias("n_rows"))
    dup = duplicate_rows(df).select("n_duplicates")
    r = flags.crossJoin(dup)
    critical = (F.col("n_all_null") > 0).cast("int")
    warnings = ((F.col("n_constant") > 0).cast("int") + (F.col("n_high_card") > 0).cast("int")
                + (F.col("n_duplicates") > 0).cast("int") + (F.col("n_high_missing") > 0).cast("int"))
    miss_pct = F.col("total_missing") * 100.0 / (F.col("n_rows") * len(cols))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - critical * 20 - warnings * 5 - F.least(miss_pct, F.lit(30.0))))
    return r.select(
        F.col("n_rows").cast("long").alias("n_rows"), F.lit(len(cols)).cast("long").alias("n_columns"),
        F.col("total_missing").cast("long").alias("total_missing"), miss_pct.cast("double").alias("missing_pct"),
        F.col("n_duplicates").cast("long").alias("n_duplicates"), critical.cast("long").alias("critical_issues"),
        warnings.cast("long").alias("warnings"), score.cast("double").alias("score")
    ).withColumn("grade", _grade(F.col("score")))


def quality_score_linear(df: DataFrame) -> DataFrame:
    """100 - 0.5 * missing % - 0.5 * duplicate %; level excellent/good/fair/poor."""
    mt = missing_totals(df).select("missing_pct")
    dp = duplicate_rows(df).select("duplicate_pct")
    s = F.greatest(F.lit(0.0), F.lit(100.0) - 0.5 * F.col("missing_pct") - 0.5 * F.col("duplicate_pct"))
    return mt.crossJoin(dp).select("missing_pct", "duplicate_pct", s.cast("double").alias("score")).withColumn(
        "level", F.when(F.col("score") >= 90, "excellent").when(F.col("score") >= 80, "good")
        .when(F.col("score") >= 70, "fair").otherwise("poor"))


# ---------------------------------------------------------------- D25 / D24
def chi_square(cells: DataFrame, keys: list[str], a: str, b: str, o: str = "o") -> DataFrame:
    """Chi-square, dof, n, Cramer's V and p per `keys` from observed cell counts (zero cells left out).

    sum over all cells of (o-e)^2/e = sum over observed cells of o^2/e - n, so no zero-filled grid is needed. At
    dof 1 all four deviations are equal and Yates' correction takes min(0.5, deviation) off them. Counts become
    doubles before they are multiplied.
    """
    cells = cells.withColumn("_o", F.col(o).cast("double"))
    ra = cells.groupBy(*keys, a).agg(F.sum("_o").alias("_ra"))
    cb = cells.groupBy(*keys, b).agg(F.sum("_o").alias("_cb"))
    rows = ra.groupBy(*keys).agg(F.sum("_ra").alias("_n"), F.count(F.lit(1)).alias("_r"), F.sum(1 / F.col("_ra")).alias("_ia"))
    cols = cb.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"), F.sum(1 / F.col("_cb")).alias("_ib"))
    n = rows.join(cols, keys) if keys else rows.crossJoin(cols)     # one row per key
    j = cells.join(ra, [*keys, a]).join(cb, [*keys, b])
    j = j.join(n, keys) if keys else j.crossJoin(n)
    dev = F.abs(F.col("_o") - F.col("_ra") * F.col("_cb") / F.col("_n"))
    g = j.groupBy(*keys).agg(F.sum(F.col("_o") / F.col("_ra") * F.col("_o") / F.col("_cb")).alias("_s"), F.max(dev).alias("_dev"),
                             *[F.first(c).alias(c) for c in ("_n", "_r", "_c", "_ia", "_ib")])
    dof = (F.col("_r") - 1) * (F.col("_c") - 1)
    plain = F.col("_n") * (F.col("_s") - 1)
    yates = F.pow(F.col("_dev") - F.least(F.lit(0.5), F.col("_dev")), 2) * F.col("_n") * F.col("_ia") * F.col("_ib")
    g = g.withColumn("chi2", F.when(dof == 1, yates).otherwise(plain)).withColumn("dof", dof.cast("long"))
    k = F.least("_r", "_c") - 1
    return g.select(*keys, "chi2", "dof", F.col("_n").cast("long").alias("n"),
                    F.when(k > 0, F.sqrt(F.greatest(F.col("chi2"), F.lit(0.0)) / (F.col("_n") * k))).alias("cramers_v"),
                    F.when(F.col("dof") > 0, chi2_sf(F.col("chi2"), F.col("dof").cast("double"))).alias("p_value"))


def crosstab_stats(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square (Yates at dof 1), dof, n, Cramer's V and p of a contingency table, zero cells included."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")) \
        .agg(F.count(F.lit(1)).alias("o"))
    return chi_square(cells, [], "_a", "_b").select("chi2", "dof", "n", "cramers_v", "p_value")


def missingness_bias(df: DataFrame, cols: list[str] | None = None, min_effect: float = 0.3, alpha: float = 0.05) -> DataFrame:
    """Does the absence of a column go with the values of another one?

    Numeric columns: r with the null indicator (more than 10 values); string columns: Cramer's V of the indicator's
    contingency table. Kept are effects above `min_effect` with p below `alpha`; above 0.5 they are CRITICAL.
    """
    cols = cols or df.columns
    num = numeric_cols(df)
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    st = df.agg(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in cols]).first()
    incomplete = [c for c in cols if st[c] and st[c] > 0]
    parts = []
    pairs = [(m, c) for m in incomplete for c in num if c != m]
    if pairs:
        wide = df.agg(*[F.corr(F.col(m).isNull().cast("double"), nan_to_null(F.col(c))).alias(f"r{i}") for i, (m, c) in enumerate(pairs)],
                      *[F.count(nan_to_null(F.col(c))).alias(f"n{i}") for i, (m, c) in enumerate(pairs)])
        long = wide.select(F.inline(F.array(*[F.struct(F.lit(m).alias("missing_col"), F.lit(c).alias("other_col"),
                                                       F.col(f"r{i}").cast("double").alias("effect"), F.col(f"n{i}").cast("long").alias("n"))
                                              for i, (m, c) in enumerate(pairs)]))).where("n > 10")
        t = F.col("effect") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("effect") * F.col("effect"), F.lit(1e-300)))
        parts.append(long.withColumn("p_value", t_sf_two_sided(t, (F.col("n") - 2).cast("double"))).withColumn("kind", F.lit("numeric")))
    for m in incomplete:
        others = [c for c in text if c != m]
        if others:
            flagged = df.select(F.col(m).isNull().alias("_missing"), *others)
            cells = flagged.unpivot(["_missing"], others, "other_col", "_value").where("_value is not null") \
                .groupBy("other_col", "_missing", "_value").agg(F.count(F.lit(1)).alias("o"))
            parts.append(chi_square(cells, ["other_col"], "_missing", "_value").where("dof > 0").select(
                F.lit(m).alias("missing_col"), "other_col", F.col("cramers_v").alias("effect"), "n", "p_value", F.lit("categorical").alias("kind")))
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "missing_col string, other_col string, effect double, n long, p_value double, kind string, severity string")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    strong = F.abs("effect")
    return out.where((strong > min_effect) & (F.col("p_value") < alpha)) \
        .withColumn("severity", F.when(strong > 0.5, "CRITICAL").otherwise("WARNING"))


# ---------------------------------------------------------------- D22
def risk_flags(df: DataFrame, target: str) -> DataFrame:
    """Minority share (< 0.2 imbalance, < 0.1 high), overfitting risk from rows and columns,
    recommended metric."""
    n_cols = len(df.columns)
    dist = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    s = dist.agg(F.min("n").alias("mn"), F.sum("n").alias("tot")).crossJoin(df.agg(F.count(F.lit(1)).alias("rows")))
    ratio = F.when(F.col("tot") > 0, F.col("mn") / F.col("tot")).otherwise(0.0)
    return s.select(ratio.alias("minority_ratio"), (ratio < 0.2).alias("class_imbalance"),
                    F.when(ratio < 0.1, "high").when(ratio < 0.2, "moderate").otherwise("low").alias("imbalance_severity"),
                    F.when(ratio < 0.2, "F1-score").otherwise("accuracy").alias("recommended_metric"),
                    F.col("rows").cast("long").alias("rows"), F.lit(n_cols).cast("long").alias("columns"),
                    F.when(F.col("rows") < 1000, "high").when(F.col("rows") < 10 * n_cols, "moderate").otherwise("low").alias("overfitting_risk"))
