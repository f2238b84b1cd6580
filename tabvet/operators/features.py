"""F-series: generated features and feature selection.

Candidate features are Column expressions; their statistics (correlations, variances, means,
class sums) come from one wide aggregate over all rows, and only the winners are projected.
Spark ML covers PCA, preprocessing pipelines and k-means.
"""

from __future__ import annotations

import re
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabvet.functions import rules as R
from tabvet.functions.core import nan_to_null, numeric_cols
from tabvet.operators.longform import quantiles_wide


def _dbl(c: str) -> Column:
    return nan_to_null(F.col(c))


def _ratio0(a: Column, b: Column) -> Column:
    """a / b, 0 where b == 0 (numpy `where(b != 0, a / b, 0)`)."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def _ratio_null(a: Column, b: Column) -> Column:
    """a / b, NULL where b == 0 (pandas `replace(0, nan)`)."""
    return F.when(b != 0, a / b)


# ------------------------------------------------------------------ F1
def interaction_candidates(df: DataFrame, cols: list[str], target: str, keep: int = 10) -> DataFrame:
    """F1: pair products a*b and ratios a/b (nulls -> 0, b == 0 -> 0, clipped to +-1e6) scored by
    |corr(feature, y)|; kept when non-constant and above 0.3 x the best single-column |r|; the
    `keep` best by |r| (ties in generation order). One aggregate scores every candidate."""
    y = _dbl(target)
    z = {c: F.coalesce(_dbl(c), F.lit(0.0)) for c in cols}
    cands: list[tuple[str, str, str, str, Column]] = []
    for a, b in combinations(cols, 2):
        cands.append((f"{a}_x_{b}", "product", a, b, z[a] * z[b]))
        cands.append((f"{a}_div_{b}", "ratio", a, b, F.least(F.greatest(_ratio0(z[a], z[b]), F.lit(-1e6)), F.lit(1e6))))
    aggs = []
    for c in cols:
        aggs += [F.stddev_samp(_dbl(c)).alias(f"sd__{c}"), F.abs(F.corr(z[c], y)).alias(f"r__{c}")]
    for i, (_, _, _, _, e) in enumerate(cands):
        aggs += [F.stddev_pop(e).alias(f"csd__{i}"), F.abs(F.corr(e, y)).alias(f"cr__{i}")]
    r = df.agg(*aggs).first()
    base = {c: (r[f"r__{c}"] or 0.0) for c in cols if (r[f"sd__{c}"] or 0.0) > 0}
    best = max(base.values()) if base else 0.0
    rows = []
    for i, (name, typ, a, b, _) in enumerate(cands):
        sd, cr = r[f"csd__{i}"], r[f"cr__{i}"]
        if sd is None or sd <= 0 or cr is None or cr != cr or cr <= best * 0.3:
            continue
        rows.append((name, typ, a, b, i, float(cr), float(cr - max(base.get(a, 0.0), base.get(b, 0.0)))))
    rows.sort(key=lambda t: (-t[5], t[4]))
    out = [(n, t, a, b, k + 1, cr, imp, float(best)) for k, (n, t, a, b, _, cr, imp) in enumerate(rows[:keep])]
    return df.sparkSession.createDataFrame(
        out, "feature string, type string, a string, b string, rank int, correlation double, improvement double, "
             "baseline_max double")


def add_interactions(df: DataFrame, ranking: DataFrame) -> DataFrame:
    """Project the F1 winners (ranking has at most `keep` rows)."""
    new = []
    for r in ranking.orderBy("rank").collect():
        za, zb = F.coalesce(_dbl(r["a"]), F.lit(0.0)), F.coalesce(_dbl(r["b"]), F.lit(0.0))
        e = za * zb if r["type"] == "product" else F.least(F.greatest(_ratio0(za, zb), F.lit(-1e6)), F.lit(1e6))
        new.append(e.alias(r["feature"]))
    return df.select("*", *new)


# ------------------------------------------------------------------ F2
def polynomial(df: DataFrame, cols: list[str], degree: int = 2, keys: list[str] | None = None) -> DataFrame:
    """every monomial of degree 1..degree, no bias, named like scikit-learn (`a^2`, `a b`)."""
    out = []
    for d in range(1, degree + 1):
        for combo in combinations_with_replacement(cols, d):
            e = F.lit(1.0)
            for c in combo:
                e = e * _dbl(c)
            counts = {c: combo.count(c) for c in dict.fromkeys(combo)}
            name = " ".join(c if k == 1 else f"{c}^{k}" for c, k in counts.items())
            out.append(e.alias(name))
    return df.select(*(keys or []), *out)


# ------------------------------------------------------------------ F3
def row_stats(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """row mean / std (ddof 1) / min / max / skew (bias-corrected) over the numeric columns,
    skipping nulls, as pandas `axis=1` reductions."""
    cols = cols or numeric_cols(df)
    v = [_dbl(c) for c in cols]
    n = sum((x.isNotNull().cast("double") for x in v), F.lit(0.0))
    s = sum((F.coalesce(x, F.lit(0.0)) for x in v), F.lit(0.0))
    mean = s / n
    dev = [F.when(x.isNotNull(), x - mean) for x in v]
    m2 = sum((F.coalesce(d * d, F.lit(0.0)) for d in dev), F.lit(0.0))
    m3 = sum((F.coalesce(d * d * d, F.lit(0.0)) for d in dev), F.lit(0.0))
    std = F.when(n > 1, F.sqrt(m2 / (n - 1)))
    skew = F.when(n > 2, F.when(m2 == 0, F.lit(0.0)).otherwise(
        F.sqrt(n * (n - 1)) / (n - 2) * (m3 / n) / F.pow(m2 / n, 1.5)))
    return df.select("*", F.when(n > 0, mean).alias("row_mean"), std.alias("row_std"), F.least(*v).alias("row_min"),
                     F.greatest(*v).alias("row_max"), skew.alias("row_skew"))


# ------------------------------------------------------------------ F4 / F5
def top_variance(df: DataFrame, k: int = 3, cols: list[str] | None = None) -> DataFrame:
    """the k numeric columns with the largest sample variance (ties by schema order)."""
    cols = cols or numeric_cols(df)
    r = df.agg(*[F.var_samp(_dbl(c)).alias(c) for c in cols]).first()
    ranked = sorted([(c, i, r[c]) for i, c in enumerate(cols) if r[c] is not None], key=lambda t: (-t[2], t[1]))[:k]
    return df.sparkSession.createDataFrame([(c, float(v), j + 1) for j, (c, _, v) in enumerate(ranked)],
                                           "column string, variance double, rank int")


def pair_features(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """product and ratio (b == 0 -> 0) among the three highest-variance columns."""
    top = [r["column"] for r in top_variance(df, 3, cols).orderBy("rank").collect()]
    new = []
    for i, a in enumerate(top):
        for b in top[i + 1:]:
            new += [(_dbl(a) * _dbl(b)).alias(f"{a}_x_{b}"), _ratio0(_dbl(a), _dbl(b)).alias(f"{a}_div_{b}")]
    return df.select("*", *new)


# ------------------------------------------------------------------ F6 / F17
def quantile_bins(df: DataFrame, cols: list[str] | None = None, q: int = 5, keys: list[str] | None = None) -> DataFrame:
    """`pd.qcut(q, labels=False, duplicates='drop')` codes: exact quantile edges, duplicates
    dropped, right-closed bins with the lowest edge included."""
    cols = cols or numeric_cols(df)
    probs = [i / q for i in range(q + 1)]
    edges: dict[str, list[float]] = {c: [] for c in cols}
    for r in quantiles_wide(df, cols, probs).collect():
        edges[r["column"]].append((r["prob"], r["quantile"]))
    out = []
    for c in cols:
        e = sorted({v for _, v in edges[c] if v is not None})
        x = _dbl(c)
        code = sum((F.when(x > F.lit(b), 1).otherwise(0) for b in e[1:-1]), F.lit(0))
        out.append(F.when(x.isNotNull() & (len(e) >= 2), code).alias(f"{c}_binned"))
    return df.select(*(keys or []), *out)


def fixed_bins(df: DataFrame, col: str, edges: list[float] | None = None, labels: list[str] | None = None,
               name: str = "_age_group") -> DataFrame:
    """`pd.cut(bins=edges, labels=labels)`: right-closed (a, b], outside -> NULL."""
    edges = edges or R.AGE_GROUP_EDGES
    labels = labels or R.AGE_GROUP_LABELS
    x = _dbl(col)
    e = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > lo) & (x <= hi)
        e = F.when(cond, F.lit(lab)) if e is None else e.when(cond, F.lit(lab))
    return df.withColumn(name, e)


# ------------------------------------------------------------------ F7
def guarded_log_sqrt(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """`{c}_log` = log1p(c) when every value is > 0, `{c}_sqrt` when every value is >= 0
    (a missing value fails both tests, as NaN comparisons do)."""
    cols = cols or numeric_cols(df)
    r = df.agg(*[F.min(_dbl(c)).alias(f"mn__{c}") for c in cols],
               *[F.sum(_dbl(c).isNull().cast("long")).alias(f"nn__{c}") for c in cols]).first()
    new = []
    for c in cols:
        mn, nn = r[f"mn__{c}"], r[f"nn__{c}"]
        if mn is None or nn:
            continue
        if mn > 0:
            new.append(F.log1p(_dbl(c)).alias(f"{c}_log"))
        if mn >= 0:
            new.append(F.sqrt(_dbl(c)).alias(f"{c}_sqrt"))
    return df.select("*", *new)


# ------------------------------------------------------------------ F8 / F9 / F10
def _finite(e: Column) -> Column:
    return F.when(~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))), e)


#: rule -> expression over the columns of its roles; names, roles and descriptions are fixed values in rules.py
DOMAIN_FORMULAS = {
    "bmi": lambda weight, height: weight / (height * height),
    "pulse_pressure": lambda systolic, diastolic: systolic - diastolic,
    "mean_arterial_pressure": lambda systolic, diastolic: (systolic + 2 * diastolic) / 3,
    "experience_ratio": lambda experience, age: _ratio_null(experience, age - 18),
}


def column_roles(columns: list[str]) -> dict[str, str]:
    """Role -> the first column that takes it; a column takes the first role whose pattern it matches."""
    taken = {c: next((role for role, pattern in R.FEATURE_ROLE_PATTERNS if re.search(pattern, c)), None) for c in columns}
    return {role: c for c, role in reversed(taken.items()) if role}


def _feature(name: str, formula: str, sources: list[str], expr: Column) -> tuple[str, str, str, Column]:
    return f"feat_{name}", formula, ", ".join(sources), _finite(expr)


def domain_rules(columns: list[str]):
    """Features of the domain rules whose roles the columns fill; rules without a formula of their own are ratios."""
    roles = column_roles(columns)
    for rule, needed, description in R.FEATURE_RULES:
        if set(needed) <= set(roles):
            sources = [roles[r] for r in needed]
            yield _feature(rule, description, sources, DOMAIN_FORMULAS.get(rule, _ratio_null)(*map(_dbl, sources)))


def generic_rules(columns: list[str], least: dict[str, float], least_abs: dict[str, float]):
    """Squares, log1p of positive columns, products and ratios by columns without zero, over all columns and pairs."""
    positive = {c for c in columns if least[c] is not None and least[c] > 0}
    nonzero = {c for c in columns if least_abs[c] is not None and least_abs[c] > 0}
    for c in columns:
        yield _feature(f"{c}_squared", f"{c}^2", [c], _dbl(c) * _dbl(c))
    for c in filter(positive.__contains__, columns):
        yield _feature(f"log_{c}", f"log({c}+1)", [c], F.log1p(_dbl(c)))
    for a, b in combinations(columns, 2):
        yield _feature(f"{a}_x_{b}", f"{a} * {b}", [a, b], _dbl(a) * _dbl(b))
        if b in nonzero:
            yield _feature(f"{a}_div_{b}", f"{a} / {b}", [a, b], _dbl(a) / _dbl(b))


def correlated_rules(pairs, r: dict, min_abs_corr: float):
    """Ratios of the pairs whose correlation is strong enough."""
    for a, b in pairs:
        if r[a, b] is not None and abs(r[a, b]) >= min_abs_corr:
            yield _feature(f"{a}_div_{b}", f"{a} / {b} (correlation: {r[a, b]:.2f})", [a, b], _ratio_null(_dbl(a), _dbl(b)))


def rule_features(df: DataFrame, min_abs_corr: float = 0.5, limit: int | None = None) -> tuple[DataFrame, list[tuple[str, str, str, Column]]]:
    """F8 + F9: domain features, or generic ones where no domain rule applies, then ratios of correlated pairs.

    Values that are not finite become NULL. All columns and pairs take part; `limit` (default none) bounds the number
    of features. Returns the enhanced frame and the list (name, formula, sources, expr)."""
    num = numeric_cols(df)
    found = {f[0]: f for f in domain_rules(df.columns)}
    pairs = list(combinations(num, 2))
    if not found and pairs:
        st = df.agg(*[F.min(_dbl(c)).alias(f"m{i}") for i, c in enumerate(num)],
                    *[F.min(F.abs(_dbl(c))).alias(f"a{i}") for i, c in enumerate(num)]).first()
        found = {f[0]: f for f in generic_rules(num, {c: st[f"m{i}"] for i, c in enumerate(num)}, {c: st[f"a{i}"] for i, c in enumerate(num)})}
    if pairs:
        r = df.agg(*[F.corr(_dbl(a), _dbl(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]).first()
        for f in correlated_rules(pairs, dict(zip(pairs, r)), min_abs_corr):
            found.setdefault(f[0], f)
    feats = list(found.values())[:limit]
    return df.select("*", *[e.alias(n) for n, _, _, e in feats]), feats


def feature_summary(enhanced: DataFrame, feats: list[tuple[str, str, str, Column]]) -> DataFrame:
    """name, formula, source columns, non-null count and mean (4 decimals) per new feature."""
    if not feats:
        return enhanced.sparkSession.createDataFrame([], "feature string, formula string, source_columns string, "
                                                         "non_null_count long, mean double, position int")
    r = enhanced.agg(*[F.count(F.col(n)).alias(f"c{i}") for i, (n, _, _, _) in enumerate(feats)],
                     *[F.avg(F.col(n)).alias(f"m{i}") for i, (n, _, _, _) in enumerate(feats)])
    structs = [F.struct(F.lit(n).alias("feature"), F.lit(f).alias("formula"), F.lit(s).alias("source_columns"),
                        F.col(f"c{i}").alias("non_null_count"), F.round(F.col(f"m{i}"), 4).alias("mean"),
                        F.lit(i).alias("position"))
               for i, (n, f, s, _) in enumerate(feats)]
    return r.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


# ------------------------------------------------------------------ F11 / F12
def anova_f(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """one-way ANOVA F per feature across target classes (scikit-learn `f_classif`): class
    counts, sums and sums of squares in one `groupBy(target)`; rank by F."""
    g = df.where(F.col(target).isNotNull()).groupBy(target).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(_dbl(c)).alias(f"s__{c}") for c in features], *[F.sum(_dbl(c) * _dbl(c)).alias(f"q__{c}") for c in features])
    tot = g.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("K"),
                *[F.sum(f"s__{c}").alias(f"S__{c}") for c in features], *[F.sum(f"q__{c}").alias(f"Q__{c}") for c in features],
                *[F.sum(F.col(f"s__{c}") * F.col(f"s__{c}") / F.col("n")).alias(f"B__{c}") for c in features])
    N, K = F.col("N").cast("double"), F.col("K").cast("double")
    rows = []
    for c in features:
        ssb = F.col(f"B__{c}") - F.col(f"S__{c}") * F.col(f"S__{c}") / N
        ssw = F.col(f"Q__{c}") - F.col(f"B__{c}")
        fstat = (ssb / (K - 1)) / (ssw / (N - K))
        rows.append(F.struct(F.lit(c).alias("feature"), fstat.alias("f_score")))
    long = tot.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return long.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("f_score"), "feature")))


def select_anova(df: DataFrame, features: list[str], target: str, k: int) -> DataFrame:
    return anova_f(df, features, target).where(F.col("rank") <= k)


def mutual_information(df: DataFrame, features: list[str], target: str, bins: int = 10, threshold: float = 0.01) -> DataFrame:
    """F12 (re-aimed): plug-in mutual information (nats) between each feature's exact quantile
    bin (missing -> 0 first, as the reference fills) and the target class, from one joint
    (feature, bin, class) count table over all rows. Features with MI < threshold are marked
    for dropping in column order, at most a third of them."""
    filled = df.select(*[F.coalesce(_dbl(c), F.lit(0.0)).alias(c) for c in features], F.col(target).alias("_y"))
    binned = quantile_bins(filled, features, bins, keys=["_y"])
    long = binned.select("_y", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_binned").alias("bin"))
                                                   for c in features])).alias("r")).select("_y", "r.*")
    joint = long.groupBy("feature", "bin", "_y").agg(F.count(F.lit(1)).alias("n"))
    w_f = Window.partitionBy("feature")
    w_fb = Window.partitionBy("feature", "bin")
    w_fy = Window.partitionBy("feature", "_y")
    # joint has features x bins x classes rows: windows over counts, not rows
    j = joint.withColumn("_tot", F.sum("n").over(w_f)).withColumn("nb", F.sum("n").over(w_fb)).withColumn("ny", F.sum("n").over(w_fy))
    mi = j.groupBy("feature").agg(F.sum(F.col("n") / F.col("_tot") * F.log(F.col("n") * F.col("_tot") / (F.col("nb") * F.col("ny"))))
                                  .alias("mi"))
    pos = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(features)], "feature string, position int")
    t = mi.join(F.broadcast(pos), "feature")
    low = F.col("mi") < threshold
    nlow = F.sum(low.cast("int")).over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return t.select("feature", "position", F.greatest(F.col("mi"), F.lit(0.0)).alias("mi"),
                    (low & (nlow <= len(features) // 3)).alias("drop"))


# ------------------------------------------------------------------ F15 / F16 / F18 (Spark ML)
def _assemble(df: DataFrame, cols: list[str], out: str = "_x") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def pca(df: DataFrame, cols: list[str], k: int = 2, keys: list[str] | None = None) -> DataFrame:
    """centred (not scaled) PCA with k components when there are more than k columns."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array
    if len(cols) <= k:
        return df.select(*(keys or []), *cols)
    x = _assemble(df.select(*(keys or []), *[F.coalesce(_dbl(c), F.lit(0.0)).alias(c) for c in cols]), cols)
    sc = StandardScaler(inputCol="_x", outputCol="_c", withMean=True, withStd=False).fit(x)
    xc = sc.transform(x)
    m = PCA(k=k, inputCol="_c", outputCol="_p").fit(xc)
    arr = vector_to_array(F.col("_p"))
    return m.transform(xc).select(*(keys or []), *[arr[i].alias(f"pc{i + 1}") for i in range(k)])


def preprocess(df: DataFrame, target: str | None = None):
    """F16: numeric median-impute + z-scale, categorical mode-impute + one-hot (unknown kept in
    an extra slot), label-indexed target. Returns (fitted PipelineModel, transformed frame)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
    num = numeric_cols(df, (target,) if target else ())
    cat = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name != target]
    stages = []
    if num:
        stages.append(Imputer(inputCols=num, outputCols=[f"{c}__imp" for c in num], strategy="median"))
    for c in cat:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep", stringOrderType="frequencyDesc"))
    if cat:
        stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in cat], outputCols=[f"{c}__oh" for c in cat],
                                    handleInvalid="keep"))
    if num:
        stages.append(VectorAssembler(inputCols=[f"{c}__imp" for c in num], outputCol="_num"))
        stages.append(StandardScaler(inputCol="_num", outputCol="_num_z", withMean=True, withStd=True))
    stages.append(VectorAssembler(inputCols=(["_num_z"] if num else []) + [f"{c}__oh" for c in cat], outputCol="features"))
    if target:
        stages.append(StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc"))
    prepared = df.select(*[_dbl(c).alias(c) for c in num], *cat, *([target] if target else []))
    model = Pipeline(stages=stages).fit(prepared)
    return model, model.transform(prepared)


def kmeans(df: DataFrame, cols: list[str], k: int = 5, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """k clusters of z-scaled features; adds `cluster`."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler
    x = _assemble(df.select(*(keys or []), *[F.coalesce(_dbl(c), F.lit(0.0)).alias(c) for c in cols]), cols)
    z = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(x).transform(x)
    m = KMeans(k=k, seed=seed, featuresCol="_z", predictionCol="cluster", maxIter=50).fit(z)
    return m.transform(z).select(*(keys or []), *cols, "cluster")
