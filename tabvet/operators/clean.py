"""E-series: imputation, imputation report, isolation-forest anomaly labels, outlier drivers.

Column-level statistics (medians, means, modes, regression coefficients) are tables with one
row per column; they become literals in a single projection over all rows. Isolation-forest
trees are grown on a parameter-bounded subsample (n_trees x max_samples rows) and scored on
every row by an Arrow-batched `mapInPandas`.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvet.functions.core import categorical_cols, nan_to_null, numeric_cols
from tabvet.operators.longform import quantiles_wide
from tabvet.operators.profile import missing_summary, mode_values
from tabvet.session import materialize


# ------------------------------------------------------------------ E1 / E2
def column_fill_values(df: DataFrame, cols: list[str], strategy: str = "median") -> dict[str, float | None]:
    """Per-column fill value: exact median, mean, or 0 (one row per column comes back)."""
    if strategy == "constant" or not cols:
        return {c: 0.0 for c in cols}
    if strategy == "median":
        rows = quantiles_wide(df, cols, [0.5]).collect()
        return {r["column"]: r["quantile"] for r in rows}
    if strategy == "mean":
        r = df.agg(*[F.avg(nan_to_null(F.col(c))).alias(c) for c in cols]).first()
        return {c: r[c] for c in cols}
    raise ValueError(f"unknown strategy {strategy}")


def impute(df: DataFrame, strategy: str = "median", cols: list[str] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Numeric NULL / NaN -> median, mean or 0. Imputed columns become double."""
    cols = cols or numeric_cols(df, exclude)
    fills = column_fill_values(df, cols, strategy)
    out = []
    for c in df.columns:
        if c in fills and fills[c] is not None:
            out.append(F.coalesce(nan_to_null(F.col(c)), F.lit(float(fills[c]))).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def impute_mode(df: DataFrame, cols: list[str] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Categorical NULL -> most frequent value (ties: smallest value, as pandas `mode()[0]`)."""
    cols = cols or categorical_cols(df, exclude)
    modes = {r["column"]: r["mode"] for r in mode_values(df, cols).collect()} if cols else {}
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[
        F.coalesce(F.col(c), F.lit(modes[c]).cast(types[c])).alias(c) if modes.get(c) is not None else F.col(c)
        for c in df.columns])


# ------------------------------------------------------------------ E5
def imputation_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per column that had missing values: missing before, missing after, values imputed."""
    b = missing_summary(before).select("column", F.col("n_null").alias("missing_before"))
    a = missing_summary(after).select("column", F.col("n_null").alias("missing_after"))
    return b.join(a, "column", "left").where(F.col("missing_before") > 0).select(
        "column", "missing_before", F.coalesce("missing_after", F.lit(0)).cast("long").alias("missing_after"),
        (F.col("missing_before") - F.coalesce("missing_after", F.lit(0))).cast("long").alias("imputed"))


# ------------------------------------------------------------------ E3
def _greatest(cols):
    """`greatest` that also accepts zero or one column."""
    if not cols:
        return F.lit(0.0)
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def _bayesian_ridge(xtx: np.ndarray, xty: np.ndarray, yty: float, n: float, max_iter: int = 300, tol: float = 1e-3):
    """Bayesian ridge on centred Gram statistics (evidence maximisation from the eigenvalues of
    XᵀX, as scikit-learn's BayesianRidge with its default gamma priors of 1e-6)."""
    a1 = a2 = l1 = l2 = 1e-6
    eig, vec = np.linalg.eigh(xtx)
    eig = np.clip(eig, 0, None)
    var_y = yty / max(n, 1.0)
    alpha = 1.0 / (var_y + np.finfo(float).eps)
    lam = 1.0
    coef = np.zeros(len(xty))
    vty = vec.T @ xty
    for _ in range(max_iter):
        coef_new = vec @ (vty / (eig + lam / alpha))
        rss = max(yty - 2 * coef_new @ xty + coef_new @ xtx @ coef_new, 0.0)
        gamma = float(np.sum(alpha * eig / (lam + alpha * eig)))
        lam = (gamma + 2 * l1) / (float(coef_new @ coef_new) + 2 * l2)
        alpha = (n - gamma + 2 * a1) / (rss + 2 * a2)
        done = np.sum(np.abs(coef - coef_new)) < tol
        coef = coef_new
        if done:
            break
    return coef


def impute_iterative(df: DataFrame, cols: list[str] | None = None, max_iter: int = 10, tol: float = 1e-3,
                     initial: str = "median") -> DataFrame:
    """Round-robin regression imputation with a Bayesian-ridge model per column.

    Each round is one distributed pass: for every column j with missing values, the Gram
    statistics (XᵀX, Xᵀy, yᵀy, sums) over the rows where j is observed are accumulated in one
    aggregate for all j at once; the p small ridge problems are solved on the driver and every
    missing cell is replaced by its prediction in one projection (Jacobi order: all columns are
    refitted on the previous round's values). Stops when the largest change in an imputed value
    is below tol x the largest absolute value. Each round's table is written to the shared
    checkpoint folder, so lineage stays one round long and lost executors recompute one round.
    """
    cols = cols or numeric_cols(df)
    key_cols = [c for c in df.columns if c not in cols]
    miss = {c: F.col(f"_m_{c}") for c in cols}
    base = df.select(*key_cols, *[nan_to_null(F.col(c)).alias(c) for c in cols],
                     *[F.col(c).isNull().alias(f"_m_{c}") for c in cols])
    base = base.select(*key_cols, *cols, *[(nan_to_null(F.col(c)).isNull() | F.col(f"_m_{c}")).alias(f"_m_{c}") for c in cols])
    counts = base.agg(*[F.sum(miss[c].cast("long")).alias(c) for c in cols]).first()
    targets = [c for c in sorted(cols, key=lambda c: (counts[c], cols.index(c))) if counts[c] > 0]
    if not targets:
        return df
    fills = column_fill_values(base, cols, initial)
    cur = base.select(*key_cols, *[F.coalesce(F.col(c), F.lit(float(fills[c] or 0.0))).alias(c) for c in cols],
                      *[miss[c] for c in cols])
    cur = materialize(cur)
    xmax = cur.agg(F.max(_greatest([F.abs(F.col(c)) for c in cols])).alias("m")).first()["m"] or 1.0
    for _ in range(max_iter):
        aggs = []
        for t in targets:
            others = [c for c in cols if c != t]
            obs = ~miss[t]
            v = [F.col(c) for c in others] + [F.col(t)]
            aggs.append(F.sum(obs.cast("double")).alias(f"{t}__n"))
            for i, a in enumerate(v):
                aggs.append(F.sum(F.when(obs, a)).alias(f"{t}__s{i}"))
                for j in range(i, len(v)):
                    aggs.append(F.sum(F.when(obs, a * v[j])).alias(f"{t}__p{i}_{j}"))
        r = cur.agg(*aggs).first()
        preds = {}
        for t in targets:
            others = [c for c in cols if c != t]
            k = len(others) + 1
            n = r[f"{t}__n"] or 0.0
            if n < 2:
                continue
            s = np.array([r[f"{t}__s{i}"] for i in range(k)], dtype=float)
            P = np.zeros((k, k))
            for i in range(k):
                for j in range(i, k):
                    P[i, j] = P[j, i] = r[f"{t}__p{i}_{j}"]
            mu = s / n
            C = P - n * np.outer(mu, mu)                       # centred cross-products
            coef = _bayesian_ridge(C[:-1, :-1], C[:-1, -1], C[-1, -1], n)
            icpt = mu[-1] - coef @ mu[:-1]
            expr = F.lit(float(icpt))
            for b, c in zip(coef, others):
                expr = expr + F.lit(float(b)) * F.col(c)
            preds[t] = expr
        nxt = cur.select(*key_cols, *[F.when(miss[c], preds[c]).otherwise(F.col(c)).alias(c) if c in preds else F.col(c)
                                      for c in cols], *[miss[c] for c in cols],
                         _greatest([F.when(miss[c], F.abs(preds[c] - F.col(c))).otherwise(F.lit(0.0))
                                    for c in preds]).alias("_delta"))
        nxt = materialize(nxt)
        delta = nxt.agg(F.max("_delta")).first()[0] or 0.0
        cur = nxt.drop("_delta")
        if delta < tol * xmax:
            break
    return cur.select(*[F.col(c) for c in df.columns])


# ------------------------------------------------------------------ E6 / E9
def _c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search (isolation-forest normaliser)."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow_tree(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    """Array form of one isolation tree: feature, threshold, left, right, leaf size."""
    feat, thr, left, right, size = [], [], [], [], []

    def node(rows: np.ndarray, depth: int) -> int:
        i = len(feat)
        feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), size.append(len(rows))
        if depth >= max_depth or len(rows) <= 1:
            return i
        sub = x[rows]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if len(cand) == 0:
            return i
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        go = sub[:, f] < t
        feat[i], thr[i] = f, t
        left[i] = node(rows[go], depth + 1)
        right[i] = node(rows[~go], depth + 1)
        return i

    node(np.arange(len(x)), 0)
    return np.array(feat), np.array(thr), np.array(left), np.array(right), np.array(size)


def _walk(tree: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """A tree as (feature, threshold, next node at 2 * node + goes left, path length at a leaf, levels); a leaf leads to itself."""
    feat, at = tree["feat"].to_numpy(), np.arange(len(tree))
    leaf = feat < 0
    nexts = np.stack([np.where(leaf, at, tree["right"]), np.where(leaf, at, tree["left"])], axis=1).reshape(-1).astype(np.intp)
    depth = np.zeros(len(tree))
    for i in at[~leaf]:  # parents come before their children
        depth[nexts[2 * i: 2 * i + 2]] = depth[i] + 1
    length = depth + np.array([_c_factor(s) for s in tree["size"]])
    return np.where(leaf, 0, feat).astype(np.intp), tree["thr"].to_numpy(float), nexts, length, int(depth.max())


def path_lengths(x: np.ndarray, forest: list) -> np.ndarray:
    """Sum over the trees of each row's path length: all rows of a batch step down one level at a time."""
    total, flat, first = np.zeros(len(x)), np.ascontiguousarray(x).reshape(-1), np.arange(len(x)) * x.shape[1]
    for feat, thr, nexts, length, levels in forest:
        node = np.zeros(len(x), dtype=np.intp)
        for _ in range(levels):
            left = flat.take(first + feat.take(node)) < thr.take(node)
            node = nexts.take(2 * node + left)
        total += length.take(node)
    return total


def isolation_forest(df: DataFrame, cols: list[str] | None = None, n_trees: int = 100, max_samples: int = 256,
                     contamination: float = 0.1, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """Adds `anomaly_score` (0..1, 1 = most anomalous) and `anomaly_label` (ANOMALY / NORMAL).

    Features: median-filled, z-scaled numeric columns. Each tree draws its own subsample of about
    `max_samples` rows by a per-tree hash of the row key, from a candidate pool whose size
    depends only on n_trees x max_samples; trees are grown in parallel by `applyInPandas`
    (one group per tree) and collected as arrays (bounded by n_trees x 2·max_samples nodes).
    Every row is scored by `mapInPandas` with vectorised traversal. The label threshold is the
    exact (1 - contamination) quantile of the scores. Rows are kept, never dropped.
    """
    spark = df.sparkSession
    cols = cols or numeric_cols(df, tuple(key or ()))
    key = key or df.columns
    filled = impute(df, "median", cols)
    st = filled.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols],
                    F.count(F.lit(1)).alias("n")).first()
    n = st["n"]
    z = [((F.col(c) - F.lit(st[f"m_{c}"])) / F.lit(st[f"s_{c}"] or 1.0)).alias(f"_z{i}") for i, c in enumerate(cols)]
    h = F.xxhash64(*[F.col(k) for k in key], F.lit(seed))
    scaled = filled.select("*", *z, h.alias("_h"))
    psi = min(max_samples, n)
    # candidate pool: ~1.5 x n_trees x psi rows at most, independent of n
    pool_rate = min(1.0, 1.5 * n_trees * psi / max(n, 1))
    u = (F.abs(F.col("_h")) % 1_000_000_007) / F.lit(1_000_000_007.0)
    pool = scaled.where(u < pool_rate).select("_h", *[f"_z{i}" for i in range(len(cols))])
    pool_n = max(1, int(round(pool_rate * n)))
    take = min(1.0, psi / pool_n)
    trees = spark.range(n_trees).withColumnRenamed("id", "tree")
    tu = (F.abs(F.xxhash64(F.col("_h"), F.col("tree"))) % 1_000_000_007) / F.lit(1_000_000_007.0)
    samp = pool.crossJoin(F.broadcast(trees)).where(tu < take)     # pool x n_trees: parameter-bounded
    zc = [f"_z{i}" for i in range(len(cols))]
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, t])
        x = pdf[zc].to_numpy(dtype=float)
        f, th, le, ri, sz = _grow_tree(x, rng, max_depth)
        return pd.DataFrame({"tree": t, "node": np.arange(len(f)), "feat": f, "thr": th, "left": le, "right": ri,
                             "size": sz, "n_sub": len(x)})

    schema = "tree long, node long, feat long, thr double, left long, right long, size long, n_sub long"
    nodes = samp.groupBy("tree").applyInPandas(grow, schema).toPandas()   # <= n_trees x (2 psi - 1) rows
    forest = [_walk(g.sort_values("node")) for _, g in nodes.groupby("tree")]
    c_n = _c_factor(float(nodes.groupby("tree")["n_sub"].first().mean()))
    bc = spark.sparkContext.broadcast(forest)

    def score(batches):
        fr = bc.value
        for pdf in batches:
            x = pdf[zc].to_numpy(dtype=float)
            tot = path_lengths(x, fr)
            s = np.power(2.0, -(tot / len(fr)) / c_n) if c_n > 0 else np.full(len(x), 0.5)
            out = pdf.drop(columns=zc + ["_h"])
            out["_s"] = s
            yield out

    out_schema = T.StructType([f for f in filled.schema.fields] + [T.StructField("_s", T.DoubleType())])
    scored = materialize(scaled.mapInPandas(score, out_schema))
    b = scored.agg(F.min("_s").alias("lo"), F.max("_s").alias("hi")).first()
    cut = quantiles_wide(scored, ["_s"], [1.0 - contamination]).first()["quantile"]
    rng_ = (b["hi"] - b["lo"]) if b["hi"] is not None else 0.0
    norm = (F.col("_s") - F.lit(b["lo"])) / F.lit(rng_) if rng_ and rng_ > 0 else F.lit(0.0)
    res = scored.select(*[F.col(c) for c in df.columns],
                        F.when(F.col("_s") > F.lit(cut), F.lit("ANOMALY")).otherwise(F.lit("NORMAL")).alias("anomaly_label"),
                        norm.cast("double").alias("anomaly_score"))
    return res


def anomaly_report(labelled: DataFrame) -> DataFrame:
    """Counts, share and score range of an E6 result (one row)."""
    a = (F.col("anomaly_label") == "ANOMALY").cast("long")
    return labelled.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(a).alias("n_anomalies"),
                        F.min("anomaly_score").alias("score_min"), F.max("anomaly_score").alias("score_max"),
                        F.avg("anomaly_score").alias("score_mean")).select(
        "n_rows", "n_anomalies", (F.col("n_rows") - F.col("n_anomalies")).alias("n_normal"),
        F.round(F.col("n_anomalies") * 100.0 / F.col("n_rows"), 2).alias("anomaly_pct"), "score_min", "score_max", "score_mean")


def vulnerability(labelled: DataFrame) -> DataFrame:
    """Share of out-of-distribution rows (isolation forest at contamination 0.05); High if > 0.1."""
    a = (F.col("anomaly_label") == "ANOMALY").cast("long")
    g = labelled.agg(F.sum(a).alias("n_outliers"), F.count(F.lit(1)).alias("n"))
    share = F.col("n_outliers") / F.col("n")
    return g.select("n_outliers", share.alias("vulnerability_score"),
                    F.when(share > 0.1, F.lit("High")).otherwise(F.lit("Low")).alias("risk_level"))


# ------------------------------------------------------------------ E7 / E8
def outlier_drivers(df: DataFrame, flag: str, cols: list[str] | None = None) -> DataFrame:
    """Per numeric column, mean |z| over the flagged rows (z from the whole table's mean and
    sample std, missing -> mean); columns with std 0 are skipped; ranked descending."""
    cols = cols or numeric_cols(df)
    st = df.agg(*[F.avg(nan_to_null(F.col(c))).alias(f"m_{c}") for c in cols],
                *[F.stddev_samp(nan_to_null(F.col(c))).alias(f"s_{c}") for c in cols])
    fl = df.where(F.col(flag)).crossJoin(F.broadcast(st))         # one-row statistics
    aggs = [F.avg(F.abs((F.coalesce(nan_to_null(F.col(c)), F.col(f"m_{c}")) - F.col(f"m_{c}")) / F.col(f"s_{c}"))).alias(c)
            for c in cols]
    wide = fl.agg(*aggs).crossJoin(st.select(*[F.col(f"s_{c}") for c in cols]))
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("mean_abs_z"),
                                                    F.col(f"s_{c}").alias("_s")) for c in cols])).alias("r")).select("r.*")
    long = long.where(F.col("_s") > 0).drop("_s")
    from pyspark.sql.window import Window
    return long.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs_z"), "column")))


def top_anomalies(df: DataFrame, score: str = "anomaly_score", k: int = 10, tie: list[str] | None = None) -> DataFrame:
    """The k highest scores (TakeOrdered; ties broken by `tie` columns ascending)."""
    return df.orderBy(F.desc(score), *[F.asc(c) for c in (tie or [])]).limit(k)
