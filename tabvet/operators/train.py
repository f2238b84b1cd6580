"""I-series: stratified split, Spark ML training, cross-validation, tuning, tournament, batch
scoring, importances, linear attributions, what-if curves and voting ensembles.

Fits are Spark ML estimators on a vector column assembled from the feature columns, so every
fit is distributed over all rows; folds come from a deterministic hash of the row key (no
random state, results do not depend on partitioning).
"""

from __future__ import annotations

import itertools
import math
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, OneVsRest)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.functions.core import nan_to_null
from tabvet.operators.forest import CellForestClassifier
from tabvet.operators.validate import stratified_flag
from tabvet.session import materialize

TASK_ROWS = 100_000
FITS = 4  # fits of a tournament that run at once


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df for many passes of fits: stored once, in even files of at most `rows` (TASK_ROWS) rows whose number the tasks divide.

    Rows that come out of joins and shuffles are otherwise made again by every stage of a pipeline, in as few partitions as
    they were merged to. A table of at most `rows` rows stays as it is."""
    rows, n = rows or TASK_ROWS, df.count()
    if n <= rows:
        return df
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return materialize(df.repartition(tasks * -(-n // (tasks * rows))))


def stored(df: DataFrame) -> DataFrame:
    """df stored once: in even files like `spread`, a small table as it comes."""
    out = spread(df)
    return materialize(df) if out is df else out


# ------------------------------------------------------------------ I1
def split(df: DataFrame, target: str, test_size: float = 0.2, order: Column | None = None, seed: int = 42) -> DataFrame:
    """Stratified hold-out: exactly round(test_size x n_c) rows of every class c go to 'test'
    (the smallest hash values), the rest to 'train'."""
    order = order if order is not None else F.xxhash64(*[F.col(c) for c in df.columns], F.lit(seed))
    f = stratified_flag(df, [target], test_size, order, "_test")
    return f.withColumn("split", F.when(F.col("_test"), F.lit("test")).otherwise(F.lit("train"))).drop("_test")


# ------------------------------------------------------------------ I2
FAMILIES = ["LogisticRegression", "RandomForest", "GradientBoosting", "DecisionTree", "NaiveBayes", "LinearSVC", "MLP"]

#: What a tournament searches for each family, the family's own setting first; Gaussian Bayes has nothing to set.
SEARCH = {"LogisticRegression": {"regParam": [0.0, 0.1]}, "RandomForest": {"maxDepth": [5, 10]}, "GradientBoosting": {"maxDepth": [5, 3]},
          "DecisionTree": {"maxDepth": [5, 10]}, "LinearSVC": {"regParam": [0.0, 0.1]}, "MLP": {"hidden": [16, 8]}}


def estimator(name: str, n_classes: int = 2, seed: int = 42, params: dict | None = None):
    """Spark ML classifier by reference model family name, with `params` set on the family's own estimator."""
    if name == "LogisticRegression":
        return LogisticRegression(maxIter=100, **(params or {}))
    if name == "RandomForest":
        return CellForestClassifier(**{"numTrees": 100, "seed": seed} | (params or {}))
    if name == "GradientBoosting":
        gbt = GBTClassifier(**{"maxIter": 50, "seed": seed} | (params or {}))
        return gbt if n_classes <= 2 else OneVsRest(classifier=gbt, parallelism=min(n_classes, FITS))
    if name == "DecisionTree":
        return DecisionTreeClassifier(seed=seed, **(params or {}))
    if name == "NaiveBayes":
        return NaiveBayes(modelType="gaussian", **(params or {}))
    if name == "LinearSVC":
        svc = LinearSVC(maxIter=100, **(params or {}))
        return svc if n_classes <= 2 else OneVsRest(classifier=svc, parallelism=min(n_classes, FITS))
    if name == "MLP":
        return None
    raise ValueError(name)


def _prep_stages(features: list[str], target: str, scale: bool = True):
    stages = [StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip"),
              VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="keep")]
    stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True) if scale
                  else VectorAssembler(inputCols=["_raw"], outputCol="features"))
    return stages


def _clean(df: DataFrame, features: list[str], target: str) -> DataFrame:
    return df.select(*[F.coalesce(nan_to_null(F.col(c)), F.lit(0.0)).alias(c) for c in features],
                     F.col(target).cast("string").alias(target), *[c for c in df.columns if c not in features and c != target])


def train(name: str, df: DataFrame, features: list[str], target: str, n_classes: int | None = None,
          seed: int = 42, params: dict | None = None) -> PipelineModel:
    """Fit `name` on all rows of `df`: label index, assemble, z-scale, estimator with `params` (MLP: hidden, its inner layer)."""
    n_classes = n_classes or df.select(target).distinct().count()
    if name == "MLP":
        est = MultilayerPerceptronClassifier(layers=[len(features), (params or {}).get("hidden", 16), n_classes], seed=seed, maxIter=100)
    else:
        est = estimator(name, n_classes, seed, params)
    return Pipeline(stages=_prep_stages(features, target) + [est]).fit(_clean(df, features, target))


def evaluate(model: PipelineModel, df: DataFrame, features: list[str], target: str) -> DataFrame:
    """accuracy, weighted F1 / precision / recall and (binary) AUC on `df` (one row)."""
    pred = model.transform(_clean(df, features, target))
    # scored once: every metric reads the stored scores
    pred = materialize(pred.select("label", "prediction", *[c for c in ("rawPrediction",) if c in pred.columns]))
    m = {k: MulticlassClassificationEvaluator(metricName=k).evaluate(pred)
         for k in ("accuracy", "f1", "weightedPrecision", "weightedRecall")}
    auc = None
    if "rawPrediction" in pred.columns and pred.select("label").distinct().count() == 2:
        auc = BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(pred)
    return df.sparkSession.createDataFrame([(m["accuracy"], m["f1"], m["weightedPrecision"], m["weightedRecall"], auc)],
                                           "accuracy double, f1 double, precision double, recall double, auc double")


# ------------------------------------------------------------------ I3 / I4 / I5
def fold_column(df: DataFrame, key: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    return df.withColumn("_fold", F.pmod(F.xxhash64(*[F.col(c) for c in key], F.lit(seed)), F.lit(k)).cast("int"))


def cross_validate(name: str, df: DataFrame, features: list[str], target: str, key: list[str], k: int = 5,
                   metric: str = "f1") -> DataFrame:
    """k-fold scores of one model family: fold, score; folds from a hash of the row key."""
    return _fold_scores(name, spread(fold_column(_clean(df, features, target), key, k)), features, target, k, metric)


def _fold_scores(name: str, d: DataFrame, features: list[str], target: str, k: int, metric: str, params: dict | None = None) -> DataFrame:
    n_classes = d.select(target).distinct().count()
    rows = []
    for f in range(k):
        m = train(name, d.where(F.col("_fold") != f), features, target, n_classes, params=params)
        pred = m.transform(d.where(F.col("_fold") == f))
        rows.append((name, f, float(MulticlassClassificationEvaluator(metricName=metric).evaluate(pred))))
    return d.sparkSession.createDataFrame(rows, "model string, fold int, score double")


def cv_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"),
                                       F.min("score").alias("min"), F.max("score").alias("max"))


def tune(df: DataFrame, features: list[str], target: str, key: list[str], k: int = 3,
         grid: dict | None = None) -> DataFrame:
    """Grid search of a random forest with `CrossValidator` over the hash fold column; one row
    per parameter set with its mean F1, best first."""
    rf = CellForestClassifier(seed=42)
    grid = grid or {"numTrees": [20, 50], "maxDepth": [5, 10]}
    b = ParamGridBuilder()
    for p, vals in grid.items():
        b = b.addGrid(rf.getParam(p), vals)
    maps = b.build()
    pipe = Pipeline(stages=_prep_stages(features, target) + [rf])
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps, evaluator=MulticlassClassificationEvaluator(metricName="f1"),
                        foldCol="_fold", parallelism=2)
    d = spread(fold_column(_clean(df, features, target), key, k))
    m = cv.fit(d)
    rows = [(",".join(f"{p.name}={v}" for p, v in pm.items()), float(s)) for pm, s in zip(maps, m.avgMetrics)]
    out = df.sparkSession.createDataFrame(rows, "params string, mean_f1 double")
    return out.orderBy(F.desc("mean_f1"), "params")


def tournament(df: DataFrame, features: list[str], target: str, key: list[str], models: list[str] | None = None,
               k: int = 3, search: dict[str, dict] | None = None) -> DataFrame:
    """Search the settings of every model family by cross-validation and rank the families by the mean F1 of their best
    setting (champion = rank 1; ties of settings go to the first, of families to the name). `params` names the setting."""
    search = SEARCH if search is None else search
    d = spread(fold_column(_clean(df, features, target), key, k))
    settings = [(name, i, dict(zip(search.get(name, {}), values))) for name in models or FAMILIES
                for i, values in enumerate(itertools.product(*search.get(name, {}).values()))]
    with ThreadPool(FITS) as pool:
        found = pool.map(lambda s: _fold_scores(s[0], d, features, target, k, "f1", s[2]), settings, chunksize=1)
    scores = None
    for s, (_, i, params) in zip(found, settings):
        s = s.withColumns({"_at": F.lit(i), "params": F.lit(",".join(f"{p}={v}" for p, v in params.items()))})
        scores = s if scores is None else scores.unionByName(s)
    from pyspark.sql.window import Window
    every = scores.groupBy("model", "_at", "params").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"),
                                                         F.min("score").alias("min"), F.max("score").alias("max"))
    best = every.groupBy("model").agg(F.min(F.struct((-F.col("mean")).alias("_loss"), "_at", "mean", "std", "min", "max", "params")).alias("b"))
    summ = best.select("model", "b.mean", "b.std", "b.min", "b.max", "b.params")
    ranked = summ.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), "model")))
    return ranked.select("model", "mean", "std", "min", "max", "rank", "params")


# ------------------------------------------------------------------ I10 / I11 / I12 / I13
def predict_batch(model: PipelineModel, df: DataFrame, features: list[str], target: str | None = None,
                  keys: list[str] | None = None) -> DataFrame:
    """Label index + confidence (max class probability) for every row."""
    d = df.select(*(keys or []), *[F.coalesce(nan_to_null(F.col(c)), F.lit(0.0)).alias(c) for c in features],
                  (F.col(target).cast("string") if target else F.lit("0")).alias(target or "_t"))
    if not target:
        d = d.withColumnRenamed("_t", "_target")
    stages = model.stages
    labels = stages[0].labels
    pm = PipelineModel(stages=stages[1:])          # scoring does not need the label indexer
    out = pm.transform(d)
    lab = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1)
    conf = F.array_max(vector_to_array("probability")) if "probability" in out.columns else F.lit(None).cast("double")
    return out.select(*(keys or []), lab.alias("predicted_label"), conf.alias("confidence"))


def model_importance(model: PipelineModel, features: list[str]) -> DataFrame:
    """Tree importances, or absolute coefficients (mean over classes) for linear models."""
    est = model.stages[-1]
    if hasattr(est, "featureImportances"):
        vals = est.featureImportances.toArray().tolist()
        kind = "tree_importance"
    elif hasattr(est, "coefficientMatrix"):
        cm = est.coefficientMatrix.toArray()
        vals = [float(abs(cm[:, j]).mean()) for j in range(cm.shape[1])]
        kind = "abs_coefficient"
    else:
        vals, kind = [None] * len(features), "none"
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    rows = [(f, i, float(v) if v is not None else None, kind) for i, (f, v) in enumerate(zip(features, vals))]
    return spark.createDataFrame(rows, "feature string, position int, importance double, kind string") \
        .orderBy(F.desc_nulls_last("importance"), "position")


def linear_attributions(df: DataFrame, features: list[str], coef: dict[str, float], keys: list[str],
                        top: int = 10) -> tuple[DataFrame, DataFrame]:
    """Exact per-row contributions of a linear score: beta_j * (x_j - mean_j). Returns the
    long per-row table and the global mean |contribution| per feature with ranks (top k)."""
    means = df.agg(*[F.avg(nan_to_null(F.col(c))).alias(c) for c in features]).first()
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"),
                 (F.lit(float(coef[c])) * (F.coalesce(nan_to_null(F.col(c)), F.lit(means[c])) - F.lit(means[c]))).alias("contribution"))
        for c in features])).alias("r")).select(*keys, "r.*")
    from pyspark.sql.window import Window
    glob = long.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))
    glob = glob.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs_contribution"), "feature"))) \
        .where(F.col("rank") <= top)
    return long, glob


def what_if(model: PipelineModel, rows: DataFrame, features: list[str], feature: str, grid: int = 20,
            keys: list[str] | None = None) -> DataFrame:
    """Response curve of P(class 1) (or max probability) when `feature` sweeps `grid` evenly spaced
    values between its min and max over `rows`; per row: sensitivity (max - min) and best value."""
    st = rows.agg(F.min(feature).alias("lo"), F.max(feature).alias("hi")).first()
    spark = rows.sparkSession
    g = spark.range(grid).select((F.lit(st["lo"]) + (F.lit(st["hi"]) - F.lit(st["lo"])) * F.col("id") / F.lit(max(grid - 1, 1)))
                                 .alias("_v"))
    x = rows.select(*(keys or []), *[c for c in features if c != feature]).crossJoin(F.broadcast(g))  # rows x grid (parameter)
    x = x.withColumn(feature, F.col("_v"))
    pm = PipelineModel(stages=model.stages[1:])
    out = pm.transform(x.select(*(keys or []), "_v", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]))
    p = vector_to_array("probability")
    score = F.when(F.size(p) == 2, p[1]).otherwise(F.array_max(p))
    curve = out.select(*(keys or []), F.col("_v").alias("value"), score.alias("score"))
    return curve.groupBy(*(keys or [])).agg(F.min("score").alias("min_score"), F.max("score").alias("max_score"),
                                            F.max_by("value", "score").alias("best_value")) \
        .withColumn("sensitivity", F.col("max_score") - F.col("min_score"))


# ------------------------------------------------------------------ I6 / I9
def voting(preds: DataFrame, key: list[str], model: str = "model", prob: str = "p", weights: dict | None = None,
           threshold: float = 0.5) -> DataFrame:
    """Weighted soft vote (mean probability of class 1) and hard majority vote per row over a
    long predictions table (key..., model, p); hard ties go to class 1."""
    w = F.lit(1.0)
    if weights:
        w = F.coalesce(F.element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]),
                                    F.col(model)), F.lit(0.0))
    vote = (F.col(prob) >= threshold).cast("double")
    g = preds.groupBy(*key).agg((F.sum(w * F.col(prob)) / F.sum(w)).alias("soft_p"), (F.sum(w * vote) / F.sum(w)).alias("_hv"))
    return g.select(*key, "soft_p", (F.col("soft_p") >= threshold).cast("int").alias("soft_label"),
                    (F.col("_hv") >= 0.5).cast("int").alias("hard_label"))


def soft_targets(df: DataFrame, probs: str = "probs", T: float = 4.0) -> DataFrame:
    """Temperature-softened class probabilities: p^(1/T) renormalised (array column in, out)."""
    s = F.transform(F.col(probs), lambda p: F.pow(p, F.lit(1.0 / T)))
    tot = F.aggregate(s, F.lit(0.0), lambda a, b: a + b)
    return df.withColumn("soft_" + probs, F.transform(s, lambda p: p / tot))
