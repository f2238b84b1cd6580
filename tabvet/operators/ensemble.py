"""Ensembles and feature selection by models: stacking (I7), models by region (I8), recursive elimination (F14), feature vote.

Every fit reads one stored table whose rows carry their fold, so the folds are the same for all models and nothing is
computed again for each fit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabvet.operators.forest import CellForestClassifier
from tabvet.operators.train import _clean, fold_column, stored, train
from tabvet.operators.longform import exact_quantiles
from tabvet.session import materialize


def class_probabilities(model: PipelineModel, rows: DataFrame, classes: list[str]) -> DataFrame:
    """rows with probs: a probability for each of `classes`, in their order, 0 for a class that the model has not seen.

    Models without probabilities (support vectors, one against the rest) give 1 to the predicted class."""
    scored = PipelineModel(stages=model.stages[1:]).transform(rows)
    own = list(model.stages[0].labels)
    if "probability" in scored.columns:
        p = vector_to_array("probability")
        probs = [p[own.index(c)] if c in own else F.lit(0.0) for c in classes]
    else:
        probs = [F.when(F.col("prediction") == own.index(c), 1.0).otherwise(0.0) if c in own else F.lit(0.0) for c in classes]
    return scored.select(*rows.columns, F.array(*probs).alias("probs"))


def best_class(probs: Column, classes: list[str]) -> Column:
    """The class with the greatest probability, ties to the first."""
    at = F.array_position(probs, F.array_max(probs)).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in classes]), at)


# ------------------------------------------------------------------ I7
@dataclass
class Stack:
    """A fitted stack: base models by name, the meta model over their probabilities, and the classes in order."""
    bases: dict[str, PipelineModel]
    meta: object
    classes: list[str]
    features: list[str]
    target: str

    def predict(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """keys and the predicted class of every row."""
        rows = _clean(df.withColumn(self.target, F.lit(self.classes[0])), self.features, self.target)
        for name, model in self.bases.items():
            rows = class_probabilities(model, rows, self.classes).withColumnRenamed("probs", f"_p_{name}")
        rows = rows.withColumn("_meta", meta_features(list(self.bases), self.classes))
        out = self.meta.transform(assembled(rows))
        return out.select(*keys, class_of(F.col("prediction"), self.classes).alias("predicted"))


def class_of(index: Column, classes: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in classes]), index.cast("int") + 1)


def meta_features(names: list[str], classes: list[str]) -> Column:
    return F.concat(*[F.col(f"_p_{n}") for n in names])


def assembled(rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn("features", array_to_vector("_meta")).drop("_meta")


def out_of_fold(d: DataFrame, names: list[str], features: list[str], target: str, keys: list[str], k: int, classes: list[str]) -> DataFrame:
    """keys, target, _fold and _p_<name>, the probabilities of each family by the model that was fitted without the row's fold.

    d is a stored table with _fold. Each fold's rows are scored by the families one after the other, so no join puts the
    columns together."""
    folds = None
    for f in range(k):
        rows = d.where(F.col("_fold") == f)
        for name in names:
            model = train(name, d.where(F.col("_fold") != f), features, target, len(classes))
            rows = class_probabilities(model, rows, classes).withColumnRenamed("probs", f"_p_{name}")
        folds = rows if folds is None else folds.unionByName(rows)
    return materialize(folds.select(*keys, target, "_fold", *[f"_p_{n}" for n in names]))


def _meta_model(n_classes: int, trees: int, depth: int):
    gbt = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.1, seed=42)
    return gbt if n_classes <= 2 else OneVsRest(classifier=gbt)


def stacking(df: DataFrame, features: list[str], target: str, keys: list[str], names: list[str], k: int = 3, top: int = 3,
             trees: int = 40, depth: int = 2) -> tuple[Stack, DataFrame]:
    """(the fitted stack, model / kind / accuracy / f1 of bases and stack).

    The `top` families by out-of-fold F1 become the bases; boosted trees learn from their out-of-fold probabilities and
    are scored on folds that neither they nor the bases have seen. The returned stack is fitted on all rows."""
    d = stored(fold_column(_clean(df, features, target), keys, k))
    classes = sorted(r[0] for r in d.select(target).where(F.col(target).isNotNull()).distinct().collect())
    d = d.where(F.col(target).isNotNull())
    oof = out_of_fold(d, names, features, target, keys, k, classes)
    label = (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(target)) - 1).cast("double")
    oof = oof.withColumn("label", label)
    rows = [(n, "base", *_scores(oof.withColumn("prediction", (F.array_position(f"_p_{n}", F.array_max(f"_p_{n}")) - 1).cast("double")))) for n in names]
    chosen = [r[0] for r in sorted(rows, key=lambda r: (-r[3], r[0]))[:top]]
    ready = materialize(assembled(oof.withColumn("_meta", meta_features(chosen, classes))).select(*keys, "_fold", "label", "features"))
    held = None
    for f in range(k):
        meta = _meta_model(len(classes), trees, depth).fit(ready.where(F.col("_fold") != f))
        part = meta.transform(ready.where(F.col("_fold") == f)).select("label", "prediction")
        held = part if held is None else held.unionByName(part)
    rows.append(("stack", "stack", *_scores(held)))
    stack = Stack({n: train(n, d, features, target, len(classes)) for n in chosen}, _meta_model(len(classes), trees, depth).fit(ready), classes, features, target)
    return stack, df.sparkSession.createDataFrame(rows, "model string, kind string, accuracy double, f1 double")


def _scores(pred: DataFrame) -> tuple[float, float]:
    return tuple(float(MulticlassClassificationEvaluator(metricName=m).evaluate(pred)) for m in ("accuracy", "f1"))


# ------------------------------------------------------------------ I8
@dataclass
class Regions:
    """Fitted regions: the clustering (kept, so that new rows meet the same centres), the models, and for each region the
    name of the model that scored best there; regions without training rows are absent."""
    clusters: PipelineModel
    models: dict[str, PipelineModel]
    best: dict[int, str]
    classes: list[str]
    features: list[str]
    target: str

    def predict(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """keys, region, model (the one that answers; `vote` in a region without a best one) and predicted class."""
        rows = _clean(df.withColumn(self.target, F.lit(self.classes[0])), self.features, self.target)
        rows = self.clusters.transform(rows).select(*rows.columns, "region")
        rows = _predicted(rows, self.models, self.classes)
        names = list(self.models)
        model = F.lit("vote")
        for region, name in self.best.items():
            model = F.when(F.col("region") == region, name).otherwise(model)
        said = [F.col(f"_c_{n}") for n in names]
        votes = [sum((F.when(s == c, 1).otherwise(0) for s in said), F.lit(0)) for c in self.classes]
        # most votes, ties to the first class in order
        vote = best_class(F.array(*votes), self.classes)
        answer = vote
        for n in names:
            answer = F.when(F.col("model") == n, F.col(f"_c_{n}")).otherwise(answer)
        return rows.withColumn("model", model).select(*keys, "region", "model", answer.alias("predicted"))


def _predicted(rows: DataFrame, models: dict[str, PipelineModel], classes: list[str]) -> DataFrame:
    for name, model in models.items():
        rows = class_probabilities(model, rows, classes).withColumn(f"_c_{name}", best_class(F.col("probs"), classes)).drop("probs")
    return rows


def region_models(df: DataFrame, features: list[str], target: str, names: list[str], k: int = 3, seed: int = 42) -> tuple[Regions, DataFrame]:
    """I8: (the fitted regions, the score table region / model / rows / accuracy / chosen).

    Rows are clustered on standardised features, every family is fitted on all rows and scored in each region; rows are then
    routed to the family that is most accurate in their region (ties to the first name)."""
    d = stored(_clean(df, features, target).where(F.col(target).isNotNull()))
    classes = sorted(r[0] for r in d.select(target).distinct().collect())
    stages = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
              KMeans(k=k, seed=seed, featuresCol="_scaled", predictionCol="region")]
    clusters = Pipeline(stages=stages).fit(d)
    models = {n: train(n, d, features, target, len(classes)) for n in names}
    rows = _predicted(clusters.transform(d).select(*d.columns, "region"), models, classes)
    hits = [F.avg(F.when(F.col(f"_c_{n}") == F.col(target), 1.0).otherwise(0.0)).alias(n) for n in names]
    table = rows.groupBy("region").agg(F.count(F.lit(1)).alias("rows"), *hits).collect()  # k rows
    best = {r.region: min(names, key=lambda n: (-r[n], n)) for r in table}
    scores = [(r.region, n, r["rows"], float(r[n]), best[r.region] == n) for r in table for n in names]
    spark = df.sparkSession
    return Regions(clusters, models, best, classes, features, target), spark.createDataFrame(scores, "region int, model string, rows long, accuracy double, chosen boolean")


# ------------------------------------------------------------------ F14
Importance = Callable[[DataFrame, list[str]], dict[str, float]]
Score = Callable[[DataFrame, DataFrame, list[str]], float]


def forest_importance(classes: int | None, trees: int = 50, depth: int = 5, seed: int = 42) -> Importance:
    """Importances of a random forest on rows with `label`; a regressor where classes is None."""
    def of(rows: DataFrame, features: list[str]) -> dict[str, float]:
        model = _forest(classes, trees, depth, seed).fit(VectorAssembler(inputCols=features, outputCol="features").transform(rows))
        return dict(zip(features, model.featureImportances.toArray().tolist()))

    return of


def forest_score(classes: int | None, trees: int = 50, depth: int = 5, seed: int = 42) -> Score:
    """Accuracy, or the coefficient of determination, on the second rows of a forest fitted on the first."""
    def of(rows: DataFrame, held: DataFrame, features: list[str]) -> float:
        stage = VectorAssembler(inputCols=features, outputCol="features")
        out = _forest(classes, trees, depth, seed).fit(stage.transform(rows)).transform(stage.transform(held))
        return held_score(out, classes is not None)

    return of


def held_score(out: DataFrame, classes: bool) -> float:
    y, p = F.col("label"), F.col("prediction")
    if classes:
        return float(out.agg(F.avg(F.when(y == p, 1.0).otherwise(0.0))).first()[0] or 0.0)
    r = out.agg(F.sum(F.pow(y - p, F.lit(2.0))), F.var_pop(y) * F.count(y)).first()
    return 1.0 - r[0] / r[1] if r[1] else 0.0


def _forest(classes: int | None, trees: int, depth: int, seed: int):
    kind = RandomForestRegressor if classes is None else CellForestClassifier
    return kind(numTrees=trees, maxDepth=depth, seed=seed)


def _gram(rows: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Means, covariance of the features, covariance with the label, label mean: two passes, the second centred."""
    means = rows.agg(*[F.avg(c) for c in [*features, "label"]]).first()
    c = [F.col(f) - F.lit(m) for f, m in zip([*features, "label"], means)]
    p = len(features)
    sums = rows.agg(*[F.avg(c[i] * c[j]) for i in range(p + 1) for j in range(i, p + 1)]).first()
    full, at = np.zeros((p + 1, p + 1)), 0
    for i in range(p + 1):
        for j in range(i, p + 1):
            full[i, j] = full[j, i] = sums[at]
            at += 1
    return np.array(means[:p], float), full[:p, :p], full[:p, p], float(means[p])


def linear_importance(rows: DataFrame, features: list[str]) -> dict[str, float]:
    """Absolute standardised coefficients of least squares on `label`."""
    _, cov, with_y, _ = _gram(rows, features)
    beta = np.linalg.lstsq(cov, with_y, rcond=None)[0]
    return {f: float(abs(b) * np.sqrt(max(v, 0.0))) for f, b, v in zip(features, beta, np.diag(cov))}


def linear_score(rows: DataFrame, held: DataFrame, features: list[str]) -> float:
    """Coefficient of determination on `held` of least squares fitted on `rows`."""
    means, cov, with_y, y0 = _gram(rows, features)
    beta = np.linalg.lstsq(cov, with_y, rcond=None)[0]
    prediction = sum((F.lit(float(b)) * (F.col(f) - F.lit(float(m))) for f, b, m in zip(features, beta, means)), F.lit(y0))
    return held_score(held.withColumn("prediction", prediction), False)


def rfe(df: DataFrame, features: list[str], target: Column, keys: list[str], n: int = 10, k: int = 3,
        importance: Importance = linear_importance, score: Score = linear_score, standardise: bool = True) -> DataFrame:
    """recursive elimination: feature, rank, selected, round (in which it went, NULL if kept), importance (in its last
    fit), score_before (all features) and score_after (the kept ones), means over the k folds.

    target is numeric (a class number for classifiers) and becomes `label`; missing feature values become the exact median,
    rows without a target are left out. At least one feature goes, as min(n, features - 1) stay. Each round fits on the
    whole stored table and drops the least important feature, ties the last in order; ranks: 1 kept, 2 the last to go."""
    medians = {r["column"]: r["quantile"] for r in exact_quantiles(_long(df, features), [0.5]).collect()}
    filled = df.where(target.isNotNull()).select(*keys, target.cast("double").alias("label"), *[
        F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(medians.get(c, 0.0))).alias(c) for c in features])
    if standardise:
        stats = filled.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
        filled = filled.select(*keys, "label", *[((F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0)).alias(c) for c in features])
    d = stored(fold_column(filled, keys, k))

    def cross_score(chosen: list[str]) -> float:
        return float(np.mean([score(d.where(F.col("_fold") != f), d.where(F.col("_fold") == f), chosen) for f in range(k)]))

    keep = min(n, len(features) - 1)
    left, gone, value = list(features), [], {}
    while len(left) > keep:
        value |= importance(d, left)
        worst = max(range(len(left)), key=lambda i: (-value[left[i]], i))
        gone.append(left.pop(worst))
    value |= importance(d, left)
    before, after = cross_score(list(features)), cross_score(left)
    rows = [(f, 1 if f in left else len(gone) - gone.index(f) + 1, f in left, None if f in left else gone.index(f) + 1, value[f], before, after) for f in features]
    return df.sparkSession.createDataFrame(rows, "feature string, rank int, selected boolean, round int, importance double, score_before double, score_after double")


def _long(df: DataFrame, features: list[str]) -> DataFrame:
    from tabvet.operators.longform import unpivot

    return unpivot(df, features)


# ------------------------------------------------------------------ F13
def feature_vote(scores: DataFrame, percentile: float = 0.3) -> DataFrame:
    """vote of three rankings over scores(feature, importance, permutation, f_score).

    importance and permutation are divided by their sum, f_score is scaled to 0..1, each with 1e-10 in the denominator; the
    vote is their mean. Features at or above the exact `percentile` of the votes (linear interpolation) are selected; rank
    1 is the highest vote, ties by name. NULL scores count as 0. One row a feature."""
    eps = F.lit(1e-10)
    s = scores.select("feature", *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0)).alias(c) for c in ("importance", "permutation", "f_score")])
    every = Window.partitionBy()
    vote = (F.col("importance") / (F.sum("importance").over(every) + eps) + F.col("permutation") / (F.sum("permutation").over(every) + eps)
            + (F.col("f_score") - F.min("f_score").over(every)) / (F.max("f_score").over(every) - F.min("f_score").over(every) + eps)) / 3
    voted = s.select("feature", vote.alias("vote"))
    cut = voted.agg(F.percentile("vote", percentile).alias("threshold"))
    out = voted.crossJoin(F.broadcast(cut))  # one row
    return out.select("feature", "vote", "threshold", (F.col("vote") >= F.col("threshold")).alias("selected"),
                      F.row_number().over(Window.orderBy(F.desc("vote"), "feature")).alias("rank"))
