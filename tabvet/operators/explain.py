"""Explanations of a scorer: permutation importance (H9), Shapley attributions of tree models (I12), counterfactuals.

A scorer is a function DataFrame -> DataFrame that adds the column `prediction` (numeric) to rows that hold the feature
columns; `model_scorer` makes one of a fitted pipeline, `linear_scorer` one of given coefficients.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabvet.functions.core import nan_to_null
from tabvet.operators.longform import row_numbers
from tabvet.session import checkpoint_dir

Scorer = Callable[[DataFrame], DataFrame]


def linear_scorer(coef: dict[str, float], intercept: float = 0.0, threshold: float | None = None) -> Scorer:
    """intercept + sum of coefficient * feature; with a threshold, 1 where the sum reaches it, else 0."""
    score = sum((F.lit(float(b)) * F.col(c).cast("double") for c, b in coef.items()), F.lit(float(intercept)))
    out = score if threshold is None else F.when(score >= threshold, 1.0).otherwise(0.0)
    return lambda df: df.withColumn("prediction", out)


def model_scorer(model: PipelineModel, features: list[str]) -> Scorer:
    """The prediction of a pipeline whose first stage indexes the target."""
    scoring = PipelineModel(stages=model.stages[1:])

    def score(df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c not in features]
        ready = df.select(*kept, *[F.coalesce(nan_to_null(F.col(c)), F.lit(0.0)).alias(c) for c in features])
        return scoring.transform(ready).select(*df.columns, "prediction")

    return score


# ------------------------------------------------------------------ H9
def _metric(metric: str, y: Column, p: Column) -> Column:
    """accuracy, or the coefficient of determination from sums around the mean target."""
    if metric == "accuracy":
        return F.avg(F.when(y == p, 1.0).otherwise(0.0))
    if metric == "r2":
        return 1.0 - F.sum(F.pow(y - p, F.lit(2.0))) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))
    if metric == "neg_mse":
        return -F.avg(F.pow(y - p, F.lit(2.0)))
    raise ValueError(metric)


def permuted_rows(df: DataFrame, features: list[str], keep: list[str], order: list[Column], shuffles: list[Column]) -> DataFrame:
    """For every repeat r, each row with the features of another: (keep..., features..., repeat, other_<feature>...).

    Rows are numbered once in `order` and once in the order of each of `shuffles`; row i takes the features of the row
    that the shuffle puts at i. Both numberings are dense, so each repeat is a permutation of the rows and the join is one
    to one."""
    cols = list(dict.fromkeys([*keep, *features]))
    keyed = df.select(*cols, *[o.alias(f"_k{i}") for i, o in enumerate(order)], *[s.alias(f"_s{r}") for r, s in enumerate(shuffles)])
    numbered = row_numbers(keyed, [F.col(f"_k{i}") for i in range(len(order))], "_row", [*cols, *[f"_s{r}" for r in range(len(shuffles))]])
    others = None
    for r in range(len(shuffles)):
        other = row_numbers(numbered.select(*features, "_row", f"_s{r}"), [F.col(f"_s{r}"), F.col("_row")], "_at", features)
        other = other.select(F.lit(r).alias("repeat"), F.col("_at"), *[F.col(c).alias(f"other_{c}") for c in features])
        others = other if others is None else others.unionByName(other)
    rows = numbered.select(*cols, "_row")
    return rows.join(others, rows["_row"] == others["_at"]).drop("_row", "_at")


def permutation_importance(score: Scorer, df: DataFrame, features: list[str], target: str, order: list[Column],
                           shuffles: list[Column], metric: str = "accuracy") -> DataFrame:
    """H9: drop of the metric when one feature's values change places among all rows.

    feature, baseline, importance_mean, importance_std (population) over the repeats, one repeat for each of `shuffles`
    (Columns by which the rows are sorted for that repeat). All features and repeats are scored in one plan: each row is
    given once per feature and repeat, and one aggregate makes the metrics. NULL targets are left out."""
    rows = df.where(F.col(target).isNotNull())
    baseline = score(rows).agg(_metric(metric, F.col(target), F.col("prediction")).alias("baseline"))
    pairs = permuted_rows(rows, features, [target], order, shuffles)
    variants = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), *[(F.col(f"other_{c}") if c == f else F.col(c)).cast("double").alias(c) for c in features])
        for f in features]))
    given = pairs.select(F.col(target).alias("_y"), "repeat", variants.alias("v")).select("_y", "repeat", "v.*")
    scored = score(given).groupBy("feature", "repeat").agg(_metric(metric, F.col("_y"), F.col("prediction")).alias("score"))
    drops = scored.crossJoin(F.broadcast(baseline))          # one row
    return drops.groupBy("feature", "baseline").agg(F.avg(F.col("baseline") - F.col("score")).alias("importance_mean"),
                                                    F.stddev_pop(F.col("baseline") - F.col("score")).alias("importance_std"))


# ------------------------------------------------------------------ I12 on tree models
@dataclass
class Leaf:
    """A leaf's value and, for each different feature on its path, the interval it needs and the share of training rows
    that the path keeps at this feature's splits."""
    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def tree_leaves(model, output: int = 1) -> list[Leaf]:
    """Leaves of a fitted Spark ML tree model (decision tree, random forest or boosted trees; numeric splits).

    Reads the node table that the model writes: it has at most trees * 2^(depth + 1) rows, which `maxDepth` bounds.
    Values are the share of class `output` for classifiers, the prediction for regressors and boosted trees, times the
    tree's weight in the ensemble."""
    spark = SparkSession.getActiveSession()
    path = f"{checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "treeID" not in nodes.columns:
        nodes = nodes.select(F.lit(0).alias("treeID"), F.struct(*nodes.columns).alias("nodeData"))
    trees: dict[int, dict[int, object]] = defaultdict(dict)
    for r in nodes.collect():
        trees[r.treeID][r.nodeData.id] = r.nodeData
    boosted = hasattr(model, "treeWeights") and type(model).__name__.startswith("GBT")
    weights = list(model.treeWeights) if boosted else [1.0 / len(trees)] * len(trees)
    classifier = type(model).__name__.endswith("ClassificationModel") and not boosted
    found: list[Leaf] = []
    for tree, table in trees.items():
        stack = [(0, {})]
        while stack:
            at, path_of = stack.pop()
            n = table[at]
            if n.leftChild < 0:
                value = n.impurityStats[output] / sum(n.impurityStats) if classifier else n.prediction
                f = sorted(path_of)
                low, high, share = (np.array([path_of[j][k] for j in f], float) for k in range(3))
                found.append(Leaf(weights[tree] * value, np.array(f, int), low, high, share))
                continue
            if n.split.numCategories != -1:
                raise ValueError("categorical splits are not supported: index such columns as numbers without metadata")
            j, limit = n.split.featureIndex, n.split.leftCategoriesOrThreshold[0]
            low, high, share = path_of.get(j, (-np.inf, np.inf, 1.0))
            # rows that reach a node: the class counts (or the number of rows) that its impurity was made from
            cover = {c: _cover(table[c], classifier) for c in (n.leftChild, n.rightChild)}
            total = sum(cover.values())
            stack.append((n.leftChild, path_of | {j: (low, min(high, limit), share * cover[n.leftChild] / total)}))
            stack.append((n.rightChild, path_of | {j: (max(low, limit), high, share * cover[n.rightChild] / total)}))
    return found


def _cover(node, classifier: bool) -> float:
    return float(sum(node.impurityStats)) if classifier else float(node.impurityStats[0])


def shapley(leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    """Exact path-dependent Shapley values of the leaves' sum, a row for each row of x, a column for each feature.

    For one leaf the game of a feature set S is value * prod(inside_j, j in S) * prod(share_j, j not in S). The Shapley
    weight |S|! (d - |S| - 1)! / d! is the integral of t^|S| (1 - t)^(d - |S| - 1) over 0..1, so a feature's value is
    (inside_i - share_i) times the integral of prod over j <> i of (inside_j t + share_j (1 - t)): a polynomial of degree
    d - 1, which Gauss-Legendre with (d + 1) // 2 points integrates exactly."""
    out = np.zeros(x.shape)
    for leaf in leaves:
        d = len(leaf.features)
        if not d:
            continue
        values = x[:, leaf.features]
        inside = (values > leaf.low) & (values <= leaf.high)                            # rows x d
        if d <= 10:  # a row's values depend on its pattern of inside alone: at most 2^d of them
            every = (np.arange(2**d)[:, None] >> np.arange(d) & 1).astype(bool)
            out[:, leaf.features] += leaf_values(leaf, every)[inside @ (1 << np.arange(d))]
        else:
            out[:, leaf.features] += leaf_values(leaf, inside)
    return out


def leaf_values(leaf: Leaf, inside: np.ndarray) -> np.ndarray:
    """Shapley values of one leaf's game for patterns of inside, a row each."""
    points, weights = np.polynomial.legendre.leggauss((len(leaf.features) + 1) // 2)
    t, w = (points + 1) / 2, weights / 2
    inside = inside.astype(float)
    factors = inside[:, :, None] * t + leaf.share[None, :, None] * (1 - t)              # rows x d x points
    one = np.ones_like(factors[:, :1])
    ahead = np.cumprod(np.concatenate([one, factors[:, :-1]], axis=1), axis=1)
    behind = np.cumprod(np.concatenate([one, factors[:, :0:-1]], axis=1), axis=1)[:, ::-1]
    return leaf.value * (inside - leaf.share) * ((ahead * behind) @ w)


KNOWN_VALUES = 1 << 22  # Shapley values that a task keeps


class Cells:
    """`shapley` of many rows, made once for each cell of the leaves' limits that a task meets.

    A leaf asks of a feature only which of the trees' limits it passes, so rows between the same limits have the same
    values; a cell's values are made from its first row and kept, at most `KNOWN_VALUES` numbers."""

    def __init__(self, leaves: list[Leaf], width: int):
        self.leaves, self.width = leaves, width
        limits: list[set[float]] = [set() for _ in range(width)]
        for leaf in leaves:
            for j, low, high in zip(leaf.features, leaf.low, leaf.high):
                limits[j] |= {float(v) for v in (low, high) if np.isfinite(v)}
        self.limits = [np.array(sorted(v)) for v in limits]
        self.sizes = [len(v) + 2 for v in self.limits]  # the last: NaN, which no interval holds
        self.numbered = math.prod(self.sizes) < 2**62
        self.known, self.values = np.zeros(0, np.int64), np.zeros((0, width))

    def of(self, x: np.ndarray) -> np.ndarray:
        passed = [np.where(np.isnan(v), len(c) + 1, np.searchsorted(c, v)) for c, v in zip(self.limits, x.T)]
        if not self.numbered:
            _, first, cell = np.unique(np.stack(passed, axis=1), axis=0, return_index=True, return_inverse=True)
            return self._made(x[first])[cell.reshape(-1)]
        number = np.zeros(len(x), np.int64)
        for at, size in zip(passed, self.sizes):
            number = number * size + at
        number, first, cell = np.unique(number, return_index=True, return_inverse=True)
        new = ~np.isin(number, self.known, assume_unique=True)
        if len(self.known) and (len(self.known) + new.sum()) * self.width > KNOWN_VALUES:
            self.known, self.values, new = self.known[:0], self.values[:0], np.ones(len(number), bool)
        known = np.concatenate([self.known, number[new]])
        values = np.concatenate([self.values, self._made(x[first[new]])])
        order = np.argsort(known)
        self.known, self.values = known[order], values[order]
        return self.values[np.searchsorted(self.known, number)][cell]

    def _made(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros((0, self.width)), *[shapley(self.leaves, x[i : i + 4096]) for i in range(0, len(x), 4096)]])


def expected(leaves: list[Leaf]) -> float:
    """The score without any feature known: leaf values by the share of rows that reach them."""
    return float(sum(leaf.value * leaf.share.prod() for leaf in leaves))


def tree_attributions(model: PipelineModel, df: DataFrame, features: list[str], keys: list[str], output: int = 1) -> DataFrame:
    """Keys, expected, score and contributions (array in the order of features) for every row.

    model is a pipeline of target index, assembler, scaler and a tree model; missing values count as 0, as in its
    training. The leaves are a bounded table and travel with the tasks; rows stay where they are. expected and a row's
    contributions add up to its score: the probability of class `output`, a regressor's prediction, or the margin of
    boosted trees."""
    leaves = tree_leaves(model.stages[-1], output)
    base = expected(leaves)
    ready = df.select(*keys, *[F.coalesce(nan_to_null(F.col(c)), F.lit(0.0)).alias(c) for c in features if c not in keys])
    rows = PipelineModel(stages=model.stages[1:-1]).transform(ready).select(*keys, vector_to_array("features").alias("_x"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)])
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(leaves, width)
        for batch in batches:
            x = batch.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            values = cells.of(x)
            ends = pa.array(np.arange(0, values.size + 1, width, dtype=np.int32))
            found = [pa.array(np.full(len(x), base)), pa.array(base + values.sum(axis=1)), pa.ListArray.from_arrays(ends, pa.array(values.reshape(-1)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *found], [*keys, "expected", "score", "contributions"])

    return rows.mapInArrow(run, f"{kinds}, expected double, score double, contributions array<double>")


def global_attributions(rows: DataFrame, features: list[str]) -> DataFrame:
    """feature, mean_abs_contribution, mean_contribution and rank over the rows of `tree_attributions`."""
    long = rows.select(F.posexplode("contributions").alias("position", "value"))
    names = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("position") + 1)
    g = long.groupBy(names.alias("feature")).agg(F.avg(F.abs("value")).alias("mean_abs_contribution"), F.avg("value").alias("mean_contribution"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs_contribution"), "feature")))


# ------------------------------------------------------------------ I14
def lattice(features: list[str], steps: list[float], most: int = 2) -> list[dict[str, float]]:
    """Changes of at most `most` features, each by one of `steps` standard deviations; without change comes first."""
    moves = [s for s in steps if s]
    found: list[dict[str, float]] = [{}]
    for size in range(1, most + 1):
        for chosen in itertools.combinations(features, size):
            found += [dict(zip(chosen, by)) for by in itertools.product(moves, repeat=size)]
    return found


def counterfactuals(score: Scorer, df: DataFrame, features: list[str], keys: list[str], desired: float | None = None,
                    steps: list[float] | None = None, most: int = 2, scale: dict[str, float] | None = None) -> DataFrame:
    """For every row the cheapest change of its features that gives the desired class.

    Candidates are `lattice(features, steps, most)`, in units of `scale` (standard deviations unless given); cost is the
    sum of the absolute steps, ties go to the candidate that comes first in the lattice. Without `desired`, any class other
    than the row's own is looked for. Returns keys, original_class, achieved_class, success, cost, candidate (its number)
    and the features of the counterfactual, cf_<feature>; a row that no candidate changes keeps its features, with
    success false and a NULL cost.

    The lattice is a literal whose size the parameters fix: rows are expanded where they lie, scored as a stream and
    reduced on the map side, so a task holds the best candidate of a row, not its candidates. The order of preference is
    fixed as well, so the best one is the smallest of plain numbers, which needs no sort. Keys need not be unique."""
    candidates = lattice(features, steps or [-2.0, -1.0, -0.5, 0.5, 1.0, 2.0], most)
    x = df.select(*keys, *[F.coalesce(nan_to_null(F.col(c)), F.lit(0.0)).alias(c) for c in features])
    if scale is None:
        stats = x.agg(*[F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(c) for c in features]).first()
        scale = {c: float(stats[c]) for c in features}
    own = score(x).withColumnRenamed("prediction", "original_class").withColumn("_id", F.monotonically_increasing_id())
    costs = [float(sum(abs(s) for s in move.values())) for move in candidates]
    size, preferred = len(candidates), sorted(range(len(candidates)), key=lambda i: (costs[i], i))
    options = F.array(*[
        F.struct(F.lit(i).alias("candidate"), F.lit(preferred.index(i)).alias("place"),
                 *[(F.col(c) + F.lit(move.get(c, 0.0) * scale[c])).alias(c) for c in features])
        for i, move in enumerate(candidates)])
    kept = ["_id", *keys, "original_class", *[f"_x_{c}" for c in features]]
    own = own.withColumns({f"_x_{c}": F.col(c) for c in features})
    given = own.select(*kept, F.explode(options).alias("o")).select(*kept, "o.*")
    scored = score(given)
    reached = F.col("prediction") == F.lit(float(desired)) if desired is not None else F.col("prediction") != F.col("original_class")
    # unknown, then reached by cost, then missed; candidates in order where the cost does not count
    code = F.when(reached, F.col("place")).when(~reached, F.col("candidate") + size).otherwise(F.col("candidate") - size)
    best = scored.withColumn("_code", code).groupBy(*kept).agg(F.min("_code").alias("_code"), F.min_by("prediction", "_code").alias("_class"))
    every = list(range(size))

    def of(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in values]), F.col("candidate") + 1)

    best = best.withColumn("candidate", F.element_at(F.array(*[F.lit(i) for i in [*every, *preferred, *every]]), F.col("_code") + size + 1))
    hit = F.when(F.col("_code") >= 0, F.col("_code") < size)
    return best.select(*keys, "original_class", F.col("_class").alias("achieved_class"), hit.alias("success"),
                       F.when(hit, of(costs)).alias("cost"), "candidate",
                       *[(F.col(f"_x_{c}") + of([move.get(c, 0.0) * scale[c] for move in candidates])).alias(f"cf_{c}") for c in features])
