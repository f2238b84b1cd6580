"""Quality classifier by positive-unlabelled learning (non-negative unbiased risk).

Trusted positives are texts labelled 1, unlabelled web text is the corpus itself, and the class prior is estimated as
the smoothed share of label 1 among labelled training texts. The model is additive over quantile bins of surface
features of the whole text (byte shares, repetition, word shape), a logistic score trained by minimising

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),

where a step that would make the bracket negative climbs back instead (the non-negative rule). Features are computed
once for all texts, stored, and scored where they lie; only a bounded sample of feature rows (`POSITIVES` positives and
`UNLABELLED` texts, the smallest hashes of the id) goes to the driver for the fit.

Learning uses only rows outside the held-out fold (crc32(doc_id as text) mod 5 is 0). Inputs of a score are the text's
features and nothing else.

Defined results: null text counts as empty, and empty texts get a score like any other; labels that are null or other
than 0 and 1 are not used, of repeated labels of a document the largest counts; without any positive or unlabelled
training text every score is the prior (0.5 without labels); repeated rows get equal scores; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.llm.common import TEXT_ROWS, fold, read, slices, text_or_empty
from tabvet.session import materialize

FOLDS = 5
POSITIVES, UNLABELLED = 12_000, 24_000
BINS = 10
THRESHOLD = 0.3
SHIFT = 1.5

_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]


def features(text: str) -> np.ndarray:
    """Surface features of a whole text."""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits, wide = of[65:91].sum(), of[97:123].sum(), of[48:58].sum(), of[128:].sum()
    words, lines = text.split(), text.split("\n")
    w = max(1, len(words))
    pairs = max(1, len(words) - 1)
    letters = max(1, upper + lower + wide)
    shape = [
        np.log1p(len(words)), np.log1p(len(raw)), (n - of[32] - of[10]) / w, upper / letters, lower / n, digits / n, wide / n,
        of[_PUNCTUATION].sum() / n, of[32] / n, of[10] / n,
        len(set(words)) / w, sum(map(eq, words, words[1:])) / pairs, len(set(zip(words, words[1:]))) / pairs,
        len(set(lines)) / len(lines), w / len(lines), max(map(len, words), default=0),
    ]
    return np.array(shape + (of[_PUNCTUATION] / n).tolist(), dtype=np.float32)


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id, features for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = pa.array([features(t.as_py()) for t in batch.column(1)], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["doc_id", "features"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, features array<float>")


class Bins:
    """One-hot quantile bins of feature rows."""

    def __init__(self, rows: np.ndarray, bins: int = BINS):
        steps = np.linspace(0, 1, bins + 1)[1:-1]
        self.edges = []
        for column in rows.T:
            some = column[column > column.min()] if len(column) else column  # a share that is mostly zero still gets bins
            self.edges.append(np.unique(np.concatenate([[column.min()], np.quantile(some, steps)])) if len(some) else np.array([], np.float32))
        self.start = np.concatenate([[0], np.cumsum([len(e) + 1 for e in self.edges])])

    @property
    def width(self) -> int:
        return int(self.start[-1])

    def index(self, rows: np.ndarray) -> np.ndarray:
        """Column numbers of the ones, a row for each row."""
        return np.stack([s + np.searchsorted(e, c, side="left") for s, e, c in zip(self.start, self.edges, rows.T)], axis=1)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, width: int, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 1e-4) -> np.ndarray:
    """Weights and, last, the intercept of the additive model over one-hot column numbers.

    The intercept is finally shifted, by `SHIFT` at most, to bring the mean unlabelled score to the prior."""
    w = np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)

    def mean_gradient(index: np.ndarray, slope: np.ndarray) -> np.ndarray:
        g = np.bincount(index.ravel(), np.repeat(slope, index.shape[1]), minlength=width + 1)
        g[-1] = slope.sum()
        return g / len(index)

    for step in range(1, steps + 1):
        zp, zu = w[positive].sum(axis=1) + w[-1], w[unlabelled].sum(axis=1) + w[-1]
        up, uu = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))  # slopes of softplus(z)
        negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        negative = mean_gradient(unlabelled, uu) - prior * mean_gradient(positive, up)
        g = prior * mean_gradient(positive, up - 1) + negative if negative_risk >= 0 else -negative
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    z, shifts = w[unlabelled].sum(axis=1) + w[-1], np.linspace(-SHIFT, SHIFT, 61)
    w[-1] += min(shifts, key=lambda b: abs((1 / (1 + np.exp(-(z + b)))).mean() - prior))
    return w


def fit(table: DataFrame, labels: DataFrame) -> tuple[Bins | None, np.ndarray, float]:
    """(bins, weights, prior) from the rows outside the held-out fold."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    train = table.where(fold("doc_id", FOLDS) != 0)
    hashed = F.xxhash64("doc_id", F.lit(7))
    marked = train.join(known, "doc_id")
    n, ones = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum("quality"), F.lit(0))).first()
    prior = (ones + 1) / (n + 2)

    def sample(df: DataFrame, limit: int) -> np.ndarray:
        rows = df.select("features", hashed.alias("h")).orderBy("h").limit(limit).select("features").toArrow().column(0)
        return np.array(rows.to_pylist(), dtype=np.float32)

    positive = sample(marked.where("quality = 1"), POSITIVES)
    unlabelled = sample(train, UNLABELLED)
    if not len(positive) or not len(unlabelled):
        return None, np.zeros(1), prior
    bins = Bins(unlabelled)
    return bins, fit_nnpu(bins.index(positive), bins.index(unlabelled), bins.width, prior), prior


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text); labels(doc_id, quality) teach."""
    table = materialize(feature_table(docs), TEXT_ROWS)
    bins, w, prior = fit(table, labels.select(F.col("doc_id").cast("long"), "quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if bins is None or not batch.num_rows:
                scores = np.full(batch.num_rows, prior)
            else:
                rows = np.stack([np.asarray(x.values) for x in batch.column(1)])
                scores = 1 / (1 + np.exp(-(w[bins.index(rows)].sum(axis=1) + w[-1])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = table.mapInArrow(run, "doc_id long, score double")
    held_out = (fold("doc_id", FOLDS) == 0).alias("held_out")
    return scored.select("doc_id", held_out, "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs(doc_id, text, ...) whose text scores at least `threshold`, all columns as they are."""
    table = materialize(feature_table(docs), TEXT_ROWS)
    bins, w, prior = fit(table, labels.select(F.col("doc_id").cast("long"), "quality"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            good = np.full(batch.num_rows, prior >= threshold)
            if bins is not None and batch.num_rows:
                rows = np.stack([features(t.as_py() or "") for t in batch.column(at)])
                good = 1 / (1 + np.exp(-(w[bins.index(rows)].sum(axis=1) + w[-1]))) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
