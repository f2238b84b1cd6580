"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else is one space, and the 2- and 3-grams of the whole text are hashed into `DIMS`
dimensions, tf-idf weighted (document frequencies over ALL training texts) and scaled to a fixed total, so that a text's
scores are sums over its n-grams. The weights come from follow-the-regularised-leader (per-coordinate rates, elastic net
L1 + L2) over a bounded sample of training texts (`PER_CLASS` a language, chosen by hash of the id); a temperature is
then fitted on a fifth of that sample which the regression has not seen.

Learning uses only rows with a language outside the held-out fold (crc32(doc_id as text) mod 3 is 1).

Defined results: a null text, or one without a letter, is `und` with score 0; null languages teach nothing; without any
training row all texts are `und`; texts of any length are read whole; ties go to the first language by code point;
repeated rows get equal results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.llm.common import fold, read

FOLDS, HELD = 3, 1
DIMS = 1 << 15
PER_CLASS = 2_000
SCALE = 20.0


@cache
def letter_table() -> np.ndarray:
    """1 for each code point that is a letter."""
    return np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)], dtype=bool)


def grams(text: str | None) -> np.ndarray:
    """Hashed 2- and 3-grams of a whole text, in order; empty if it has no letter."""
    if not text:
        return np.zeros(0, np.int32)
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letters = letter_table()[code]
    if not letters.any():
        return np.zeros(0, np.int32)
    keep = letters.copy()
    keep[1:] |= letters[:-1]  # one space after each run of letters
    line = np.empty(int(keep.sum()) + 2, np.uint64)
    line[0] = line[-1] = 32
    line[1:-1] = np.where(letters, code, 32)[keep]
    two = line[:-1] * np.uint64(0x9E3779B97F4A7C15) + line[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two[:-1] * np.uint64(0x165667B19E3779F9) + line[2:] * np.uint64(0xD6E8FEB86659FD93)
    return (np.concatenate([two, three]) >> np.uint64(64 - 15)).astype(np.int32)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts each dimension occurs, and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS + 1, np.int64), 0
        seen = np.zeros(DIMS, bool)
        for batch in batches:
            for text in batch.column(0):
                seen[:] = False
                seen[grams(text.as_py())] = True
                df[:DIMS] += seen
                n += 1
        df[DIMS] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1), pa.int32()), pa.array(df)], ["dim", "n"])

    rows = texts.select("text").mapInArrow(run, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(DIMS + 1, np.int64)
    out[rows.column("dim").to_numpy()] = rows.column("n").to_numpy()
    return out[:DIMS], int(out[DIMS])


def sampled(train: DataFrame, per_class: int) -> list[tuple[int, str, np.ndarray, np.ndarray]]:
    """(hash, language, dimensions, counts) of about `per_class` texts of each language, chosen by hash of the id."""
    sizes = {r.lang: r.n for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(1.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_class / n))).otherwise(share)
    hashed = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    chosen = train.select("lang", "text", hashed.alias("h")).where(F.col("h") / F.lit(float(1 << 30)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, counts = [], []
            for text in batch.column(1):
                d, c = np.unique(grams(text.as_py()), return_counts=True)
                dims.append(d.astype("<u2").tobytes())
                counts.append(c.astype("<u4").tobytes())
            columns = [batch.column(0), batch.column(2), pa.array(dims, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "h", "dims", "counts"])

    found = chosen.mapInArrow(run, "lang string, h long, dims binary, counts binary").collect()
    rows = [(r.h, r.lang, np.frombuffer(r.dims, "<u2").astype(np.int64), np.frombuffer(r.counts, "<u4")) for r in found]
    return sorted((r for r in rows if len(r[2])), key=lambda r: (r[0], r[1], r[2].tobytes()))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class FTRL:
    """Follow-the-regularised-leader (proximal) for softmax regression with elastic net."""

    def __init__(self, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((DIMS, classes)), np.zeros((DIMS, classes))

    def weights(self, dims=slice(None)) -> np.ndarray:
        z, n = self.z[dims], self.n[dims]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, dims: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(dims)
        slope = softmax(x @ w)
        slope[label] -= 1
        g = x[:, None] * slope
        n = self.n[dims]
        self.z[dims] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[dims] = n + g * g


class Model:
    """languages, weights times inverse document frequency, inverse document frequencies and temperature."""

    def __init__(self, train: DataFrame, per_class: int = PER_CLASS, epochs: int = 2):
        df, texts = document_frequencies(train)
        self.idf = (np.log((1 + texts) / (1 + df)) + 1).astype(np.float32)
        rows = sampled(train, per_class)
        self.languages = sorted({r[1] for r in rows}, key=lambda s: s.encode())
        labels = [self.languages.index(r[1]) for r in rows]
        self.temperature = 1.0
        if not rows:
            return
        vectors = [(d, self.vector(d, c)) for _, _, d, c in rows]
        held = [i for i in range(len(rows)) if i % 5 == 4]
        learner = FTRL(len(self.languages))
        for _ in range(epochs):
            for i in range(len(rows)):
                if i % 5 != 4:
                    learner.learn(*vectors[i], labels[i])
        w = learner.weights()
        self.table = (w * self.idf[:, None] * SCALE).astype(np.float32)
        if held:
            logits = np.stack([vectors[i][1] @ w[vectors[i][0]] for i in held])
            truth = np.array([labels[i] for i in held])

            def loss(t: float) -> float:
                return -np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()

            self.temperature = float(min(np.geomspace(0.1, 10, 81), key=loss))

    def vector(self, dims: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = counts * self.idf[dims]
        return SCALE * x / x.sum()

    def predict(self, texts: Iterator[str | None]) -> Iterator[tuple[str, float]]:
        """(language, calibrated probability) of each text."""
        for text in texts:
            g = grams(text)
            if not len(g) or not self.languages:
                yield "und", 0.0
                continue
            logits = self.table[g].sum(axis=0, dtype=np.float64) / float(self.idf[g].sum(dtype=np.float64))
            p = softmax(logits / self.temperature)
            best = int(p.argmax())
            yield self.languages[best], float(p[best])


def language(docs: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text, lang)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    train = rows.where((fold("doc_id", FOLDS) != HELD) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    shared = docs.sparkSession.sparkContext.broadcast(Model(train, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shared.value.predict(t.as_py() for t in batch.column(1)))
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    scored = rows.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "lang_pred", "score")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(read(spark, sf_dir, "documents"))
