"""Quality classifier and language identification: held-out accuracy and awkward rows."""

import zlib

import numpy as np

from tabvet.llm import language as L
from tabvet.llm import quality as Q

from .data import documents, nothing


def fold(doc_id, n):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def test_quality_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in Q.op7(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (fold(i, 5) == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [(rows[i].score, rows[i].predicted, y) for i, y in labels.items() if rows[i].held_out]
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.97
    assert np.mean([p for _, p, y in held if y]) > 0.98


def test_quality_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (7, 0), (None, 1), (3, None), (10, 5)], "doc_id long, quality int")
    docs = documents(spark)
    got = Q.quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in Q.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert Q.quality(nothing(spark), labels).count() == 0
    assert Q.keep_good(docs, labels).columns == docs.columns


def test_held_out_labels_teach_nothing(spark):
    held = [i for i in range(1, 14) if fold(i, 5) == 0]
    labels = spark.createDataFrame([(i, 1) for i in held], "doc_id long, quality int")
    assert {r.score for r in Q.quality(documents(spark), labels).collect()} == {0.5}


def test_nnpu_separates(spark):
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.8
    rows = np.where(truth[:, None], rng.normal(1.5, 1, (4000, 4)), rng.normal(-1.5, 1, (4000, 4))).astype(np.float32)
    bins = Q.Bins(rows)
    w = Q.fit_nnpu(bins.index(rows[truth][:1000]), bins.index(rows), bins.width, 0.8)
    z = w[bins.index(rows)].sum(axis=1) + w[-1]
    assert ((z > 0) == truth).mean() > 0.97


def test_language_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = L.op8(spark, sf).collect()
    assert len(rows) == len(truth) and all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_language_of_awkward_rows(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in L.language(docs).collect()}
    assert len(got) == len({r.doc_id for r in docs.collect()})
    assert (got[4].lang_pred, got[4].score) == ("und", 0.0) and got[5].lang_pred == got[6].lang_pred == "und"
    assert got[13].lang_pred == "en"
    assert L.language(nothing(spark)).count() == 0
    assert {r.lang_pred for r in L.language(docs.where("text is null or doc_id = 5")).collect()} == {"und"}
