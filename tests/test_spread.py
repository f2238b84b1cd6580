"""Inputs of fits are stored once and in even files; scores are made once for all metrics."""

import pytest
from pyspark.sql import functions as F

from tabvet.operators import train as I


@pytest.fixture
def counted(spark):
    """A frame that counts how often its rows are made: (frame, calls)."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def made(x):
        calls.add(1)
        return float(x % 17)

    frame = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 13).cast("double").alias("b"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("y"))
    return frame.withColumn("a", made("k")), calls


def test_spread_keeps_every_row(spark):
    rows = spark.createDataFrame([(i % 7 or None, float(i % 3)) for i in range(250)], "k int, v double").coalesce(1)
    out = I.spread(rows, 10)
    assert sorted(map(str, out.collect())) == sorted(map(str, rows.collect()))
    files = out.groupBy(F.input_file_name()).count().collect()
    assert len(files) % spark.sparkContext.defaultParallelism == 0 and max(r["count"] for r in files) <= 12
    assert I.spread(rows, 250) is rows


def test_rows_are_scored_once_for_all_metrics(counted):
    df, calls = counted
    model = I.train("DecisionTree", df, ["a", "b"], "y")
    before = calls.value
    out = I.evaluate(model, df, ["a", "b"], "y").first()
    assert 0 < out["accuracy"] <= 1 and out["auc"] is not None
    assert calls.value - before == 300


def test_folds_are_made_once_for_all_models(counted, monkeypatch):
    monkeypatch.setattr(I, "TASK_ROWS", 100)
    df, calls = counted
    ranks = I.tournament(df, ["a", "b"], "y", ["k"], ["DecisionTree", "NaiveBayes"], k=3).collect()
    assert [r["rank"] for r in ranks] == [1, 2]
    assert calls.value <= 600          # the count may need them once more
    calls.value = 0
    assert len(I.tune(df, ["a", "b"], "y", ["k"], 3, {"numTrees": [2], "maxDepth": [2, 3]}).collect()) == 2
    assert calls.value <= 600


def test_tournament_searches_every_family(spark, monkeypatch):
    asked = []

    def scored(name, d, features, target, k, metric, params=None):
        asked.append((name, *sorted((params or {}).items())))
        good = 0.9 if name == "MLP" and params == {"hidden": 8} else 0.5
        return spark.createDataFrame([(name, f, good) for f in range(k)], "model string, fold int, score double")

    monkeypatch.setattr(I, "_fold_scores", scored)
    rows = spark.createDataFrame([(i, float(i % 5), "xyz"[i % 3]) for i in range(30)], "k int, a double, y string")
    got = I.tournament(rows, ["a"], "y", ["k"], k=3).collect()
    assert [r.model for r in got] == ["MLP", "DecisionTree", "GradientBoosting", "LinearSVC", "LogisticRegression", "NaiveBayes", "RandomForest"]
    assert got[0].params == "hidden=8" and [r["params"] for r in got[1:3]] == ["maxDepth=5", "maxDepth=5"] and [r["rank"] for r in got] == list(range(1, 8))
    assert len(asked) == len(set(asked)) == 13


def test_settings_reach_each_family(spark):
    rows = spark.createDataFrame([(float(i % 5), float(i % 7), "xyz"[i % 3]) for i in range(60)], "a double, b double, y string")
    for name, grid in I.SEARCH.items():
        param, value = next((p, v[-1]) for p, v in grid.items())
        if name == "MLP":
            assert list(I.train(name, rows, ["a", "b"], "y", params={param: value}).stages[-1].getLayers()) == [2, value, 3]
            continue
        for classes in (2, 3):
            found = I.estimator(name, classes, params={param: value})
            found = found.getClassifier() if hasattr(found, "getClassifier") else found
            assert found.getOrDefault(param) == value
