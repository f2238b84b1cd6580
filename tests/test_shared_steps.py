"""Steps that several queries share: one pass where there were many, with the same results."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabvet.operators import clean as E
from tabvet.operators import dataset as DS
from tabvet.operators import drift as G
from tabvet.operators import ensemble as En
from tabvet.operators import longform
from tabvet.operators import train as I
from tabvet.operators import validate as B


def test_path_lengths_equal_a_walk_row_by_row():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    x[5, 1] = np.nan
    want, forest = np.zeros(len(x)), []
    for _ in range(4):
        feat, thr, left, right, size = E._grow_tree(np.nan_to_num(x[rng.choice(300, 64)]), rng, 6)
        forest.append(E._walk(pd.DataFrame({"feat": feat, "thr": thr, "left": left, "right": right, "size": size})))
        for i, row in enumerate(x):
            at, depth = 0, 0
            while feat[at] >= 0:
                at, depth = (left if row[feat[at]] < thr[at] else right)[at], depth + 1
            want[i] += depth + E._c_factor(size[at])
    assert np.allclose(E.path_lengths(x, forest), want, rtol=0, atol=1e-12)


def test_drift_suite_counts_values_once(spark, monkeypatch):
    df = spark.range(400).select((F.col("id") % 50).cast("double").alias("a"), (F.col("id") * 1.5).alias("b"))
    ref, cur = df.where("a < 30"), df.where("a >= 20")
    calls, unpivot = [], G.unpivot
    monkeypatch.setattr(G, "unpivot", lambda *a, **k: calls.append(1) or unpivot(*a, **k))
    got = G.drift_suite(ref, cur, ["a", "b"]).first()
    assert len(calls) == 2          # one for each side
    assert abs(got["ks_max"] - 2 / 3) < 1e-9 and got["psi_drift"]


def test_describe_all_reads_one_table_of_distinct_values(spark, monkeypatch):
    rows = [(i % 7 if i % 5 else None, "b" if i % 2 else "a", float("nan") if i == 3 else i / 2) for i in range(101)]
    df = spark.createDataFrame(rows, "k int, s string, x double")
    monkeypatch.setattr(longform, "unpivot", None)          # no second table
    got = {r["column"]: r for r in DS.describe_all(df).collect()}
    x = pd.Series([r[2] for r in rows])
    assert [got["x"][q] for q in ("q25", "q50", "q75")] == [float(x.quantile(q)) for q in (0.25, 0.5, 0.75)]
    assert (got["s"]["unique"], got["s"]["top"], got["s"]["freq"]) == (2, "a", 51) and got["x"]["count"] == 100


def test_folds_of_elimination_lie_in_even_files(spark, monkeypatch):
    monkeypatch.setattr(I, "TASK_ROWS", 100)
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 13).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b")).coalesce(1)
    largest = []

    def importance(rows, features):
        largest.append(rows.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0])
        return En.linear_importance(rows, features)

    assert En.rfe(df, ["a", "b"], F.col("a") * 2, ["k"], n=1, importance=importance).count() == 2
    assert max(largest) <= 130


def test_split_gathers_no_stratum_in_a_task(spark):
    df = spark.range(6000).select((F.col("id") % 3000).alias("id"), F.when(F.col("id") % 5 > 0, "hot").alias("s"))
    order = F.pmod(F.col("id") * 7919, F.lit(251))
    for buckets in (1, 40, 1024):
        out = B.stratified_flag(df, ["s"], 0.2, order, "f", buckets)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert all("_b#" in x for x in re.findall(r"hashpartitioning\((.*?)\)?, \d+\)", plan)), plan
        got = out.withColumn("o", order).toPandas()
        assert len(got) == 6000
        for _, g in got.groupby("s", dropna=False):
            first = g.sort_values(["o", "id"])["id"].tolist()[: round(0.2 * len(g))]
            assert sorted(g[g["f"]]["id"]) == sorted(first)
