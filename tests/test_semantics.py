"""Semantics checked against pandas / numpy brute force on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabvet.functions.core import kurtosis_unbiased, skewness_unbiased
from tabvet.operators import clean as E
from tabvet.operators import features as FE
from tabvet.operators import validate as B
from tabvet.operators.leakage import leakage
from tabvet.sources.tables import load_table


def test_bias_corrected_moments_match_pandas(spark, sf):
    li = load_table(spark, sf, "lineitem").select("l_extendedprice")
    r = li.agg(skewness_unbiased(F.col("l_extendedprice")).alias("s"), kurtosis_unbiased(F.col("l_extendedprice")).alias("k")).first()
    p = li.toPandas()["l_extendedprice"]
    assert r["s"] == pytest.approx(p.skew(), rel=1e-9)
    assert r["k"] == pytest.approx(p.kurtosis(), rel=1e-9)


def test_quantile_bins_match_qcut(spark, sf):
    li = load_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_quantity")
    # the raw values ride along as keys, so codes are compared row by row (no join)
    m = FE.quantile_bins(li, ["l_tax", "l_quantity"], 5, keys=["l_tax", "l_quantity"]).toPandas()
    for c in ("l_tax", "l_quantity"):
        want = pd.qcut(m[c], q=5, labels=False, duplicates="drop")
        assert (want.to_numpy() == m[f"{c}_binned"].to_numpy()).all()


def test_row_stats_match_pandas(spark, sf):
    li = load_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity",
        F.when(F.col("l_orderkey") % 3 == 0, F.lit(None)).otherwise(F.col("l_discount")).alias("d"), "l_tax")
    got = FE.row_stats(li, ["l_quantity", "d", "l_tax"]).toPandas()
    x = got[["l_quantity", "d", "l_tax"]].astype(float)
    assert np.allclose(got["row_mean"], x.mean(axis=1), equal_nan=True)
    assert np.allclose(got["row_std"], x.std(axis=1), equal_nan=True)
    assert np.allclose(got["row_skew"].astype(float), x.skew(axis=1), equal_nan=True, atol=1e-9)


def test_stratified_flag_is_exact_with_a_hot_stratum(spark, sf):
    ev = load_table(spark, sf, "events").select("event_id", "event_type")
    # one stratum holding a third of the rows or more
    hot = ev.withColumn("s", F.when(F.col("event_id") % 3 == 0, F.lit("hot")).otherwise(F.col("event_type")))
    out = B.stratified_flag(hot, ["s"], 0.25, F.xxhash64("event_id"), "f").toPandas()
    assert len(out) == hot.count()
    for s, g in out.groupby("s"):
        assert g["f"].sum() == round(len(g) * 0.25 + 1e-12) or abs(g["f"].sum() - len(g) * 0.25) <= 0.5


def test_interactions_match_numpy(spark, sf):
    li = load_table(spark, sf, "lineitem")
    cols = ["l_quantity", "l_discount", "l_tax"]
    got = FE.interaction_candidates(li, cols, "l_extendedprice", keep=10).toPandas()
    p = li.select(*cols, "l_extendedprice").toPandas()
    y = p["l_extendedprice"].to_numpy()
    top = got.iloc[0]
    a, b = p[top["a"]].to_numpy(), p[top["b"]].to_numpy()
    v = a * b if top["type"] == "product" else np.clip(np.where(b != 0, a / np.where(b == 0, 1, b), 0), -1e6, 1e6)
    assert top["correlation"] == pytest.approx(abs(np.corrcoef(v, y)[0, 1]), rel=1e-9)


def test_iterative_imputation_recovers_a_linear_relation(spark, sf):
    li = load_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    df = li.select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_quantity") * 3 + 7).alias("y"))
    df = df.withColumn("y", F.when(F.col("l_orderkey") % 5 == 0, F.lit(None)).otherwise(F.col("y")))
    out = E.impute_iterative(df, ["l_quantity", "y"], max_iter=5).toPandas()
    assert np.allclose(out["y"], out["l_quantity"] * 3 + 7, atol=1e-3)


def test_isolation_forest_labels_the_contamination_share(spark, sf):
    li = load_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    out = E.isolation_forest(li, ["l_quantity", "l_extendedprice"], n_trees=20, contamination=0.1,
                             key=["l_orderkey", "l_linenumber"])
    pdf = out.toPandas()
    share = (pdf["anomaly_label"] == "ANOMALY").mean()
    assert 0.09 <= share <= 0.11
    assert pdf["anomaly_score"].min() == 0.0 and pdf["anomaly_score"].max() == 1.0
    # the extreme corner is scored above the median row
    ext = pdf.loc[(pdf["l_extendedprice"] - pdf["l_extendedprice"].mean()).abs().idxmax(), "anomaly_score"]
    assert ext > pdf["anomaly_score"].median()


def test_leakage_flags_copies(spark, sf):
    li = load_table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice",
                                                 F.col("l_extendedprice").alias("copy"))
    got = {r["column"]: r["reason"] for r in leakage(li, "l_extendedprice").collect()}
    assert got == {"copy": "identical to target values"}


def test_streaming_state_matches_batch_last_n(spark, sf):
    from tabvet.operators.monitor import keep_last_n
    from tabvet.streaming import streams as S
    ev = S.table_stream(spark, sf, "events")
    key = F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string"))
    conf = F.least(F.col("value") / 100.0, F.lit(1.0))
    out = S.run_available_now(S.prediction_state_stream(ev, key, conf), "t", "update")
    got = S.latest_per_key(spark, out, ["model"]).toPandas().set_index("model")
    batch = load_table(spark, sf, "events").select(key.alias("model"), "ts", "event_id", conf.alias("c"))
    last = keep_last_n(batch, 100).groupBy("model").agg(F.avg("c").alias("m")).toPandas().set_index("model")
    for m in last.index:
        assert got.loc[m, "mean_conf"] == pytest.approx(last.loc[m, "m"], rel=1e-9)
