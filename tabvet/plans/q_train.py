"""Registered I-series queries. Spark ML fits are rows-only checked; the split, voting and
soft-target table operators have DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.functions.core import round_doubles
from tabvet.operators import train as I
from tabvet.plans.fixtures import PRED_SQL, predictions
from tabvet.plans.registry import query
from tabvet.plans.sqlgen import r6
from tabvet.sources.tables import load_table

FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_linenumber"]
TARGET = "l_returnflag"


def _order():
    return (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 100003


def _data(spark, d):
    return load_table(spark, d, "lineitem").select(*KEYS, *FEATS, TARGET)


def _split(spark, d):
    return I.spread(I.split(_data(spark, d), TARGET, 0.2, order=_order()))


@query("i1_split", """WITH o AS (SELECT l_orderkey, l_linenumber, l_returnflag, (l_orderkey * 7919 + l_linenumber * 104729) % 100003 AS o FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY o, l_orderkey, l_linenumber) AS rn,
             count(*) OVER (PARTITION BY l_returnflag) AS n FROM o)
SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN rn <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r""")
def i1_split(spark, d):
    df = load_table(spark, d, "lineitem").select(*KEYS, TARGET)
    return I.split(df, TARGET, 0.2, order=_order())


@query("i2_train_evaluate")
def i2_train_evaluate(spark, d):
    s = _split(spark, d)
    tr, te = s.where("split = 'train'"), s.where("split = 'test'")
    out = None
    for name in ("LogisticRegression", "RandomForest", "DecisionTree", "NaiveBayes"):
        m = I.train(name, tr, FEATS, TARGET)
        e = I.evaluate(m, te, FEATS, TARGET).select(F.lit(name).alias("model"), "*")
        out = e if out is None else out.unionByName(e)
    return round_doubles(out)


@query("i3_cross_validate")
def i3_cross_validate(spark, d):
    return round_doubles(I.cv_summary(I.cross_validate("DecisionTree", _data(spark, d), FEATS, TARGET, KEYS, k=3)))


@query("i4_tune")
def i4_tune(spark, d):
    return round_doubles(I.tune(_data(spark, d), FEATS, TARGET, KEYS, k=3))


@query("i5_tournament")
def i5_tournament(spark, d):
    return round_doubles(I.tournament(_data(spark, d), FEATS, TARGET, KEYS, k=3))


@query("i10_predict_batch")
def i10_predict_batch(spark, d):
    s = _split(spark, d)
    m = I.train("RandomForest", s.where("split = 'train'"), FEATS, TARGET)
    return round_doubles(I.predict_batch(m, s.where("split = 'test'"), FEATS, keys=KEYS))


@query("i11_model_importance")
def i11_model_importance(spark, d):
    m = I.train("RandomForest", I.spread(_data(spark, d)), FEATS, TARGET)
    return round_doubles(I.model_importance(m, FEATS))


@query("i12_linear_attributions")
def i12_linear_attributions(spark, d):
    df = _data(spark, d)
    bin_df = df.withColumn("_y", (F.col(TARGET) == "R").cast("string"))
    m = I.train("LogisticRegression", bin_df, FEATS, "_y")
    lr, scaler = m.stages[-1], m.stages[-2]
    # coefficients on the z-scaled inputs -> raw-unit coefficients
    std = scaler.std.toArray()
    coef = {c: float(lr.coefficients[i] / std[i]) if std[i] > 0 else 0.0 for i, c in enumerate(FEATS)}
    _, glob = I.linear_attributions(df, FEATS, coef, KEYS)
    return round_doubles(glob)


@query("i13_what_if")
def i13_what_if(spark, d):
    s = _split(spark, d)
    m = I.train("LogisticRegression", s.where("split = 'train'"), FEATS, TARGET)
    return round_doubles(I.what_if(m, s.where("split = 'test'"), FEATS, "l_discount", 20, keys=KEYS))


# ------------------------------------------------------------------ I6 / I9 on a predictions table
def _three_models(spark, d):
    p = predictions(spark, d)
    return p.select("event_id", F.explode(F.array(
        F.struct(F.lit("a").alias("model"), F.col("p").alias("p")),
        F.struct(F.lit("b").alias("model"), (F.col("p") * 0.8 + 0.1).alias("p")),
        F.struct(F.lit("c").alias("model"), (F.lit(1.0) - F.col("p") * 0.5).alias("p")))).alias("r")).select("event_id", "r.*")


THREE_SQL = f"""WITH {PRED_SQL},
tm AS (SELECT event_id, 'a' AS model, p FROM pred UNION ALL SELECT event_id, 'b', p * 0.8 + 0.1 FROM pred
       UNION ALL SELECT event_id, 'c', 1.0 - p * 0.5 FROM pred),
w AS (SELECT *, CASE model WHEN 'a' THEN 3.0 WHEN 'b' THEN 1.0 ELSE 1.0 END AS w FROM tm),
g AS (SELECT event_id, sum(w * p) / sum(w) AS sp, sum(w * CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END) / sum(w) AS hv FROM w GROUP BY event_id)
SELECT event_id, {r6('sp')} AS soft_p, CAST(sp >= 0.5 AS INTEGER) AS soft_label, CAST(hv >= 0.5 AS INTEGER) AS hard_label FROM g"""


@query("i6_voting", THREE_SQL)
def i6_voting(spark, d):
    return round_doubles(I.voting(_three_models(spark, d), ["event_id"], weights={"a": 3.0, "b": 1.0, "c": 1.0}))


@query("i9_soft_targets", f"""WITH {PRED_SQL}
SELECT event_id, [round(pow(p, 0.25) / (pow(p, 0.25) + pow(1 - p, 0.25)), 6),
                  round(pow(1 - p, 0.25) / (pow(p, 0.25) + pow(1 - p, 0.25)), 6)] AS soft_probs FROM pred""")
def i9_soft_targets(spark, d):
    p = predictions(spark, d).select("event_id", F.array(F.col("p"), F.lit(1.0) - F.col("p")).alias("probs"))
    out = I.soft_targets(p, "probs", 4.0)
    return out.select("event_id", F.transform("soft_probs", lambda x: F.round(x, 6)).alias("soft_probs"))
