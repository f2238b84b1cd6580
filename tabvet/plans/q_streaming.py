"""Registered M-series queries: each drains a file stream over the tables with
`trigger(availableNow=True)` into a foreachBatch sink in the checkpoint folder and returns the
sink as a batch DataFrame. Windowed counts have DuckDB oracles; stateful and model-scoring
streams are rows-only checked against their batch twins in tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.functions.core import round_doubles
from tabvet.operators import clean as E
from tabvet.operators import drift as G
from tabvet.operators import infer as C
from tabvet.operators import train as I
from tabvet.operators import validate as B
from tabvet.plans.fixtures import EVENT_CUT
from tabvet.plans.q_validate import VAL_COLS, VAL_KEYS, _validate_sql
from tabvet.plans.registry import query
from tabvet.plans.sqlgen import r6
from tabvet.session import materialize
from tabvet.sources.tables import load_table
from tabvet.streaming import streams as S


# ------------------------------------------------------------------ M1
@query("m1_telemetry_stream", f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS status,
  count(*) AS requests, {r6('avg(value)')} AS mean_latency FROM events GROUP BY ALL""")
def m1_telemetry_stream(spark, d):
    st = S.telemetry_stream(S.table_stream(spark, d, "events"))
    out = S.run_available_now(st, "m1", "update")
    res = S.latest_per_key(spark, out, ["window_start", "status"])
    return round_doubles(res.select("window_start", "status", "requests", "mean_latency"))


@query("m1_telemetry_p95")
def m1_telemetry_p95(spark, d):
    st = S.telemetry_stream(S.table_stream(spark, d, "events"))
    out = S.run_available_now(st, "m1p", "update")
    return round_doubles(S.latest_per_key(spark, out, ["window_start", "status"]))


# ------------------------------------------------------------------ M2 / M5
M2_SQL = f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n,
  CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_error,
  {r6("sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) * 1.0 / count(*)")} AS error_rate,
  sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) * 1.0 / count(*) > 0.05 AS alert FROM events GROUP BY 1"""


@query("m2_error_rate_alerts_stream", M2_SQL)
def m2_error_rate_alerts_stream(spark, d):
    st = S.error_rate_alerts_stream(S.table_stream(spark, d, "events"))
    out = S.run_available_now(st, "m2", "update")
    return round_doubles(S.latest_per_key(spark, out, ["window_start"]))


@query("m5_alert_sink_stream", f"SELECT * FROM ({M2_SQL}) WHERE alert")
def m5_alert_sink_stream(spark, d):
    """Alert windows. The update-mode sink keeps every state of a window, alert or not, so that a window whose rate falls
    below the limit later loses its alert; the filter follows the latest-per-key step."""
    st = S.error_rate_alerts_stream(S.table_stream(spark, d, "events"))
    out = S.run_available_now(st, "m5", "update")
    return round_doubles(S.latest_per_key(spark, out, ["window_start"]).where("alert"))


# ------------------------------------------------------------------ M3
@query("m3_prediction_state_stream")
def m3_prediction_state_stream(spark, d):
    ev = S.table_stream(spark, d, "events", max_files_per_trigger=1)
    conf = F.least(F.col("value") / 100.0, F.lit(1.0))
    st = S.prediction_state_stream(ev, F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")), conf)
    out = S.run_available_now(st, "m3", "update")
    return round_doubles(S.latest_per_key(spark, out, ["model"]))


# ------------------------------------------------------------------ M4
_M4_BIN = "CASE WHEN value < lo OR value > hi THEN NULL WHEN hi = lo THEN 0 WHEN value = hi THEN 9 ELSE least(CAST(floor((value - lo) / ((hi - lo) / 10)) AS BIGINT), 9) END"


@query("m4_drift_stream", f"""WITH ref AS (SELECT value FROM events WHERE ts < TIMESTAMP '{EVENT_CUT}'), cur AS (SELECT value FROM events WHERE ts >= TIMESTAMP '{EVENT_CUT}'),
mm AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n FROM ref), ct AS (SELECT count(value) AS tot FROM cur),
hb AS (SELECT {_M4_BIN} AS bin, count(*) AS cnt FROM ref, mm GROUP BY 1), cb AS (SELECT {_M4_BIN} AS bin, count(*) AS cnt FROM cur, mm GROUP BY 1),
j AS (SELECT CASE WHEN coalesce(hb.cnt, 0) = 0 THEN 1e-10 ELSE hb.cnt * 1.0 / n END AS bp, CASE WHEN coalesce(cb.cnt, 0) = 0 THEN 1e-10 ELSE cb.cnt * 1.0 / tot END AS cp
  FROM range(0, 10) b CROSS JOIN mm CROSS JOIN ct LEFT JOIN hb ON hb.bin = b.range LEFT JOIN cb ON cb.bin = b.range)
SELECT CAST(0 AS BIGINT) AS batch, 'value' AS "column", max(tot) AS n, {r6("sum((cp - bp) * ln(cp / bp))")} AS psi FROM j, ct""")
def m4_drift_stream(spark, d):
    """The table is one file, so one micro-batch; several are tested against the batch operator in tests/."""
    cut = F.lit(EVENT_CUT).cast("timestamp_ntz")
    base = materialize(G.histogram_shares(load_table(spark, d, "events").where(F.col("ts") < cut), ["value"], 10))
    stream = S.table_stream(spark, d, "events").where(F.col("ts") >= cut)
    out_dir, chk = S._sink_dirs(spark, "m4")
    q = (stream.writeStream.option("checkpointLocation", chk).foreachBatch(S.drift_batches(base, ["value"], out_dir))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return round_doubles(spark.read.parquet(out_dir).drop("batch_id"))


# ------------------------------------------------------------------ M6
@query("m6_validate_stream", f"SELECT l_orderkey, l_linenumber, error_text FROM ({_validate_sql()}) WHERE status = 'INVALID'")
def m6_validate_stream(spark, d):
    from tabvet.plans.q_validate import _val_input
    batch = _val_input(spark, d)
    cons = C.semantic_types(batch.select(*VAL_COLS))          # constraints learnt in batch, applied to the stream
    li = S.table_stream(spark, d, "lineitem")
    src = li.select(*VAL_KEYS, (F.col("l_quantity") + F.col("l_discount")).alias("quantity"),
                    F.when(F.col("l_orderkey") % 13 == 0, F.lit(None).cast("double")).otherwise(F.col("l_quantity") * 4 - 20).alias("age"),
                    (F.round(F.col("l_discount") * 100) * 15 - 5).alias("fill_ratio"))
    v = B.validate_rows(src, cons, keys=VAL_KEYS)
    out, chk = S._sink_dirs(spark, "m6")

    def two_sinks(b, bid):
        b.where("status = 'VALID'").select(*VAL_KEYS).write.mode("overwrite").parquet(f"{out}/valid/batch_id={bid}")
        b.where("status = 'INVALID'").select(*VAL_KEYS, "error_text").write.mode("overwrite").parquet(f"{out}/invalid/batch_id={bid}")

    q = v.writeStream.option("checkpointLocation", chk).foreachBatch(two_sinks).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/invalid").drop("batch_id")


# ------------------------------------------------------------------ M7
@query("m7_score_stream")
def m7_score_stream(spark, d):
    feats = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    model = I.train("LogisticRegression", load_table(spark, d, "lineitem"), feats, "l_returnflag")
    li = S.table_stream(spark, d, "lineitem")
    scored = I.predict_batch(model, li, feats, keys=["l_orderkey", "l_linenumber"])
    out = S.run_available_now(scored, "m7", "append")
    return round_doubles(spark.read.parquet(out).drop("batch_id"))
