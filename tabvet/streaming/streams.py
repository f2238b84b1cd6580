"""M-series: Structured Streaming twins of the monitoring, validation and scoring operators.

Sources are file streams over the Parquet tables (`readStream` on the table folder with a file
filter). Windowed aggregates use event-time watermarks; per-model ring buffers live in
`applyInPandasWithState`; sinks are `foreachBatch` writers that put every micro-batch under
`batch_id=<n>` with overwrite, so a retried batch replaces its own output (idempotent) and
the result table survives executor and driver restarts through the checkpoint folder.
`run_available_now` drains a stream once and returns the sink as a batch DataFrame.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tabvet.operators.drift import psi_counts
from tabvet.session import checkpoint_dir, path_exists


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """File stream of one Parquet table of the folder (schema taken from the table)."""
    d = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(d)


def _sink_dirs(spark: SparkSession, tag: str) -> tuple[str, str]:
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{tag}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/chk"


def batch_writer(path: str):
    """foreachBatch function: write the micro-batch under batch_id=<n> (overwrite = idempotent)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def run_available_now(stream: DataFrame, tag: str, output_mode: str = "append", writer=None) -> str:
    """Drain everything available now through a foreachBatch sink; returns the sink folder."""
    spark = stream.sparkSession
    out, chk = _sink_dirs(spark, tag)
    q = (stream.writeStream.outputMode(output_mode).option("checkpointLocation", chk)
         .foreachBatch(writer(out) if writer else batch_writer(out)).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def latest_per_key(spark: SparkSession, path: str, keys: list[str], schema_of: DataFrame | None = None) -> DataFrame:
    """Update-mode sinks hold one row per key and batch; keep each key's row of the latest batch."""
    if not path_exists(spark, path):  # no batch produced any row
        return spark.createDataFrame([], schema_of.schema) if schema_of is not None else spark.createDataFrame([], "x int")
    df = spark.read.parquet(path)
    w = F.max_by(F.struct(*[c for c in df.columns if c not in keys and c != "batch_id"]), "batch_id")
    return df.groupBy(*keys).agg(w.alias("_r")).select(*keys, "_r.*")


def _event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need TIMESTAMP; wall-clock TIMESTAMP_NTZ columns are read in the session zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


# ------------------------------------------------------------------ M1
def telemetry_stream(events: DataFrame, window: str = "1 hour", watermark: str = "2 hours", ts: str = "ts",
                     status: str = "event_type", latency: str = "value") -> DataFrame:
    """Per event-time window and status: requests, mean and approximate p95 latency."""
    return (_event_time(events, ts).withWatermark(ts, watermark)
            .groupBy(F.window(ts, window).alias("w"), F.col(status).alias("status"))
            .agg(F.count(F.lit(1)).alias("requests"), F.avg(latency).alias("mean_latency"),
                 F.percentile_approx(latency, 0.95, 10000).alias("p95_latency"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "status", "requests", "mean_latency", "p95_latency"))


# ------------------------------------------------------------------ M2
def error_rate_alerts_stream(events: DataFrame, window: str = "1 hour", watermark: str = "2 hours", ts: str = "ts",
                             is_error=None, threshold: float = 0.05) -> DataFrame:
    """Windowed error share; emits a window's row with `alert` = share > threshold (L9 rule)."""
    err = is_error if is_error is not None else (F.col("event_type") == "error")
    g = (_event_time(events, ts).withWatermark(ts, watermark).groupBy(F.window(ts, window).alias("w"))
         .agg(F.count(F.lit(1)).alias("n"), F.sum(err.cast("long")).alias("n_error")))
    rate = F.col("n_error") / F.col("n")
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "n_error", rate.alias("error_rate"),
                    (rate > threshold).alias("alert"))


# ------------------------------------------------------------------ M3
def prediction_state_stream(events: DataFrame, key, conf, ts: str = "ts", tie: str = "event_id",
                            window: int = 100, recent: int = 10, expire_after: str = "30 days", watermark: str = "1 day") -> DataFrame:
    """Ring buffer of the last `window` confidences per model in streaming state; after every
    micro-batch emits per model: records seen, buffer size, buffer mean / population std,
    the number of the newest `recent` records below mean - 2 std (L3 rule), and expired.

    State ends in event time: once the watermark passes a model's newest record by `expire_after`, its state is removed
    and one last row says expired, with nothing buffered. A model that comes back starts from nothing. Records older than
    the watermark are late and dropped; records without a time are dropped too."""
    src = _event_time(events.select(key.alias("model"), F.col(ts).alias("ts"), F.col(tie).cast("long").alias("tie"),
                                    conf.cast("double").alias("conf")), "ts").where(F.col("ts").isNotNull())
    src = src.withWatermark("ts", watermark).withColumn("ms", F.unix_millis("ts"))
    idle = int(pd.Timedelta(expire_after).total_seconds() * 1000)
    out_schema = "model string, seen long, buffered long, mean_conf double, std_conf double, n_anomalies long, expired boolean"
    state_schema = "seen long, ms array<long>, tie array<long>, conf array<double>"

    def row(k, seen, c, expired):
        mean, std = (float(c.mean()), float(c.std())) if len(c) else (np.nan, np.nan)
        n_anom = int((c[-recent:] < mean - 2 * std).sum()) if len(c) >= 10 else 0
        return pd.DataFrame({"model": [k[0]], "seen": [seen], "buffered": [len(c)], "mean_conf": [mean],
                             "std_conf": [std], "n_anomalies": [n_anom], "expired": [expired]})

    def update(k, pdfs, state):
        if state.hasTimedOut:
            seen = state.get[0]
            state.remove()
            yield row(k, seen, np.array([]), True)
            return
        seen, ms, tie_, conf_ = state.get if state.exists else (0, [], [], [])
        buf = pd.DataFrame({"ms": list(ms), "tie": list(tie_), "conf": list(conf_)})
        late = state.getCurrentWatermarkMs()
        for pdf in pdfs:
            pdf = pdf[pdf["ms"] >= late]
            seen += len(pdf)
            buf = pd.concat([buf, pdf[["ms", "tie", "conf"]]], ignore_index=True) if len(buf) else pdf[["ms", "tie", "conf"]]
            buf = buf.sort_values(["ms", "tie"]).tail(window)
        if not len(buf):
            return
        state.update((int(seen), [int(x) for x in buf["ms"]], [int(x) for x in buf["tie"]], [float(x) for x in buf["conf"]]))
        state.setTimeoutTimestamp(max(int(buf["ms"].max()) + idle, state.getCurrentWatermarkMs() + 1))
        yield row(k, seen, buf["conf"].to_numpy(dtype=float), False)

    return src.groupBy("model").applyInPandasWithState(update, out_schema, state_schema, "update",
                                                        GroupStateTimeout.EventTimeTimeout)


# ------------------------------------------------------------------ M4
def drift_batches(baseline: DataFrame, cols: list[str], out: str):
    """foreachBatch function: one PSI row per column and micro-batch against a stored baseline histogram.

    `baseline` (column, bin, lo, hi, share) has one row per column and bin; binning, range rule and floor are those of
    the batch operator `psi_counts`, which it calls."""
    def write(batch: DataFrame, batch_id: int) -> None:
        n = batch.agg(*[F.count(c).alias(c) for c in cols]).unpivot([], cols, "column", "n")
        psi = psi_counts(baseline, batch, cols).join(n, "column")
        psi.select(F.lit(batch_id).cast("long").alias("batch"), "column", "n", "psi").write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    return write
