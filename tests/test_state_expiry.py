"""The confidence buffer of a model ends after an idle time and starts anew when the model comes back."""

from pyspark.sql import functions as F

from tabvet.streaming import streams as S



def events(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, at string, model string, conf double")
    return df.select("event_id", F.col("at").cast("timestamp_ntz").alias("ts"), "model", "conf")


def test_state_expires_and_returns(spark, tmp_path):
    days = [
        [(1, "2024-01-01", "a", 0.5), (2, "2024-01-01", "b", 0.9), (3, "2024-01-02", "a", 0.7)],
        [(4, "2024-01-09", "b", 0.8)],                                     # the watermark passes a's last record by more than 5 days
        [(5, "2024-01-10", "b", 0.6), (6, "2024-01-02", "b", 0.1)],        # 6 is late
        [(7, "2024-01-11", "a", 0.4)],                                     # a comes back
    ]
    parts = [events(spark, rows) for rows in days]
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    state = S.prediction_state_stream(stream, F.col("model"), F.col("conf"), expire_after="5 days", watermark="1 day")
    out = S.run_available_now(state, "expiry", "update")
    rows = sorted(spark.read.parquet(out).collect(), key=lambda r: (r.model, r.batch_id))
    a, b = [r for r in rows if r.model == "a"], [r for r in rows if r.model == "b"]
    assert [(r.seen, r.buffered, r.expired) for r in a] == [(2, 2, False), (2, 0, True), (1, 1, False)]
    assert [r.seen for r in b] == [1, 2, 3] and not any(r.expired for r in b)
