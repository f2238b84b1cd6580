"""Streams over several micro-batches equal their batch twins."""

import math

from pyspark.sql import functions as F

from tabvet.operators import drift as G
from tabvet.session import materialize
from tabvet.streaming import streams as S


def files(spark, tmp_path, frames):
    schema = frames[0].schema
    for i, f in enumerate(frames):
        f.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def test_drift_of_each_micro_batch_equals_the_batch_operator(spark, tmp_path):
    ref = spark.range(1000).select((F.col("id") % 100).cast("double").alias("value"))
    parts = [spark.range(300).select((F.col("id") * 7 % 100 + shift).cast("double").alias("value")) for shift in (0, 20, 55)]
    base = materialize(G.histogram_shares(ref, ["value"], 10))
    out = str(tmp_path / "out")
    stream = files(spark, tmp_path, parts)
    q = stream.writeStream.option("checkpointLocation", str(tmp_path / "chk")).foreachBatch(S.drift_batches(base, ["value"], out)) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(r.psi for r in spark.read.parquet(out).collect())
    want = sorted(G.psi_counts(base, p, ["value"]).first().psi for p in parts)
    assert len(got) == 3 and all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got, want))


def test_a_cleared_alert_is_withdrawn(spark, tmp_path):
    """The first file puts an hour above the limit, the second one below it again."""
    def events(errors, n, start):
        return spark.range(n).select((F.col("id") + start).alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id % 50 as int), 0)").alias("ts"),
                                     F.when(F.col("id") < errors, "error").otherwise("view").alias("event_type"))

    stream = files(spark, tmp_path, [events(5, 20, 0), events(0, 400, 100)])
    out = S.run_available_now(S.error_rate_alerts_stream(stream), "t", "update")
    rows = S.latest_per_key(spark, out, ["window_start"]).collect()
    assert [(r.n, r.n_error, r.alert) for r in rows] == [(420, 5, False)]
