"""Model registry and experiment log: state after each event (I18), version comparison (I18), experiment statistics (I16),
algorithm and preprocessing advice from a dataset's shape (I17).

A registry log is a table (model, at, seq, action, version, ...) of events in any order of arrival. Its state is a fold over
(at, seq) per model: a late event takes its place by time, and all later states are those that follow from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIONS = ("register", "promote", "rollback")


def registry_states(log: DataFrame) -> DataFrame:
    """Every event with the state after it: applied, latest, production, depth (of the stack of promotions).

    `register` makes its version the latest. `promote` puts a version into production, on top of those before it, also one
    that was never registered. `rollback` with a version puts that one on top if it was registered before, else nothing
    happens; without a version it takes the top away, so that the version below is in production again, or none; on an
    empty stack nothing happens. Events of one time follow seq, then action and version; other actions, and events without
    a model or time, are not applied and change nothing (a NULL time comes first).

    The stack needs no loop: its depth is the running sum of pushes and pops less its least value so far (a pop on the empty
    stack moves that), and its top is the version of the last push that reached the present depth. The windows run over
    one model's events in order, without holding them."""
    order = [F.col("at").asc_nulls_first(), "seq", "action", F.col("version").asc_nulls_first()]
    line = Window.partitionBy("model").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("model", "version").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    valid = F.col("model").isNotNull() & F.col("at").isNotNull()
    action = F.when(valid, F.col("action"))
    known = F.coalesce(F.max((action == "register").cast("int")).over(earlier), F.lit(0)) == 1
    named = F.col("version").isNotNull()
    push = ((action == "promote") & named) | ((action == "rollback") & named & F.col("_known"))
    pop = (action == "rollback") & ~named
    move = F.when(push, 1).when(pop, -1).otherwise(0)
    moved = log.withColumn("_known", known).withColumn("_move", move)
    summed = moved.withColumn("_sum", F.sum("_move").over(line))
    depth = F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(line))
    deep = summed.withColumn("depth", depth.cast("long"))
    before = F.coalesce(F.lag("depth").over(Window.partitionBy("model").orderBy(*order)), F.lit(0))
    level = Window.partitionBy("model", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.last(F.when(F.col("_move") == 1, F.col("version")), ignorenulls=True).over(level)
    latest = F.last(F.when((action == "register") & named, F.col("version")), ignorenulls=True).over(line)
    applied = ((action == "register") & named) | (F.col("_move") == 1) | ((F.col("_move") == -1) & (before > 0))
    return deep.withColumn("applied", F.coalesce(applied, F.lit(False))).withColumn("latest", latest) \
        .withColumn("production", F.when(F.col("depth") > 0, top)).drop("_known", "_move", "_sum")


def registry_compare(log: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per registered version: metrics and time of its last registration, how often it was promoted, and
    whether it is in production or the latest at the end of the log."""
    states = registry_states(log)
    last = F.struct("at", "seq", "action", F.coalesce("version", F.lit("")))
    end = states.groupBy("model").agg(F.max_by("production", last).alias("_production"), F.max_by("latest", last).alias("_latest"))
    named = states.where("applied and version is not null")
    registered = F.col("action") == "register"
    per = named.groupBy("model", "version").agg(
        F.count_if(registered).alias("registrations"), F.count_if(~registered).alias("promotions"),
        F.max(F.when(registered, F.col("at"))).alias("created_at"),
        *[F.max_by(m, F.when(registered, last)).alias(m) for m in metrics])
    out = per.where("registrations > 0").join(end, "model")
    return out.select("model", "version", "created_at", *metrics, "registrations", "promotions",
                      F.col("version").eqNullSafe(F.col("_production")).alias("production"),
                      F.col("version").eqNullSafe(F.col("_latest")).alias("latest"))


def experiment_stats(runs: DataFrame, model: str = "model", score: str = "f1_score") -> DataFrame:
    """I16: per model: experiments, mean score (missing scores count as 0), share, and whether it has the best mean (above
    0; ties by name). A missing model is `Unknown`."""
    named = runs.select(F.coalesce(F.col(model), F.lit("Unknown")).alias("model"), F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(None)), F.lit(0.0)).alias("s"))
    per = named.groupBy("model").agg(F.count(F.lit(1)).alias("experiments"), F.avg("s").alias("mean_score"))
    total = per.agg(F.sum("experiments").alias("_total"), F.min(F.struct((-F.col("mean_score")).alias("m"), "model")).alias("_best"))
    out = per.crossJoin(F.broadcast(total))  # one row
    return out.select("model", "experiments", "mean_score", (F.col("experiments") / F.col("_total")).alias("share"),
                      ((F.col("model") == F.col("_best.model")) & (F.col("mean_score") > 0)).alias("best"))


def first_rule(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for condition, value in reversed(rules):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out
