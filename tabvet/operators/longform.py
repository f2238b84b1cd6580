"""Long-form kernels: unpivot, value counts, distributed running totals, exact quantiles.

Value-level operators (exact quantiles, KS, Wasserstein, top values) work on a long
(column, value) frame aggregated to distinct values first, so the shuffle carries at most one
row per distinct value and a hot value (a third of all rows) collapses to one row by map-side
partial aggregation.

Running totals never put a whole column into one task: distinct values are split into
value-range buckets (bounds from `percentile_approx` over the distinct values, so buckets are
balanced), prefix sums run inside each (column, bucket), and per-bucket offsets come from a
table of #columns x #buckets rows (schema-bound, therefore safe to broadcast).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabvet.session import materialize


def unpivot(df: DataFrame, cols: list[str], key: str = "column", value: str = "value", cast: str = "double",
            ids: list[str] | None = None, drop_nulls: bool = True) -> DataFrame:
    """Wide -> long (ids..., column, value) with values cast to one type."""
    ids = ids or []
    sel = df.select(*ids, *[F.col(c).cast(cast).alias(c) for c in cols])
    if cast == "double":
        sel = sel.select(*ids, *[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in cols])
    long = sel.unpivot(ids, cols, key, value) if ids else sel.unpivot([], cols, key, value)
    if drop_nulls:
        long = long.where(F.col(value).isNotNull())
    return long


def default_buckets(spark) -> int:
    try:
        return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    except Exception:  # pragma: no cover
        return 8


def running_totals(vc: DataFrame, keys: list[str], order: str, weights: list[str], buckets: int | None = None,
                   with_next: bool = False, checkpoint: bool = True) -> DataFrame:
    """Inclusive running sums of `weights` ordered by `order` within each key.

    vc must hold at most one row per (keys, order) (aggregate first). Adds for each weight w:
    `cum_<w>` (inclusive prefix sum) and `tot_<w>` (key total); with `with_next`, `next_value`
    (the following distinct `order` value, NULL for the last one).
    """
    spark = vc.sparkSession
    nb = buckets or default_buckets(spark)
    if checkpoint:
        # vc feeds three branches (bounds, local sums, bucket totals): materialise it once in the
        # shared checkpoint folder instead of recomputing the scan + aggregation per branch
        vc = materialize(vc)
    fr = [i / nb for i in range(1, nb)]
    bounds = vc.groupBy(*keys).agg(F.percentile_approx(order, fr, 10000).alias("_bounds"))
    b = vc.join(F.broadcast(bounds), keys).withColumn(
        "_bucket", F.size(F.filter(F.col("_bounds"), lambda x: x < F.col(order)))
    ).drop("_bounds")

    w_local = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local_cols = [F.sum(w).over(w_local).alias(f"_cl_{w}") for w in weights]
    if with_next:
        local_cols.append(F.lead(order).over(Window.partitionBy(*keys, "_bucket").orderBy(order)).alias("_lead"))
    local = b.select("*", *local_cols)

    btot = b.groupBy(*keys, "_bucket").agg(*[F.sum(w).alias(f"_bt_{w}") for w in weights],
                                            F.min(order).alias("_bmin"))
    wb = Window.partitionBy(*keys).orderBy("_bucket")
    wk = Window.partitionBy(*keys)
    off_cols = [F.coalesce(F.sum(f"_bt_{w}").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_off_{w}")
                for w in weights]
    off_cols += [F.sum(f"_bt_{w}").over(wk).alias(f"tot_{w}") for w in weights]
    off_cols.append(F.lead("_bmin").over(wb).alias("_next_bmin"))
    offs = btot.select(*keys, "_bucket", *off_cols)

    out = local.join(F.broadcast(offs), keys + ["_bucket"])
    outs = [F.col(c) for c in vc.columns]
    outs += [(F.col(f"_cl_{w}") + F.col(f"_off_{w}")).alias(f"cum_{w}") for w in weights]
    outs += [F.col(f"tot_{w}") for w in weights]
    if with_next:
        outs.append(F.coalesce(F.col("_lead"), F.col("_next_bmin")).alias("next_value"))
    return out.select(*outs)


def exact_quantiles(long: DataFrame, probs: list[float], key: str = "column", value: str = "value",
                    buckets: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (pandas / DuckDB `quantile_cont`) per key.

    Returns (key, prob, quantile). Sort-based and distributed: no single-task value buffer.
    """
    vc = long.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return quantiles_from_counts(vc, probs, key, value, buckets)


def quantiles_from_counts(vc: DataFrame, probs: list[float], key: str = "column", value: str = "value",
                          buckets: int | None = None) -> DataFrame:
    """exact_quantiles starting from a distinct-value table (key, value, n)."""
    spark = vc.sparkSession
    cdf = running_totals(vc, [key], value, ["n"], buckets=buckets)
    totals = vc.groupBy(key).agg(F.sum("n").alias("tot"))       # one row per key
    pr = spark.createDataFrame([(float(p),) for p in probs], "prob double")
    req = (totals.crossJoin(F.broadcast(pr))                     # keys x probs, bounded by the schema
           .withColumn("_h", (F.col("tot") - 1).cast("double") * F.col("prob"))
           .withColumn("_lo", F.floor("_h").cast("long"))
           .withColumn("_hi", F.ceil("_h").cast("long"))
           .withColumn("_frac", F.col("_h") - F.floor("_h")))
    c = cdf.select(key, value, (F.col("cum_n") - F.col("n")).alias("_start"), F.col("cum_n").alias("_end")).alias("c")
    r = F.broadcast(req.alias("r"))
    # rows whose rank interval [start, end) overlaps [lo, hi]: at most two per request
    j = c.join(r, (F.col(f"c.{key}") == F.col(f"r.{key}")) & (F.col("c._start") <= F.col("r._hi")) & (F.col("r._lo") < F.col("c._end")))
    hit_lo = (F.col("c._start") <= F.col("r._lo")) & (F.col("r._lo") < F.col("c._end"))
    hit_hi = (F.col("c._start") <= F.col("r._hi")) & (F.col("r._hi") < F.col("c._end"))
    g = j.groupBy(F.col(f"r.{key}").alias(key), F.col("r.prob").alias("prob")).agg(
        F.max(F.when(hit_lo, F.col(f"c.{value}"))).alias("_vlo"), F.max(F.when(hit_hi, F.col(f"c.{value}"))).alias("_vhi"),
        F.first(F.col("r._frac")).alias("_frac"))
    return g.select(key, "prob", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")).alias("quantile"))


def quantiles_wide(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """Exact quantiles of several numeric columns: (column, prob, quantile)."""
    return exact_quantiles(unpivot(df, cols), probs)


def value_counts(df: DataFrame, cols: list[str], key: str = "column", value: str = "value") -> DataFrame:
    """(column, value-as-string, n) for every distinct non-null value of each column."""
    long = unpivot(df, cols, key=key, value=value, cast="string")
    return long.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))


def top_k_per_key(df: DataFrame, key: str | list[str], order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def row_numbers(df: DataFrame, order: list[Column], name: str = "row", keep: list[str] | None = None) -> DataFrame:
    """df (its columns `keep`) with `name`, dense numbers from 0 in the given order, equal rows of the order in any order.

    A range sort deals the rows out, once; a row's place in its range is stored with it and offset by the rows of the
    ranges before it (a table of one row a range, so small enough to broadcast). No task sees more than one range."""
    parts = default_buckets(df.sparkSession)
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order, F.col("_tie"))
    # in a sorted range the number is the range and, in the low 33 bits, the place
    dealt = dealt.sortWithinPartitions(*order, F.col("_tie")).select(*(keep or df.columns), F.monotonically_increasing_id().alias("_at_range"))
    dealt = materialize(dealt).withColumn("_part", F.shiftright("_at_range", 33))
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    place = F.col("_at_range").bitwiseAND(F.lit((1 << 33) - 1))
    placed = dealt.join(F.broadcast(offset), "_part")
    return placed.withColumn(name, place + F.col("_before")).drop("_at_range", "_part", "_before")
