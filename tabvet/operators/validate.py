"""B-series: column selection, flagged-column drops, row schemas and row validation, filters,
review gate and stratified sampling.

Per-column rule tables (flags, constraints) have one row per column of the input, so they are
the only things brought to the driver: they turn into generated Column expressions that run
inside whole-stage codegen over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvet.functions.core import categorical_cols, numeric_cols
from tabvet.operators.colstats import column_stats
from tabvet.operators.infer import categorize_columns
from tabvet.session import materialize

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


# ------------------------------------------------------------------ B1
def select_numeric(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> DataFrame:
    return df.select(*numeric_cols(df, exclude))


def select_categorical(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> DataFrame:
    return df.select(*categorical_cols(df, exclude))


# ------------------------------------------------------------------ B2
def column_flags(df: DataFrame) -> DataFrame:
    """One row per (column, flag): ALL_NULL, CONSTANT (one distinct non-null value) and ID
    (C3 category). A column can carry several flags."""
    st = column_stats(df, numeric_stats=False)
    cat = categorize_columns(df).select("column", "category")
    t = st.join(F.broadcast(cat), "column")
    flags = F.array_compact(F.array(
        F.when(F.col("n_null") == F.col("n_rows"), F.lit("ALL_NULL")),
        F.when((F.col("n_null") < F.col("n_rows")) & (F.col("n_distinct") <= 1), F.lit("CONSTANT")),
        F.when(F.col("category") == "ID", F.lit("ID"))))
    return t.select("column", "position", F.explode(flags).alias("flag"))


def drop_flagged(df: DataFrame, flags: DataFrame, kinds: tuple[str, ...] = ("ALL_NULL", "CONSTANT", "ID"),
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop every column flagged with one of `kinds` (`flags` has at most one row per column and kind)."""
    drop = {r["column"] for r in flags.where(F.col("flag").isin(list(kinds))).select("column").distinct().collect()}
    return df.select(*[c for c in df.columns if c not in drop or c in keep])


# ------------------------------------------------------------------ B3
def _field_type(dt: T.DataType) -> str:
    if isinstance(dt, INTEGRAL):
        return "int"
    if isinstance(dt, FRACTIONAL):
        return "float"
    if isinstance(dt, T.BooleanType):
        return "bool"
    return "str"


def infer_row_schema(df: DataFrame, constraints: DataFrame) -> DataFrame:
    """Row schema from C1 constraints: one row per column with field name, type, bounds and
    whether the field is optional or carries a range validator. Unknown fields are rejected."""
    spark = df.sparkSession
    types = spark.createDataFrame(
        [(f.name, i, _field_type(f.dataType)) for i, f in enumerate(df.schema.fields)],
        "column string, position int, field_type string")
    c = constraints.select("column", "constraint_min", "constraint_max")
    t = types.join(F.broadcast(c), "column", "left")
    lo, hi = F.col("constraint_min"), F.col("constraint_max")
    both = lo.isNotNull() & hi.isNotNull()
    safe = F.lower(F.translate(F.col("column"), " -", "__"))
    return t.select(
        "column", "position", safe.alias("field_name"), "field_type",
        lo.alias("ge"), F.when(both, hi).alias("le"),
        lo.isNull().alias("optional"), both.alias("has_validator"),
        F.lit(True).alias("forbid_extra"))


# ------------------------------------------------------------------ B4 / B5
def _fmt_bound(b: float) -> str:
    return str(int(b)) if float(b).is_integer() else repr(float(b))


def validate_rows(df: DataFrame, constraints: DataFrame, keys: list[str], max_listed: int = 3) -> DataFrame:
    """Per-row VALID / INVALID with the full error array and the first `max_listed` errors
    joined by '; '. Checks per constrained column, in column order: integer-ness (type 'int'),
    value below min, value above max; missing values are skipped. Every row is checked."""
    rules = {r["column"]: r for r in constraints.select("column", "constraint_min", "constraint_max",
                                                         "constraint_type").collect()}
    fields = {f.name: f.dataType for f in df.schema.fields}
    checks: list[Column] = []
    for name in df.columns:
        r = rules.get(name)
        if r is None:
            continue
        dt = fields[name]
        c = F.col(name)
        if isinstance(dt, (T.StringType, T.BooleanType)):
            # non-numeric strings fail float() and are skipped by the range checks
            num = c.try_cast("double") if isinstance(dt, T.StringType) else F.lit(None).cast("double")
        else:
            num = c.cast("double")
        present = c.isNotNull() & ~F.isnan(num) if not isinstance(dt, (T.StringType, T.BooleanType)) else c.isNotNull()
        shown = num.cast("string")
        if r["constraint_type"] == "int" and not isinstance(dt, INTEGRAL):
            pyname = "float" if isinstance(dt, FRACTIONAL) else ("bool" if isinstance(dt, T.BooleanType) else "str")
            bad = num.isNull() | (num != F.floor(num))
            checks.append(F.when(present & bad, F.lit(f"{name}: Expected integer, got {pyname}")))
        if r["constraint_min"] is not None:
            lo = float(r["constraint_min"])
            checks.append(F.when(present & (num < F.lit(lo)),
                                 F.concat(F.lit(f"{name}: Value "), shown, F.lit(f" below minimum {_fmt_bound(lo)}"))))
        if r["constraint_max"] is not None:
            hi = float(r["constraint_max"])
            checks.append(F.when(present & (num > F.lit(hi)),
                                 F.concat(F.lit(f"{name}: Value "), shown, F.lit(f" above maximum {_fmt_bound(hi)}"))))
    errors = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    out = df.select(*keys, errors.alias("errors"))
    n = F.size("errors")
    return out.select(
        *keys,
        F.when(n > 0, F.lit("INVALID")).otherwise(F.lit("VALID")).alias("status"),
        F.when(n > 0, F.concat_ws("; ", F.slice("errors", 1, max_listed))).otherwise(F.lit("-")).alias("error_text"),
        n.alias("n_errors"), "errors")


def validation_report(validated: DataFrame) -> DataFrame:
    """Rows validated, valid / invalid counts and shares (one row)."""
    v = (F.col("status") == "VALID").cast("long")
    return validated.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(v).alias("n_valid")).select(
        "n_rows", "n_valid", (F.col("n_rows") - F.col("n_valid")).alias("n_invalid"),
        (F.col("n_valid") * 100.0 / F.col("n_rows")).alias("valid_pct"),
        ((F.col("n_rows") - F.col("n_valid")) * 100.0 / F.col("n_rows")).alias("invalid_pct"))


def violation_summary(validated: DataFrame, k: int = 5) -> DataFrame:
    """Violations per column (text before the first ':' of every error), the k most frequent."""
    e = validated.select(F.explode("errors").alias("e"))
    g = e.groupBy(F.substring_index("e", ":", 1).alias("column")).agg(F.count(F.lit(1)).alias("n_violations"))
    return g.orderBy(F.desc("n_violations"), "column").limit(k)


# ------------------------------------------------------------------ B6 / B7
def filter_metadata(df: DataFrame, match: dict, metadata_col: str | None = None) -> DataFrame:
    """Conjunctive equality; keys are columns, or keys of a map column `metadata_col`."""
    cond = F.lit(True)
    for k, v in match.items():
        c = F.col(metadata_col)[k] if metadata_col else F.col(k)
        cond = cond & c.eqNullSafe(F.lit(v))
    return df.where(cond)


def recent(df: DataFrame, asof: str, hours: float = 24, ts_col: str = "ts", severity: str | None = None,
           severity_col: str = "severity") -> DataFrame:
    """Rows with ts strictly after `asof` minus `hours` (and the given severity). `asof` is a
    parameter so results do not depend on the wall clock; the bound is a literal, so the
    comparison is pushed into the Parquet scan."""
    lo = F.lit(asof).cast("timestamp") - F.expr(f"INTERVAL {int(round(hours * 3600))} SECONDS")
    out = df.where(F.col(ts_col).cast("timestamp") > lo)
    if severity is not None:
        out = out.where(F.col(severity_col) == severity)
    return out


# ------------------------------------------------------------------ B9
def review_gate(df: DataFrame, flag_col: str, threshold: float = 0.2) -> DataFrame:
    """One row: flagged share and whether it exceeds `threshold` (pipeline stops for review)."""
    f = F.coalesce(F.col(flag_col).cast("long"), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(f).alias("n_flagged")).select(
        "n_rows", F.coalesce(F.col("n_flagged"), F.lit(0)).alias("n_flagged"),
        F.coalesce(F.col("n_flagged") / F.col("n_rows"), F.lit(0.0)).alias("flagged_share"),
        (F.coalesce(F.col("n_flagged") / F.col("n_rows"), F.lit(0.0)) > threshold).alias("requires_review"))


# ------------------------------------------------------------------ B10
def stratified_flag(df: DataFrame, strata: list[str], fraction: float, order: Column, flag: str = "_in_sample",
                    n_buckets: int = 1024) -> DataFrame:
    """Every row of `df` plus a boolean `flag` that is true for exactly round(fraction * n_s) rows
    of every stratum s: the rows with the smallest `order` values (a deterministic hash, e.g.
    `xxhash64(key, seed)`; ties by the remaining columns).

    No window spans a whole stratum: `order` is bucketed, a partial-aggregated histogram per
    (stratum, bucket) tells how many rows of each bucket the quota takes, buckets that it takes
    whole or not at all are flagged outright, and only the boundary bucket (about 1/n_buckets of
    the stratum) is ranked with a window. A hot stratum therefore costs one bucket-sized sort.
    The histogram is stored, so its size is known: a small one is broadcast and the rows stay where
    they are; else rows meet it by stratum and bucket. No task gathers a stratum.
    """
    from pyspark.sql.window import Window
    o = df.withColumn("_o", order)
    rng = o.agg(F.min("_o").alias("lo"), F.max("_o").alias("hi"))
    width = (F.col("hi").cast("double") - F.col("lo").cast("double") + 1.0) / n_buckets
    b = F.least(F.floor((F.col("_o").cast("double") - F.col("lo").cast("double")) / width).cast("int"),
                F.lit(n_buckets - 1))
    ob = o.crossJoin(F.broadcast(rng)).withColumn("_b", b).drop("lo", "hi")   # one-row broadcast
    hist = ob.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # histogram rows are (strata x n_buckets) at most: the windows are over counts, not rows
    cum = hist.withColumn("_cum", F.sum("_n").over(w)).withColumn(
        "_quota", F.round(F.sum("_n").over(Window.partitionBy(*strata)) * F.lit(fraction)).cast("long"))
    takes = materialize(cum.select(
        *[F.col(c).alias(f"_s{i}") for i, c in enumerate(strata)], F.col("_b").alias("_bucket"), F.col("_n").alias("_of"),
        (F.col("_quota") - (F.col("_cum") - F.col("_n"))).alias("_need")))
    same = [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(strata)]     # a NULL stratum is a stratum
    j = ob.join(takes, [*same, F.col("_b") == F.col("_bucket")], "left").drop(*[f"_s{i}" for i in range(len(strata))])
    at_edge = F.coalesce((F.col("_need") > 0) & (F.col("_need") < F.col("_of")), F.lit(False))
    rest = j.where(~at_edge).withColumn(flag, F.coalesce(F.col("_need") >= F.col("_of"), F.lit(False)))
    # a stratum has one boundary bucket at most, so ranks within (stratum, bucket) are ranks within it
    rk = Window.partitionBy(*strata, "_b").orderBy("_o", *[c for c in df.columns if c not in strata])
    at = j.where(at_edge).withColumn(flag, F.row_number().over(rk) <= F.col("_need"))
    return rest.unionByName(at).select(*df.columns, flag)


def stratified_sample(df: DataFrame, strata: list[str], fraction: float, order: Column,
                      n_buckets: int = 1024) -> DataFrame:
    """Exactly round(fraction * n_s) rows of every stratum (see `stratified_flag`)."""
    return stratified_flag(df, strata, fraction, order, "_in_sample", n_buckets).where("_in_sample").drop("_in_sample")
