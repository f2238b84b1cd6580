"""C-series: column typing and inference.

Statistics come from one long-form aggregate over the data (column_stats) plus one pass of
string checks; the name rules then run as Spark expressions over a one-row-per-column table
(`rlike` on the column-name column), so the whole result is a DataFrame plan with no driver
loop over data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.functions import rules as R
from tabvet.functions.core import NUMERIC_TYPES
from tabvet.operators.colstats import column_stats
from tabvet.operators.longform import unpivot


def _first_match(name: Column, patterns: list[tuple[str, str]], default=None) -> Column:
    expr = None
    for label, pat in patterns:
        expr = F.when(name.rlike(pat), F.lit(label)) if expr is None else expr.when(name.rlike(pat), F.lit(label))
    return expr.otherwise(F.lit(default))


def _lookup(key: Column, mapping: dict, default) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def string_checks(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per string column: any value with '@' and '.', any starting with http / www., any phone-like."""
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, has_email boolean, has_url boolean, has_phone boolean")
    v = F.col("value")
    return unpivot(df, cols, cast="string").groupBy("column").agg(
        F.max(v.contains("@") & v.contains(".")).alias("has_email"),
        F.max(v.startswith("http") | v.startswith("www.")).alias("has_url"),
        F.max(v.rlike(r"^[\d\-\+\(\)\s]{7,}$")).alias("has_phone"))


def semantic_types(df: DataFrame) -> DataFrame:
    """C1 + C2: name patterns (first match, confidence 0.85, category, domain constraints), else
    statistical fallback on full-column statistics."""
    st = column_stats(df)
    str_cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    sc = string_checks(df, str_cols)
    t = st.join(F.broadcast(sc), "column", "left")       # one row per column
    name = F.col("column")
    by_name = _first_match(name, R.SEMANTIC_PATTERNS)
    ratio = F.when(F.col("n_rows") > 0, F.col("n_distinct") / F.col("n_rows")).otherwise(0.0)
    nd = F.col("n_distinct")
    num_type = (F.when(nd == 2, "binary_numeric").when((ratio < 0.02) & (nd <= 10), "ordinal")
                .when((F.col("min") >= 0) & (F.col("max") <= 1), "probability_or_ratio")
                .when((F.col("min") >= 0) & (F.col("max") <= 100), "percentage_or_score")
                .when(F.col("min") >= 0, "positive_numeric").otherwise("numeric"))
    num_conf = (F.when(nd == 2, 0.9).when((ratio < 0.02) & (nd <= 10), 0.75)
                .when((F.col("min") >= 0) & (F.col("max") <= 1), 0.7)
                .when((F.col("min") >= 0) & (F.col("max") <= 100), 0.6).otherwise(0.5))
    str_type = (F.when(F.col("has_email"), "email").when(F.col("has_url"), "url").when(F.col("has_phone"), "phone")
                .when(nd == 2, "binary_category").when(nd <= 10, "low_cardinality_category").when(nd <= 50, "category")
                .when(ratio > 0.9, "identifier_or_text").otherwise("categorical"))
    str_conf = (F.when(F.col("has_email") | F.col("has_url"), 0.9).when(F.col("has_phone"), 0.7).when(nd == 2, 0.85)
                .when(nd <= 10, 0.7).when(nd <= 50, 0.6).when(ratio > 0.9, 0.6).otherwise(0.5))
    dt = F.col("dtype")
    temporal = dt.startswith("timestamp") | (dt == "date")
    fb_type = (F.when(F.col("is_numeric"), num_type).when(dt == "string", str_type).when(temporal, "datetime")
               .when(dt == "boolean", "boolean").otherwise("unknown"))
    fb_conf = (F.when(F.col("is_numeric"), num_conf).when(dt == "string", str_conf).when(temporal | (dt == "boolean"), 0.95)
               .otherwise(0.0))
    detected = F.coalesce(by_name, fb_type)
    cmin = {k: v[0] for k, v in R.DOMAIN_CONSTRAINTS.items() if v[0] is not None}
    cmax = {k: v[1] for k, v in R.DOMAIN_CONSTRAINTS.items() if v[1] is not None}
    ctyp = {k: v[2] for k, v in R.DOMAIN_CONSTRAINTS.items()}
    out = t.select("column", "position", by_name.alias("_by_name"), detected.alias("detected_type"),
                   F.when(by_name.isNotNull(), F.lit(0.85)).otherwise(fb_conf).cast("double").alias("confidence"),
                   F.when(by_name.isNotNull(), F.lit("column_name_pattern")).otherwise(F.lit("heuristics")).alias("inferred_from"),
                   (F.col("is_numeric") & by_name.isNull() & (fb_type == "positive_numeric")).alias("_pos"))
    cat = F.when(F.col("_by_name").isNotNull(), _lookup(F.col("_by_name"), R.CATEGORY_MAP, "Feature")).otherwise(F.lit("Unknown"))
    has_dom = F.col("_by_name").isin(list(R.DOMAIN_CONSTRAINTS))
    return out.select(
        "column", "position", "detected_type", cat.alias("category"), "confidence", "inferred_from",
        F.when(has_dom, F.col("_by_name")).alias("domain"),
        F.when(has_dom, _lookup(F.col("_by_name"), cmin, None).cast("double")).when(F.col("_pos"), F.lit(0.0)).alias("constraint_min"),
        F.when(has_dom, _lookup(F.col("_by_name"), cmax, None).cast("double")).alias("constraint_max"),
        F.when(has_dom, _lookup(F.col("_by_name"), ctyp, None)).when(F.col("_pos"), F.lit("float")).alias("constraint_type"))


def categorize_columns(df: DataFrame) -> DataFrame:
    """ID / TARGET / TEMPORAL / CATEGORICAL / CONTINUOUS from name fragments and cardinality."""
    st = column_stats(df, numeric_stats=False)
    low = F.lower(F.col("column"))

    def any_of(frags: list[str]) -> Column:
        c = None
        for f in frags:
            c = low.contains(f) if c is None else (c | low.contains(f))
        return c

    nd, n = F.col("n_distinct"), F.col("n_rows")
    dt = F.col("dtype")
    temporal_type = dt.startswith("timestamp") | (dt == "date")
    cat = (F.when(any_of(R.ID_PATTERNS) & (nd > n * 0.9), "ID")
           .when(any_of(R.TARGET_PATTERNS) & (nd <= 10), "TARGET")
           .when(any_of(R.TEMPORAL_PATTERNS) | temporal_type, "TEMPORAL")
           .when(F.col("is_numeric") & ((nd < n * 0.05) | (nd <= 20)), "CATEGORICAL")
           .when(F.col("is_numeric"), "CONTINUOUS")
           .when((nd < n * 0.05) | (nd <= 50), "CATEGORICAL")
           .when(nd > n * 0.9, "ID").otherwise("CATEGORICAL"))
    return st.select("column", "position", "n_distinct", cat.alias("category"))


def value_patterns(df: DataFrame, cols: list[str] | None = None, threshold: float = 0.8) -> DataFrame:
    """C4: share of non-null values fully matching each pattern (all values); type if share > 80 %."""
    cols = cols or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    v = F.col("value")
    g = unpivot(df, cols, cast="string").groupBy("column").agg(
        *[F.avg(v.rlike(p).cast("double")).alias(n) for n, p in R.VALUE_PATTERNS])
    best = None
    for n, _ in R.VALUE_PATTERNS:
        best = F.when(F.col(n) > threshold, F.lit(n)) if best is None else best.when(F.col(n) > threshold, F.lit(n))
    return g.select("column", *[F.col(n).alias(f"share_{n.lower()}") for n, _ in R.VALUE_PATTERNS], best.alias("pattern_type"))


def value_range_types(df: DataFrame) -> DataFrame:
    """BINARY ({0,1}), PERCENTAGE_VALUE (0..100), YEAR (integral 1900..2100), AGE (name + 0..120)
    per numeric column. BINARY is tested before PERCENTAGE_VALUE (documented deviation)."""
    st = column_stats(df)
    low = F.lower(F.col("column"))
    integral = F.col("dtype").isin("tinyint", "smallint", "int", "bigint")
    mn, mx = F.col("min"), F.col("max")
    typ = (F.when((mn >= 0) & (mx <= 120) & low.contains("age"), "AGE")
           .when(F.col("_binary"), "BINARY")
           .when((mn >= 0) & (mx <= 100), "PERCENTAGE_VALUE")
           .when((mn >= 1900) & (mx <= 2100) & integral, "YEAR")
           .otherwise("GENERIC"))
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]
    b = unpivot(df, num).groupBy("column").agg(F.bool_and((F.col("value") == 0) | (F.col("value") == 1)).alias("_binary"))
    return st.where(F.col("is_numeric")).join(F.broadcast(b), "column", "left").select("column", typ.alias("value_type"))


def domain_profile(df: DataFrame) -> DataFrame:
    """Keyword hits per domain over the space-joined lower-case column names; primary domain and
    confidence min(score / 3, 1)."""
    names = " ".join(c.lower() for c in df.columns)
    spark = df.sparkSession
    rows = [(d, k) for d, ks in R.DOMAIN_KEYWORDS for k in ks]
    kw = spark.createDataFrame(rows, "domain string, keyword string")
    hits = kw.withColumn("hit", F.lit(names).contains(F.col("keyword")))
    order = {d: i for i, (d, _) in enumerate(R.DOMAIN_KEYWORDS)}
    sc = hits.groupBy("domain").agg(F.sum(F.col("hit").cast("int")).alias("score"),
                                    F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("keyword")))).alias("matched_keywords"))
    sc = sc.withColumn("domain_order", _lookup(F.col("domain"), order, 99))
    top = sc.orderBy(F.desc("score"), "domain_order").limit(1).select(
        F.when(F.col("score") > 0, F.col("domain")).otherwise("GENERAL").alias("primary_domain"),
        F.when(F.col("score") > 0, F.least(F.col("score") / 3.0, F.lit(1.0))).otherwise(0.0).alias("confidence"))
    return sc.crossJoin(top).select("domain", "score", "matched_keywords", "primary_domain", "confidence")


def domain_hints(df: DataFrame) -> DataFrame:
    """C6 per column: first domain whose keyword is a substring of the column name."""
    spark = df.sparkSession
    cols = spark.createDataFrame([(c, i) for i, c in enumerate(df.columns)], "column string, position int")
    low = F.lower(F.col("column"))
    expr = None
    for dom, kws in R.DOMAIN_KEYWORDS:
        for k in kws:
            expr = F.when(low.contains(k), F.lit(dom)) if expr is None else expr.when(low.contains(k), F.lit(dom))
    return cols.select("column", "position", expr.otherwise(F.lit(None).cast("string")).alias("domain_hint"))


def target_candidates(df: DataFrame) -> DataFrame:
    """50 for a target-like name, +30 for 2 distinct values (+20 for 3..10), +10 for the last column."""
    st = column_stats(df, numeric_stats=False)
    last = df.columns[-1]
    nd = F.col("n_distinct")
    score = (F.when(F.col("column").rlike(R.TARGET_NAME_PATTERN), 50).otherwise(0)
             + F.when(nd == 2, 30).when((nd > 2) & (nd <= 10), 20).otherwise(0)
             + F.when(F.col("column") == last, 10).otherwise(0))
    return st.select("column", "position", score.alias("score"))


def task_type(df: DataFrame, target: str) -> DataFrame:
    """Classification when the target has <= 20 distinct values or is text, else regression."""
    is_text = df.schema[target].dataType.simpleString() == "string"
    return df.agg(F.countDistinct(target).alias("n_distinct")).select(
        F.lit(target).alias("target"), "n_distinct",
        F.when((F.col("n_distinct") <= 20) | F.lit(is_text), "classification").otherwise("regression").alias("task_type"))


def sensitive_columns(df: DataFrame, target: str | None = None, k: int | None = None) -> DataFrame:
    """C11: 2..10 distinct values and a sensitive name pattern, or <= 5 distinct ('demographic');
    all of them, or the first k in schema order."""
    # positions stay those of the input schema; the target is dropped after the aggregate
    st = column_stats(df, df.columns, numeric_stats=False).where(F.col("column") != F.lit(target or ""))
    nd = F.col("n_distinct")
    by_name = _first_match(F.col("column"), R.SENSITIVE_PATTERNS)
    typ = F.when((nd <= 10) & (nd >= 2) & by_name.isNotNull(), by_name).when((nd <= 10) & (nd >= 2) & (nd <= 5), F.lit("demographic"))
    found = st.select("column", "position", "n_distinct", typ.alias("sensitive_type")).where(F.col("sensitive_type").isNotNull())
    return found if k is None else found.orderBy("position").limit(k)
