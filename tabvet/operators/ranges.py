"""Range rules of measurements (C7, C8, D20), readiness checklist (H19), advice from a dataset's shape (I17), and search
among past experiments (K10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvet.functions.core import NUMERIC_TYPES, nan_to_null
from tabvet.operators.colstats import column_stats
from tabvet.operators.profile import overview
from tabvet.operators.registry_log import first_rule

# ---- fixed values: name patterns (of names in lower case without _ and spaces), possible and typical range of each type ----
CLINICAL = {
    "age": (("age", "patient_age", "age_years", "años"), (0, 120), (18, 85)),
    "blood_pressure_systolic": (("systolic", "sbp", "sys_bp", "blood_pressure_sys"), (70, 250), (90, 140)),
    "blood_pressure_diastolic": (("diastolic", "dbp", "dia_bp", "blood_pressure_dia"), (40, 150), (60, 90)),
    "heart_rate": (("heart_rate", "pulse", "hr", "bpm", "heartrate"), (30, 220), (60, 100)),
    "bmi": (("bmi", "body_mass_index", "bodymassindex"), (10, 60), (18.5, 30)),
    "weight": (("weight", "body_weight", "mass", "kg", "weight_kg"), (20, 300), (50, 100)),
    "height": (("height", "stature", "height_cm"), (100, 250), (150, 190)),
    "cholesterol_total": (("cholesterol", "total_chol", "chol", "totalcholesterol"), (100, 400), (150, 200)),
    "cholesterol_hdl": (("hdl", "hdl_chol", "good_cholesterol", "highchol"), (20, 100), (40, 60)),
    "cholesterol_ldl": (("ldl", "ldl_chol", "bad_cholesterol"), (50, 250), (70, 130)),
    "triglycerides": (("triglycerides", "trig", "trigs"), (30, 500), (50, 150)),
    "blood_glucose": (("glucose", "blood_sugar", "fasting_glucose", "sugar", "bloodsugar"), (40, 500), (70, 100)),
    "hba1c": (("hba1c", "a1c", "glycated", "hemoglobin_a1c"), (4, 15), (4, 5.7)),
    "temperature": (("temperature", "temp", "body_temp", "fever"), (35, 42), (36.1, 37.2)),
    "oxygen_saturation": (("spo2", "oxygen", "saturation", "o2_sat", "oxygensaturation"), (70, 100), (95, 100)),
    "respiratory_rate": (("respiratory", "resp_rate", "breathing", "rr"), (8, 40), (12, 20)),
    "creatinine": (("creatinine", "creat", "serum_creatinine"), (0.3, 15), (0.6, 1.2)),
}
BINARY_VALUES = ("0", "1", "true", "false", "yes", "no", "Yes", "No", "YES", "NO")
ID_PATTERNS = ("id", "key", "index", "code")
CRITICAL_PCT, WARNING_PCT, COMPLETENESS_WEIGHT, VALIDITY_WEIGHT = 30, 15, 0.4, 0.6


def named_type(column: str) -> str | None:
    """The first type of the table whose pattern the column's plain name holds."""
    plain = column.lower().replace("_", "").replace(" ", "")
    return next((kind for kind, (patterns, _, _) in CLINICAL.items() if any(p in plain for p in patterns)), None)


def clinical_types(df: DataFrame) -> DataFrame:
    """Column, semantic_type, finding and n_null for every column, in one pass over the rows and one over distinct values.

    In order: two values out of yes / no / 0 / 1 / true / false are a binary flag; text with at most 10 values is
    categorical; text or whole numbers without repetition under an id-like name are an identifier; numbers get the type their
    name suggests, with finding `typical` or `atypical` by their mean if all values lie in the possible range (20 % more on
    either side), else `by name`; other numbers are continuous (fractional, or a spread above 10) or discrete."""
    stats = column_stats(df)
    flags = df.agg(*[F.coalesce(F.bool_and(F.col(f"`{c}`").cast("string").isin(*BINARY_VALUES)), F.lit(False)).alias(c) for c in df.columns])
    binary = flags.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("two")) for c in df.columns])).alias("b")).select("b.*")
    rows = []
    for f in df.schema.fields:
        plain = f.name.lower().replace("_", "").replace(" ", "")
        kind = named_type(f.name)
        _, possible, typical = CLINICAL[kind] if kind else ((), (None, None), (None, None))
        whole = isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        text = isinstance(f.dataType, T.StringType)
        rows.append((f.name, kind, *map(_float, (*possible, *typical)), text, text or whole, any(p in plain for p in ID_PATTERNS), isinstance(f.dataType, (T.DoubleType, T.FloatType))))
    rules = df.sparkSession.createDataFrame(rows, "column string, kind string, low double, high double, typical_low double, typical_high double, text boolean, id_type boolean, id_name boolean, fractional boolean")
    s = stats.join(F.broadcast(rules), "column").join(F.broadcast(binary), "column")  # one row a column
    present = F.col("n_rows") - F.col("n_null")
    within = (F.col("min") >= F.col("low") * 0.8) & (F.col("max") <= F.col("high") * 1.2)
    flag = (F.col("n_distinct") == 2) & F.col("two")
    categorical = (F.col("n_distinct") <= 10) & F.col("text")
    identifier = (F.col("n_distinct") == present) & F.col("id_type") & F.col("id_name")
    named = F.col("is_numeric") & F.col("kind").isNotNull()
    generic = F.when(F.col("fractional") | (F.col("max") - F.col("min") > 10), F.lit("continuous")).otherwise(F.lit("discrete"))
    kind = F.when(flag, "binary_flag").when(categorical, "categorical").when(identifier, "identifier").when(named, F.col("kind")) \
        .when(F.col("is_numeric"), generic).otherwise("unknown")
    finding = F.when(~(flag | categorical | identifier) & named, F.when(within, F.when(F.col("mean").between(F.col("typical_low"), F.col("typical_high")), "typical")
                                                                      .otherwise("atypical")).otherwise("by name")).otherwise("generic")
    return s.select("column", "position", kind.alias("semantic_type"), finding.alias("finding"), "n_null", "n_distinct")


def _float(x) -> float | None:
    return None if x is None else float(x)


def typical_ranges(types: DataFrame) -> dict[str, tuple[float, float]]:
    """The typical range of every column that clinical_types gave one of the table's types (a row a column)."""
    return {r.column: CLINICAL[r.semantic_type][2] for r in types.where(F.col("semantic_type").isin(*CLINICAL)).collect()}


def range_risk(df: DataFrame, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """Column, share of present values outside the typical range in percent, and the level: critical above 30, warning
    above 15, else normal; unknown without values. One aggregate over all rows."""
    if not rules:
        return df.sparkSession.createDataFrame([], "column string, low double, high double, pct_outside double, risk string")
    out = df.agg(*[F.avg(F.when((x < lo) | (x > hi), 1.0).when(x.isNotNull(), 0.0)).alias(f"p{i}") for i, (x, (lo, hi)) in enumerate((nan_to_null(F.col(f"`{c}`")), r) for c, r in rules.items())])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(float(lo)).alias("low"), F.lit(float(hi)).alias("high"), (F.col(f"p{i}") * 100).alias("pct_outside"))
                     for i, (c, (lo, hi)) in enumerate(rules.items())])
    p = F.col("pct_outside")
    level = F.when(p.isNull(), "unknown").when(p > CRITICAL_PCT, "critical").when(p > WARNING_PCT, "warning").otherwise("normal")
    return out.select(F.explode(rows).alias("r")).select("r.*").withColumn("risk", level)


def quality_score_ranges(df: DataFrame) -> DataFrame:
    """One row: completeness (percent of cells present), validity (percent of range-typed columns with normal risk, 100
    without any), their weighted sum, and what was counted."""
    types = clinical_types(df)
    risks = range_risk(df, typical_ranges(types))
    found = risks.agg(F.count(F.lit(1)).alias("typed"), F.count_if(F.col("risk") == "normal").alias("valid"), F.count_if(F.col("risk") != "normal").alias("risk_warnings"))
    repeated = types.agg(F.count_if((F.col("semantic_type") == "identifier") & (F.col("n_null") > 0)).alias("identifier_gaps"))
    one = overview(df).select("n_rows", "missing_pct").crossJoin(found).crossJoin(repeated)  # one row each
    complete = 100 - F.col("missing_pct")
    valid = F.when(F.col("typed") > 0, F.col("valid") / F.col("typed") * 100).otherwise(100.0)
    return one.select(F.round(complete * COMPLETENESS_WEIGHT + valid * VALIDITY_WEIGHT, 1).alias("overall_score"), F.round(complete, 1).alias("completeness_score"),
                      F.round(valid, 1).alias("validity_score"), F.col("typed").cast("long").alias("typed_columns"),
                      F.col("risk_warnings").cast("long").alias("risk_warnings"), F.col("identifier_gaps").cast("long").alias("identifier_gaps"))


# ------------------------------------------------------------------ H19
def readiness_checklist(df: DataFrame, target: str | None, model: str | None = None, score: float = 0.0, documented: int = 0) -> DataFrame:
    """Eight checks with status, points and most, from facts of the table and what is known of the model.

    model is the trained model's name, score its best score, documented the number of features with a description. The
    facts come from one pass for missing cells and one count by class; a target with more than 20 values, or none, is not
    judged for balance and keeps its points."""
    numeric = sum(isinstance(f.dataType, NUMERIC_TYPES) for f in df.schema.fields)
    one = overview(df).select("n_rows", "missing_pct")
    if target in df.columns:
        counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
        known = F.col(target).isNotNull()
        facts = counts.agg(F.count(F.when(known, 1)).alias("classes"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("nulls"),
                           (F.min(F.when(known, F.col("n"))) / F.sum(F.when(known, F.col("n"))) * 100).alias("least"))
        one = one.crossJoin(facts)  # one row
    else:
        one = one.withColumns({"classes": F.lit(None).cast("long"), "nulls": F.lit(None).cast("long"), "least": F.lit(None).cast("double")})
    rows, missing, least, nulls = F.col("n_rows"), F.col("missing_pct"), F.col("least"), F.col("nulls")
    judged = (F.col("classes") <= 20) & least.isNotNull()

    def check(order: int, name: str, most: int, status: Column, points: dict[str, int]) -> Column:
        earned = F.lit(0)
        for s, p in points.items():
            earned = F.when(status == s, p).otherwise(earned)
        return F.struct(F.lit(order).alias("position"), F.lit(name).alias("check"), status.alias("status"), earned.alias("points"), F.lit(most).alias("most"))

    checks = [
        check(1, "Model Trained", 20, F.lit("PASS" if model else "FAIL"), {"PASS": 20}),
        check(2, "Data Quality", 15, first_rule([(missing < 5, "PASS"), (missing < 15, "WARN")], "FAIL"), {"PASS": 15, "WARN": 8}),
        check(3, "Feature Count", 10, F.lit("PASS" if 5 <= numeric <= 100 else "WARN" if numeric > 100 else "FAIL"), {"PASS": 10, "WARN": 5}),
        check(4, "Model Performance", 20, F.lit("PASS" if score >= 0.85 else "WARN" if score >= 0.7 else "FAIL"), {"PASS": 20, "WARN": 10}),
        check(5, "Sample Size", 10, first_rule([(rows >= 1000, "PASS"), (rows >= 500, "WARN")], "FAIL"), {"PASS": 10, "WARN": 5}),
        check(6, "Target Variable", 10, first_rule([(nulls == 0, "PASS"), (nulls > 0, "WARN")], "FAIL"), {"PASS": 10, "WARN": 5}),
        check(7, "Class Balance", 10, first_rule([(~judged, "N/A"), (least >= 20, "PASS"), (least >= 10, "WARN")], "FAIL"), {"PASS": 10, "WARN": 5, "N/A": 10}),
        check(8, "Feature Documentation", 5, F.lit("PASS" if documented > numeric * 0.5 else "WARN"), {"PASS": 5, "WARN": 2}),
    ]
    return one.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


# ------------------------------------------------------------------ I17
# ---- fixed values: next algorithms to try after each ----
ALTERNATIVES = {
    "LogisticRegression": ["RandomForest", "SVC"],
    "RandomForest": ["XGBoost", "LightGBM", "GradientBoosting"],
    "XGBoost": ["LightGBM", "GradientBoosting"],
    "LightGBM": ["XGBoost", "GradientBoosting"],
    "GradientBoosting": ["XGBoost", "RandomForest"],
    "NaiveBayes": ["LogisticRegression", "RandomForest"],
    "SVC": ["RandomForest", "LogisticRegression"],
}


def recommend_architecture(shapes: DataFrame) -> DataFrame:
    """Algorithm, preprocessing steps, alternatives and confidence for every row of shapes.

    shapes has size_class, categorical_count, has_text, dimensionality (as `dataset_shape` gives them), classes (NULL for a
    numeric target) and quality_level; other columns stay. Any number of datasets is judged in one projection."""
    size, kinds, level = F.col("size_class"), F.col("classes"), F.col("quality_level")
    low, high = F.col("dimensionality") == "low", F.col("dimensionality") == "high"
    binary = [
        ((size == "tiny") | ((size == "small") & (level == "poor")), "LogisticRegression", "handle_missing,scale_features,remove_outliers"),
        (size.isin("small", "medium") & low, "RandomForest", "handle_missing,encode_categorical,scale_features"),
        (size.isin("medium", "large") & (F.col("categorical_count") > 5), "LightGBM", "handle_missing,encode_categorical,feature_selection"),
        ((size == "large") & high, "XGBoost", "handle_missing,feature_engineering,scale_features"),
        (F.col("has_text"), "NaiveBayes", "handle_missing,vectorize_text,encode_categorical"),
    ]
    two = first_rule([(c, a) for c, a, _ in binary], "RandomForest")
    two_steps = first_rule([(c, s) for c, _, s in binary], "handle_missing,encode_categorical,scale_features")
    many = first_rule([(size.isin("small", "medium"), "RandomForest"), ((size == "large") & high, "XGBoost")], "LightGBM")
    number = first_rule([(size.isin("small", "medium"), "RandomForest"), (size == "large", "GradientBoosting")], "LightGBM")
    problem = F.when(kinds.isNull(), "regression").when(kinds == 2, "binary").otherwise("multiclass")
    algorithm = F.when(problem == "binary", two).when(problem == "multiclass", many).otherwise(number)
    steps = F.when(problem == "binary", two_steps).when(problem == "multiclass", "handle_missing,encode_categorical,feature_selection") \
        .otherwise("handle_missing,scale_features,handle_outliers")
    confidence = F.when(problem == "binary", F.when(level == "good", 0.95).otherwise(0.80)).when(problem == "multiclass", 0.90).otherwise(0.85)
    others = first_rule([(F.col("algorithm") == a, ",".join(names)) for a, names in ALTERNATIVES.items()], "RandomForest,XGBoost")
    return shapes.withColumns({"problem": problem, "algorithm": algorithm, "preprocessing": steps, "confidence": confidence}).withColumn("alternatives", others)


# ------------------------------------------------------------------ K10
def experiment_text(run_id: str = "run_id", at: str = "at", dataset: str = "dataset", target: str = "target", model: str = "model",
                    metrics: dict[str, str] | None = None) -> Column:
    """A run as text, one line a fact; missing facts read N/A."""
    def fact(name: str, column: str) -> Column:
        return F.concat(F.lit(f"{name}: "), F.coalesce(F.col(column).cast("string"), F.lit("N/A")))

    lines = [fact("Experiment ID", run_id), fact("Timestamp", at), fact("Dataset", dataset), fact("Target Column", target), fact("Best Model", model), F.lit("Metrics:")]
    lines += [F.concat(F.lit(f"  - {name}: "), F.coalesce(F.col(c).cast("string"), F.lit("N/A"))) for name, c in (metrics or {}).items()]
    return F.concat_ws("\n", *lines)
