"""The library's scalar and table functions for use in `spark.sql` text.

Expressions become SQL functions, which Spark inlines into the plan, so they run like the Column builders they repeat; the
p-value helpers, which have no built-in form, are registered as the vectorised functions that the DataFrame side uses.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tabvet.functions.stats import chi2_sf, erfc_udf, t_sf_two_sided

VECTORISED = {"chi2_sf": chi2_sf, "t_sf_two_sided": t_sf_two_sided, "erfc": erfc_udf}

#: name -> definition after `CREATE OR REPLACE TEMPORARY FUNCTION`.
EXPRESSIONS = {
    "safe_div": r"safe_div(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN IF(b <> 0, a / b, NULL)",
    "nan_to_null": r"nan_to_null(x DOUBLE) RETURNS DOUBLE RETURN nanvl(x, NULL)",
    "normalize_ws": r"normalize_ws(t STRING) RETURNS STRING RETURN trim(regexp_replace(t, '\\s+', ' '))",
    "slug": r"slug(t STRING) RETURNS STRING RETURN coalesce(nullif(regexp_replace(regexp_replace(t, '[^a-zA-Z0-9._-]+', '_'), '^_+|_+$', ''), ''), if(t IS NULL, NULL, 'document'))",
    "psi_term": r"psi_term(base DOUBLE, cur DOUBLE) RETURNS DOUBLE RETURN (greatest(cur, 1e-10D) - greatest(base, 1e-10D)) * ln(greatest(cur, 1e-10D) / greatest(base, 1e-10D))",
    "word_chunks": r"""word_chunks(t STRING, size INT, overlap INT) RETURNS TABLE (chunk INT, total_chunks INT, text STRING)
        RETURN SELECT c, n, array_join(slice(w, c * (size - overlap) + 1, size), ' ')
        FROM (SELECT w, n, explode(sequence(0, n - 1)) AS c
              FROM (SELECT w, CAST(ceil(size(w) / (size - overlap)) AS INT) AS n FROM (SELECT split(trim(t), '\\s+') AS w) WHERE trim(t) <> ''))""",
}


def registered(spark: SparkSession) -> set[str]:
    """Names of ours that the session's catalog knows."""
    names = [*VECTORISED, *EXPRESSIONS]
    return {n for n in names if spark.catalog.functionExists(n)}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session, each once; returns the names that were new. Temporary: nothing is written."""
    known = registered(spark)
    new = [n for n in [*VECTORISED, *EXPRESSIONS] if n not in known]
    for name in new:
        if name in VECTORISED:
            spark.udf.register(name, VECTORISED[name])
        else:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {EXPRESSIONS[name]}")
    return new
