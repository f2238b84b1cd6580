"""Column-expression helpers (all JVM-side built-ins, no UDFs)."""

from tabvet.functions.core import (  # noqa: F401
    categorical_cols,
    kurtosis_unbiased,
    nan_to_null,
    numeric_cols,
    safe_div,
    skewness_unbiased,
    temporal_cols,
)
