"""tabvet: data-quality, drift, evaluation, retrieval and monitoring operators on Spark.

Every operator takes DataFrames and returns a DataFrame (or a fitted Spark ML model).
Operators run over whole tables: no sampling caps, no driver-side loops over rows.
"""

from tabvet.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
