"""Sources and sinks (A-series)."""

from tabvet.sources.tables import TABLES, load_table  # noqa: F401
