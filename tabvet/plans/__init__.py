"""Query plans: deterministic fixtures, registered queries and their DuckDB oracles."""
