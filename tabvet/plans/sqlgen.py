"""Small helpers that write the DuckDB oracle SQL (result-sized, one SELECT per column)."""

from __future__ import annotations


def r6(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits})"


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body
