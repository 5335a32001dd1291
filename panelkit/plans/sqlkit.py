"""Small SQL text helpers for the oracle side (plain string building)."""

from __future__ import annotations


def mode_cte(name: str, src: str, keys: list[str], col: str, out: str) -> str:
    """CTE ``name`` with keys + ``out`` = most frequent non-null ``col`` per
    key, smallest value on ties."""
    k = ", ".join(keys)
    return (f"{name}_c AS (SELECT {k}, {col} AS v, count(*) AS n FROM {src} "
            f"WHERE {col} IS NOT NULL GROUP BY {k}, {col}),\n"
            f"{name} AS (SELECT {k}, first(v ORDER BY n DESC, v) AS {out} FROM {name}_c GROUP BY {k})")


def join_on(keys: list[str], a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
