"""Query catalogue: each entry is a Spark callable ``(spark, root) ->
DataFrame`` plus, where the result is SQL-expressible, an equivalent ANSI
SQL text over the same tables (the independent oracle)."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every catalogue module (registration happens on import)."""
    import importlib
    for m in CATALOGUE_MODULES:
        importlib.import_module(f"{__package__}.{m}")


CATALOGUE_MODULES = ["q_build", "q_quality", "q_describe", "q_panel", "q_stats",
                     "q_evaluate", "q_prescribe", "q_forecast", "q_models"]
