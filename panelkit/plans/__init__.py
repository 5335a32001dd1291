"""Query catalogue over the driver tables (see ``roles`` for the mapping)."""

from .registry import ORACLE, QUERIES, load_all

__all__ = ["ORACLE", "QUERIES", "load_all"]
