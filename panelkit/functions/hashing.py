"""Content hashes (lineage / ledger): all computed by Spark's ``sha2``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_hex(c) -> Column:
    """SHA-256 hex of a binary or string column."""
    return F.sha2(F.col(c) if isinstance(c, str) else c, 256)


def canonical_json(*cols) -> Column:
    """JSON text of a struct of the named columns (field order is given by
    the caller, so the text is canonical for a fixed column list)."""
    return F.to_json(F.struct(*[F.col(c) if isinstance(c, str) else c for c in cols]))


def row_hash(*cols) -> Column:
    return F.sha2(canonical_json(*cols), 256)
