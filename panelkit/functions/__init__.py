"""Scalar column expressions (all JVM-side, codegen-friendly; no UDFs)."""

from .text import (strip_ws, norm_key, sentinel_to_null, coerce_double,
                   coerce_long, is_entity_code, starts_with, cut)
from .numeric import (ordinal_bucket, weighted_score, tier, safe_div,
                      log1p_target, expm1_inverse, clip, inf_to_null,
                      flag, rnd, LEVEL_BOUNDS)
from .hashing import sha256_hex, row_hash, canonical_json

__all__ = [
    "strip_ws", "norm_key", "sentinel_to_null", "coerce_double", "coerce_long",
    "is_entity_code", "starts_with", "cut", "ordinal_bucket", "weighted_score",
    "tier", "safe_div", "log1p_target", "expm1_inverse", "clip", "inf_to_null",
    "flag", "rnd", "LEVEL_BOUNDS", "sha256_hex", "row_hash", "canonical_json",
]
