"""Reproducible randomness: a value depends on the row's key, never on its partition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(key: Column, salt: str | Column, seed: int | Column = 42) -> Column:
    """Uniform double in [0, 1) from 52 bits of md5("key:salt:seed")."""
    salt = F.lit(salt) if isinstance(salt, str) else salt.cast("string")
    seed = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    digest = F.md5(F.concat_ws(":", key.cast("string"), salt, seed))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def uniform_int(u: Column, low: Column, high: Column) -> Column:
    """Integer in [low, high], both ends included."""
    return (low + F.floor(u * (high - low + 1))).cast("bigint")
