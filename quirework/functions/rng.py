"""Uniform numbers that depend on keys only: the same in every engine, run and partition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*keys: Column | str, seed: int = 0) -> Column:
    """In [0, 1): the first 8 hexadecimal digits of the md5 of the keys, joined by ':', over 2^32."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def uniform_int(low: int, high: int, *keys: Column | str, seed: int = 0) -> Column:
    """From low up to but not including high."""
    return (F.lit(low) + F.floor(uniform(*keys, seed=seed) * (high - low))).cast("int")


#: The same in DuckDB's SQL: format with the keys joined by || ':' ||.
UNIFORM_SQL = "(CAST('0x' || substring(md5({}), 1, 8) AS BIGINT) / 4294967296.0)"
