"""Reproducible draws from a text seed and row keys.

The draw value is the first 32 bits of md5('seed|k1|k2|tag') as a non-negative
bigint; DuckDB computes the same value with ('0x'||substr(md5(..),1,8))::BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(x) -> Column:
    if isinstance(x, Column):
        return x.cast("string")
    return F.lit(str(x))


def draw_hash(seed, *keys) -> Column:
    """Non-negative 32-bit hash of seed and keys joined by '|'."""
    text = F.concat_ws("|", _as_col(seed), *[_as_col(k) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def pick(h: Column, n: Column) -> Column:
    """0-based position in [0, n) chosen by hash h; null when n is 0 or null."""
    return F.when(n > 0, F.pmod(h, n))


def duck_draw_hash(seed: str, *keys: str) -> str:
    """DuckDB twin of draw_hash; keys are SQL expressions."""
    parts = ", ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"('0x' || substr(md5(concat_ws('|', {parts})), 1, 8))::BIGINT"
