"""Deterministic, partition-independent random keys (never ``rand()``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def key_text(*cols: Column | str) -> Column:
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    return F.concat_ws(":", *parts)


def uniform(seed: str | int, *cols: Column | str) -> Column:
    """u in (0, 1) from md5(seed ':' key...): same value on any partitioning."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), key_text(*cols)))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(TWO_POW_32)


def uniform_sql(seed: str | int, key_sql: str) -> str:
    """DuckDB twin of :func:`uniform` (key_sql already ':'-joined text)."""
    return f"((('0x' || substr(md5('{seed}' || ':' || {key_sql}), 1, 8))::BIGINT + 0.5) / {TWO_POW_32})"
