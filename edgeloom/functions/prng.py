"""A counter-based generator with the same values as a Column, as SQL for Spark and DuckDB, and in Python.

A draw is the first 13 hex digits of the MD5 of its key's parts joined by colons, so it
has 52 bits and needs no state: any row computes its own.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 52
SPAN = 1 << BITS


def draw(*parts: Column | str | int) -> Column:
    """A BIGINT in [0, 2**52); strings name columns, integers are literals."""
    key = F.concat_ws(":", *[F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("bigint")


def unit(*parts: Column | str | int) -> Column:
    """A DOUBLE in [0, 1)."""
    return draw(*parts).cast("double") / F.lit(float(SPAN))


def duckdb_draw(*parts: str | int) -> str:
    key = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT)"


def duckdb_unit(*parts: str | int) -> str:
    return f"(CAST({duckdb_draw(*parts)} AS DOUBLE) / {float(SPAN)})"


def python_draw(*parts: object) -> int:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def python_unit(*parts: object) -> float:
    return python_draw(*parts) / SPAN
