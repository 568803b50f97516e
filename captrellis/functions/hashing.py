"""Repeatable pseudo-random choices derived from row keys.

Every draw is a pure function of a seed and the row key, so a recomputed
partition makes the same choice again, which ``rand()`` does not promise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 15 hex digits are 60 bits: always a positive BIGINT, wide enough for any row count.
_DRAW_DIGITS = 15


def order_key(seed: int | str, *keys: Column | str) -> Column:
    """Hex digest that puts rows into a seeded pseudo-random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_col(k).cast("string") for k in keys]))


def pick(n: int | Column, seed: int | str, *keys: Column | str) -> Column:
    """Draw from ``0 .. n-1`` for a row key."""
    draw = F.conv(F.substring(order_key(seed, *keys), 1, _DRAW_DIGITS), 16, 10).cast("bigint")
    return F.pmod(draw, n if isinstance(n, Column) else F.lit(n).cast("bigint"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
