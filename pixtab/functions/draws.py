"""Repeatable random choices: draws are digests of what is drawn for, the same in every engine and at every layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int, *of: Column | str) -> Column:
    """A text that sorts like a random number."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in of]))


def draw_below(n: Column, seed: int, *of: Column | str) -> Column:
    """An INT from 0 up to ``n`` - 1 (``n`` at least 1)."""
    return F.pmod(F.conv(F.substring(draw(seed, *of), 1, 12), 16, 10).cast("bigint"), n).cast("int")
