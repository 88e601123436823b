"""Structuring elements as offset lists, and spreading points over them with one shuffle."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Offsets = list[tuple[int, int]]

NEIGHBOURS8: Offsets = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]
NEIGHBOURS4: Offsets = [(-1, 0), (0, -1), (0, 1), (1, 0)]


def disk(radius: float) -> Offsets:
    """All offsets within Euclidean ``radius``."""
    r = int(math.floor(radius))
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= radius * radius]


def square(radius: int) -> Offsets:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]


def ellipse_rows(size: int) -> list[tuple[int, int, int]]:
    """``(dy, first dx, last dx)`` per row of the ellipse inscribed in a ``size`` x ``size`` box.

    The anchor is the box centre ``size // 2``; the half width of row i is
    ``rint(c * sqrt(1 - ((i - r) / r)^2))`` with ``r = c = size // 2``.
    """
    r = size // 2
    rows = []
    for i in range(size):
        dy = i - r
        if abs(dy) <= r:
            half = int(round(r * math.sqrt((r * r - dy * dy) / (r * r)))) if r else 0
            rows.append((dy, max(r - half, 0) - r, min(r + half + 1, size) - 1 - r))
    return rows


def ellipse(size: int) -> Offsets:
    return [(dy, dx) for dy, lo, hi in ellipse_rows(size) for dx in range(lo, hi + 1)]


def offset_array(offsets: Sequence[tuple[int, int]], extra: Sequence[int] | None = None) -> Column:
    """Literal array of ``struct(dy, dx[, k])`` - a constant of the plan, not a table."""
    rows = [(dy, dx) if extra is None else (dy, dx, extra[i]) for i, (dy, dx) in enumerate(offsets)]
    names = ("dy", "dx", "k")
    return F.expr("array(" + ", ".join(
        "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in zip(names, row)) + ")" for row in rows) + ")")


def spread(points: DataFrame, offsets: Sequence[tuple[int, int]], extra: Sequence[int] | None = None) -> DataFrame:
    """Every point at every offset: ``(image_id, y, x[, k])``; the caller groups by pixel.

    Keys are single pixels, so a hot image spreads over all partitions.
    """
    out = points.select("image_id", "y", "x", F.explode(offset_array(offsets, extra)).alias("_o"))
    cols = ["image_id", (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x")]
    if extra is not None:
        cols.append(F.col("_o.k").alias("k"))
    return out.select(*cols)
