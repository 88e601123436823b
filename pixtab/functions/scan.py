"""Ordered scans in blocks: running values, neighbours in order and rolling windows.

A window over a whole episode would be one task. Here the order column (INT, unique per key) is cut
into blocks of ``2**BITS`` values: a local window runs inside each block, and only one row per block
- at most 32,768 per key for an INT order - is scanned to carry values across blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 16

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def block_of(order: str, bits: int = BITS) -> Column:
    return F.shiftright(F.col(order), bits)


def running(df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, tuple[str, Column]],
            exclusive: bool = False, bits: int = BITS) -> DataFrame:
    """Add running ``sum``/``max``/``min`` columns per key: ``{name: (kind, expression)}``."""
    tagged = df.withColumn("_blk", block_of(order, bits))
    for name, (_, expr) in values.items():
        tagged = tagged.withColumn(f"_v_{name}", expr)
    totals = tagged.groupBy(*keys, "_blk").agg(
        *[_AGG[kind](f"_v_{n}").alias(f"_t_{n}") for n, (kind, _) in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_blk", *[
        _AGG[kind](f"_t_{n}").over(earlier).alias(f"_c_{n}") for n, (kind, _) in values.items()])
    upto = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else 0)
    out = tagged.join(carry, [*keys, "_blk"])
    for name, (kind, _) in values.items():
        local, before = _AGG[kind](f"_v_{name}").over(upto), F.col(f"_c_{name}")
        if kind == "sum":
            merged = F.coalesce(local, F.lit(0)) + F.coalesce(before, F.lit(0))
        else:
            merged = (F.greatest if kind == "max" else F.least)(local, before)
        out = out.withColumn(name, merged)
    return out.drop("_blk", *[f"{p}_{n}" for n in values for p in ("_v", "_c")])


def neighbour(df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, str],
              ahead: bool = False, bits: int = BITS) -> DataFrame:
    """``lag`` (or ``lead``) by one row per key: ``{new column: source column}``."""
    edge = (F.min_by if ahead else F.max_by)
    packed = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    tagged = df.withColumn("_blk", block_of(order, bits)).withColumn("_row", packed)
    ends = tagged.groupBy(*keys, "_blk").agg(edge("_row", order).alias("_end"))
    blocks = Window.partitionBy(*keys).orderBy("_blk")
    step = F.lead if ahead else F.lag
    carry = ends.select(*keys, "_blk", step("_end").over(blocks).alias("_edge"))
    local = Window.partitionBy(*keys, "_blk").orderBy(order)
    out = tagged.join(carry, [*keys, "_blk"]).withColumn(
        "_nb", F.coalesce(step("_row").over(local), F.col("_edge")))
    for name in values:
        out = out.withColumn(name, F.col(f"_nb.{name}"))
    return out.drop("_blk", "_row", "_edge", "_nb")


def rolling_mean(df: DataFrame, keys: Sequence[str], order: str, size: int,
                 values: Mapping[str, str], bits: int = BITS) -> DataFrame:
    """Mean of the last ``size`` rows; ``order`` must count 0, 1, 2, … without gaps per key.

    Rows less than ``size`` before a block are copied into it, so every window is complete inside its
    own block; windows longer than a block are copied into as many blocks as they reach.
    """
    blk = block_of(order, bits)
    reach = F.shiftright(F.col(order) + F.lit(size - 1), bits)
    spread = df.withColumn("_blk", F.explode(F.sequence(blk, reach)))
    w = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(-(size - 1), 0)
    for name, src in values.items():
        spread = spread.withColumn(name, F.avg(src).over(w))
    return spread.where(F.col("_blk") == blk).drop("_blk")
