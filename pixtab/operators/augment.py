"""Geometric copies of points, pixels and traces, and expert (position, action) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixtab.functions.keys import ranked, salted_join
from pixtab.operators.steplog import STOP, action_of

TRANSFORMS = ("flip_h", "flip_v", "rot90", "rot180", "rot270")

# fixed values: action after each transform, for actions 0..8
ACTION_REMAP = {
    "flip_h": [0, 7, 6, 5, 4, 3, 2, 1, 8],
    "flip_v": [4, 3, 2, 1, 0, 7, 6, 5, 8],
    "rot90": [2, 3, 4, 5, 6, 7, 0, 1, 8],
    "rot180": [4, 5, 6, 7, 0, 1, 2, 3, 8],
    "rot270": [6, 7, 0, 1, 2, 3, 4, 5, 8],
}
# fixed values: (brightness, contrast)
JITTERS = [(0.8, 1.0), (1.2, 1.0), (1.0, 0.8), (1.0, 1.2)]


def _each() -> Column:
    return F.explode(F.array(*[F.lit(t) for t in TRANSFORMS]))


def transform_points(df: DataFrame, canvas: DataFrame) -> DataFrame:
    """All five transforms of any table with ``image_id, y, x``; ``image_id`` gets the transform's name."""
    t = salted_join(df, canvas.select("image_id", "h", "w"), ["image_id"]).withColumn("transform", _each())
    y, x, h, w = (F.col(c) for c in "yxhw")
    kind = F.col("transform")
    ny = (F.when(kind == "flip_h", y).when(kind == "rot90", x).when(kind == "rot270", w - 1 - x).otherwise(h - 1 - y))
    nx = (F.when(kind == "flip_v", x).when(kind == "rot90", h - 1 - y).when(kind == "rot270", y).otherwise(w - 1 - x))
    return (t.withColumn("_y", ny).withColumn("_x", nx)
            .withColumn("image_id", F.concat_ws("_", F.col("image_id").cast("string"), kind))
            .drop("y", "x", "h", "w").withColumnRenamed("_y", "y").withColumnRenamed("_x", "x"))


def transform_canvas(canvas: DataFrame) -> DataFrame:
    t = canvas.withColumn("transform", _each())
    turned = F.col("transform").isin("rot90", "rot270")
    return t.select(F.concat_ws("_", F.col("image_id").cast("string"), "transform").alias("image_id"), "transform",
                    F.when(turned, F.col("w")).otherwise(F.col("h")).alias("h"),
                    F.when(turned, F.col("h")).otherwise(F.col("w")).alias("w"))


def remap_action(action: Column, transform: Column) -> Column:
    out = action
    for name, table in ACTION_REMAP.items():
        out = F.when(transform == name, F.get(F.array(*[F.lit(v) for v in table]), action)).otherwise(out)
    return out


def jitter(px: DataFrame, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Four brightness/contrast variants of values in [0, 1]."""
    table = F.array(*[F.struct(F.lit(i).alias("variant"), F.lit(b).alias("b"), F.lit(c).alias("c"))
                      for i, (b, c) in enumerate(JITTERS)])
    t = px.withColumn("_j", F.explode(table))
    for c in channels:
        v = F.col(c) * F.col("_j.c") + (F.col("_j.b") - 1.0) * 0.5
        t = t.withColumn(c, F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))
    return t.withColumn("variant", F.col("_j.variant")).drop("_j")


def expert_pairs(traces: DataFrame, canvas: DataFrame, half: int) -> DataFrame:
    """``(image_id, order, trace_id, seq, y, x, action)``: positions with a legal next move.

    The next position is the row with ``seq + 1`` of the same trace - an equi-join, so a long trace
    is not one task. ``order`` counts the pairs of an image in trace order.
    """
    keys = ["image_id", "trace_id", "seq"]
    following = traces.select("image_id", "trace_id", (F.col("seq") - 1).alias("seq"),
                              F.col("y").alias("_ny"), F.col("x").alias("_nx"))
    out = traces.select(*keys, "y", "x").join(following, keys)
    out = salted_join(out, canvas.select("image_id", "h", "w"), ["image_id"])
    ok = F.col("y").between(half, F.col("h") - half - 1) & F.col("x").between(half, F.col("w") - half - 1)
    out = out.where(ok).withColumn("action", action_of(F.col("_ny") - F.col("y"), F.col("_nx") - F.col("x")))
    out = out.where(F.col("action") != STOP).select(*keys, "y", "x", "action")
    return ranked(out, ["image_id"], ["trace_id", "seq"], "order")
