"""Forward values of the training losses over grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixtab.operators.filters import soft_skeleton


def _bce(p: Column, t: Column) -> Column:
    """Binary cross-entropy with logarithms bounded below by -100."""
    log = lambda v: F.when(v > 0, F.greatest(F.ln(F.when(v > 0, v)), F.lit(-100.0))).otherwise(F.lit(-100.0))
    return -(t * log(p) + (1 - t) * log(1 - p))


def bce(grid: DataFrame, by: Sequence[str] = ("image_id",), pos_weight: float | None = None) -> DataFrame:
    """Mean cross-entropy of ``v`` against ``gt``; restrict the rows to the field of view beforehand."""
    p, t = F.col("v"), F.col("gt").cast("double")
    if pos_weight is None:
        loss = _bce(p, t)
    else:
        loss = -(pos_weight * t * F.ln(p + 1e-5) + (1 - t) * F.ln(1 - p + 1e-5))
    return grid.groupBy(*by).agg(F.avg(loss).alias("bce"))


def soft_cl_dice(grid: DataFrame, iterations: int = 10) -> DataFrame:
    """Soft clDice per image of ``v`` against ``gt``; both skeletons come from one tiling."""
    g = grid.select("image_id", "y", "x", F.col("v").cast("double").alias("v"), F.col("gt").cast("double").alias("gt"))
    s = soft_skeleton(g, iterations, ("v", "gt")).withColumnRenamed("v", "sv").withColumnRenamed("gt", "sg")
    m = g.join(s, ["image_id", "y", "x"])
    sums = m.groupBy("image_id").agg(
        F.sum(F.col("sv") * F.col("gt")).alias("a"), F.sum("sv").alias("b"), F.sum(F.col("sg") * F.col("v")).alias("c"), F.sum("sg").alias("d"))
    prec, sens = F.col("a") / (F.col("b") + 1e-5), F.col("c") / (F.col("d") + 1e-5)
    return sums.select("image_id", (2 * prec * sens / (prec + sens + 1e-5)).alias("cl_dice"))


def combined(grid: DataFrame, fov: DataFrame | None = None, bce_weight: float = 0.4, cl_weight: float = 0.6,
             iterations: int = 10, pos_weight: float | None = None) -> DataFrame:
    """One row: cross-entropy over all pixels of the field of view, mean soft clDice, and their weighted sum."""
    seen = grid if fov is None else grid.join(fov.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_semi")
    a = bce(seen, (), pos_weight)
    b = soft_cl_dice(grid, iterations).agg(F.avg("cl_dice").alias("cl_dice"))
    none = F.lit(None).cast("double")
    both = a.withColumn("cl_dice", none).unionByName(b.withColumn("bce", none))
    return both.agg(F.max("bce").alias("bce"), F.max("cl_dice").alias("cl_dice")).withColumn("total", bce_weight * F.col("bce") + cl_weight * (1 - F.col("cl_dice")))


def focal(grid: DataFrame, by: Sequence[str] = ("image_id",), mask: DataFrame | None = None,
          alpha: float = 0.25, gamma: float = 2.0) -> DataFrame:
    """Focal loss of a heatmap; with a mask the mean is over its pixels."""
    p, t = F.col("v"), F.col("gt").cast("double")
    pt = F.when(t > 0.5, p).otherwise(1 - p)
    loss = alpha * F.pow(1 - pt, F.lit(gamma)) * _bce(p, t)
    if mask is None:
        return grid.groupBy(*by).agg(F.avg(loss).alias("focal"))
    seen = grid.join(mask.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_semi")
    return seen.groupBy(*by).agg((F.sum(loss) / (F.count(F.lit(1)) + 1e-8)).alias("focal"))
