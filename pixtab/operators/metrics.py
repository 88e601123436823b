"""Tolerance-aware comparison of predicted and annotated curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixtab.functions.keys import salted_join
from pixtab.functions.offsets import disk, offset_array
from pixtab.functions.strips import TILE, at_home, halo_tiles, tile_votes
from pixtab.operators.distance import nearest_d2

PIXEL = ["image_id", "y", "x"]


def inside(points: DataFrame, fov: DataFrame) -> DataFrame:
    """Keep pixels of ``points`` that lie in the field of view."""
    return points.join(fov.select(*PIXEL).distinct(), PIXEL, "left_semi")


def _image_list(pred: DataFrame, gt: DataFrame, images: DataFrame | None) -> DataFrame:
    if images is not None:
        return images.select("image_id").distinct()
    return pred.select("image_id").unionByName(gt.select("image_id")).distinct()


def match_counts(pred: DataFrame, gt: DataFrame, taus: Sequence[int] = (1, 2, 3),
                 images: DataFrame | None = None) -> DataFrame:
    """Pixel counts and hits within each tolerance, both directions in one pass.

    Both sets are tiled in one shuffle, spread over the largest disk inside their tiles and met in a
    local aggregation by pixel: no pair is formed, and the per-image sums are partial aggregates.
    """
    offs = disk(max(taus))
    both = pred.select(*PIXEL, F.lit(True).alias("is_pred")).unionByName(gt.select(*PIXEL, F.lit(False).alias("is_pred")))
    votes = tile_votes(both, offs, [dy * dy + dx * dx for dy, dx in offs], keep=["is_pred"])
    met = (votes.groupBy(*TILE, "y", "x").agg(F.min(F.when(F.col("is_pred"), F.col("k"))).alias("dp"),
                                              F.min(F.when(~F.col("is_pred"), F.col("k"))).alias("dg"))
           .where("dp = 0 OR dg = 0"))
    counts = met.groupBy("image_id").agg(
        F.count_if(F.col("dp") == 0).alias("n_pred"), F.count_if(F.col("dg") == 0).alias("n_gt"),
        *[F.count_if((F.col("dp") == 0) & (F.col("dg") <= t * t)).alias(f"hit_pred_{t}") for t in taus],
        *[F.count_if((F.col("dg") == 0) & (F.col("dp") <= t * t)).alias(f"hit_gt_{t}") for t in taus])
    if images is None:
        return counts
    return _image_list(pred, gt, images).join(counts, "image_id", "left").na.fill(0)


def _safe(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / F.greatest(den, F.lit(1))).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r)).otherwise(F.lit(0.0))


def tolerant_f1(pred: DataFrame, gt: DataFrame, taus: Sequence[int] = (1, 2, 3),
                images: DataFrame | None = None) -> DataFrame:
    """Precision, recall and F1 per tolerance; both empty score 1, one empty scores 0."""
    c = match_counts(pred, gt, taus, images)
    both_empty = (F.col("n_pred") == 0) & (F.col("n_gt") == 0)
    cols = []
    for t in taus:
        p, r = _safe(F.col(f"hit_pred_{t}"), F.col("n_pred")), _safe(F.col(f"hit_gt_{t}"), F.col("n_gt"))
        for name, value in (("precision", p), ("recall", r), ("f1", _f1(p, r))):
            cols.append(F.when(both_empty, F.lit(1.0)).otherwise(value).alias(f"{name}_{t}px"))
    return c.select("image_id", *cols)


def plain_f1(pred: DataFrame, gt: DataFrame, tolerance: int = 2, images: DataFrame | None = None) -> DataFrame:
    """The other convention: denominators of at least 1, so two empty sets score 0."""
    c = match_counts(pred, gt, (tolerance,), images)
    p = F.col(f"hit_pred_{tolerance}") / F.greatest("n_pred", F.lit(1))
    r = F.col(f"hit_gt_{tolerance}") / F.greatest("n_gt", F.lit(1))
    return c.select("image_id", _f1(p, r).alias("f1"), p.alias("precision"), r.alias("recall"))


def hd95(pred: DataFrame, gt: DataFrame, canvas: DataFrame, q: float = 0.95) -> DataFrame:
    """Larger of the two directed percentiles of the nearest distance.

    Distances are counted per image before the percentile: its state is the set of distinct
    squared distances, not the pixels. One empty side costs the canvas diagonal.
    """
    def directed(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        hist = nearest_d2(a, b).groupBy("image_id", "d2").agg(F.count(F.lit(1)).alias("n"))
        return hist.groupBy("image_id").agg(
            F.expr(f"percentile(sqrt(cast(d2 as double)), {q}, n)").alias(name))

    def present(points: DataFrame, name: str) -> DataFrame:
        return points.select("image_id").distinct().withColumn(name, F.lit(True))

    out = (canvas.join(directed(pred, gt, "pg"), "image_id", "left").join(directed(gt, pred, "gp"), "image_id", "left")
           .join(present(pred, "has_p"), "image_id", "left").join(present(gt, "has_g"), "image_id", "left"))
    h, w = F.col("h").cast("double"), F.col("w").cast("double")
    value = (F.when(F.col("has_p").isNull() & F.col("has_g").isNull(), F.lit(0.0))
             .when(F.col("has_p").isNull() | F.col("has_g").isNull(), F.sqrt(h * h + w * w))
             .otherwise(F.greatest("pg", "gp")))
    return out.select("image_id", value.alias("hd95"))


def overlay_counts(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """Pixels that match, or lie in only one of the sets, per image and class."""
    tagged = (pred.select(*PIXEL, F.lit(1).alias("k")).unionByName(gt.select(*PIXEL, F.lit(2).alias("k"))))
    kind = F.when(F.col("k") == 1, "pred_only").when(F.col("k") == 2, "gt_only").otherwise("match")
    return (tagged.groupBy(*PIXEL).agg(F.bit_or("k").alias("k"))
            .groupBy("image_id", kind.alias("class")).agg(F.count(F.lit(1)).alias("pixels")))


def box_coverage(trajectory: DataFrame, gt: DataFrame, canvas: DataFrame, radius: int = 2) -> DataFrame:
    """Annotated pixels hit or missed by a box around the path, and box pixels off the annotation."""
    # One shuffle of the points; boxes are made and merged inside the tiles.
    tagged = trajectory.select(*PIXEL, F.lit(1).alias("k")).distinct().unionByName(gt.select(*PIXEL, F.lit(2).alias("k")))
    at = range(-radius, radius + 1)
    box, point = offset_array([(dy, dx) for dy in at for dx in at]), offset_array([(0, 0)])
    moved = halo_tiles(tagged, radius).select(*TILE, "y", "x", "k", F.explode(F.when(F.col("k") == 1, box).otherwise(point)).alias("o"))
    moved = moved.select(*TILE, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "k")
    merged = moved.where(at_home()).groupBy(*TILE, "y", "x").agg(F.bit_or("k").alias("k"))
    kind = F.when(F.col("k") == 3, "hit").when(F.col("k") == 2, "missed").otherwise("extra")
    counts = (salted_join(merged, canvas, ["image_id"])
              .where("y >= 0 AND x >= 0 AND y < h AND x < w"))
    return counts.groupBy("image_id", kind.alias("class")).agg(F.count(F.lit(1)).alias("pixels"))
