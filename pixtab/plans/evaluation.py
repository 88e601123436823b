"""All metrics of predicted curves, one wide row per image."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixtab.functions.lineage import materialize
from pixtab.operators import components, metrics, thinning


def evaluate(pred: DataFrame, gt: DataFrame, canvas: DataFrame, taus: Sequence[int] = (1, 2, 3),
             gt_mask: DataFrame | None = None, pred_mask: DataFrame | None = None, pred_prob: DataFrame | None = None,
             fov: DataFrame | None = None) -> DataFrame:
    """Tolerant F1, clDice (with an annotated mask; probabilities are preferred), component error and HD95.

    With a field of view every input is restricted to it first.
    """
    cut = (lambda t: t) if fov is None else (lambda t: metrics.inside(t, fov))
    pred, gt = materialize(cut(pred)), materialize(cut(gt))
    out = metrics.tolerant_f1(pred, gt, taus, canvas)
    if gt_mask is not None and (pred_prob is not None or pred_mask is not None):
        mask = cut(thinning.threshold_at_least(pred_prob, 0.5) if pred_prob is not None else pred_mask)
        out = out.join(thinning.cl_dice(mask, cut(gt_mask), canvas), "image_id")
    return (out.join(components.betti0_error(pred, gt, canvas), "image_id")
            .join(metrics.hd95(pred, gt, canvas), "image_id"))


def with_bridged_error(results: DataFrame, pred: DataFrame, gt: DataFrame, canvas: DataFrame, radius: int = 3) -> DataFrame:
    """Component error of the raw prediction next to that after gap bridging."""
    post = components.betti0_error(thinning.bridge_gaps(pred, radius, canvas), gt, canvas)
    return (results.withColumnRenamed("betti_0_error", "betti_0_error_raw")
            .join(post.withColumnRenamed("betti_0_error", "betti_0_error_postproc"), "image_id")
            .select(*[c for c in results.columns if c not in ("betti_0_error", "hd95")], F.col("betti_0_error_raw"),
                    F.col("betti_0_error_postproc"), "hd95"))
