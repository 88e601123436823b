"""Image to centerline: threshold-based and link-based ridge extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixtab.functions.lineage import materialize
from pixtab.functions.strips import canvas_of
from pixtab.operators import components, filters, graph, linking, morphology, pixels, thinning

PIXEL = ["image_id", "y", "x"]


def linspace(low: float, high: float, n: int) -> list[float]:
    return [low] if n == 1 else [low + (high - low) * i / (n - 1) for i in range(n)]


def vesselness(enhanced: DataFrame, sigmas: Sequence[float], smooth: float) -> DataFrame:
    """Ridge response scaled to [0, 1] per image, then smoothed."""
    v = pixels.min_max(materialize(filters.ridges(enhanced, sigmas)))
    return filters.gaussian(materialize(v), smooth) if smooth > 0 else v


def masked(grid: DataFrame, mask: DataFrame) -> DataFrame:
    """Zero outside the mask."""
    return grid.join(mask.select(*PIXEL).withColumn("_in", F.lit(True)), PIXEL, "left").select(
        *PIXEL, F.when(F.col("_in"), F.col("v")).otherwise(F.lit(0.0)).alias("v"))


def by_threshold(enhanced: DataFrame, mask: DataFrame, sigmas: Sequence[float], threshold: float, smooth: float = 1.0,
                 min_size: int = 50, prune_length: float = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(centerline points, vesselness grid, cleaned mask) from the thresholded ridge response."""
    v = materialize(masked(vesselness(enhanced, sigmas, smooth), mask))
    closed = morphology.close(thinning.threshold_above(v, threshold), morphology.disk_spans(1), canvas_of(v))
    binary = materialize(components.remove_small(closed, min_size))
    skeleton = thinning.thin(binary)
    return graph.remove_spurs(skeleton, prune_length), v, binary


def by_linking(enhanced: DataFrame, mask: DataFrame, sigmas: Sequence[float], smooth: float = 1.0, seed_thresh: float = 0.15,
               step_thresh: float = 0.08, min_length: int = 10, min_object: int = 0, thin_output: bool = True
               ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(centerline points, vesselness grid, linked groups) from ridge linking inside the eroded mask."""
    safe = morphology.erode(mask, morphology.diamond_spans(3))
    v = materialize(masked(vesselness(enhanced, sigmas, smooth), safe))
    groups = materialize(linking.link_ridges(v, seed_thresh, step_thresh, min_length, mask))
    points = groups.select(*PIXEL)
    if thin_output:
        points = graph.remove_spurs(thinning.thin(points), min_length)
    if min_object > 0:
        points = components.remove_small(points, min_object)
    return points, v, groups
