"""Contrast enhancement and field-of-view derivation, all images in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixtab.functions.lineage import materialize
from pixtab.functions.strips import canvas_of
from pixtab.operators import components, filters, morphology, pixels

PIXEL = ["image_id", "y", "x"]


@dataclass(frozen=True)
class Enhanced:
    """The enhanced grid and the steps that led to it."""

    enhanced: DataFrame
    green: DataFrame
    gamma: DataFrame
    clahe: DataFrame
    mask: DataFrame


def derive_fov(gray: DataFrame, block: int = 51, c: float = 10, erosion: int | None = None) -> DataFrame:
    """Field of view from brightness: adaptive threshold, close, open, largest filled object, erode."""
    canvas = materialize(canvas_of(gray))
    k = morphology.kernel_size(F.col("h"), F.col("w"))
    element = morphology.ellipse_spans_of(k)
    m = filters.adaptive_mean_points(gray, block, c)
    m = morphology.open_(morphology.close(m, element, canvas), element, canvas)
    m = components.fill_holes(components.largest_component(m))
    if erosion == 0:
        return m
    e = F.lit(erosion) if erosion else k
    return morphology.erode(m, morphology.ellipse_spans_of(e * 2 + 1), canvas)


def enhance(px: DataFrame, external_fov: DataFrame | None = None, clip: float = 2.5, tiles: int = 8,
            gamma: float = 0.8, median_size: int = 3, fov_block: int = 51) -> Enhanced:
    """Green channel, gamma, median, mask, tile-wise equalisation and percentile normalisation.

    ``external_fov`` is a gray mask grid; without it the field of view is derived.
    """
    green = pixels.green_channel(px)
    corrected = materialize(pixels.to_8bit(green).withColumn("v", pixels.gamma(F.col("v"), gamma)))
    if external_fov is not None:
        mask = morphology.external_fov(external_fov, canvas_of(external_fov))
    else:
        mask = derive_fov(corrected, fov_block)
    mask = materialize(mask)
    smooth = filters.median(corrected, median_size)
    masked = smooth.join(mask.withColumn("_in", F.lit(True)), PIXEL, "left").select(
        *PIXEL, F.when(F.col("_in"), F.col("v")).otherwise(F.lit(0)).alias("v"))
    equal = materialize(filters.clahe(materialize(masked), clip, tiles))
    return Enhanced(pixels.roi_normalise(equal, mask), green, corrected, equal, mask)
