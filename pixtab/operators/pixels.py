"""Per-pixel projections, normalisation and resampling of grids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType

from pixtab.functions.keys import salted_join
from pixtab.functions.strips import EDGE

PIXEL = ["image_id", "y", "x"]


def green_channel(px: DataFrame) -> DataFrame:
    """The green channel as a grid; a gray grid passes through."""
    return px.select(*PIXEL, F.col("g" if "g" in px.columns else "v").alias("v"))


def to_8bit(grid: DataFrame) -> DataFrame:
    """Fractional grids: values in [0, 1] (per image) are scaled by 255, all are truncated. Integer grids stay as they are."""
    if not isinstance(grid.schema["v"].dataType, FractionalType):
        return grid.select(*PIXEL, F.col("v").cast("int").alias("v"))
    top = grid.groupBy("image_id").agg(F.max("v").alias("_top"))
    out = salted_join(grid, top, ["image_id"])
    v = F.when(F.col("_top") <= 1.0, F.col("v") * 255).otherwise(F.col("v"))
    return out.select(*PIXEL, F.floor(v).cast("int").alias("v"))


def gamma(v: Column, value: float = 0.8) -> Column:
    """Gamma curve on 0..255, truncated like a lookup table of bytes."""
    return F.floor(F.pow(v / 255.0, F.lit(1.0 / value)) * 255).cast("int")


def min_max(grid: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Scale each image to [0, 1]; extremes are partial aggregates, joined back salted."""
    ends = grid.groupBy("image_id").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    out = salted_join(grid, ends, ["image_id"])
    return out.select(*PIXEL, ((F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + eps)).alias("v"))


def roi_normalise(grid: DataFrame, roi: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip each 8-bit image to its percentiles inside the region; ``v / 255`` where the region is empty.

    Values are counted first, so the exact percentile works on at most 256 rows per image.
    """
    hist = (grid.join(roi.select(*PIXEL), PIXEL, "left_semi").groupBy("image_id", "v")
            .agg(F.count(F.lit(1)).alias("_n")))
    cut = hist.groupBy("image_id").agg(F.expr(f"percentile(v, array({low}D, {high}D), _n)").alias("_p"))
    out = salted_join(grid, cut, ["image_id"], how="left")
    lo, hi = F.col("_p")[0], F.col("_p")[1]
    scaled = F.least(F.greatest((F.col("v") - lo) / (hi - lo + 1e-8), F.lit(0.0)), F.lit(1.0))
    return out.select(*PIXEL, F.when(F.col("_p").isNull(), F.col("v") / 255.0).otherwise(scaled).alias("v"))


def replace_green(px: DataFrame, grid: DataFrame) -> DataFrame:
    """Put an enhanced channel in place of green."""
    new = grid.select(*PIXEL, F.col("v").alias("_g"))
    return px.join(new, PIXEL).select(*PIXEL, "r", F.col("_g").alias("g"), "b")


def _takers(c: str, n: str, m: str, nearest: bool) -> Column:
    """The target places that sample source place ``c`` on an axis resized from ``n`` to ``m``, as an array."""
    scale, step = F.col(m) / F.col(n), F.col(n) / F.col(m)
    first = F.greatest(F.ceil((F.col(c) - 0.5) * scale - 0.5) - 1, F.lit(0))
    last = F.least(F.floor((F.col(c) + 1.5) * scale - 0.5) + 1, F.col(m) - 1)

    def takes(t: Column) -> Column:
        if nearest:
            return F.least(F.floor(t * step), F.col(n) - 1) == F.col(c)
        base = F.floor((t + 0.5) * step - 0.5)
        return F.col(c).isin(*[F.least(F.greatest(base + i, F.lit(0)), F.col(n) - 1) for i in (0, 1)])

    return F.when(first <= last, F.filter(F.sequence(first.cast("int"), last.cast("int")), takes))


def _nearest(px: DataFrame) -> DataFrame:
    """Every source pixel names the target pixels that take it."""
    for c, n, m in (("y", "h", "nh"), ("x", "w", "nw")):
        px = px.withColumn(f"t{c}", F.explode(_takers(c, n, m, True)))
    return px.select("image_id", F.col("ty").alias("y"), F.col("tx").alias("x"), "v")


def _blend_tile(edge: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def taps(first: int, n: int, m: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        t = np.arange(first, min(first + edge, m))
        at = (t + 0.5) * (n / m) - 0.5
        base = np.floor(at)
        ends = [np.clip(base + i, 0, n - 1).astype("int64") for i in (0, 1)]
        return t, ends, [1 - (at - base), at - base]

    def blend(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        ty, y_at, y_k = taps(int(one["ty"]) * edge, int(one["h"]), int(one["nh"]))
        tx, x_at, x_k = taps(int(one["tx"]) * edge, int(one["w"]), int(one["nw"]))
        # source rows and columns that a target names, in order: the block has no others
        rows, cols = np.unique(np.concatenate(y_at)), np.unique(np.concatenate(x_at))
        y, x = pdf["y"].to_numpy("int64"), pdf["x"].to_numpy("int64")
        i, j = np.searchsorted(rows, y), np.searchsorted(cols, x)
        used = (i < len(rows)) & (j < len(cols))
        used[used] = (rows[i[used]] == y[used]) & (cols[j[used]] == x[used])
        i, j, known = i[used], j[used], pdf["known"].to_numpy(bool)[used]
        there, valued, value = (np.zeros((len(rows), len(cols)), k) for k in (bool, bool, float))
        there[i, j] = True
        valued[i[known], j[known]] = True
        value[i[known], j[known]] = pdf["v"].to_numpy("float64")[used][known]
        total = np.zeros((len(ty), len(tx)))
        some, any_value = np.zeros(total.shape, bool), np.zeros(total.shape, bool)
        for a, ka in zip(y_at, y_k, strict=True):
            for b, kb in zip(x_at, x_k, strict=True):
                block = np.ix_(np.searchsorted(rows, a), np.searchsorted(cols, b))
                total += np.where(valued[block], ka[:, None] * kb * value[block], 0)
                some |= there[block]
                any_value |= valued[block]
        oy, ox = np.nonzero(some)
        v = pd.array(total[oy, ox], dtype="Float64")
        v[~any_value[oy, ox]] = pd.NA
        return pd.DataFrame({"image_id": one["image_id"], "y": ty[oy].astype("int32"), "x": tx[ox].astype("int32"), "v": v})
    return blend


def resample(grid: DataFrame, canvas: DataFrame, nearest: bool = False, edge: int = EDGE) -> DataFrame:
    """Resize each image from ``(h, w)`` to ``(nh, nw)``.

    Nearest takes ``floor(t * h / nh)`` and needs no shuffle of its own. Bilinear samples at pixel centres: source pixels go to the
    target tiles that sample them, at most a rim of them twice, and a tile gathers its four taps from its block. Source pixels that no
    target samples do not move, so a block holds at most two source rows and columns for each of the tile, however much an image shrinks.
    Missing pixels and null values count as 0; a target pixel without any source pixel is left out, one whose source pixels are all null is null.
    """
    px = salted_join(grid.select(*PIXEL, "v"), canvas.select("image_id", "h", "w", "nh", "nw"), ["image_id"])
    if nearest:
        return _nearest(px)
    key = grid.schema["image_id"].dataType.simpleString()
    for c, n, m, t in (("y", "h", "nh", "ty"), ("x", "w", "nw", "tx")):
        tiles = F.array_distinct(F.transform(_takers(c, n, m, False), lambda p: F.floor(p / edge).cast("int")))
        px = px.withColumn(t, F.explode(tiles))
    tiled = px.select(*PIXEL, "ty", "tx", "h", "w", "nh", "nw", F.col("v").cast("double").alias("v"), F.col("v").isNotNull().alias("known"))
    return tiled.groupBy("image_id", "ty", "tx").applyInPandas(_blend_tile(edge), f"image_id {key}, y int, x int, v double")


def resample_mask(grid: DataFrame, canvas: DataFrame) -> DataFrame:
    """Nearest resampling of a 0/1 grid, binarised again at 0.5, as points."""
    return resample(grid, canvas, nearest=True).where("v > 0.5").select(*PIXEL)


def fit_and_pad(grid: DataFrame, canvas: DataFrame, size: int = 584, nearest: bool = False) -> DataFrame:
    """Scale the longest side to ``size`` and centre the image on a zero square of that size."""
    long_side = F.greatest("h", "w")
    dims = canvas.select("image_id", "h", "w", F.rint(F.col("h") * (size / long_side)).cast("int").alias("nh"),
                         F.rint(F.col("w") * (size / long_side)).cast("int").alias("nw"))
    shift = dims.select("image_id", F.floor((size - F.col("nh")) / 2).cast("int").alias("_dy"),
                        F.floor((size - F.col("nw")) / 2).cast("int").alias("_dx"))
    body = salted_join(resample(grid, dims, nearest), shift, ["image_id"])
    body = body.select("image_id", (F.col("y") + F.col("_dy")).alias("y"), (F.col("x") + F.col("_dx")).alias("x"), "v")
    square = canvas.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("y")).repartition("image_id", "y")
    square = square.select("image_id", "y", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("x"))
    return square.join(body, PIXEL, "left").select(*PIXEL, F.coalesce(F.col("v"), F.lit(0).cast(body.schema["v"].dataType)).alias("v"))
