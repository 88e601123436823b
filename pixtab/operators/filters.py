"""Neighbourhood filters on dense grids, one shuffle each (see ``functions.strips``)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixtab.functions import strips as st
from pixtab.functions.keys import salted_join
from pixtab.functions.lineage import materialize

PIXEL = ["image_id", "y", "x"]


def median(grid: DataFrame, size: int = 3, edge: int = st.EDGE) -> DataFrame:
    """Median of ``size`` x ``size`` pixels with a repeated border; ``size <= 0`` passes through."""
    if size <= 0:
        return grid.select(*PIXEL, "v")
    r = size // 2
    s = st.to_strips(grid, r, edge=edge)

    def around(_: Column, i: Column) -> Column:
        last = F.size("v") - 1
        return F.array(*[F.get(F.col("v"), F.least(F.greatest(i + d, F.lit(0)), last)) for d in range(-r, r + 1)])

    s = s.withColumn("h3", F.transform("v", around))
    order = Window.partitionBy(*st.TILE).orderBy("y")
    rows = [F.col("h3")]
    for step in (F.lag, F.lead):
        for d in range(1, r + 1):
            rows.append(F.coalesce(*[step("h3", k).over(order) for k in range(d, 0, -1)], F.col("h3")))
    s = s.withColumn("rows", F.array(*rows))
    mid = F.transform(F.sequence(F.lit(0), F.size("v") - 1), lambda i: F.get(
        F.sort_array(F.flatten(F.transform(F.col("rows"), lambda row: F.get(row, i)))), F.lit((size * size) // 2)))
    return st.to_pixels(s.select(*st.TILE, "y", "x0", mid.alias("v")), edge=edge)


def adaptive_mean_points(grid: DataFrame, block: int = 51, c: float = 10, edge: int = st.EDGE) -> DataFrame:
    """Pixels brighter than their rounded ``block`` x ``block`` mean plus ``c``; the border is repeated."""
    box = [1.0] * block  # sums of integers are exact in doubles
    s = st.to_strips(grid.select(*PIXEL, F.col("v").cast("double").alias("v")), block // 2, edge=edge, canvas=st.canvas_of(grid))
    t = st.to_pixels(st.convolve(s, {"total": (box, box)}, mirror=False, keep=True), ["v", "total"], edge)
    return t.where(F.col("v") > F.rint(F.col("total") / float(block * block)) + c).select(*PIXEL)


def gaussian_kernel(sigma: float, order: int = 0, truncate: float = 4.0) -> list[float]:
    """Normalised Gaussian weights, or its sampled first or second derivative."""
    r = int(truncate * sigma + 0.5)
    g = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    total = sum(g)
    g = [v / total for v in g]
    if order == 1:
        return [v * d / sigma ** 2 for v, d in zip(g, range(-r, r + 1))]
    if order == 2:
        return [v * (d * d / sigma ** 4 - 1 / sigma ** 2) for v, d in zip(g, range(-r, r + 1))]
    return g


def gaussian(grid: DataFrame, sigma: float, edge: int = st.EDGE, canvas: DataFrame | None = None) -> DataFrame:
    """Separable Gaussian with a mirrored border, cut at four sigmas. A sparse grid needs its ``canvas``."""
    k = gaussian_kernel(sigma)
    s = _strips(grid.select(*PIXEL, F.col("v").cast("double").alias("v")), len(k) // 2, edge, canvas)
    return st.to_pixels(st.convolve(s, {"v": (k, k)}), edge=edge)


def hessians(grid: DataFrame, sigmas: Sequence[float], edge: int = st.EDGE) -> DataFrame:
    """Scale-normalised second derivatives ``(yy<i>, xy<i>, xx<i>)`` for every sigma, in one tiling."""
    kernels = [[gaussian_kernel(s, o) for o in range(3)] for s in sigmas]
    passes = {}
    for i, (sigma, k) in enumerate(zip(sigmas, kernels)):
        for name, along_x, along_y in (("yy", 0, 2), ("xy", 1, 1), ("xx", 2, 0)):
            passes[f"{name}{i}"] = (k[along_x], [v * sigma ** 2 for v in k[along_y]])
    r = max(len(k[0]) // 2 for k in kernels)
    s = st.to_strips(grid.select(*PIXEL, F.col("v").cast("double").alias("v")), r, edge=edge, canvas=st.canvas_of(grid))
    return st.to_pixels(st.convolve(s, passes), list(passes), edge=edge)


def ridges(grid: DataFrame, sigmas: Sequence[float], beta: float = 0.5, edge: int = st.EDGE) -> DataFrame:
    """Multi-scale response to dark ridges (Frangi et al. 1998): the maximum over scales.

    The structure threshold is half the largest Hessian norm of the image at each scale.
    """
    h = hessians(grid, sigmas, edge)
    cols, tops = [], []
    for i in range(len(sigmas)):
        yy, xy, xx = F.col(f"yy{i}"), F.col(f"xy{i}"), F.col(f"xx{i}")
        root = F.sqrt((yy - xx) * (yy - xx) / 4 + xy * xy)
        mean = (yy + xx) / 2
        a, b = mean + root, mean - root
        swap = F.abs(a) < F.abs(b)
        small, large = F.when(swap, a).otherwise(b), F.when(swap, b).otherwise(a)
        cols += [small.alias(f"s{i}"), large.alias(f"l{i}"), F.sqrt(a * a + b * b).alias(f"n{i}")]
        tops.append((F.max(f"n{i}") / 2).alias(f"c{i}"))
    e = materialize(h.select(*PIXEL, *cols))  # used for the thresholds and for the response
    e = salted_join(e, e.groupBy("image_id").agg(*tops), ["image_id"])
    best = []
    for i in range(len(sigmas)):
        c = F.when(F.col(f"c{i}") == 0, F.lit(1.0)).otherwise(F.col(f"c{i}"))
        ratio = F.col(f"s{i}") / F.when(F.col(f"l{i}") == 0, F.lit(1e-10)).otherwise(F.col(f"l{i}"))
        v = F.exp(-ratio * ratio / (2 * beta * beta)) * (1 - F.exp(-(F.col(f"n{i}") * F.col(f"n{i}")) / (2 * c * c)))
        best.append(F.when(F.col(f"l{i}") > 0, v).otherwise(F.lit(0.0)))
    top = best[0] if len(best) == 1 else F.greatest(*best)
    return e.select(*PIXEL, top.alias("v"))


def _strips(grid: DataFrame, halo: int, edge: int, canvas: DataFrame | None) -> DataFrame:
    """Strips with image sizes; pixels missing from the grid are 0 if the canvas is given."""
    if canvas is None:
        return st.to_strips(grid, halo, edge=edge, canvas=st.canvas_of(grid))
    return st.to_strips(grid, halo, edge=edge, canvas=canvas.select("image_id", "h", "w"), fill=0)


def local_maxima(grid: DataFrame, edge: int = st.EDGE, canvas: DataFrame | None = None) -> DataFrame:
    """Pixels not below any of their eight neighbours; outside the image counts as 0.

    A sparse grid, whose missing pixels are 0, needs its ``canvas``.
    """
    s = _strips(grid, 1, edge, canvas).withColumn("m", F.col("v"))
    s = st.pool(s, "m", 1)
    hits = s.select(*st.TILE, "y", "x0", F.transform("v", lambda v, i: (v >= F.get(F.col("m"), i)) & (
        (v >= 0) | ((F.col("y") > 0) & (F.col("y") < F.col("h") - 1) & (F.col("x0") + i > 0) & (F.col("x0") + i < F.col("w") - 1)))).alias("v"))
    return st.to_pixels(hits, edge=edge).where("v").select(*PIXEL)


def soft_pool(grid: DataFrame, kind: str, edge: int = st.EDGE) -> DataFrame:
    """3 x 3 ``erode``, ``dilate`` or ``open`` on values, border clipped."""
    s = st.to_strips(grid, 2, edge=edge)
    for least in {"erode": (True,), "dilate": (False,), "open": (True, False)}[kind]:
        s = st.pool(s, "v", 1, least)
    return st.to_pixels(s, edge=edge)


def soft_skeleton(grid: DataFrame, iterations: int = 10, values: Sequence[str] = ("v",), edge: int = st.EDGE) -> DataFrame:
    """Soft skeleton of one or more value columns: repeated erosion, keeping what opening removes.

    All iterations run in one tiling whose halo covers their total reach.
    """
    s = st.to_strips(grid, iterations + 2, values, edge)
    for n in values:
        for it in range(iterations + 1):
            if it:
                s = st.pool(s, n, 1, least=True)
            s = st.pool(st.pool(s.withColumn("_o", F.col(n)), "_o", 1, True), "_o", 1, False)
            delta = F.zip_with(F.col(n), F.col("_o"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
            if it == 0:
                s = s.withColumn(f"_{n}", delta)
            else:
                s = s.withColumn("_d", delta).withColumn(f"_{n}", F.zip_with(
                    f"_{n}", "_d", lambda k, d: k + F.greatest(d - k * d, F.lit(0.0))))
    s = s.select(*st.TILE, "y", "x0", *[F.col(f"_{n}").alias(n) for n in values])
    return st.to_pixels(s, values, edge)


def _equalised(clip: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per region ``(image_id, ry, rx, v, n, area)``, listed counts of 8-bit values: its table of 256 equalised values."""
    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.arange(256)
        for batch in batches:
            rows, v, n = batch.num_rows, batch.column("v"), batch.column("n")
            v, n, of = v.flatten().to_numpy(), n.flatten().to_numpy(), np.repeat(np.arange(rows), pc.list_value_length(v).to_numpy())
            if v.size and (v.min() < 0 or v.max() > 255):
                raise ValueError("an 8-bit grid is needed")
            counts = np.zeros((rows, 256), "int64")
            counts[of, v] = n
            area = batch.column("area").to_numpy()[:, None]
            limit = np.maximum(np.floor(clip * area / 256).astype("int64"), 1)
            excess = np.maximum(counts - limit, 0).sum(axis=1, keepdims=True)
            rest = excess % 256
            stride = np.maximum(256 // np.maximum(rest, 1), 1)
            even = np.minimum(counts, limit) + excess // 256 + ((level % stride == 0) & (level // stride < rest))
            lut = np.minimum(np.rint(np.cumsum(even, axis=1) * (255.0 / area)), 255).astype("int32")
            ends = pa.array(np.arange(rows + 1, dtype="int32") * 256, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("image_id", "ry", "rx")), pa.ListArray.from_arrays(ends, pa.array(lut.ravel()))],
                                             names=["image_id", "ry", "rx", "lut"])
    return tables


def clahe(grid: DataFrame, clip: float = 2.5, tiles: int = 8) -> DataFrame:
    """Contrast-limited equalisation of 8-bit grids on ``tiles`` x ``tiles`` regions.

    Histograms are partial aggregates of at most 256 values per region; the four tables around each
    interpolation cell are assembled once and met by one salted join.
    """
    dims = st.canvas_of(grid).select("image_id", "h", "w", F.ceil(F.col("h") / tiles).cast("int").alias("th"),
                                     F.ceil(F.col("w") / tiles).cast("int").alias("tw"))
    px = salted_join(grid.select(*PIXEL, F.col("v").cast("int").alias("v")), dims, ["image_id"])

    def places(c: str, n: str, t: str) -> Column:
        """The index itself and its mirror image in the padding up to a multiple of the region."""
        mirror = 2 * F.col(n) - 2 - F.col(c)
        return F.explode(F.when((mirror >= F.col(n)) & (mirror < F.col(t) * tiles), F.array(F.col(c), mirror)).otherwise(F.array(F.col(c))))

    parts = px.withColumn("_py", places("y", "h", "th")).withColumn("_px", places("x", "w", "tw"))
    region = ["image_id", "ry", "rx"]
    hist = (parts.groupBy("image_id", F.floor(F.col("_py") / F.col("th")).cast("int").alias("ry"),
                          F.floor(F.col("_px") / F.col("tw")).cast("int").alias("rx"), "v")
            .agg(F.count(F.lit(1)).cast("int").alias("n"), F.first(F.col("th") * F.col("tw")).alias("area")))
    full = hist.groupBy(*region).agg(F.collect_list("v").alias("v"), F.collect_list("n").alias("n"), F.first("area").alias("area"),
                                     F.bool_or(F.col("v").isNull()).alias("gap")).where("NOT gap").drop("gap")
    key = grid.schema["image_id"].dataType.simpleString()
    lut = full.mapInArrow(_equalised(clip), f"image_id {key}, ry int, rx int, lut array<int>")

    def corners(c: str) -> Column:
        """Interpolation cells a region serves, as their low (0) or high (1) side."""
        cell = lambda at, side: F.struct(at.cast("int").alias("c"), F.lit(side).alias("s"))
        out = F.array(cell(F.col(c) - 1, 1), cell(F.col(c), 0))
        out = F.when(F.col(c) == 0, F.concat(out, F.array(cell(F.lit(-1), 0)))).otherwise(out)
        return F.explode(F.when(F.col(c) == tiles - 1, F.concat(out, F.array(cell(F.lit(tiles - 1), 1)))).otherwise(out))

    cells = lut.withColumn("_a", corners("ry")).withColumn("_b", corners("rx"))
    cells = cells.groupBy("image_id", F.col("_a.c").alias("cy"), F.col("_b.c").alias("cx")).agg(*[
        F.max(F.when((F.col("_a.s") == i) & (F.col("_b.s") == j), F.col("lut"))).alias(f"l{i}{j}") for i in (0, 1) for j in (0, 1)])
    fy, fx = F.col("y") * (1.0 / F.col("th")) - 0.5, F.col("x") * (1.0 / F.col("tw")) - 0.5
    px = px.select(*PIXEL, "v", F.floor(fy).cast("int").alias("cy"), F.floor(fx).cast("int").alias("cx"),
                   (fy - F.floor(fy)).alias("a"), (fx - F.floor(fx)).alias("b"))
    # a cell is at most 1/49 of an image, so few shares are enough for rows this wide
    out = salted_join(px, cells, ["image_id", "cy", "cx"], salts=4)
    at = {n: F.get(F.col(n), F.col("v")) for n in ("l00", "l01", "l10", "l11")}
    a, b = F.col("a"), F.col("b")
    value = (at["l00"] * (1 - b) + at["l01"] * b) * (1 - a) + (at["l10"] * (1 - b) + at["l11"] * b) * a
    return out.select(*PIXEL, F.rint(value).cast("int").alias("v"))
