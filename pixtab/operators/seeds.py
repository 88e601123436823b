"""Seed heatmaps, peak selection, peripheral seeds and the next frontier seed."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixtab.functions import strips as st
from pixtab.functions.keys import first_of_each, pixel_id, salted_join
from pixtab.functions.lineage import materialize
from pixtab.operators.distance import nearest_d2
from pixtab.operators.filters import gaussian_kernel
from pixtab.operators.morphology import ellipse_spans, erode, square_spans, whole_around
from pixtab.operators.neighborhood import special_points
from pixtab.operators.patches import with_margin

PIXEL = ["image_id", "y", "x"]


def seed_heatmap(centerline: DataFrame, canvas: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Gaussian blobs at endpoints and junctions, scaled to a maximum of 1; absent pixels are 0.

    Impulses are few, so each is spread over its kernel and summed by pixel instead of filtering
    dense images. Impulses near a border also act from their mirror positions.
    """
    k = gaussian_kernel(sigma)
    r = len(k) // 2
    weights = F.expr("array(" + ", ".join(f"{v!r}D" for v in k) + ")")

    def images_of(c: str, n: str) -> Column:
        low = F.when(F.col(c) < r, F.array(-1 - F.col(c))).otherwise(F.array().cast("array<int>"))
        high = F.when(F.col(c) >= F.col(n) - r, F.array(2 * F.col(n) - 1 - F.col(c))).otherwise(F.array().cast("array<int>"))
        return F.explode(F.concat(F.array(F.col(c)), low, high))

    p = salted_join(special_points(centerline).drop("type"), canvas.select("image_id", "h", "w"), ["image_id"])
    p = p.select("image_id", "h", "w", images_of("y", "h").alias("y"), "x").withColumn("x", images_of("x", "w"))
    tiled = st.halo_tiles(p, r)  # one shuffle of the impulses; what they give is summed in the tile
    rows = tiled.select(*st.TILE, "h", "w", "y", "x", F.posexplode(weights).alias("i", "ky")).withColumn("y", F.col("y") + F.col("i") - r)
    rows = rows.where((F.col("y") >= 0) & (F.col("y") < F.col("h")) & (F.floor(F.col("y") / st.EDGE) == F.col("ty")))
    px = rows.select(*st.TILE, "w", "y", "x", "ky", F.posexplode(weights).alias("j", "kx")).withColumn("x", F.col("x") + F.col("j") - r)
    px = px.where((F.col("x") >= 0) & (F.col("x") < F.col("w")) & (F.floor(F.col("x") / st.EDGE) == F.col("tx")))
    heat = px.groupBy(*st.TILE, "y", "x").agg(F.sum(F.col("ky") * F.col("kx")).alias("v")).select(*PIXEL, "v")
    top = heat.groupBy("image_id").agg(F.max("v").alias("_m"))
    return salted_join(heat, top, ["image_id"]).select(*PIXEL, (F.col("v") / F.col("_m")).alias("v"))


def suppress_border(heat: DataFrame, fov: DataFrame, canvas: DataFrame, kernel: int = 35, margin: int = 37) -> DataFrame:
    """Zero the heat outside the eroded field of view and within ``margin`` of the image border."""
    met = whole_around(heat.select(*PIXEL, "v"), fov, square_spans(kernel // 2), canvas)
    off = F.col("y").between(margin, F.col("h") - margin - 1) & F.col("x").between(margin, F.col("w") - margin - 1)
    return met.select(*PIXEL, F.when(F.col("inside") & off, F.col("v")).otherwise(F.lit(0.0)).alias("v"))


def _peaks_of_tiles(radius: int, edge: int) -> st.TileWork:
    around = sorted(((dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy or dx),
                    key=lambda o: o[0] * o[0] + o[1] * o[1])
    side, most = edge + 4 * radius, 64  # tiles whose blocks are held at once

    def peaks(own: dict[str, np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, dict]:
        n = len(own["y"])
        tile = st.tile_of_rows(starts, n)
        y = own["y"].astype("int64") - own["ty"].astype("int64") * edge + 2 * radius
        x = own["x"].astype("int64") - own["tx"].astype("int64") * edge + 2 * radius
        place = np.empty(n, "int32")  # greater values first, then smaller (y, x)
        place[np.lexsort((-x, -y, own["v"]))] = np.arange(1, n + 1)
        at = ((tile % most) * side + y) * side + x
        found = [np.empty(0, "int64")]
        for first in range(0, len(starts), most):
            lo, hi = starts[first], starts[first + most] if first + most < len(starts) else n
            block = np.zeros(min(most, len(starts) - first) * side * side, "int32")
            block[at[lo:hi]] = place[lo:hi]
            if np.any(block[at[lo:hi]] != place[lo:hi]):
                raise ValueError("a pixel of the grid is given twice")
            home = (y[lo:hi] >= 2 * radius) & (y[lo:hi] < edge + 2 * radius) & (x[lo:hi] >= 2 * radius) & (x[lo:hi] < edge + 2 * radius)
            left = lo + np.flatnonzero(home)
            for dy, dx in around:
                left = left[block[at[left] + dy * side + dx] < place[left]]
            found.append(left)
        at = np.concatenate(found)
        return at, {c: own[c][at] for c in ("y", "x", "v")}
    return peaks


def _dense_peaks(heat: DataFrame, canvas: DataFrame, radius: int, edge: int) -> DataFrame:
    """Maxima ``(image_id, y, x, v)`` of their neighbourhood among all pixels of the canvas."""
    s = st.to_strips(heat, radius, edge=edge, canvas=canvas.select("image_id", "h", "w"), fill=0).drop("h", "w")
    ranked_value = F.transform("v", lambda v, i: F.struct(v.alias("v"), (-pixel_id(F.col("y"), F.col("x0") + i)).alias("neg")))
    s = s.withColumn("m", ranked_value).withColumn("own", F.col("m"))
    s = st.pool(s, "m", radius)
    s = s.withColumn("k", F.zip_with("own", "m", lambda a, b: a == b))
    return st.to_pixels(s, ["v", "k"], edge).where("k").drop("k")


def select_peaks(heat: DataFrame, canvas: DataFrame, threshold: float, radius: int, top_k: int,
                 exclude_border: bool = True, edge: int = st.EDGE) -> DataFrame:
    """``(image_id, rank, y, x, confidence)``: maxima of their neighbourhood above ``threshold``, best first.

    Equal values within ``radius`` go to the smallest (y, x). An image where nothing exceeds the
    threshold gets its centre with confidence 0.5. Pixels missing from ``heat`` are 0.

    Only a pixel above the threshold can be a peak or stand against one, so only these are stored and go to their tiles, unless
    the threshold is below the 0 of missing pixels.
    """
    above = materialize(heat.select(*PIXEL, "v").where(F.col("v") > threshold))
    if threshold >= 0:
        on_canvas = salted_join(above.where("image_id IS NOT NULL"), canvas.select("image_id", "h", "w"), ["image_id"])
        on_canvas = on_canvas.where("y >= 0 AND x >= 0 AND y < h AND x < w").select(*PIXEL, "v")
        shape = ", ".join(f"{c} {on_canvas.schema[c].dataType.simpleString()}" for c in (*PIXEL, "v"))
        peaks = st.map_tiles(st.halo_copies(on_canvas, radius, edge), _peaks_of_tiles(radius, edge), shape)
    else:
        peaks = _dense_peaks(heat, canvas, radius, edge).where(F.col("v") > threshold)
    if exclude_border:
        peaks = with_margin(peaks, canvas, radius).where(F.col("v") > threshold)
    best = first_of_each(peaks.withColumn("_low", -F.col("v")), ["image_id"], ["_low", "y", "x"], top_k, "rank")
    seeds = best.select("image_id", "rank", "y", "x", F.col("v").alias("confidence"))
    quiet = canvas.join(above.select("image_id").distinct(), "image_id", "left_anti")
    return seeds.unionByName(quiet.select("image_id", F.lit(1).alias("rank"), F.floor(F.col("h") / 2).cast("int").alias("y"),
                                          F.floor(F.col("w") / 2).cast("int").alias("x"), F.lit(0.5).alias("confidence")))


def ring_band(fov: DataFrame, canvas: DataFrame, inset: int = 40) -> DataFrame:
    """Field-of-view pixels within ``inset`` of its border."""
    return fov.select(*PIXEL).join(erode(fov, ellipse_spans(2 * inset + 1), canvas), PIXEL, "left_anti")


def ring_seeds(fov: DataFrame, canvas: DataFrame, n: int = 24, inset: int = 40, half: int = 32) -> DataFrame:
    """``(image_id, angle, y, x)``: per angle the ring pixel furthest in that direction, moved into the safe zone.

    Projections are compared after rounding to nine decimals; ties take the smallest (y, x), and a
    position found for several angles keeps the first.
    """
    centre = fov.groupBy("image_id").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    ring = salted_join(ring_band(fov, canvas, inset), centre, ["image_id"])
    table = F.expr("array(" + ", ".join(
        f"named_struct('i', {i}, 'dy', {math.sin(2 * math.pi * i / n)!r}D, 'dx', {math.cos(2 * math.pi * i / n)!r}D)" for i in range(n)) + ")")
    score = (F.col("y") - F.col("cy")) * F.col("a.dy") + (F.col("x") - F.col("cx")) * F.col("a.dx")
    best = (ring.select("*", F.explode(table).alias("a")).groupBy("image_id", F.col("a.i").alias("angle"))
            .agg(F.max(F.struct(F.round(score, 9).alias("s"), (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).alias("b")))
    safe = best.join(canvas.select("image_id", "h", "w"), "image_id")
    clamp = lambda v, size: F.least(F.greatest(v, F.lit(half + 2)), F.col(size) - half - 3)
    moved = safe.select("image_id", "angle", clamp(-F.col("b.ny"), "h").alias("y"), clamp(-F.col("b.nx"), "w").alias("x"))
    return moved.groupBy(*PIXEL).agg(F.min("angle").alias("angle")).select("image_id", "angle", "y", "x")


def merge_seeds(detected: DataFrame, ring: DataFrame, max_traces: int, n_ring: int = 24, dedup: int = 35) -> DataFrame:
    """Detector seeds in their slots, then ring seeds no closer than ``dedup`` (Manhattan) to any of them.

    Returns ``(image_id, source, place, y, x)``; detectors come before rings, each by ``place``.
    """
    first = detected.where(F.col("rank") <= max_traces - n_ring)
    near = first.groupBy("image_id").agg(F.collect_list(F.struct("y", "x")).alias("_s"))  # at most max_traces entries
    ok = ~F.exists(F.coalesce("_s", F.array().cast("array<struct<y:int,x:int>>")), lambda s: (
        F.abs(F.col("y") - s["y"]) + F.abs(F.col("x") - s["x"]) < dedup))
    added = ring.join(near, "image_id", "left").where(ok)
    return (first.select("image_id", F.lit("detector").alias("source"), F.col("rank").alias("place"), "y", "x")
            .unionByName(added.select("image_id", F.lit("ring").alias("source"), F.col("angle").alias("place"), "y", "x")))


def frontier_seed(gt: DataFrame, covered: DataFrame, canvas: DataFrame, half: int, extra: int = 0) -> DataFrame:
    """The uncovered annotated pixel furthest from the covered set, moved into the safe zone.

    With nothing covered yet it is the pixel nearest to the centre; fully covered images drop out.
    """
    left = gt.select(*PIXEL).join(covered.select(*PIXEL), PIXEL, "left_anti")
    far = (nearest_d2(left, covered).groupBy("image_id")
           .agg(F.max(F.struct("d2", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).alias("b"))
           .select("image_id", (-F.col("b.ny")).alias("y"), (-F.col("b.nx")).alias("x")))
    fresh = salted_join(salted_join(left, covered.select("image_id").distinct(), ["image_id"], "left_anti"), canvas, ["image_id"])
    dy, dx = F.col("y") - F.floor(F.col("h") / 2), F.col("x") - F.floor(F.col("w") / 2)
    start = (fresh.groupBy("image_id").agg(F.min(F.struct((dy * dy + dx * dx).alias("d2"), "y", "x")).alias("b"))
             .select("image_id", F.col("b.y").alias("y"), F.col("b.x").alias("x")))
    m = half + extra
    clamp = lambda c, n: F.least(F.greatest(F.col(c), F.lit(m)), F.col(n) - m - 1).cast("int").alias(c)
    return far.unionByName(start).join(canvas, "image_id").select("image_id", clamp("y", "h"), clamp("x", "w"))
