"""Patches around anchors, observation channels, tile covers and tile blending."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixtab.functions.draws import draw_below
from pixtab.functions.keys import salted_join, spread_out
from pixtab.functions.strips import EDGE, TILE, halo_tiles

PIXEL = ["image_id", "y", "x"]


#: Patches handed to Spark at once: a patch may be large.
_BATCH = 64


def _cut(batches: Iterator[pd.DataFrame], names: list[str], fills: list[float], half: int, edge: int,
         finish: Callable[[dict, pd.Series], dict], keep: list[str]) -> Iterator[pd.DataFrame]:
    """Patches from rows that come tile by tile: first the tile's raster rows, then its anchors."""
    size, tile, blocks, out = edge + 2 * half, None, {}, []
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            if (r.image_id, r.ty, r.tx) != tile:
                tile, blocks = (r.image_id, r.ty, r.tx), {n: np.full((size, size), f) for n, f in zip(names, fills, strict=True)}
            at_y, at_x = r.y - r.ty * edge, r.x - r.tx * edge
            if r.is_anchor:
                patch = {n: b[at_y:at_y + 2 * half + 1, at_x:at_x + 2 * half + 1] for n, b in blocks.items()}
                out.append({"anchor_id": r.anchor_id, **{k: getattr(r, k) for k in keep}, **finish(patch, r)})
                if len(out) == _BATCH:
                    yield pd.DataFrame(out)
                    out = []
            else:
                xs = np.asarray(r.xs) - r.tx * edge + half
                for n in names:
                    blocks[n][at_y + half, xs] = getattr(r, f"p_{n}")
    if out:
        yield pd.DataFrame(out)


def _patches(grid: DataFrame, names: Mapping[str, float], anchors: DataFrame, half: int, channels: Sequence[str],
             finish: Callable[[dict, pd.Series], dict], keep: Sequence[str] = (), edge: int = EDGE) -> DataFrame:
    """One row per anchor with the array ``channels`` of its square, in (dy, dx) order.

    Pixels and anchors are dealt out by tile, pixels with a halo of ``half``, and meet there as they stream by:
    a task holds one tile, nothing is joined per pixel, and missing pixels have the value given in ``names``.
    """
    packed = F.collect_list(F.struct("x", *[F.col(n).cast("double").alias(n) for n in names]))
    rows = halo_tiles(grid.select(*PIXEL, *names), half, edge).groupBy(*TILE, "y").agg(packed.alias("_p"))
    strips = rows.select(*TILE, "y", F.lit(0).alias("x"), F.lit(False).alias("is_anchor"), F.col("_p.x").alias("xs"),
                         *[F.col(f"_p.{n}").alias(f"p_{n}") for n in names])
    own = anchors.select("image_id", F.floor(F.col("y") / edge).cast("int").alias("ty"), F.floor(F.col("x") / edge).cast("int").alias("tx"),
                         F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.lit(True).alias("is_anchor"), "anchor_id", *keep)
    met = spread_out(strips.unionByName(own, allowMissingColumns=True), *TILE).sortWithinPartitions(*TILE, "is_anchor", "y")
    kinds = dict(anchors.dtypes)
    shape = ", ".join([f"anchor_id {kinds['anchor_id']}", *[f"`{k}` {kinds[k]}" for k in keep], *[f"`{c}` array<double>" for c in channels]])
    fills, fields = list(names.values()), list(names)
    return met.mapInPandas(lambda b: _cut(b, fields, fills, half, edge, finish, list(keep)), shape)


def unpacked(patches: DataFrame, half: int, columns: Sequence[str]) -> DataFrame:
    """``(anchor_id, dy, dx, <columns>)``: array channels as one row per patch pixel."""
    side = 2 * half + 1
    out = patches.select("anchor_id", F.posexplode(F.arrays_zip(*columns)).alias("_i", "_p"))
    return out.select("anchor_id", (F.floor(F.col("_i") / side) - half).cast("int").alias("dy"), (F.col("_i") % side - half).alias("dx"),
                      *[F.col(f"_p.{c}").alias(c) for c in columns])


def patch_arrays(grid: DataFrame, anchors: DataFrame, half: int, edge: int = EDGE) -> DataFrame:
    """``(anchor_id, v)``: the square around each anchor as one array in (dy, dx) order, 0 outside the image."""
    return _patches(grid, {"v": 0.0}, anchors, half, ["v"], lambda patch, _: {"v": patch["v"].ravel()}, edge=edge)


def crop(grid: DataFrame, anchors: DataFrame, half: int, edge: int = EDGE) -> DataFrame:
    """``(anchor_id, dy, dx, v)``: the same as one row per patch pixel."""
    rows = unpacked(patch_arrays(grid, anchors, half, edge), half, ["v"])
    return rows.withColumn("v", F.col("v").cast(grid.schema["v"].dataType))


def _slope(column: str, along: str, across: str) -> Column:
    """Central difference inside the patch, one-sided at its border."""
    w = Window.partitionBy("anchor_id", across).orderBy(along)
    before, after, here = F.lag(column).over(w), F.lead(column).over(w), F.col(column)
    return F.when(before.isNull(), after - here).when(after.isNull(), here - before).otherwise((after - before) / 2)


def toward(patch: DataFrame, column: str = "v") -> DataFrame:
    """Unit direction of steepest descent of a distance patch: ``gy, gx``."""
    out = patch.withColumn("_gy", -_slope(column, "dy", "dx")).withColumn("_gx", -_slope(column, "dx", "dy"))
    size = F.sqrt(F.col("_gy") * F.col("_gy") + F.col("_gx") * F.col("_gx")) + 1e-8
    return out.withColumn("gy", F.col("_gy") / size).withColumn("gx", F.col("_gx") / size).drop("_gy", "_gx")


def observations(anchors: DataFrame, px: DataFrame, distance: DataFrame, visits: DataFrame, half: int,
                 tolerance: float, vesselness: DataFrame | None = None, edge: int = EDGE) -> DataFrame:
    """All channels of the patches of ``anchors(anchor_id, image_id, order, y, x)``, one row of arrays per anchor.

    ``px`` holds r, g, b in [0, 1]; ``visits(image_id, y, x, first)`` the order of the first visit of a
    pixel, which counts as visited when earlier than the anchor's own. ``half`` is at least 1. Anchors that share an
    ``anchor_id`` give a row each. ``unpacked`` turns the arrays into rows.
    """
    if half < 1:
        raise ValueError("a direction needs patches of at least 3 x 3 pixels")
    table = px.select(*PIXEL, "r", "g", "b").join(distance.select(*PIXEL, F.col("v").alias("d")), PIXEL)
    names = {"r": 0.0, "g": 0.0, "b": 0.0, "d": 0.0}
    if vesselness is not None:
        table = table.join(vesselness.select(*PIXEL, F.col("v").alias("vesselness")), PIXEL, "left").na.fill(0, ["vesselness"])
        names["vesselness"] = 0.0
    table = table.join(visits.groupBy(*PIXEL).agg(F.min("first").cast("double").alias("first")), PIXEL, "left")
    table = table.withColumn("first", F.coalesce("first", F.lit(float("inf"))))
    names["first"] = float("inf")
    extra = [] if vesselness is None else ["vesselness"]

    def finish(patch: dict, anchor: pd.Series) -> dict:
        down, right = (-g for g in np.gradient(patch["d"]))
        size = np.sqrt(down * down + right * right) + 1e-8
        out = {n: patch[n] for n in ("r", "g", "b", *extra)} | {
            "visited": (patch["first"] < anchor.order).astype(float), "dt": np.clip(patch["d"] / max(tolerance, 1e-6), 0.0, 1.0),
            "gy": down / size, "gx": right / size}
        return {n: v.ravel() for n, v in out.items()}

    return _patches(table, names, anchors, half, ["r", "g", "b", "visited", "dt", "gy", "gx", *extra], finish, ("order",), edge)


def tile_cover(canvas: DataFrame, size: int, stride: int) -> DataFrame:
    """``(image_id, ty, tx)``: top-left corners 0, stride, … plus the last one flush with the border."""
    def starts(n: str) -> Column:
        regular = F.when(F.col(n) >= size, F.sequence(F.lit(0), F.greatest(F.col(n) - size, F.lit(0)), F.lit(stride))).otherwise(
            F.array().cast("array<int>"))
        return F.explode(F.array_distinct(F.concat(regular, F.array(F.greatest(F.lit(0), F.col(n) - size)))))

    return canvas.select("image_id", "w", starts("h").alias("ty")).select("image_id", "ty", starts("w").alias("tx"))


def pixels_in(grid: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """Columns of ``tiles`` (corners ``ty, tx``) beside the pixels that lie in them, one row per tile and pixel.

    Tiles and pixels meet on grid cells of the tile size, of which a tile touches at most four. No position is made per tile: Spark
    does not see such rows in its size estimate and would send them all through the driver. So the tiles are merged, not broadcast.
    """
    cell = lambda c: F.explode(F.sequence(F.floor(F.col(c) / size), F.floor((F.col(c) + size - 1) / size)))
    spread = tiles.withColumn("_cy", cell("ty")).withColumn("_cx", cell("tx")).hint("merge")
    px = grid.withColumn("_cy", F.floor(F.col("y") / size)).withColumn("_cx", F.floor(F.col("x") / size))
    hit = F.col("y").between(F.col("ty"), F.col("ty") + size - 1) & F.col("x").between(F.col("tx"), F.col("tx") + size - 1)
    values = [c for c in grid.columns if c not in PIXEL]
    return px.join(spread, ["image_id", "_cy", "_cx"]).where(hit).select(*tiles.columns, "y", "x", *values)


def blend_tiles(predictions: DataFrame, size: int) -> DataFrame:
    """Weighted mean of overlapping tile values ``(image_id, ty, tx, y, x, v)``; weights fall off as exp(-2 u^2)."""
    u = lambda at, start: F.lit(-1.0) + (F.col(at) - F.col(start)) * (2.0 / (size - 1))
    uy, ux = u("y", "ty"), u("x", "tx")
    t = predictions.withColumn("_k", F.exp(-2 * uy * uy) * F.exp(-2 * ux * ux))
    return t.groupBy(*PIXEL).agg((F.sum(F.col("_k") * F.col("v")) / (F.sum("_k") + 1e-8)).alias("v"))


def random_tiles(points: DataFrame, canvas: DataFrame, size: int, per_image: int = 1, seed: int = 0, tries: int = 10,
                 enough: int = 10) -> DataFrame:
    """Random tile positions that prefer content: the first of ``tries`` with more than ``enough`` points, else the last.

    Candidates and points meet on grid cells of the tile size (a candidate touches at most four),
    so the join stays an equi-join with bounded groups. Images not larger than a tile give (0, 0).
    """
    big = (F.col("h") > size) & (F.col("w") > size)
    cand = canvas.select("*", F.explode(F.sequence(F.lit(0), F.lit(per_image - 1))).alias("sample"))
    cand = cand.select("*", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("k"))
    draw = lambda n, axis: F.when(big, draw_below(F.greatest(F.col(n) - size, F.lit(1)), seed, F.lit(axis), "image_id", "sample", "k")).otherwise(F.lit(0))
    cand = cand.withColumn("ty", draw("h", 0)).withColumn("tx", draw("w", 1)).select("image_id", "sample", "k", "ty", "tx")
    cell = lambda c: F.explode(F.sequence(F.floor(F.col(c) / size), F.floor((F.col(c) + size - 1) / size)))
    spread = cand.withColumn("cy", cell("ty")).withColumn("cx", cell("tx"))
    pts = points.select(*PIXEL, F.floor(F.col("y") / size).alias("cy"), F.floor(F.col("x") / size).alias("cx"))
    hit = (F.col("y") >= F.col("ty")) & (F.col("y") < F.col("ty") + size) & (F.col("x") >= F.col("tx")) & (F.col("x") < F.col("tx") + size)
    n = spread.join(pts, ["image_id", "cy", "cx"]).where(hit).groupBy("image_id", "sample", "k").agg(F.count(F.lit(1)).alias("n"))
    scored = cand.join(n, ["image_id", "sample", "k"], "left").na.fill(0, ["n"])
    rank = F.when(F.col("n") > enough, F.col("k")).otherwise(F.lit(tries) * 2 - F.col("k"))
    best = scored.groupBy("image_id", "sample").agg(F.min_by(F.struct("ty", "tx", "n"), rank).alias("b"))
    return best.select("image_id", "sample", F.col("b.ty").alias("ty"), F.col("b.tx").alias("tx"), F.col("b.n").alias("points"))


def crop_tiles(grid: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """Pixels of each tile, at their places in it."""
    t = pixels_in(grid, tiles.select("image_id", "sample", "ty", "tx"), size)
    values = [c for c in grid.columns if c not in PIXEL]
    return t.select("image_id", "sample", (F.col("y") - F.col("ty")).alias("dy"), (F.col("x") - F.col("tx")).alias("dx"), *values)


def with_margin(grid: DataFrame, canvas: DataFrame, margin: int) -> DataFrame:
    """Zero the outer ``margin`` pixels of each image."""
    out = salted_join(grid, canvas.select("image_id", "h", "w"), ["image_id"])
    inner = F.col("y").between(margin, F.col("h") - margin - 1) & F.col("x").between(margin, F.col("w") - margin - 1)
    return out.select(*PIXEL, F.when(inner, F.col("v")).otherwise(F.lit(0.0)).alias("v"))
