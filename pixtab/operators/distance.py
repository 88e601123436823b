"""Distances to the nearest foreground pixel."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixtab.functions.keys import spread_out
from pixtab.functions.lineage import materialize
from pixtab.functions.offsets import disk
from pixtab.functions.strips import EDGE, TILE, TileWork, halo_copies, halo_tiles, map_tiles, tile_of_rows, tile_votes

_CHUNK = 1 << 20  # candidate distances evaluated at once
#: Edge of the lowest cells of the pyramid, and how many of them make up the edge of a cell above.
LEAF, FAN = 32, 4


def near_d2(points: DataFrame, radius: float) -> DataFrame:
    """``(image_id, y, x, d2)`` for every pixel within ``radius`` of a point (bounded variant)."""
    offs = disk(radius)
    votes = tile_votes(points, offs, [dy * dy + dx * dx for dy, dx in offs])
    return votes.groupBy(*TILE, "y", "x").agg(F.min("k").alias("d2")).select("image_id", "y", "x", "d2")


def pixels_of(canvas: DataFrame) -> DataFrame:
    """All pixels of each canvas; rows are generated in parallel per (image, row)."""
    rows = (canvas.where("h > 0 AND w > 0")
            .select("image_id", "w", F.explode(F.expr("sequence(0, h - 1)")).alias("y"))
            .repartition("image_id", "y"))
    return rows.select("image_id", "y", F.explode(F.expr("sequence(0, w - 1)")).alias("x"))


def _clipped_rows(radius: float, edge: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per tile ``(image_id, ty, tx, h, w, py, px)``: its raster rows with the squared distance to a point within ``radius``, or -1."""
    reach = int(math.floor(radius))
    far_first = sorted(disk(radius), key=lambda o: (-(o[0] * o[0] + o[1] * o[1]), o))
    side = edge + 4 * reach  # the halo, and what points of the halo reach

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["image_id", "y", "x0", "d2"]
        for batch in batches:
            at, parts, size = [], [], 0
            ty, tx, h, w = (batch.column(c).to_numpy() for c in ("ty", "tx", "h", "w"))
            for i in range(batch.num_rows):
                block = np.full((side, side), -1, "int32")
                if batch.column("py")[i].is_valid:
                    y = batch.column("py")[i].values.to_numpy() - ty[i] * edge + 2 * reach
                    x = batch.column("px")[i].values.to_numpy() - tx[i] * edge + 2 * reach
                    for dy, dx in far_first:
                        block[y + dy, x + dx] = dy * dy + dx * dx
                high, wide = min(edge, h[i] - ty[i] * edge), min(edge, w[i] - tx[i] * edge)
                at.append((i, ty[i] * edge, tx[i] * edge, high, wide))
                parts.append(block[2 * reach:2 * reach + high, 2 * reach:2 * reach + wide].ravel())
                size += parts[-1].size
                if size >= _CHUNK or i + 1 == batch.num_rows:
                    tile, y0, x0, highs, wides = np.array(at, "int64").T
                    first = np.concatenate([np.arange(n) for n in highs])
                    ends = np.concatenate([[0], np.cumsum(np.repeat(wides, highs))])
                    yield pa.RecordBatch.from_arrays([
                        batch.column("image_id").take(pa.array(np.repeat(tile, highs))),
                        pa.array((np.repeat(y0, highs) + first).astype("int32")), pa.array(np.repeat(x0, highs).astype("int32")),
                        pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(np.concatenate(parts)))], names=names)
                    at, parts, size = [], [], 0
    return rows


def clipped_distance(points: DataFrame, canvas: DataFrame, tolerance: float, edge: int = EDGE) -> DataFrame:
    """Distance map clipped at ``tolerance``; an image without points is ``tolerance`` everywhere.

    Only the points and one row per tile are shuffled. The pixels of a canvas are unpacked from raster rows where their tile is.
    """
    key, kind = (canvas.schema[c].dataType.simpleString() for c in ("image_id", "h"))
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / edge).cast("int")))
    tiles = canvas.where("h > 0 AND w > 0").select("image_id", F.col("h").cast("long").alias("h"), F.col("w").cast("long").alias("w"))
    tiles = spread_out(tiles.withColumn("ty", cells("h")).withColumn("tx", cells("w")), *TILE)
    near = halo_tiles(points.select("image_id", "y", "x"), int(math.floor(tolerance)), edge).groupBy(*TILE).agg(
        F.collect_list(F.struct("y", "x")).alias("p"))
    rows = tiles.join(near, TILE, "left").select(*TILE, "h", "w", F.col("p.y").alias("py"), F.col("p.x").alias("px")).mapInArrow(
        _clipped_rows(tolerance, edge), f"image_id {key}, y int, x0 int, d2 array<int>")
    px = rows.select("image_id", "y", "x0", F.posexplode("d2").alias("_i", "d2"))
    d = F.least(F.sqrt(F.col("d2").cast("double")), F.lit(float(tolerance)))
    return px.select("image_id", F.col("y").cast(kind).alias("y"), (F.col("x0") + F.col("_i")).cast(kind).alias("x"),
                     F.when(F.col("d2") >= 0, d).otherwise(F.lit(float(tolerance))).alias("v"))


def _near_tiles(radius: int, edge: int) -> TileWork:
    by_length = sorted(disk(radius), key=lambda o: (o[0] * o[0] + o[1] * o[1], o))
    side, most = edge + 4 * radius, 128  # tiles whose blocks are held at once

    def near(own: dict[str, np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, dict]:
        n = len(own["y"])
        tile, query = tile_of_rows(starts, n), own["is_query"] == 1
        y = own["y"].astype("int64") - own["ty"].astype("int64") * edge + 2 * radius
        x = own["x"].astype("int64") - own["tx"].astype("int64") * edge + 2 * radius
        home = query & (y >= 2 * radius) & (y < edge + 2 * radius) & (x >= 2 * radius) & (x < edge + 2 * radius)
        at = ((tile % most) * side + y) * side + x
        best = np.full(n, -1, "int64")
        for first in range(0, len(starts), most):
            lo, hi = starts[first], starts[first + most] if first + most < len(starts) else n
            there = np.zeros(min(most, len(starts) - first) * side * side, bool)
            there[at[lo:hi][~query[lo:hi]]] = True
            left = lo + np.flatnonzero(home[lo:hi])
            for dy, dx in by_length:
                if not len(left):
                    break
                hit = there[at[left] + dy * side + dx]
                best[left[hit]] = dy * dy + dx * dx
                left = left[~hit]
        asked = np.flatnonzero(home)
        return asked, {"y": own["y"][asked], "x": own["x"][asked], "d2": best[asked]}
    return near


def visited_d2(places: DataFrame, points: DataFrame, radius: float, edge: int = EDGE) -> DataFrame:
    """``(image_id, y, x, d2)`` for the distinct ``places`` that have a point within ``radius``, exactly.

    Points go with their halo copies to the tiles that have a place, and are looked up in the tile's block: nothing is spread over a disk,
    and points of tiles nobody visits do not move on.
    """
    key = points.schema["image_id"].dataType.simpleString()
    reach = math.ceil(radius)
    home = [F.floor(F.col(c) / edge).cast("int").alias(t) for c, t in (("y", "ty"), ("x", "tx"))]
    asked = places.select("image_id", "y", "x").distinct().select("image_id", "y", "x", *home)
    copies = points.select("image_id", "y", "x")
    for c, t in (("y", "ty"), ("x", "tx")):
        first, last = (F.floor((F.col(c) + d) / edge) for d in (-reach, reach))
        copies = copies.withColumn(t, F.explode(F.sequence(first, last).cast("array<int>")))
    asked = asked.groupBy(*TILE).agg(F.collect_list(F.struct("y", "x")).alias("q"))
    near = copies.join(asked.select(*TILE), TILE, "left_semi").groupBy(*TILE).agg(F.collect_list(F.struct("y", "x")).alias("p"))
    found = asked.join(near, TILE).select("image_id", "q.y", "q.x", F.col("p.y").alias("py"), F.col("p.x").alias("px")).mapInPandas(
        _look_up(reach), f"image_id {key}, y int, x int, d2 bigint")
    return found.where(F.col("d2") <= radius * radius)


def _look_up(reach: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per tile ``(image_id, y, x, py, px)``: the places that have a point within ``reach``; offsets are tried from short to long."""
    by_length = sorted(disk(reach), key=lambda o: (o[0] * o[0] + o[1] * o[1], o))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names, parts = [], [np.empty((3, 0), "int64")]
            for image, y, x, py, px in pdf.itertuples(index=False):
                y, x, py, px = (c.astype("int64") for c in (y, x, py, px))
                y0, x0 = y.min() - reach, x.min() - reach
                there = np.zeros((y.max() - y0 + reach + 1, x.max() - x0 + reach + 1), bool)
                py, px = py - y0, px - x0
                inside = (py >= 0) & (px >= 0) & (py < there.shape[0]) & (px < there.shape[1])
                there[py[inside], px[inside]] = True
                d2, left = np.full(len(y), -1, "int64"), np.arange(len(y))
                for dy, dx in by_length:
                    if not len(left):
                        break
                    hit = there[y[left] - y0 + dy, x[left] - x0 + dx]
                    d2[left[hit]] = dy * dy + dx * dx
                    left = left[~hit]
                keep = d2 >= 0
                names += [image] * int(keep.sum())
                parts.append(np.stack([y[keep], x[keep], d2[keep]]))
            y, x, d2 = np.concatenate(parts, axis=1)
            yield pd.DataFrame({"image_id": pd.Series(names, dtype=object), "y": y.astype("int32"), "x": x.astype("int32"), "d2": d2})
    return look


def nearest_d2(queries: DataFrame, targets: DataFrame, radius: int = 8, edge: int = EDGE) -> DataFrame:
    """Exact squared Euclidean distance from each query pixel to the nearest target of its image.

    Queries with a target within ``radius`` are answered inside halo tiles, after one shuffle of the given pixels.
    Only the others go down a pyramid of occupied cells. Queries of images without targets are left out.
    """
    key = queries.schema["image_id"].dataType.simpleString()
    both = (queries.select("image_id", "y", "x", F.lit(1).alias("is_query"))
            .unionByName(targets.select("image_id", "y", "x", F.lit(0).alias("is_query"))))
    near = materialize(map_tiles(halo_copies(both, radius, edge), _near_tiles(radius, edge), f"image_id {key}, y int, x int, d2 bigint"))
    far = near.where("d2 < 0").drop("d2")
    found = near.where("d2 >= 0")
    return found if far.isEmpty() else found.unionByName(_far_d2(far, targets))


def _leaves(px: DataFrame) -> DataFrame:
    """``(image_id, cy, cx, at, y0, y1, x0, x1)``: pixels of every occupied cell of the lowest level, and their box."""
    cell = [F.floor(F.col(c) / LEAF).cast("int").alias(n) for c, n in (("y", "cy"), ("x", "cx"))]
    ends = [f(c).alias(f"{c}{i}") for c in ("y", "x") for i, f in enumerate((F.min, F.max))]
    return px.groupBy("image_id", *cell).agg(F.collect_list(F.struct("y", "x")).alias("at"), *ends)


def _cells(leaves: DataFrame, size: int, side: str) -> DataFrame:
    """Occupied cells of edge ``size`` as ``(image_id, {side}cell, {side}above, {side}box)``."""
    def at(edge: int) -> Column:
        return F.struct(*[F.floor(F.col(c) * LEAF / edge).cast("int").alias(c) for c in ("cy", "cx")])

    ends = [f(f"{c}{i}").alias(f"{c}{i}") for c in ("y", "x") for i, f in enumerate((F.min, F.max))]
    return leaves.groupBy("image_id", at(size).alias(f"{side}cell"), at(size * FAN).alias(f"{side}above")).agg(*ends).select(
        "image_id", f"{side}cell", f"{side}above", F.struct("y0", "y1", "x0", "x1").alias(f"{side}box"))


def _not_beaten(pairs: DataFrame) -> DataFrame:
    """Pairs of cells, less those whose nearest places lie farther apart than the farthest ones of another pair of the query cell."""
    gap, reach = [], []
    for c in ("y", "x"):
        after, before = F.col(f"tbox.{c}0") - F.col(f"qbox.{c}1"), F.col(f"qbox.{c}0") - F.col(f"tbox.{c}1")
        gap.append(F.greatest(after, before, F.lit(0)).cast("long"))
        reach.append(F.greatest(F.col(f"tbox.{c}1") - F.col(f"qbox.{c}0"), F.col(f"qbox.{c}1") - F.col(f"tbox.{c}0")).cast("long"))
    bound = F.min("_hi").over(Window.partitionBy("image_id", "qcell"))
    return (pairs.withColumn("_hi", reach[0] * reach[0] + reach[1] * reach[1]).withColumn("_bound", bound)
            .where(gap[0] * gap[0] + gap[1] * gap[1] <= F.col("_bound")).select("image_id", "qcell", "tcell"))


def opened_cells(asked: DataFrame, there: DataFrame) -> DataFrame:
    """``(image_id, qcell, tcell)``: for every leaf of queries, the leaves of targets that may hold a nearest one.

    Both sides go down a pyramid of occupied cells. At each level a pair of cells is opened only if its least distance does
    not exceed the smallest upper bound of its query cell, so the pairs that are left lie in a ring around the nearest target.
    """
    span = asked.unionByName(there).agg(*[(F.max(f"{c}1") - F.min(f"{c}0")).alias(c) for c in ("y", "x")]).first()
    size = LEAF
    while size * FAN <= max(span.y or 0, span.x or 0):
        size *= FAN
    # at most FAN + 1 cells along an edge, so 25 a side and image in the first join
    pairs = _not_beaten(_cells(asked, size, "q").join(_cells(there, size, "t"), "image_id"))
    while size > LEAF:
        size //= FAN
        above = pairs.select("image_id", F.col("qcell").alias("qabove"), F.col("tcell").alias("tabove"))
        below = above.join(_cells(asked, size, "q"), ["image_id", "qabove"]).join(_cells(there, size, "t"), ["image_id", "tabove"])
        pairs = _not_beaten(below)
    return pairs


def _least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per leaf ``(image_id, y, x, ty, tx)``: the least squared distance of each query to the targets of the opened cells."""
    for pdf in batches:
        names, parts = [], [np.empty((3, 0), "int64")]
        for image, *arrays in pdf.itertuples(index=False):
            y, x, ty, tx = (c.astype("int64") for c in arrays)
            d2, step = np.empty(len(y), "int64"), max(1, _CHUNK // len(ty))
            for s in range(0, len(y), step):
                part = slice(s, s + step)
                d2[part] = ((y[part, None] - ty) ** 2 + (x[part, None] - tx) ** 2).min(axis=1)
            names += [image] * len(y)
            parts.append(np.stack([y, x, d2]))
        y, x, d2 = np.concatenate(parts, axis=1)
        yield pd.DataFrame({"image_id": pd.Series(names, dtype=object), "y": y.astype("int32"), "x": x.astype("int32"), "d2": d2})


def _far_d2(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Nearest targets at any distance: a leaf of queries is compared with the pixels of the cells it opens, and no others.

    Nothing is joined by image alone but the top of the pyramid; a hot image is as many rows as it has leaves.
    """
    key = queries.schema["image_id"].dataType.simpleString()
    asked, there = materialize(_leaves(queries)), materialize(_leaves(targets.select("image_id", "y", "x").distinct()))
    leaf = F.struct("cy", "cx")
    goals = (opened_cells(asked, there).join(there.select("image_id", leaf.alias("tcell"), "at"), ["image_id", "tcell"])
             .groupBy("image_id", "qcell").agg(F.flatten(F.collect_list("at")).alias("t")))
    met = asked.select("image_id", leaf.alias("qcell"), "at").join(goals, ["image_id", "qcell"])
    return spread_out(met, "image_id", "qcell").select(
        "image_id", "at.y", "at.x", F.col("t.y").alias("ty"), F.col("t.x").alias("tx")).mapInPandas(
        _least, f"image_id {key}, y int, x int, d2 bigint")


def distance_map(points: DataFrame, canvas: DataFrame) -> DataFrame:
    """Exact Euclidean distance at every canvas pixel (null where the image has no point)."""
    px = pixels_of(canvas)
    d2 = nearest_d2(px, points)
    return (px.join(d2, ["image_id", "y", "x"], "left")
            .select("image_id", "y", "x", F.sqrt(F.col("d2").cast("double")).alias("v")))
