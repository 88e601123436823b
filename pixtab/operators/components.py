"""Connected components of point sets and graphs.

Pixels are labelled inside tiles first (a tile is a bounded group), so only one node per tile-local
piece and one edge per touching pair of pieces enters the iterative part. Labels are the smallest
pixel id of the component.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixtab.functions.keys import id_x, id_y, pixel_id, salted_join
from pixtab.functions.lineage import materialize
from pixtab.functions.strips import EDGE, TileWork, map_tiles, tile_of_rows

_FORWARD8 = [(0, 1), (1, -1), (1, 0), (1, 1)]
_FORWARD4 = [(0, 1), (1, 0)]
PIXEL = ["image_id", "y", "x"]


@dataclass(frozen=True)
class Labelled:
    """``pixels(image_id, y, x, piece)`` and ``pieces(image_id, piece, n, label)``."""

    pixels: DataFrame
    pieces: DataFrame


def _places(y: np.ndarray, x: np.ndarray, own: dict, tile: np.ndarray, edge: int) -> np.ndarray:
    """A number per pixel that orders by (tile, y, x); neighbours in a tile differ by the same number everywhere, pixels of two tiles never touch."""
    wide = edge + 2
    return (tile * wide + y - own["ty"].astype("int64") * edge + 1) * wide + x - own["tx"].astype("int64") * edge + 1


def _label_tiles(forward: Sequence[tuple[int, int]], edge: int) -> TileWork:
    def label(own: dict[str, np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, dict]:
        y, x = own["y"].astype("int64"), own["x"].astype("int64")
        at = _places(y, x, own, tile_of_rows(starts, len(y)), edge)
        order = np.argsort(at, kind="stable")
        at, a, b = at[order], [], []
        for dy, dx in forward:
            goal = at + dy * (edge + 2) + dx
            to = np.searchsorted(at, goal)
            hit = np.flatnonzero(at[np.minimum(to, len(at) - 1)] == goal)
            a.append(hit)
            b.append(to[hit])
        y, x = y[order], x[order]
        root = _roots(len(at), np.concatenate(a), np.concatenate(b))
        return order, {"y": y, "x": x, "piece": ((y << 32) + x)[root]}
    return label


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index connected to each of ``n`` nodes by the pairs ``a[i], b[i]``."""
    parent = np.arange(n)
    while True:
        low = np.minimum(parent[a], parent[b])
        new = parent.copy()
        np.minimum.at(new, parent[a], low)
        np.minimum.at(new, parent[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, parent):
            return new
        parent = new


def _link_tiles(edge: int) -> TileWork:
    """Labels by explicit links ``to`` (pixel ids, -1 when there is none)."""
    def label(own: dict[str, np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, dict]:
        y, x, to = (own[c].astype("int64") for c in ("y", "x", "to"))
        tile = tile_of_rows(starts, len(y))
        at = _places(y, x, own, tile, edge)
        order = np.argsort(at, kind="stable")
        goal = _places(to >> 32, to & 0xFFFFFFFF, own, tile, edge)
        inside = (to >= 0) & ((to >> 32) // edge == own["ty"]) & ((to & 0xFFFFFFFF) // edge == own["tx"])
        at, goal, inside = at[order], goal[order], inside[order]
        place = np.minimum(np.searchsorted(at, goal), len(at) - 1)
        hit = np.flatnonzero(inside & (at[place] == goal))
        y, x = y[order], x[order]
        return order, {"y": y, "x": x, "to": to[order], "piece": ((y << 32) + x)[_roots(len(at), hit, place[hit])]}
    return label


def _tiled(px: DataFrame, edge: int) -> DataFrame:
    out = px.withColumn("ty", F.floor(F.col("y") / edge).cast("int")).withColumn("tx", F.floor(F.col("x") / edge).cast("int"))
    return out


def label_links(links: DataFrame, edge: int = EDGE) -> Labelled:
    """Components of pixels that name at most one other pixel each: ``(image_id, y, x, to)``."""
    key = links.schema["image_id"].dataType.simpleString()
    px = map_tiles(_tiled(links.select(*PIXEL, F.coalesce("to", F.lit(-1)).alias("to")), edge), _link_tiles(edge),
                   f"image_id {key}, y int, x int, to bigint, piece bigint")
    px = materialize(px.withColumn("to", F.when(F.col("to") >= 0, F.col("to"))))
    ends = px.select("image_id", pixel_id().alias("to"), F.col("piece").alias("b"))
    over = (px.where("to IS NOT NULL").where(
        (F.floor(id_y(F.col("to")) / edge) != F.floor(F.col("y") / edge)) | (F.floor(id_x(F.col("to")) / edge) != F.floor(F.col("x") / edge)))
        .select("image_id", "to", F.col("piece").alias("a")).join(ends, ["image_id", "to"]).select("image_id", "a", "b").distinct())
    return _join_pieces(px.drop("to"), materialize(over))


def _join_pieces(px: DataFrame, links: DataFrame) -> Labelled:
    pieces = px.groupBy("image_id", "piece").agg(F.count(F.lit(1)).alias("n"))
    if links.isEmpty():
        return Labelled(px, pieces.withColumn("label", F.col("piece")))
    labels = min_labels(links).withColumnRenamed("node", "piece")
    return Labelled(px, pieces.join(labels, ["image_id", "piece"], "left").withColumn("label", F.coalesce("label", "piece")))


def min_labels(edges: DataFrame) -> DataFrame:
    """``(image_id, node, label)`` for every node of ``edges(image_id, a, b)``.

    Alternating star contraction: each round hangs larger neighbours, then smaller ones, on the
    smallest neighbour until every component is a star. Hubs are salted in the joins, and groups are
    only ever reduced to a minimum.
    """
    e = edges.where("a <> b").select("image_id", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e)
    seen = None
    while True:
        both = e.unionByName(e.select("image_id", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("image_id", "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (salted_join(both.where("v > u"), low, ["image_id", "u"], by=("v",))
                 .select("image_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("image_id", "u").agg(F.min("v").alias("m"))
        joined = salted_join(large, low, ["image_id", "u"], by=("v",))
        small = (joined.where("v <> m").select("image_id", F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("image_id", "u", F.col("m").alias("v"))).distinct())
        e = materialize(small)
        mark = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("image_id", "u", "v"))).first()
        if mark == seen:
            break
        seen = mark
    return e.select("image_id", F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        e.select("image_id", F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def label_components(points: DataFrame, diagonal: bool = True, edge: int = EDGE) -> Labelled:
    """Label an arbitrary point set; 8-connected when ``diagonal``, else 4-connected."""
    forward = _FORWARD8 if diagonal else _FORWARD4
    key = points.schema["image_id"].dataType.simpleString()
    px = materialize(map_tiles(_tiled(points.select(*PIXEL), edge), _label_tiles(forward, edge), f"image_id {key}, y int, x int, piece bigint"))
    rim = px.where(F.pmod("y", F.lit(edge)).isin(0, edge - 1) | F.pmod("x", F.lit(edge)).isin(0, edge - 1))
    reach = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in forward])
    over = rim.select("image_id", "y", "x", "piece", F.explode(reach).alias("o")).select(
        "image_id", F.col("piece").alias("a"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"),
        F.floor(F.col("y") / edge).alias("_ty"), F.floor(F.col("x") / edge).alias("_tx"))
    over = over.where((F.floor(F.col("y") / edge) != F.col("_ty")) | (F.floor(F.col("x") / edge) != F.col("_tx")))
    links = over.join(rim.withColumnRenamed("piece", "b"), PIXEL).select("image_id", "a", "b").distinct()
    return _join_pieces(px, materialize(links))


def labels_of(found: Labelled) -> DataFrame:
    """``(image_id, y, x, label)``; the join key is a tile-local piece, so no component is one task."""
    return (found.pixels.join(found.pieces.select("image_id", "piece", "label"), ["image_id", "piece"])
            .select("image_id", "y", "x", "label"))


def component_sizes(found: Labelled) -> DataFrame:
    return found.pieces.groupBy("image_id", "label").agg(F.sum("n").alias("size"))


def component_counts(found: Labelled) -> DataFrame:
    """Number of components per image: every component has one piece that carries its own label."""
    return found.pieces.where("piece = label").groupBy("image_id").agg(F.count(F.lit(1)).alias("components"))


def _keep(found: Labelled, labels: DataFrame) -> DataFrame:
    pieces = salted_join(found.pieces, labels.select("image_id", "label"), ["image_id", "label"], by=("piece",))
    return found.pixels.join(pieces.select("image_id", "piece"), ["image_id", "piece"], "left_semi").select(*PIXEL)


def remove_small(points: DataFrame, min_size: int, diagonal: bool = False, edge: int = EDGE) -> DataFrame:
    """Drop components of fewer than ``min_size`` pixels."""
    found = label_components(points, diagonal, edge)
    return _keep(found, component_sizes(found).where(F.col("size") >= min_size))


def largest_component(points: DataFrame, diagonal: bool = True, edge: int = EDGE) -> DataFrame:
    """The largest component of each image; equal sizes go to the smallest label."""
    found = label_components(points, diagonal, edge)
    top = component_sizes(found).groupBy("image_id").agg(
        F.max(F.struct("size", (-F.col("label")).alias("neg"))).alias("t"))
    return _keep(found, top.select("image_id", (-F.col("t.neg")).alias("label")))


def fill_holes(points: DataFrame, edge: int = EDGE) -> DataFrame:
    """Add background that the points cut off (4-connected) from the outside of their bounding box."""
    box = points.groupBy("image_id").agg((F.min("y") - 1).alias("y0"), (F.max("y") + 1).alias("y1"),
                                         (F.min("x") - 1).alias("x0"), (F.max("x") + 1).alias("x1"))
    rows = box.select("*", F.explode(F.expr("sequence(y0, y1)")).alias("y")).repartition("image_id", "y")
    frame = rows.select("image_id", "y", F.explode(F.expr("sequence(x0, x1)")).alias("x"))
    found = label_components(frame.join(points.select(*PIXEL), PIXEL, "left_anti"), False, edge)
    # the box margin is one background component around everything; its corner has the smallest id
    outer = box.select("image_id", pixel_id("y0", "x0").alias("label"))
    holes = salted_join(found.pieces, outer.withColumn("_out", F.lit(True)), ["image_id", "label"], "left", by=("piece",))
    inner = found.pixels.join(holes.where("_out IS NULL").select("image_id", "piece"), ["image_id", "piece"], "left_semi")
    return points.select(*PIXEL).unionByName(inner.select(*PIXEL))


def betti0_error(pred: DataFrame, gt: DataFrame, images: DataFrame, edge: int = EDGE) -> DataFrame:
    """Absolute difference of the numbers of 8-connected components."""
    p = component_counts(label_components(pred, True, edge)).withColumnRenamed("components", "p")
    g = component_counts(label_components(gt, True, edge)).withColumnRenamed("components", "g")
    both = images.select("image_id").distinct().join(p, "image_id", "left").join(g, "image_id", "left").na.fill(0)
    return both.select("image_id", F.abs(F.col("p") - F.col("g")).cast("double").alias("betti_0_error"))
