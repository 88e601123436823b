"""Thinning of masks to one-pixel curves and removal of short branches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixtab.functions.keys import id_x, id_y, pixel_id
from pixtab.functions.lineage import materialize
from pixtab.functions.offsets import NEIGHBOURS8
from pixtab.functions.strips import EDGE, TILE, TileWork, halo_copies, map_tiles, tile_votes
from pixtab.operators.components import remove_small
from pixtab.operators.morphology import dilate, ellipse_spans

PIXEL = ["image_id", "y", "x"]
# neighbours clockwise from north; bit i of a pixel's code says neighbour i is present
_RING = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def _deletable(first: bool) -> np.ndarray:
    """For each code of eight neighbours, whether a pass deletes the pixel."""
    code = np.arange(256)
    bits = code[:, None] >> np.arange(8) & 1
    rises = ((bits == 0) & (np.roll(bits, -1, axis=1) == 1)).sum(axis=1)
    n, e, s, w = 1, 4, 16, 64
    faces = ((n | e | s), (e | s | w)) if first else ((n | e | w), (n | s | w))
    many = bits.sum(axis=1)
    return (many >= 2) & (many <= 6) & (rises == 1) & (code & faces[0] != faces[0]) & (code & faces[1] != faces[1])


def _thin_tile(passes: int, edge: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    tables, halo = (_deletable(True), _deletable(False)), 2 * passes
    wide = edge + 2 * halo

    side = wide + 2  # a border of nothing around the block
    away = [dy * side + dx for dy, dx in _RING]

    def thinned(px: np.ndarray, rims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = (px // edge + halo + 1) * side + px % edge + halo + 1
        there = np.zeros(side * side, bool)
        there[own] = there[(rims // wide + 1) * side + rims % wide + 1] = True
        left = np.flatnonzero(there) if len(px) else own
        for _ in range(passes):
            for table in tables:
                code = np.zeros(len(left), np.uint8)
                for i, off in enumerate(away):
                    code |= there[left + off].astype(np.uint8) << i
                gone = table[code]
                there[left[gone]] = False
                left = left[~gone]
        return px, px[there[own]]

    def thin_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends = [thinned(np.asarray(px, "int64"), np.asarray(c, "int64")) for px, c in zip(pdf["px"], pdf["codes"], strict=True)]
            occupied = np.array([len(before) > 0 for before, _ in ends], bool)
            out = pdf.loc[occupied, TILE].copy()
            out["px"] = pd.Series([after for before, after in ends if len(before)], index=out.index, dtype=object)
            out["changed"] = [len(after) < len(before) for before, after in ends if len(before)]
            yield out
    return thin_tiles


def _same_tile(left: DataFrame, right: DataFrame) -> Column:
    return left["image_id"].eqNullSafe(right["_image"]) & (left["ty"] == right["_ty"]) & (left["tx"] == right["_tx"])


def thinning_rounds(points: DataFrame, per_round: int = 2, edge: int = EDGE) -> Iterator[DataFrame]:
    """``(image_id, ty, tx, px, changed)`` after each round, up to the first that changes nothing: one row per occupied tile.

    A round runs ``per_round`` double passes in the blocks of the active tiles, those that changed in the last round or touch one that
    did; any other tile would see what it saw before. Only pixels of active tiles and the rims that their neighbours
    send them are shuffled. The list of active tiles is met by a join that Spark broadcasts as its size allows.
    """
    if not 1 <= 2 * per_round <= edge:
        raise ValueError(f"{per_round} double passes need a halo of {2 * per_round} pixels, tiles have {edge}")
    halo, key = 2 * per_round, points.schema["image_id"].dataType.simpleString()
    wide, shape = edge + 2 * halo, f"image_id {key}, ty int, tx int, px array<int>, changed boolean"
    tile = [F.floor(F.col(c) / edge).cast("int").alias(t) for c, t in (("y", "ty"), ("x", "tx"))]
    code = F.pmod("y", F.lit(edge)) * edge + F.pmod("x", F.lit(edge))
    state = materialize(points.groupBy("image_id", *tile).agg(F.collect_set(code.cast("int")).alias("px")).withColumn("changed", F.lit(True)))
    around = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))

    def seen_from(px: Column, dy: Column, dx: Column) -> Column:
        """Codes inside the block of the tile that lies (dy, dx) tiles off."""
        def at(p: Column) -> tuple[Column, Column]:
            return F.floor(p / edge).cast("int") - dy * edge + halo, p % edge - dx * edge + halo

        inside = F.filter(px, lambda p: at(p)[0].between(0, wide - 1) & at(p)[1].between(0, wide - 1))
        return F.transform(inside, lambda p: at(p)[0] * wide + at(p)[1])

    def on_rim(p: Column) -> Column:
        x = p % edge
        return (p < halo * edge) | (p >= (edge - halo) * edge) | (x < halo) | (x >= edge - halo)

    whole = True
    while state.where("changed").limit(1).count():
        active = state.where("changed").select("image_id", "ty", "tx", around.alias("o")).select(
            F.col("image_id").alias("_image"), (F.col("ty") + F.col("o.dy")).alias("_ty"), (F.col("tx") + F.col("o.dx")).alias("_tx")).distinct()
        codes, none = seen_from(F.col("rim"), F.col("o.dy"), F.col("o.dx")), F.array().cast("array<int>")
        rims = state.withColumn("rim", F.filter("px", on_rim)).where(F.size("rim") > 0).select("*", around.alias("o")).where(
            "o.dy <> 0 OR o.dx <> 0").select("image_id", (F.col("ty") + F.col("o.dy")).alias("ty"), (F.col("tx") + F.col("o.dx")).alias("tx"),
                                             none.alias("px"), codes.alias("codes")).where(F.size("codes") > 0)
        sent = state.select(*TILE, "px", none.alias("codes")).unionByName(rims)
        if not whole:
            sent = sent.join(active, _same_tile(sent, active), "left_semi")
        blocks = sent.groupBy(*TILE).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("px", "codes")]).where(F.size("px") > 0)
        done = blocks.mapInPandas(_thin_tile(per_round, edge), shape)
        if not whole:
            rest = state.join(active, _same_tile(state, active), "left_anti").withColumn("changed", F.lit(False))
            done = rest.unionByName(done)
        state, whole = materialize(done), False
        yield state


def thin(points: DataFrame, per_round: int = 2, edge: int = EDGE) -> DataFrame:
    """Zhang-Suen thinning of all images at once, in rounds over the tiles that still change (see ``thinning_rounds``)."""
    last = None
    for last in thinning_rounds(points.select(*PIXEL), per_round, edge):
        pass
    if last is None:
        return points.select(*PIXEL).limit(0)
    at = last.select("image_id", "ty", "tx", F.explode("px").alias("p"))
    return at.select("image_id", (F.col("ty") * edge + F.floor(F.col("p") / edge)).cast("int").alias("y"),
                     (F.col("tx") * edge + F.col("p") % edge).cast("int").alias("x"))


def adjacency(points: DataFrame) -> DataFrame:
    """``(image_id, pid, nbrs)``: each pixel's at most eight neighbours as pixel ids."""
    votes = tile_votes(points, [(-dy, -dx) for dy, dx in NEIGHBOURS8] + [(0, 0)], keep=[pixel_id().alias("q")])
    around = votes.groupBy(*TILE, "y", "x").agg(F.collect_list("q").alias("q")).select(
        "image_id", pixel_id().alias("pid"), "q").where(F.array_contains("q", F.col("pid")))
    return around.select("image_id", "pid", F.array_sort(F.filter("q", lambda v: v != F.col("pid"))).alias("nbrs"))


def _walk_tiles(max_steps: int, edge: int) -> TileWork:
    around = [(dy << 32) + dx for dy, dx in NEIGHBOURS8]

    def walk(own: dict[str, np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, dict]:
        y, x = own["y"].astype("int64"), own["x"].astype("int64")
        codes, home = (y << 32) + x, (y // edge == own["ty"]) & (x // edge == own["tx"])
        tiles, begun, paths, stopped = [], [], [], []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(y)], strict=True):
            here = codes[lo:hi][home[lo:hi]].tolist()
            there = set(codes[lo:hi].tolist()) if here else ()
            for start in here:
                if sum(start + o in there for o in around) != 1:
                    continue
                path, seen, more = [start], {start}, True
                while more:
                    fresh = [q for o in around if (q := path[-1] + o) in there and q not in seen]
                    more = len(fresh) == 1
                    if len(path) == max_steps:
                        break
                    if more:
                        path += fresh
                        seen.add(fresh[0])
                tiles.append(lo)
                begun.append(start)
                paths.append(path)
                stopped.append(not more)
        return np.array(tiles, "int64"), {"start": begun, "path": paths, "stopped": stopped}
    return walk


def walk_branches(points: DataFrame, max_steps: int, edge: int = EDGE) -> DataFrame:
    """Walk from every endpoint while exactly one unvisited neighbour remains.

    Returns ``(image_id, start, path, stopped)``; ``path`` holds at most ``max_steps`` pixel ids. A walk never
    leaves the ``max_steps`` pixels around its start, so tiles with a halo of that width hold it whole: one
    shuffle of the pixels, whatever the length, and no task holds more than a tile.
    """
    key = points.schema["image_id"].dataType.simpleString()
    tiled = halo_copies(points.select(*PIXEL).distinct(), max_steps, edge)
    return map_tiles(tiled, _walk_tiles(max_steps, edge), f"image_id {key}, start bigint, path array<bigint>, stopped boolean")


def branch_lengths(points: DataFrame, max_steps: int = 100) -> DataFrame:
    """Pixels from each endpoint up to and including where the walk stops, at most ``max_steps``."""
    w = walk_branches(points, max_steps)
    return w.select("image_id", id_y(F.col("start")).alias("y"), id_x(F.col("start")).alias("x"),
                    F.size("path").alias("length"))


def prune(points: DataFrame, min_length: int = 10, rounds: int = 5) -> DataFrame:
    """Remove branches shorter than ``min_length``, up to ``rounds`` times.

    All short branches of a round are found on the same snapshot and removed together.
    """
    current = materialize(points.select(*PIXEL))
    for _ in range(rounds):
        paths = walk_branches(current, min_length).where(F.size("path") < min_length)
        gone = paths.select("image_id", F.explode("path").alias("p")).select(
            "image_id", id_y(F.col("p")).alias("y"), id_x(F.col("p")).alias("x")).distinct()
        gone = materialize(gone)
        if gone.isEmpty():
            break
        current = materialize(current.join(gone, PIXEL, "left_anti"))
    return current


def extract_centerline(mask: DataFrame, min_size: int = 50, min_length: int = 10, rounds: int = 5) -> DataFrame:
    """Mask points to centerline: drop small objects, thin, prune."""
    return prune(thin(remove_small(mask, min_size)), min_length, rounds)


def bridge_gaps(points: DataFrame, radius: int = 3, canvas: DataFrame | None = None) -> DataFrame:
    """Dilate by an ellipse, inside the image if its ``canvas`` is given, to close small gaps, then thin again."""
    return thin(dilate(points, ellipse_spans(2 * radius + 1), canvas))


def cl_dice(pred_mask: DataFrame, gt_mask: DataFrame, images: DataFrame) -> DataFrame:
    """Harmonic mean of the shares of each thinned mask that lies in the other mask."""
    bits = None
    for i, s in enumerate((pred_mask, gt_mask, thin(pred_mask), thin(gt_mask))):
        tagged = s.select(*PIXEL, F.lit(1 << i).alias("k"))
        bits = tagged if bits is None else bits.unionByName(tagged)
    k = bits.groupBy(*PIXEL).agg(F.bit_or("k").alias("k"))
    have = lambda m: F.count_if(F.col("k").bitwiseAND(m) == m)
    c = k.groupBy("image_id").agg(have(1).alias("p"), have(2).alias("g"), have(4).alias("sp"), have(8).alias("sg"),
                                  have(6).alias("sp_g"), have(9).alias("sg_p"))
    c = images.select("image_id").distinct().join(c, "image_id", "left").na.fill(0)
    prec, sens = F.col("sp_g") / F.greatest("sp", F.lit(1)), F.col("sg_p") / F.greatest("sg", F.lit(1))
    value = (F.when((F.col("p") == 0) & (F.col("g") == 0), F.lit(1.0))
             .when((F.col("p") == 0) | (F.col("g") == 0) | (F.col("sp") == 0) | (F.col("sg") == 0), F.lit(0.0))
             .when(prec + sens == 0, F.lit(0.0))
             .otherwise(2 * prec * sens / F.when(prec + sens > 0, prec + sens)))
    return c.select("image_id", value.alias("cldice"))


def cl_dice_from_probs(prob: DataFrame, gt_mask: DataFrame, images: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The same with the prediction given as a probability grid."""
    return cl_dice(threshold_at_least(prob, threshold), gt_mask, images)


def threshold_at_least(grid: DataFrame, threshold: float) -> DataFrame:
    return grid.where(F.col("v") >= threshold).select(*PIXEL)


def threshold_above(grid: DataFrame, threshold: float | Column) -> DataFrame:
    return grid.where(F.col("v") > threshold).select(*PIXEL)
