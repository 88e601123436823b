"""Ridge linking: every pixel points to its best neighbour, and linked groups with a seed survive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixtab.functions.keys import pixel_id, salted_join
from pixtab.functions.lineage import materialize
from pixtab.functions.offsets import NEIGHBOURS8
from pixtab.functions.strips import TILE, tile_votes
from pixtab.operators.components import label_links

PIXEL = ["image_id", "y", "x"]


def best_links(grid: DataFrame, step_thresh: float) -> DataFrame:
    """``(image_id, y, x, v, to, top)``: best 8-neighbour above the threshold (ties: smallest y, x)."""
    live = grid.where(F.col("v") > step_thresh)
    votes = tile_votes(live, [*NEIGHBOURS8, (0, 0)], [0] * 8 + [1], keep=["v", (-pixel_id()).alias("neg")])
    own = F.col("k") == 1
    met = votes.groupBy(*TILE, "y", "x").agg(F.max(F.when(own, F.col("v"))).alias("v"),
                                             F.max(F.when(~own, F.struct("v", "neg"))).alias("nb"))
    return met.where("v IS NOT NULL").select(*PIXEL, "v", (-F.col("nb.neg")).alias("to"), F.col("nb.v").alias("top"))


def link_ridges(grid: DataFrame, seed_thresh: float = 0.15, step_thresh: float = 0.08, min_length: int = 10,
                fov: DataFrame | None = None) -> DataFrame:
    """Pixels ``(image_id, y, x, label)`` of groups that hold a strong local maximum and enough pixels.

    The sequential walk depends on visiting order; this form does not, so the two differ in detail.
    """
    inside = grid if fov is None else grid.join(fov.select(*PIXEL), PIXEL, "left_semi")
    links = materialize(best_links(inside, step_thresh))
    found = label_links(links)
    seeds = links.where((F.col("v") >= seed_thresh) & (F.col("top").isNull() | (F.col("v") >= F.col("top")))).select(*PIXEL)
    seeded = found.pixels.join(seeds, PIXEL, "left_semi").select("image_id", "piece").distinct().withColumn("_s", F.lit(1))
    pieces = found.pieces.join(seeded, ["image_id", "piece"], "left")
    good = (pieces.groupBy("image_id", "label").agg(F.sum("n").alias("n"), F.max("_s").alias("s"))
            .where((F.col("n") >= min_length) & F.col("s").isNotNull()).select("image_id", "label"))
    kept = salted_join(found.pieces, good, ["image_id", "label"], by=("piece",))
    return found.pixels.join(kept.select("image_id", "piece", "label"), ["image_id", "piece"]).select(*PIXEL, "label")
