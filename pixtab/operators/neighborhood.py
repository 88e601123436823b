"""Neighbour counts, endpoints and junctions of point sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixtab.functions.offsets import NEIGHBOURS4, NEIGHBOURS8
from pixtab.functions.strips import TILE, tile_votes

_SELF = 16  # larger than any neighbour count


def neighbour_counts(points: DataFrame, diagonal: bool = True) -> DataFrame:
    """``(image_id, y, x, n)``: points next to each point, 0 when isolated. One shuffle of the points, no join."""
    ring = NEIGHBOURS8 if diagonal else NEIGHBOURS4
    votes = tile_votes(points, [*ring, (0, 0)], [1] * len(ring) + [_SELF])
    total = votes.groupBy(*TILE, "y", "x").agg(F.sum("k").alias("s"))
    return total.where(F.col("s") >= _SELF).select("image_id", "y", "x", (F.col("s") - _SELF).cast("int").alias("n"))


def endpoints(points: DataFrame) -> DataFrame:
    """Points with exactly one neighbour."""
    return neighbour_counts(points).where("n = 1").drop("n")


def junctions(points: DataFrame) -> DataFrame:
    """Points with more than two neighbours."""
    return neighbour_counts(points).where("n > 2").drop("n")


def special_points(points: DataFrame) -> DataFrame:
    """Endpoints and junctions with their ``type``."""
    kind = F.when(F.col("n") == 1, "endpoint").otherwise("junction")
    return (neighbour_counts(points).where("n = 1 OR n > 2")
            .select("image_id", "y", "x", kind.alias("type")))


def special_counts(points: DataFrame) -> DataFrame:
    """Endpoints, junctions and their sum (the seeds) per image."""
    n = neighbour_counts(points)
    return n.groupBy("image_id").agg(
        F.count_if(F.col("n") == 1).alias("endpoints"),
        F.count_if(F.col("n") > 2).alias("junctions"),
        F.count_if((F.col("n") == 1) | (F.col("n") > 2)).alias("seeds"))
