"""Splits, filters and start selection. Ranks are distributed, so one dataset may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixtab.functions import draws
from pixtab.functions.keys import first_of_each, ranked, salted_join
from pixtab.operators.neighborhood import endpoints


def _part(share: Column) -> Column:
    """Truncate like ``int()``; counts are exact in doubles."""
    return F.floor(share).cast("bigint")


def three_way(manifest: DataFrame, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15),
              by: str = "dataset", order: str = "image_id") -> DataFrame:
    """``split`` by position in id order: the first ``int(r0 n)``, up to ``int((r0 + r1) n)``, the rest."""
    r = ranked(manifest, [by], [order], "_rn", total="_n")
    n = F.col("_n").cast("double")
    t, v = _part(F.lit(float(ratios[0])) * n), _part(F.lit(float(ratios[0]) + float(ratios[1])) * n)
    split = F.when(F.col("_rn") <= t, "train").when(F.col("_rn") <= v, "val").otherwise("test")
    return r.withColumn("split", split).drop("_rn", "_n")


def train_val(manifest: DataFrame, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15),
              by: str = "dataset", order: str = "image_id") -> DataFrame:
    """Two-way split with the first two ratios renormalised, at least one sample on each side."""
    r = ranked(manifest, [by], [order], "_rn", total="_n")
    share = F.lit(ratios[0] / (ratios[0] + ratios[1])) * F.col("_n").cast("double")
    t = F.greatest(F.lit(1), F.least(_part(share), F.col("_n") - 1))
    return r.withColumn("split", F.when(F.col("_rn") <= t, "train").otherwise("val")).drop("_rn", "_n")


def official_test(samples: DataFrame, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """Samples of the official test part; datasets without any use the test slice of the rest."""
    tests = samples.where("part = 'test'")
    have = tests.select("dataset").distinct()
    slice_ = three_way(samples.where("part <> 'test'"), ratios).where("split = 'test'").drop("split")
    return tests.unionByName(salted_join(slice_, have, ["dataset"], "left_anti", by=("image_id",)))


def by_ranges(manifest: DataFrame, ranges: Mapping[str, tuple[int, int]], number: Column) -> DataFrame:
    """``split`` from fixed id ranges (inclusive); other ids drop out."""
    split = F.lit(None).cast("string")
    for name, (lo, hi) in ranges.items():
        split = F.when(number.between(lo, hi), name).otherwise(split)
    return manifest.withColumn("split", split).where(F.col("split").isNotNull())


def head_tail(rows: DataFrame, order: Sequence[str], share: float = 0.9) -> DataFrame:
    """First ``int(share n)`` rows as ``train``, the rest as ``val``."""
    r = ranked(rows, [], order, "_rn", total="_n")
    t = _part(F.lit(float(share)) * F.col("_n").cast("double"))
    return r.withColumn("split", F.when(F.col("_rn") <= t, "train").otherwise("val")).drop("_rn", "_n")


def by_difficulty(samples: DataFrame, difficulty: Column, limit: float, order: str = "image_id",
                  by: str = "dataset", least: int = 10) -> DataFrame:
    """Samples up to ``limit``; where fewer than ``least`` remain, the first ``least`` of all instead."""
    tagged = samples.withColumn("_ok", difficulty <= limit)
    counts = tagged.groupBy(by).agg((F.count_if("_ok") >= least).alias("_enough"))
    passing = salted_join(tagged.where("_ok"), counts.where("_enough"), [by], by=(order,))
    first = first_of_each(tagged, [by], [order], least, "_rn").drop("_rn")
    few = salted_join(first, counts.where("NOT _enough"), [by], by=(order,))
    return passing.unionByName(few).drop("_ok", "_enough")


def existing_only(manifest: DataFrame, scanned: DataFrame, key: str = "image_id") -> DataFrame:
    """Keep entries whose id the scan has found."""
    return manifest.join(scanned.select(key).distinct(), key, "left_semi")


def start_positions(centerline: DataFrame, fov: DataFrame, canvas: DataFrame, seed: int | None = None) -> DataFrame:
    """One start per image: an endpoint, else a centerline pixel, else a field-of-view pixel, else the centre.

    The choice within the best class is the smallest seeded hash, or the first (y, x) without a
    seed. One aggregation per image, partial before the shuffle.
    """
    ends = endpoints(centerline).withColumn("k", F.lit(0))
    cand = (ends.unionByName(centerline.select("image_id", "y", "x", F.lit(1).alias("k")))
            .unionByName(fov.select("image_id", "y", "x", F.lit(2).alias("k"))))
    draw = F.lit("") if seed is None else draws.draw(seed, "image_id", "y", "x")
    best = cand.groupBy("image_id").agg(F.min(F.struct("k", draw.alias("draw"), "y", "x")).alias("b"))
    return (canvas.join(best, "image_id", "left").select(
        "image_id", F.coalesce("b.y", F.floor(F.col("h") / 2).cast("int")).alias("y"),
        F.coalesce("b.x", F.floor(F.col("w") / 2).cast("int")).alias("x")))
