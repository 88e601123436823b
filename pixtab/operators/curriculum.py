"""Difficulty schedules, stage advancement and sample difficulty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixtab.functions.keys import salted_join
from pixtab.functions.lineage import materialize
from pixtab.functions.scan import running
from pixtab.operators.neighborhood import special_counts

# fixed values: (name, difficulty, success rate needed, episodes needed)
STAGES = [
    ("large_vessels", 0.2, 0.7, 100),
    ("medium_vessels", 0.4, 0.6, 200),
    ("small_vessels", 0.6, 0.5, 300),
    ("capillaries", 0.8, 0.4, 400),
    ("full_difficulty", 1.0, 0.3, 500),
]


def warmup_difficulty(count: Column, start: float, end: float, warmup: int) -> Column:
    """Difficulty after ``count`` steps: linear, then ``end``."""
    return F.when(count < warmup, start + count / float(warmup) * (end - start)).otherwise(F.lit(end))


def stage_history(episodes: DataFrame, stages: Sequence[tuple[str, float, float, int]] = STAGES) -> DataFrame:
    """Add ``stage`` (index after the episode) to ``(run, idx 0,1,2,…, success 0/1)``.

    A stage ends at the first episode where enough episodes have passed since it began and their
    success rate is high enough. With running success counts that is one filtered ``min`` per
    stage over all runs at once, so no run is folded in a single task.
    """
    counted = materialize(running(episodes, ["run"], "idx", {"_s": ("sum", F.col("success"))}))
    begin = counted.select("run").distinct().select("run", F.lit(-1).alias("_i0"), F.lit(0).cast("long").alias("_s0"))
    reached = None
    for _, _, rate, need in stages[:-1]:
        n = F.col("idx") - F.col("_i0")
        done = (n >= need) & ((F.col("_s") - F.col("_s0")) / F.greatest(n, F.lit(1)) >= rate)
        begin = materialize(
            salted_join(counted, begin, ["run"], by=("idx",)).where(done)
            .groupBy("run").agg(F.min(F.struct("idx", "_s")).alias("_e"))
            .select("run", F.col("_e.idx").alias("_i0"), F.col("_e._s").alias("_s0")))
        ends = begin.select("run", F.col("_i0").alias("at"))
        reached = ends if reached is None else reached.unionByName(ends)
    if reached is None:
        return counted.drop("_s").withColumn("stage", F.lit(0))
    ends = reached.groupBy("run").agg(F.collect_list("at").alias("_ends"))  # at most one entry per stage
    out = salted_join(counted, ends, ["run"], how="left", by=("idx",))
    passed = F.size(F.filter(F.coalesce("_ends", F.array().cast("array<int>")), lambda a: a <= F.col("idx")))
    return out.withColumn("stage", passed).drop("_s", "_ends")


def sample_difficulty(centerline: DataFrame, mask: DataFrame, canvas: DataFrame) -> DataFrame:
    """0.4 thinness + 0.3 junction density + 0.3 sparseness, each in [0, 1]."""
    c = centerline.groupBy("image_id").agg(F.count(F.lit(1)).alias("c"))
    v = mask.groupBy("image_id").agg(F.count(F.lit(1)).alias("v"))
    j = special_counts(centerline).select("image_id", "junctions")
    t = (canvas.join(c, "image_id", "left").join(v, "image_id", "left").join(j, "image_id", "left")
         .na.fill(0, ["c", "v", "junctions"]))
    width = F.when(F.col("c") > 0, F.col("v") / F.greatest("c", F.lit(1))).otherwise(F.lit(1.0))
    thin = 1.0 - F.least(width / 10.0, F.lit(1.0))
    joint = F.least(F.col("junctions") / F.greatest("c", F.lit(1)) * 1000 / 10.0, F.lit(1.0))
    sparse = 1.0 - F.least(F.col("v") / (F.col("h") * F.col("w")) * 20, F.lit(1.0))
    return t.select("image_id", (0.4 * thin + 0.3 * joint + 0.3 * sparse).alias("difficulty"))
