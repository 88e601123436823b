"""What the tracing environment computes along a trajectory, as column and window work on step logs.

Tables: ``steps(episode, step INT, action, y, x[, image_id])``; ``step`` counts 0, 1, 2, … per episode.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixtab.functions.keys import salted_join
from pixtab.functions.offsets import disk, spread
from pixtab.functions.scan import neighbour, running
from pixtab.functions.strips import EDGE, TILE, halo_tiles, with_membership
from pixtab.operators.distance import visited_d2

STOP = 8
# fixed values: (dy, dx) of actions 0..7 = N, NE, E, SE, S, SW, W, NW
DIRECTIONS = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
PIXEL = ["image_id", "y", "x"]


def _pick(values: Sequence[int], index: Column, default: int) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(v) for v in values]), index.cast("int")), F.lit(default))


def move_dy(action: Column) -> Column:
    return _pick([dy for dy, _ in DIRECTIONS], action, 0)


def move_dx(action: Column) -> Column:
    return _pick([dx for _, dx in DIRECTIONS], action, 0)


def action_of(dy: Column, dx: Column) -> Column:
    """Action of a unit step; any other step is STOP."""
    out = F.lit(STOP)
    for a, (my, mx) in enumerate(DIRECTIONS):
        out = F.when((dy == my) & (dx == mx), F.lit(a)).otherwise(out)
    return out


def replay_positions(actions: DataFrame, starts: DataFrame, step_size: int = 1) -> DataFrame:
    """Position after each action: start plus the running sum of moves."""
    moved = running(actions, ["episode"], "step", {
        "_dy": ("sum", move_dy(F.col("action")) * step_size), "_dx": ("sum", move_dx(F.col("action")) * step_size)})
    first = starts.select("episode", F.col("y").alias("_y0"), F.col("x").alias("_x0"))
    out = salted_join(moved, first, ["episode"], by=("step",))
    return (out.withColumn("y", (F.col("_y0") + F.col("_dy")).cast("int"))
            .withColumn("x", (F.col("_x0") + F.col("_dx")).cast("int")).drop("_dy", "_dx", "_y0", "_x0"))


def with_validity(steps: DataFrame, canvas: DataFrame, half: int, fov: DataFrame | None = None) -> DataFrame:
    """``is_valid``: the whole patch lies in the image and the position in the field of view."""
    out = salted_join(steps, canvas.select("image_id", "h", "w"), ["image_id"], how="left", by=("step",))
    ok = F.col("y").between(half, F.col("h") - half - 1) & F.col("x").between(half, F.col("w") - half - 1)
    if fov is not None:
        # masks are dense: they are packed into blocks before the shuffle
        out = with_membership(out, fov, "_in")
        ok = ok & F.col("_in")
    return out.withColumn("is_valid", F.coalesce(ok, F.lit(False))).drop("h", "w", "_in")


def with_revisit(steps: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """``is_revisit``: the episode was at this pixel before; ``starts(episode, y, x)`` is where it began, as step -1."""
    seen = steps.select("episode", "y", "x", "step")
    if starts is not None:
        seen = seen.unionByName(starts.select("episode", "y", "x", F.lit(-1).alias("step")))
    first = seen.groupBy("episode", "y", "x").agg(F.min("step").alias("_first"))
    return (steps.join(first, ["episode", "y", "x"])
            .withColumn("is_revisit", F.col("step") > F.col("_first")).drop("_first"))


def with_distance(steps: DataFrame, gt: DataFrame, tolerance: float, clip: float) -> DataFrame:
    """``distance`` to the annotation clipped at ``clip``, and ``on_track`` (within ``tolerance``)."""
    near = visited_d2(steps, gt, clip)
    d = F.coalesce(F.least(F.sqrt(F.col("d2").cast("double")), F.lit(float(clip))), F.lit(float(clip)))
    return (steps.join(near, PIXEL, "left").withColumn("distance", d).drop("d2")
            .withColumn("on_track", F.col("distance") <= tolerance))


def with_streak(steps: DataFrame) -> DataFrame:
    """``streak``: consecutive off-track steps up to and including this one."""
    last_on = F.when(F.col("on_track"), F.col("step"))
    out = running(steps, ["episode"], "step", {"_on": ("max", last_on)})
    return out.withColumn("streak", (F.col("step") - F.coalesce("_on", F.lit(-1))).cast("int")).drop("_on")


def episode_ends(steps: DataFrame, max_streak: int, max_steps: int) -> DataFrame:
    """First step that ends each episode and why; ``end_step`` is null when the log just stops."""
    reason = (F.when(F.col("action") == STOP, "stop").when(~F.col("is_valid"), "out_of_bounds")
              .when(F.col("streak") >= max_streak, "off_track").when(F.col("step") + 1 >= max_steps, "truncated"))
    out = steps.withColumn("_r", reason)
    first = F.min_by(F.when(F.col("_r").isNotNull(), F.struct("step", "_r")),
                     F.when(F.col("_r").isNotNull(), F.col("step")))
    return (out.groupBy("episode").agg(first.alias("_e"))
            .select("episode", F.col("_e.step").alias("end_step"), F.col("_e._r").alias("reason")))


def upto_end(steps: DataFrame, ends: DataFrame) -> DataFrame:
    """Drop steps after each episode's end; the ending step keeps its ``reason``."""
    out = salted_join(steps, ends, ["episode"], by=("step",))
    return (out.where(F.col("end_step").isNull() | (F.col("step") <= F.col("end_step")))
            .withColumn("reason", F.when(F.col("step") == F.col("end_step"), F.col("reason"))).drop("end_step"))


def _reached(radius: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per row ``(episode, y, x, step, gy, gx)``: how many of the pixels ``(gy, gx)`` each step is the first to come near."""
    offs, halo = disk(radius), int(radius)
    never = np.iinfo("int64").max

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names, steps, counts = [], [np.empty(0, "int64")], [np.empty(0, "int64")]
            for episode, y, x, step, gy, gx in pdf.itertuples(index=False):
                y0, x0 = y.min() - 2 * halo, x.min() - 2 * halo
                block = np.full((y.max() - y0 + 2 * halo + 1, x.max() - x0 + 2 * halo + 1), never)
                block[y - y0, x - x0] = step
                gy, gx = gy - y0, gx - x0
                near = (gy >= halo) & (gx >= halo) & (gy < block.shape[0] - halo) & (gx < block.shape[1] - halo)
                gy, gx = gy[near], gx[near]
                first = np.full(len(gy), never)
                for dy, dx in offs:
                    np.minimum(first, block[gy + dy, gx + dx], out=first)
                own, n = np.unique(first[first < never], return_counts=True)
                names += [episode] * len(own)
                steps.append(own)
                counts.append(n)
            yield pd.DataFrame({"episode": pd.Series(names, dtype=object), "step": np.concatenate(steps), "n": np.concatenate(counts)})
    return count


def first_reached(seen: DataFrame, gt: DataFrame, tolerance: float, edge: int = EDGE) -> DataFrame:
    """``(episode, step, new_coverage)``: annotated pixels that no earlier step of the episode came within ``tolerance`` of.

    ``seen`` has the first visit of each pixel. Visits go to their tile, with halo copies, once, as one row per episode and tile; annotated
    pixels are one row per tile. Both are bounded by the tile, and the disk is only looked up inside it.
    """
    kind, order = seen.schema["episode"].dataType.simpleString(), seen.schema["step"].dataType.simpleString()
    visits = halo_tiles(seen, int(tolerance), edge).groupBy("episode", *TILE).agg(F.collect_list(F.struct("y", "x", "step")).alias("seen"))
    there = gt.select(*PIXEL).distinct().groupBy("image_id", F.floor(F.col("y") / edge).cast("int").alias("ty"), F.floor(F.col("x") / edge).cast("int").alias("tx")).agg(
        F.collect_list(F.struct("y", "x")).alias("there"))
    counted = visits.join(there, TILE).select(
        "episode", "seen.y", "seen.x", "seen.step", F.col("there.y").alias("gy"), F.col("there.x").alias("gx")).mapInPandas(
        _reached(tolerance), f"episode {kind}, step {order}, n bigint")
    return counted.groupBy("episode", "step").agg(F.sum("n").alias("new_coverage"))


def with_coverage(steps: DataFrame, gt: DataFrame, tolerance: float, starts: DataFrame | None = None) -> DataFrame:
    """``new_coverage`` (annotated pixels first reached by this step), ``covered`` and ``coverage_ratio``.

    Steps that stop, or are out of bounds (where ``is_valid`` is known), do not move and cover nothing.
    What lies around ``starts(episode, image_id, y, x)`` is covered before the first step. Only the first
    visit of a pixel can cover anything, so positions are reduced to it; they are spread over the disk inside tiles (``first_reached``).
    """
    moves = steps.where(F.col("action") != STOP) if "action" in steps.columns else steps
    moves = moves.where("is_valid") if "is_valid" in steps.columns else moves
    moves = moves.select("episode", "image_id", "y", "x", "step")
    if starts is not None:
        moves = moves.unionByName(starts.select("episode", "image_id", "y", "x", F.lit(-1).alias("step")))
    seen = moves.groupBy("episode", "image_id", "y", "x").agg(F.min("step").alias("step"))
    gained = first_reached(seen, gt, tolerance)
    out = steps.join(gained, ["episode", "step"], "left").na.fill(0, ["new_coverage"])
    out = running(out, ["episode"], "step", {"covered": ("sum", F.col("new_coverage"))})
    if starts is not None:
        before = gained.where("step = -1").select("episode", F.col("new_coverage").alias("_before"))
        out = salted_join(out, before, ["episode"], how="left", by=("step",))
        out = out.withColumn("covered", F.col("covered") + F.coalesce("_before", F.lit(0))).drop("_before")
    total = gt.groupBy("image_id").agg(F.count(F.lit(1)).alias("_total"))
    out = salted_join(out, total, ["image_id"], how="left", by=("step",))
    ratio = F.col("covered") / F.greatest(F.coalesce("_total", F.lit(0)), F.lit(1))
    return out.withColumn("coverage_ratio", ratio).withColumnRenamed("_total", "total").na.fill(0, ["total"])


# fixed values: the rewards' default weights
def with_step_reward(steps: DataFrame, tolerance: float, near: float = 1.0, coverage: float = 2.0,
                     off: float = -1.0, revisit: float = -0.5, step_cost: float = -0.01,
                     shaping: bool = True, gamma: float = 0.99, starts: DataFrame | None = None) -> DataFrame:
    """Reward of each in-episode step.

    The first step comes from ``starts(episode, distance)``; without it, from the same distance.
    """
    out = steps
    d = F.col("distance")
    reward = (F.when(~F.col("is_revisit"), near * F.greatest(F.lit(0.0), 1.0 - d / tolerance)).otherwise(F.lit(revisit))
              + F.when(F.col("new_coverage") > 0, coverage * F.col("new_coverage")).otherwise(F.lit(0.0))
              + F.when(F.col("on_track"), F.lit(0.0)).otherwise(F.lit(off)) + F.lit(step_cost))
    if shaping:
        out = neighbour(out, ["episode"], "step", {"_prev": "distance"})
        if starts is not None:
            began = starts.select("episode", F.col("distance").alias("_began"))
            out = salted_join(out, began, ["episode"], how="left", by=("step",))
        else:
            out = out.withColumn("_began", F.lit(None).cast("double"))
        reward = reward + (F.coalesce("_prev", "_began", d) - gamma * d)
    return out.withColumn("reward", reward).drop("_prev", "_began")


# fixed values: the default weights at an episode's end
def with_end_reward(steps: DataFrame, weight: float = 10.0, out_of_bounds: float = -10.0,
                    off_track: float = -5.0) -> DataFrame:
    """Apply the ending rules: STOP pays the covered F1, leaving the image and losing the track cost."""
    recall = F.col("covered") / F.greatest("total", F.lit(1))
    precision = F.when(F.col("covered") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall + F.when(
        precision + recall > 0, F.lit(0.0)).otherwise(F.lit(1.0)))).otherwise(F.lit(0.0))
    return steps.withColumn("reward", F.when(F.col("reason") == "stop", weight * f1)
                            .when(F.col("reason") == "out_of_bounds", F.lit(out_of_bounds))
                            .when(F.col("reason") == "off_track", F.col("reward") + off_track)
                            .otherwise(F.col("reward")))


def clip_reward(reward: Column, bound: float = 1.0) -> Column:
    return F.least(F.greatest(reward, F.lit(-bound)), F.lit(bound))


def episode_returns(steps: DataFrame) -> DataFrame:
    """Undiscounted return and length per episode."""
    return steps.groupBy("episode").agg(F.sum("reward").alias("return"), F.count(F.lit(1)).alias("length"))


def evaluation_means(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean coverage and F1 of evaluation episodes; 0 for none."""
    return results.groupBy(*by).agg(*[
        F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in ("coverage", "f1")])


def coverage_by_trace(visits: DataFrame, gt: DataFrame) -> DataFrame:
    """``gain`` and cumulative ``coverage`` of each trace: pixels it is the first to visit, over the total."""
    first = visits.groupBy(*PIXEL).agg(F.min("trace_id").alias("trace_id"))
    fresh = first.groupBy("image_id", "trace_id").agg(F.count(F.lit(1)).alias("_n"))
    every = visits.select("image_id", "trace_id").distinct()
    total = gt.groupBy("image_id").agg(F.count(F.lit(1)).alias("_total"))
    out = every.join(fresh, ["image_id", "trace_id"], "left").na.fill(0, ["_n"])
    out = running(out, ["image_id"], "trace_id", {"_sum": ("sum", F.col("_n"))})
    out = salted_join(out, total, ["image_id"], how="left", by=("trace_id",))
    whole = F.greatest(F.coalesce("_total", F.lit(0)), F.lit(1))
    return out.select("image_id", "trace_id", (F.col("_n") / whole).alias("gain"),
                      (F.col("_sum") / whole).alias("coverage"))


def early_stop(gains: DataFrame, min_gain: float, warmup: int = 3) -> DataFrame:
    """Keep traces up to the first one, from index ``warmup`` on, that gains too little."""
    low = F.when((F.col("trace_id") >= warmup) & (F.col("gain") < min_gain), F.col("trace_id"))
    cut = gains.groupBy("image_id").agg(F.min(low).alias("_cut"))
    out = salted_join(gains, cut, ["image_id"], by=("trace_id",))
    return out.where(F.col("_cut").isNull() | (F.col("trace_id") <= F.col("_cut"))).drop("_cut")


def covered_pixels(visits: DataFrame) -> DataFrame:
    """Union of all traces of an image."""
    return visits.select(*PIXEL).distinct()


def without_repeats(visits: DataFrame, order: str = "seq") -> DataFrame:
    """Drop a visit that repeats the position before it in its trace (STOP and blocked moves log one)."""
    keys = ["image_id", "trace_id"]
    out = neighbour(visits, keys, order, {"_py": "y", "_px": "x"})
    return out.where(F.col("_py").isNull() | (F.col("_py") != F.col("y")) | (F.col("_px") != F.col("x"))).drop("_py", "_px")
