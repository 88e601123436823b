"""Replaying logged episodes: from positions to rewards, all episodes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pixtab.functions.lineage import materialize
from pixtab.operators import steplog


def judge_steps(steps: DataFrame, gt: DataFrame, canvas: DataFrame, half: int, tolerance: float, clip: float,
                fov: DataFrame | None = None, starts: DataFrame | None = None) -> DataFrame:
    """Validity, revisits, distance and off-track streak of every logged step; see ``reward_steps`` for ``starts``."""
    s = steplog.with_validity(steps, canvas, half, fov)
    s = materialize(steplog.with_distance(steplog.with_revisit(s, starts), gt, tolerance, clip))
    return steplog.with_streak(s)


def reward_steps(steps: DataFrame, gt: DataFrame, canvas: DataFrame, half: int, tolerance: float, clip: float,
                 max_streak: int, max_steps: int, fov: DataFrame | None = None, shaping: bool = True,
                 starts: DataFrame | None = None) -> DataFrame:
    """Rewards of all steps up to each episode's end.

    ``starts(episode, image_id, y, x)`` is where each episode began: it counts as visited, what lies around
    it as covered, and the first step comes from its distance.

    Ordered operators read their input twice (block totals, then rows), so the plan is cut where
    one feeds the next instead of being recomputed.
    """
    s = materialize(judge_steps(steps, gt, canvas, half, tolerance, clip, fov, starts))
    s = materialize(steplog.upto_end(s, steplog.episode_ends(s, max_streak, max_steps)))
    s = materialize(steplog.with_coverage(s, gt, tolerance, starts))
    began = None if starts is None else steplog.with_distance(starts, gt, tolerance, clip)
    return steplog.with_end_reward(steplog.with_step_reward(s, tolerance, shaping=shaping, starts=began))
