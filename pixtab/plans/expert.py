"""Annotated masks to expert (position, action) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pixtab.functions.lineage import materialize
from pixtab.operators import augment, graph, splits, thinning


def expert_rows(mask: DataFrame, canvas: DataFrame, half: int, min_size: int = 50, min_branch: int = 10,
                train_share: float = 0.9) -> DataFrame:
    """Centerline, graph, traces and their legal moves, split by position into train and val."""
    line = thinning.extract_centerline(mask, min_size, min_branch)
    _, traces = graph.expert_traces(line)
    pairs = augment.expert_pairs(materialize(traces), canvas, half)
    return splits.head_tail(pairs, ["image_id", "order"], train_share)
