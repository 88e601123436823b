"""Queries over the shared tables, each next to the SQL it must agree with."""

import importlib

MODULES = ("q_metrics", "q_steplog", "q_samples", "q_shapes", "q_grids", "q_fields")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"checks.{name}")
