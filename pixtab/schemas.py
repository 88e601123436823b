"""Table schemas, checked where tables enter from outside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

REGISTRY = T.StructType([T.StructField(n, T.StringType(), n not in ("name", "image_dir", "vessel_dir", "image_glob", "vessel_suffix"))
                         for n in ("name", "image_dir", "vessel_dir", "image_glob", "vessel_suffix",
                                   "mask_dir", "mask_suffix", "stem_rule", "train_subdir", "test_subdir")])

COLUMNS = {
    "points": ("image_id", "y", "x"),
    "grid": ("image_id", "y", "x", "v"),
    "px": ("image_id", "y", "x", "r", "g", "b"),
    "canvas": ("image_id", "h", "w"),
    "traces": ("image_id", "trace_id", "seq", "y", "x"),
    "seeds": ("image_id", "rank", "y", "x", "confidence"),
    "steps": ("episode", "step", "action", "y", "x"),
}


def require(df: DataFrame, table: str) -> DataFrame:
    """Fail early when a table lacks columns."""
    missing = [c for c in COLUMNS[table] if c not in df.columns]
    if missing:
        raise ValueError(f"{table} table lacks {missing}")
    return df
