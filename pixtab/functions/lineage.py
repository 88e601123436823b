"""Cutting lineage for iterative operators with reliable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; make one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="pixtab-checkpoint-")
    sc.setCheckpointDir(folder)


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, and later plans start from files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
