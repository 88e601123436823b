"""Step streams: running episode returns and curriculum stages."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pixtab.functions.lineage import ensure_checkpoint_dir
from pixtab.operators.curriculum import STAGES


def stream_folder(spark: SparkSession) -> str:
    """A fresh folder next to the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def read_log(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A parquet log as a stream, with the schema of the files already there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_returns(steps: DataFrame) -> DataFrame:
    """Return and length per episode so far; the state is one sum and one count per episode."""
    return steps.groupBy("episode").agg(F.sum("reward").alias("return"), F.count(F.lit(1)).alias("length"))


def drain(stream: DataFrame, key: Sequence[str], mode: str = "update") -> DataFrame:
    """Run a stream over what is available and return the last row of every key.

    Each micro-batch overwrites its own folder, so a retried batch leaves no duplicates.
    """
    spark = stream.sparkSession
    folder = stream_folder(spark)

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/b={number}")

    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state")
         .trigger(availableNow=True).foreachBatch(save).start())
    q.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    value = [c for c in stream.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*value), "_batch").alias("_r"))
    return last.select(*key, *[F.col(f"_r.{c}").alias(c) for c in value])


def stage_states(episodes: DataFrame, stages: Sequence[tuple[str, float, float, int]] = STAGES) -> DataFrame:
    """Stage, episodes and successes of every ``run`` after each micro-batch of ``(run, idx, success)``.

    Episodes of a run must arrive in order across micro-batches, which is checked; inside one they are sorted.
    Of a micro-batch only the numbers and outcomes of a run's episodes are held.
    """
    rules = [(rate, need) for _, _, rate, need in stages]

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stage, seen, won, last = state.get if state.exists else (0, 0, 0, None)
        # one micro-batch of one run: bounded by maxFilesPerTrigger
        parts = [(b["idx"].to_numpy("int64"), b["success"].to_numpy()) for b in batches]
        idx = np.concatenate([i for i, _ in parts])
        order = np.argsort(idx, kind="stable")
        ok = np.concatenate([s for _, s in parts])[order]
        if last is not None and idx[order[0]] <= last:
            raise ValueError(f"run {key[0]}: episode {idx[order[0]]} came after episode {last}")
        last = int(idx[order[-1]])
        while len(ok):
            n, w = seen + np.arange(1, len(ok) + 1), won + np.cumsum(ok)
            done = np.flatnonzero((n >= rules[stage][1]) & (w / n >= rules[stage][0])) if stage < len(rules) - 1 else []
            if len(done) == 0:
                seen, won = int(n[-1]), int(w[-1])
                break
            stage, seen, won, ok = stage + 1, 0, 0, ok[done[0] + 1:]
        state.update((stage, seen, won, last))
        yield pd.DataFrame({"run": [key[0]], "stage": [stage], "episodes": [seen], "successes": [won]})

    kind = episodes.schema["run"].dataType.simpleString()
    return episodes.groupBy("run").applyInPandasWithState(
        advance, f"run {kind}, stage int, episodes bigint, successes bigint",
        "stage int, episodes bigint, successes bigint, last bigint", "update", GroupStateTimeout.NoTimeout)
