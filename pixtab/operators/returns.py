"""Advantages, returns and training-log arithmetic on rollout tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pixtab.functions.keys import salted_join
from pixtab.functions.lineage import materialize
from pixtab.functions.scan import running

def _links(gamma: float, decay: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per sorted batch of rows ``(_run, reward, value, done)``: each row's advantage as ``_head + _a * A + _b * v``.

    A and v are the advantage and the value of the step after the run's last one here, which another partition holds. The rows come
    from the last step back; such maps compose associatively, so one of them is all that is carried on from batch to batch.
    """
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, head, a, b, after = None, 0.0, 1.0, 0.0, None
        for pdf in batches:
            out = np.empty((3, len(pdf)))
            rows = zip(pdf["_run"].tolist(), pdf["reward"].tolist(), pdf["value"].tolist(), pdf["done"].tolist(), strict=True)
            for i, (name, reward, value, done) in enumerate(rows):
                alive = 1.0 - done
                if name != run:
                    run, head, a, b = name, reward - value, decay * alive, gamma * alive
                else:
                    k = decay * alive
                    head, a, b = reward + gamma * after * alive - value + k * head, k * a, k * b
                after = value
                out[0, i], out[1, i], out[2, i] = head, a, b
            pdf["_head"], pdf["_a"], pdf["_b"] = out
            yield pdf
    return scan


def _incoming(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What comes into each partition of a rollout from the partitions before it, which hold later steps; rows in that order."""
    run, now, after = None, 0.0, 0.0
    for pdf in batches:
        into = np.zeros((2, len(pdf)))
        rows = zip(*(pdf[c].tolist() for c in ("_run", "_head", "_a", "_b", "_v", "last_value")), strict=True)
        for i, (name, head, a, b, value, last) in enumerate(rows):
            if name != run:
                run, now, after = name, 0.0, last
            into[:, i] = now, after
            now, after = head + a * now + b * after, value
        yield pdf.drop(columns=["_head", "_a", "_b", "_v", "last_value"]).assign(_in=into[0], _after=into[1])


def advantages(rollout: DataFrame, keys: Sequence[str], order: str = "step", gamma: float = 0.99,
               lam: float = 0.95, bootstrap: DataFrame | None = None) -> DataFrame:
    """Generalised advantage estimates and returns (``reward, value, done`` -> ``advantage, ret``).

    ``A_t = delta_t + gamma * lam * (1 - done_t) * A_{t+1}`` is a suffix scan of affine maps, which compose associatively. Steps are
    range-partitioned by (keys, order), so a long rollout spans many partitions; each is scanned once from its last step back, with one
    map carried along. A second pass over one map per rollout and partition tells what comes into each
    partition. Nothing is collected per rollout. ``bootstrap(keys, last_value)`` gives the value after the last step, 0 when missing.
    """
    keys = list(keys)
    back = [*keys, F.desc(order)]
    laid = (rollout.withColumns({c: F.col(c).cast("double") for c in ("reward", "value")}).repartitionByRange(*back).sortWithinPartitions(*back)
            .withColumn("_pos", F.monotonically_increasing_id()).withColumn("_run", F.xxhash64(*keys)))
    wide = StructType([*laid.schema, *StructType.fromDDL("_head double, _a double, _b double")])
    # Stored, because range bounds are sampled: the place of a row must be the same each time.
    scanned = materialize(laid.mapInPandas(_links(gamma, gamma * lam), wide)).withColumn("_part", F.shiftright("_pos", 33))
    # One row for each rollout and partition: the map of all its steps there, that of the row that comes last in it.
    ends = scanned.groupBy(*keys, "_part").agg(F.max_by(F.struct("_head", "_a", "_b", F.col("value").alias("_v")), "_pos").alias("_m")).select(
        *keys, "_part", F.xxhash64(*keys).alias("_run"), "_m.*")
    if bootstrap is None:
        ends = ends.withColumn("last_value", F.lit(0.0))
    else:
        ends = ends.join(bootstrap.select(*keys, F.col("last_value").cast("double").alias("last_value")), keys, "left").na.fill(0.0, ["last_value"])
    ends = ends.select(*keys, "_part", "_run", "_head", "_a", "_b", "_v", "last_value")
    shape = StructType([*ends.select(*keys, "_part", "_run").schema, *StructType.fromDDL("_in double, _after double")])
    carry = ends.repartition(*keys).sortWithinPartitions(*keys, "_part").mapInPandas(_incoming, shape).drop("_run")
    carry = carry.withColumnsRenamed({"_part": "_at"} | {k: f"_on{i}" for i, k in enumerate(keys)})
    same = F.col("_part") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_on{i}"))
    out = scanned.join(carry, same).withColumn("advantage", F.col("_head") + F.col("_a") * F.col("_in") + F.col("_b") * F.col("_after"))
    return out.select(*rollout.columns, "advantage").withColumn("ret", F.col("advantage") + F.col("value"))


def standardised(df: DataFrame, keys: Sequence[str], column: str = "advantage", by: Sequence[str] = ("step",)) -> DataFrame:
    """``(v - mean) / (sample std + 1e-8)`` per rollout, from partial aggregates."""
    stats = df.groupBy(*keys).agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    out = salted_join(df, stats, list(keys), by=by)
    return out.withColumn(f"{column}_std", (F.col(column) - F.col("_m")) / (F.col("_s") + 1e-8)).drop("_m", "_s")


def log_softmax_at(logits: Column, index: Column) -> Column:
    """Log-probability of one class, shifted by the maximum for stability."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, b: a + b)
    return F.get(logits, index) - top - F.log(total)


def entropy(logits: Column) -> Column:
    """Entropy of the softmax of ``logits``."""
    top = F.array_max(logits)
    exps = F.transform(logits, lambda v: F.exp(v - top))
    total = F.aggregate(exps, F.lit(0.0), lambda a, b: a + b)
    mean = F.aggregate(F.zip_with(exps, logits, lambda e, v: e * (v - top)), F.lit(0.0), lambda a, b: a + b) / total
    return F.log(total) - mean


def argmax(logits: Column) -> Column:
    """Index of the first largest value."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def update_diagnostics(df: DataFrame, by: Sequence[str], clip_eps: float = 0.2, bound: float = 10.0) -> DataFrame:
    """Policy loss, value loss and entropy from logged old and new outputs.

    Needs ``log_prob, old_log_prob, advantage, value, ret, logits``.
    """
    ratio = F.exp(F.col("log_prob") - F.col("old_log_prob"))
    clipped = F.least(F.greatest(ratio, F.lit(1 - clip_eps)), F.lit(1 + clip_eps))
    surrogate = F.least(ratio * F.col("advantage"), clipped * F.col("advantage"))

    def cut(c: str) -> Column:
        return F.least(F.greatest(F.col(c), F.lit(-bound)), F.lit(bound))

    miss = cut("value") - cut("ret")
    return df.groupBy(*by).agg((-F.avg(surrogate)).alias("policy_loss"), F.avg(miss * miss).alias("value_loss"),
                               F.avg(entropy(F.col("logits"))).alias("entropy"))


def classification_log(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean cross-entropy and accuracy from ``logits`` and ``label``."""
    hit = (argmax(F.col("logits")) == F.col("label")).cast("int")
    return df.groupBy(*by).agg(F.avg(-log_softmax_at(F.col("logits"), F.col("label"))).alias("loss"),
                               F.avg(hit).alias("accuracy"))


def best_so_far(df: DataFrame, keys: Sequence[str], order: str, column: str, largest: bool = True) -> DataFrame:
    """Rows that strictly improve on everything before them (the ones worth saving)."""
    out = running(df, keys, order, {"_best": ("max" if largest else "min", F.col(column))}, exclusive=True)
    better = F.col(column) > F.col("_best") if largest else F.col(column) < F.col("_best")
    return out.where(F.col("_best").isNull() | better).drop("_best")
