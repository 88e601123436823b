"""Summary tables over metrics and traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixtab.functions.keys import first_of_each, salted_join


def summarise(metrics: DataFrame, columns: Sequence[str], sample: bool = True) -> DataFrame:
    """``(metric, mean, std, text)``: mean and sample (or population) deviation of each metric column."""
    long = metrics.select(*columns).unpivot([], list(columns), "metric", "value")
    std = F.stddev_samp("value") if sample else F.stddev_pop("value")
    out = long.groupBy("metric").agg(F.avg("value").alias("mean"), std.alias("std"))
    return out.withColumn("text", F.format_string("%.4f ± %.4f", "mean", "std"))


def trace_lengths(traces: DataFrame) -> DataFrame:
    return traces.groupBy("image_id", "trace_id").agg(F.count(F.lit(1)).alias("length"))


def trace_statistics(traces: DataFrame, images: DataFrame) -> DataFrame:
    """Number of traces and exact median length per image, 0 without traces."""
    hist = trace_lengths(traces).groupBy("image_id", "length").agg(F.count(F.lit(1)).alias("n"))
    stats = hist.groupBy("image_id").agg(F.sum("n").alias("num_traces"), F.expr("percentile(length, 0.5D, n)").alias("median_len"))
    return images.select("image_id").distinct().join(stats, "image_id", "left").na.fill(0)


def length_histogram(traces: DataFrame, edges: int = 40) -> DataFrame:
    """``(image_id, bin, traces)``: lengths between ``edges`` log-spaced edges from shortest to longest."""
    n = trace_lengths(traces)
    span = n.groupBy("image_id").agg(F.greatest(F.min("length"), F.lit(1)).alias("lo"), F.max("length").alias("hi"))
    t = salted_join(n, span, ["image_id"], by=("trace_id",))
    share = F.ln(F.col("length") / F.col("lo")) / F.ln(F.col("hi") / F.when(F.col("hi") > F.col("lo"), F.col("lo")))
    at = F.floor(F.round(F.coalesce(share, F.lit(0.0)) * (edges - 1), 9)).cast("int")
    return (t.groupBy("image_id", F.least(F.greatest(at, F.lit(0)), F.lit(edges - 2)).alias("bin"))
            .agg(F.count(F.lit(1)).alias("traces")))


def first_traces(traces: DataFrame, n: int = 50) -> DataFrame:
    """Seeds (first points) of the first ``n`` traces of each image in visit order."""
    starts = traces.where("seq = 0")
    return (first_of_each(starts, ["image_id"], ["trace_id"], n, "rank")
            .select("image_id", "rank", "trace_id", "y", "x"))
