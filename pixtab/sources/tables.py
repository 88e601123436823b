"""Stored results: parquet centerlines computed once, CSV reports, and per-consumer projections."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixtab.functions.keys import salted_join
from pixtab.functions.lineage import materialize

KEY = ["dataset", "image_id", "params_hash"]

# fixed values: columns of the per-image report, in order
REPORT_COLUMNS = [
    "image_id", "precision_1px", "recall_1px", "f1_1px", "precision_2px", "recall_2px", "f1_2px",
    "precision_3px", "recall_3px", "f1_3px", "cldice", "betti_0_error_raw", "betti_0_error_postproc", "hd95",
]


def with_params(manifest: DataFrame, **params) -> DataFrame:
    """Add a hash of the operator parameters, so results of other settings are never reused."""
    text = ",".join(f"{k}={params[k]}" for k in sorted(params))
    return manifest.withColumn("params_hash", F.sha2(F.lit(text), 256))


def missing(manifest: DataFrame, stored: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Manifest entries that have no stored result yet."""
    return manifest.join(stored.select(*key).distinct(), list(key), "left_anti")


def update_centerlines(manifest: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Compute only missing images, append them partitioned by dataset, and return the stored rows of ``manifest``.

    A status table beside the results has one row per finished image, also where the result is empty, and the
    run that made it. Rows of a run that did not finish have no status: they are not read, and made again.
    """
    spark, status = manifest.sparkSession, f"{path}_status"
    kinds = ", ".join(f"{k} {manifest.schema[k].dataType.simpleString()}" for k in KEY)
    try:
        done = spark.read.schema(f"{kinds}, run string").parquet(status)
    except Exception as e:  # first run: nothing stored
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = spark.createDataFrame([], f"{kinds}, run string")
    todo, run = missing(manifest.select(*KEY).distinct(), done), uuid.uuid4().hex
    result = compute(missing(manifest, done)).withColumn("run", F.lit(run))
    if not todo.isEmpty():
        marks = materialize(todo.withColumn("run", F.lit(run)))
        result.write.mode("append").partitionBy("dataset").parquet(path)
        marks.write.mode("append").parquet(status)
    stored = spark.read.schema(result.schema).parquet(path)
    done = spark.read.schema(f"{kinds}, run string").parquet(status).join(manifest.select(*KEY).distinct(), KEY, "left_semi")
    return stored.join(done, [*KEY, "run"], "left_semi").drop("run")


def write_report(metrics: DataFrame, path: str, columns: Sequence[str] = REPORT_COLUMNS, append: bool = True) -> None:
    """CSV with a fixed header; absent columns and missing values are empty."""
    cols = [F.col(c) if c in metrics.columns else F.lit(None).cast("double").alias(c) for c in columns]
    (metrics.select(*cols).write.mode("append" if append else "overwrite")
     .option("header", True).option("nullValue", "").option("emptyValue", "").csv(path))


def unet_tables(enhanced: DataFrame, centerline: DataFrame, vessel: DataFrame, fov: DataFrame) -> dict[str, DataFrame]:
    """Enhanced image plus binary annotations."""
    return {"image": enhanced, "centerline": centerline, "vessel_mask": vessel, "fov_mask": fov}


def frangi_tables(px: DataFrame, centerline: DataFrame, vessel: DataFrame, fov: DataFrame) -> dict[str, DataFrame]:
    """Raw RGB; annotations as 8-bit values 255."""
    full = lambda p: p.select("image_id", "y", "x", F.lit(255).alias("v"))
    return {"image": px, "centerline": full(centerline), "vessel_mask": full(vessel), "fov_mask": full(fov)}


greedy_tracer_tables = frangi_tables


def rl_agent_tables(px: DataFrame, centerline: DataFrame, vessel: DataFrame, fov: DataFrame,
                    distance: DataFrame) -> dict[str, DataFrame]:
    """RGB scaled to [0, 1], binary annotations and the clipped distance map."""
    image = px.select("image_id", "y", "x", *[(F.col(c) / 255.0).alias(c) for c in "rgb"])
    return {"image": image, "centerline": centerline, "vessel_mask": vessel, "fov_mask": fov, "distance": distance}


def choose_fov(images: DataFrame, given: DataFrame, derived: DataFrame) -> DataFrame:
    """The loaded mask of an image where there is one, else the derived mask."""
    have = given.select("image_id").distinct()
    wanted = images.select("image_id").distinct()
    return (salted_join(given, wanted, ["image_id"], "left_semi")
            .unionByName(salted_join(derived, wanted.join(have, "image_id", "left_anti"), ["image_id"], "left_semi")))
