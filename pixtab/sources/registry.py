"""Dataset layouts as a table; later registrations replace earlier ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixtab.schemas import REGISTRY

# fixed values: name, image_dir, vessel_dir, image_glob, vessel_suffix, mask_dir, mask_suffix, stem_rule, train_subdir, test_subdir
LAYOUTS = [
    ("DRIVE", "images", "1st_manual", "*.tif", ".gif", "mask", "_mask.gif", "drive", "training", "test"),
    ("STARE", ".", ".", "*.ppm", ".ah.ppm", None, None, None, None, None),
    ("CHASE_DB1", ".", ".", "*.png", "_1stHO.png", None, None, None, None, None),
    ("HRF", "images", "manual1", "*.jpg", ".tif", "mask", "_mask.tif", None, None, None),
    ("DR_HAGIS", "Fundus_Images", "Manual_Segmentations", "*.jpg", ".png", "Mask_images", ".png", None, None, None),
    ("FIVES", "Original", "Ground truth", "*.png", ".png", None, None, None, "train", "test"),
    ("LES_AV", "images", "vessel-segmentations", "*.png", ".png", "mask", ".gif", None, None, None),
    ("AV_WIDE", "images", "manual", "*.png", "_vessels.png", None, None, None, None, None),
    ("IOSTAR", "image", "GT", "*.jpg", ".tif", None, None, None, None, None),
]
ALIASES = {"CHASEDB1": "CHASE_DB1", "DRHAGIS": "DR_HAGIS"}


def canonical_name(name: Column) -> Column:
    """Upper case, ``-`` and space as ``_``."""
    return F.upper(F.translate(name, "- ", "__"))


def latest(entries: DataFrame, order: str) -> DataFrame:
    """The last registration of each canonical name, by ``order``."""
    rest = [c for c in entries.columns if c != "name"]
    named = entries.withColumn("name", canonical_name(F.col("name")))
    return (named.groupBy("name").agg(F.max_by(F.struct(*rest), order).alias("_e"))
            .select("name", *[F.col(f"_e.{c}").alias(c) for c in rest]))


def registry(spark: SparkSession, added: Sequence[tuple] = ()) -> DataFrame:
    """Built-in layouts, their aliases and ``added`` rows (same columns), last one wins."""
    by_name = {row[0]: row for row in LAYOUTS}
    rows = [*LAYOUTS, *[(alias, *by_name[name][1:]) for alias, name in ALIASES.items()], *added]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq int, " + ", ".join(
        f"{f.name} string" for f in REGISTRY))
    return latest(table, "seq").select(*REGISTRY.names)
