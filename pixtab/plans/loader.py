"""From registered layouts and file listings to the split manifest of many datasets at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixtab.operators.splits import three_way
from pixtab.sources.manifest import stem, vessel_stem
from pixtab.sources.registry import canonical_name


def _annotated(image_stem: Column, rule: Column) -> Column:
    return F.when(rule == "drive", vessel_stem(image_stem, "drive")).otherwise(image_stem)


def discover_all(layouts: DataFrame, images: DataFrame, vessels: DataFrame, masks: DataFrame) -> DataFrame:
    """``(dataset, image_id, image_path, vessel_path, mask_path)`` of every dataset with a layout.

    Listings are ``(dataset, name)``; ``layouts`` is a registry, one row per name, whose suffixes and rule are columns
    here, so one join on names serves all layouts. Images without annotation drop out, those without mask keep null.
    """
    rules = layouts.select(F.col("name").alias("_set"), "vessel_suffix", "mask_suffix", "stem_rule")
    s = stem(F.col("name"))
    named = images.join(rules, canonical_name(F.col("dataset")) == F.col("_set")).select(
        "dataset", s.alias("image_id"), F.col("name").alias("image_path"),
        F.concat(_annotated(s, F.col("stem_rule")), "vessel_suffix").alias("vessel_path"),
        F.concat(s, F.col("mask_suffix")).alias("_mask"))
    found = named.join(vessels.select("dataset", F.col("name").alias("vessel_path")).distinct(), ["dataset", "vessel_path"], "left_semi")
    have = masks.select("dataset", F.col("name").alias("_mask")).distinct().withColumn("mask_path", F.col("_mask"))
    return found.join(have, ["dataset", "_mask"], "left").select("dataset", "image_id", "image_path", "vessel_path", "mask_path")


def load_manifest(layouts: DataFrame, images: DataFrame, vessels: DataFrame, masks: DataFrame,
                  ratios: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """The discovered samples with their ``split`` by position in id order, dataset by dataset."""
    return three_way(discover_all(layouts, images, vessels, masks), ratios)
