"""From file listings to sample manifests: discovery and pairing by joins on names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixtab.functions.keys import ranked


def list_files(spark: SparkSession, path: str, glob: str, recursive: bool = False) -> DataFrame:
    """Paths and names matching ``glob``; file contents are pruned from the scan."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", str(recursive).lower()).load(path))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))


def resolve_roots(datasets: DataFrame, existing: DataFrame) -> DataFrame:
    """``base_root, train_root, test_root`` for ``(dataset, root_dir, train_subdir, test_subdir)``.

    ``existing(path)`` lists directories. The given folder is the top one when it holds the training
    folder, the training folder itself when so named, and is otherwise used as it is.
    """
    have = existing.select(F.col("path").alias("_p")).distinct()
    sub = F.concat_ws("/", "root_dir", "train_subdir")
    d = datasets.withColumn("_p", F.when(F.col("train_subdir").isNotNull(), sub))
    d = d.join(have.withColumn("_has", F.lit(True)), "_p", "left")
    inner = F.col("_has").isNull() & (F.element_at(F.split("root_dir", "/"), -1) == F.col("train_subdir"))
    parent = F.regexp_replace("root_dir", "/[^/]*$", "")
    base = F.when(inner, parent).otherwise(F.col("root_dir"))
    train = F.when(F.col("_has"), F.col("_p")).otherwise(F.col("root_dir"))
    test = F.when(F.col("test_subdir").isNotNull(), F.concat_ws("/", base, F.col("test_subdir")))
    return d.select("dataset", base.alias("base_root"), train.alias("train_root"), test.alias("test_root"))


def part_of(path: Column, test_subdir: str = "test") -> Column:
    """``train`` or ``test`` from the folder names of a path."""
    return F.when(F.array_contains(F.split(path, "/"), test_subdir), "test").otherwise("train")


def stem(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def vessel_stem(image_stem: Column, rule: str | None) -> Column:
    if rule == "drive":
        return F.replace(F.replace(image_stem, F.lit("_training"), F.lit("_manual1")), F.lit("_test"), F.lit("_manual1"))
    return image_stem


def discover(images: DataFrame, vessels: DataFrame, masks: DataFrame | None, vessel_suffix: str,
             mask_suffix: str | None = None, rule: str | None = None) -> DataFrame:
    """Images with an annotation, and their mask when there is one.

    In flat folders annotation files are listed as images too; their own annotation name does not
    exist, so the inner join drops them.
    """
    s = stem(F.col("name"))
    left = images.select(s.alias("image_id"), F.col("name").alias("image_path"),
                         F.concat(vessel_stem(s, rule), F.lit(vessel_suffix)).alias("vessel_path"))
    out = left.join(vessels.select(F.col("name").alias("vessel_path")).distinct(), "vessel_path", "left_semi")
    if masks is None or mask_suffix is None:
        return out.select("image_id", "image_path", "vessel_path", F.lit(None).cast("string").alias("mask_path"))
    found = masks.select(F.col("name").alias("_m")).distinct().withColumn("mask_path", F.col("_m"))
    return (out.withColumn("_m", F.concat("image_id", F.lit(mask_suffix))).join(found, "_m", "left")
            .select("image_id", "image_path", "vessel_path", "mask_path"))


def _first_by_prefix(files: DataFrame, lengths: list[int], out: str) -> DataFrame:
    """First file name, in order, for every prefix of the given lengths."""
    every = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    cut = F.explode(F.filter(every, lambda n: n <= F.length("name")))
    return (files.select("name", cut.alias("_n")).groupBy(F.expr("substring(name, 1, _n)").alias("image_id"))
            .agg(F.min("name").alias(out)))


def pair_by_prefix(images: DataFrame, masks: DataFrame, annotations: DataFrame,
                   missing_mask: str = "raise") -> DataFrame:
    """First mask and annotation whose names start with the image's id (its name up to ``_``).

    The test "starts with" becomes an equi-join by expanding each listed name into its prefixes of the
    lengths that ids have (file names, and so these lengths, are short).
    Images without annotation are skipped; one without mask is an error, or kept with null.
    """
    ids = images.select(F.substring_index("name", "_", 1).alias("image_id"), F.col("name").alias("image_path"))
    lengths = sorted(r[0] for r in ids.where("length(image_id) > 0").select(F.length("image_id")).distinct().collect())
    out = (ids.join(_first_by_prefix(annotations, lengths, "vessel_path"), "image_id")
           .join(_first_by_prefix(masks, lengths, "mask_path"), "image_id", "left"))
    if missing_mask == "raise":
        message = F.concat(F.lit("no mask for image "), F.col("image_id"))
        out = out.withColumn("mask_path", F.coalesce(F.col("mask_path"), F.raise_error(message).cast("string")))
    return out.select("image_id", "image_path", "vessel_path", "mask_path")


def pair_by_position(images: DataFrame, vessels: DataFrame, masks: DataFrame, check: bool = True) -> DataFrame:
    """Pair the i-th names of three sorted listings; ``check`` makes unequal lengths an error."""
    out = None
    for df, col in ((images, "image_path"), (vessels, "vessel_path"), (masks, "mask_path")):
        r = ranked(df.select(F.col("name").alias(col)), [], [col], "position", total=f"n_{col}")
        out = r if out is None else out.join(r, "position")
    if check:
        same = (F.col("n_image_path") == F.col("n_vessel_path")) & (F.col("n_image_path") == F.col("n_mask_path"))
        out = out.withColumn("position", F.when(same, F.col("position")).otherwise(
            F.raise_error(F.lit("listings differ in length")).cast("bigint")))
    return out.select("position", "image_path", "vessel_path", "mask_path")


def combine(**datasets: DataFrame) -> DataFrame:
    """Stack manifests or tables of several datasets with a ``dataset`` column."""
    out = None
    for name, df in datasets.items():
        tagged = df.withColumn("dataset", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
