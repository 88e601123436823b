"""Pixel ids, salted joins and ranks that never put one key's rows into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixtab.functions.lineage import materialize

SALTS = 16


def pixel_id(y: Column | str = "y", x: Column | str = "x") -> Column:
    """``y * 2^32 + x``: a BIGINT that sorts like (y, x)."""
    y = F.col(y) if isinstance(y, str) else y
    x = F.col(x) if isinstance(x, str) else x
    return F.shiftleft(y.cast("long"), 32) + x.cast("long")


def id_y(pid: Column) -> Column:
    return F.shiftright(pid, 32).cast("int")


def id_x(pid: Column) -> Column:
    return pid.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def spread_out(df: DataFrame, *cols: str | Column) -> DataFrame:
    """Hash-partition into ``spark.sql.shuffle.partitions`` parts.

    The count is explicit so that compact rows which stand for much work (tiles, bands) are not
    merged into a few tasks because their bytes are small.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner",
                by: Sequence[str] = ("y", "x"), salts: int = SALTS) -> DataFrame:
    """Join per-key statistics to many rows per key.

    A hot key is cut into ``salts`` shares by a hash of ``by``, by default at least one for 16 partitions; the
    statistics side (one row per key) is repeated once per share. Null keys match each other. Spark still broadcasts the small side when its size allows:
    shares are a table of their own, as the size check would not count rows that an ``explode`` repeats.
    """
    salts = max(salts, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16) if salts == SALTS else salts
    share = F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")
    own = [F.col(c).alias(f"_on{on.index(c)}") if c in on else F.col(c) for c in small.columns]
    copies = small.select(*own).crossJoin(big.sparkSession.range(0, salts, 1, 1).select(F.col("id").cast("int").alias("_copy")))
    same = F.col("_salt") == F.col("_copy")
    for i, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"_on{i}"))
    return big.withColumn("_salt", share).join(copies, same, how).drop("_salt", "_copy", *[f"_on{i}" for i in range(len(on))])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn",
           total: str | None = None) -> DataFrame:
    """``row_number()`` per key in ``order``, for keys of any size.

    Rows are range-partitioned by (keys, order), so a hot key spans many partitions. The layout is
    checkpointed because range bounds are sampled; the rank is the row's place inside its
    partition plus the key's row counts in earlier partitions (one row per key and partition).
    """
    cols = [*keys, *order]
    laid = materialize(
        df.repartitionByRange(*cols).sortWithinPartitions(*cols)
        .withColumn("_pos", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_pos", 33))
    runs = laid.groupBy(*keys, "_part").agg(F.min("_pos").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    picked = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")]
    if total:
        picked.append(F.sum("_n").over(whole).alias(total))
    runs = runs.select(*[F.col(k).alias(f"_on{i}") for i, k in enumerate(keys)], F.col("_part").alias("_at"), "_lo", *picked)
    same = F.col("_part") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_on{i}"))
    return (laid.join(runs, same)
            .withColumn(name, F.col("_pos") - F.col("_lo") + F.col("_before") + 1)
            .drop("_pos", "_part", "_lo", "_before", "_at", *[f"_on{i}" for i in range(len(keys))]))


#: Spark ranks before the shuffle only up to this rank.
FEW = 1000


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, name: str = "rn") -> DataFrame:
    """The first ``n`` rows per key with their rank, for keys of any size and any ``n``.

    Few rows are ranked by a window that Spark cuts to ``n`` rows per task before the shuffle; for more,
    the ranks are distributed.
    """
    if n <= FEW:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return ranked(df, keys, order, name).where(F.col(name) <= n)
