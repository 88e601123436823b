"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixtab.functions.lineage import materialize


def min_roots(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)`` (BIGINT); root is the smallest node reachable.

    Alternating star contraction. Groups are only reduced to a minimum, which combines before the
    shuffle; the joins hang neighbours on that minimum and may be split where a hub has many rows.
    Each round is checkpointed, so a lost executor costs a round. No links give no rows; repeated
    links, both directions and links of a node to itself change nothing; rows with a null are left out.
    """
    e = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))))
        e = materialize(small.distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
