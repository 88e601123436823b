"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixtab.functions.lineage import materialize
from pixtab.llm.arrow import whole_rows

#: The ring has 2^BITS places; a shard stands on it with NODES virtual nodes.
BITS, NODES = 12, 64
#: Rows of one place that are handled together; a place with more is cut into several cells.
CELL = 1 << 20


def place(h: Column) -> Column:
    """The place of a 64-bit hash on the ring."""
    return F.shiftrightunsigned(h, 64 - BITS).cast("int")


def virtual_nodes(like: DataFrame, shards: list[int], nodes: int) -> DataFrame:
    """``(at, h, shard)`` of the virtual nodes of ``shards``: a shard's nodes do not depend on which others there are."""
    ids = like.sparkSession.range(0, (max(shards) + 1) * nodes, 1, 1)
    shard = F.floor(F.col("id") / nodes).cast("long")
    h = F.xxhash64(F.lit("node"), shard, F.col("id") % nodes)
    return ids.where(shard.isin(shards)).select(place(h).alias("at"), h.alias("h"), shard.cast("int").alias("shard"))


def laid_out(cells: DataFrame, room: Mapping[int, int], nodes: int = NODES) -> DataFrame:
    """``(at, sub, lo, hi, shard)``: which part of each cell goes to which shard.

    ``cells`` has ``(at, sub, w)``; ``room`` is each shard's capacity, together at least the sum of w. In each round every cell asks the next shard
    clockwise that has room; a shard takes what asks in the order of a hash and cuts the cell that fills it, and the rest
    continues clockwise. Only a full shard turns something away, so there are at most as many rounds as shards. All of this
    works on the cells, at most 2^BITS of them and one more for every CELL rows, in one task, while rows stay where they are.
    """
    room = dict(room)
    asking = materialize(cells.select("at", "sub", F.lit(0).cast("long").alias("lo"), F.col("w").alias("hi")).coalesce(1))
    out = asking.select("*", F.lit(None).cast("int").alias("shard")).limit(0)
    clockwise = Window.orderBy(F.desc("at"), F.desc_nulls_last("node.h")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    while True:
        around = virtual_nodes(cells, [s for s, n in room.items() if n > 0] or [0], nodes)
        both = asking.withColumn("node", F.lit(None).cast("struct<at:int,h:bigint,shard:int>")).unionByName(
            around.select("at", F.struct("at", "h", "shard").alias("node")), allowMissingColumns=True).coalesce(1)
        # From the far end of the ring back: the last node seen is the next one clockwise; past the end it is the first of all.
        after = F.coalesce(F.last("node", True).over(clockwise), F.min("node").over(everything))
        asked = both.withColumn("shard", after["shard"]).where("node is null")
        turn = Window.partitionBy("shard").orderBy(F.xxhash64("at", "sub"), "at", "sub").rowsBetween(Window.unboundedPreceding, 0)
        w = F.col("hi") - F.col("lo")
        left = F.create_map(*[F.lit(x) for s, n in room.items() for x in (s, n)])[F.col("shard")]
        got = materialize(asked.withColumn("taken", F.greatest(F.lit(0), F.least(w, left - (F.sum(w).over(turn) - w))).cast("long"))
                          .select("at", "sub", "lo", "hi", "shard", "taken"))
        out = out.unionByName(got.where("taken > 0").select("at", "sub", "lo", (F.col("lo") + F.col("taken")).alias("hi"), "shard"))
        sums = got.groupBy("shard").agg(F.sum("taken").alias("taken"), F.sum(w - F.col("taken")).alias("rest")).collect()  # a row a shard
        for r in sums:
            room[r["shard"]] -= r["taken"]
        if not sum(r["rest"] for r in sums):
            return out
        asking = got.where(w > F.col("taken")).select("at", "sub", (F.col("lo") + F.col("taken")).alias("lo"), "hi")


def ring_shards(rows: DataFrame, key: str, shards: int, weight: Column | None = None, slack: float = 0.0, nodes: int = NODES) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard), a row for each row.

    A row belongs to the next virtual node clockwise of its key's hash. A shard holds at most its share of the whole weight
    times 1 + ``slack``; rows that overflow continue clockwise. Without ``weight`` rows count, and with a slack of 0 counts
    are then at most one apart; with weights (less than 1 counts as 1) a shard may exceed its bound by less than one row. More slack moves fewer rows when shards
    come or go. A hot key, null among them, is cut into cells of about CELL rows by place in the stored table, so neither a shard nor a task
    gets all of it; repeated rows are rows of their own. An empty table gives an empty result; columns of any name are carried along (``shard``
    and ``slot`` of the input are replaced).
    """
    rows = rows.drop("shard", "slot")
    h = F.xxhash64(F.lit("key"), F.col(f"`{key}`"))
    own = materialize(whole_rows(rows, h=h, at=place(h), w=F.lit(1).cast("long") if weight is None else F.greatest(weight.cast("long"), F.lit(1))))
    own = own.withColumn("row", F.monotonically_increasing_id())  # of stored rows: the same each time
    large = own.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL).select("at", F.ceil(F.col("n") / CELL).alias("parts"))
    own = own.join(F.broadcast(large), "at", "left")  # at most 2^BITS rows
    own = own.withColumn("sub", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), "parts")).cast("int"))
    cells = materialize(own.groupBy("at", "sub").agg(F.sum("w").alias("w")))
    whole = cells.agg(F.sum("w")).first()[0] or 0
    limit = whole + int(whole * slack)
    parts = laid_out(cells, {s: limit // shards + (s < limit % shards) for s in range(shards)}, nodes)

    cell = Window.partitionBy("at", "sub").orderBy("h", "row")
    upto = cell.rowsBetween(Window.unboundedPreceding, 0)
    ranked = own.select("_r", "at", "sub", (F.sum("w").over(upto) - F.col("w")).alias("begin"), F.row_number().over(cell).alias("rank"))
    here = parts.withColumnsRenamed({"at": "at_", "sub": "sub_"})
    placed = materialize(ranked.join(here, (F.col("at") == F.col("at_")) & (F.col("sub") == F.col("sub_"))
                                     & (F.col("begin") >= F.col("lo")) & (F.col("begin") < F.col("hi"))).select("_r", "at", "sub", "rank", "shard"))
    sizes = placed.groupBy("shard", "at", "sub").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("at", "sub")) - F.col("n")
    starts = sizes.select("shard", "at", "sub", (before - F.col("first")).alias("shift"))
    out = placed.join(starts, ["shard", "at", "sub"])
    names = {c: F.col(f"_r.`{c}`") for c in rows.columns}
    return out.select(*[c.alias(n) for n, c in names.items()], "shard", (F.col("rank") + F.col("shift")).cast("long").alias("slot"))


def op11_ring(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Law ``rows``: with no slack, every shard gets its exact share of rows. Null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return ring_shards(sized, "doc_id", shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
