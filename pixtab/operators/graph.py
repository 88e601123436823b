"""Skeleton graphs: nodes, edges, degrees, expert traces and spur removal.

Chains of ordinary pixels are contracted inside tiles: each pixel, in each direction, learns which node lies ahead in its tile, how
far, and through which last pixel, or where its chain leaves the tile. Only the pixels where chains enter a tile are then ranked
by pointer doubling, in about log2(borders crossed) joins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixtab.functions.keys import id_x, id_y, pixel_id, ranked, salted_join
from pixtab.functions.lineage import materialize
from pixtab.functions.strips import EDGE, TileWork, map_tiles, tile_of_rows
from pixtab.operators.components import min_labels
from pixtab.operators.neighborhood import special_points
from pixtab.operators.thinning import adjacency, thin

PIXEL = ["image_id", "y", "x"]


def nodes(points: DataFrame) -> DataFrame:
    """``(image_id, node_id, y, x, type)``; ids are pixel ids, ordered like (y, x)."""
    return special_points(points).select("image_id", pixel_id().alias("node_id"), "y", "x", "type")


def _gap(a: Column, b: Column) -> Column:
    """Distance of two neighbouring pixels: 1 or the square root of 2."""
    straight = (id_y(a) == id_y(b)) | (id_x(a) == id_x(b))
    return F.when(straight, F.lit(1.0)).otherwise(F.sqrt(F.lit(2.0)))


def _contract_tiles(edge: int) -> TileWork:
    """Follows all states of the tiles at once, by pointer jumping; closed rings are dropped."""
    def contract(own: dict[str, np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, dict]:
        a, b, na, nb, end, last = (own[c].astype("int64") for c in ("a", "b", "na", "nb", "end", "last"))
        n, e = len(a), own["e"].astype("float64")
        d, tile = np.ones(n, "int64"), tile_of_rows(starts, n)
        y0, x0 = own["ty"].astype("int64") * edge, own["tx"].astype("int64") * edge

        def places(before: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Number of the state (before -> at): the pixel's place in its tile and the side it is entered from."""
            y, x = at >> 32, at & 0xFFFFFFFF
            side = ((before >> 32) - y + 1) * 3 + (before & 0xFFFFFFFF) - x + 1
            inside = (y // edge * edge == y0) & (x // edge * edge == x0)
            return np.where(inside, ((tile * edge + y - y0) * edge + x - x0) * 9 + side, -1)
        state = places(a, b)
        order = np.argsort(state, kind="stable")
        known, goal = state[order], np.where(na >= 0, places(na, nb), -1)
        at = np.maximum(np.searchsorted(known, goal, side="right") - 1, 0)
        ahead = np.where((goal >= 0) & (known[at] == goal), order[at], -1)
        for _ in range(n.bit_length() + 1):
            i = np.flatnonzero(ahead >= 0)
            if not i.size:
                break
            j = ahead[i]
            d[i] += d[j]
            e[i] += e[j]
            end[i], last[i], na[i], nb[i], ahead[i] = end[j], last[j], na[j], nb[j], ahead[j]
        rows = np.flatnonzero(ahead < 0)
        made = {"a": a, "b": b, "d": d, "e": e, "end": end, "last": last, "na": na, "nb": nb}
        return rows, {c: v[rows] for c, v in made.items()}
    return contract


def contracted(states: DataFrame, edge: int = EDGE) -> tuple[DataFrame, DataFrame]:
    """States followed to their node or to the border of their tile, and the table of entries that the doubling starts from.

    An entry is a state that some chain reaches from another tile, so a chain has at most two of them, one each way, for
    every tile border it crosses.
    """
    key = states.schema["image_id"].dataType.simpleString()
    tiled = states.select("*", F.floor(id_y(F.col("b")) / edge).cast("int").alias("ty"), F.floor(id_x(F.col("b")) / edge).cast("int").alias("tx"))
    filled = tiled.na.fill(-1, ["end", "last", "na", "nb"])  # as missing numbers, 64-bit ids would not stay exact
    local = map_tiles(filled, _contract_tiles(edge),
                      f"image_id {key}, a bigint, b bigint, d bigint, e double, end bigint, last bigint, na bigint, nb bigint")
    local = materialize(local.select("image_id", "a", "b", F.col("d").cast("int").alias("d"), "e", *[
        F.when(F.col(c) >= 0, F.col(c)).alias(c) for c in ("end", "last", "na", "nb")]))
    reached = local.where("end IS NULL").select("image_id", F.col("na").alias("a"), F.col("nb").alias("b")).distinct()
    return local, materialize(local.join(reached, ["image_id", "a", "b"], "left_semi"))


def _ahead(s: DataFrame) -> DataFrame:
    return s.select("image_id", F.col("a").alias("na"), F.col("b").alias("nb"), F.col("d").alias("d2"), F.col("e").alias("e2"),
                    F.col("end").alias("end2"), F.col("last").alias("last2"), F.col("na").alias("na2"), F.col("nb").alias("nb2"))


def _moved(s: DataFrame, ahead: DataFrame) -> DataFrame:
    """Open states taken on to where the states ahead of them have come."""
    return s.where("end IS NULL").join(ahead, ["image_id", "na", "nb"]).select(
        "image_id", "a", "b", (F.col("d") + F.col("d2")).alias("d"), (F.col("e") + F.col("e2")).alias("e"),
        F.col("end2").alias("end"), F.col("last2").alias("last"), F.col("na2").alias("na"), F.col("nb2").alias("nb"))


def _chains(points: DataFrame, edge: int = EDGE) -> tuple[DataFrame, DataFrame]:
    """Pixels of chains between nodes, and pairs of adjacent nodes.

    Chain pixels: ``(image_id, src, dst, first, length, extent, seq, pid)`` with ``src < dst``; ``first``
    is the pixel after ``src`` and names the chain. Loops back to the same node are left out.
    """
    around = materialize(adjacency(points))
    special = (F.size("nbrs") == 1) | (F.size("nbrs") > 2)
    hubs = around.where(special).select("image_id", F.col("pid").alias("c"))
    direct = (around.where(special).select("image_id", "pid", F.explode("nbrs").alias("c")).where("pid < c")
              .join(hubs, ["image_id", "c"], "left_semi").select("image_id", F.col("pid").alias("src"), F.col("c").alias("dst")))
    inner = around.where(F.size("nbrs") == 2)
    way = F.explode(F.array(F.struct(F.col("nbrs")[0].alias("a"), F.col("nbrs")[1].alias("c")),
                            F.struct(F.col("nbrs")[1].alias("a"), F.col("nbrs")[0].alias("c"))))
    s = inner.select("image_id", F.col("pid").alias("b"), way.alias("w")).select("image_id", "w.a", "b", "w.c")
    s = s.join(hubs.withColumn("hub", F.lit(True)), ["image_id", "c"], "left")
    # state (a -> b): pixel b entered from a; next state (b -> c), or the end at node c
    s = s.select("image_id", "a", "b", _gap(F.col("b"), F.col("c")).alias("e"),
                 F.when(F.col("hub"), F.col("c")).alias("end"), F.when(F.col("hub"), F.col("b")).alias("last"),
                 F.when(F.col("hub").isNull(), F.col("b")).alias("na"), F.when(F.col("hub").isNull(), F.col("c")).alias("nb"))
    local, entries = contracted(s, edge)
    open_ = entries.where("end IS NULL").count()
    while open_:
        moved = _moved(entries, _ahead(entries))
        entries = materialize(entries.where("end IS NOT NULL").unionByName(moved))
        now = entries.where("end IS NULL").count()
        if now == open_:  # only closed rings without a node are left
            break
        open_ = now
    s = materialize(local.where("end IS NOT NULL").unionByName(_moved(local, _ahead(entries.where("end IS NOT NULL")))))
    arms = s.where("end IS NOT NULL").groupBy("image_id", F.col("b").alias("pid")).agg(
        F.array_sort(F.collect_list(F.struct("end", "last", "d", "e"))).alias("t"))
    lo, hi = F.col("t")[0], F.col("t")[1]
    chain = arms.where((F.size("t") == 2) & (lo["end"] != hi["end"])).select(
        "image_id", lo["end"].alias("src"), hi["end"].alias("dst"), lo["last"].alias("first"),
        (lo["d"] + hi["d"] + 1).alias("length"), (lo["e"] + hi["e"]).alias("extent"), lo["d"].alias("seq"), "pid")
    return chain, direct


def edges_and_points(points: DataFrame, edge: int = EDGE) -> tuple[DataFrame, DataFrame]:
    """One edge per node pair and its pixels in order.

    Edges: ``(image_id, src, dst, length)``, the shortest chain of each pair, length in pixels with
    both ends. Points: ``(image_id, src, dst, seq, y, x)`` - one row per pixel, never packed.
    """
    chain, direct = _chains(points, edge)
    chain = materialize(chain)
    ways = (chain.where("seq = 1").select("image_id", "src", "dst", "length", "first")
            .unionByName(direct.select("image_id", "src", "dst", F.lit(2).alias("length"), F.col("dst").alias("first"))))
    best = ways.groupBy("image_id", "src", "dst").agg(F.min(F.struct("length", "first")).alias("b"))
    best = materialize(best.select("image_id", "src", "dst", F.col("b.length").alias("length"), F.col("b.first").alias("first")))
    inner = salted_join(chain.select("image_id", "src", "dst", "first", "seq", "pid"),
                        best.drop("length"), ["image_id", "src", "dst", "first"], by=("pid",)).drop("first")
    ends = (best.select("image_id", "src", "dst", F.lit(0).alias("seq"), F.col("src").alias("pid"))
            .unionByName(best.select("image_id", "src", "dst", (F.col("length") - 1).alias("seq"), F.col("dst").alias("pid"))))
    path = inner.unionByName(ends).select("image_id", "src", "dst", "seq", id_y(F.col("pid")).alias("y"), id_x(F.col("pid")).alias("x"))
    return best.drop("first"), path


def edges(points: DataFrame) -> DataFrame:
    return edges_and_points(points)[0]


def degrees(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Edges per node, 0 for isolated ones."""
    ends = edge_table.select("image_id", F.explode(F.array("src", "dst")).alias("node_id"))
    n = ends.groupBy("image_id", "node_id").agg(F.count(F.lit(1)).alias("degree"))
    return node_table.select("image_id", "node_id").join(n, ["image_id", "node_id"], "left").na.fill(0)


def expert_traces(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of all graph components that have a degree-1 node, numbered per image, and their pixels.

    An image without any such node contributes the component of its first node. Traces are numbered
    by (component, src, dst).
    """
    e, path = edges_and_points(points)
    node_table = nodes(points)
    labels = min_labels(e.select("image_id", F.col("src").alias("a"), F.col("dst").alias("b")))
    deg = materialize(degrees(node_table, e).join(labels.withColumnRenamed("node", "node_id"), ["image_id", "node_id"], "left"))
    tips = deg.where("degree = 1").select("image_id", "label").distinct()
    first = (deg.groupBy("image_id").agg(F.min(F.struct("node_id", "label")).alias("f"), F.count_if(F.col("degree") == 1).alias("n"))
             .where("n = 0 AND f.label IS NOT NULL").select("image_id", F.col("f.label").alias("label")))
    chosen = tips.unionByName(first)
    tagged = e.join(labels.select("image_id", F.col("node").alias("src"), "label"), ["image_id", "src"])
    kept = salted_join(tagged, chosen, ["image_id", "label"], by=("src", "dst"))
    traces = ranked(kept, ["image_id"], ["label", "src", "dst"], "trace_id").select("image_id", "trace_id", "src", "dst", "length")
    traces = materialize(traces)
    px = salted_join(path, traces.drop("length"), ["image_id", "src", "dst"])
    return traces, px.select("image_id", "trace_id", "seq", "y", "x")


def spur_pixels(points: DataFrame, max_extent: float) -> DataFrame:
    """Pixels, ends included, of tip-to-junction branches shorter than ``max_extent`` (Euclidean)."""
    chain, direct = _chains(points)
    kind = nodes(points).select("image_id", "node_id", "type")

    def mixed(df: DataFrame) -> DataFrame:
        out = (df.join(kind.select("image_id", F.col("node_id").alias("src"), F.col("type").alias("_a")), ["image_id", "src"])
               .join(kind.select("image_id", F.col("node_id").alias("dst"), F.col("type").alias("_b")), ["image_id", "dst"]))
        return out.where("_a <> _b")

    short = mixed(chain.where(F.col("extent") < max_extent))
    near = mixed(direct.where(_gap(F.col("src"), F.col("dst")) < max_extent))
    pid = (short.select("image_id", F.explode(F.array("pid", "src", "dst")).alias("p"))
           .unionByName(near.select("image_id", F.explode(F.array("src", "dst")).alias("p"))).distinct())
    return pid.select("image_id", id_y(F.col("p")).alias("y"), id_x(F.col("p")).alias("x"))


def remove_spurs(points: DataFrame, max_extent: float) -> DataFrame:
    """Drop short tip-to-junction branches and thin what is left."""
    return thin(points.join(spur_pixels(points, max_extent), PIXEL, "left_anti"))
