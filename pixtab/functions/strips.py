"""Dense rasters as row strips inside halo tiles.

A strip is one raster row inside one tile, its values packed into an array of at most
``edge + 2 * halo`` numbers. Tiles carry ``halo`` extra pixels on each side, so after ONE shuffle by
``(image_id, ty, tx)`` any chain of neighbourhood filters whose radii add up to ``halo`` runs
locally: along x with array functions, along y with windows that all share one sort. A huge image
is many tiles, and no task holds more than a tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pixtab.functions.keys import salted_join, spread_out
from pixtab.functions.offsets import offset_array

EDGE = 256
TILE = ["image_id", "ty", "tx"]


def _cover(c: str, halo: int, edge: int) -> Column:
    lo = F.floor((F.col(c) - halo) / edge)
    hi = F.floor((F.col(c) + halo) / edge)
    return F.sequence(lo, hi).cast("array<int>")


def halo_copies(px: DataFrame, halo: int, edge: int = EDGE) -> DataFrame:
    """Each pixel in its own tile and in tiles it is a halo pixel of; nothing is shuffled yet."""
    return (px.withColumn("ty", F.explode(_cover("y", halo, edge)))
            .withColumn("tx", F.explode(_cover("x", halo, edge))))


def halo_tiles(px: DataFrame, halo: int, edge: int = EDGE) -> DataFrame:
    """The same after one shuffle by tile."""
    return spread_out(halo_copies(px, halo, edge), *TILE)


def at_home(edge: int = EDGE) -> Column:
    return (F.floor(F.col("y") / edge) == F.col("ty")) & (F.floor(F.col("x") / edge) == F.col("tx"))


#: Columns of whole tiles and the first row of each tile, to the number of a row of the same tile for every row made, and the columns made.
TileWork = Callable[[dict[str, np.ndarray], np.ndarray], tuple[np.ndarray, dict]]


def _whole_tiles(batches: Iterator[pa.RecordBatch], work: TileWork, schema: StructType) -> Iterator[pa.RecordBatch]:
    shape, held = to_arrow_schema(schema), []

    def made(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        at, out = work({c: rows[c].to_numpy() for c in rows.column_names if c != "image_id"}, starts)
        images = rows["image_id"].combine_chunks().take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([images if t.name == "image_id" else pa.array(out[t.name], t.type) for t in shape], schema=shape)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch])
        image = rows["image_id"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        turns = np.zeros(len(image) - 1, bool)
        for key in (image, rows["ty"].to_numpy(), rows["tx"].to_numpy()):
            turns |= key[1:] != key[:-1]
        starts = np.concatenate([[0], np.flatnonzero(turns) + 1])
        if len(starts) > 1:
            yield made(rows.slice(0, starts[-1]), starts[:-1])
        held = rows.slice(starts[-1]).to_batches()  # the last tile may go on
    if held:
        yield made(pa.Table.from_batches(held), np.zeros(1, "int64"))


def map_tiles(tiled: DataFrame, work: TileWork, schema: str) -> DataFrame:
    """Rows that ``work`` makes of whole tiles, with the ``image_id`` of the tile; ``tiled(image_id, ty, tx, ...)`` holds numbers without nulls.

    Partitions are sorted by tile and stream by in batches that are cut behind the last whole tile, so many small tiles cost one call.
    A task holds one batch and one tile.
    """
    shape = StructType.fromDDL(schema)
    return spread_out(tiled, *TILE).sortWithinPartitions(*TILE).mapInArrow(lambda batches: _whole_tiles(batches, work, shape), shape)


def tile_of_rows(starts: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` rows the number of its tile."""
    return np.repeat(np.arange(len(starts)), np.diff(starts, append=n))


#: Edge of a packed block: its pixels are the bits of a BIGINT.
BLOCK = 8


_AT_BIT = f"cast(pmod(y, {BLOCK}) * {BLOCK} + pmod(x, {BLOCK}) as int)"


def packed(points: DataFrame) -> DataFrame:
    """``(image_id, by, bx, bits)``: a set of pixels as one number per occupied block of 8 x 8, made before the shuffle.

    Bit ``8 * (y % 8) + x % 8`` of ``bits`` stands for the pixel. A dense mask is a few hundred rows an image instead of one per pixel.
    """
    at = [F.floor(F.col(c) / BLOCK).cast("int").alias(n) for c, n in (("y", "by"), ("x", "bx"))]
    return points.select("image_id", *at, F.expr(f"shiftleft(1L, {_AT_BIT})").alias("bit")).groupBy(
        "image_id", "by", "bx").agg(F.bit_or("bit").alias("bits"))


def with_membership(px: DataFrame, mask: DataFrame, name: str) -> DataFrame:
    """``px`` with the boolean ``name``: whether the row's pixel is in ``mask``, which is met in packed blocks.

    A mask is often made of one row per image. Spark's size check sees those rows and not the pixels made of them, so it would take
    the blocks of any number of images for small and gather them at the driver: they are merged, never broadcast.
    """
    at = [F.floor(F.col(c) / BLOCK).cast("int").alias(n) for c, n in (("y", "by"), ("x", "bx"))]
    met = px.select("*", *at).join(packed(mask).hint("merge"), ["image_id", "by", "bx"], "left")
    return met.select(*px.columns, F.coalesce(F.expr(f"(shiftright(bits, {_AT_BIT}) & 1) = 1"), F.lit(False)).alias(name))


def tile_votes(points: DataFrame, offsets: Sequence[tuple[int, int]], extra: Sequence[int] | None = None,
               keep: Sequence[Column | str] = (), edge: int = EDGE) -> DataFrame:
    """Every point at every offset, inside halo tiles: ``(image_id, ty, tx, y, x[, k], <keep>)``.

    Only the points and their halo copies are shuffled (a few percent more rows than points); the
    many votes are made and can be aggregated by ``[*TILE, "y", "x"]`` inside the tile. ``keep`` are
    expressions over the source pixel.
    """
    radius = max(max(abs(dy), abs(dx)) for dy, dx in offsets)
    tiled = halo_tiles(points, radius, edge)
    out = tiled.select(*TILE, "y", "x", *keep, F.explode(offset_array(offsets, extra)).alias("_o"))
    names = [c for c in out.columns if c not in (*TILE, "y", "x", "_o")]
    out = out.select(*TILE, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"),
                     *([F.col("_o.k").alias("k")] if extra is not None else []), *names)
    return out.where(at_home(edge))


def _field(name: str) -> Callable[[Column], Column]:
    return lambda s: s[name]


def canvas_of(grid: DataFrame) -> DataFrame:
    """Height and width of dense grids: one row per image, aggregated map-side first."""
    return grid.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def _all_rows(canvas: DataFrame, halo: int, edge: int) -> DataFrame:
    """``(image_id, ty, tx, y, _lo, _hi)``: every raster row of every halo tile of the canvas."""
    def cells(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / edge).cast("int")))

    def bounds(t: str, n: str) -> tuple[Column, Column]:
        return F.greatest(F.col(t) * edge - halo, F.lit(0)), F.least(F.col(t) * edge + edge + halo, F.col(n)) - 1
    tiles = (canvas.where("h > 0 AND w > 0").select("image_id", F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"))
             .withColumn("ty", cells("h")).withColumn("tx", cells("w")))
    lo, hi = bounds("tx", "w")
    return tiles.select(*TILE, F.explode(F.sequence(*bounds("ty", "h"))).alias("y"), lo.alias("_lo"), hi.alias("_hi"))


def to_strips(grid: DataFrame, halo: int, values: Sequence[str] = ("v",), edge: int = EDGE,
              canvas: DataFrame | None = None, fill: float | None = None) -> DataFrame:
    """``(image_id, ty, tx, y, x0, <value arrays>[, h, w])`` from a grid.

    A grid that holds every pixel needs no ``fill``; a row of it with a gap is an error. With ``fill`` and the
    ``canvas``, pixels that are not in the grid have that value, one value per pixel being given at most.
    """
    packed = F.sort_array(F.collect_list(F.struct("x", *values)))
    strips = halo_tiles(grid.select("image_id", "y", "x", *values), halo, edge).groupBy(*TILE, "y").agg(packed.alias("_p"))
    if fill is None:
        first, last = F.col("_p")[0]["x"], F.element_at("_p", -1)["x"]
        whole = last - first + 1 == F.size("_p")
        x0 = F.when(whole, first).otherwise(F.raise_error(F.lit("a grid with gaps needs a fill value")).cast("int"))
        strips = strips.select(*TILE, "y", x0.alias("x0"), *[F.transform("_p", _field(n)).alias(n) for n in values])
    else:
        if canvas is None:
            raise ValueError("fill needs the canvas")
        rows = _all_rows(canvas, halo, edge).join(strips, [*TILE, "y"], "left")
        given = F.filter(F.coalesce("_p", F.array().cast(strips.schema["_p"].dataType)), lambda p: p["x"].between(F.col("_lo"), F.col("_hi")))
        rows = rows.withColumn("_g", given)

        def filled(n: str) -> Column:
            """Each given value after the fill of the gap before it, and the fill up to the end: one pass over the row."""
            one = F.lit(fill).cast(grid.schema[n].dataType)

            def piece(p: Column, i: Column) -> Column:
                before = F.coalesce(F.when(i > 0, F.get("_g", i - 1)["x"]), F.col("_lo") - 1)
                return F.concat(F.array_repeat(one, p["x"] - before - 1), F.array(p[n]))
            last = F.coalesce(F.get("_g", F.size("_g") - 1)["x"], F.col("_lo") - 1)
            row = F.flatten(F.concat(F.transform("_g", piece), F.array(F.array_repeat(one, F.col("_hi") - last))))
            twice = F.raise_error(F.lit("a pixel of the grid is given twice")).cast(f"array<{grid.schema[n].dataType.simpleString()}>")
            return F.when(F.size(row) == F.col("_hi") - F.col("_lo") + 1, row).otherwise(twice)
        rows = rows.select(*TILE, "y", F.col("_lo").alias("x0"), *[filled(n).alias(n) for n in values])
        strips = spread_out(rows, *TILE)
    if canvas is not None:
        strips = salted_join(strips, canvas, ["image_id"], by=("ty", "tx"))
    return strips


def to_pixels(strips: DataFrame, values: Sequence[str] = ("v",), edge: int = EDGE) -> DataFrame:
    """Unpack strips and drop the halo copies."""
    zipped = F.arrays_zip(*[F.col(n) for n in values])
    out = strips.select(*TILE, "y", "x0", F.posexplode(zipped).alias("_i", "_p"))
    out = out.withColumn("x", F.col("x0") + F.col("_i")).where(at_home(edge))
    return out.select("image_id", "y", "x", *[F.col(f"_p.{n}").alias(n) for n in values])


def rows_around(radius: int) -> "Window":
    return Window.partitionBy(*TILE).orderBy("y").rowsBetween(-radius, radius)


def pool_rows(values: Column, radius: int, reduce: Callable[[Column], Column]) -> Column:
    """Moving ``array_min``/``array_max`` along x, clipped at the raster border."""
    return F.transform(values, lambda _, i: reduce(
        F.slice(values, F.greatest(i - radius, F.lit(0)) + 1, F.least(i, F.lit(radius)) + radius + 1)))


def pool_columns(strips: DataFrame, name: str, radius: int, least: bool) -> DataFrame:
    """Moving minimum or maximum along y, clipped at the raster border."""
    pick = F.least if least else F.greatest
    gathered = strips.withColumn("_rows", F.collect_list(name).over(rows_around(radius)))
    merged = F.aggregate(F.slice("_rows", 2, 2 * radius + 1), F.col("_rows")[0],
                         lambda acc, row: F.zip_with(acc, row, lambda a, b: pick(a, b)))
    return gathered.withColumn(name, merged).drop("_rows")


def pool(strips: DataFrame, name: str, radius: int, least: bool = False) -> DataFrame:
    """Square moving minimum or maximum of ``(2 * radius + 1)`` pixels."""
    reduce = F.array_min if least else F.array_max
    return pool_columns(strips.withColumn(name, pool_rows(F.col(name), radius, reduce)), name, radius, least)


def _padding(start: int, size: int, radius: int, total: int, mirror: bool) -> np.ndarray:
    """Block indices of positions ``start - radius`` onwards beyond a mirrored or repeated border.

    Positions beyond the block are clipped; they only feed halo pixels.
    """
    i = np.arange(start - radius, start + size + radius)
    if mirror:
        i = i % (2 * total)
        i = np.where(i < total, i, 2 * total - 1 - i)
    return np.clip(np.clip(i, 0, total - 1) - start, 0, size - 1)


def _slide(block: np.ndarray, kernel: Sequence[float], start: int, total: int, mirror: bool) -> np.ndarray:
    """Correlate the rows of ``block`` with ``kernel``."""
    n = block.shape[1]
    padded = block[:, _padding(start, n, len(kernel) // 2, total, mirror)]
    out = np.zeros(block.shape)
    for j, weight in enumerate(kernel):
        out += weight * padded[:, j:j + n]
    return out


def convolve(strips: DataFrame, passes: Mapping[str, tuple[Sequence[float], Sequence[float]]], value: str = "v",
             mirror: bool = True, keep: bool = False) -> DataFrame:
    """Separable correlations ``{output: (kernel along x, kernel along y)}``, border mirrored or repeated.

    ``keep`` also returns the input. Needs ``h, w`` and a halo of the longest kernel's radius. Each tile is one bounded numpy block, in
    the partition where the strips already are: weighted sums of a few dozen taps run several
    times faster there than as array expressions.
    """
    key = strips.schema["image_id"].dataType.simpleString()

    def tile(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("y")
        y0, x0, h, w = (rows[c][0].as_py() for c in ("y", "x0", "h", "w"))
        block = rows[value].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows.num_rows, -1)
        ends = pa.array(np.arange(rows.num_rows + 1, dtype="int32") * block.shape[1], pa.int32())
        made: dict[int, np.ndarray] = {}
        out = {c: rows[c].cast(pa.int32()) if c != "image_id" else rows[c] for c in (*TILE, "y", "x0")}
        if keep:
            out[value] = pa.ListArray.from_arrays(ends, pa.array(block.ravel()))
        for name, (along_x, along_y) in passes.items():
            if id(along_x) not in made:
                made[id(along_x)] = _slide(block, along_x, x0, w, mirror)
            done = _slide(made[id(along_x)].T, along_y, y0, h, mirror).T
            out[name] = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(done).ravel()))
        return pa.table(out)

    schema = f"image_id {key}, ty int, tx int, y int, x0 int, " + ", ".join(
        f"`{n}` array<double>" for n in [*([value] if keep else []), *passes])
    return strips.select(*TILE, "y", "x0", value, "h", "w").groupBy(*TILE).applyInArrow(tile, schema)
