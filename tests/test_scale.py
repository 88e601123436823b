"""What large tables must not do: broadcast or shuffle a row per pixel, or cost one Python call per small tile."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixtab.functions import keys, strips
from pixtab.operators import components, distance, filters, morphology, patches, seeds, steplog


def plan(df):
    return df._jdf.queryExecution().toString()


def image(spark, side=30):
    return spark.range(side * side).selectExpr("0 AS image_id", f"cast(id div {side} as int) AS y", f"cast(id % {side} as int) AS x", "cast(id as double) AS v")


def test_pixels_of_tiles_are_not_broadcast(spark):
    grid, canvas = image(spark), spark.createDataFrame([(0, 30, 30)], "image_id int, h int, w int")
    px = patches.pixels_in(grid, patches.tile_cover(canvas, 24, 10), 24)
    assert "Broadcast" not in plan(px) and px.columns == ["image_id", "ty", "tx", "y", "x", "v"]
    want = {(ty, tx, y, x) for ty in (0, 6) for tx in (0, 6) for y in range(ty, ty + 24) for x in range(tx, tx + 24)}
    got = px.collect()
    assert len(got) == len(want) and {(r.ty, r.tx, r.y, r.x) for r in got} == want and all(r.v == r.y * 30 + r.x for r in got)


def test_clipped_distance_shuffles_no_canvas_pixels(spark, points):
    canvas = spark.createDataFrame([("a", 20, 33), ("b", 3, 2), ("c", 0, 5), (None, 1, 2)], "image_id string, h int, w int")
    pts = [(0, 0), (7, 31), (-1, 20), (19, 34)]
    d = distance.clipped_distance(points({"a": pts, "c": [(0, 0)]}), canvas, 2.5, edge=8)
    assert plan(d).split("== Physical Plan ==")[1].count("Exchange") <= 3
    got = {(r.image_id, r.y, r.x): r.v for r in d.collect()}
    want = {("a", y, x): min([2.5, *(np.hypot(y - p, x - q) for p, q in pts)]) for y in range(20) for x in range(33)}
    want |= {("b", y, x): 2.5 for y in range(3) for x in range(2)} | {(None, 0, x): 2.5 for x in range(2)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_masks_are_packed_before_the_shuffle(spark, points):
    mask = points({"a": [(y, x) for y in range(-9, 25) for x in range(-9, 40) if (y + x) % 3], "b": [(0, 0)]})
    blocks = strips.packed(mask.unionAll(mask))
    assert blocks.count() == 6 * 7 - 2 + 1  # two corners are empty
    steps = points({"a": [(y, x) for y in range(-12, 28) for x in range(-12, 44)], "b": [(0, 0), (0, 1)], None: [(0, 0)]})
    got = strips.with_membership(steps, mask, "_in")
    there = {(r.image_id, r.y, r.x) for r in mask.collect()}
    assert got.columns == [*steps.columns, "_in"] and all(r._in == ((r.image_id, r.y, r.x) in there) for r in got.collect())
    log = steps.withColumn("step", F.lit(0))
    canvas = spark.createDataFrame([("a", 60, 60), ("b", 9, 9)], "image_id string, h int, w int")
    ok = steplog.with_validity(log, canvas, 0, mask)
    assert {(r.image_id, r.y, r.x) for r in ok.where("is_valid").collect()} == {p for p in there if p[1] >= 0 and p[2] >= 0}
    assert ok.select("is_valid").where("is_valid IS NULL").count() == 0


def ran(df):
    """The physical plan as adaptive execution has changed it by the end."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_masks_made_of_few_rows_are_not_broadcast(spark):
    """Twenty rows of canvas look small to Spark, whatever is made of them."""
    rows = keys.spread_out(spark.range(20).withColumnRenamed("id", "image_id"), "image_id")
    mask = rows.selectExpr("image_id", "explode(sequence(0, 63)) AS y").selectExpr("image_id", "y", "explode(sequence(8, 39)) AS x")
    px = spark.range(4000).selectExpr("id % 25 AS image_id", "cast(id % 64 as int) AS y", "cast(id % 50 as int) AS x")
    out = strips.with_membership(px, mask, "_in")
    assert "Broadcast" not in ran(out)
    assert all(r._in == (r.image_id < 20 and 8 <= r.x < 40) for r in out.collect()) and out.count() == 4000


def test_repeated_rows_count_for_the_size_check(spark):
    """16 copies of 40,000 rows are over Spark's limit of 10 MB; those of ten rows are not."""
    big = spark.range(50_000).selectExpr("id AS k", "cast(id as int) AS step")
    small = spark.range(40_000).selectExpr("id AS k", "id * 2 AS v").groupBy("k").agg(F.max("v").alias("v"))
    out = keys.salted_join(big, small, ["k"], how="left", by=("step",))
    assert "BroadcastHashJoin" not in ran(out)
    assert out.count() == 50_000 and out.where("v = 2 * k").count() == 40_000 and out.where("v IS NULL").count() == 10_000
    assert "BroadcastHashJoin" in ran(keys.salted_join(big, small.where("k < 10"), ["k"], by=("step",)))


@pytest.mark.parametrize("element", [lambda: morphology.square_spans(2), lambda: morphology.ellipse_spans(5)])
def test_eroded_mask_at_places_is_that_of_erode(spark, points, element):
    shape = element()
    mask = points({"a": [(y, x) for y in range(20) for x in range(25) if (y * 7 + x * 5) % 41], "b": [(1, 1)]})
    canvas = spark.createDataFrame([("a", 20, 25), ("b", 6, 6)], "image_id string, h int, w int")
    places = points({"a": [(y, x) for y in range(20) for x in range(25)], "b": [(1, 1)]})
    got = morphology.whole_around(places, mask, shape, canvas, edge=8).where("inside").select("image_id", "y", "x").collect()
    want = morphology.erode(mask, shape, canvas).collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_sparse_peaks_are_those_of_all_pixels(spark):
    rng = np.random.default_rng(3)
    rows = [("a", int(y), int(x), float(rng.integers(1, 9)) / 8) for y, x in {tuple(p) for p in rng.integers(0, 40, (500, 2)).tolist()}]
    heat = spark.createDataFrame([*rows, ("b", 1, 1, 0.2), (None, 1, 1, 0.9)], "image_id string, y int, x int, v double")
    canvas = spark.createDataFrame([("a", 40, 40), ("b", 8, 8), ("c", 4, 4)], "image_id string, h int, w int")
    got = seeds.select_peaks(heat, canvas, 0.3, 2, 5000, exclude_border=False, edge=16)
    dense = seeds._dense_peaks(heat, canvas, 2, 16).where("v > 0.3")
    at = lambda df: sorted((r.image_id, r.y, r.x) for r in df.select("image_id", "y", "x").collect())
    assert at(got.where("image_id = 'a'")) == at(dense) and len(at(dense)) > 10
    assert at(got.where("image_id <> 'a'")) == [("b", 4, 4), ("c", 2, 2)]
    with pytest.raises(Exception, match="given twice"):
        seeds.select_peaks(heat.unionAll(heat), canvas, 0.3, 2, 5, edge=16).collect()


def test_tiles_come_whole_and_many_at_once(spark, points):
    px = points({f"i{k}": [(y, x) for y in range(9) for x in range(9)] for k in range(300)})
    tiled = components._tiled(px, 4)

    def work(own, starts):
        size = np.diff(starts, append=len(own["y"]))
        return starts, {"n": size, "calls": np.full(len(starts), len(starts))}
    out = strips.map_tiles(tiled, work, "image_id string, n int, calls int").collect()
    assert len(out) == 300 * 9 and sum(r.n for r in out) == 300 * 81 and max(r.calls for r in out) > 100
    assert "FlatMapGroupsInPandas" not in plan(components.label_components(px, edge=4).pixels)
    found = components.labels_of(components.label_components(px, edge=4)).groupBy("image_id").agg(F.count_distinct("label").alias("n"))
    assert found.where("n = 1").count() == 300


def test_vesselness_steps_work_on_runs_regions_and_arrays(spark):
    side, px = 19, [(y, x) for y in range(19) for x in range(19) if (y * 7 + x * 3) % 11 and (y, x) != (9, 9)]
    mask = spark.createDataFrame([(0, y, x) for y, x in px], "image_id int, y int, x int")
    canvas = spark.createDataFrame([(0, side, side)], "image_id int, h int, w int")
    sized = morphology.erode(mask, morphology.ellipse_spans_of(F.rint(F.col("h") / 6).cast("int")), canvas)
    physical = plan(sized).split("== Physical Plan ==")[1]
    assert physical.count("Window [") == 1 and "min(x" in physical  # runs are aggregated, no window for each pixel's run
    assert {tuple(r) for r in sized.collect()} == {tuple(r) for r in morphology.erode(mask, morphology.ellipse_spans(3), canvas).collect()}
    near = [(dy, x) for dy, lo, hi in morphology.ellipse_spans(3).rows for x in range(lo, hi + 1)]
    want = {(0, y, x) for y, x in px if all((y + a, x + b) in px or not (0 <= y + a < side and 0 <= x + b < side) for a, b in near)}
    assert {tuple(r) for r in sized.collect()} == want and want
    assert "Pandas" not in plan(filters.gaussian(image(spark), 1.0))
    assert "Window" not in plan(filters.clahe(image(spark).withColumn("v", F.col("v") % 256)))
