"""Files in, tables out: images, registry, stored centerlines, CSV reports, streams and plan shape."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from pixtab import schemas
from pixtab.functions.lineage import materialize
from pixtab.operators import filters, neighborhood, patches, splits, steplog
from pixtab.plans.expert import expert_rows
from pixtab.sources import images, manifest, registry, tables
from pixtab.streaming import episodes


def png(path, rows):
    h, w = len(rows), len(rows[0])
    raw = b"".join(b"\0" + bytes(v for px in row for v in px) for row in rows)
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                     + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_to_pixels(spark, tmp_path):
    png(tmp_path / "a.png", [[(255, 0, 0), (0, 255, 0)], [(0, 0, 255), (200, 200, 200)]])
    src = images.read_images(spark, str(tmp_path), "*.png")
    px = {(r.y, r.x): (r.r, r.g, r.b) for r in images.unpack_pixels(src).collect()}
    assert px == {(0, 0): (255, 0, 0), (0, 1): (0, 255, 0), (1, 0): (0, 0, 255), (1, 1): (200, 200, 200)}
    gray = {(r.y, r.x): r.v for r in images.load_gray(spark, str(tmp_path), "*.png").collect()}
    assert gray == {(0, 0): 76, (0, 1): 150, (1, 0): 29, (1, 1): 200}
    assert images.undecodable(src).count() == 0
    assert manifest.list_files(spark, str(tmp_path), "*.png").first().name == "a.png"


def test_registry_last_one_wins(spark):
    r = registry.registry(spark, [("my-data", "i", "v", "*.png", ".png", None, None, None, None, None),
                                  ("MY_DATA", "j", "v", "*.png", ".png", None, None, None, None, None)])
    rows = {x.name: x for x in r.collect()}
    assert len(rows) == 12 and rows["MY_DATA"].image_dir == "j"
    assert rows["DRHAGIS"].vessel_dir == rows["DR_HAGIS"].vessel_dir == "Manual_Segmentations"


def test_double_suffix_and_prefix_rules(spark):
    f = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    flat = f("im0001.ppm", "im0001.ah.ppm")
    got = manifest.discover(flat, flat, None, ".ah.ppm").collect()
    assert [(r.image_id, r.vessel_path, r.mask_path) for r in got] == [("im0001", "im0001.ah.ppm", None)]
    d = manifest.discover(f("21_training.tif"), f("21_manual1.gif"), f("21_training_mask.gif"), ".gif", "_mask.gif", "drive").first()
    assert (d.vessel_path, d.mask_path) == ("21_manual1.gif", "21_training_mask.gif")
    with pytest.raises(Exception, match="no mask for image 22"):
        manifest.pair_by_prefix(f("22_training.tif"), f("21_mask.gif"), f("22_manual1.gif")).collect()
    with pytest.raises(Exception, match="differ in length"):
        manifest.pair_by_position(f("a", "b"), f("c", "d"), f("e")).collect()


def test_centerlines_are_computed_once(spark, tmp_path):
    path, asked = str(tmp_path / "cl"), []
    m = tables.with_params(spark.createDataFrame([("D", "1"), ("D", "2")], "dataset string, image_id string"), min_size=5)

    def compute(todo):
        asked.append(sorted(r.image_id for r in todo.collect()))
        return todo.select("dataset", "image_id", "params_hash", F.lit(0).alias("y"), F.lit(0).alias("x"))

    assert tables.update_centerlines(m.where("image_id = '1'"), path, compute).count() == 1
    assert tables.update_centerlines(m, path, compute).count() == 2
    assert asked == [["1"], ["2"]]


def test_csv_report_has_fixed_columns(spark, tmp_path):
    path = str(tmp_path / "report")
    m = spark.createDataFrame([("a", 0.5, None), ("b", 0.25, 3.0)], "image_id string, f1_1px double, hd95 double")
    tables.write_report(m.where("image_id = 'a'"), path)
    tables.write_report(m.where("image_id = 'b'"), path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == tables.REPORT_COLUMNS
    assert {r.image_id: (r.f1_1px, r.hd95, r.cldice) for r in back.collect()} == {"a": ("0.5", None, None), "b": ("0.25", "3.0", None)}


def test_schema_guard(spark):
    with pytest.raises(ValueError, match="lacks"):
        schemas.require(spark.range(1), "points")


def test_start_falls_back_to_fov_then_centre(spark, points):
    canvas = spark.createDataFrame([(i, 9, 9) for i in ("line", "fov", "none")], "image_id string, h int, w int")
    line = points({"line": [(2, 2), (2, 3), (2, 4)]})
    got = {r.image_id: (r.y, r.x) for r in splits.start_positions(line, points({"fov": [(6, 1), (7, 7)]}), canvas).collect()}
    assert got == {"line": (2, 2), "fov": (6, 1), "none": (4, 4)}
    seeded = splits.start_positions(line, points({"fov": [(6, 1)]}), canvas, seed=3).where("image_id = 'line'").first()
    assert (seeded.y, seeded.x) in {(2, 2), (2, 4)}


def test_random_tiles_prefer_content(spark, points):
    canvas = spark.createDataFrame([("a", 64, 64), ("small", 8, 8)], "image_id string, h int, w int")
    p = points({"a": [(y, x) for y in range(64) for x in range(64) if (y + x) % 2]})
    t = {r.image_id: r for r in patches.random_tiles(p, canvas, 16, seed=1).collect()}
    assert t["a"].points > 10 and 0 <= t["a"].ty < 48 and (t["small"].ty, t["small"].tx) == (0, 0)
    cut = patches.crop_tiles(p, spark.createDataFrame([("a", 0, 0, 0)], "image_id string, sample int, ty int, tx int"), 16)
    assert cut.count() == 128


def test_filters_do_not_depend_on_tiles(spark):
    grid = spark.range(40 * 50).select(F.lit("a").alias("image_id"), (F.col("id") / 50).cast("int").alias("y"),
                                       (F.col("id") % 50).cast("int").alias("x"), (F.xxhash64("id") % 256).cast("double").alias("v"))
    grid = materialize(grid)
    rows = lambda df: sorted((r.y, r.x, round(r.v, 9)) for r in df.collect())
    for f in (lambda e: filters.gaussian(grid, 1.5, edge=e), lambda e: filters.median(grid.withColumn("v", F.col("v").cast("int")), 5, edge=e),
              lambda e: filters.soft_skeleton(grid, 2, edge=e)):
        assert rows(f(16)) == rows(f(256))


def test_consecutive_repeats_are_dropped(spark):
    t = spark.createDataFrame([("a", 0, s, y, 0) for s, y in enumerate((1, 1, 2, 2, 3))], "image_id string, trace_id int, seq int, y int, x int")
    assert [r.y for r in steplog.without_repeats(t).orderBy("seq").collect()] == [1, 2, 3]


def test_expert_rows_of_a_bar(spark, points):
    bar = points({"a": [(y, x) for y in range(10, 13) for x in range(5, 40)]})
    canvas = spark.createDataFrame([("a", 64, 64)], "image_id string, h int, w int")
    rows = expert_rows(bar, canvas, 2, 10, 4).orderBy("order").collect()
    assert {r.action for r in rows} == {2} and [r.order for r in rows] == list(range(1, len(rows) + 1))
    assert [r.split for r in rows].count("train") == int(0.9 * len(rows))


def test_stream_stages_keep_state_across_batches(spark, tmp_path):
    path = str(tmp_path / "log")
    for part in range(3):
        spark.createDataFrame([("r", part * 4 + i, 1) for i in range(4)], "run string, idx int, success int").coalesce(1).write.mode("append").parquet(path)
    stages = [("a", 0, 0.5, 5), ("b", 0, 0.5, 5), ("c", 0, 0.5, 5)]
    got = episodes.drain(episodes.stage_states(episodes.read_log(spark, path, files_per_trigger=1), stages), ["run"]).first()
    assert (got.stage, got.episodes, got.successes) == (2, 2, 2)


def test_neighbour_counts_shuffle_once(spark, points):
    plan = neighborhood.neighbour_counts(points({"a": [(0, 0)]}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "BroadcastNestedLoopJoin" not in plan
