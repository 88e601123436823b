"""Rows that are easily lost: null keys, empty results, unreadable files, long names, sparse grids, episode ends."""

import pytest
from pyspark.sql import functions as F

from pixtab.functions.keys import first_of_each, ranked, salted_join
from pixtab.functions.scan import rolling_mean
from pixtab.operators import filters, seeds, splits, steplog
from pixtab.plans import replay
from pixtab.sources import images, manifest, tables


def test_null_datasets_are_split_too(spark):
    m = spark.createDataFrame([(None, f"i{k}") for k in range(10)] + [("D", f"i{k}") for k in range(10)], "dataset string, image_id string")
    for split in (splits.three_way, splits.train_val):
        got = {(r.dataset, r.image_id): r.split for r in split(m).collect()}
        assert len(got) == 20 and all(got[None, f"i{k}"] == got["D", f"i{k}"] for k in range(10))
    parts = m.withColumn("part", F.when(F.col("dataset").isNull() & (F.col("image_id") < "i3"), "test").otherwise("train"))
    assert {r.image_id for r in splits.official_test(parts).where("dataset is null").collect()} == {"i0", "i1", "i2"}
    hard = m.withColumn("d", F.substring("image_id", 2, 2).cast("int"))
    assert splits.by_difficulty(hard, F.col("d"), 2, least=5).where("dataset is null").count() == 5


def test_null_keys_meet(spark):
    big = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, y int").withColumn("x", F.col("y"))
    small = spark.createDataFrame([(None, 10), ("a", 20)], "k string, v int")
    assert {(r.y, r.v) for r in salted_join(big, small, ["k"]).collect()} == {(1, 10), (2, 20)}
    assert {(r.y, r.v) for r in salted_join(big, small, ["k"], "left").collect()} == {(1, 10), (2, 20), (3, None)}
    assert [r.y for r in salted_join(big, small, ["k"], "left_anti").collect()] == [3]
    assert salted_join(big, small, ["k"]).columns == ["k", "y", "x", "v"]


def test_ranks_beyond_the_window_limit(spark, monkeypatch):
    df = spark.range(300).select((F.col("id") % 2).alias("k"), "id")
    want = {(r.k, r.id): r.rn for r in ranked(df, ["k"], ["id"]).where("rn <= 40").collect()}
    monkeypatch.setattr("pixtab.functions.keys.FEW", 10)
    assert {(r.k, r.id): r.rn for r in first_of_each(df, ["k"], ["id"], 40).collect()} == want and len(want) == 80


def test_undecodable_images_are_errors(spark, tmp_path):
    (tmp_path / "broken.png").write_bytes(b"not an image")
    src = spark.createDataFrame([("good", 1, 1, 3, bytearray(b"abc")), ("broken", -1, -1, -1, bytearray())],
                                "image_id string, height int, width int, nChannels int, data binary")
    with pytest.raises(Exception, match="cannot decode image broken"):
        images.unpack_pixels(src).collect()
    assert images.unpack_pixels(src, skip_undecodable=True).count() == 1
    assert [r.image_id for r in images.undecodable(src).collect()] == ["broken"]


def test_empty_results_are_computed_once(spark, tmp_path):
    path, asked = str(tmp_path / "cl"), []
    m = tables.with_params(spark.createDataFrame([("D", "1"), ("D", "2")], "dataset string, image_id string"), min_size=5)

    def compute(todo):
        asked.append(sorted(r.image_id for r in todo.collect()))
        return todo.where("image_id = '2'").select("dataset", "image_id", "params_hash", F.lit(0).alias("y"), F.lit(0).alias("x"))
    for n in (0, 1, 1):
        assert tables.update_centerlines(m if n else m.where("image_id = '1'"), path, compute).count() == n
    assert asked == [["1"], ["2"], []]


def test_results_of_a_run_that_did_not_finish_are_made_again(spark, tmp_path):
    path = str(tmp_path / "cl")
    m = tables.with_params(spark.createDataFrame([("D", "1")], "dataset string, image_id string"), min_size=5)

    def compute(todo):
        return todo.select("dataset", "image_id", "params_hash", F.lit(0).alias("y"), F.lit(0).alias("x"))
    compute(m).withColumn("run", F.lit("lost")).write.mode("append").partitionBy("dataset").parquet(path)
    assert tables.update_centerlines(m, path, compute).count() == 1


def test_ids_of_any_length_pair(spark):
    f = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    long = "x" * 90
    got = manifest.pair_by_prefix(f(f"{long}_t.tif", "7_t.tif"), f(f"{long}_mask.gif", "7_mask.gif"), f(f"{long}_1.gif", "7_1.gif")).collect()
    assert {(r.image_id, r.vessel_path) for r in got} == {(long, f"{long}_1.gif"), ("7", "7_1.gif")}


def test_windows_longer_than_a_block(spark):
    df = spark.range(100).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("step"), F.col("id").cast("double").alias("v"))
    got = {r.step: r.m for r in rolling_mean(df, ["k"], "step", 30, {"m": "v"}, bits=3).collect()}
    for i in range(100):
        own = range(max(0, i - 29), i + 1)
        assert got[i] == pytest.approx(sum(own) / len(own))


def test_sparse_grids_keep_their_places(spark):
    canvas = spark.createDataFrame([(1, 70, 90)], "image_id int, h int, w int")
    heat = spark.createDataFrame([(1, 40, 60, 0.9), (1, 40, 20, 0.8), (1, 41, 60, 0.5)], "image_id int, y int, x int, v double")
    for edge in (16, 256):
        got = [(r["rank"], r.y, r.x) for r in seeds.select_peaks(heat, canvas, 0.3, 3, 5, edge=edge).orderBy("rank").collect()]
        assert got == [(1, 40, 60), (2, 40, 20)]
    smooth = {(r.y, r.x): r.v for r in filters.gaussian(heat, 1.0, edge=16, canvas=canvas).collect()}
    assert len(smooth) == 70 * 90 and max(smooth, key=smooth.get) == (40, 60)
    assert {(r.y, r.x) for r in filters.local_maxima(heat, edge=16, canvas=canvas).collect()} >= {(40, 60), (40, 20)}
    with pytest.raises(Exception, match="gaps needs"):
        filters.gaussian(heat, 1.0).collect()


def test_episode_begins_at_its_start(spark):
    gt = spark.createDataFrame([(1, 50, x) for x in range(48, 56)], "image_id int, y int, x int")
    canvas = spark.createDataFrame([(1, 100, 60)], "image_id int, h int, w int")
    starts = spark.createDataFrame([(7, 1, 50, 50)], "episode int, image_id int, y int, x int")
    # east, back to the start, then out of the image
    steps = spark.createDataFrame([(7, 0, 2, 50, 51, 1), (7, 1, 6, 50, 50, 1), (7, 2, 2, 50, 59, 1)],
                                  "episode int, step int, action int, y int, x int, image_id int")
    got = replay.reward_steps(steps, gt, canvas, 2, 1.0, 5.0, 5, 50, starts=starts).orderBy("step").collect()
    assert [r.is_revisit for r in got] == [False, True, False]
    # the start covers x = 49..51, the first step adds 52, the way back nothing, the step outside nothing
    assert [r.new_coverage for r in got] == [1, 0, 0] and [r.covered for r in got] == [4, 4, 4]
    assert [r.reward for r in got] == pytest.approx([1.0 + 2.0 - 0.01, -0.5 - 0.01, -10.0])
    off = spark.createDataFrame([(7, 1, 53, 50)], "episode int, image_id int, y int, x int")
    first = replay.reward_steps(steps, gt, canvas, 2, 1.0, 5.0, 5, 50, starts=off).where("step = 0").first()
    assert first.reward == pytest.approx(1.0 + 2.0 * 3 - 0.01 + 3.0)
    assert steplog.with_revisit(steps).where("is_revisit").count() == 0
