"""Blocked scans, ranks and folds must not depend on where blocks end."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixtab.functions import strips as st
from pixtab.functions.keys import ranked
from pixtab.functions.scan import neighbour, rolling_mean, running
from pixtab.operators import curriculum, distance, returns, steplog
from pixtab.operators.augment import ACTION_REMAP, remap_action, transform_points


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(1)
    data = [(e, t, rng.randrange(-5, 6)) for e in ("a", "b") for t in range(37)]
    return spark.createDataFrame(data, "episode string, step int, v int"), data


@pytest.mark.parametrize("bits", [0, 2, 16])
def test_running_values(log, bits):
    df, data = log
    out = running(df, ["episode"], "step", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, bits=bits)
    before = running(df, ["episode"], "step", {"lo": ("min", F.col("v"))}, exclusive=True, bits=bits)
    got = {(r.episode, r.step): (r.s, r.m) for r in out.collect()}
    low = {(r.episode, r.step): r.lo for r in before.collect()}
    for e, t, _ in data:
        seen = [v for f, u, v in data if f == e and u <= t]
        assert got[(e, t)] == (sum(seen), max(seen))
        assert low[(e, t)] == (min(seen[:-1]) if t else None)


@pytest.mark.parametrize("bits", [0, 3])
def test_neighbours_and_rolling_mean(log, bits):
    df, data = log
    v = {(e, t): x for e, t, x in data}
    for ahead, d in ((False, -1), (True, 1)):
        got = {(r.episode, r.step): r.n for r in neighbour(df, ["episode"], "step", {"n": "v"}, ahead, bits).collect()}
        assert got == {(e, t): v.get((e, t + d)) for e, t, _ in data}
    got = {(r.episode, r.step): r.m for r in rolling_mean(df, ["episode"], "step", 5, {"m": "v"}, bits=3).collect()}
    for e, t, _ in data:
        w = [v[(e, u)] for u in range(max(0, t - 4), t + 1)]
        assert got[(e, t)] == pytest.approx(sum(w) / len(w))


def test_ranks_of_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("k"), (F.col("id") * 7919 % 5000).alias("o"))
    got = ranked(df, ["k"], ["o"], "rn", total="n").collect()
    for key in ("cold", "hot"):
        mine = sorted((r.o, r.rn, r.n) for r in got if r.k == key)
        assert [r for _, r, _ in mine] == list(range(1, len(mine) + 1)) and {n for _, _, n in mine} == {len(mine)}


@pytest.mark.parametrize("gamma,lam", [(0.99, 0.95), (1.0, 1.0), (0.5, 0.1), (0.9, 0.0)])
def test_advantages_over_many_blocks(spark, gamma, lam):
    rng = random.Random(9)
    data = [("e", t, rng.random(), rng.random(), int(rng.random() < 0.002)) for t in range(1500)]
    df = spark.createDataFrame(data, "episode string, step int, reward double, value double, done int")
    boot = spark.createDataFrame([("e", 0.7)], "episode string, last_value double")
    got = {r.step: r.advantage for r in returns.advantages(df, ["episode"], gamma=gamma, lam=lam, bootstrap=boot).collect()}
    a, nxt = 0.0, 0.7
    for _, t, r, v, d in reversed(data):
        a = r + gamma * nxt * (1 - d) - v + gamma * lam * (1 - d) * a
        nxt = v
        assert got[t] == pytest.approx(a, abs=1e-8)


def test_stages_match_a_sequential_walk(spark):
    rng = random.Random(4)
    stages = [("a", 0, 0.5, 4), ("b", 0, 0.5, 6), ("c", 0, 0.9, 5), ("d", 0, 0, 1)]
    data = [(run, i, int(rng.random() < 0.55)) for run in ("x", "y", "z") for i in range(60)]
    df = spark.createDataFrame(data, "run string, idx int, success int")
    got = {(r.run, r.idx): r.stage for r in curriculum.stage_history(df, stages).collect()}
    state = {}
    for run, i, ok in data:
        s, n, w = state.get(run, (0, 0, 0))
        n, w = n + 1, w + ok
        if s < 3 and n >= stages[s][3] and w / n >= stages[s][2]:
            s, n, w = s + 1, 0, 0
        state[run] = (s, n, w)
        assert got[(run, i)] == s


def test_four_quarter_turns_are_the_identity(spark, points):
    canvas = spark.createDataFrame([("a", 5, 7)], "image_id string, h int, w int")
    p, h, w = points({"a": [(0, 1), (4, 6), (2, 3)]}), 5, 7
    for _ in range(4):
        turned = transform_points(p, spark.createDataFrame([("a", h, w)], "image_id string, h int, w int")).where("transform = 'rot90'")
        p, (h, w) = turned.select(F.lit("a").alias("image_id"), "y", "x"), (w, h)
    assert sorted((r.y, r.x) for r in p.collect()) == [(0, 1), (2, 3), (4, 6)]
    assert canvas.count() == 1


def test_action_remap_equals_turned_moves(spark):
    base = spark.createDataFrame([(a,) for a in range(8)], "a int")
    for name in ACTION_REMAP:
        start = base.select(F.concat(F.lit("i"), "a").alias("image_id"), "a", F.lit(5).alias("y"), F.lit(5).alias("x"))
        end = start.withColumn("y", F.col("y") + steplog.move_dy(F.col("a"))).withColumn("x", F.col("x") + steplog.move_dx(F.col("a")))
        canvas = start.select("image_id", F.lit(11).alias("h"), F.lit(11).alias("w"))
        s = transform_points(start, canvas).where(F.col("transform") == name).select("a", F.col("y").alias("y0"), F.col("x").alias("x0"))
        t = transform_points(end, canvas).where(F.col("transform") == name).select("a", "y", "x")
        moved = s.join(t, "a").select("a", steplog.action_of(F.col("y") - F.col("y0"), F.col("x") - F.col("x0")).alias("got"),
                                      remap_action(F.col("a"), F.lit(name)).alias("want"))
        assert moved.where("got <> want").count() == 0


def test_advantages_of_one_long_rollout(spark):
    n, gamma, lam = 2_000_000, 0.99, 0.95
    df = spark.range(n).select(F.lit(1).alias("episode"), F.col("id").cast("int").alias("step"), (F.col("id") % 7 / 3.0).alias("reward"),
                               (F.col("id") % 5 / 2.0).alias("value"), F.when(F.col("id") % 300_007 == 9, 1).otherwise(0).alias("done"))
    out = returns.advantages(df.repartition(16), ["episode"], gamma=gamma, lam=lam)
    step = np.arange(n)
    reward, value, done = step % 7 / 3.0, step % 5 / 2.0, step % 300_007 == 9
    delta = reward + gamma * np.r_[value[1:], 0.0] * ~done - value
    want, after = np.empty(n), 0.0
    for i in range(n - 1, -1, -1):
        want[i] = after = delta[i] + gamma * lam * (not done[i]) * after
    seen = {r["step"]: r["advantage"] for r in out.where("step % 9973 = 0 or step > 1999990 or step % 300007 between 8 and 11").collect()}
    assert len(seen) > 200 and out.count() == n
    assert all(abs(a - want[s]) < 1e-9 for s, a in seen.items())


def test_filled_strips_of_sparse_rows(spark):
    grid = spark.createDataFrame([("a", 0, 3, 2.0), ("a", 0, 39, 5.0), ("a", 7, 0, 1.0)], "image_id string, y int, x int, v double")
    canvas = spark.createDataFrame([("a", 9, 40), ("b", 2, 3)], "image_id string, h int, w int")
    strips = st.to_strips(grid, 2, edge=16, canvas=canvas, fill=0)
    px = {(r["image_id"], r["y"], r["x"]): r["v"] for r in st.to_pixels(strips, edge=16).collect()}
    assert len(px) == 9 * 40 + 6 and {k: v for k, v in px.items() if v} == {("a", 0, 3): 2.0, ("a", 0, 39): 5.0, ("a", 7, 0): 1.0}
    twice = grid.unionByName(grid)
    with pytest.raises(Exception, match="given twice"):
        st.to_strips(twice, 2, edge=16, canvas=canvas, fill=0).collect()


def test_distances_and_coverage_across_tiles(spark):
    rng = random.Random(4)
    gt = {(rng.randrange(60), rng.randrange(60)) for _ in range(120)}
    walk = [(e, t, rng.randrange(60), rng.randrange(60)) for e in ("a", "b") for t in range(80)]
    steps = spark.createDataFrame([(*w, "i") for w in walk], "episode string, step int, y int, x int, image_id string")
    points = spark.createDataFrame([("i", y, x) for y, x in gt], "image_id string, y int, x int")
    for radius in (2, 2.5, 4):
        want = {(y, x): min((y - a) ** 2 + (x - b) ** 2 for a, b in gt) for _, _, y, x in walk}
        got = {(r["y"], r["x"]): r["d2"] for r in distance.visited_d2(steps, points, radius, edge=16).collect()}
        assert got == {k: d for k, d in want.items() if d <= radius * radius}
        seen = steps.groupBy("episode", "image_id", "y", "x").agg(F.min("step").alias("step"))
        first = {}
        for e, t, y, x in walk:
            for a, b in gt:
                if (y - a) ** 2 + (x - b) ** 2 <= radius * radius:
                    first.setdefault((e, a, b), t)
        count = {}
        for (e, _, _), t in first.items():
            count[e, t] = count.get((e, t), 0) + 1
        reached = {(r["episode"], r["step"]): r["new_coverage"] for r in steplog.first_reached(seen, points, radius, edge=16).collect()}
        assert reached == count
