"""Micro-rasters with hand-made expectations, tile borders and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixtab.functions.offsets import ellipse
from pixtab.operators import components, distance, graph, metrics, morphology, neighborhood, pixels, thinning


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def cells(df):
    return sorted((r.y, r.x) for r in df.select("y", "x").collect())


LINE5 = [(2, x) for x in range(5)]
PLUS5 = sorted({(2, i) for i in range(5)} | {(i, 2) for i in range(5)})
RING = [(y, x) for y in range(5) for x in range(5) if y in (0, 4) or x in (0, 4)]
LOOP = [(0, 2), (1, 1), (1, 3), (2, 0), (2, 4), (3, 1), (3, 3), (4, 2)]  # no corner, so no special pixel
BLOBS = [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (2, 3), (3, 2), (3, 3)]


def test_specials(points):
    p = points({"line": LINE5, "plus": PLUS5, "ring": RING, "loop": LOOP, "dot": [(7, 7)]})
    got = {r.image_id: (r.endpoints, r.junctions) for r in neighborhood.special_counts(p).collect()}
    assert got == {"line": (2, 0), "plus": (4, 5), "ring": (0, 8), "loop": (0, 0), "dot": (0, 0)}


def test_components_connectivity_and_tiles(points):
    p = points({"a": BLOBS})
    for edge in (2, 3, 256):
        assert rows(components.component_counts(components.label_components(p, True, edge))) == [("a", 1)]
        assert rows(components.component_counts(components.label_components(p, False, edge))) == [("a", 2)]


def test_components_match_brute_force_across_tiles(spark, points):
    rng = random.Random(5)
    pts = sorted({(rng.randrange(24), rng.randrange(24)) for _ in range(260)})
    label = {p: p for p in pts}
    changed = True
    while changed:
        changed = False
        for y, x in pts:
            low = min(label[q] for q in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)) if q in label)
            if low < label[(y, x)]:
                label[(y, x)] = low
                changed = True
    want = sorted(((y, x), (ly << 32) + lx) for (y, x), (ly, lx) in label.items())
    got = components.labels_of(components.label_components(points({"a": pts}), edge=4))
    assert sorted(((r.y, r.x), r.label) for r in got.collect()) == want


def test_one_long_chain_is_one_component(spark):
    e = spark.range(400).select(F.lit("a").alias("image_id"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components.min_labels(e)
    assert got.count() == 401 and got.where("label <> 0").count() == 0


def test_small_largest_and_holes(points):
    p = points({"a": RING + [(9, 9)]})
    assert cells(components.remove_small(p, 2)) == sorted(RING)
    full = components.fill_holes(components.largest_component(p))
    assert cells(full) == [(y, x) for y in range(5) for x in range(5)]
    assert cells(components.fill_holes(points({"a": RING}), edge=2)) == cells(full)


def test_thinning_keeps_topology_and_ignores_tiling(points):
    bar = [(y, x) for y in range(3) for x in range(9)]
    p = points({"bar": bar, "blobs": BLOBS})
    whole = rows(thinning.thin(p))
    assert whole == rows(thinning.thin(p, per_round=1, edge=3))
    bar_px = [(y, x) for i, y, x in whole if i == "bar"]
    assert {y for y, _ in bar_px} == {1}
    counts = dict(rows(components.component_counts(components.label_components(thinning.thin(p)))))
    assert counts == {"bar": 1, "blobs": 1}


def test_branch_lengths_and_pruning(points):
    # a long line with a spur of three pixels leaving it
    t = [(5, x) for x in range(20)] + [(4, 10), (3, 10), (2, 10)]
    p = points({"t": t})
    lengths = {(r.y, r.x): r.length for r in thinning.branch_lengths(p, 50).collect()}
    assert lengths[(2, 10)] == 3
    assert (2, 10) not in cells(thinning.prune(p, 6, 1)) and (5, 0) in cells(thinning.prune(p, 6, 1))


def test_graph_of_a_line_and_a_loop(points):
    p = points({"line": LINE5, "loop": LOOP})
    edges, path = graph.edges_and_points(p)
    assert rows(edges.select("image_id", "length")) == [("line", 5)]
    assert [(r.y, r.x) for r in path.orderBy("seq").collect()] == LINE5
    assert [r.degree for r in graph.degrees(graph.nodes(p), edges).collect()] == [1, 1]
    traces, px = graph.expert_traces(p)
    assert traces.count() == 1 and px.count() == 5


def test_spur_removal(points):
    t = [(5, x) for x in range(20)] + [(4, 10), (3, 10)]
    left = cells(graph.remove_spurs(points({"t": t}), 4.0))
    assert (3, 10) not in left and (5, 0) in left


def test_nearest_distance_matches_brute_force(points):
    rng = random.Random(3)
    a = sorted({(rng.randrange(60), rng.randrange(90)) for _ in range(80)})
    b = sorted({(rng.randrange(60), rng.randrange(90)) for _ in range(25)})
    got = {(r.y, r.x): r.d2 for r in distance.nearest_d2(points({"a": a, "none": [(1, 1)]}), points({"a": b})).collect()}
    assert got == {(y, x): min((y - v) ** 2 + (x - u) ** 2 for v, u in b) for y, x in a}


def test_far_distances_open_few_cells(spark, points):
    rng = random.Random(8)
    a = sorted({(rng.randrange(4096), rng.randrange(4096)) for _ in range(2000)})
    b = sorted({(rng.randrange(4096), rng.randrange(4096)) for _ in range(2000)})
    one, moved = [(4000, 17)], [(y - 2000, x - 3000) for y, x in b]
    asked, there = points({"a": a, "one": a, "moved": a, "none": a[:3]}), points({"a": b + b[:9], "one": one, "moved": moved})

    def want(x, y):
        x, y = np.array(x), np.array(y)
        return {tuple(p): int(((y - p) ** 2).sum(axis=1).min()) for p in x}

    got = {}
    for r in distance.nearest_d2(asked, there).collect():
        got.setdefault(r.image_id, {})[(r.y, r.x)] = r.d2
    assert got == {"a": want(a, b), "one": want(a, one), "moved": want(a, moved)}
    leaves = [distance._leaves(p.where("image_id = 'a'")) for p in (asked, there)]
    opened, cells_asked = distance.opened_cells(*leaves).count(), leaves[0].count()
    assert cells_asked <= opened < 16 * cells_asked  # of 1,900 occupied cells


def test_thinning_goes_on_in_active_tiles_only(points):
    rng = random.Random(2)
    blob = {(y, x) for y in range(40) for x in range(40) if (y - 20) ** 2 + (x - 20) ** 2 < 330}
    specks = {(rng.randrange(-90, 200), rng.randrange(60, 300)) for _ in range(900)}
    p = points({"a": sorted(blob | specks), "b": sorted(blob), "c": [(0, 0)]})
    seen = [(state.count(), state.where("changed").count()) for state in thinning.thinning_rounds(p, per_round=1, edge=8)]
    tiles, changed = seen[0][0], [n for _, n in seen]
    assert len(changed) > 5 and changed[-1] == 0
    # specks are done after a round or two, only the shrinking rims of the blobs go on
    assert all(a >= b for a, b in zip(changed, changed[1:], strict=False)) and max(changed) < tiles / 4 and changed[-2] < changed[0] / 2
    assert rows(thinning.thin(p, per_round=1, edge=8)) == rows(thinning.thin(p, per_round=3)) == rows(thinning.thin(p, edge=5))
    assert thinning.thin(points({"a": [(0, 0)]}).limit(0)).count() == 0


@pytest.mark.parametrize("h,w,nh,nw", [(13, 17, 29, 5), (40, 30, 6, 7), (1, 9, 4, 9), (5, 5, 5, 5)])
def test_resampling_in_tiles_matches_brute_force(spark, h, w, nh, nw):
    rng = random.Random(h)
    src = {(y, x): rng.randrange(256) for y in range(h) for x in range(w) if rng.random() < 0.8}
    if h == 40:
        src |= {p: None for p in list(src)[::3]}
    grid = spark.createDataFrame([("a", y, x, v) for (y, x), v in src.items()], "image_id string, y int, x int, v int")
    canvas = spark.createDataFrame([("a", h, w, nh, nw)], "image_id string, h int, w int, nh int, nw int")
    near, blend = {}, {}
    for ty in range(nh):
        for tx in range(nw):
            at = min(math.floor(ty * (h / nh)), h - 1), min(math.floor(tx * (w / nw)), w - 1)
            if at in src:
                near[ty, tx] = src[at]
            fy, fx = (ty + 0.5) * (h / nh) - 0.5, (tx + 0.5) * (w / nw) - 0.5
            by, bx = math.floor(fy), math.floor(fx)
            taps = [((min(max(by + i, 0), h - 1), min(max(bx + j, 0), w - 1)), abs(1 - i - fy + by) * abs(1 - j - fx + bx))
                    for i in (0, 1) for j in (0, 1)]
            taps = [(src[p], k) for p, k in taps if p in src]
            if taps:
                blend[ty, tx] = None if all(v is None for v, _ in taps) else sum(v * k for v, k in taps if v is not None)
    assert {(r.y, r.x): r.v for r in pixels.resample(grid, canvas, nearest=True).collect()} == near
    for edge in (4, 256):
        got = {(r.y, r.x): r.v for r in pixels.resample(grid, canvas, edge=edge).collect()}
        assert got.keys() == blend.keys() and all((got[p] is None) == (blend[p] is None) for p in got)
        assert all(got[p] == pytest.approx(blend[p]) for p in got if got[p] is not None)


def test_distance_maps(spark, points):
    canvas = spark.createDataFrame([("a", 3, 4), ("empty", 2, 2)], "image_id string, h int, w int")
    d = distance.clipped_distance(points({"a": [(0, 0)]}), canvas, 2.0)
    v = {(r.image_id, r.y, r.x): r.v for r in d.collect()}
    assert v[("a", 0, 1)] == 1.0 and v[("a", 2, 3)] == 2.0 and v[("empty", 1, 1)] == 2.0 and len(v) == 16
    exact = {(r.y, r.x): r.v for r in distance.distance_map(points({"a": [(0, 0)]}), canvas).where("image_id = 'a'").collect()}
    assert exact[(2, 3)] == pytest.approx(13 ** 0.5)


def test_empty_set_conventions(spark, points):
    canvas = spark.createDataFrame([("e", 3, 4), ("one", 3, 4)], "image_id string, h int, w int")
    pred, gt = points({"one": [(0, 0)]}), points({"one": [(0, 0)]}).where("y < 0")
    f = {r.image_id: r for r in metrics.tolerant_f1(pred, gt, (1,), canvas).collect()}
    assert f["e"].f1_1px == 1.0 and f["one"].f1_1px == 0.0
    p = {r.image_id: r.f1 for r in metrics.plain_f1(pred, gt, 2, canvas).collect()}
    assert p == {"e": 0.0, "one": 0.0}
    assert {r.image_id: r.hd95 for r in metrics.hd95(pred, gt, canvas).collect()} == {"e": 0.0, "one": 5.0}


def test_shifted_line(spark, points):
    gt, pred = points({"a": [(y, 5) for y in range(9)]}), points({"a": [(y, 7) for y in range(9)]})
    r = metrics.tolerant_f1(pred, gt).first()
    assert (r.f1_1px, r.f1_2px, r.f1_3px) == (0.0, 1.0, 1.0)
    assert metrics.hd95(pred, gt, spark.createDataFrame([("a", 9, 9)], "image_id string, h int, w int")).first().hd95 == 2.0


def test_f1_is_symmetric_and_grows_with_tolerance(points):
    rng = random.Random(11)
    a = points({"a": sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(60)})})
    b = points({"a": sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(60)})})
    x, y = metrics.tolerant_f1(a, b).first(), metrics.tolerant_f1(b, a).first()
    for t in (1, 2, 3):
        assert x[f"f1_{t}px"] == pytest.approx(y[f"f1_{t}px"]) and x[f"precision_{t}px"] == y[f"recall_{t}px"]
    assert x.precision_1px <= x.precision_2px <= x.precision_3px


def test_morphology_order_and_tiles(spark, points):
    rng = random.Random(2)
    pts = sorted({(rng.randrange(20), rng.randrange(20)) for _ in range(230)})
    canvas = spark.createDataFrame([("a", 20, 20)], "image_id string, h int, w int")
    p, shape = points({"a": pts}), morphology.disk_spans(1)
    closed, opened = set(cells(morphology.close(p, shape, canvas))), set(cells(morphology.open_(p, shape, canvas)))
    assert opened <= set(pts) <= closed
    for size in (3, 4, 5):
        tiled = morphology.ellipse_spans(size)
        free = morphology.ellipse_spans_of(F.lit(size))
        assert cells(morphology.erode(p, tiled, canvas)) == cells(morphology.erode(p, free, canvas))
        assert cells(morphology.dilate(p, tiled, canvas)) == cells(morphology.dilate(p, free, canvas))
        off = ellipse(size)
        want = [(y, x) for y in range(20) for x in range(20) if all(
            not (0 <= y + a < 20 and 0 <= x + b < 20) or (y + a, x + b) in set(pts) for a, b in off)]
        assert cells(morphology.erode(p, tiled, canvas)) == want


def test_chains_across_tiles_are_contracted_first(spark, points, monkeypatch):
    wave = [(40 + round(30 * math.sin(x / 9)), x) for x in range(400)]
    joined = {p for (y0, x), (y1, _) in zip(wave, wave[1:]) for p in [(y, x) for y in range(min(y0, y1), max(y0, y1) + 1)]}
    ring = [(y, x) for y in range(100, 141) for x in range(10, 51) if y in (100, 140) or x in (10, 50)]
    px = points({"a": sorted(joined), "b": [(5, x) for x in range(90)] + [(y, 45) for y in range(6, 70)], "c": ring})
    px = thinning.thin(px)
    want, want_path = (sorted(map(tuple, df.collect())) for df in graph.edges_and_points(px))
    rows = []
    real = graph.contracted

    def spy(states, edge):
        local, entries = real(states, edge)
        rows.append((states.count(), entries.count(), sum(1 for r in states.select("a", "b").collect()
                     if (r["a"] >> 32) // edge != (r["b"] >> 32) // edge or (r["a"] & 0xFFFFFFFF) // edge != (r["b"] & 0xFFFFFFFF) // edge)))
        return local, entries
    monkeypatch.setattr(graph, "contracted", spy)
    got, got_path = (sorted(map(tuple, df.collect())) for df in graph.edges_and_points(px, edge=16))
    assert want and got == want and got_path == want_path
    states, entries, crossings = rows[0]
    assert 0 < entries <= crossings < states / 5  # only where a chain enters a tile
