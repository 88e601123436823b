"""Patches, tiles, seeds, losses, summaries, composed plans and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.q_grids import C1, DIMS, ERO, clahe_cte, dims, gauss_cte, rgb, ridge_cte, skel_cte
from checks.q_metrics import HD_CTE, NB_GT, hits
from checks.q_shapes import CLDICE, CLDICE_VALUE, label_cte
from checks.q_steplog import SMALL_STAGES
from checks.registry import query
from pixtab.functions import strips as st
from pixtab.functions.keys import spread_out
from pixtab.functions.lineage import materialize
from pixtab.operators import distance, filters, linking, losses, metrics, patches, seeds, steplog, summaries
from pixtab.plans import centerlines, enhance, evaluation
from pixtab.streaming import episodes

PIXEL = ["image_id", "y", "x"]


def prob_v(spark, sf):
    return fx.prob(spark, sf).select("image_id", "y", "x", "v")


PEAKS = """
, pk AS (SELECT a.image_id, a.y, a.x, CAST(a.image_id AS BIGINT) * 4096 + a.y * 64 + a.x AS anchor_id FROM prob a WHERE NOT EXISTS (SELECT 1 FROM prob b
   WHERE b.image_id = a.image_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.v > a.v))"""
PATCH = """
, pa AS (SELECT anchor_id, image_id, i.k AS dy, j.k AS dx, y + i.k AS py, x + j.k AS px FROM pk, (SELECT unnest(range(-2, 3)) AS k) i, (SELECT unnest(range(-2, 3)) AS k) j)"""


def anchors(spark, sf):
    pk = filters.local_maxima(prob_v(spark, sf))
    return pk.withColumn("anchor_id", F.col("image_id").cast("bigint") * 4096 + F.col("y") * 64 + F.col("x"))


@query("d18_patches", fx.with_views("prob", PEAKS + PATCH + """
SELECT anchor_id, CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx, round(coalesce(v, 0), 6)::DOUBLE AS v FROM pa LEFT JOIN prob g ON g.image_id = pa.image_id AND g.y = py AND g.x = px"""))
def d18(spark, sf):
    return fx.rounded(patches.crop(prob_v(spark, sf), anchors(spark, sf), 2, edge=32))


SLOPES = """
, gr AS (SELECT *, -CASE WHEN lag(v) OVER wy IS NULL THEN lead(v) OVER wy - v WHEN lead(v) OVER wy IS NULL THEN v - lag(v) OVER wy ELSE (lead(v) OVER wy - lag(v) OVER wy) / 2 END AS ry,
     -CASE WHEN lag(v) OVER wx IS NULL THEN lead(v) OVER wx - v WHEN lead(v) OVER wx IS NULL THEN v - lag(v) OVER wx ELSE (lead(v) OVER wx - lag(v) OVER wx) / 2 END AS rx
   FROM pv WINDOW wy AS (PARTITION BY anchor_id, dx ORDER BY dy), wx AS (PARTITION BY anchor_id, dy ORDER BY dx))"""


@query("d17_descent_direction", fx.with_views("prob", PEAKS + PATCH + """
, pv AS (SELECT anchor_id, dy, dx, coalesce(v, 0)::DOUBLE AS v FROM pa LEFT JOIN prob g ON g.image_id = pa.image_id AND g.y = py AND g.x = px)""" + SLOPES + """
SELECT anchor_id, CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx, round(ry / (sqrt(ry*ry + rx*rx) + 1e-8), 6) AS gy, round(rx / (sqrt(ry*ry + rx*rx) + 1e-8), 6) AS gx FROM gr"""))
def d17(spark, sf):
    return fx.rounded(patches.toward(patches.crop(prob_v(spark, sf), anchors(spark, sf), 2)).drop("v"))


@query("d19_observations", fx.with_views("gray8 prob", C1 + PEAKS + PATCH + """
, m AS (SELECT image_id, y, x FROM gray8 WHERE v > 150)
, near AS (SELECT m.image_id, m.y + a.k AS y, m.x + b.k AS x, min(sqrt((a.k*a.k + b.k*b.k)::DOUBLE)) AS d FROM m, (SELECT unnest(range(-3, 4)) AS k) a, (SELECT unnest(range(-3, 4)) AS k) b GROUP BY ALL)
, tb AS (SELECT px.image_id, px.y, px.x, r / 255 AS r, g / 255 AS g, b / 255 AS b, least(coalesce(d, 3), 3) AS d, pk.anchor_id AS first FROM px LEFT JOIN near USING (image_id, y, x) LEFT JOIN pk USING (image_id, y, x))
, pv AS (SELECT anchor_id, dy, dx, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(d, 0)::DOUBLE AS v, CASE WHEN first < anchor_id THEN 1 ELSE 0 END AS visited
    FROM pa LEFT JOIN tb ON tb.image_id = pa.image_id AND tb.y = py AND tb.x = pa.px)""" + SLOPES + """
SELECT anchor_id, CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx, round(r, 6)::DOUBLE AS r, round(g, 6)::DOUBLE AS g, round(b, 6)::DOUBLE AS b, visited::DOUBLE AS visited, round(least(v / 2, 1), 6)::DOUBLE AS dt,
   round(ry / (sqrt(ry*ry + rx*rx) + 1e-8), 6) AS gy, round(rx / (sqrt(ry*ry + rx*rx) + 1e-8), 6) AS gx FROM gr"""))
def d19(spark, sf):
    a = materialize(anchors(spark, sf))
    px = rgb(spark, sf).select(*PIXEL, *[(F.col(c) / 255.0).alias(c) for c in "rgb"])
    d = distance.clipped_distance(fx.gray8(spark, sf).where("v > 150"), dims(spark, sf), 3.0)
    seen = patches.observations(a.withColumn("order", F.col("anchor_id")), px, d, a.select(*PIXEL, F.col("anchor_id").alias("first")), 2, 2.0, edge=32)
    return fx.rounded(patches.unpacked(seen, 2, ["r", "g", "b", "visited", "dt", "gy", "gx"]))


COVER = """
, c AS (SELECT image_id, ty, tx FROM (SELECT image_id, w, unnest(list_distinct(list_append(range(0, h - 24 + 1, 10), greatest(0, h - 24)))) AS ty FROM d) q,
   LATERAL (SELECT unnest(list_distinct(list_append(range(0, w - 24 + 1, 10), greatest(0, w - 24)))) AS tx) r)"""


@query("d20_tile_cover", fx.with_views("raster", DIMS + COVER + "SELECT image_id, CAST(ty AS INT) AS ty, CAST(tx AS INT) AS tx FROM c"))
def d20(spark, sf):
    return patches.tile_cover(dims(spark, sf), 24, 10)


@query("d21_tile_blend", fx.with_views("prob", DIMS.replace("raster", "prob") + COVER + """
, t AS (SELECT c.image_id, ty, tx, y, x, v * (1 + ty / 100) AS v, exp(-2 * (-1 + (y - ty) * 2 / 23::DOUBLE) ** 2) * exp(-2 * (-1 + (x - tx) * 2 / 23::DOUBLE) ** 2) AS k
   FROM c JOIN prob p ON p.image_id = c.image_id AND y BETWEEN ty AND ty + 23 AND x BETWEEN tx AND tx + 23)
SELECT image_id, y, x, round(sum(k * v) / (sum(k) + 1e-8), 6) AS v FROM t GROUP BY ALL"""))
def d21(spark, sf):
    tiles = patches.tile_cover(dims(spark, sf), 24, 10)
    px = patches.pixels_in(prob_v(spark, sf), tiles, 24)
    return fx.rounded(patches.blend_tiles(px.withColumn("v", F.col("v") * (1 + F.col("ty") / 100)), 24))


@query("d22_random_tiles", fx.with_views("points_gt", """
, cand AS (SELECT image_id, s AS sample, k, CAST(CAST('0x' || substr(md5(concat_ws(':', 3, 0, image_id, s, k)), 1, 12) AS BIGINT) % 144 AS INT) AS ty,
     CAST(CAST('0x' || substr(md5(concat_ws(':', 3, 1, image_id, s, k)), 1, 12) AS BIGINT) % 144 AS INT) AS tx
   FROM (SELECT DISTINCT user_id AS image_id FROM events), range(0, 2) AS a(s), range(0, 10) AS b(k))
, n AS (SELECT c.*, (SELECT count(*) FROM points_gt p WHERE p.image_id = c.image_id AND p.y >= ty AND p.y < ty + 48 AND p.x >= tx AND p.x < tx + 48) AS n FROM cand c)
SELECT image_id, CAST(sample AS INT) AS sample, arg_min(ty, r) AS ty, arg_min(tx, r) AS tx, arg_min(n, r) AS points
FROM (SELECT *, CASE WHEN n > 10 THEN k ELSE 20 - k END AS r FROM n) GROUP BY image_id, sample"""))
def d22(spark, sf):
    return patches.random_tiles(fx.points_gt(spark, sf), fx.curve_canvas(spark, sf), 48, per_image=2, seed=3)


HEAT = NB_GT + """
, sp AS (SELECT image_id, y, x FROM n WHERE n = 1 OR n > 2)
, ker AS (SELECT k, exp(-0.5::DOUBLE * (k / 2.0::DOUBLE) ** 2) / sum(exp(-0.5::DOUBLE * (k / 2.0::DOUBLE) ** 2)) OVER () AS g FROM (SELECT unnest(range(-8, 9)) AS k))
, heat AS (SELECT image_id, y + a.k AS y, x + b.k AS x, sum(a.g * b.g) AS v FROM sp, ker a, ker b GROUP BY ALL)"""


@query("f1_seed_heatmap", fx.with_views("points_gt", HEAT + """
SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(v / max(v) OVER (PARTITION BY image_id), 6) AS v FROM heat"""))
def f1(spark, sf):
    return fx.rounded(seeds.seed_heatmap(fx.points_gt(spark, sf), fx.curve_canvas(spark, sf), 2.0))


SQUARE3 = ", disk AS (SELECT a.k AS dy, b.k AS dx FROM (SELECT unnest(range(-1, 2)) AS k) a, (SELECT unnest(range(-1, 2)) AS k) b)"


@query("f2_suppressed_heat", fx.with_views("prob fov", DIMS.replace("raster", "prob") + SQUARE3 + ERO.replace("raster", "prob").format(i="fov", o="e") + """
SELECT p.image_id, p.y, p.x, round(CASE WHEN e.image_id IS NOT NULL AND p.y BETWEEN 6 AND h - 7 AND p.x BETWEEN 6 AND w - 7 THEN v ELSE 0 END, 6)::DOUBLE AS v
FROM prob p JOIN d USING (image_id) LEFT JOIN e ON e.image_id = p.image_id AND e.y = p.y AND e.x = p.x"""))
def f2(spark, sf):
    return fx.rounded(seeds.suppress_border(prob_v(spark, sf), fx.fov(spark, sf), dims(spark, sf), kernel=3, margin=6))


@query("f3_peaks", fx.with_views("prob", DIMS.replace("raster", "prob") + """
, q AS (SELECT image_id, y, x, CASE WHEN image_id = 0 THEN v * 0.5 ELSE v END AS v FROM prob)
, pk AS (SELECT a.* FROM q a JOIN d USING (image_id) WHERE v > 0.7 AND y BETWEEN 3 AND h - 4 AND x BETWEEN 3 AND w - 4 AND NOT EXISTS (SELECT 1 FROM q b WHERE b.image_id = a.image_id
    AND b.y BETWEEN a.y - 3 AND a.y + 3 AND b.x BETWEEN a.x - 3 AND a.x + 3 AND (b.v > a.v OR (b.v = a.v AND (b.y < a.y OR (b.y = a.y AND b.x < a.x))))))
, best AS (SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY v DESC, y, x) AS INT) AS rank, y, x, v FROM pk)
SELECT image_id, rank, y, x, round(v, 6)::DOUBLE AS confidence FROM best WHERE rank <= 12
UNION ALL SELECT image_id, 1, CAST(h // 2 AS INT), CAST(w // 2 AS INT), 0.5::DOUBLE FROM d WHERE image_id NOT IN (SELECT image_id FROM q WHERE v > 0.7)"""))
def f3(spark, sf):
    q = prob_v(spark, sf).withColumn("v", F.when(F.col("image_id") == 0, F.col("v") * 0.5).otherwise(F.col("v")))
    return fx.rounded(seeds.select_peaks(q, dims(spark, sf), 0.7, 3, 12))


@query("f3_peaks_of_heatmap", fx.with_views("points_gt", HEAT + """
, nv AS (SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(v / max(v) OVER (PARTITION BY image_id), 6) AS v0 FROM heat)
, q AS (SELECT image_id, y, x, CASE WHEN x BETWEEN 49 AND 143 AND y BETWEEN 6 AND 185 THEN v0 ELSE 0 END AS v FROM nv)
, pk AS (SELECT a.* FROM q a WHERE v > 0.3 AND NOT EXISTS (SELECT 1 FROM q b WHERE b.image_id = a.image_id
    AND b.y BETWEEN a.y - 5 AND a.y + 5 AND b.x BETWEEN a.x - 5 AND a.x + 5 AND (b.v > a.v OR (b.v = a.v AND (b.y < a.y OR (b.y = a.y AND b.x < a.x))))))
, best AS (SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY v DESC, y, x) AS INT) AS rank, y, x, v FROM pk)
SELECT image_id, rank, y, x, v AS confidence FROM best WHERE rank <= 12
UNION ALL SELECT DISTINCT user_id, 1, 96, 96, 0.5::DOUBLE FROM events WHERE user_id NOT IN (SELECT image_id FROM q WHERE v > 0.3)"""))
def f3_heat(spark, sf):
    """Heatmap, border suppression and peaks one after the other: a heatmap has touched pixels only."""
    canvas = fx.curve_canvas(spark, sf)
    rows = spread_out(canvas, "image_id").selectExpr("image_id", "h", "explode(sequence(48, 144)) AS x")
    fov = rows.selectExpr("image_id", "x", "explode(sequence(0, h - 1)) AS y")
    heat = fx.rounded(seeds.seed_heatmap(fx.points_gt(spark, sf), canvas, 2.0))
    heat = seeds.suppress_border(heat, fov, canvas, kernel=3, margin=6)
    return seeds.select_peaks(heat, canvas, 0.3, 5, 12, exclude_border=False)


RING = DIMS + """
, spans(dy, half) AS (VALUES (-4,0),(-3,3),(-2,3),(-1,4),(0,4),(1,4),(2,3),(3,3),(4,0))
, disk AS (SELECT dy, dx FROM spans, (SELECT unnest(range(-4, 5)) AS dx) WHERE abs(dx) <= half)""" + ERO.format(i="fov", o="er") + """
, ring AS (SELECT image_id, y, x FROM fov ANTI JOIN er USING (image_id, y, x))"""


@query("f4_ring_band", fx.with_views("raster fov", RING + "SELECT image_id, y, x FROM ring"))
def f4(spark, sf):
    return seeds.ring_band(fx.fov(spark, sf), dims(spark, sf), 4)


RINGS = RING + """
, cen AS (SELECT image_id, avg(y) AS cy, avg(x) AS cx FROM fov GROUP BY 1)
, sc AS (SELECT image_id, i, y, x, round((y - cy) * sin(2 * pi() * i / 12) + (x - cx) * cos(2 * pi() * i / 12), 9) AS s FROM ring JOIN cen USING (image_id), (SELECT unnest(range(0, 12)) AS i))
, bst AS (SELECT image_id, i, y, x FROM (SELECT *, row_number() OVER (PARTITION BY image_id, i ORDER BY s DESC, y, x) AS rn FROM sc) WHERE rn = 1)
, rs AS (SELECT image_id, CAST(min(i) AS INT) AS angle, y, x FROM (SELECT image_id, i, least(greatest(y, 8), h - 9) AS y, least(greatest(x, 8), w - 9) AS x FROM bst JOIN d USING (image_id)) GROUP BY ALL)"""


@query("f5_ring_seeds", fx.with_views("raster fov", RINGS + "SELECT image_id, angle, y, x FROM rs"))
def f5(spark, sf):
    return seeds.ring_seeds(fx.fov(spark, sf), dims(spark, sf), 12, 4, 6)


@query("f6_merged_seeds", fx.with_views("raster fov prob", RINGS + """
, det AS (SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY v DESC, y, x) AS INT) AS rank, y, x FROM prob)
, f AS (SELECT * FROM det WHERE rank <= 20 - 12)
SELECT image_id, 'detector' AS source, rank AS place, y, x FROM f
UNION ALL SELECT image_id, 'ring', angle, y, x FROM rs WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.image_id = rs.image_id AND abs(f.y - rs.y) + abs(f.x - rs.x) < 9)"""))
def f6(spark, sf):
    det = seeds.select_peaks(prob_v(spark, sf), dims(spark, sf), -1.0, 0, 20, exclude_border=False)
    return seeds.merge_seeds(det, seeds.ring_seeds(fx.fov(spark, sf), dims(spark, sf), 12, 4, 6), 20, 12, 9)


FRONT = """
, cov AS (SELECT DISTINCT image_id, y, x FROM traces WHERE trace_id < 2 AND image_id > 3)
, lft AS (SELECT g.* FROM points_gt g ANTI JOIN cov USING (image_id, y, x))
, dd AS (SELECT l.image_id, l.y, l.x, min((l.y-c.y)*(l.y-c.y) + (l.x-c.x)*(l.x-c.x)) AS d2 FROM lft l JOIN cov c USING (image_id) GROUP BY ALL)
, pick AS (SELECT image_id, y, x FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY d2 DESC, y, x) AS rn FROM dd) WHERE rn = 1
   UNION ALL SELECT image_id, y, x FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY (y-96)*(y-96)+(x-96)*(x-96), y, x) AS rn FROM lft WHERE image_id NOT IN (SELECT image_id FROM cov)) WHERE rn = 1)
SELECT image_id, CAST(least(greatest(y, 60), 131) AS INT) AS y, CAST(least(greatest(x, 60), 131) AS INT) AS x FROM pick"""


@query("f7_frontier_seed", fx.with_views("traces points_gt", FRONT))
def f7(spark, sf):
    covered = steplog.covered_pixels(fx.traces(spark, sf).where("trace_id < 2 AND image_id > 3"))
    return seeds.frontier_seed(fx.points_gt(spark, sf), covered, fx.curve_canvas(spark, sf), 55, 5)


@query("h8_metric_summary", fx.with_views("points_gt points_pred", hits(2) + """
, u AS (UNPIVOT (SELECT precision_2px::DOUBLE AS precision_2px, recall_2px::DOUBLE AS recall_2px, f1_2px::DOUBLE AS f1_2px FROM f2) ON precision_2px, recall_2px, f1_2px INTO NAME metric VALUE value)
SELECT metric, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std, round(stddev_pop(value), 5) AS std_pop FROM u GROUP BY metric"""))
def h8(spark, sf):
    m = materialize(fx.rounded(metrics.tolerant_f1(fx.points_pred(spark, sf), fx.points_gt(spark, sf), (2,))))
    cols = ["precision_2px", "recall_2px", "f1_2px"]
    pop = summaries.summarise(m, cols, sample=False).select("metric", F.col("std").alias("std_pop"))
    return fx.rounded(summaries.summarise(m, cols).drop("text").join(pop, "metric"), 5)


LEN = ", ln AS (SELECT image_id, trace_id, count(*) AS length FROM traces GROUP BY ALL)"
TRACES = "SELECT episode AS image_id, trace AS trace_id, row_number() OVER (PARTITION BY episode, trace ORDER BY step) - 1 AS seq, y, x FROM (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY episode ORDER BY step ROWS UNBOUNDED PRECEDING) AS trace FROM steps)"
CUT = f", cut AS ({TRACES})" + LEN.replace("FROM traces", "FROM cut")


def cut_traces(spark, sf):
    """Traces of uneven length: an ``error`` event starts a new one."""
    s = fx.steps(spark, sf)
    s = steplog.running(s, ["episode"], "step", {"trace_id": ("sum", (F.col("event_type") == "error").cast("int"))})
    s = materialize(s.select(F.col("episode").alias("image_id"), "trace_id", "step", "y", "x"))
    first = s.groupBy("image_id", "trace_id").agg(F.min("step").alias("_f"))
    return s.join(first, ["image_id", "trace_id"]).select("image_id", "trace_id", (F.col("step") - F.col("_f")).alias("seq"), "y", "x")


@query("h9_trace_statistics", fx.with_views("steps", CUT + "SELECT image_id, count(*) AS num_traces, median(length)::DOUBLE AS median_len FROM ln GROUP BY 1"))
def h9(spark, sf):
    return summaries.trace_statistics(cut_traces(spark, sf), fx.curve_canvas(spark, sf))


@query("h10_length_histogram", fx.with_views("steps", CUT + """
, sp AS (SELECT *, min(length) OVER w AS lo, max(length) OVER w AS hi FROM ln WINDOW w AS (PARTITION BY image_id))
SELECT image_id, CAST(least(CASE WHEN hi > lo THEN floor(round(ln(length / lo) / ln(hi / lo) * 39, 9)) ELSE 0 END, 38) AS INT) AS bin, count(*) AS traces FROM sp GROUP BY ALL"""))
def h10(spark, sf):
    return summaries.length_histogram(cut_traces(spark, sf))


@query("h11_first_traces", fx.with_views("steps", CUT + """
SELECT * FROM (SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY trace_id) AS INT) AS rank, CAST(trace_id AS BIGINT) AS trace_id, y, x FROM cut WHERE seq = 0) WHERE rank <= 5"""))
def h11(spark, sf):
    return summaries.first_traces(cut_traces(spark, sf), 5)


BCE = "-(gt * CASE WHEN v > 0 THEN greatest(ln(CASE WHEN v > 0 THEN v ELSE 1 END), -100) ELSE -100 END + (1 - gt) * CASE WHEN v < 1 THEN greatest(ln(CASE WHEN v < 1 THEN 1 - v ELSE 1 END), -100) ELSE -100 END)"


@query("h14_bce", fx.with_views("prob fov", f"""
SELECT image_id, round(avg({BCE}), 6) AS bce, round(avg(-(3 * gt * ln(v + 1e-5) + (1 - gt) * ln(1 - v + 1e-5))), 6) AS weighted FROM prob SEMI JOIN fov USING (image_id, y, x) GROUP BY 1"""))
def h14(spark, sf):
    p = fx.prob(spark, sf).join(fx.fov(spark, sf), PIXEL, "left_semi")
    return fx.rounded(losses.bce(p).join(losses.bce(p, pos_weight=3.0).withColumnRenamed("bce", "weighted"), "image_id"))


SOFT = skel_cte("prob", "sk", 2) + ", tg AS (SELECT image_id, y, x, gt::DOUBLE AS v FROM prob)" + skel_cte("tg", "st", 2) + """
, cdm AS (SELECT image_id, sum(a.v * gt) / (sum(a.v) + 1e-5) AS p, sum(b.v * p.v) / (sum(b.v) + 1e-5) AS r FROM prob p JOIN sk a USING (image_id, y, x) JOIN st b USING (image_id, y, x) GROUP BY 1)"""


@query("h15_soft_cldice", fx.with_views("prob", SOFT + "SELECT image_id, round(2 * p * r / (p + r + 1e-5), 6) AS cl_dice FROM cdm"))
def h15(spark, sf):
    return fx.rounded(losses.soft_cl_dice(fx.prob(spark, sf), 2))


@query("h15_combined_loss", fx.with_views("prob fov", SOFT + f"""
, b AS (SELECT avg({BCE}) AS bce FROM prob SEMI JOIN fov USING (image_id, y, x)), c AS (SELECT avg(2 * p * r / (p + r + 1e-5)) AS cl_dice FROM cdm)
SELECT round(bce, 6) AS bce, round(cl_dice, 6) AS cl_dice, round(0.4::DOUBLE * bce + 0.6::DOUBLE * (1 - cl_dice), 6) AS total FROM b, c"""))
def h15c(spark, sf):
    return fx.rounded(losses.combined(fx.prob(spark, sf), fx.fov(spark, sf), iterations=2))


@query("h16_focal_loss", fx.with_views("prob fov", f"""
SELECT image_id, round(sum(0.25 * (1 - CASE WHEN gt = 1 THEN v ELSE 1 - v END) ** 2 * {BCE}) / (count(*) + 1e-8), 6) AS focal FROM prob SEMI JOIN fov USING (image_id, y, x) GROUP BY 1"""))
def h16(spark, sf):
    return fx.rounded(losses.focal(fx.prob(spark, sf), mask=fx.fov(spark, sf)))


@query("h7_all_metrics", fx.with_views("points_gt points_pred mask_gt mask_pred", hits(1) + hits(2) + hits(3) + HD_CTE + CLDICE + label_cte("points_pred", "lp") + label_cte("points_gt", "lg") + f"""
SELECT f1.*, f2.* EXCLUDE (image_id), f3.* EXCLUDE (image_id), {CLDICE_VALUE} AS cldice, abs(coalesce(bp, 0) - coalesce(bg, 0))::DOUBLE AS betti_0_error,
   round(CASE WHEN f1.image_id NOT IN (SELECT image_id FROM points_pred) THEN sqrt(2 * 192.0 * 192.0) ELSE hd.v END, 6) AS hd95
FROM f1 JOIN f2 USING (image_id) JOIN f3 USING (image_id) LEFT JOIN cd USING (image_id) JOIN hd USING (image_id)
LEFT JOIN (SELECT image_id, count(DISTINCT label) AS bp FROM lp GROUP BY 1) USING (image_id) LEFT JOIN (SELECT image_id, count(DISTINCT label) AS bg FROM lg GROUP BY 1) USING (image_id)"""))
def h7(spark, sf):
    return fx.rounded(evaluation.evaluate(fx.points_pred(spark, sf), fx.points_gt(spark, sf), fx.curve_canvas(spark, sf),
                                          gt_mask=fx.mask_gt(spark, sf), pred_mask=fx.mask_pred(spark, sf)))


LINK = """
, act AS (SELECT a.image_id, a.y, a.x, a.v FROM {src} a WHERE a.v > {step})
, nb AS (SELECT a.image_id, a.y, a.x, b.y AS qy, b.x AS qx, b.v AS qv, row_number() OVER (PARTITION BY a.image_id, a.y, a.x ORDER BY b.v DESC, b.y, b.x) AS rn
   FROM act a JOIN act b ON b.image_id = a.image_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND (b.y <> a.y OR b.x <> a.x))
, lk AS (SELECT image_id, y::BIGINT * 4294967296 + x AS a, qy::BIGINT * 4294967296 + qx AS b FROM nb WHERE rn = 1)
, bi AS (SELECT image_id, a, b FROM lk UNION SELECT image_id, b, a FROM lk)
, lab AS (
  WITH RECURSIVE cc(image_id, id, label) USING KEY (image_id, id) AS (
    SELECT image_id, y::BIGINT * 4294967296 + x AS id, y::BIGINT * 4294967296 + x AS label FROM act
    UNION
    SELECT r.image_id, r.id, min(c.label) FROM cc c JOIN bi e ON e.image_id = c.image_id AND e.a = c.id JOIN recurring.cc r ON r.image_id = e.image_id AND r.id = e.b
    WHERE c.label < r.label GROUP BY r.image_id, r.id)
  SELECT * FROM cc)
, sd AS (SELECT a.image_id, a.y::BIGINT * 4294967296 + a.x AS id FROM act a LEFT JOIN nb n ON n.image_id = a.image_id AND n.y = a.y AND n.x = a.x AND n.rn = 1 WHERE a.v >= {seed} AND (n.qv IS NULL OR a.v >= n.qv))
, grp AS (SELECT l.image_id, label FROM lab l LEFT JOIN sd s ON s.image_id = l.image_id AND s.id = l.id GROUP BY ALL HAVING count(*) >= {n} AND count(s.id) > 0)
, linked AS (SELECT l.image_id, CAST(l.id // 4294967296 AS INT) AS y, CAST(l.id % 4294967296 AS INT) AS x, label FROM lab l SEMI JOIN grp USING (image_id, label))"""


@query("e17_ridge_linking", fx.with_views("prob fov", ", pf AS (SELECT * FROM prob SEMI JOIN fov USING (image_id, y, x))" + LINK.format(src="pf", step=0.5, seed=0.7, n=10) + "SELECT * FROM linked"))
def e17(spark, sf):
    return linking.link_ridges(prob_v(spark, sf), 0.7, 0.5, 10, fx.fov(spark, sf))


GIVEN = """
, ext AS (SELECT g.image_id, g.y, g.x FROM gray8 g JOIN fov USING (image_id, y, x))
, fv AS (SELECT e.image_id, e.y, e.x FROM ext e JOIN d USING (image_id) JOIN ext q ON q.image_id = e.image_id AND abs(q.y - e.y) + abs(q.x - e.x) <= 1
   GROUP BY e.image_id, e.y, e.x, h, w HAVING count(*) = 5 - CASE WHEN e.y IN (0, h - 1) THEN 1 ELSE 0 END - CASE WHEN e.x IN (0, w - 1) THEN 1 ELSE 0 END)"""
ENH = C1 + DIMS + GIVEN + """
, gm AS (SELECT image_id, y, x, CAST(floor(pow(g / 255::DOUBLE, 1.25::DOUBLE) * 255) AS INT) AS v FROM px)
, nn AS (SELECT g.image_id, g.y, g.x, least(greatest(g.y + a.k, 0), h - 1) AS ny, least(greatest(g.x + b.k, 0), w - 1) AS nx FROM gm g JOIN d USING (image_id),
   (SELECT unnest(range(-1, 2)) AS k) a, (SELECT unnest(range(-1, 2)) AS k) b)
, med AS (SELECT n.image_id, n.y, n.x, CAST(median(v) AS INT) AS v FROM nn n JOIN gm s ON s.image_id = n.image_id AND s.y = ny AND s.x = nx GROUP BY ALL)
, msk AS (SELECT m.image_id, m.y, m.x, CAST(CASE WHEN f.image_id IS NULL THEN 0 ELSE v END AS INT) AS v FROM med m LEFT JOIN fv f USING (image_id, y, x))""" + clahe_cte("msk", "cl") + """
, ct AS (SELECT image_id, quantile_cont(v::DOUBLE, 0.01) AS lo, quantile_cont(v::DOUBLE, 0.99) AS hi FROM cl SEMI JOIN fv USING (image_id, y, x) GROUP BY 1)
, enh AS (SELECT image_id, y, x, CASE WHEN lo IS NULL THEN v / 255 ELSE least(greatest((v - lo) / (hi - lo + 1e-8), 0), 1) END::DOUBLE AS v FROM cl LEFT JOIN ct USING (image_id))"""


def given_fov(spark, sf):
    return fx.gray8(spark, sf).join(fx.fov(spark, sf).withColumn("_f", F.lit(1)), PIXEL, "left").select(
        *PIXEL, F.when(F.col("_f") == 1, 255).otherwise(0).alias("v"))


@query("d12_enhancement", fx.with_views("gray8 fov raster", ENH + "SELECT image_id, y, x, round(v, 6) AS v FROM enh"))
def d12(spark, sf):
    return fx.rounded(enhance.enhance(rgb(spark, sf), given_fov(spark, sf)).enhanced)


@query("e13_derived_fov", fx.with_views("raster", DIMS + """
, g AS (SELECT image_id, y, x, CAST(CASE WHEN (y-30)*(y-30) + (x-34)*(x-34) <= 500 THEN 150 + floor(v * 200) ELSE greatest(0, floor(v * 50)) END AS INT) AS v FROM raster)
, taps AS (SELECT g.image_id, g.y, g.x, g.v, least(greatest(g.y + a.k, 0), h - 1) AS ny, least(greatest(g.x + b.k, 0), w - 1) AS nx FROM g JOIN d USING (image_id),
   (SELECT unnest(range(-25, 26)) AS k) a, (SELECT unnest(range(-25, 26)) AS k) b)
, mean AS (SELECT t.image_id, t.y, t.x, any_value(t.v) AS v, round_even(sum(s.v) / 2601, 0) AS m FROM taps t JOIN g s ON s.image_id = t.image_id AND s.y = ny AND s.x = nx GROUP BY t.image_id, t.y, t.x)
, m AS (SELECT image_id, y, x FROM mean WHERE v > m + 10)""" + label_cte("m", "l") + """
, top AS (SELECT image_id, min_by(label, label - n * 1000000000000000) AS label FROM (SELECT image_id, label, count(*)::BIGINT AS n FROM l GROUP BY ALL) GROUP BY 1)
, big AS (SELECT image_id, y, x FROM l SEMI JOIN top USING (image_id, label))
, bg AS (SELECT r.image_id, y + 1 AS y, x + 1 AS x FROM (SELECT image_id, CAST(a.k AS INT) AS y, CAST(b.k AS INT) AS x FROM d, (SELECT unnest(range(-1, 66)) AS k) a, (SELECT unnest(range(-1, 66)) AS k) b) r ANTI JOIN big USING (image_id, y, x))""" + label_cte("bg", "bl", True) + """
, filled AS (SELECT image_id, y, x FROM big UNION ALL SELECT image_id, CAST(y - 1 AS INT), CAST(x - 1 AS INT) FROM bl WHERE label <> 0)
SELECT e.image_id, e.y, e.x FROM filled e JOIN d USING (image_id) JOIN filled q ON q.image_id = e.image_id AND abs(q.y - e.y) + abs(q.x - e.x) <= 1
GROUP BY e.image_id, e.y, e.x, h, w HAVING count(*) = 5 - CASE WHEN e.y IN (0, h - 1) THEN 1 ELSE 0 END - CASE WHEN e.x IN (0, w - 1) THEN 1 ELSE 0 END"""))
def e13(spark, sf):
    g = fx.raster(spark, sf).selectExpr(
        "image_id", "y", "x", "cast(CASE WHEN (y-30)*(y-30) + (x-34)*(x-34) <= 500 THEN 150 + floor(v * 200) ELSE greatest(0, floor(v * 50)) END AS int) AS v")
    return enhance.derive_fov(g)


def vessel_cte(mask: str) -> str:
    return ridge_cte("enh", "rg", (1.0, 1.5)) + """
, nm AS (SELECT image_id, y, x, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-8) AS v FROM rg WINDOW w AS (PARTITION BY image_id))""" + gauss_cte("nm", "gs", 1.0) + f"""
, ves AS (SELECT g.image_id, g.y, g.x, round(CASE WHEN f.image_id IS NULL THEN 0 ELSE v END, 9)::DOUBLE AS v FROM gs g LEFT JOIN {mask} f USING (image_id, y, x))"""


@query("e18_vesselness_mask", fx.with_views("gray8 fov raster", ENH + vessel_cte("fv") + """
, m AS (SELECT image_id, y, x FROM ves WHERE v > 0.25)
, disk(dy, dx) AS (VALUES (0,0),(0,1),(0,-1),(1,0),(-1,0))
, dl AS (SELECT DISTINCT p.image_id, p.y + dy AS y, p.x + dx AS x FROM m p JOIN d USING (image_id), disk WHERE p.y + dy >= 0 AND p.x + dx >= 0 AND p.y + dy < h AND p.x + dx < w)""" + ERO.format(i="dl", o="cls") + label_cte("cls", "l", True) + """
, bn AS (SELECT image_id, y, x FROM (SELECT *, count(*) OVER (PARTITION BY image_id, label) AS n FROM l) WHERE n >= 12)
SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM bn"""))
def e18(spark, sf):
    e = enhance.enhance(rgb(spark, sf), given_fov(spark, sf))
    return centerlines.by_threshold(materialize(e.enhanced), e.mask, (1.0, 1.5), 0.25, 1.0, 12, 6)[2]


@query("e18_vesselness_centerline")
def e18c(spark, sf):
    e = enhance.enhance(rgb(spark, sf), given_fov(spark, sf))
    return centerlines.by_threshold(materialize(e.enhanced), e.mask, (1.0, 1.5), 0.25, 1.0, 12, 6)[0]


SAFE = """
, safe AS (SELECT a.image_id, a.y, a.x FROM fv a JOIN fv q ON q.image_id = a.image_id AND abs(q.y - a.y) + abs(q.x - a.x) <= 3 GROUP BY ALL HAVING count(*) = 25)"""


@query("e19_linked_groups", fx.with_views("gray8 fov raster", ENH + SAFE + vessel_cte("safe") + LINK.format(src="ves", step=0.2, seed=0.3, n=8) + "SELECT image_id, y, x, label FROM linked"))
def e19(spark, sf):
    e = enhance.enhance(rgb(spark, sf), given_fov(spark, sf))
    return centerlines.by_linking(materialize(e.enhanced), e.mask, (1.0, 1.5), 1.0, 0.3, 0.2, 8, thin_output=False)[2]


@query("e19_linked_centerline")
def e19c(spark, sf):
    e = enhance.enhance(rgb(spark, sf), given_fov(spark, sf))
    return centerlines.by_linking(materialize(e.enhanced), e.mask, (1.0, 1.5), 1.0, 0.3, 0.2, 8, 6)[0]


@query("s1_streamed_returns", """SELECT user_id AS episode, round(sum(value), 6) AS "return", count(*) AS length FROM events GROUP BY 1""")
def s1(spark, sf):
    log = episodes.read_log(spark, f"{sf}/events*.parquet").selectExpr("user_id AS episode", "value AS reward")
    return fx.rounded(episodes.drain(episodes.running_returns(log), ["episode"]))


@query("s2_streamed_stages", fx.with_views("steps", """RECURSIVE
, e AS (SELECT episode AS run, step AS idx, CASE WHEN event_type IN ('signup', 'purchase') THEN 1 ELSE 0 END AS s FROM steps)
, st(k, rate, need) AS (VALUES (0, 0.5, 4), (1, 0.45, 6), (2, 0.42, 8), (3, 0.4, 10), (4, 2.0, 1))
, walk AS (SELECT run, -1 AS idx, 0 AS stage, 0 AS n, 0 AS ok FROM e WHERE idx = 0
  UNION ALL SELECT e.run, e.idx, CASE WHEN up THEN stage + 1 ELSE stage END, CASE WHEN up THEN 0 ELSE n + 1 END, CASE WHEN up THEN 0 ELSE ok + q.s END
  FROM (SELECT w.*, e.idx AS i2, e.s, w.n + 1 >= st.need AND (w.ok + e.s) / (w.n + 1) >= st.rate AS up
        FROM walk w JOIN e ON e.run = w.run AND e.idx = w.idx + 1 JOIN st ON st.k = w.stage) q JOIN e ON e.run = q.run AND e.idx = q.i2)
SELECT run, max_by(stage, idx)::INT AS stage, max_by(n, idx)::BIGINT AS episodes, max_by(ok, idx)::BIGINT AS successes FROM walk GROUP BY 1"""))
def s2(spark, sf):
    log = episodes.read_log(spark, f"{sf}/events*.parquet")
    runs = log.select(F.col("user_id").alias("run"), F.col("event_id").alias("idx"),
                      F.col("event_type").isin("signup", "purchase").cast("int").alias("success"))
    return episodes.drain(episodes.stage_states(runs, SMALL_STAGES), ["run"])
