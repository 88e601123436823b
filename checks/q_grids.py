"""Per-pixel and neighbourhood operators on the dense rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.registry import query
from pixtab.functions import strips as st
from pixtab.operators import filters, morphology, pixels, thinning

C1 = ", px AS (SELECT image_id, y, x, v AS r, (v * 7 + y) % 256 AS g, 255 - v AS b FROM gray8)"


def rgb(spark, sf):
    return fx.gray8(spark, sf).selectExpr("image_id", "y", "x", "v AS r", "(v * 7 + y) % 256 AS g", "255 - v AS b")


@query("c1_green_channel", fx.with_views("gray8", C1 + "SELECT image_id, y, x, CAST(g AS INT) AS v FROM px"))
def c1(spark, sf):
    return pixels.green_channel(rgb(spark, sf))


@query("c2_range_guard", fx.with_views("prob", """
SELECT image_id, y, x, CAST(floor(CASE WHEN max(v) OVER (PARTITION BY image_id) <= 1 THEN v * 255 ELSE v END) AS INT) AS v
FROM (SELECT image_id, y, x, CASE WHEN image_id % 2 = 0 THEN v ELSE v * 200 END AS v FROM prob)"""))
def c2(spark, sf):
    return pixels.to_8bit(fx.prob(spark, sf).selectExpr("image_id", "y", "x", "CASE WHEN image_id % 2 = 0 THEN v ELSE v * 200 END AS v"))


@query("c2_dark_integers", fx.with_views("gray8", "SELECT image_id, y, x, CASE WHEN v > 127 THEN 1 ELSE 0 END AS v FROM gray8"))
def c2_dark(spark, sf):
    """An almost black 8-bit image is not brightened."""
    return pixels.to_8bit(fx.gray8(spark, sf).selectExpr("image_id", "y", "x", "CASE WHEN v > 127 THEN 1 ELSE 0 END AS v"))


@query("c3_gamma", fx.with_views("gray8", "SELECT image_id, y, x, CAST(floor(pow(v / 255::DOUBLE, 1.25::DOUBLE) * 255) AS INT) AS v FROM gray8"))
def c3(spark, sf):
    return fx.gray8(spark, sf).withColumn("v", pixels.gamma(F.col("v"), 0.8))


@query("c4_min_max", fx.with_views("raster", """
SELECT image_id, y, x, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-8), 6) AS v FROM raster WINDOW w AS (PARTITION BY image_id)"""))
def c4(spark, sf):
    return fx.rounded(pixels.min_max(fx.raster(spark, sf)))


@query("c5_roi_normalise", fx.with_views("gray8 fov", """
, c AS (SELECT image_id, quantile_cont(v::DOUBLE, 0.01) AS lo, quantile_cont(v::DOUBLE, 0.99) AS hi FROM gray8 SEMI JOIN (SELECT * FROM fov WHERE image_id > 0) f USING (image_id, y, x) GROUP BY 1)
SELECT image_id, y, x, round(CASE WHEN lo IS NULL THEN v / 255 ELSE least(greatest((v - lo) / (hi - lo + 1e-8), 0), 1) END, 6)::DOUBLE AS v FROM gray8 LEFT JOIN c USING (image_id)"""))
def c5(spark, sf):
    return fx.rounded(pixels.roi_normalise(fx.gray8(spark, sf), fx.fov(spark, sf).where("image_id > 0")))


@query("c7_replace_green", fx.with_views("gray8 prob", C1 + "SELECT image_id, y, x, r, p.v AS g, b FROM px JOIN prob p USING (image_id, y, x)"))
def c7(spark, sf):
    return pixels.replace_green(rgb(spark, sf), fx.prob(spark, sf))


DIMS = ", d AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM raster GROUP BY 1)"


@query("c8_resample_nearest", fx.with_views("gray8", DIMS + """
, t AS (SELECT image_id, h, w, a.k AS y, b.k AS x FROM d, (SELECT unnest(range(0, 40)) AS k) a, (SELECT unnest(range(0, 90)) AS k) b)
SELECT t.image_id, CAST(t.y AS INT) AS y, CAST(t.x AS INT) AS x FROM t JOIN gray8 g ON g.image_id = t.image_id AND g.y = floor(t.y * (h / 40)) AND g.x = floor(t.x * (w / 90)) WHERE g.v > 127"""))
def c8n(spark, sf):
    g = fx.gray8(spark, sf)
    dims = st.canvas_of(g).withColumn("nh", F.lit(40)).withColumn("nw", F.lit(90))
    return pixels.resample_mask(g.withColumn("v", (F.col("v") > 127).cast("int")), dims)


BILINEAR = """
, s AS (SELECT *, (ty + 0.5::DOUBLE) * (h / nh) - 0.5 AS fy, (tx + 0.5::DOUBLE) * (w / nw) - 0.5 AS fx FROM t)
, q AS (SELECT image_id, ty, tx, least(greatest(floor(fy) + i, 0), h - 1) AS y, least(greatest(floor(fx) + j, 0), w - 1) AS x,
     CASE i WHEN 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END * CASE j WHEN 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END AS k
   FROM s, (VALUES (0), (1)) AS a(i), (VALUES (0), (1)) AS b(j))
, bil AS (SELECT q.image_id, ty, tx, sum(k * v) AS v FROM q JOIN raster r ON r.image_id = q.image_id AND r.y = q.y AND r.x = q.x GROUP BY ALL)"""


@query("c8_resample_bilinear", fx.with_views("gray8", DIMS + """
, t AS (SELECT image_id, h, w, 40 AS nh, 90 AS nw, a.k AS ty, b.k AS tx FROM d, (SELECT unnest(range(0, 40)) AS k) a, (SELECT unnest(range(0, 90)) AS k) b)""" + BILINEAR + """
SELECT image_id, CAST(ty AS INT) AS y, CAST(tx AS INT) AS x, round(v, 6) AS v FROM bil"""))
def c8b(spark, sf):
    g = fx.raster(spark, sf)
    dims = st.canvas_of(g).withColumn("nh", F.lit(40)).withColumn("nw", F.lit(90))
    return fx.rounded(pixels.resample(g, dims))


@query("c9_fit_and_pad", fx.with_views("gray8", DIMS + """
, e AS (SELECT *, CAST(round_even(h * (96 / greatest(h, w)), 0) AS INT) AS nh, CAST(round_even(w * (96 / greatest(h, w)), 0) AS INT) AS nw FROM d)
, t AS (SELECT image_id, h, w, nh, nw, a.k AS ty, b.k AS tx FROM e, (SELECT unnest(range(0, 96)) AS k) a, (SELECT unnest(range(0, 96)) AS k) b WHERE a.k < nh AND b.k < nw)""" + BILINEAR + """
, m AS (SELECT bil.image_id, ty + (96 - nh) // 2 AS y, tx + (96 - nw) // 2 AS x, v FROM bil JOIN e USING (image_id))
SELECT e.image_id, CAST(a.k AS INT) AS y, CAST(b.k AS INT) AS x, round(coalesce(v, 0), 6)::DOUBLE AS v FROM e CROSS JOIN (SELECT unnest(range(0, 96)) AS k) a CROSS JOIN (SELECT unnest(range(0, 96)) AS k) b
LEFT JOIN m ON m.image_id = e.image_id AND m.y = a.k AND m.x = b.k"""))
def c9(spark, sf):
    g = fx.raster(spark, sf)
    return fx.rounded(pixels.fit_and_pad(g, st.canvas_of(g), 96))


@query("c10_threshold", fx.with_views("prob", "SELECT image_id, y, x FROM prob WHERE v >= 0.5"))
def c10(spark, sf):
    return thinning.threshold_at_least(fx.prob(spark, sf), 0.5)


@query("d4_median", fx.with_views("gray8", DIMS + """
, n AS (SELECT g.image_id, g.y, g.x, least(greatest(g.y + a.k, 0), h - 1) AS ny, least(greatest(g.x + b.k, 0), w - 1) AS nx FROM gray8 g JOIN d USING (image_id),
   (SELECT unnest(range(-1, 2)) AS k) a, (SELECT unnest(range(-1, 2)) AS k) b)
SELECT n.image_id, n.y, n.x, CAST(median(v) AS INT) AS v FROM n JOIN gray8 s ON s.image_id = n.image_id AND s.y = ny AND s.x = nx GROUP BY ALL"""))
def d4(spark, sf):
    return filters.median(fx.gray8(spark, sf), 3, edge=32)


ADAPT = DIMS.replace("raster", "gray8") + """
, taps AS (SELECT g.image_id, g.y, g.x, g.v, least(greatest(g.y + a.k, 0), h - 1) AS ny, least(greatest(g.x + b.k, 0), w - 1) AS nx FROM gray8 g JOIN d USING (image_id),
   (SELECT unnest(range(-5, 6)) AS k) a, (SELECT unnest(range(-5, 6)) AS k) b)
, mean AS (SELECT t.image_id, t.y, t.x, any_value(t.v) AS v, round_even(sum(s.v) / 121, 0) AS m FROM taps t JOIN gray8 s ON s.image_id = t.image_id AND s.y = ny AND s.x = nx
   GROUP BY t.image_id, t.y, t.x)"""


@query("d5_adaptive_mean", fx.with_views("gray8", ADAPT + "SELECT image_id, y, x FROM mean WHERE v > m + 10"))
def d5(spark, sf):
    return filters.adaptive_mean_points(fx.gray8(spark, sf), 11, 10, edge=32)


MASK = """
, m AS (SELECT image_id, y, x FROM gray8 WHERE v > 90)
, disk AS (SELECT a.k AS dy, b.k AS dx FROM (SELECT unnest(range(-2, 3)) AS k) a, (SELECT unnest(range(-2, 3)) AS k) b WHERE a.k*a.k + b.k*b.k <= 4)"""
SPARSE = MASK.replace("v > 90", "v > 200")
DIL = ", {o} AS (SELECT DISTINCT p.image_id, p.y + dy AS y, p.x + dx AS x FROM {i} p JOIN d USING (image_id), disk WHERE p.y + dy >= 0 AND p.x + dx >= 0 AND p.y + dy < h AND p.x + dx < w)"
ERO = """, {o} AS (SELECT image_id, y, x FROM (SELECT r.image_id, r.y, r.x, r.y + dy AS ny, r.x + dx AS nx, h, w FROM raster r JOIN d USING (image_id) CROSS JOIN disk) c
   LEFT JOIN (SELECT image_id AS pi, y AS py, x AS px FROM {i}) p ON pi = image_id AND py = ny AND px = nx
   GROUP BY image_id, y, x HAVING count(*) FILTER (pi IS NULL AND ny >= 0 AND nx >= 0 AND ny < h AND nx < w) = 0)"""


def mask(spark, sf, above=90):
    return fx.gray8(spark, sf).where(F.col("v") > above).select("image_id", "y", "x")


def dims(spark, sf):
    return st.canvas_of(fx.raster(spark, sf))


@query("d6_dilate", fx.with_views("gray8", DIMS + SPARSE + DIL.format(i="m", o="a") + "SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM a"))
def d6d(spark, sf):
    return morphology.dilate(mask(spark, sf, 200), morphology.disk_spans(2), dims(spark, sf))


@query("d6_erode", fx.with_views("gray8", DIMS + MASK + ERO.format(i="m", o="a") + "SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM a"))
def d6e(spark, sf):
    return morphology.erode(mask(spark, sf), morphology.disk_spans(2), dims(spark, sf))


@query("d6_erode_repeated", fx.with_views("gray8", MASK + """
SELECT m.image_id, m.y, m.x FROM m JOIN m q ON q.image_id = m.image_id AND abs(q.y - m.y) + abs(q.x - m.x) <= 3 GROUP BY ALL HAVING count(*) = 25"""))
def d6r(spark, sf):
    return morphology.erode(mask(spark, sf), morphology.diamond_spans(3))


@query("d7_open", fx.with_views("gray8", DIMS + MASK + ERO.format(i="m", o="a") + DIL.format(i="a", o="b") + "SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM b"))
def d7o(spark, sf):
    return morphology.open_(mask(spark, sf), morphology.disk_spans(2), dims(spark, sf))


@query("d7_close", fx.with_views("gray8", DIMS + SPARSE + DIL.format(i="m", o="a") + ERO.format(i="a", o="b") + "SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM b"))
def d7c(spark, sf):
    return morphology.close(mask(spark, sf, 200), morphology.disk_spans(2), dims(spark, sf))


@query("d8_kernel_size", fx.with_views("raster", DIMS + """
SELECT image_id, f, CAST(greatest(1, round_even(5 * (sqrt((h*f*h*f + w*f*w*f)::DOUBLE) / 812), 0)) AS INT) AS k FROM d, (VALUES (1), (4), (9), (20)) AS s(f)"""))
def d8(spark, sf):
    s = dims(spark, sf).withColumn("f", F.explode(F.array(*[F.lit(f) for f in (1, 4, 9, 20)])))
    return s.select("image_id", "f", morphology.kernel_size(F.col("h") * F.col("f"), F.col("w") * F.col("f")).alias("k"))


@query("d13_external_fov", fx.with_views("gray8 fov", DIMS + """
, ex AS (SELECT image_id, y, x FROM gray8 SEMI JOIN fov USING (image_id, y, x) WHERE v > 100)
SELECT e.image_id, e.y, e.x FROM ex e JOIN d USING (image_id) JOIN ex q ON q.image_id = e.image_id AND abs(q.y - e.y) + abs(q.x - e.x) <= 1
GROUP BY e.image_id, e.y, e.x, h, w HAVING count(*) = 5 - CASE WHEN e.y IN (0, h - 1) THEN 1 ELSE 0 END - CASE WHEN e.x IN (0, w - 1) THEN 1 ELSE 0 END"""))
def d13(spark, sf):
    g = fx.gray8(spark, sf)
    return morphology.external_fov(g.join(fx.fov(spark, sf), ["image_id", "y", "x"], "left_semi"), dims(spark, sf), threshold=100)


def gauss_cte(src: str, out: str, sigma: float, orders=(0, 0), val="v") -> str:
    """Row pass (order 0/1/2) then column pass, border mirrored, independent of the library's kernels."""
    r = int(4 * sigma + 0.5)
    w = {0: "g", 1: f"g * k / {sigma ** 2}", 2: f"g * (k * k / {float(sigma) ** 4} - 1 / {float(sigma) ** 2})"}
    ker = f"(SELECT k, exp(-0.5::DOUBLE * (k / {float(sigma)}::DOUBLE) ** 2) / sum(exp(-0.5::DOUBLE * (k / {float(sigma)}::DOUBLE) ** 2)) OVER () AS g FROM (SELECT unnest(range({-r}, {r + 1})) AS k))"
    mir = "CASE WHEN {c} + k < 0 THEN -1 - ({c} + k) WHEN {c} + k >= {n} THEN 2 * {n} - 1 - ({c} + k) ELSE {c} + k END"
    return f"""
, {out}_r AS (SELECT a.image_id, a.y, a.x, sum(b.v * wt) AS v FROM (SELECT p.image_id, p.y, p.x, {mir.format(c='p.x', n='w')} AS sx, {w[orders[0]]} AS wt FROM {src} p JOIN d USING (image_id) CROSS JOIN {ker}) a
   JOIN (SELECT image_id, y, x, {val}::DOUBLE AS v FROM {src}) b ON b.image_id = a.image_id AND b.y = a.y AND b.x = a.sx GROUP BY a.image_id, a.y, a.x)
, {out} AS (SELECT a.image_id, a.y, a.x, sum(b.v * wt) AS v FROM (SELECT p.image_id, p.y, p.x, {mir.format(c='p.y', n='h')} AS sy, {w[orders[1]]} AS wt FROM {src} p JOIN d USING (image_id) CROSS JOIN {ker}) a
   JOIN {out}_r b ON b.image_id = a.image_id AND b.y = a.sy AND b.x = a.x GROUP BY a.image_id, a.y, a.x)"""


@query("d9_gaussian", fx.with_views("raster", DIMS + gauss_cte("raster", "g1", 1.5) + "SELECT image_id, y, x, round(v, 6) AS v FROM g1"))
def d9(spark, sf):
    return fx.rounded(filters.gaussian(fx.raster(spark, sf), 1.5, edge=32))


def ridge_cte(src: str, out: str, sigmas) -> str:
    """Frangi response by closed-form eigenvalues."""
    text, parts = "", []
    for i, s in enumerate(sigmas):
        text += gauss_cte(src, f"{out}yy{i}", s, (0, 2)) + gauss_cte(src, f"{out}xy{i}", s, (1, 1)) + gauss_cte(src, f"{out}xx{i}", s, (2, 0))
        text += f"""
, {out}e{i} AS (SELECT image_id, y, x, m + rt AS a, m - rt AS b FROM (SELECT image_id, y, x, {s * s} * (p.v + q.v) / 2 AS m,
     sqrt(({s * s} * (p.v - q.v)) ** 2 / 4 + ({s * s} * r.v) ** 2) AS rt FROM {out}yy{i} p JOIN {out}xx{i} q USING (image_id, y, x) JOIN {out}xy{i} r USING (image_id, y, x)))
, {out}f{i} AS (SELECT image_id, y, x, CASE WHEN l > 0 THEN exp(-((s / l) ** 2) / 0.5) * (1 - exp(-(n * n) / (2 * c * c))) ELSE 0 END::DOUBLE AS v FROM
   (SELECT *, CASE WHEN abs(a) < abs(b) THEN a ELSE b END AS s, CASE WHEN abs(a) < abs(b) THEN b ELSE a END AS l, sqrt(a*a + b*b) AS n, max(sqrt(a*a + b*b)) OVER (PARTITION BY image_id) / 2 AS c FROM {out}e{i}))"""
        parts.append(f"SELECT * FROM {out}f{i}")
    return text + f"\n, {out} AS (SELECT image_id, y, x, max(v) AS v FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL)"


@query("d10_ridge_response", fx.with_views("raster", DIMS + ridge_cte("raster", "rg", (1.0, 2.0)) + "SELECT image_id, y, x, round(v, 6) AS v FROM rg"))
def d10(spark, sf):
    return fx.rounded(filters.ridges(fx.raster(spark, sf), (1.0, 2.0)))


@query("d14_local_maxima", fx.with_views("prob", """
SELECT a.image_id, a.y, a.x FROM prob a WHERE NOT EXISTS (SELECT 1 FROM prob b WHERE b.image_id = a.image_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.v > a.v)"""))
def d14(spark, sf):
    return filters.local_maxima(fx.prob(spark, sf).select("image_id", "y", "x", "v"), edge=32)


def pool_cte(src, out, fn):
    return f", {out} AS (SELECT a.image_id, a.y, a.x, {fn}(b.v) AS v FROM {src} a JOIN {src} b ON b.image_id = a.image_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL)"


@query("d15_soft_pools", fx.with_views("prob", pool_cte("prob", "e", "min") + pool_cte("prob", "dl", "max") + pool_cte("e", "o", "max") + """
SELECT image_id, y, x, round(e.v, 6) AS eroded, round(dl.v, 6) AS dilated, round(o.v, 6) AS opened FROM e JOIN dl USING (image_id, y, x) JOIN o USING (image_id, y, x)"""))
def d15(spark, sf):
    p, key = fx.prob(spark, sf).select("image_id", "y", "x", "v"), ["image_id", "y", "x"]
    one = lambda k, n: filters.soft_pool(p, k).withColumnRenamed("v", n)
    return fx.rounded(one("erode", "eroded").join(one("dilate", "dilated"), key).join(one("open", "opened"), key))


def skel_cte(src: str, out: str, n: int) -> str:
    text, cur = "", src
    for i in range(n + 1):
        if i:
            text += pool_cte(cur, f"{out}i{i}", "min")
            cur = f"{out}i{i}"
        text += pool_cte(cur, f"{out}a{i}", "min") + pool_cte(f"{out}a{i}", f"{out}o{i}", "max")
        text += f", {out}d{i} AS (SELECT image_id, y, x, greatest(c.v - o.v, 0) AS v FROM {cur} c JOIN {out}o{i} o USING (image_id, y, x))"
        text += (f", {out}s0 AS (SELECT * FROM {out}d0)" if i == 0 else
                 f", {out}s{i} AS (SELECT image_id, y, x, s.v + greatest(q.v - s.v * q.v, 0) AS v FROM {out}s{i - 1} s JOIN {out}d{i} q USING (image_id, y, x))")
    return text + f", {out} AS (SELECT * FROM {out}s{n})"


@query("d16_soft_skeleton", fx.with_views("prob", skel_cte("prob", "sk", 3) + "SELECT image_id, y, x, round(v, 6)::DOUBLE AS v FROM sk"))
def d16(spark, sf):
    return fx.rounded(filters.soft_skeleton(fx.prob(spark, sf).select("image_id", "y", "x", "v"), 3))


def clahe_cte(src: str, out: str) -> str:
    """Contrast-limited equalisation of 64-pixel-wide images with 8 x 8 regions, clip 2.5."""
    return f"""
, {out}p AS (SELECT g.*, h, w, CAST(ceil(h / 8) AS INT) AS th, CAST(ceil(w / 8) AS INT) AS tw FROM {src} g JOIN d USING (image_id))
, {out}m AS (SELECT image_id, v, y AS py, x AS px, th, tw FROM {out}p UNION ALL SELECT image_id, v, 2 * h - 2 - y, x, th, tw FROM {out}p WHERE 2 * h - 2 - y >= h AND 2 * h - 2 - y < th * 8)
, {out}h AS MATERIALIZED (SELECT image_id, CAST(py // th AS INT) AS ry, CAST(px // tw AS INT) AS rx, v, count(*) AS n, any_value(th * tw) AS area FROM {out}m GROUP BY image_id, ry, rx, v)
, {out}r AS (SELECT image_id, ry, rx, any_value(area) AS area, greatest(CAST(floor(2.5 * any_value(area) / 256) AS INT), 1) AS lim FROM {out}h GROUP BY 1, 2, 3)
, {out}x AS (SELECT r.*, CAST(sum(greatest(n - lim, 0)) AS INT) AS ex FROM {out}r r JOIN {out}h USING (image_id, ry, rx) GROUP BY ALL)
, {out}l AS MATERIALIZED (SELECT image_id, ry, rx, v, least(round_even(sum(e) OVER (PARTITION BY image_id, ry, rx ORDER BY v) * (255.0::DOUBLE / area), 0), 255) AS l FROM
   (SELECT x.*, b.v, least(coalesce(n, 0), lim) + ex // 256 + CASE WHEN ex % 256 > 0 AND b.v % greatest(256 // greatest(ex % 256, 1), 1) = 0
       AND b.v // greatest(256 // greatest(ex % 256, 1), 1) < ex % 256 THEN 1 ELSE 0 END AS e
    FROM {out}x x CROSS JOIN (SELECT unnest(range(0, 256)) AS v) b LEFT JOIN {out}h hh ON hh.image_id = x.image_id AND hh.ry = x.ry AND hh.rx = x.rx AND hh.v = b.v))
, {out}c AS (SELECT image_id, y, x, v, y * (1.0::DOUBLE / th) - 0.5 AS fy, x * (1.0::DOUBLE / tw) - 0.5 AS fx FROM {out}p)
, {out}k AS MATERIALIZED (SELECT image_id, y, x, v, fy - floor(fy) AS wy, fx - floor(fx) AS wx, CAST(greatest(floor(fy), 0) AS INT) AS y0, CAST(least(floor(fy) + 1, 7) AS INT) AS y1,
     CAST(greatest(floor(fx), 0) AS INT) AS x0, CAST(least(floor(fx) + 1, 7) AS INT) AS x1 FROM {out}c)
, {out} AS (SELECT c.image_id, c.y, c.x, CAST(round_even((a.l * (1 - wx) + b.l * wx) * (1 - wy) + (e.l * (1 - wx) + f.l * wx) * wy, 0) AS INT) AS v
   FROM {out}k c JOIN {out}l a ON a.image_id = c.image_id AND a.v = c.v AND a.ry = y0 AND a.rx = x0
   JOIN {out}l b ON b.image_id = c.image_id AND b.v = c.v AND b.ry = y0 AND b.rx = x1
   JOIN {out}l e ON e.image_id = c.image_id AND e.v = c.v AND e.ry = y1 AND e.rx = x0
   JOIN {out}l f ON f.image_id = c.image_id AND f.v = c.v AND f.ry = y1 AND f.rx = x1)"""


@query("d11_clahe", fx.with_views("gray8", DIMS + clahe_cte("gray8", "cl") + "SELECT image_id, y, x, v FROM cl"))
def d11(spark, sf):
    return filters.clahe(fx.gray8(spark, sf))
