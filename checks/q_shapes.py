"""Components, thinning, pruning, skeleton graphs and the metrics built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.registry import query
from pixtab.operators import components, graph, thinning
from pixtab.plans import evaluation

RING = "(VALUES (-1,0,1),(-1,1,2),(0,1,4),(1,1,8),(1,0,16),(1,-1,32),(0,-1,64),(-1,-1,128)) AS ring(dy, dx, bit)"


def label_cte(src: str, name: str, four: bool = False) -> str:
    """Minimum-label propagation to the fixpoint."""
    touch = "abs(p.y - c.y) + abs(p.x - c.x) = 1" if four else "abs(p.y - c.y) <= 1 AND abs(p.x - c.x) <= 1"
    return f"""
, {name} AS (
  WITH RECURSIVE cc(image_id, y, x, label) USING KEY (image_id, y, x) AS (
    SELECT image_id, y, x, y::BIGINT * 4294967296 + x AS label FROM {src}
    UNION
    SELECT r.image_id, r.y, r.x, min(c.label) FROM cc c JOIN {src} p ON p.image_id = c.image_id AND p.y BETWEEN c.y - 1 AND c.y + 1 AND p.x BETWEEN c.x - 1 AND c.x + 1 AND {touch}
      JOIN recurring.cc r ON r.image_id = p.image_id AND r.y = p.y AND r.x = p.x
    WHERE c.label < r.label GROUP BY r.image_id, r.y, r.x)
  SELECT * FROM cc)"""


def thin_cte(src: str, name: str, rounds: int = 8) -> str:
    """Zhang-Suen sub-iterations, more of them than the masks are thick."""
    return f"""
, {name} AS (
  WITH RECURSIVE t(k, image_id, y, x) AS (
    SELECT 0, image_id, y, x FROM {src}
    UNION ALL
    SELECT k + 1, image_id, y, x FROM (
      SELECT p.k, p.image_id, p.y, p.x, CAST(coalesce(sum(q.bit), 0) AS INT) AS c
      FROM t p LEFT JOIN (SELECT k, image_id, y - dy AS y, x - dx AS x, bit FROM t, {RING}) q ON q.image_id = p.image_id AND q.y = p.y AND q.x = p.x
      GROUP BY p.k, p.image_id, p.y, p.x) s
    WHERE k < {2 * rounds} AND NOT (bit_count(c) BETWEEN 2 AND 6
      AND bit_count((255 - c) & (((c >> 1) | (c << 7)) & 255)) = 1
      AND CASE WHEN k % 2 = 0 THEN c & 21 <> 21 AND c & 84 <> 84 ELSE c & 69 <> 69 AND c & 81 <> 81 END))
  SELECT image_id, y, x FROM t WHERE k = {2 * rounds})"""


@query("e3_components_8", fx.with_views("points_pred", label_cte("points_pred", "l") + "SELECT image_id, y, x, label FROM l"))
def e3(spark, sf):
    return components.labels_of(components.label_components(fx.points_pred(spark, sf)))


@query("e3_components_4", fx.with_views("points_pred", label_cte("points_pred", "l", True) + "SELECT image_id, y, x, label FROM l"))
def e3_4(spark, sf):
    return components.labels_of(components.label_components(fx.points_pred(spark, sf), diagonal=False, edge=16))


@query("e4_remove_small", fx.with_views("points_pred", label_cte("points_pred", "l", True) + """
SELECT image_id, y, x FROM (SELECT *, count(*) OVER (PARTITION BY image_id, label) AS n FROM l) WHERE n >= 8"""))
def e4(spark, sf):
    return components.remove_small(fx.points_pred(spark, sf), 8)


@query("e5_largest_filled", fx.with_views("points_gt", label_cte("points_gt", "l") + """
, top AS (SELECT image_id, min_by(label, label - n * 1000000000000000) AS label FROM (SELECT image_id, label, count(*)::BIGINT AS n FROM l GROUP BY ALL) GROUP BY 1)
, big AS (SELECT image_id, y, x FROM l SEMI JOIN top USING (image_id, label))
, bg AS (SELECT image_id, CAST(yy AS INT) AS y, CAST(xx AS INT) AS x FROM (SELECT image_id, unnest(range(y0 - 1, y1 + 2)) AS yy, x0, x1 FROM
    (SELECT image_id, min(y)::BIGINT AS y0, max(y)::BIGINT AS y1, min(x)::BIGINT AS x0, max(x)::BIGINT AS x1 FROM big GROUP BY 1)) b, range(0, 192) AS r(xx)
    WHERE xx BETWEEN x0 - 1 AND x1 + 1 AND NOT EXISTS (SELECT 1 FROM big g WHERE g.image_id = b.image_id AND g.y = yy AND g.x = xx))""" + label_cte("bg", "m", True) + """
, outside AS (SELECT image_id, min(label) AS label FROM m GROUP BY 1)
SELECT image_id, y, x FROM big UNION ALL SELECT image_id, y, x FROM m ANTI JOIN outside USING (image_id, label)"""))
def e5(spark, sf):
    return components.fill_holes(components.largest_component(fx.points_gt(spark, sf)))


@query("h5_betti0_error", fx.with_views("points_gt points_pred", label_cte("points_pred", "lp") + label_cte("points_gt", "lg") + """
SELECT image_id, abs(coalesce(p, 0) - coalesce(g, 0))::DOUBLE AS betti_0_error FROM (SELECT DISTINCT user_id AS image_id FROM events)
LEFT JOIN (SELECT image_id, count(DISTINCT label) AS p FROM lp GROUP BY 1) USING (image_id) LEFT JOIN (SELECT image_id, count(DISTINCT label) AS g FROM lg GROUP BY 1) USING (image_id)"""))
def h5(spark, sf):
    return components.betti0_error(fx.points_pred(spark, sf), fx.points_gt(spark, sf), fx.curve_canvas(spark, sf))


@query("e6_thinning", fx.with_views("mask_gt", thin_cte("mask_gt", "s", 12) + "SELECT image_id, y, x FROM s"))
def e6(spark, sf):
    return thinning.thin(fx.mask_gt(spark, sf))


ADJ = """
, adj AS (SELECT p.image_id, p.y, p.x, q.y AS qy, q.x AS qx FROM {s} p JOIN {s} q ON p.image_id = q.image_id AND q.y BETWEEN p.y - 1 AND p.y + 1
   AND q.x BETWEEN p.x - 1 AND p.x + 1 AND (p.y <> q.y OR p.x <> q.x))
, deg AS (SELECT p.image_id, p.y, p.x, count(a.qy) AS n FROM {s} p LEFT JOIN adj a USING (image_id, y, x) GROUP BY ALL)"""


def walk_cte(src: str, name: str, steps: int, adj: str = "adj", deg: str = "deg") -> str:
    return f"""
, {name} AS (
  WITH RECURSIVE w(image_id, sy, sx, y, x, path, going) AS (
    SELECT image_id, y, x, y, x, [y * 1000 + x], true FROM {deg} WHERE n = 1
    UNION ALL
    SELECT * FROM (SELECT w.image_id, sy, sx, min(a.qy), min(a.qx), list_append(path, min(a.qy) * 1000 + min(a.qx)) AS path, true
      FROM w JOIN {adj} a USING (image_id, y, x) WHERE NOT list_contains(path, a.qy * 1000 + a.qx) AND len(path) < {steps}
      GROUP BY w.image_id, sy, sx, path HAVING count(*) = 1))
  SELECT image_id, sy AS y, sx AS x, max(len(path)) AS length, max_by(path, len(path)) AS path FROM w GROUP BY ALL)"""


@query("e7_branch_length", fx.with_views("points_pred", ADJ.format(s="points_pred") + walk_cte("points_pred", "w", 100) + """
SELECT image_id, y, x, CAST(length AS INT) AS length FROM w"""))
def e7(spark, sf):
    return thinning.branch_lengths(fx.points_pred(spark, sf))


def prune_cte(src: str, out: str, min_length: int, rounds: int) -> str:
    text, cur = "", src
    for i in range(rounds):
        nxt = out if i == rounds - 1 else f"{out}_{i}"
        a = (ADJ.format(s=cur).replace("adj", f"{out}_adj{i}").replace("deg", f"{out}_deg{i}")
             + walk_cte(cur, f"{out}_w{i}", min_length, f"{out}_adj{i}", f"{out}_deg{i}"))
        text += a + f"""
, {nxt} AS (SELECT c.image_id, c.y, c.x FROM {cur} c ANTI JOIN (SELECT image_id, unnest(path) AS p FROM {out}_w{i} WHERE length < {min_length}) g
    ON g.image_id = c.image_id AND g.p = c.y * 1000 + c.x)"""
        cur = nxt
    return text


@query("e8_spur_pruning", fx.with_views("points_pred", prune_cte("points_pred", "pruned", 10, 5) + "SELECT image_id, y, x FROM pruned"))
def e8(spark, sf):
    return thinning.prune(fx.points_pred(spark, sf))


@query("e9_centerline", fx.with_views("mask_pred", label_cte("mask_pred", "l", True) + """
, big AS (SELECT image_id, y, x FROM (SELECT *, count(*) OVER (PARTITION BY image_id, label) AS n FROM l) WHERE n >= 50)""" +
                               thin_cte("big", "s", 12) + prune_cte("s", "c", 10, 5) + "SELECT image_id, y, x FROM c"))
def e9(spark, sf):
    return thinning.extract_centerline(fx.mask_pred(spark, sf))


@query("e10_graph_nodes", fx.with_views("points_gt", ADJ.format(s="points_gt") + """
SELECT image_id, y::BIGINT * 4294967296 + x AS node_id, y, x, CASE WHEN n = 1 THEN 'endpoint' ELSE 'junction' END AS type FROM deg WHERE n = 1 OR n > 2"""))
def e10(spark, sf):
    return graph.nodes(fx.points_gt(spark, sf))


EDGES = ADJ.format(s="points_gt") + """
, sp AS (SELECT image_id, y, x FROM deg WHERE n = 1 OR n > 2)
, go AS (
  WITH RECURSIVE w(image_id, sy, sx, fy, fx, py, px, y, x, k, len, ext, on_node) AS (
    SELECT a.image_id, a.y, a.x, a.qy, a.qx, a.y, a.x, a.qy, a.qx, 1, 2, sqrt(((a.qy-a.y)*(a.qy-a.y) + (a.qx-a.x)*(a.qx-a.x))::DOUBLE), b.image_id IS NOT NULL
    FROM adj a JOIN sp s USING (image_id, y, x) LEFT JOIN sp b ON b.image_id = a.image_id AND b.y = a.qy AND b.x = a.qx
    UNION ALL
    SELECT w.image_id, sy, sx, fy, fx, w.y, w.x, a.qy, a.qx, k + 1, len + 1, ext + sqrt(((a.qy-w.y)*(a.qy-w.y) + (a.qx-w.x)*(a.qx-w.x))::DOUBLE), b.image_id IS NOT NULL
    FROM w JOIN adj a ON a.image_id = w.image_id AND a.y = w.y AND a.x = w.x AND (a.qy <> w.py OR a.qx <> w.px)
    LEFT JOIN sp b ON b.image_id = a.image_id AND b.y = a.qy AND b.x = a.qx WHERE NOT on_node)
  SELECT * FROM w)
, ways AS (SELECT image_id, sy, sx, fy, fx, y, x, len, ext FROM go WHERE on_node AND (sy < y OR (sy = y AND sx < x)))
, edge AS (SELECT image_id, sy::BIGINT * 4294967296 + sx AS src, y::BIGINT * 4294967296 + x AS dst, min(len) AS length,
     min_by(fy::BIGINT * 4294967296 + fx, len * 10000000000000000::HUGEINT + fy::BIGINT * 4294967296 + fx) AS first FROM ways GROUP BY ALL)"""


@query("e11_graph_edges", fx.with_views("points_gt", EDGES + "SELECT image_id, src, dst, CAST(length AS INT) AS length FROM edge"))
def e11(spark, sf):
    return graph.edges(fx.points_gt(spark, sf))


@query("e11_edge_points", fx.with_views("points_gt", EDGES + """
, px AS (SELECT g.image_id, e.src, e.dst, 0 AS seq, g.sy AS y, g.sx AS x FROM edge e JOIN (SELECT DISTINCT image_id, sy, sx FROM go) g ON g.image_id = e.image_id AND g.sy::BIGINT * 4294967296 + g.sx = e.src
  UNION ALL SELECT g.image_id, e.src, e.dst, g.k, g.y, g.x FROM edge e JOIN go g ON g.image_id = e.image_id AND g.sy::BIGINT * 4294967296 + g.sx = e.src
     AND g.fy::BIGINT * 4294967296 + g.fx = e.first AND g.k < e.length)
SELECT image_id, src, dst, CAST(seq AS INT) AS seq, y, x FROM px"""))
def e11p(spark, sf):
    return graph.edges_and_points(fx.points_gt(spark, sf))[1]


@query("e12_node_degree", fx.with_views("points_gt", EDGES + """
SELECT s.image_id, s.y::BIGINT * 4294967296 + s.x AS node_id, count(e.src) AS degree FROM sp s LEFT JOIN edge e ON e.image_id = s.image_id
  AND (e.src = s.y::BIGINT * 4294967296 + s.x OR e.dst = s.y::BIGINT * 4294967296 + s.x) GROUP BY ALL"""))
def e12(spark, sf):
    gt = fx.points_gt(spark, sf)
    return graph.degrees(graph.nodes(gt), graph.edges(gt))


@query("e14_expert_traces", fx.with_views("points_gt", EDGES + """
, nd AS (SELECT image_id, y::BIGINT * 4294967296 + x AS id FROM sp)
, dg AS (SELECT n.image_id, n.id, count(e.src) AS d FROM nd n LEFT JOIN edge e ON e.image_id = n.image_id AND (e.src = n.id OR e.dst = n.id) GROUP BY ALL)
, lab AS (
  WITH RECURSIVE cc(image_id, id, label) USING KEY (image_id, id) AS (
    SELECT image_id, id, id FROM nd
    UNION
    SELECT r.image_id, r.id, min(c.label) FROM cc c JOIN (SELECT image_id, src AS a, dst AS b FROM edge UNION ALL SELECT image_id, dst, src FROM edge) e ON e.image_id = c.image_id AND e.a = c.id
      JOIN recurring.cc r ON r.image_id = e.image_id AND r.id = e.b WHERE c.label < r.label GROUP BY r.image_id, r.id)
  SELECT * FROM cc)
, tips AS (SELECT DISTINCT image_id, label FROM lab JOIN dg USING (image_id, id) WHERE d = 1)
, chosen AS (SELECT * FROM tips UNION ALL SELECT image_id, min_by(label, id) FROM lab WHERE image_id NOT IN (SELECT image_id FROM tips) GROUP BY 1)
SELECT e.image_id, row_number() OVER (PARTITION BY e.image_id ORDER BY label, src, dst) AS trace_id, src, dst, CAST(length AS INT) AS length
FROM edge e JOIN lab l ON l.image_id = e.image_id AND l.id = e.src SEMI JOIN chosen c ON c.image_id = l.image_id AND c.label = l.label"""))
def e14(spark, sf):
    return graph.expert_traces(fx.points_gt(spark, sf))[0]


@query("e15_spur_removal", fx.with_views("points_gt", EDGES + """
, spur AS (SELECT w.* FROM ways w JOIN deg a ON a.image_id = w.image_id AND a.y = w.sy AND a.x = w.sx JOIN deg b ON b.image_id = w.image_id AND b.y = w.y AND b.x = w.x
   WHERE (a.n = 1) <> (b.n = 1) AND ext < 8)
, dead AS (SELECT g.image_id, unnest([g.sy * 1000 + g.sx, g.y * 1000 + g.x]) AS p FROM spur s JOIN go g ON g.image_id = s.image_id AND g.sy = s.sy AND g.sx = s.sx AND g.fy = s.fy AND g.fx = s.fx AND g.len <= s.len)
, rest AS (SELECT p.* FROM points_gt p ANTI JOIN dead d ON d.image_id = p.image_id AND d.p = p.y * 1000 + p.x)""" + thin_cte("rest", "s", 6) + "SELECT image_id, y, x FROM s"))
def e15(spark, sf):
    return graph.remove_spurs(fx.points_gt(spark, sf), 8.0)


ELL7 = "(VALUES (-3,0,0),(-2,-2,2),(-1,-3,3),(0,-3,3),(1,-3,3),(2,-2,2),(3,0,0)) AS se(dy, lo, hi)"
BRIDGE = f"""
, fat AS (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM points_pred, {ELL7}, (SELECT unnest(range(-3, 4)) AS dx)
  WHERE dx BETWEEN lo AND hi AND y + dy BETWEEN 0 AND 191 AND x + dx BETWEEN 0 AND 191)"""


@query("e16_gap_bridging", fx.with_views("points_pred", BRIDGE + thin_cte("fat", "s", 12) + "SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM s"))
def e16(spark, sf):
    return thinning.bridge_gaps(fx.points_pred(spark, sf), 3, fx.curve_canvas(spark, sf))


CLDICE = thin_cte("mask_pred", "sp", 12) + thin_cte("mask_gt", "sg", 12) + """
, cd AS (SELECT image_id, tp / n1 AS p, ts / n2 AS r FROM
   (SELECT s.image_id, count(*) AS n1, count(m.image_id) AS tp FROM sp s LEFT JOIN mask_gt m USING (image_id, y, x) GROUP BY 1) JOIN
   (SELECT s.image_id, count(*) AS n2, count(m.image_id) AS ts FROM sg s LEFT JOIN mask_pred m USING (image_id, y, x) GROUP BY 1) USING (image_id))"""
CLDICE_VALUE = "round(coalesce(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 0), 6)::DOUBLE"


@query("h3_cldice", fx.with_views("mask_gt mask_pred", CLDICE + f"""
SELECT image_id, {CLDICE_VALUE} AS cldice FROM (SELECT DISTINCT user_id AS image_id FROM events) LEFT JOIN cd USING (image_id)"""))
def h3(spark, sf):
    return fx.rounded(thinning.cl_dice(fx.mask_pred(spark, sf), fx.mask_gt(spark, sf), fx.curve_canvas(spark, sf)))


@query("h4_cldice_from_probs", fx.with_views("prob", """
, a AS (SELECT image_id, y, x FROM prob WHERE v >= 0.5), b AS (SELECT image_id, y, x FROM prob WHERE gt = 1)""" + thin_cte("a", "sa", 16) + thin_cte("b", "sb", 16) + f"""
, cd AS (SELECT image_id, tp / n1 AS p, ts / n2 AS r FROM
   (SELECT s.image_id, count(*) AS n1, count(m.image_id) AS tp FROM sa s LEFT JOIN b m USING (image_id, y, x) GROUP BY 1) JOIN
   (SELECT s.image_id, count(*) AS n2, count(m.image_id) AS ts FROM sb s LEFT JOIN a m USING (image_id, y, x) GROUP BY 1) USING (image_id))
SELECT image_id, {CLDICE_VALUE} AS cldice FROM cd"""))
def h4(spark, sf):
    p = fx.prob(spark, sf)
    return fx.rounded(thinning.cl_dice_from_probs(p, p.where("gt = 1").select("image_id", "y", "x"), p))


@query("h17_betti0_raw_and_bridged", fx.with_views("points_gt points_pred", BRIDGE + thin_cte("fat", "s", 12) + label_cte("points_pred", "lp") + label_cte("points_gt", "lg") + label_cte("s", "ls") + """
, n AS (SELECT 'p' AS k, image_id, count(DISTINCT label) AS c FROM lp GROUP BY 2 UNION ALL SELECT 'g', image_id, count(DISTINCT label) FROM lg GROUP BY 2
   UNION ALL SELECT 's', image_id, count(DISTINCT label) FROM ls GROUP BY 2)
SELECT image_id, abs(coalesce(sum(c) FILTER (k = 'p'), 0) - coalesce(sum(c) FILTER (k = 'g'), 0))::DOUBLE AS betti_0_error_raw,
   abs(coalesce(sum(c) FILTER (k = 's'), 0) - coalesce(sum(c) FILTER (k = 'g'), 0))::DOUBLE AS betti_0_error_postproc FROM n GROUP BY image_id"""))
def h17(spark, sf):
    pred, gt, images = fx.points_pred(spark, sf), fx.points_gt(spark, sf), fx.curve_canvas(spark, sf)
    raw = components.betti0_error(pred, gt, images).withColumn("hd95", F.lit(None).cast("double"))
    return evaluation.with_bridged_error(raw, pred, gt, images, 3).drop("hd95")
