"""Neighbour counts and curve metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.registry import query
from pixtab.functions.lineage import ensure_checkpoint_dir
from pixtab.operators import distance, metrics, neighborhood
from pixtab.sources import tables

_NB = """
, n AS (SELECT a.image_id, a.y, a.x, count(b.image_id) AS n
        FROM {p} a LEFT JOIN {p} b ON a.image_id = b.image_id AND b.y BETWEEN a.y - 1 AND a.y + 1
          AND b.x BETWEEN a.x - 1 AND a.x + 1 AND (a.y <> b.y OR a.x <> b.x)
        GROUP BY ALL)"""
NB_GT = _NB.format(p="points_gt")


@query("d1_neighbour_count", fx.with_views("points_gt", NB_GT + """
SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(n AS INT) AS n FROM n"""))
def d1(spark, sf):
    return neighborhood.neighbour_counts(fx.points_gt(spark, sf))


@query("d2_endpoints", fx.with_views("points_gt", NB_GT + "SELECT image_id, y, x FROM n WHERE n = 1"))
def d2(spark, sf):
    return neighborhood.endpoints(fx.points_gt(spark, sf))


@query("d3_junctions", fx.with_views("points_gt", NB_GT + "SELECT image_id, y, x FROM n WHERE n > 2"))
def d3(spark, sf):
    return neighborhood.junctions(fx.points_gt(spark, sf))


@query("h18_special_counts", fx.with_views("points_gt", NB_GT + """
SELECT image_id, count(*) FILTER (n = 1) AS endpoints, count(*) FILTER (n > 2) AS junctions,
       count(*) FILTER (n = 1 OR n > 2) AS seeds FROM n GROUP BY image_id"""))
def h18(spark, sf):
    return neighborhood.special_counts(fx.points_gt(spark, sf))


def hits(tau: int) -> str:
    return f"""
, hp{tau} AS (SELECT p.image_id, count(*) FILTER (EXISTS (SELECT 1 FROM points_gt g WHERE g.image_id = p.image_id
     AND g.y BETWEEN p.y - {tau} AND p.y + {tau} AND (g.y-p.y)*(g.y-p.y) + (g.x-p.x)*(g.x-p.x) <= {tau * tau})) AS hit, count(*) AS n
   FROM points_pred p GROUP BY 1)
, hg{tau} AS (SELECT g.image_id, count(*) FILTER (EXISTS (SELECT 1 FROM points_pred p WHERE g.image_id = p.image_id
     AND p.y BETWEEN g.y - {tau} AND g.y + {tau} AND (g.y-p.y)*(g.y-p.y) + (g.x-p.x)*(g.x-p.x) <= {tau * tau})) AS hit, count(*) AS n
   FROM points_gt g GROUP BY 1)
, m{tau} AS (SELECT image_id, coalesce(hp{tau}.hit / hp{tau}.n, 0) AS p, coalesce(hg{tau}.hit / hg{tau}.n, 0) AS r
   FROM hp{tau} FULL JOIN hg{tau} USING (image_id))
, f{tau} AS (SELECT image_id, round(p, 6) AS precision_{tau}px, round(r, 6) AS recall_{tau}px,
     round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1_{tau}px FROM m{tau})"""


H1_SQL = fx.with_views("points_gt points_pred", hits(1) + hits(2) + hits(3) + """
SELECT * FROM f1 JOIN f2 USING (image_id) JOIN f3 USING (image_id)""")


@query("h1_tolerant_f1", H1_SQL)
def h1(spark, sf):
    return fx.rounded(metrics.tolerant_f1(fx.points_pred(spark, sf), fx.points_gt(spark, sf)))


@query("a12_csv_report", H1_SQL)
def a12(spark, sf):
    """The report is written as CSV and read back: what comes back is what was measured."""
    found = fx.rounded(metrics.tolerant_f1(fx.points_pred(spark, sf), fx.points_gt(spark, sf)))
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/report-{uuid.uuid4().hex}"
    tables.write_report(found, path)
    names = ["image_id bigint", *[f"{c} double" for c in tables.REPORT_COLUMNS[1:]]]
    return spark.read.schema(", ".join(names)).option("header", True).csv(path).select(*found.columns)


@query("h2_plain_f1", fx.with_views("points_gt points_pred", hits(2) + """
SELECT image_id, f1_2px AS f1, precision_2px AS precision, recall_2px AS recall FROM f2"""))
def h2(spark, sf):
    return fx.rounded(metrics.plain_f1(fx.points_pred(spark, sf), fx.points_gt(spark, sf)))


NEAR_SQL = """
, d AS (SELECT a.image_id, a.y, a.x, min((a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x)) AS d2
        FROM points_pred a JOIN points_gt b USING (image_id) GROUP BY ALL)
, e AS (SELECT a.image_id, a.y, a.x, min((a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x)) AS d2
        FROM points_gt a JOIN points_pred b USING (image_id) GROUP BY ALL)"""


@query("e1_nearest_distance", fx.with_views("points_gt points_pred", NEAR_SQL + """
SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(d2 AS BIGINT) AS d2 FROM d"""))
def e1(spark, sf):
    return distance.nearest_d2(fx.points_pred(spark, sf), fx.points_gt(spark, sf))


HD_CTE = NEAR_SQL + """
, hd AS (SELECT image_id, greatest(
      (SELECT quantile_cont(sqrt(d2::DOUBLE), 0.95) FROM d WHERE d.image_id = c.image_id),
      (SELECT quantile_cont(sqrt(d2::DOUBLE), 0.95) FROM e WHERE e.image_id = c.image_id)) AS v
    FROM (SELECT DISTINCT episode AS image_id FROM steps) c)"""


@query("h6_hd95", fx.with_views("points_gt points_pred", HD_CTE + """
SELECT image_id, round(CASE WHEN image_id NOT IN (SELECT image_id FROM points_pred) THEN sqrt(2 * 192.0 * 192.0)
                            ELSE v END, 6) AS hd95 FROM hd"""))
def h6(spark, sf):
    return fx.rounded(metrics.hd95(fx.points_pred(spark, sf), fx.points_gt(spark, sf), fx.curve_canvas(spark, sf)))


@query("e2_clipped_distance", fx.with_views("points_gt", """
, near AS (SELECT g.image_id, g.y + a.k AS y, g.x + b.k AS x, min(sqrt((a.k*a.k + b.k*b.k)::DOUBLE)) AS d
   FROM points_gt g, (SELECT unnest(range(-3, 4)) AS k) a, (SELECT unnest(range(-3, 4)) AS k) b GROUP BY ALL)
SELECT c.image_id, CAST(yy.k AS INT) AS y, count(*) AS n, round(sum(least(coalesce(d, 3.0), 3.0)::DOUBLE), 6) AS total
FROM (SELECT DISTINCT user_id AS image_id FROM events) c, (SELECT unnest(range(0, 192)) AS k) yy,
     (SELECT unnest(range(0, 192)) AS k) xx
LEFT JOIN near n ON n.image_id = c.image_id AND n.y = yy.k AND n.x = xx.k GROUP BY ALL"""))
def e2(spark, sf):
    d = distance.clipped_distance(fx.points_gt(spark, sf), fx.curve_canvas(spark, sf), 3.0)
    return fx.rounded(d.groupBy("image_id", "y").agg(F.count("v").alias("n"), F.sum("v").alias("total")))


@query("h13_overlay_classes", fx.with_views("points_gt points_pred", """
SELECT image_id, CASE WHEN p.image_id IS NULL THEN 'gt_only' WHEN g.image_id IS NULL THEN 'pred_only' ELSE 'match' END AS class,
       count(*) AS pixels
FROM points_gt g FULL JOIN points_pred p USING (image_id, y, x) GROUP BY ALL"""))
def h13(spark, sf):
    return metrics.overlay_counts(fx.points_pred(spark, sf), fx.points_gt(spark, sf))


@query("h12_box_coverage", fx.with_views("points_gt points_pred", """
, box AS (SELECT DISTINCT image_id, y + a.k AS y, x + b.k AS x FROM points_pred,
    (SELECT unnest(range(-2, 3)) AS k) a, (SELECT unnest(range(-2, 3)) AS k) b
    WHERE y + a.k BETWEEN 0 AND 191 AND x + b.k BETWEEN 0 AND 191)
SELECT image_id, CASE WHEN b.image_id IS NULL THEN 'missed' WHEN g.image_id IS NULL THEN 'extra' ELSE 'hit' END AS class,
       count(*) AS pixels
FROM points_gt g FULL JOIN box b USING (image_id, y, x) GROUP BY ALL"""))
def h12(spark, sf):
    return metrics.box_coverage(fx.points_pred(spark, sf), fx.points_gt(spark, sf), fx.curve_canvas(spark, sf))


@query("b7_inside_fov", fx.with_views("gray8 fov", """
SELECT image_id, y, x FROM gray8 SEMI JOIN fov USING (image_id, y, x) WHERE v > 127"""))
def b7(spark, sf):
    return metrics.inside(fx.gray8(spark, sf).where("v > 127").select("image_id", "y", "x"), fx.fov(spark, sf))
