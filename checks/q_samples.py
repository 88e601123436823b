"""Manifests, splits, sampling, augmentation and expert pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.registry import query
from pixtab.operators import augment, splits
from pixtab.operators.distance import clipped_distance
from pixtab.plans import loader
from pixtab.sources import images, manifest, registry, tables


def _entries(spark, sf):
    return fx.table(spark, sf, "orders").selectExpr(
        "concat(substring(o_orderpriority, 3), ' set-', o_custkey) AS name", "o_orderkey AS seq", "o_orderstatus AS image_dir",
        "date_format(o_orderdate, 'yyyy') AS vessel_dir")


@query("a1_latest_registration", """
SELECT upper(replace(replace(concat(o_orderpriority[3:], ' set-', o_custkey), '-', '_'), ' ', '_')) AS name, max(o_orderkey) AS seq,
       max_by(o_orderstatus, o_orderkey) AS image_dir, max_by(strftime(o_orderdate, '%Y'), o_orderkey) AS vessel_dir
FROM orders GROUP BY 1""")
def a1(spark, sf):
    return registry.latest(_entries(spark, sf), "seq")


@query("a2_canonical_name", """
SELECT o_orderkey, upper(replace(replace(o_orderpriority, '-', '_'), ' ', '_')) AS name FROM orders""")
def a2(spark, sf):
    return fx.table(spark, sf, "orders").select("o_orderkey", registry.canonical_name(F.col("o_orderpriority")).alias("name"))


@query("a3_file_listing")
def a3(spark, sf):
    return manifest.list_files(spark, sf, "*.parquet").select("name")


@query("a4_resolve_roots", """
WITH d AS (SELECT CAST(c_custkey AS VARCHAR) AS dataset, concat('/data/', c_custkey, CASE WHEN c_nationkey < 8 THEN '/training' ELSE '' END) AS root,
   CASE WHEN c_mktsegment <> 'BUILDING' THEN 'training' END AS tr, CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'test' END AS te FROM customer)
, ex AS (SELECT DISTINCT concat('/data/', o_custkey, '/training') AS p FROM orders WHERE o_orderstatus = 'F')
, r AS (SELECT *, tr IS NOT NULL AND concat(root, '/', tr) IN (SELECT p FROM ex) AS has FROM d)
, b AS (SELECT *, CASE WHEN NOT has AND tr IS NOT NULL AND root LIKE '%/training' THEN root[:-10] ELSE root END AS base FROM r)
SELECT dataset, base AS base_root, CASE WHEN has THEN concat(root, '/', tr) ELSE root END AS train_root,
       CASE WHEN te IS NOT NULL THEN concat(base, '/', te) END AS test_root FROM b""")
def a4(spark, sf):
    d = fx.table(spark, sf, "customer").selectExpr(
        "cast(c_custkey as string) AS dataset", "concat('/data/', c_custkey, CASE WHEN c_nationkey < 8 THEN '/training' ELSE '' END) AS root_dir",
        "CASE WHEN c_mktsegment <> 'BUILDING' THEN 'training' END AS train_subdir", "CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'test' END AS test_subdir")
    e = fx.table(spark, sf, "orders").where("o_orderstatus = 'F'").selectExpr("concat('/data/', o_custkey, '/training') AS path")
    return manifest.resolve_roots(d, e)


def samples(spark, sf):
    return manifest.discover(fx.files_image(spark, sf), fx.files_vessel(spark, sf), fx.files_mask(spark, sf), ".gif", "_mask.gif", "drive")


SAMPLES = """
, samples AS (SELECT s AS image_id, i.name AS image_path, v.name AS vessel_path, m.name AS mask_path
  FROM (SELECT name, replace(name, '.tif', '') AS s FROM files_image) i
  JOIN files_vessel v ON v.name = concat(replace(replace(s, '_training', '_manual1'), '_test', '_manual1'), '.gif')
  LEFT JOIN files_mask m ON m.name = concat(s, '_mask.gif'))"""


@query("a5_discover_samples", fx.with_views("files_image files_vessel files_mask", SAMPLES + "SELECT * FROM samples"))
def a5(spark, sf):
    return samples(spark, sf)


LISTED = """
WITH lay(dataset, vsuf, msuf, drive) AS (VALUES ('drive', '.gif', '_mask.gif', true), ('hrf', '.tif', '_mask.tif', false), ('AV-WIDE', '_vessels.png', NULL, false))
, img AS (SELECT CASE c_nationkey % 4 WHEN 0 THEN 'drive' WHEN 1 THEN 'hrf' WHEN 2 THEN 'AV-WIDE' ELSE 'unknown' END AS dataset, concat(c_custkey, '_training.tif') AS name,
    concat(c_custkey, '_training') AS image_id, c_custkey FROM customer)
, ord AS (SELECT DISTINCT c_custkey, c_nationkey % 4 AS k, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey)
, ves AS (SELECT DISTINCT CASE k WHEN 0 THEN 'drive' WHEN 1 THEN 'hrf' WHEN 2 THEN 'AV-WIDE' ELSE 'unknown' END AS dataset,
    CASE k WHEN 0 THEN concat(c_custkey, '_manual1.gif') WHEN 1 THEN concat(c_custkey, '_training.tif') ELSE concat(c_custkey, '_training_vessels.png') END AS name FROM ord WHERE o_orderstatus <> 'P')
, mas AS (SELECT DISTINCT CASE k WHEN 0 THEN 'drive' ELSE 'hrf' END AS dataset, concat(c_custkey, '_training_mask', CASE k WHEN 0 THEN '.gif' ELSE '.tif' END) AS name FROM ord WHERE o_orderstatus = 'F' AND k < 2)
, man AS (SELECT i.dataset, i.image_id, i.name AS image_path, v.name AS vessel_path, m.name AS mask_path,
    row_number() OVER (PARTITION BY i.dataset ORDER BY i.image_id) AS rn, count(*) OVER (PARTITION BY i.dataset) AS n
  FROM img i JOIN lay USING (dataset) JOIN ves v ON v.dataset = i.dataset AND v.name = concat(CASE WHEN drive THEN replace(i.image_id, '_training', '_manual1') ELSE i.image_id END, vsuf)
  LEFT JOIN mas m ON m.dataset = i.dataset AND m.name = concat(i.image_id, msuf))
SELECT dataset, image_id, image_path, vessel_path, mask_path, CASE WHEN rn <= CAST(floor(0.7::DOUBLE * n) AS INT) THEN 'train'
  WHEN rn <= CAST(floor((0.7::DOUBLE + 0.15::DOUBLE) * n) AS INT) THEN 'val' ELSE 'test' END AS split FROM man"""


@query("loader_manifest", LISTED)
def loaded(spark, sf):
    """Three layouts at once, as names of customers and their orders; a fourth dataset has no layout."""
    which = "CASE {} % 4 WHEN 0 THEN 'drive' WHEN 1 THEN 'hrf' WHEN 2 THEN 'AV-WIDE' ELSE 'unknown' END AS dataset".format
    customer = fx.table(spark, sf, "customer")
    files = customer.selectExpr(which("c_nationkey"), "concat(c_custkey, '_training.tif') AS name")
    ordered = fx.table(spark, sf, "orders").join(customer, F.col("c_custkey") == F.col("o_custkey")).selectExpr("c_custkey", "c_nationkey", "o_orderstatus")
    vessels = ordered.where("o_orderstatus <> 'P'").selectExpr(
        which("c_nationkey"), "concat(c_custkey, CASE c_nationkey % 4 WHEN 0 THEN '_manual1.gif' WHEN 1 THEN '_training.tif' ELSE '_training_vessels.png' END) AS name")
    masks = ordered.where("o_orderstatus = 'F' AND c_nationkey % 4 < 2").selectExpr(
        which("c_nationkey"), "concat(c_custkey, '_training_mask', CASE c_nationkey % 4 WHEN 0 THEN '.gif' ELSE '.tif' END) AS name")
    return loader.load_manifest(registry.registry(spark), files, vessels, masks)


@query("a6_pair_by_prefix", fx.with_views("files_image files_vessel files_mask", """
, i AS (SELECT split_part(name, '_', 1) AS image_id, name AS image_path FROM files_image)
SELECT image_id, image_path, (SELECT min(name) FROM files_vessel v WHERE starts_with(v.name, image_id)) AS vessel_path,
       (SELECT min(name) FROM files_mask m WHERE starts_with(m.name, image_id)) AS mask_path
FROM i WHERE EXISTS (SELECT 1 FROM files_vessel v WHERE starts_with(v.name, image_id))"""))
def a6(spark, sf):
    return manifest.pair_by_prefix(fx.files_image(spark, sf), fx.files_mask(spark, sf), fx.files_vessel(spark, sf), missing_mask="null")


@query("a7_pair_by_position", fx.with_views("files_image files_vessel files_mask", """
SELECT i.rn AS position, i.name AS image_path, v.name AS vessel_path, m.name AS mask_path
FROM (SELECT *, row_number() OVER (ORDER BY name) AS rn FROM files_image) i JOIN (SELECT *, row_number() OVER (ORDER BY name) AS rn FROM files_vessel) v USING (rn)
JOIN (SELECT *, row_number() OVER (ORDER BY name) AS rn FROM files_mask) m USING (rn)"""))
def a7(spark, sf):
    return manifest.pair_by_position(fx.files_image(spark, sf), fx.files_vessel(spark, sf), fx.files_mask(spark, sf), check=False)


@query("a8_unpack_pixels", fx.with_views("gray8", """
SELECT image_id, y, x, v AS r, 255 - v AS g, CAST(v // 2 AS INT) AS b FROM gray8"""))
def a8(spark, sf):
    hex2 = lambda c: F.lpad(F.hex(c), 2, "0")
    px = fx.gray8(spark, sf).select("image_id", "y", "x", F.concat(
        hex2(F.floor(F.col("v") / 2)), hex2(255 - F.col("v")), hex2(F.col("v"))).alias("h"))
    packed = px.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.lit(3).alias("nChannels"),
                                        F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "h"))), lambda s: s["h"]), "")).alias("data"))
    return images.unpack_pixels(packed)


@query("a9_binarise", fx.with_views("gray8", "SELECT image_id, y, x, t FROM gray8, (VALUES (127), (128)) AS b(t) WHERE v > t"))
def a9(spark, sf):
    g = fx.gray8(spark, sf)
    return images.binarise(g, 127).withColumn("t", F.lit(127)).unionByName(images.binarise(g, 128).withColumn("t", F.lit(128)))


@query("a10_missing_centerlines", fx.with_views("files_image files_vessel files_mask", SAMPLES + """
SELECT image_id FROM samples WHERE split_part(image_id, '_', 1) NOT IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT')"""))
def a10(spark, sf):
    todo = tables.with_params(samples(spark, sf).withColumn("dataset", F.lit("D")), min_size=50, prune=10)
    done = fx.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").selectExpr("cast(o_custkey as string) AS c").distinct()
    done = samples(spark, sf).select("image_id").withColumn("c", F.substring_index("image_id", "_", 1)).join(done, "c", "left_semi")
    done = tables.with_params(done.select("image_id").withColumn("dataset", F.lit("D")), prune=10, min_size=50)
    return tables.missing(todo, done).select("image_id")


@query("a11_combined_datasets", fx.with_views("files_image files_vessel", """
SELECT 'image' AS dataset, name FROM files_image UNION ALL SELECT 'vessel', name FROM files_vessel"""))
def a11(spark, sf):
    return manifest.combine(image=fx.files_image(spark, sf), vessel=fx.files_vessel(spark, sf))


@query("a13_agent_tables", fx.with_views("gray8 fov", """
, m AS (SELECT image_id, y, x FROM gray8 WHERE v > 127)
, near AS (SELECT m.image_id, m.y + a.k AS y, m.x + b.k AS x, min(sqrt((a.k*a.k+b.k*b.k)::DOUBLE)) AS d FROM m, (SELECT unnest(range(-2, 3)) AS k) a,
    (SELECT unnest(range(-2, 3)) AS k) b GROUP BY ALL)
SELECT image_id, y, x, round(v / 255, 6) AS image, round(least(coalesce(d, 2.0), 2.0)::DOUBLE, 6) AS distance, m.image_id IS NOT NULL AS vessel,
       fov.image_id IS NOT NULL AS fov FROM gray8 LEFT JOIN near USING (image_id, y, x) LEFT JOIN m USING (image_id, y, x) LEFT JOIN fov USING (image_id, y, x)"""))
def a13(spark, sf):
    g = fx.gray8(spark, sf)
    px = g.select("image_id", "y", "x", *[F.col("v").alias(c) for c in "rgb"])
    mask = images.binarise(g)
    canvas = g.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    t = tables.rl_agent_tables(px, mask, mask, fx.fov(spark, sf), clipped_distance(mask, canvas, 2.0))
    key = ["image_id", "y", "x"]
    yes = lambda n: t[n].withColumn(n, F.lit(True))
    out = (t["image"].join(t["distance"].withColumnRenamed("v", "distance"), key).join(yes("vessel_mask"), key, "left").join(yes("fov_mask"), key, "left"))
    return fx.rounded(out.select(*key, F.col("r").alias("image"), "distance", F.coalesce("vessel_mask", F.lit(False)).alias("vessel"),
                                 F.coalesce("fov_mask", F.lit(False)).alias("fov")))


@query("a13_tracer_tables", fx.with_views("gray8", "SELECT image_id, count(*) AS n, CAST(sum(255) AS BIGINT) AS total FROM gray8 WHERE v > 127 GROUP BY 1"))
def a13b(spark, sf):
    g = fx.gray8(spark, sf)
    px = g.select("image_id", "y", "x", *[F.col("v").alias(c) for c in "rgb"])
    m = images.binarise(g)
    return tables.frangi_tables(px, m, m, m)["vessel_mask"].groupBy("image_id").agg(F.count("v").alias("n"), F.sum("v").alias("total"))


@query("a14_choose_fov", fx.with_views("gray8 fov", """
, bright AS (SELECT image_id, y, x FROM gray8 WHERE v > 220)
SELECT image_id, y, x FROM bright UNION ALL SELECT image_id, y, x FROM fov WHERE image_id NOT IN (SELECT image_id FROM bright)"""))
def a14(spark, sf):
    g = fx.gray8(spark, sf)
    return tables.choose_fov(g.select("image_id").distinct(), images.binarise(g, 220), fx.fov(spark, sf))


def by_segment(spark, sf):
    return fx.table(spark, sf, "customer").selectExpr("c_mktsegment AS dataset", "c_name AS image_id", "c_acctbal", "c_nationkey")


B_CTE = """WITH c AS (SELECT c_mktsegment AS dataset, c_name AS image_id, c_acctbal, c_nationkey FROM customer)
, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY image_id) AS rn, count(*) OVER (PARTITION BY dataset) AS n FROM c)
"""
_T = "CAST(floor(0.7::DOUBLE * n) AS INT)"
_V = "CAST(floor((0.7::DOUBLE + 0.15::DOUBLE) * n) AS INT)"


@query("b1_three_way_split", B_CTE + f"SELECT dataset, image_id, CASE WHEN rn <= {_T} THEN 'train' WHEN rn <= {_V} THEN 'val' ELSE 'test' END AS split FROM r")
def b1(spark, sf):
    return splits.three_way(by_segment(spark, sf)).select("dataset", "image_id", "split")


@query("b2_train_val_split", B_CTE + """SELECT dataset, image_id, CASE WHEN rn <= greatest(1, least(CAST(floor(0.7::DOUBLE / (0.7::DOUBLE + 0.15::DOUBLE) * n) AS INT), n - 1))
   THEN 'train' ELSE 'val' END AS split FROM r""")
def b2(spark, sf):
    return splits.train_val(by_segment(spark, sf)).select("dataset", "image_id", "split")


@query("b3_official_test", f"""WITH c AS (SELECT c_mktsegment AS dataset, c_name AS image_id,
    CASE WHEN c_nationkey = 3 AND c_mktsegment < 'F' THEN 'test' ELSE 'train' END AS part FROM customer)
, h AS (SELECT DISTINCT dataset FROM c WHERE part = 'test')
, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY image_id) AS rn, count(*) OVER (PARTITION BY dataset) AS n FROM c WHERE part <> 'test')
SELECT dataset, image_id FROM c WHERE part = 'test' UNION ALL SELECT dataset, image_id FROM r WHERE dataset NOT IN (SELECT dataset FROM h) AND rn > {_V}""")
def b3(spark, sf):
    part = "CASE WHEN c_nationkey = 3 AND dataset < 'F' THEN 'test' ELSE 'train' END AS part"
    return splits.official_test(by_segment(spark, sf).selectExpr("dataset", "image_id", part)).select("dataset", "image_id")


@query("b4_id_ranges", """SELECT c_custkey, CASE WHEN c_nationkey BETWEEN 2 AND 15 THEN 'train' WHEN c_nationkey BETWEEN 16 AND 18 THEN 'val' ELSE 'test' END AS split
FROM customer WHERE c_nationkey BETWEEN 2 AND 21""")
def b4(spark, sf):
    return splits.by_ranges(fx.table(spark, sf, "customer"), {"train": (2, 15), "val": (16, 18), "test": (19, 21)},
                            F.col("c_nationkey")).select("c_custkey", "split")


@query("b5_head_tail_split", """SELECT o_orderkey, CASE WHEN rn <= CAST(floor(0.9::DOUBLE * n) AS INT) THEN 'train' ELSE 'val' END AS split
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)""")
def b5(spark, sf):
    return splits.head_tail(fx.table(spark, sf, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "split")


@query("b6_difficulty_filter", """WITH c AS (SELECT c_nationkey AS dataset, c_name AS image_id, c_acctbal <= 500 AS ok FROM customer)
, k AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY dataset) AS n, row_number() OVER (PARTITION BY dataset ORDER BY image_id) AS rn FROM c)
SELECT dataset, image_id FROM k WHERE CASE WHEN n >= 10 THEN ok ELSE rn <= 10 END""")
def b6(spark, sf):
    s = fx.table(spark, sf, "customer").selectExpr("c_nationkey AS dataset", "c_name AS image_id", "c_acctbal")
    return splits.by_difficulty(s, F.col("c_acctbal"), 500).select("dataset", "image_id")


START = """
, n AS (SELECT a.image_id, a.y, a.x, count(b.image_id) AS n FROM points_gt a LEFT JOIN points_gt b ON a.image_id = b.image_id
   AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND (a.y <> b.y OR a.x <> b.x) GROUP BY ALL)
, c AS (SELECT image_id, y, x, CASE WHEN n = 1 THEN 0 ELSE 1 END AS k FROM n)"""


@query("b8_first_start", fx.with_views("points_gt", START + """
SELECT e.image_id, coalesce(arg_min(y, k * 1000000 + y * 1000 + x), 96) AS y, coalesce(arg_min(x, k * 1000000 + y * 1000 + x), 96) AS x
FROM (SELECT DISTINCT user_id AS image_id FROM events) e LEFT JOIN c USING (image_id) GROUP BY 1"""))
def b8(spark, sf):
    gt = fx.points_gt(spark, sf)
    return splits.start_positions(gt, gt.where("y < 0"), fx.curve_canvas(spark, sf))


@query("b8_seeded_start", fx.with_views("points_gt", START + """
, pool AS (SELECT * FROM c WHERE image_id % 3 <> 0 UNION ALL
   SELECT u.image_id, CAST(u.image_id % 50 + i AS INT), CAST(40 + i AS INT), 2 FROM (SELECT DISTINCT user_id AS image_id FROM events) u, range(0, 4) AS r(i) WHERE u.image_id % 2 = 0)
SELECT e.image_id, coalesce(arg_min(y, concat(k, md5(concat_ws(':', 7, image_id, y, x)))), 96) AS y, coalesce(arg_min(x, concat(k, md5(concat_ws(':', 7, image_id, y, x)))), 96) AS x
FROM (SELECT DISTINCT user_id AS image_id FROM events) e LEFT JOIN pool USING (image_id) GROUP BY 1"""))
def b8s(spark, sf):
    """Some images have no curve, and of those some have no field of view either."""
    canvas = fx.curve_canvas(spark, sf)
    fov = canvas.where("image_id % 2 = 0").selectExpr("image_id", "explode(sequence(0, 3)) AS i").selectExpr(
        "image_id", "cast(image_id % 50 + i as int) AS y", "cast(40 + i as int) AS x")
    return splits.start_positions(fx.points_gt(spark, sf).where("image_id % 3 <> 0"), fov, canvas, seed=7)


@query("b9_existing_ids", "SELECT c_custkey AS image_id FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
def b9(spark, sf):
    return splits.existing_only(fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("image_id")),
                                fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("image_id")))


TURN = """
, t(transform) AS (VALUES ('flip_h'), ('flip_v'), ('rot90'), ('rot180'), ('rot270'))
, turned AS (SELECT concat(image_id, '_', transform) AS image_id, transform, trace_id, seq,
   CASE transform WHEN 'flip_h' THEN y WHEN 'rot90' THEN x WHEN 'rot270' THEN 191 - x ELSE 191 - y END AS y,
   CASE transform WHEN 'flip_v' THEN x WHEN 'rot90' THEN 191 - y WHEN 'rot270' THEN y ELSE 191 - x END AS x FROM traces, t)"""


@query("g22_geometric_copies", fx.with_views("traces", TURN + "SELECT * FROM turned"))
def g22(spark, sf):
    return augment.transform_points(fx.traces(spark, sf), fx.curve_canvas(spark, sf))


@query("g23_action_remap", fx.with_views("traces", TURN + """
, m AS (SELECT image_id, trace_id, seq, lead(y) OVER w - y AS dy, lead(x) OVER w - x AS dx FROM turned WINDOW w AS (PARTITION BY image_id, trace_id ORDER BY seq))
SELECT image_id, trace_id, seq, CAST(CASE WHEN dy=-1 AND dx=0 THEN 0 WHEN dy=-1 AND dx=1 THEN 1 WHEN dy=0 AND dx=1 THEN 2 WHEN dy=1 AND dx=1 THEN 3
  WHEN dy=1 AND dx=0 THEN 4 WHEN dy=1 AND dx=-1 THEN 5 WHEN dy=0 AND dx=-1 THEN 6 WHEN dy=-1 AND dx=-1 THEN 7 END AS INT) AS action FROM m WHERE dy IS NOT NULL"""))
def g23(spark, sf):
    pairs = augment.expert_pairs(fx.traces(spark, sf), fx.curve_canvas(spark, sf), 0)
    t = augment.transform_points(pairs, fx.curve_canvas(spark, sf))
    return t.select("image_id", "trace_id", "seq", augment.remap_action(F.col("action"), F.col("transform")).alias("action"))


@query("g21_expert_pairs", fx.with_views("traces", """
, m AS (SELECT *, lead(y) OVER w - y AS dy, lead(x) OVER w - x AS dx FROM traces WINDOW w AS (PARTITION BY image_id, trace_id ORDER BY seq))
, a AS (SELECT image_id, trace_id, seq, y, x, CAST(CASE WHEN dy=-1 AND dx=0 THEN 0 WHEN dy=-1 AND dx=1 THEN 1 WHEN dy=0 AND dx=1 THEN 2 WHEN dy=1 AND dx=1 THEN 3
  WHEN dy=1 AND dx=0 THEN 4 WHEN dy=1 AND dx=-1 THEN 5 WHEN dy=0 AND dx=-1 THEN 6 WHEN dy=-1 AND dx=-1 THEN 7 END AS INT) AS action
  FROM m WHERE dy IS NOT NULL AND y BETWEEN 60 AND 131 AND x BETWEEN 60 AND 131)
SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY trace_id, seq) AS "order" FROM a WHERE action IS NOT NULL"""))
def g21(spark, sf):
    return augment.expert_pairs(fx.traces(spark, sf), fx.curve_canvas(spark, sf), 60)


@query("c6_jitter", fx.with_views("prob", """
SELECT image_id, y, x, variant, round(least(greatest(v * c + (b - 1) * 0.5, 0), 1)::DOUBLE, 6) AS v
FROM prob, (VALUES (0, 0.8::DOUBLE, 1.0::DOUBLE), (1, 1.2, 1.0), (2, 1.0, 0.8), (3, 1.0, 1.2)) AS j(variant, b, c)"""))
def c6(spark, sf):
    return fx.rounded(augment.jitter(fx.prob(spark, sf).select("image_id", "y", "x", "v"), ("v",)))
