"""Derived inputs: curves from ``events``, rasters from ``embeddings``, file lists from orders.

Each view exists twice: as a Spark DataFrame (scale-safe) and as a DuckDB CTE for the oracles.
Gaps and shifts of the predicted curves depend on event type and value. Canvases of curve images are
192 x 192; raster images are 64 pixels wide and up to 64 high.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixtab.functions.lineage import materialize
from pixtab.functions.scan import running
from pixtab.operators.morphology import dilate, disk_spans

SIDE = 192

_SQL = {
    "moves": ((), """
  SELECT user_id AS episode, event_id, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step,
         sum(CASE event_type WHEN 'error' THEN -1 WHEN 'signup' THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS turns
  FROM events"""),
    "dirs": (("moves",), """
  SELECT *, CASE WHEN act IN (7,0,1) THEN -1 WHEN act IN (3,4,5) THEN 1 ELSE 0 END AS dy,
            CASE WHEN act IN (1,2,3) THEN 1 WHEN act IN (5,6,7) THEN -1 ELSE 0 END AS dx
  FROM (SELECT *, ((episode + turns) % 8 + 8) % 8 AS act FROM moves)"""),
    "steps": (("dirs",), """
  SELECT episode, CAST(step AS INT) AS step, CAST(act AS INT) AS action, event_id, event_type, value,
         CAST(96 + sum(dy) OVER (PARTITION BY episode ORDER BY step ROWS UNBOUNDED PRECEDING) AS INT) AS y,
         CAST(96 + sum(dx) OVER (PARTITION BY episode ORDER BY step ROWS UNBOUNDED PRECEDING) AS INT) AS x
  FROM dirs"""),
    "points_gt": (("steps",), "SELECT DISTINCT episode AS image_id, y, x FROM steps"),
    "points_pred": (("steps",), """
  SELECT DISTINCT episode AS image_id,
         y + CASE WHEN event_type = 'view' AND value < 8 THEN 2 ELSE 0 END AS y,
         x + CASE WHEN event_type = 'click' AND value < 6 THEN 3 ELSE 0 END AS x
  FROM steps WHERE event_type <> 'purchase'"""),
    "mask_gt": (("points_gt",), """
  SELECT DISTINCT p.image_id, p.y + a.k AS y, p.x + b.k AS x
  FROM points_gt p, (SELECT unnest(range(-2, 3)) AS k) a, (SELECT unnest(range(-2, 3)) AS k) b
  WHERE a.k * a.k + b.k * b.k <= 4"""),
    "mask_pred": (("points_pred",), """
  SELECT DISTINCT p.image_id, p.y + a.k AS y, p.x + b.k AS x
  FROM points_pred p, (SELECT unnest(range(-2, 3)) AS k) a, (SELECT unnest(range(-2, 3)) AS k) b
  WHERE a.k * a.k + b.k * b.k <= 4"""),
    "raster": ((), """
  SELECT CAST(floor(vec_id / 64) AS INT) AS image_id, CAST(vec_id % 64 AS INT) AS y, CAST(i - 1 AS INT) AS x,
         CAST(embedding[i] AS DOUBLE) AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"""),
    "gray8": (("raster",), """
  SELECT image_id, y, x, CAST(least(255, greatest(0, floor((v + 0.6) * 212))) AS INT) AS v FROM raster"""),
    "prob": (("raster",), """
  SELECT image_id, y, x, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (v + 0.6::DOUBLE) / 1.2::DOUBLE)) AS v,
         CASE WHEN v > 0.1 THEN 1 ELSE 0 END AS gt FROM raster"""),
    "fov": (("raster",), "SELECT image_id, y, x FROM raster WHERE (y-32)*(y-32) + (x-32)*(x-32) <= 900"),
    "rollout": (("steps",), """
  SELECT episode, step, event_id, (value - 100.0::DOUBLE) / 193.7::DOUBLE AS reward,
         (event_id % 100) / 97.0::DOUBLE AS value, CASE WHEN step % 20 = 19 THEN 1 ELSE 0 END AS done
  FROM steps"""),
    "traces": (("steps",), """
  SELECT episode AS image_id, CAST(floor(step / 20) AS INT) AS trace_id, CAST(step % 20 AS INT) AS seq, y, x
  FROM steps"""),
    "files_image": ((), """
  SELECT concat(CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 4 = 0 THEN '_test' ELSE '_training' END, '.tif') AS name
  FROM customer"""),
    "files_vessel": ((), """
  SELECT DISTINCT concat(CAST(o_custkey AS VARCHAR), '_manual1.gif') AS name FROM orders WHERE o_orderstatus <> 'P'"""),
    "files_mask": ((), """
  SELECT DISTINCT concat(CAST(o_custkey AS VARCHAR), CASE WHEN o_custkey % 4 = 0 THEN '_test' ELSE '_training' END, '_mask.gif') AS name
  FROM orders WHERE o_orderstatus = 'F'"""),
}


def with_views(names: str, body: str) -> str:
    """DuckDB text: the named views (and what they need) as CTEs, then ``body``.

    ``body`` may begin with further CTEs introduced by a leading comma.
    """
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in _SQL[n][0]:
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names.split():
        visit(n)
    body = body.strip()
    recursive = "RECURSIVE " if "RECURSIVE" in body[:12].upper() else ""
    if recursive:
        body = body[body.upper().index("RECURSIVE") + 9:].strip()
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({_SQL[n][1]})" for n in order) + "\n" + body


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_STEPS: dict[tuple[str, str], DataFrame] = {}


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """The step log, derived from all of ``events`` once per session and shared by the queries."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STEPS:
        _STEPS[key] = materialize(derive_steps(spark, sf))
    return _STEPS[key]


def derive_steps(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select(F.col("user_id").alias("episode"), "event_id", "event_type", "value")
    turn = F.when(F.col("event_type") == "error", -1).when(F.col("event_type") == "signup", 1).otherwise(0)
    ev = running(ev, ["episode"], "event_id", {"n": ("sum", F.lit(1)), "turns": ("sum", turn)})
    act = F.pmod(F.col("episode") + F.col("turns"), F.lit(8)).cast("int")
    ev = ev.select("episode", (F.col("n") - 1).cast("int").alias("step"), act.alias("action"),
                   "event_id", "event_type", "value")
    dy = F.when(F.col("action").isin(7, 0, 1), -1).when(F.col("action").isin(3, 4, 5), 1).otherwise(0)
    dx = F.when(F.col("action").isin(1, 2, 3), 1).when(F.col("action").isin(5, 6, 7), -1).otherwise(0)
    out = running(ev, ["episode"], "step", {"sy": ("sum", dy), "sx": ("sum", dx)})
    return out.select("episode", "step", "action", "event_id", "event_type", "value",
                      (F.col("sy") + 96).cast("int").alias("y"), (F.col("sx") + 96).cast("int").alias("x"))


def points_gt(spark, sf):
    return steps(spark, sf).select(F.col("episode").alias("image_id"), "y", "x").distinct()


def points_pred(spark, sf):
    s = steps(spark, sf).where("event_type <> 'purchase'")
    return s.selectExpr(
        "episode AS image_id",
        "y + CASE WHEN event_type = 'view' AND value < 8 THEN 2 ELSE 0 END AS y",
        "x + CASE WHEN event_type = 'click' AND value < 6 THEN 3 ELSE 0 END AS x").distinct()


def mask_gt(spark, sf):
    return dilate(points_gt(spark, sf), disk_spans(2))


def mask_pred(spark, sf):
    return dilate(points_pred(spark, sf), disk_spans(2))


def curve_canvas(spark, sf):
    return (table(spark, sf, "events").select(F.col("user_id").alias("image_id")).distinct()
            .select("image_id", F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w")))


def raster(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    return e.select(F.floor(F.col("vec_id") / 64).cast("int").alias("image_id"),
                    (F.col("vec_id") % 64).cast("int").alias("y"), F.col("x").cast("int").alias("x"),
                    F.col("v").cast("double").alias("v"))


def gray8(spark, sf):
    return raster(spark, sf).selectExpr(
        "image_id", "y", "x", "cast(least(255, greatest(0, floor((v + 0.6D) * 212))) as int) AS v")


def prob(spark, sf):
    return raster(spark, sf).selectExpr(
        "image_id", "y", "x", "least(1.0D, greatest(0.0D, (v + 0.6D) / 1.2D)) AS v",
        "CASE WHEN v > 0.1D THEN 1 ELSE 0 END AS gt")


def fov(spark, sf):
    return raster(spark, sf).where("(y-32)*(y-32) + (x-32)*(x-32) <= 900").select("image_id", "y", "x")


def rollout(spark, sf):
    return steps(spark, sf).selectExpr(
        "episode", "step", "event_id", "(value - 100.0D) / 193.7D AS reward", "(event_id % 100) / 97.0D AS value",
        "CASE WHEN step % 20 = 19 THEN 1 ELSE 0 END AS done")


def traces(spark, sf):
    return steps(spark, sf).selectExpr(
        "episode AS image_id", "cast(floor(step / 20) as int) AS trace_id", "step % 20 AS seq", "y", "x")


def files_image(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "concat(c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '_test' ELSE '_training' END, '.tif') AS name")


def files_vessel(spark, sf):
    return (table(spark, sf, "orders").where("o_orderstatus <> 'P'")
            .selectExpr("concat(o_custkey, '_manual1.gif') AS name").distinct())


def files_mask(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'F'").selectExpr(
        "concat(o_custkey, CASE WHEN o_custkey % 4 = 0 THEN '_test' ELSE '_training' END, '_mask.gif') AS name").distinct()


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles so that the order of summation does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
