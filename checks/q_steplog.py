"""Trajectory, reward, return and curriculum operators over curves logged in ``events``.

The annotation of an episode is the curve of the next one, so paths leave and rejoin it. A long
``purchase`` ends an episode with STOP.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.registry import query
from pixtab.functions.keys import spread_out
from pixtab.functions.lineage import materialize
from pixtab.functions.scan import rolling_mean
from pixtab.operators import curriculum, returns, steplog
from pixtab.plans import replay

TOL, CLIP, HALF, STREAK, MAX_STEPS = 2.0, 5.0, 40, 12, 60


def log(spark, sf):
    s = fx.steps(spark, sf)
    act = F.when((F.col("event_type") == "purchase") & (F.col("value") > 80), 8).otherwise(F.col("action"))
    return s.select("episode", "step", act.alias("action"), "y", "x", (F.col("episode") + 1).alias("image_id"))


def canvas(spark, sf):
    return fx.curve_canvas(spark, sf).select((F.col("image_id") + 1).alias("image_id"), "h", "w")


LOG = """
, log AS (SELECT episode, step, CASE WHEN event_type = 'purchase' AND value > 80 THEN 8 ELSE action END AS action,
          y, x, episode + 1 AS image_id FROM steps)"""
DIST = LOG + """
, dist AS (SELECT l.*, coalesce((SELECT min(sqrt(((g.y-l.y)*(g.y-l.y) + (g.x-l.x)*(g.x-l.x))::DOUBLE)) FROM points_gt g
             WHERE g.image_id = l.image_id AND abs(g.y-l.y) <= 5 AND (g.y-l.y)*(g.y-l.y) + (g.x-l.x)*(g.x-l.x) <= 25), 5.0) AS distance
           FROM log l)
, valid AS (SELECT l.*, y BETWEEN 40 AND 151 AND x BETWEEN 40 AND 151 AND abs(x - 96) <= 48 AS is_valid,
              distance <= 2 AS on_track,
              row_number() OVER (PARTITION BY episode, y, x ORDER BY step) > 1 OR (y = 96 AND x = 96) AS is_revisit FROM dist l)
, streak AS (SELECT *, CASE WHEN on_track THEN 0 ELSE row_number() OVER (PARTITION BY episode, grp, on_track ORDER BY step) END AS streak
   FROM (SELECT *, sum(CASE WHEN on_track THEN 1 ELSE 0 END) OVER (PARTITION BY episode ORDER BY step ROWS UNBOUNDED PRECEDING) AS grp FROM valid))"""
ENDS = DIST + """
, why AS (SELECT *, CASE WHEN action = 8 THEN 'stop' WHEN NOT is_valid THEN 'out_of_bounds' WHEN streak >= 12 THEN 'off_track'
            WHEN step + 1 >= 60 THEN 'truncated' END AS r FROM streak)
, ends AS (SELECT episode, min(step) FILTER (r IS NOT NULL) AS end_step, min_by(r, step) FILTER (r IS NOT NULL) AS reason
           FROM why GROUP BY episode)"""
COVER = """
, travel AS (SELECT episode, image_id, y, x, step FROM {t} WHERE action <> 8 AND {ok}
     UNION ALL SELECT DISTINCT episode, image_id, 96, 96, -1 FROM log)
, reach AS (SELECT l.episode, g.image_id, g.y, g.x, min(l.step) AS step FROM travel l JOIN points_gt g
     ON g.image_id = l.image_id AND abs(g.y - l.y) <= 2 AND (g.y-l.y)*(g.y-l.y) + (g.x-l.x)*(g.x-l.x) <= 4 GROUP BY ALL)
, gain AS (SELECT episode, step, count(*) AS n FROM reach GROUP BY ALL)
, tot AS (SELECT image_id, count(*) AS total FROM points_gt GROUP BY ALL)
, cov AS (SELECT l.*, coalesce(n, 0) AS new_coverage, coalesce(total, 0) AS total,
     sum(coalesce(n, 0)) OVER (PARTITION BY l.episode ORDER BY l.step ROWS UNBOUNDED PRECEDING) + coalesce(b.n0, 0) AS covered
     FROM {t} l LEFT JOIN gain USING (episode, step) LEFT JOIN tot USING (image_id)
     LEFT JOIN (SELECT episode, n AS n0 FROM gain WHERE step = -1) b USING (episode))
, began AS (SELECT e.episode, coalesce(min(sqrt(((g.y-96)*(g.y-96) + (g.x-96)*(g.x-96))::DOUBLE)), 5.0) AS d0
     FROM (SELECT DISTINCT episode, image_id FROM log) e LEFT JOIN points_gt g
       ON g.image_id = e.image_id AND (g.y-96)*(g.y-96) + (g.x-96)*(g.x-96) <= 25 GROUP BY 1)"""
REWARD = ENDS + """
, kept AS (SELECT s.*, CASE WHEN s.step = e.end_step THEN e.reason END AS reason FROM streak s JOIN ends e USING (episode)
           WHERE e.end_step IS NULL OR s.step <= e.end_step)""" + COVER.format(t="kept", ok="is_valid") + """
, rew AS (SELECT *, CASE WHEN is_revisit THEN -0.5::DOUBLE ELSE greatest(0, 1 - distance / 2) END
     + 2 * new_coverage + CASE WHEN on_track THEN 0 ELSE -1 END - 0.01::DOUBLE
     + coalesce(lag(distance) OVER (PARTITION BY episode ORDER BY step), d0) - 0.99::DOUBLE * distance AS base FROM cov JOIN began USING (episode))
, final AS (SELECT *, CASE reason WHEN 'stop' THEN 10 * CASE WHEN covered > 0 THEN 2 * (covered / total) / (1 + covered / total) ELSE 0 END
     WHEN 'out_of_bounds' THEN -10 WHEN 'off_track' THEN base - 5 ELSE base END::DOUBLE AS reward FROM rew)"""


def judged(spark, sf):
    return replay.judge_steps(log(spark, sf), fx.points_gt(spark, sf), canvas(spark, sf), HALF, TOL, CLIP,
                              fov_all(spark, sf), starts(spark, sf))


def starts(spark, sf):
    """Every curve begins at the middle of its image, before its first move."""
    return log(spark, sf).select("episode", "image_id", F.lit(96).alias("y"), F.lit(96).alias("x")).distinct()


def fov_all(spark, sf):
    """Field of view of every image: the columns within 48 of the centre."""
    rows = spread_out(canvas(spark, sf), "image_id").selectExpr("image_id", "h", "explode(sequence(48, 144)) AS x")
    return rows.selectExpr("image_id", "x", "explode(sequence(0, h - 1)) AS y")


def rewarded(spark, sf):
    return replay.reward_steps(log(spark, sf), fx.points_gt(spark, sf), canvas(spark, sf), HALF, TOL, CLIP,
                               STREAK, MAX_STEPS, fov_all(spark, sf), starts=starts(spark, sf))


@query("g1_action_lookup", fx.with_views("steps", """
, m AS (SELECT episode, step, y - lag(y) OVER w AS dy, x - lag(x) OVER w AS dx FROM steps WINDOW w AS (PARTITION BY episode ORDER BY step))
SELECT episode, step, CAST(CASE WHEN dy=-1 AND dx=0 THEN 0 WHEN dy=-1 AND dx=1 THEN 1 WHEN dy=0 AND dx=1 THEN 2 WHEN dy=1 AND dx=1 THEN 3
  WHEN dy=1 AND dx=0 THEN 4 WHEN dy=1 AND dx=-1 THEN 5 WHEN dy=0 AND dx=-1 THEN 6 WHEN dy=-1 AND dx=-1 THEN 7 ELSE 8 END AS INT) AS action
FROM m"""))
def g1(spark, sf):
    s = steplog.neighbour(fx.steps(spark, sf), ["episode"], "step", {"py": "y", "px": "x"})
    return s.select("episode", "step", steplog.action_of(F.col("y") - F.col("py"), F.col("x") - F.col("px")).alias("action"))


@query("g2_replay_positions", fx.with_views("steps", LOG + """
SELECT episode, step, CAST(100 + sum(2 * CASE WHEN action IN (7,0,1) THEN -1 WHEN action IN (3,4,5) THEN 1 ELSE 0 END) OVER w AS INT) AS y,
       CAST(90 + sum(2 * CASE WHEN action IN (1,2,3) THEN 1 WHEN action IN (5,6,7) THEN -1 ELSE 0 END) OVER w AS INT) AS x
FROM log WINDOW w AS (PARTITION BY episode ORDER BY step ROWS UNBOUNDED PRECEDING)"""))
def g2(spark, sf):
    acts = log(spark, sf).select("episode", "step", "action")
    starts = fx.table(spark, sf, "events").selectExpr("user_id AS episode", "100 AS y", "90 AS x").distinct()
    return steplog.replay_positions(acts, starts, 2).select("episode", "step", "y", "x")


@query("g3_valid_positions", fx.with_views("points_gt", DIST + "SELECT episode, step, is_valid FROM valid"))
def g3(spark, sf):
    return (steplog.with_validity(log(spark, sf), canvas(spark, sf), HALF, fov_all(spark, sf))
            .select("episode", "step", "is_valid"))


@query("g4_revisits", fx.with_views("points_gt", DIST + "SELECT episode, step, is_revisit FROM valid"))
def g4(spark, sf):
    return steplog.with_revisit(log(spark, sf), starts(spark, sf)).select("episode", "step", "is_revisit")


@query("g5_distance_on_track", fx.with_views("points_gt", DIST + "SELECT episode, step, round(distance, 6) AS distance, on_track FROM valid"))
def g5(spark, sf):
    return fx.rounded(steplog.with_distance(log(spark, sf), fx.points_gt(spark, sf), TOL, CLIP)
                      .select("episode", "step", "distance", "on_track"))


@query("g6_off_track_streak", fx.with_views("points_gt", DIST + "SELECT episode, step, CAST(streak AS INT) AS streak FROM streak"))
def g6(spark, sf):
    return judged(spark, sf).select("episode", "step", "streak")


@query("g7_episode_ends", fx.with_views("points_gt", ENDS + "SELECT episode, end_step, reason FROM ends"))
def g7(spark, sf):
    return steplog.episode_ends(judged(spark, sf), STREAK, MAX_STEPS)


@query("g8_coverage_gain", fx.with_views("points_gt", LOG + COVER.format(t="log", ok="true") + """
SELECT episode, step, CAST(new_coverage AS BIGINT) AS new_coverage, CAST(covered AS BIGINT) AS covered,
       round(covered / greatest(total, 1), 6) AS coverage_ratio FROM cov"""))
def g8(spark, sf):
    return fx.rounded(steplog.with_coverage(log(spark, sf), fx.points_gt(spark, sf), TOL, starts(spark, sf))
                      .select("episode", "step", "new_coverage", "covered", "coverage_ratio"))


@query("g9_step_reward", fx.with_views("points_gt", REWARD + "SELECT episode, step, round(base, 6) AS reward FROM rew"))
def g9(spark, sf):
    return fx.rounded(rewarded_steps_only(spark, sf).select("episode", "step", "reward"))


def rewarded_steps_only(spark, sf):
    s = judged(spark, sf)
    s = materialize(steplog.upto_end(s, steplog.episode_ends(s, STREAK, MAX_STEPS)))
    covered = materialize(steplog.with_coverage(s, fx.points_gt(spark, sf), TOL, starts(spark, sf)))
    return steplog.with_step_reward(covered, TOL, starts=steplog.with_distance(starts(spark, sf), fx.points_gt(spark, sf), TOL, CLIP))


@query("g10_end_reward", fx.with_views("points_gt", REWARD + """
SELECT episode, step, reason, round(reward, 6) AS reward FROM final WHERE reason IS NOT NULL"""))
def g10(spark, sf):
    return fx.rounded(rewarded(spark, sf).where("reason IS NOT NULL").select("episode", "step", "reason", "reward"))


@query("g11_episode_returns", fx.with_views("points_gt", REWARD + """
SELECT episode, round(sum(reward), 6) AS "return", count(*) AS length, round(sum(least(greatest(reward, -1), 1)), 6) AS clipped
FROM final GROUP BY episode"""))
def g11(spark, sf):
    s = rewarded(spark, sf).withColumn("_c", steplog.clip_reward(F.col("reward")))
    whole = steplog.episode_returns(s)
    return fx.rounded(whole.join(s.groupBy("episode").agg(F.sum("_c").alias("clipped")), "episode"))


@query("g12_rolling_mean", fx.with_views("rollout", """
SELECT episode, step, round(avg(reward) OVER (PARTITION BY episode ORDER BY step ROWS 49 PRECEDING), 6) AS mean_reward FROM rollout"""))
def g12(spark, sf):
    return fx.rounded(rolling_mean(fx.rollout(spark, sf), ["episode"], "step", 50, {"mean_reward": "reward"})
                      .select("episode", "step", "mean_reward"))


GAE = """RECURSIVE
, ordered AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY step DESC) AS i,
     coalesce(lead(value) OVER (PARTITION BY episode ORDER BY step), 0.25) AS nxt FROM rollout)
, delta AS (SELECT *, reward + 0.99::DOUBLE * nxt * (1 - done) - value AS d FROM ordered)
, gae AS (SELECT episode, step, i, d AS adv, value FROM delta WHERE i = 1
   UNION ALL SELECT t.episode, t.step, t.i, t.d + 0.99::DOUBLE * 0.95::DOUBLE * (1 - t.done) * g.adv, t.value
   FROM gae g JOIN delta t ON t.episode = g.episode AND t.i = g.i + 1)"""


def _bootstrap(spark, sf):
    return fx.table(spark, sf, "events").selectExpr("user_id AS episode", "0.25D AS last_value").distinct()


@query("g13_advantages", fx.with_views("rollout", GAE + """
SELECT episode, step, round(adv, 6) AS advantage, round(adv + value, 6) AS ret FROM gae"""))
def g13(spark, sf):
    return fx.rounded(returns.advantages(fx.rollout(spark, sf), ["episode"], bootstrap=_bootstrap(spark, sf))
                      .select("episode", "step", "advantage", "ret"))


@query("g14_standardised", fx.with_views("rollout", """
SELECT episode, step, round((reward - avg(reward) OVER w) / (stddev_samp(reward) OVER w + 1e-8), 6) AS reward_std
FROM rollout WINDOW w AS (PARTITION BY episode)"""))
def g14(spark, sf):
    return fx.rounded(returns.standardised(fx.rollout(spark, sf), ["episode"], "reward").select("episode", "step", "reward_std"))


def _outputs(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    part = lambda a, n: F.transform(F.slice("embedding", a, n), lambda v: v.cast("double"))
    return e.select((F.col("vec_id") / 64).cast("int").alias("rollout"), "vec_id", (F.col("label") % 9).alias("label"),
                    part(1, 9).alias("logits"), part(10, 9).alias("old"), F.col("embedding")[20].cast("double").alias("advantage"),
                    (F.col("embedding")[21].cast("double") * 60).alias("value"), (F.col("embedding")[22].cast("double") * 60).alias("ret"))


_OUT = """
WITH o AS (SELECT CAST(floor(vec_id / 64) AS INT) AS rollout, vec_id, label % 9 AS label, list_transform(embedding[1:9], lambda v: v::DOUBLE) AS l,
   list_transform(embedding[10:18], lambda v: v::DOUBLE) AS old, embedding[21]::DOUBLE AS adv, embedding[22]::DOUBLE * 60 AS value,
   embedding[23]::DOUBLE * 60 AS ret FROM embeddings)
, p AS (SELECT *, ln(list_sum(list_transform(l, lambda v: exp(v)))) AS z, ln(list_sum(list_transform(old, lambda v: exp(v)))) AS zo FROM o)
"""


@query("g15_update_diagnostics", _OUT + """
SELECT rollout, round(-avg(least(ratio * adv, least(greatest(ratio, 0.8::DOUBLE), 1.2::DOUBLE) * adv)), 6) AS policy_loss,
   round(avg(pow(least(greatest(value, -10), 10) - least(greatest(ret, -10), 10), 2)), 6) AS value_loss, round(avg(ent), 6) AS entropy
FROM (SELECT *, exp(l[label+1] - z - old[label+1] + zo) AS ratio, -list_sum(list_transform(l, lambda v: exp(v - z) * (v - z))) AS ent FROM p)
GROUP BY rollout""")
def g15(spark, sf):
    o = _outputs(spark, sf)
    o = (o.withColumn("log_prob", returns.log_softmax_at(F.col("logits"), F.col("label")))
         .withColumn("old_log_prob", returns.log_softmax_at(F.col("old"), F.col("label"))))
    return fx.rounded(returns.update_diagnostics(o, ["rollout"]))


@query("g24_classification_log", _OUT + """
SELECT rollout, round(avg(z - l[label+1]), 6) AS loss, round(avg(CASE WHEN list_position(l, list_max(l)) - 1 = label THEN 1 ELSE 0 END), 6) AS accuracy
FROM p GROUP BY rollout""")
def g24(spark, sf):
    return fx.rounded(returns.classification_log(_outputs(spark, sf), ["rollout"]))


@query("g16_best_so_far", fx.with_views("rollout", """
SELECT episode, step, reward FROM (SELECT *, max(reward) OVER (PARTITION BY episode ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
FROM rollout) WHERE b IS NULL OR reward > b"""))
def g16(spark, sf):
    return returns.best_so_far(fx.rollout(spark, sf), ["episode"], "step", "reward").select("episode", "step", "reward")


@query("g16_lowest_so_far", fx.with_views("rollout", """
SELECT episode, step, reward FROM (SELECT *, min(reward) OVER (PARTITION BY episode ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
FROM rollout) WHERE b IS NULL OR reward < b"""))
def g16_low(spark, sf):
    return returns.best_so_far(fx.rollout(spark, sf), ["episode"], "step", "reward", largest=False).select("episode", "step", "reward")


@query("g17_evaluation_means", fx.with_views("rollout", """
SELECT done, round(avg(value), 6) AS mean_coverage, round(avg(reward), 6) AS mean_f1 FROM rollout GROUP BY done"""))
def g17(spark, sf):
    r = fx.rollout(spark, sf).selectExpr("done", "value AS coverage", "reward AS f1")
    return fx.rounded(steplog.evaluation_means(r, ["done"]))


@query("g18_warmup_difficulty", fx.with_views("steps", """
SELECT episode, step, round(CASE WHEN step + 1 < 50 THEN 0.2 + (step + 1) / 50.0 * 0.8 ELSE 1.0 END, 6)::DOUBLE AS difficulty FROM steps"""))
def g18(spark, sf):
    return fx.rounded(fx.steps(spark, sf).select(
        "episode", "step", curriculum.warmup_difficulty(F.col("step") + 1, 0.2, 1.0, 50).alias("difficulty")))


SMALL_STAGES = [("a", 0.2, 0.5, 4), ("b", 0.4, 0.45, 6), ("c", 0.6, 0.42, 8), ("d", 0.8, 0.4, 10), ("e", 1.0, 0.3, 12)]


def successes(spark, sf):
    return fx.steps(spark, sf).select(F.col("episode").alias("run"), F.col("step").alias("idx"),
                                      F.col("event_type").isin("signup", "purchase").cast("int").alias("success"))


@query("g19_stage_history", fx.with_views("steps", """RECURSIVE
, e AS (SELECT episode AS run, step AS idx, CASE WHEN event_type IN ('signup', 'purchase') THEN 1 ELSE 0 END AS s FROM steps)
, st(k, rate, need) AS (VALUES (0, 0.5, 4), (1, 0.45, 6), (2, 0.42, 8), (3, 0.4, 10), (4, 2.0, 1))
, walk AS (SELECT run, -1 AS idx, 0 AS stage, 0 AS n, 0 AS ok FROM e WHERE idx = 0
  UNION ALL SELECT e.run, e.idx, CASE WHEN up THEN stage + 1 ELSE stage END, CASE WHEN up THEN 0 ELSE n + 1 END, CASE WHEN up THEN 0 ELSE ok + q.s END
  FROM (SELECT w.*, e.idx AS i2, e.s, w.n + 1 >= st.need AND (w.ok + e.s) / (w.n + 1) >= st.rate AS up
        FROM walk w JOIN e ON e.run = w.run AND e.idx = w.idx + 1 JOIN st ON st.k = w.stage) q JOIN e ON e.run = q.run AND e.idx = q.i2)
SELECT run, CAST(idx AS INT) AS idx, CAST(stage AS INT) AS stage FROM walk WHERE idx >= 0"""))
def g19(spark, sf):
    return curriculum.stage_history(successes(spark, sf), SMALL_STAGES).select("run", "idx", "stage")


@query("g20_sample_difficulty", fx.with_views("mask_gt", """
, n AS (SELECT a.image_id, a.y, a.x, count(b.image_id) AS n
        FROM points_gt a LEFT JOIN points_gt b ON a.image_id = b.image_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND (a.y <> b.y OR a.x <> b.x)
        GROUP BY ALL)
, c AS (SELECT image_id, count(*) AS c, count(*) FILTER (n > 2) AS j FROM n GROUP BY 1)
, v AS (SELECT image_id, count(*) AS v FROM mask_gt GROUP BY 1)
SELECT image_id, round(0.4::DOUBLE * (1 - least(v / c / 10, 1)) + 0.3::DOUBLE * least(j / c * 1000 / 10, 1)
   + 0.3::DOUBLE * (1 - least(v / (192 * 192) * 20, 1)), 6) AS difficulty FROM c JOIN v USING (image_id)"""))
def g20(spark, sf):
    return fx.rounded(curriculum.sample_difficulty(fx.points_gt(spark, sf), fx.mask_gt(spark, sf), fx.curve_canvas(spark, sf)))


GAIN = """
, first AS (SELECT image_id, y, x, min(trace_id) AS trace_id FROM traces GROUP BY ALL)
, fresh AS (SELECT image_id, trace_id, count(*) AS n FROM first GROUP BY ALL)
, gains AS (SELECT t.image_id, t.trace_id, coalesce(n, 0) / total AS gain,
     sum(coalesce(n, 0)) OVER (PARTITION BY t.image_id ORDER BY t.trace_id ROWS UNBOUNDED PRECEDING) / total AS coverage
   FROM (SELECT DISTINCT image_id, trace_id FROM traces) t LEFT JOIN fresh USING (image_id, trace_id)
   JOIN (SELECT image_id, count(*) AS total FROM points_gt GROUP BY 1) USING (image_id))"""


@query("f8_trace_coverage", fx.with_views("traces points_gt", GAIN + """
SELECT image_id, trace_id, round(gain, 6) AS gain, round(coverage, 6) AS coverage FROM gains"""))
def f8(spark, sf):
    return fx.rounded(steplog.coverage_by_trace(fx.traces(spark, sf), fx.points_gt(spark, sf)))


@query("f9_early_stop", fx.with_views("traces points_gt", GAIN + """
SELECT image_id, trace_id, round(gain, 6) AS gain FROM gains JOIN (SELECT image_id,
  min(trace_id) FILTER (trace_id >= 3 AND gain < 0.2) AS cut FROM gains GROUP BY 1) USING (image_id) WHERE cut IS NULL OR trace_id <= cut"""))
def f9(spark, sf):
    return fx.rounded(steplog.early_stop(steplog.coverage_by_trace(fx.traces(spark, sf), fx.points_gt(spark, sf)), 0.2)
                      .select("image_id", "trace_id", "gain"))


@query("f10_covered_pixels", fx.with_views("traces", "SELECT DISTINCT image_id, y, x FROM traces"))
def f10(spark, sf):
    return steplog.covered_pixels(fx.traces(spark, sf))
