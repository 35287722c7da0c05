"""Confusion, scores and map quality against labels."""
from pyspark.sql import functions as F

from scangrid.functions import geom as G, semantics as SEM
from scangrid.operators import metrics as M, quality as Q
from scangrid.schema import POLICIES

from . import sqltext as S, views as V
from .maps import K, cells, grid_sql, r
from .registry import register

SCORE_COLS = [f"{m}_{k}" for m in ("iou", "precision", "recall", "f1") for k in range(4)]


def rounded_scores(df, by):
    return df.select(*by, *[r(c) for c in SCORE_COLS], r("accuracy"), r("miou"), "labelled")


CONF_SQL = ("conf_counts as (select sequence, frame_id, truth, least(pred, 4) as pred, "
            "count(*) as n from points where truth < 4 group by all)")


@register("confusion_dense", V.with_sql(V.POINTS_SQL, CONF_SQL, body="""
 select f.sequence, f.frame_id, cast(t as integer) as truth, cast(p as integer) as pred, coalesce(n, 0) as n
 from (select distinct sequence, frame_id from conf_counts) f cross join range(4) a(t) cross join range(5) b(p)
 left join conf_counts c on c.sequence=f.sequence and c.frame_id=f.frame_id and c.truth=t and c.pred=p"""))
def confusion_dense(spark, sf):
    return M.dense_confusion(M.confusion(V.points(spark, sf), K), K)


@register("scores_per_frame", V.with_sql(V.POINTS_SQL, CONF_SQL,
                                         body=S.scores_sql("conf_counts", ("sequence", "frame_id"))))
def scores_per_frame(spark, sf):
    return rounded_scores(M.scores(M.confusion(V.points(spark, sf), K), K), K)


@register("scores_overall_and_band", V.with_sql(V.POINTS_SQL, f"""
 banded as (select {S.band('sqrt(x*x+y*y)')} as band, truth, least(pred, 4) as pred from points
  where truth < 4 and sqrt(x*x+y*y) < 100),
 conf_counts as (select coalesce(band, -1) as band, truth, pred, count(*) as n from banded
  group by grouping sets ((band, truth, pred), (truth, pred)))""",
    body=S.scores_sql("conf_counts", ("band",))))
def scores_overall_and_band(spark, sf):
    """Band scores and the overall score from one pass with grouping sets."""
    p = (V.points(spark, sf).where((F.col("truth") < 4) & (G.radius() < 100))
         .select(SEM.distance_band(G.radius()).alias("band"), "truth",
                 SEM.clip_pred("pred").alias("pred")))
    counts = p.groupingSets([["band", "truth", "pred"], ["truth", "pred"]],
                            "band", "truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("band", F.coalesce("band", F.lit(-1)))
    return rounded_scores(M.scores(counts, ["band"]), ["band"])


@register("block_scores", V.with_sql(V.POINTS_SQL, """
 conf_counts as (select cast(floor(x/10) as bigint) as bx, cast(floor(y/10) as bigint) as by_, truth, least(pred,4) as pred,
  count(*) as n from points where truth < 4 group by all)""",
    body=S.scores_sql("conf_counts", ("bx", "by_"), unknown_column=False)))
def block_scores(spark, sf):
    p = V.points(spark, sf).select(G.block_index("x").alias("bx"), G.block_index("y").alias("by_"),
                                   "truth", "pred")
    by = ["bx", "by_"]
    return rounded_scores(M.scores(M.confusion(p, by), by, unknown_column=False), by)


@register("interval_scores", V.with_sql(V.POINTS_SQL, f"""
 conf_counts as (select least(9, cast(floor(frame_id*582*10/4071.0) as bigint)) as time_interval,
   {S.band('sqrt(x*x+y*y)')} as band, truth, least(pred,4) as pred, count(*) as n
  from points where truth < 4 and sqrt(x*x+y*y) < 100 group by all)""",
    body=S.scores_sql("conf_counts", ("time_interval", "band"))))
def interval_scores(spark, sf):
    """Scores per tenth of a 4,071-frame drive (frames spread out by 582) and band."""
    p = (V.points(spark, sf).where(G.radius() < 100)
         .select(SEM.temporal_interval(F.col("frame_id") * 582).alias("time_interval"),
                 SEM.distance_band(G.radius()).alias("band"), "truth", "pred"))
    by = ["time_interval", "band"]
    return rounded_scores(M.scores(M.confusion(p, by), by), by)


LEAF_CONF = f"""leaf_conf as (select policy, band, truth, pred, count(*) as n from (
 select policy, {S.band('sqrt((x+size/2)*(x+size/2)+(y+size/2)*(y+size/2))')} as band, truth_class as truth,
  least(dominant_class, 4) as pred from leaf where truth_class < 4) q where band is not null group by all)"""
FINE_BAND = S.band("sqrt((ix*0.05::double+0.025)*(ix*0.05::double+0.025)+(iy*0.05::double+0.025)*(iy*0.05::double+0.025))")
COMMON_CONF = f"""common_conf as (select policy, band, truth, pred, count(*) as n from (
 select policy, {FINE_BAND} as band, fine_truth as truth, least(dominant_class, 4) as pred
  from shared where fine_truth < 4) q where band is not null group by all)"""


def quality_sql(cte, body):
    return V.with_sql(V.POINTS_SQL, V.POSES_SQL, S.MOTION_SQL, *S.grid_ctes(), cte, body=body)


@register("own_leaf_scores", quality_sql(LEAF_CONF, S.scores_sql("leaf_conf", ("policy", "band"))))
def own_leaf_scores(spark, sf):
    by = ["policy", "band"]
    return rounded_scores(M.scores(Q.leaf_confusion(cells(spark, sf), ["policy"]), by), by)


@register("common_support_scores",
          quality_sql(COMMON_CONF, S.scores_sql("common_conf", ("policy", "band"))))
def common_support_scores(spark, sf):
    by = ["policy", "band"]
    return rounded_scores(M.scores(Q.common_confusion(cells(spark, sf), ["policy"]), by), by)


@register("point_scores_by_policy", quality_sql(f"""point_conf as (
 select l.policy, {S.band('sqrt(a.x*a.x+a.y*a.y)')} as band, a.truth, least(l.dominant_class, 4) as pred, count(*) as n
 from (select * replace (pt.x as x) from located pt) a
 join leaf l on l.sequence=a.sequence and l.frame_id=a.frame_id and l.policy=a.policy and l.units=a.units and l.lx=a.lx and l.ly=a.ly
 where a.truth < 4 group by all)""", S.scores_sql("point_conf", ("policy", "band"))))
def point_scores_by_policy(spark, sf):
    by = ["policy", "band"]
    counts = Q.point_confusion(V.points(spark, sf), cells(spark, sf))
    return rounded_scores(M.scores(counts, by), by)


@register("elevation_errors", quality_sql(f"""errs as (
 select policy, band, statistic, error from (
  select policy, {FINE_BAND} as band, 'mean' as statistic, mean_z - fine_mean_z as error from shared union all
  select policy, {FINE_BAND}, 'min', min_z - fine_min_z from shared union all
  select policy, {FINE_BAND}, 'max', max_z - fine_max_z from shared) q where band is not null)""", """
 select policy, band, statistic, round(avg(abs(error)), 9) as mae, round(sqrt(avg(error*error)), 9) as rmse,
  round(quantile_cont(abs(error), 0.95), 9) as p95 from errs group by 1, 2, 3"""))
def elevation_errors(spark, sf):
    return Q.elevation_errors(cells(spark, sf), ["policy"]).select(
        "policy", "band", "statistic", r("mae"), r("rmse"), r("p95"))


@register("observed_obstacle_iou", quality_sql(f"""fine as (select *, {FINE_BAND} as band from shared)""", """
 select policy, band, round(count(*) filter (where fine_truth in (2,3) and dominant_class in (2,3))::double /
   nullif(count(*) filter (where fine_truth < 4 and (fine_truth in (2,3) or dominant_class in (2,3))), 0), 9) as obstacle_iou,
  count(*) filter (where max_z - min_z > 0.5) as multi_height_cells
 from fine where band is not null group by 1, 2"""))
def observed_obstacle_iou(spark, sf):
    return Q.obstacle_iou(cells(spark, sf), ["policy"]).select(
        "policy", "band", r("obstacle_iou"), "multi_height_cells")


@register("leaf_size_histogram", quality_sql(f"""banded as (select policy, size_mm,
  {S.band('sqrt((x+size/2)*(x+size/2)+(y+size/2)*(y+size/2))')} as band from leaf),
 h as (select policy, band, count(*) as cells, {', '.join(f'count(*) filter (where size_mm={m}) as n{m}' for m in (50, 100, 250, 500))}
  from banded where band is not null group by 1, 2)""", f"""
 select policy, band, cells, cells*42 as bytes, n50, n100, n250, n500,
  {', '.join(f'round(n{m}*{(m / 1000) ** 2!r}::double, 9) as area_{m}' for m in (50, 100, 250, 500))},
  {', '.join(f'round(n{m}*{(m / 1000) ** 2!r}::double/(n50*{0.05 ** 2!r}::double+n100*{0.1 ** 2!r}::double+n250*{0.25 ** 2!r}::double+n500*{0.5 ** 2!r}::double), 9) as share_{m}' for m in (50, 100, 250, 500))}
 from h"""))
def leaf_size_histogram(spark, sf):
    h = Q.leaf_histogram(cells(spark, sf), ["policy"])
    named = ((50, "0.05"), (100, "0.1"), (250, "0.25"), (500, "0.5"))
    return h.select(
        "policy", "band", "cells", "bytes",
        *[F.col("histogram")[k].alias(f"n{m}") for m, k in named],
        *[F.round(F.col("area_m2")[k], 9).alias(f"area_{m}") for m, k in named],
        *[F.round(F.col("area_fraction")[k], 9).alias(f"share_{m}") for m, k in named])


@register("complex_and_simple_cell_size", quality_sql("dummy as (select 1)", """
 select sequence, frame_id, policy, round(avg(size) filter (where fine_complex), 9) as complex_mean_cell_m,
  round(avg(size) filter (where not fine_complex), 9) as simple_mean_cell_m from shared group by 1, 2, 3"""))
def complex_and_simple_cell_size(spark, sf):
    return Q.complexity_sizes(cells(spark, sf)).select(
        *K, "policy", r("complex_mean_cell_m"), r("simple_mean_cell_m"))


@register("boundary_distance", quality_sql("""edges as (
 select l.policy, least(abs(a.x-l.x), abs(a.x-l.x-l.size), abs(a.y-l.y), abs(a.y-l.y-l.size)) as e
 from located a join leaf l on l.sequence=a.sequence and l.frame_id=a.frame_id and l.policy=a.policy
  and l.units=a.units and l.lx=a.lx and l.ly=a.ly where l.truth_kinds > 1)""", """
 select policy, round(avg(e), 9) as boundary_mae, round(sqrt(avg(e*e)), 9) as boundary_rmse,
  round(quantile_cont(e, 0.95), 9) as boundary_p95 from edges group by 1"""))
def boundary_distance(spark, sf):
    return Q.boundary_distance(V.points(spark, sf), cells(spark, sf), ["policy"]).select(
        "policy", r("boundary_mae"), r("boundary_rmse"), r("boundary_p95"))


@register("retained_fraction", V.with_sql(V.POINTS_SQL, body="""
 select sequence, frame_id, round(count(*) filter (where sqrt(x*x+y*y) < 100)/count(*)::double, 9) as retained_fraction
 from points group by 1, 2"""))
def retained_fraction(spark, sf):
    return Q.retention(V.points(spark, sf)).select(*K, r("retained_fraction"))


@register("class_share", V.with_sql(V.POINTS_SQL, body="""
 select f.sequence, f.frame_id, cast(k as integer) as class, round(count(pred)/any_value(total)::double, 9) as share,
  round(avg(conf), 9) as confidence
 from (select sequence, frame_id, count(*) as total from points group by 1, 2) f cross join range(4) c(k)
 left join points p on p.sequence=f.sequence and p.frame_id=f.frame_id and p.pred=k group by 1, 2, 3"""))
def class_share(spark, sf):
    return M.class_share(V.points(spark, sf), K).select(*K, "class", r("share"), r("confidence"))


@register("uncertain_leaves", grid_sql("""
 select sequence, frame_id, count(*) filter (where class_confidence < 0.5) as uncertain_cells, count(*) as cells
 from leaf where policy='adaptive' group by 1, 2""", policies=["adaptive"]))
def uncertain_leaves(spark, sf):
    from scangrid.operators import grid
    return grid.leaves(cells(spark, sf, ("adaptive",))).groupBy(*K).agg(
        F.count_if(F.col("class_confidence") < 0.5).alias("uncertain_cells"),
        F.count(F.lit(1)).alias("cells"))


@register("interval_policy_delta", quality_sql(f"""conf as (
 select sequence, frame_id, band, policy, truth, pred, count(*) as n from (
 select sequence, frame_id, policy, {FINE_BAND} as band, fine_truth as truth, least(dominant_class, 4) as pred
  from shared where fine_truth < 4) q where band is not null and policy in ('uniform','adaptive') group by all)""",
    f"""select sequence, frame_id, band, round(max(miou) filter (where policy='adaptive')
   - max(miou) filter (where policy='uniform'), 9) as delta_miou
 from ({S.scores_sql('conf', ('sequence', 'frame_id', 'band', 'policy'))}) s group by 1, 2, 3"""))
def interval_policy_delta(spark, sf):
    by = [*K, "band", "policy"]
    sc = M.scores(Q.common_confusion(cells(spark, sf, ("uniform", "adaptive"))), by)
    sc = sc.withColumn("miou", F.round("miou", 9))
    return M.paired_delta(sc, [*K, "band"], "policy", "uniform", "adaptive", ["miou"]).select(
        *K, "band", r("delta_miou"))
