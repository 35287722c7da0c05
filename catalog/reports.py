"""The report tables over map policies."""
from pyspark.sql import functions as F

from scangrid.functions import semantics as SEM
from scangrid.operators import quality as Q, reports, summaries

from . import sqltext as S, views as V
from .maps import K, REFINED_SQL, cells, r
from .registry import register
from .scoring import FINE_BAND, quality_sql

FRAME_CONF = f"""frame_conf as materialized (select sequence, frame_id, policy, band, truth, pred, count(*) as n from (
 select sequence, frame_id, policy, {FINE_BAND} as band, fine_truth as truth, least(dominant_class, 4) as pred
  from shared where fine_truth < 4) q where band is not null group by all),
 strata as (select sequence, frame_id, case when d > 0.12 then 'dense-object' when s > 0.5 then 'structure-dominant'
   when t > 0.3 then 'terrain-dominant' else 'mixed-road' end as scene_stratum from (
  select sequence, frame_id, avg((truth=1)::int) as t, avg((truth=2)::int) as s, avg((truth=3)::int) as d from points group by 1, 2) f),
 policy_conf as (select policy, truth, pred, cast(sum(n) as bigint) as n from frame_conf group by all),
 band_conf as (select policy, band, truth, pred, cast(sum(n) as bigint) as n from frame_conf group by all),
 interval_conf as (select policy, least(9, cast(floor(frame_id*582*10/4071.0) as bigint)) as time_interval, band, truth, pred,
  cast(sum(n) as bigint) as n from frame_conf group by all),
 stratum_conf as (select policy, scene_stratum, truth, pred, cast(sum(n) as bigint) as n from frame_conf join strata using (sequence, frame_id) group by all)"""


def _strata(spark, sf):
    return summaries.frame_strata(V.points(spark, sf))


def _cube(spark, sf, counts):
    """Frames are spread over a 4,071-frame drive by 582."""
    return reports.report_cube(counts, _strata(spark, sf),
                               SEM.temporal_interval(F.col("frame_id") * 582))


@register("report_bands", quality_sql(FRAME_CONF, f"""
 select b.policy, b.band, accuracy, miou, labelled, round(spread, 6) as spread, frames, round(obstacle_iou, 9) as obstacle_iou
 from ({S.scores_sql('band_conf', ('policy', 'band'))}) b
 join (select policy, band, stddev_pop(miou) as spread, count(miou) as frames
  from ({S.scores_sql('frame_conf', ('sequence', 'frame_id', 'policy', 'band'))}) f group by 1, 2) s using (policy, band)
 join (select policy, band, avg(v) as obstacle_iou from (select sequence, frame_id, policy, band,
   count(*) filter (where fine_truth in (2,3) and dominant_class in (2,3))::double
   / nullif(count(*) filter (where fine_truth < 4 and (fine_truth in (2,3) or dominant_class in (2,3))), 0) as v
   from (select *, {FINE_BAND} as band from shared) x where band is not null group by 1, 2, 3, 4) o group by 1, 2) o using (policy, band)"""))
def report_bands(spark, sf):
    own = reports.frame_sums(cells(spark, sf))
    return reports.band_report(_cube(spark, sf, reports.labelled_counts(own)), own).select(
        "policy", "band", r("accuracy"), r("miou"), "labelled", r("spread", 6), "frames", r("obstacle_iou"))


@register("report_intervals", quality_sql(FRAME_CONF, f"""
 select time_interval, band, round(max(miou) filter (where policy='adaptive') - max(miou) filter (where policy='uniform'), 8) as delta_miou,
  max(labelled) filter (where policy='adaptive') as labelled
 from ({S.scores_sql('interval_conf', ('policy', 'time_interval', 'band'))}) s group by 1, 2"""))
def report_intervals(spark, sf):
    out = reports.interval_report(_cube(spark, sf, Q.common_confusion(cells(spark, sf))))
    return out.select("time_interval", "band", r("delta_miou", 8), "labelled")


@register("report_strata", quality_sql(FRAME_CONF, f"""
 select policy, scene_stratum, accuracy, miou, labelled, frames from ({S.scores_sql('stratum_conf', ('policy', 'scene_stratum'))}) s
 join (select scene_stratum, count(*) as frames from strata group by 1) f using (scene_stratum)"""))
def report_strata(spark, sf):
    out = reports.stratum_report(_cube(spark, sf, Q.common_confusion(cells(spark, sf))), _strata(spark, sf))
    return out.select("policy", "scene_stratum", r("accuracy"), r("miou"), "labelled", "frames")


@register("report_policies", quality_sql(FRAME_CONF + f""",
 refined as ({REFINED_SQL})""", f"""
 select p.policy, frames, mean_cells, mean_bytes, mean_refined_nodes, mean_retained_fraction, mean_complex_mean_cell_m, mean_simple_mean_cell_m,
  accuracy, miou, labelled from ({S.scores_sql('policy_conf', ('policy',))}) p join (
  select l.policy, count(*) as frames, round(avg(l.cells), 6) as mean_cells, round(avg(l.cells*42), 6) as mean_bytes,
   round(avg(coalesce(refined_nodes, 0)), 6) as mean_refined_nodes, round(avg(retained), 9) as mean_retained_fraction,
   round(avg(complex), 9) as mean_complex_mean_cell_m, round(avg(simple), 9) as mean_simple_mean_cell_m
  from (select sequence, frame_id, policy, count(*) as cells from leaf group by 1, 2, 3) l
  left join refined using (sequence, frame_id, policy)
  join (select sequence, frame_id, policy, avg(size) filter (where fine_complex) as complex, avg(size) filter (where not fine_complex) as simple
   from shared group by 1, 2, 3) c using (sequence, frame_id, policy)
  join (select sequence, frame_id, count(*) filter (where sqrt(x*x+y*y) < 100)/count(*)::double as retained from points group by 1, 2) t using (sequence, frame_id)
  group by 1) m using (policy)"""))
def report_policies(spark, sf):
    own = reports.frame_sums(cells(spark, sf))
    out = reports.policy_report(_cube(spark, sf, reports.labelled_counts(own)), own, V.points(spark, sf))
    return out.select("policy", "frames", r("mean_cells", 6), r("mean_bytes", 6), r("mean_refined_nodes", 6),
                      *[r(f"mean_{c}") for c in ("retained_fraction", "complex_mean_cell_m", "simple_mean_cell_m")],
                      r("accuracy"), r("miou"), "labelled")
