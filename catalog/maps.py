"""Elevation-map policies."""
from pyspark.sql import functions as F

from scangrid.functions import geom as G
from scangrid.functions.semantics import distance_band
from scangrid.operators import grid, motion
from scangrid.schema import POLICIES

from . import sqltext as S, views as V
from .registry import register

K = ("sequence", "frame_id")


def frame_speed(spark, sf):
    return motion.frame_motion(V.poses(spark, sf)).drop("dt")


def cells(spark, sf, policies=POLICIES):
    return grid.grid_cells(V.points(spark, sf), policies, frame_speed(spark, sf), truth="truth")


def r(name, digits=9):
    return F.round(name, digits).alias(name)


def grid_sql(body, policies=None):
    return V.with_sql(V.POINTS_SQL, V.POSES_SQL, S.MOTION_SQL, *S.grid_ctes(policies=policies),
                      body=body)


@register("points_checksum", V.with_sql(V.POINTS_SQL, body="""
 select sequence, frame_id, count(*) as n, cast(sum(x_mm) as bigint) as sx, cast(sum(y_mm) as bigint) as sy,
  cast(sum(z_mm) as bigint) as sz, cast(sum(point_id % 1000003) as bigint) as ids, cast(sum(truth) as bigint) as truths,
  cast(sum(pred) as bigint) as preds from points group by 1, 2"""))
def points_checksum(spark, sf):
    return V.points(spark, sf).groupBy(*K).agg(
        F.count(F.lit(1)).alias("n"), F.sum("x_mm").alias("sx"), F.sum("y_mm").alias("sy"),
        F.sum("z_mm").alias("sz"), F.sum(F.col("point_id") % 1000003).alias("ids"),
        F.sum("truth").alias("truths"), F.sum("pred").alias("preds"))


@register("valid_points", V.with_sql(V.POINTS_SQL, body="""
 select sequence, frame_id, point_id, x, y, z from points where sqrt(x*x+y*y) < 100"""))
def valid_points(spark, sf):
    return V.points(spark, sf).where(G.in_range()).select(*K, "point_id", "x", "y", "z")


UNIFORM_BODY = f"""
 select sequence, frame_id, lx, ly, n as point_count, round(sz/n, 12) as mean_z, zmin as min_z, zmax as max_z,
  round(greatest(0, szz/n-(sz/n)*(sz/n)), 12) as height_variance,
  round((obst/n::double)*(1-obst/n::double), 12) as occupancy_variance,
  cast({S.argmax4('v0', 'v1', 'v2', 'v3')} as integer) as dominant_class,
  round(greatest(v0,v1,v2,v3)/1000000000.0::double/n, 12) as class_confidence,
  {S.semantic_split('k0', 'k1', 'k2', 'k3')} as semantic_complexity
 from agg{{u}}"""
def leaf_out():
    return ["lx", "ly", "point_count", r("mean_z", 12), "min_z", "max_z",
            r("height_variance", 12), r("occupancy_variance", 12), "dominant_class",
            r("class_confidence", 12),
            "semantic_complexity"]


@register("uniform_grid", grid_sql(UNIFORM_BODY.format(u=1), policies=["uniform"]))
def uniform_grid(spark, sf):
    return grid.uniform_grid(V.points(spark, sf)).select(*K, *leaf_out())


@register("cell_aggregate_half_metre", grid_sql(UNIFORM_BODY.format(u=10), policies=["uniform"]))
def cell_aggregate_half_metre(spark, sf):
    return grid.cell_aggregate(V.points(spark, sf), 0.5).select(*K, *leaf_out())


LEAF_BODY = f"""
 select sequence, frame_id, size_mm, lx, ly, n as point_count, round(mean_z, 12) as mean_z, zmin as min_z, zmax as max_z,
  round(hv, 12) as height_variance, round(occupancy_variance, 12) as occupancy_variance,
  cast(dominant_class as integer) as dominant_class, round(class_confidence, 12) as class_confidence,
  mixed_cell as semantic_complexity
 from leaf where policy = '{{p}}'"""


def _policy_entry(policy):
    @register(f"grid_{policy}", grid_sql(LEAF_BODY.format(p=policy), policies=[policy]))
    def build(spark, sf):
        return (grid.build_grid(V.points(spark, sf), (policy,), frame_speed(spark, sf))
                .select(*K, "size_mm", *leaf_out()))
    return build


for _p in ("distance", "ground", "semantic", "adaptive"):
    _policy_entry(_p)


@register("policy_band_storage", grid_sql(f"""
 select policy, band, count(*) as cells, count(*)*42 as bytes,
  cast(sum(n) as bigint) as points from
 (select policy, n, {S.band('sqrt((x+size/2)*(x+size/2)+(y+size/2)*(y+size/2))')} as band from leaf) q
 where band is not null group by 1, 2"""))
def policy_band_storage(spark, sf):
    lv = grid.leaves(cells(spark, sf))
    half = F.col("size") / 2
    band = distance_band(G.radius(F.col("x") + half, F.col("y") + half))
    return (lv.withColumn("band", band).where("band is not null").groupBy("policy", "band")
            .agg(F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * 42).alias("bytes"),
                 F.sum("point_count").alias("points")))


@register("leaf_storage", grid_sql("""
 select policy, count(*) as cells, count(*)*42 as bytes, round(count(*)*42/1048576.0::double, 9) as mib,
  round((1-count(*)/max(case when policy='uniform' then count(*) end) over ()::double)*100, 9) as reduction_pct
 from leaf group by policy"""))
def leaf_storage(spark, sf):
    out = grid.storage_reduction(grid.leaf_storage(grid.leaves(cells(spark, sf)), ["policy"]))
    return out.select("policy", "cells", "bytes", r("mib"), r("reduction_pct"))


REFINED_SQL = """
 select n.sequence, n.frame_id, n.policy, count(*) filter (where split and (units = 10
   or (units = 2 and parent_split and tenth) or (units = 5 and parent_split and not tenth))) as refined_nodes
 from (select a.sequence, a.frame_id, a.policy, a.units, a.split, b.split as parent_split,
   b.ceil_m <= 0.100001 as tenth from (
   select sequence, frame_id, policy, 10 as units, lx, ly, lx as bx, ly as by_, split from node10 union all
   select sequence, frame_id, policy, 5, lx, ly, cast(floor(lx/2.0) as bigint), cast(floor(ly/2.0) as bigint), split from node5 union all
   select sequence, frame_id, policy, 2, lx, ly, cast(floor(lx/5.0) as bigint), cast(floor(ly/5.0) as bigint), split from node2) a
  join node10 b on a.sequence=b.sequence and a.frame_id=b.frame_id and a.policy=b.policy and a.bx=b.lx and a.by_=b.ly) n
 where policy <> 'uniform' group by 1, 2, 3"""


@register("refinement_count", grid_sql(REFINED_SQL))
def refinement_count(spark, sf):
    return grid.refinement_count(cells(spark, sf, POLICIES[1:]), [*K, "policy"])


@register("assign_points", V.with_sql(
    V.POINTS_SQL, V.POSES_SQL, S.MOTION_SQL, *S.grid_ctes(policies=["adaptive"]), body="""
 select p.sequence, p.frame_id, p.point_id, coalesce(l.size_mm, -1) as size_mm, l.lx, l.ly,
  cast(coalesce(l.dominant_class, 255) as integer) as cell_class
 from points p left join located a on a.sequence=p.sequence and a.frame_id=p.frame_id and a.point_id=p.point_id
 left join leaf l on l.sequence=a.sequence and l.frame_id=a.frame_id and l.units=a.units and l.lx=a.lx and l.ly=a.ly"""))
def assign_points(spark, sf):
    p = V.points(spark, sf)
    return grid.assign_points(p, cells(spark, sf, ("adaptive",)), ("adaptive",)).select(
        *K, "point_id", "size_mm", "lx", "ly", "cell_class")


@register("truth_majority_per_leaf", grid_sql("""
 select sequence, frame_id, size_mm, lx, ly, cast(truth_class as integer) as truth_class, truth_kinds
 from leaf where policy = 'adaptive'""", policies=["adaptive"]))
def truth_majority_per_leaf(spark, sf):
    return grid.leaves(cells(spark, sf, ("adaptive",))).select(
        *K, "size_mm", "lx", "ly", "truth_class", "truth_kinds")


@register("overlapping_footprints", grid_sql("""
 select policy, count(*) as footprint_cells, cast(sum(case when covers > 1 then 1 else 0 end) as bigint) as overlapping from (
  select sequence, frame_id, policy, ix, iy, count(*) as covers from (
   select sequence, frame_id, policy, lx*units+dx as ix, ly*units+dy as iy from leaf, range(10) a(dx), range(10) b(dy)
   where dx < units and dy < units) f group by all) g group by policy"""))
def overlapping_footprints(spark, sf):
    places = grid.leaf_places(V.points(spark, sf), POLICIES, frame_speed(spark, sf))
    return grid.footprint_counts(places).groupBy("policy").agg(
        F.sum("covered").alias("footprint_cells"), F.sum("overlapping").alias("overlapping"))


@register("policy_changed_leaves", grid_sql("""
 select sequence, frame_id, size_mm, lx, ly, cast(max(policy='ground') as integer) as in_left,
  cast(max(policy='adaptive') as integer) as in_right from leaf where policy in ('ground', 'adaptive')
 group by 1, 2, 3, 4, 5 having count(*) = 1""", policies=["ground", "adaptive"]))
def policy_changed_leaves(spark, sf):
    lv = grid.leaves(cells(spark, sf, ("ground", "adaptive")))
    return grid.changed_leaves(lv.where("policy = 'ground'"), lv.where("policy = 'adaptive'"))


TURN_MOTION = """motion as (select sequence, frame_id, variant, 60/3.6::double as speed, radians(degrees::double) as heading
 from (select distinct sequence, frame_id from points) f, (values (0, 0), (1, 18), (2, -18), (3, 90)) t(variant, degrees))"""


@register("turn_response", V.with_sql(
    V.POINTS_SQL, TURN_MOTION, *S.grid_ctes(policies=["adaptive"], variant=True), body="""
 , sided as (select sequence, frame_id, variant, size_mm, lx, ly from leaf)
 select sequence, frame_id, step, count(*) as changed_leaves from (
  select sequence, frame_id, step, size_mm, lx, ly from (
   select sequence, frame_id, variant as step, size_mm, lx, ly from sided where variant > 0 union all
   select sequence, frame_id, variant + 1, size_mm, lx, ly from sided where variant < 3) u
  group by all having count(*) = 1) c group by 1, 2, 3"""))
def turn_response(spark, sf):
    """Leaves changed by each turn of the wheel at 60 km/h: 0, +18, -18, +90 degrees."""
    p = V.points(spark, sf)
    turns = F.array(*[F.struct(F.lit(i).alias("variant"), F.radians(F.lit(float(d))).alias("heading"))
                      for i, d in enumerate((0, 18, -18, 90))])
    sweep = (p.select(*K).distinct().select(*K, F.inline(turns))
             .withColumn("speed", G.kmh_to_mps(F.lit(60.0))))
    lv = grid.build_grid(p, ("adaptive",), sweep)
    cols = [*K, "size_mm", "lx", "ly"]
    after = lv.where("variant > 0").select(F.col("variant").alias("step"), *cols)
    before = lv.where("variant < 3").select((F.col("variant") + 1).alias("step"), *cols)
    return (after.unionByName(before).groupBy("step", *cols).agg(F.count(F.lit(1)).alias("n"))
            .where("n = 1").groupBy(*K, "step").agg(F.count(F.lit(1)).alias("changed_leaves")))


@register("speed_sweep_storage", V.with_sql(
    V.POINTS_SQL, """motion as (select sequence, frame_id, variant, variant*20/3.6::double as speed, 0.5::double as heading
 from (select distinct sequence, frame_id from points) f, range(4) t(variant))""",
    *S.grid_ctes(policies=["adaptive"], variant=True), body="""
 select cast(variant as bigint) as variant, count(*) as cells, count(*)*42 as bytes from leaf group by 1"""))
def speed_sweep_storage(spark, sf):
    p = V.points(spark, sf)
    sweep = (p.select(*K).distinct()
             .withColumn("variant", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
             .withColumn("speed", G.kmh_to_mps(F.col("variant") * 20.0))
             .withColumn("heading", F.lit(0.5)))
    lv = grid.build_grid(p, ("adaptive",), sweep)
    return lv.groupBy("variant").agg(F.count(F.lit(1)).alias("cells"),
                                     (F.count(F.lit(1)) * 42).alias("bytes"))


@register("export_cells", grid_sql("""
 select sequence, frame_id, array_agg([round(x,4), round(y,4), size, cast(dominant_class as double),
   round(round(mean_z,12),4), round(round(class_confidence,12),4)] order by size_mm, lx, ly) as cells
 from leaf where policy = 'adaptive' group by 1, 2""",
    policies=["adaptive"]))
def export_cells(spark, sf):
    """Leaves of each frame as one array of rounded rows."""
    lv = grid.leaves(cells(spark, sf, ("adaptive",)))
    row = F.struct("size_mm", "lx", "ly", F.array(
        F.round("x", 4), F.round("y", 4), F.col("size"), F.col("dominant_class").cast("double"),
        F.round(F.round("mean_z", 12), 4), F.round(F.round("class_confidence", 12), 4)).alias("row"))
    return lv.groupBy(*K).agg(
        F.transform(F.array_sort(F.collect_list(row)), lambda s: s["row"]).alias("cells"))
