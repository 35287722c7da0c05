"""Spatial joins, clustering, boxes, tracks and ribbons."""
from pyspark.sql import Window, functions as F

from scangrid.functions import geom as G
from scangrid.operators import cluster, grid, motion, spatial, tracks, voxel

from . import sqltext as S, views as V
from .maps import K, cells, frame_speed, r
from .registry import register

EGO_SQL = """ego as (select sequence, frame_id, lag(frame_id) over w as previous_frame,
 lag(tx) over w - tx as ex, lag(ty) over w - ty as ey, ts_s - lag(ts_s) over w as dt
 from poses window w as (partition by sequence order by frame_id))"""
NEAR27 = "range(-1, 2) a(ox), range(-1, 2) b(oy), range(-1, 2) c(oz)"
NEAR9 = "range(-1, 2) a(ox), range(-1, 2) b(oy)"


def ego(spark, sf):
    return motion.ego_transforms(V.poses(spark, sf))


def hash_sql(source, size, dims="xyz", prefix="c"):
    return ", ".join(f"cast(floor({d}/{size}::double) as bigint) as {prefix}{d}" for d in dims)


@register("frame_motion", V.with_sql(V.POSES_SQL, S.MOTION_SQL, body="""
 select sequence, frame_id, round(speed, 9) as speed, round(heading, 9) as heading from motion"""))
def frame_motion(spark, sf):
    return frame_speed(spark, sf).select(*K, r("speed"), r("heading"))


@register("frame_dt", V.with_sql(V.POSES_SQL, EGO_SQL, body="""
 select sequence, frame_id, round(dt, 9) as dt from ego"""))
def frame_dt(spark, sf):
    m = motion.frame_motion(V.poses(spark, sf), fixed_dt=None)
    return m.select(*K, r("dt"))


@register("ego_compensated_points", V.with_sql(V.POINTS_SQL, V.POSES_SQL, EGO_SQL, body="""
 select e.sequence, e.frame_id, p.point_id, round(p.x + ex, 6) as wx, round(p.y + ey, 6) as wy, round(p.z, 6) as wz
 from points p join ego e on p.sequence=e.sequence and p.frame_id=e.previous_frame"""))
def ego_compensated_points(spark, sf):
    p = V.points(spark, sf).withColumnRenamed("frame_id", "previous_frame")
    j = p.join(ego(spark, sf), ["sequence", "previous_frame"])
    w = G.rigid_apply(G.rigid("e_t"), "x", "y", "z")
    return j.select(*K, "point_id", *[F.round(v, 6).alias(n) for v, n in zip(w, ("wx", "wy", "wz"))])


@register("motion_residual", V.with_sql(V.POINTS_SQL, V.POSES_SQL, EGO_SQL, f"""
 warped as (select e.sequence, e.frame_id, floor((p.x+ex)*10000+0.5)/10000 as x, floor((p.y+ey)*10000+0.5)/10000 as y,
   floor(p.z*10000+0.5)/10000 as z from points p join ego e on p.sequence=e.sequence and p.frame_id=e.previous_frame),
 w2 as materialized (select distinct *, {hash_sql('warped', 3)} from warped),
 q as materialized (select *, cx+ox as hx, cy+oy as hy, cz+oz as hz from (select *, {hash_sql('points', 3)} from points) p, {NEAR27}),
 best as materialized (select q.sequence, q.frame_id, q.point_id, min(sqrt((q.x-w.x)*(q.x-w.x)+(q.y-w.y)*(q.y-w.y)+(q.z-w.z)*(q.z-w.z))) as d
  from q join w2 w on q.sequence=w.sequence and q.frame_id=w.frame_id and q.hx=w.cx and q.hy=w.cy and q.hz=w.cz group by 1, 2, 3)""",
    body="""select p.sequence, p.frame_id, p.point_id,
  round(case when e.previous_frame is null then null else least(coalesce(d, 3), 3) end, 9) as residual
 from points p left join ego e on p.sequence=e.sequence and p.frame_id=e.frame_id
 left join best b on b.sequence=p.sequence and b.frame_id=p.frame_id and b.point_id=p.point_id"""))
def motion_residual(spark, sf):
    out = spatial.motion_residual(V.points(spark, sf).select(*K, "point_id", "x", "y", "z"),
                                  ego(spark, sf))
    return out.select(*K, "point_id", r("residual"))


def proximity_sql(reach, q_where, s_where):
    return V.with_sql(V.POINTS_SQL, f"""
 src as materialized (select distinct sequence, frame_id, x, y, {hash_sql('p', reach, 'xy')} from points where {s_where}),
 q as materialized (select *, cx+ox as hx, cy+oy as hy from (select *, {hash_sql('p', reach, 'xy')} from points where {q_where}) p, {NEAR9})""",
        body=f"""select distinct q.sequence, q.frame_id, q.point_id from q join src s on q.sequence=s.sequence
 and q.frame_id=s.frame_id and q.hx=s.cx and q.hy=s.cy
 where (q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y) < {reach}*{reach}""")


@register("road_proximity", proximity_sql(0.8, "pred = 1", "pred = 0"))
def road_proximity(spark, sf):
    p = V.points(spark, sf)
    return spatial.within_radius(p.where("pred = 1"), p.where("pred = 0"), K, 0.8).select(
        *K, "point_id")


@register("sidewalk_near_road", proximity_sql(4.0, "truth = 1 and instance_id % 2 = 0",
                                              "truth = 0 and instance_id % 2 = 0"))
def sidewalk_near_road(spark, sf):
    """Sidewalk returns (id 48) within 4 m of road returns (id 40); 1 m on dense sweeps."""
    p = V.raw_labels(spark, sf).withColumn("semantic", F.col("raw").bitwiseAND(65535))
    return spatial.within_radius(p.where("semantic = 48"), p.where("semantic = 40"), K, 4.0).select(
        *K, "point_id")


@register("neighbour_counts", V.with_sql(V.POINTS_SQL, f"""
 src as materialized (select sequence, frame_id, pred, x, y, z, count(*) as w, {hash_sql('p', 0.5)} from points group by all),
 q as materialized (select *, cx+ox as hx, cy+oy as hy, cz+oz as hz from src, {NEAR27})""", body="""
 select q.sequence, q.frame_id, q.pred, q.x, q.y, q.z, cast(sum(s.w) as bigint) as neighbours from q join src s on q.sequence=s.sequence and q.frame_id=s.frame_id and q.pred=s.pred
  and q.hx=s.cx and q.hy=s.cy and q.hz=s.cz
 where (q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y)+(q.z-s.z)*(q.z-s.z) <= 0.25 group by 1, 2, 3, 4, 5, 6"""))
def neighbour_counts(spark, sf):
    return spatial.neighbour_counts(V.points(spark, sf), [*K, "pred"], 0.5)


REPS = f"""reps_all as materialized (select sequence, frame_id, pred, {hash_sql('p', 0.2, prefix='v')},
  min(point_id) as point_id, arg_min(x, point_id) as x, arg_min(y, point_id) as y, arg_min(z, point_id) as z
 from points where pred in (2, 3) group by sequence, frame_id, pred, vx, vy, vz)"""


@register("first_of_voxel", V.with_sql(V.POINTS_SQL, REPS, body="""
 select sequence, frame_id, pred, vx, vy, vz, point_id, x, y, z from reps_all"""))
def first_of_voxel(spark, sf):
    return cluster.first_of_voxel(V.points(spark, sf).where("pred in (2, 3)"), [*K, "pred"], 0.2)


def dbscan_ctes(tag, reps, eps, minimum):
    d2 = "(q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y)+(q.z-s.z)*(q.z-s.z)"
    return [f"""h{tag} as materialized (select *, {hash_sql('p', eps)} from {reps})""",
            f"""p{tag} as materialized (select q.sequence, q.frame_id, q.point_id as a, s.point_id as b, {d2} as d2
  from (select *, cx+ox as hx, cy+oy as hy, cz+oz as hz from h{tag}, {NEAR27}) q join h{tag} s
  on q.sequence=s.sequence and q.frame_id=s.frame_id and q.hx=s.cx and q.hy=s.cy and q.hz=s.cz
  where {d2} <= {eps}*{eps})""",
            f"core{tag} as materialized (select a as id from p{tag} group by 1 having count(*) >= {minimum})",
            f"""e{tag} as materialized (select a, b from p{tag} where a in (select id from core{tag}) and b in (select id from core{tag}))""",
            f"""walk{tag} as (select id, id as root from core{tag} union
  select e.b, w.root from walk{tag} w join e{tag} e on e.a = w.id where w.root < e.b)""",
            f"comp{tag} as materialized (select id, min(root) as cluster from walk{tag} group by 1)",
            f"""bord{tag} as materialized (select a as id, arg_min(b, (d2, b)) as near from p{tag}
  where a not in (select id from core{tag}) and b in (select id from core{tag}) and d2 < {eps}*{eps} group by 1)""",
            f"""lab{tag} as materialized (select r.*, coalesce(c.cluster, c2.cluster) as cluster from {reps} r
  left join comp{tag} c on c.id = r.point_id left join bord{tag} b on b.id = r.point_id left join comp{tag} c2 on c2.id = b.near)"""]


def cls_reps(k):
    return f"reps{k} as materialized (select * from reps_all where pred = {k})"


@register("dbscan_static", V.with_sql(V.POINTS_SQL, REPS, cls_reps(2), *dbscan_ctes("2", "reps2", 1.0, 5),
                                      body="select sequence, frame_id, point_id, cluster from lab2",
                                      recursive=True))
def dbscan_static(spark, sf):
    reps = cluster.first_of_voxel(V.points(spark, sf).where("pred = 2"), K, 0.2)
    return cluster.dbscan(reps, K, 1.0, 5, distinct=True).select(*K, "point_id", "cluster")


@register("dbscan_restarting_ids", V.with_sql(
    V.POINTS_SQL, REPS, cls_reps(2), cls_reps(3), *dbscan_ctes("2", "reps2", 1.0, 5), *dbscan_ctes("3", "reps3", 0.5, 3),
    """num as materialized (select point_id, row_number() over (partition by sequence, frame_id order by point_id) as own from points)""",
    """lab as (select * from lab2 union all select * from lab3)""",
    body="""select l.sequence, l.frame_id, l.pred, n.own as point_id, c.own as cluster
 from lab l join num n on n.point_id = l.point_id left join num c on c.point_id = l.cluster""", recursive=True))
def dbscan_restarting_ids(spark, sf):
    """Both obstacle classes at once, with point ids that start anew in every frame."""
    own = F.row_number().over(Window.partitionBy(*K).orderBy("point_id")).cast("long")
    p = V.points(spark, sf).withColumn("point_id", own).where("pred in (2, 3)")
    by = [*K, "pred"]
    reps = cluster.first_of_voxel(p, by, 0.2)
    eps = F.when(F.col("pred") == 2, 1.0).otherwise(0.5)
    least = F.when(F.col("pred") == 2, 5).otherwise(3)
    return cluster.dbscan(reps, by, eps, least, distinct=True).select(*by, "point_id", "cluster")


@register("connected_components", V.with_sql(
    """edges as (select distinct l_partkey as a, 1000000000 + l_suppkey as b from lineitem
    union select distinct o_custkey % 97, 1000000000 + o_orderkey % 89 from orders)""",
    """node as (select a as id from edges union select b from edges)""",
    """links as materialized (select a, b from edges union select b, a from edges)""",
    """walk as (select id, id as root from node union select e.b, w.root from walk w join links e on e.a = w.id where w.root < e.b)""",
    body="select id, min(root) as label from walk group by 1", recursive=True))
def connected_components(spark, sf):
    """Part-supplier links as a graph, plus a dense one from the orders."""
    li = V.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000000).alias("b"))
    o = V.table(spark, sf, "orders").select(
        (F.col("o_custkey") % 97).alias("a"), (F.col("o_orderkey") % 89 + 1000000000).alias("b"))
    edges = li.union(o).distinct()
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    return cluster.connected_components(nodes, edges)


def member_cte(k):
    return f"""mem{k} as materialized (select p.*, coalesce(l.cluster, l.point_id) as object_id, l.cluster is null as fallback
 from (select *, {hash_sql('p', 0.2, prefix='v')} from points where pred = {k}) p
 join lab{k} l on l.sequence=p.sequence and l.frame_id=p.frame_id and l.vx=p.vx and l.vy=p.vy and l.vz=p.vz)"""


OBJ_KEYS = "sequence, frame_id, object_id, fallback"


def box_ctes(k, floor):
    return [f"""b{k} as materialized (select *, case when points > 2 then atan2(2*cxy, cxx-cyy)/2 else 0 end as yaw from (
  select *, sx::double/points/1000 as mx, sy::double/points/1000 as my, (points::hugeint*sxy-sx::hugeint*sy)::double as cxy,
   (points::hugeint*sxx-sx::hugeint*sx)::double as cxx, (points::hugeint*syy-sy::hugeint*sy)::double as cyy from (
   select {OBJ_KEYS}, count(*) as points, sum(xi) as sx, sum(yi) as sy, sum(xi*yi) as sxy, sum(xi*xi) as sxx, sum(yi*yi) as syy,
    min(z) as z0, max(z) as z1, avg(conf) as confidence from (select *, cast(floor(x*1000+0.5) as bigint) as xi,
    cast(floor(y*1000+0.5) as bigint) as yi from mem{k}) m group by {OBJ_KEYS}) t) s)""",
            f"""x{k} as materialized (select {OBJ_KEYS}, min(u) as u0, max(u) as u1, min(v) as v0, max(v) as v1 from (
  select {OBJ_KEYS}, (m.x-mx)*cos(yaw)+(m.y-my)*sin(yaw) as u, (m.y-my)*cos(yaw)-(m.x-mx)*sin(yaw) as v
  from mem{k} m join b{k} using ({OBJ_KEYS})) q group by {OBJ_KEYS})""",
            f"""box{k} as materialized (select {OBJ_KEYS}, {k} as class,
  mx+(u0+u1)/2*cos(yaw)-(v0+v1)/2*sin(yaw) as center_x, my+(u0+u1)/2*sin(yaw)+(v0+v1)/2*cos(yaw) as center_y, (z0+z1)/2 as center_z,
  greatest(u1-u0, {floor[0]}) as size_u, greatest(v1-v0, {floor[1]}) as size_v, greatest(z1-z0, {floor[2]}) as size_z, confidence, points
  from b{k} join x{k} using ({OBJ_KEYS}))"""]


PROPOSAL_CTES = [V.POINTS_SQL, REPS, cls_reps(2), cls_reps(3), *dbscan_ctes("2", "reps2", 1.0, 5),
                 *dbscan_ctes("3", "reps3", 0.5, 3), member_cte(2), member_cte(3),
                 *box_ctes(2, (0.15, 0.15, 0.15)), *box_ctes(3, (0.3, 0.3, 0.4))]
BOX_COLS = ("center_x", "center_y", "center_z", "size_u", "size_v", "size_z", "confidence")


@register("object_proposals", V.with_sql(*PROPOSAL_CTES, body=f"""
 select {OBJ_KEYS}, class, points, {', '.join(f'round({c}, 6) as {c}' for c in BOX_COLS)}
 from (select * from box2 union all select * from box3) b""", recursive=True))
def object_proposals(spark, sf):
    return cluster.object_proposals(V.points(spark, sf)).select(
        *K, "object_id", "fallback", "class", "points", *[r(c, 6) for c in BOX_COLS])


@register("track_candidates", V.with_sql(*PROPOSAL_CTES, V.POSES_SQL, EGO_SQL, body="""
 select n.sequence, n.frame_id, n.object_id, o.object_id as previous_id,
  round(sqrt((n.center_x-o.center_x-ex)*(n.center_x-o.center_x-ex)+(n.center_y-o.center_y-ey)*(n.center_y-o.center_y-ey)
   +(n.center_z-o.center_z)*(n.center_z-o.center_z)), 6) as distance
 from box3 n join ego e on e.sequence=n.sequence and e.frame_id=n.frame_id
 join box3 o on o.sequence=n.sequence and o.frame_id=e.previous_frame
 where not n.fallback and not o.fallback and (n.center_x-o.center_x-ex)*(n.center_x-o.center_x-ex)+(n.center_y-o.center_y-ey)*(n.center_y-o.center_y-ey)
   +(n.center_z-o.center_z)*(n.center_z-o.center_z) < 4""", recursive=True))
def track_candidates(spark, sf):
    return tracks.track_candidates(cluster.object_proposals(
        V.points(spark, sf), rules=cluster.PROPOSAL_RULES[1:]), ego(spark, sf)).select(
        *K, "object_id", "previous_id", r("distance", 6))


def track_ctes(ego, x, y):
    """CTEs `cand` and `chosen`: boxes in id order take the nearest old box that is still free."""
    d2 = "(n.center_x-o.wx)*(n.center_x-o.wx)+(n.center_y-o.wy)*(n.center_y-o.wy)+(n.center_z-o.center_z)*(n.center_z-o.center_z)"
    return [f"""cand as materialized (select n.sequence, n.frame_id, n.object_id, o.object_id as previous_id, o.dt, sqrt({d2}) as distance
  from box3 n join (select e.sequence, e.frame_id, e.dt, o.object_id, {x} as wx, {y} as wy, o.center_z from box3 o join {ego} e
   on o.sequence=e.sequence and o.frame_id=e.previous_frame where not o.fallback) o on o.sequence=n.sequence and o.frame_id=n.frame_id
  where not n.fallback and {d2} < 4)""",
            """turn as materialized (select sequence, frame_id, object_id, row_number() over (partition by sequence, frame_id order by object_id) as k
  from (select distinct sequence, frame_id, object_id from cand) c)""",
            """taking as (select sequence, frame_id, 0::bigint as k, null::bigint as object_id, null::struct(i bigint, d double, t double) as b, []::bigint[] as used
  from (select distinct sequence, frame_id from cand) f union all
  select sequence, frame_id, k, object_id, b, case when b is null then used else list_append(used, b.i) end from (
   select w.sequence, w.frame_id, o.k, o.object_id, w.used, arg_min({'i': c.previous_id, 'd': c.distance, 't': c.dt}, (c.distance, c.previous_id))
    filter (where not list_contains(w.used, c.previous_id)) as b from taking w
   join turn o on o.sequence=w.sequence and o.frame_id=w.frame_id and o.k=w.k+1
   join cand c on c.sequence=o.sequence and c.frame_id=o.frame_id and c.object_id=o.object_id
   group by w.sequence, w.frame_id, o.k, o.object_id, w.used) x)""",
            "chosen as (select sequence, frame_id, object_id, b.i as previous_id, b.d as distance, b.t as dt from taking where b is not null)"]


@register("attach_tracks", V.with_sql(*PROPOSAL_CTES, V.POSES_SQL, EGO_SQL, *track_ctes(
    "ego", "o.center_x+ex", "o.center_y+ey"), body="""
 select b.sequence, b.frame_id, b.object_id, previous_id, round(distance, 6) as displacement_m, round(distance/dt, 6) as speed_mps
 from box3 b left join chosen c on c.sequence=b.sequence and c.frame_id=b.frame_id and c.object_id=b.object_id and not b.fallback""", recursive=True))
def attach_tracks(spark, sf):
    boxes = cluster.object_proposals(V.points(spark, sf), rules=cluster.PROPOSAL_RULES[1:])
    return tracks.attach_tracks(boxes, ego(spark, sf)).select(
        *K, "object_id", "previous_id", r("displacement_m", 6), r("speed_mps", 6))


@register("terrain_ribbons")
def terrain_ribbons(spark, sf):
    p = V.points(spark, sf).withColumn("height", F.col("z") + 1.7)
    return cluster.terrain_ribbons(p).select(*K, "cluster", "points", "i", r("x", 3), r("y", 3), r("z", 3))


@register("temporal_match", V.with_sql(
    V.POINTS_SQL, V.POSES_SQL, S.MOTION_SQL, EGO_SQL, *S.grid_ctes(policies=["adaptive"]), f"""
 ctr as materialized (select sequence, frame_id, size_mm, dominant_class, size_mm::bigint*67108864+(lx+4096)*8192+ly+4096 as leaf_id,
   x+size/2 as cx0, y+size/2 as cy0, mean_z from leaf),
 old as materialized (select sequence, frame_id, leaf_id, dominant_class, size_mm, x, y, z, {hash_sql('o', 0.15)} from (
   select e.sequence, e.frame_id, leaf_id, dominant_class, size_mm, floor((cx0+ex)*10000+0.500001)/10000 as x,
    floor((cy0+ey)*10000+0.500001)/10000 as y, floor(mean_z*10000+0.500001)/10000 as z
   from ctr c join ego e on e.sequence=c.sequence and e.previous_frame=c.frame_id) o),
 new as materialized (select c.sequence, c.frame_id, leaf_id, dominant_class, size_mm, floor(cx0*10000+0.500001)/10000 as x,
   floor(cy0*10000+0.500001)/10000 as y, floor(mean_z*10000+0.500001)/10000 as z
   from ctr c join ego e on e.sequence=c.sequence and e.frame_id=c.frame_id where e.previous_frame is not null),
 probe as materialized (select *, cx+ox as hx, cy+oy as hy, cz+oz as hz from (select *, {hash_sql('n', 0.15)} from new) n, {NEAR27}),
 hit as materialized (select n.sequence, n.frame_id, n.leaf_id, arg_min({{'i': o.leaf_id, 'c': o.dominant_class, 's': o.size_mm, 'z': o.z}},
    (sqrt((n.x-o.x)*(n.x-o.x)+(n.y-o.y)*(n.y-o.y)+(n.z-o.z)*(n.z-o.z)), o.leaf_id)) as b
   from probe n join old o on o.sequence=n.sequence and o.frame_id=n.frame_id and o.cx=n.hx and o.cy=n.hy and o.cz=n.hz
   where (n.x-o.x)*(n.x-o.x)+(n.y-o.y)*(n.y-o.y)+(n.z-o.z)*(n.z-o.z) < 0.15*0.15 group by 1, 2, 3)""", body="""
 select n.sequence, n.frame_id, round(avg((b is not null)::int), 9) as overlap_fraction,
  round(avg((b.c <> n.dominant_class)::int), 9) as semantic_flicker_rate,
  round(avg((b.s <> n.size_mm)::int), 9) as resolution_change_rate, round(avg(abs(n.z-b.z)), 9) as height_stability_mae_m
 from new n left join hit h on h.sequence=n.sequence and h.frame_id=n.frame_id and h.leaf_id=n.leaf_id group by 1, 2"""))
def temporal_match(spark, sf):
    lv = grid.leaves(cells(spark, sf, ("adaptive",)))
    m = spatial.temporal_match(lv, ego(spark, sf))
    return spatial.temporal_summary(m).select(
        *K, r("overlap_fraction"), r("semantic_flicker_rate"), r("resolution_change_rate"),
        r("height_stability_mae_m"))


@register("crop_around_anchor", V.with_sql(V.POINTS_SQL, """
 anchors as (select sequence, frame_id, min(point_id) as anchor, arg_min(x, point_id) as x, arg_min(y, point_id) as y
  from points where truth = 2 and pred <> truth group by 1, 2)""", body="""
 select p.sequence, p.frame_id, p.point_id, a.anchor from points p join anchors a on a.sequence=p.sequence and a.frame_id=p.frame_id
 where (p.x-a.x)*(p.x-a.x)+(p.y-a.y)*(p.y-a.y) < 16"""))
def crop_around_anchor(spark, sf):
    p = V.points(spark, sf)
    anchors = p.where("truth = 2 and pred <> truth").groupBy(*K).agg(
        F.min("point_id").alias("anchor"), F.min_by("x", "point_id").alias("x"),
        F.min_by("y", "point_id").alias("y"))
    return spatial.crop_around(p, anchors, K).select(*K, "point_id", "anchor")


@register("voxel_occupancy", V.with_sql(V.POINTS_SQL, body="""
 select sequence, frame_id, count(*) as occupied, cast(sum(n) as bigint) as point_count, 12800000::bigint as dense_bytes, count(*)*8 as sparse_bytes from (
  select sequence, frame_id, floor((x+10)/0.05) as vx, floor((y+10)/0.05) as vy, floor((z+3)/0.05) as vz, count(*) as n
  from points where x >= -10 and x < 10 and y >= -10 and y < 10 and z >= -3 and z < 1 group by all) v group by 1, 2"""))
def voxel_occupancy(spark, sf):
    return voxel.voxel_summary(V.points(spark, sf))


# --- neighbourhoods inside blocks ---------------------------------------------

PAIRS = """pairs as materialized (select q.block, q.vec_id as q_id, s.vec_id as s_id,
 (q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y)+(q.z-s.z)*(q.z-s.z) as d2 from logits q join logits s on q.block=s.block)"""
RANKED = "ranked as materialized (select *, row_number() over (partition by block, q_id order by d2, s_id) as rank from pairs)"


def _sides(spark, sf):
    e = V.logits(spark, sf)
    return (e.select("block", F.col("vec_id").alias("q_id"), "x", "y", "z"),
            e.select("block", F.col("vec_id").alias("s_id"), "x", "y", "z", "feat"))


def _knn(spark, sf, k):
    q, s = _sides(spark, sf)
    return spatial.knn(q, s, ["block"], k, (0.1, 0.3))


@register("knn", V.with_sql(V.LOGITS_SQL, PAIRS, RANKED, body="""
 select block, q_id, s_id, rank, round(d2, 12) as d2 from ranked where rank <= 8"""))
def knn(spark, sf):
    return _knn(spark, sf, 8).select("block", "q_id", "s_id", F.col("rank").cast("long").alias("rank"),
                                     r("d2", 12))


@register("radius_knn", V.with_sql(V.LOGITS_SQL, PAIRS, RANKED, body="""
 select block, q_id, rank, case when d2 <= 0.01 then s_id else first_value(s_id) over (partition by block, q_id order by rank) end as s_id
 from ranked where rank <= 8"""))
def radius_knn(spark, sf):
    return spatial.radius_knn(_knn(spark, sf, 8), ["block"], 0.1).select(
        "block", "q_id", F.col("rank").cast("long").alias("rank"), "s_id")


BALL = """hits as (select *, row_number() over (partition by block, q_id order by s_id) as slot from pairs where d2 <= 0.15*0.15),
 slots as materialized (select q.block, q.q_id, cast(t.slot as bigint) as slot, coalesce(h.s_id, q.first_id) as s_id
 from (select block, q_id, min(s_id) as first_id from hits group by 1, 2) q cross join range(1, 9) t(slot)
 left join hits h on h.block=q.block and h.q_id=q.q_id and h.slot=t.slot)"""


@register("ball_query", V.with_sql(V.LOGITS_SQL, PAIRS, BALL, body="select * from slots"))
def ball_query(spark, sf):
    q, s = _sides(spark, sf)
    return spatial.ball_query(q, s, ["block"], 0.15, 8).select(
        "block", "q_id", F.col("slot").cast("long").alias("slot"), "s_id")


@register("idw_interpolate", V.with_sql(V.LOGITS_SQL, PAIRS, RANKED, body="""
 select p.block, p.q_id, round(sum(1/(p.d2+1e-8)*l.feat)/sum(1/(p.d2+1e-8)), 9) as feat
 from ranked p join logits l on l.block=p.block and l.vec_id=p.s_id where rank <= 3 group by 1, 2"""))
def idw_interpolate(spark, sf):
    _, s = _sides(spark, sf)
    return spatial.idw_interpolate(_knn(spark, sf, 3), s, ["block"]).select(
        "block", "q_id", r("feat"))


GROUPED = """grouped as materialized (select g.block, g.q_id, g.slot, g.s_id, s.feat, s.x-c.x as dx, s.y-c.y as dy, s.z-c.z as dz
 from slots g join logits s on s.block=g.block and s.vec_id=g.s_id join logits c on c.block=g.block and c.vec_id=g.q_id)"""


def _grouped(spark, sf):
    q, s = _sides(spark, sf)
    return spatial.group_features(spatial.ball_query(q, s, ["block"], 0.15, 8), q, s, ["block"])


@register("sample_and_group", V.with_sql(V.LOGITS_SQL, PAIRS, BALL, GROUPED, body="""
 select block, q_id, slot, s_id, round(feat, 9) as feat, round(dx, 9) as dx, round(dy, 9) as dy, round(dz, 9) as dz from grouped"""))
def sample_and_group(spark, sf):
    return _grouped(spark, sf).select("block", "q_id", F.col("slot").cast("long").alias("slot"), "s_id",
                                      r("feat"), r("dx"), r("dy"), r("dz"))


@register("neighbourhood_max_pool", V.with_sql(V.LOGITS_SQL, PAIRS, BALL, GROUPED, body="""
 select block, q_id, round(max(feat), 9) as max_feat, round(max(dx), 9) as max_dx from grouped group by 1, 2"""))
def neighbourhood_max_pool(spark, sf):
    return spatial.max_pool(_grouped(spark, sf), ["block"], ["feat", "dx"]).select(
        "block", "q_id", r("max_feat"), r("max_dx"))
