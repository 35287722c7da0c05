"""Ground plane, occupancy map and composite frame products."""
from pyspark.sql import functions as F

from scangrid.operators import ground, occupancy
from scangrid.functions import geom as G

from . import views as V
from .maps import K, r
from .registry import register

H = "(((point_id % 1000003 + 1000003) % 1000003 * 7919) % 1000003)"
GROUND_CTES = ["""pool as materialized (select p.* from points p join (select sequence, frame_id, count(*) filter (where sqrt(x*x+y*y) < 35) as nn
  from points group by 1, 2) f using (sequence, frame_id) where nn < 10 or sqrt(x*x+y*y) < 35)""",
               """low as materialized (select p.* from pool p join (select sequence, frame_id, quantile_cont(z, 0.35) as q from pool group by 1, 2) c
  using (sequence, frame_id) where z <= q)""",
               f"""slot as materialized (select sequence, frame_id, slot, min(key) as k0, max(key) as k1, arg_min({{'x': x, 'y': y, 'z': z}}, key) as c0,
  arg_max({{'x': x, 'y': y, 'z': z}}, key) as c1, count(*) as n from (
  select *, {H} * 8796093022208 + point_id % 8796093022208 as key, {H} % 120 as slot from low) l group by 1, 2, 3)""",
               """smp as materialized (select sequence, frame_id, c.x as x, c.y as y, c.z as z, n_low, count(*) over (partition by sequence, frame_id) as m,
  row_number() over (partition by sequence, frame_id order by slot, key) - 1 as rnk from (
  select sequence, frame_id, slot, k0 as key, c0 as c from slot union all
  select sequence, frame_id, slot, k1, c1 from slot where k1 <> k0) u
  join (select sequence, frame_id, sum(n) as n_low from slot group by 1, 2) f using (sequence, frame_id))""",
               """pick as materialized (select sequence, frame_id, t, c, cast(floor(m*(w-floor(w))) as bigint) as rnk from (
  select sequence, frame_id, t, c, m, n_low, (t*3+c+1)*0.6180339887498949::double as w
  from (select distinct sequence, frame_id, m, n_low from smp) f, range(40) a(t), range(3) b(c)) q where n_low >= 3)""",
               """tri as (select p.sequence, p.frame_id, t, max(x) filter (where c=0) as x0, max(y) filter (where c=0) as y0, max(z) filter (where c=0) as z0,
  max(x) filter (where c=1) as x1, max(y) filter (where c=1) as y1, max(z) filter (where c=1) as z1,
  max(x) filter (where c=2) as x2, max(y) filter (where c=2) as y2, max(z) filter (where c=2) as z2
  from pick p join smp s on s.sequence=p.sequence and s.frame_id=p.frame_id and s.rnk=p.rnk group by 1, 2, 3)""",
               """pl0 as (select *, (x1-x0)*(y2-y0)-(x2-x0)*(y1-y0) as det from tri)""",
               """pl1 as (select *, ((z1-z0)*(y2-y0)-(z2-z0)*(y1-y0))/det as a, ((x1-x0)*(z2-z0)-(x2-x0)*(z1-z0))/det as b from pl0 where abs(det) >= 1e-5)""",
               """pl as materialized (select sequence, frame_id, t, a, b, z0-a*x0-b*y0 as c from pl1 where sqrt(a*a+b*b) <= 0.35)""",
               """vote as materialized (select s.sequence, s.frame_id, t, a, b, c, count(*) as inl from low s join pl using (sequence, frame_id)
  where abs(z-(a*x+b*y+c)) < 0.12 group by all)""",
               """bst as materialized (select sequence, frame_id, arg_max({'a': a, 'b': b, 'c': c, 'n': inl}, (inl, -t)) as p from vote group by 1, 2)""",
               """fit as materialized (select sequence, frame_id, regr_count(z, x) as n, avg(x) as mx, avg(y) as my, avg(z) as mz, var_pop(x) as sxx, var_pop(y) as syy,
  covar_pop(x, y) as sxy, covar_pop(x, z) as sxz, covar_pop(y, z) as syz from low s join bst using (sequence, frame_id)
  where p.n >= 3 and abs(z-(p.a*x+p.b*y+p.c)) < 0.12 group by 1, 2)""",
               """planes as materialized (select sequence, frame_id, a, b, mz-a*mx-b*my as c from (select *, (sxz*syy-syz*sxy)/(sxx*syy-sxy*sxy) as a,
  (syz*sxx-sxz*sxy)/(sxx*syy-sxy*sxy) as b from fit) f)"""]


@register("ground_plane", V.with_sql(V.POINTS_SQL, *GROUND_CTES, body="""
 select sequence, frame_id, round(a, 6) as plane_a, round(b, 6) as plane_b, round(c, 6) as plane_c, true as valid from planes"""))
def ground_plane(spark, sf):
    return ground.ground_plane(V.points(spark, sf)).select(
        *K, r("plane_a", 6), r("plane_b", 6), r("plane_c", 6), "valid")


@register("height_above_ground", V.with_sql(V.POINTS_SQL, *GROUND_CTES, body="""
 select p.sequence, p.frame_id, p.point_id, round(z-(a*x+b*y+c), 5) as height from points p join planes using (sequence, frame_id)"""))
def height_above_ground(spark, sf):
    p = V.points(spark, sf)
    return ground.with_height(p, ground.ground_plane(p)).select(*K, "point_id", r("height", 5))


@register("lsq_plane", V.with_sql(V.POINTS_SQL, body="""
 select sequence, frame_id, n, round(a, 9) as a, round(b, 9) as b, round(mz-a*mx-b*my, 9) as c from (
  select *, (sxz*syy-syz*sxy)/(sxx*syy-sxy*sxy) as a, (syz*sxx-sxz*sxy)/(sxx*syy-sxy*sxy) as b from (
   select sequence, frame_id, count(*) as n, avg(x) as mx, avg(y) as my, avg(z) as mz, var_pop(x) as sxx, var_pop(y) as syy,
    covar_pop(x, y) as sxy, covar_pop(x, z) as sxz, covar_pop(y, z) as syz from points group by 1, 2) s) t"""))
def lsq_plane(spark, sf):
    return ground.lsq_plane(V.points(spark, sf), K).select(*K, "n", r("a"), r("b"), r("c"))


OCC_CTES = ["""near as materialized (select * from points where abs(x) < 10 and abs(y) < 10
  and not (x between -3.0 and 2.8 and abs(y) <= 1.25 and z between -1.5 and 0.5))""",
            """base as materialized (select sequence, frame_id, coalesce(quantile_cont(z, 0.15) filter (where sqrt(x*x+y*y) < 6 and pred <= 1),
  quantile_cont(z, 0.15)) as base from near group by 1, 2)""",
            """tiles as materialized (select sequence, frame_id, floor(x) as tx, floor(y/1.5) as ty, quantile_cont(z, 0.15) as tile from near
  where pred in (0, 1) group by 1, 2, 3, 4 having count(*) >= 10)""",
            """mk as materialized (select n.*, sqrt(x*x+y*y) as r, cast(coalesce(tile, base) as float) as g from near n join base b
  on b.sequence=n.sequence and b.frame_id=n.frame_id left join tiles t on t.sequence=n.sequence and t.frame_id=n.frame_id
  and t.tx=floor(n.x) and t.ty=floor(n.y/1.5))""",
            """turns as materialized (select *, (pred in (2,3) and z > g + cast(0.10 as float)) or z > g + cast(0.22 as float) as blocked,
  atan2(y, x) + pi() as turn from mk)""",
            """sec as materialized (select *, cast(floor((turn - floor(turn/(2*pi()))*(2*pi()))/(2*pi())*720) as bigint) as sector from turns)""",
            """nearest as materialized (select sequence, frame_id, sector, cast(min(r) filter (where blocked) as float) as nearest from sec group by 1, 2, 3)""",
            """far as materialized (select s.sequence, s.frame_id, s.sector, cast(max(r) as float) as farthest from sec s join nearest n
  on n.sequence=s.sequence and n.frame_id=s.frame_id and n.sector=s.sector
  where pred in (0,1) and (nearest is null or r < nearest - cast(0.1 as float)) group by 1, 2, 3)""",
            """rays as materialized (select sequence, frame_id, cast(floor((d*cos(ang)+10)/0.2) as bigint) as ix, cast(floor((d*sin(ang)+10)/0.2) as bigint) as iy from (
  select sequence, frame_id, (sector+0.5)*(2*pi()/720)-pi() as ang, unnest(range(cast(ceil(cast(farthest as double)/0.1) as bigint)))*0.1::double as d
  from far where farthest > cast(0.3 as float)) q)""",
            """occ as materialized (select sequence, frame_id, ix, iy, cast(max(value) as integer) as value from (
  select sequence, frame_id, ix, iy, 0 as value from rays where ix between 0 and 99 and iy between 0 and 99 union all
  select sequence, frame_id, cast(floor((x+10)/0.2) as bigint), cast(floor((y+10)/0.2) as bigint), case when blocked then 100 else 0 end
  from turns where blocked or pred in (0,1)) u group by 1, 2, 3, 4)"""]


@register("self_and_near_field", V.with_sql(V.POINTS_SQL, *OCC_CTES[:1], body="""
 select sequence, frame_id, point_id from near"""))
def self_and_near_field(spark, sf):
    return occupancy.near_field(V.points(spark, sf)).select(*K, "point_id")


@register("scan_base", V.with_sql(V.POINTS_SQL, *OCC_CTES[:2], body="""
 select sequence, frame_id, round(base, 9) as base from base"""))
def scan_base(spark, sf):
    return occupancy.scan_base(occupancy.near_field(V.points(spark, sf)), K).select(*K, r("base"))


@register("local_ground", V.with_sql(V.POINTS_SQL, *OCC_CTES[:5], body="""
 select sequence, frame_id, point_id, round(cast(g as double), 6) as ground, blocked from turns"""))
def local_ground(spark, sf):
    near = occupancy.near_field(V.points(spark, sf))
    return occupancy.with_blocked(near, K).select(
        *K, "point_id", F.round(F.col("ground").cast("double"), 6).alias("ground"), "blocked")


@register("sector_limits", V.with_sql(V.POINTS_SQL, *OCC_CTES[:8], body="""
 select n.sequence, n.frame_id, n.sector, round(cast(nearest as double), 5) as nearest, round(cast(farthest as double), 5) as farthest
 from nearest n left join far f on f.sequence=n.sequence and f.frame_id=n.frame_id and f.sector=n.sector"""))
def sector_limits(spark, sf):
    marked = occupancy.with_blocked(occupancy.near_field(V.points(spark, sf)), K)
    return occupancy.sector_limits(marked, K).select(
        *K, "sector", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("nearest", "farthest")])


@register("occupancy_grid", V.with_sql(V.POINTS_SQL, *OCC_CTES, body="select * from occ"))
def occupancy_grid(spark, sf):
    return occupancy.occupancy_cells(V.points(spark, sf))


@register("occupancy_counts", V.with_sql(V.POINTS_SQL, *OCC_CTES, body="""
 select f.sequence, f.frame_id, count(*) filter (where value = 0) as free, count(*) filter (where value = 100) as occupied,
  10000 - count(value) as unknown from (select distinct sequence, frame_id from points) f
  left join occ o on o.sequence = f.sequence and o.frame_id = f.frame_id group by 1, 2"""))
def occupancy_counts(spark, sf):
    return occupancy.occupancy_counts(occupancy.occupancy_cells(V.points(spark, sf)), V.points(spark, sf))


@register("corridor_status", V.with_sql(V.POINTS_SQL, *OCC_CTES, body="""
 select f.sequence, f.frame_id, case when d is not null then 'STOP' when coalesce(s, 0) < 0.7 then 'REVIEW' else 'CLEAR' end as operator_status,
  round(d, 6) as nearest_obstruction_m
 from (select distinct sequence, frame_id from points) f
 left join (select sequence, frame_id, min(x - 2.8) as d from turns where blocked and x > 2.8 and x < 5.8 and abs(y) < 1.5 group by 1, 2) c
  on c.sequence=f.sequence and c.frame_id=f.frame_id
 left join (select sequence, frame_id, count(*)/cast(16*15 as double) as s from occ where ix between 64 and 78 and iy between 42 and 57 group by 1, 2) o
  on o.sequence=f.sequence and o.frame_id=f.frame_id"""))
def corridor_status(spark, sf):
    p = V.points(spark, sf)
    return occupancy.corridor_status(p, occupancy.occupancy_cells(p)).select(
        *K, "operator_status", r("nearest_obstruction_m", 6))


@register("occupancy_map_array", V.with_sql(V.POINTS_SQL, *OCC_CTES, body="""
 select f.sequence, f.frame_id, array_agg(coalesce(value, -1) order by j, i) as data
 from (select distinct sequence, frame_id from points) f cross join range(100) a(i) cross join range(100) b(j)
 left join occ o on o.sequence=f.sequence and o.frame_id=f.frame_id and o.ix=i and o.iy=j group by 1, 2"""))
def occupancy_map_array(spark, sf):
    return occupancy.flatten_map(occupancy.occupancy_cells(V.points(spark, sf)), V.points(spark, sf))
