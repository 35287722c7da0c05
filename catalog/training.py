"""Blocks, sampling, predictors and SQL functions."""
from pyspark.sql import functions as F

from scangrid.functions import geom as G
from scangrid.functions.register import register_sql_functions
from scangrid.operators import blocks as B, predict

from . import sqltext as S, views as V
from .maps import K, r
from .registry import register

BLOCK_SQL = """blk as materialized (select *, cast(floor(x/10) as bigint) as bx, cast(floor(y/10) as bigint) as by_ from points where sqrt(x*x+y*y) < 100),
 sizes as materialized (select *, case when sqrt(power(greatest(bx*10.0, -(bx*10.0+10), 0), 2)+power(greatest(by_*10.0, -(by_*10.0+10), 0), 2)) >= 25 then 16 else 64 end as samples
  from (select sequence, frame_id, bx, by_, count(*) as original_count, count(*) filter (where truth < 4) as labelled from blk group by all) s)"""


def _sizes(spark, sf):
    return B.block_sizes(V.points(spark, sf), 64, 16)


@register("block_sizes", V.with_sql(V.POINTS_SQL, BLOCK_SQL, body="""
 select sequence, frame_id, bx, by_ as by, original_count, labelled, samples from sizes"""))
def block_sizes(spark, sf):
    return _sizes(spark, sf)


@register("usable_blocks", V.with_sql(V.POINTS_SQL, BLOCK_SQL, body="""
 select sequence, frame_id, bx, by_ as by, original_count from sizes where labelled > 32 and original_count >= 32"""))
def usable_blocks(spark, sf):
    return B.usable_blocks(_sizes(spark, sf)).select(*K, "bx", "by", "original_count")


@register("point_reduction", V.with_sql(V.POINTS_SQL, BLOCK_SQL, body="""
 select sequence, frame_id, cast(sum(samples) as bigint) as network_points, cast(sum(original_count) as bigint) as input_points, count(*) as blocks from sizes group by 1, 2"""))
def point_reduction(spark, sf):
    return B.point_reduction(V.points(spark, sf), 64, 16)


SLOT_SQL = """ordered as (select *, row_number() over (partition by sequence, frame_id, bx, by_ order by ((point_id % 1000003 + 1000003) % 1000003 * 7919) % 1000003, point_id) - 1 as rk from blk),
 slots as materialized (select o.sequence, o.frame_id, o.bx, o.by_, point_id, rk + c*original_count as slot, c > 0 as is_repeat, x, y, truth
  from ordered o join sizes s using (sequence, frame_id, bx, by_), range(64) t(c) where rk + c*original_count < samples)"""


@register("resample_blocks", V.with_sql(V.POINTS_SQL, BLOCK_SQL, SLOT_SQL, body="""
 select sequence, frame_id, bx, by_ as by, point_id, slot, is_repeat from slots"""))
def resample_blocks(spark, sf):
    return B.resample_blocks(V.points(spark, sf), 64, 16).select(
        *K, "bx", "by", "point_id", "slot", "is_repeat")


@register("block_relative_coordinates", V.with_sql(V.POINTS_SQL, BLOCK_SQL, SLOT_SQL, body="""
 select sequence, frame_id, bx, by_ as by, slot, round(x-bx*10, 9) as x, round(y-by_*10, 9) as y from slots where not is_repeat"""))
def block_relative_coordinates(spark, sf):
    return B.resample_blocks(V.points(spark, sf), 64, 16).where("not is_repeat").select(
        *K, "bx", "by", "slot", r("x"), r("y"))


@register("capped_blocks", V.with_sql(V.POINTS_SQL, BLOCK_SQL, body="""
 select sequence, frame_id, bx, by_ as by, pick from (select *, row_number() over (partition by sequence, frame_id
   order by ((bx+16)*64+by_+16+frame_id*4099)*7919 % 1000003, bx, by_) as pick from sizes where labelled > 32 and original_count >= 32) q where pick <= 4"""))
def capped_blocks(spark, sf):
    return B.capped_blocks(B.usable_blocks(_sizes(spark, sf)), 4).select(
        *K, "bx", "by", F.col("pick").cast("long").alias("pick"))


@register("block_label_tensors", V.with_sql(V.POINTS_SQL, BLOCK_SQL, SLOT_SQL, body="""
 select sequence, frame_id, bx, by_ as by, array_agg(truth order by slot) as labels, count(*) as n from slots group by 1, 2, 3, 4"""))
def block_label_tensors(spark, sf):
    t = B.block_tensors(B.resample_blocks(V.points(spark, sf), 64, 16), ["x", "y", "z"])
    return t.select(*K, "bx", "by", "labels", F.size("labels").cast("long").alias("n"))


@register("augmented_blocks")
def augmented_blocks(spark, sf):
    """Random rotation per block (invariants are tested)."""
    return B.augment(B.resample_blocks(V.points(spark, sf), 64, 16)).select(
        *K, "bx", "by", "slot", "x", "y", "z")


@register("normalized_cloud", V.with_sql(V.LOGITS_SQL, """
 c as (select block, avg(x) as mx, avg(y) as my, avg(z) as mz from logits group by 1),
 d as (select l.block, vec_id, x-mx as dx, y-my as dy, z-mz as dz from logits l join c using (block)),
 m as (select block, max(sqrt(dx*dx+dy*dy+dz*dz)) as norm from d group by 1)""", body="""
 select vec_id, round(dx/norm, 9) as x, round(dy/norm, 9) as y, round(dz/norm, 9) as z from d join m using (block)"""))
def normalized_cloud(spark, sf):
    from scangrid.operators.normalize import normalize_cloud
    return normalize_cloud(V.logits(spark, sf), ["block"]).select("vec_id", r("x"), r("y"), r("z"))


RULE = "case when z < -1.66 then 0 when z < -1.4 then 1 when z < -0.6 then 3 else 2 end"


@register("apply_predictor", V.with_sql(V.POINTS_SQL, body=f"""
 select sequence, frame_id, point_id, {RULE} as pred, cast(case when abs(z+1.4) < 0.05 then 0.5 else 0.9 end as double) as conf from points"""))
def apply_predictor(spark, sf):
    return predict.apply_predictor(V.points(spark, sf).select(*K, "point_id", "x", "y", "z")).select(
        *K, "point_id", "pred", "conf")


@register("block_prediction_transfer", V.with_sql(V.POINTS_SQL, BLOCK_SQL, SLOT_SQL, f"""
 smp as materialized (select s.sequence, s.frame_id, s.bx, s.by_, s.point_id, floor((b.x-b.bx*10)*10000+0.5)/10000 as x, floor((b.y-b.by_*10)*10000+0.5)/10000 as y, b.z, {RULE} as pred
  from (select * from slots where not is_repeat) s join blk b using (sequence, frame_id, bx, by_, point_id)),
 loc as materialized (select sequence, frame_id, bx, by_, point_id, floor((x-bx*10)*10000+0.5)/10000 as x, floor((y-by_*10)*10000+0.5)/10000 as y, z from blk)""", body="""
 select l.sequence, l.frame_id, l.point_id, arg_min(s.pred, (sqrt((l.x-s.x)*(l.x-s.x)+(l.y-s.y)*(l.y-s.y)+(l.z-s.z)*(l.z-s.z)), s.point_id)) as pred
 from loc l join smp s using (sequence, frame_id, bx, by_) group by 1, 2, 3"""))
def block_prediction_transfer(spark, sf):
    """Predict the sampled points of each block, then give every point its nearest sample's class."""
    p = V.points(spark, sf).select(*K, "point_id", "x", "y", "z", "truth")
    snap = [B.snapped(c, 1e-4).alias(c) for c in ("x", "y")]
    samples = B.resample_blocks(p, 64, 16).where("not is_repeat").select(
        *B.BLOCK_KEYS, F.col("point_id").alias("sample_id"), *snap, "z")
    predicted = predict.apply_predictor(samples)
    return B.transfer_labels(p, predicted, step=1e-4).select(*K, "point_id", "pred")


@register("sql_policy_functions", V.with_sql(V.POINTS_SQL, f"""
 m as (select *, cast(15 as double) as speed, cast(0.3 as double) as heading from points)""", body=f"""
 select sequence, frame_id, point_id, round({S.fovea('x', 'y')}, 9) as fovea,
  {S.semantic_split('truth', 'pred', 'intensity_u8', 'instance_id % 3')} as mixed from m"""))
def sql_policy_functions(spark, sf):
    register_sql_functions(spark)
    p = V.points(spark, sf)
    return p.selectExpr(
        "sequence", "frame_id", "point_id", "round(fovea_distance(x, y, 15D, 0.3D), 9) as fovea",
        "semantic_split(truth, pred, intensity_u8, instance_id % 3) as mixed")


@register("scalar_geometry", V.with_sql(V.POINTS_SQL, body="""
 select point_id, frame_id, cast(floor(x/0.05+1e-7) as bigint)*8192 + 4096*8192 + cast(floor(y/0.05+1e-7) as bigint) + 4096 as cell_key,
  cast(floor((t - floor(t/(2*pi()))*(2*pi()))/(2*pi())*720) as bigint) as azimuth,
  (cast(floor(x/10) as bigint)+16)*64 + cast(floor(y/10) as bigint)+16 as block_key,
  round(sqrt(power(greatest(floor(x/10)*10, -(floor(x/10)*10+10), 0), 2)+power(greatest(floor(y/10)*10, -(floor(y/10)*10+10), 0), 2)), 9) as block_distance,
  round((x-5)*cos(0.7)+(y-5)*sin(0.7)+5, 9) as rx, round((y-5)*cos(0.7)-(x-5)*sin(0.7)+5, 9) as ry,
  round(w-floor(w), 5) as dither
 from (select *, atan2(y, x)+pi() as t, sin(x*12.9898+y*78.233)*43758.5453 as w from points) p"""))
def scalar_geometry(spark, sf):
    rx, ry = G.rotate_block("x", "y", 0.7)
    bx, by = G.block_index("x"), G.block_index("y")
    return V.points(spark, sf).select(
        "point_id", "frame_id", G.cell_key(G.cell_index("x"), G.cell_index("y")).alias("cell_key"),
        G.azimuth_bin("x", "y").alias("azimuth"), G.block_key(bx, by).alias("block_key"),
        F.round(G.near_block_distance(bx, by), 9).alias("block_distance"),
        F.round(rx, 9).alias("rx"), F.round(ry, 9).alias("ry"),
        F.round(G.spatial_dither("x", "y"), 5).alias("dither"))


@register("even_centroids", V.with_sql(V.LOGITS_SQL, """
 rk as (select block, vec_id, row_number() over (partition by block order by vec_id) - 1 as r, count(*) over (partition by block) as total from logits)""", body="""
 select block, vec_id from rk semi join (select b2, case when i = k - 1 then total - 1 else cast(floor(i*((total-1)/cast(k-1 as double))) as bigint) end as pos
  from (select block as b2, max(total) as total, least(max(total), 16) as k from rk group by 1) n, range(16) t(i) where i < k) p on b2=block and pos=r"""))
def even_centroids(spark, sf):
    from scangrid.operators.scale import evenly_spaced
    return evenly_spaced(V.logits(spark, sf).select("block", "vec_id"), ["block"], ["vec_id"],
                         F.floor(F.col("vec_id") / 16), 16)


@register("farthest_points")
def farthest_points(spark, sf):
    """Sequential by nature; tested against brute force. Blocks are bounded by resampling."""
    from scangrid.operators.normalize import farthest_points as pick
    samples = B.resample_blocks(V.points(spark, sf), 64, 16).where("not is_repeat")
    return pick(samples, B.BLOCK_KEYS, 8)


@register("block_inventory", V.with_sql(V.POINTS_SQL, BLOCK_SQL, body="""
 select case when frame_id = 7 then 'valid' else 'train' end as split, count(*) as blocks, count(distinct sequence) as sequences, count(distinct (sequence, frame_id)) as scans
 from sizes where labelled > 32 and original_count >= 32 group by 1"""))
def block_inventory(spark, sf):
    from scangrid.sources.sinks import block_inventory as inventory
    usable = B.usable_blocks(_sizes(spark, sf))
    return inventory(usable.withColumn("split", F.when(F.col("frame_id") == 7, "valid").otherwise("train")))


@register("prediction_table_roundtrip", V.with_sql(V.POINTS_SQL, body=f"""
 select sequence, {RULE} as pred, count(*) as n from points group by 1, 2"""))
def prediction_table_roundtrip(spark, sf):
    """Predictions written by model signature and sequence, then read back."""
    from scangrid.sources import sinks
    from scangrid.streaming.frames import shared_folder
    sig = predict.model_signature("height-rules", {"n": 4096})
    rows = predict.apply_predictor(V.points(spark, sf).select(*K, "point_id", "x", "y", "z"), signature=sig)
    path = shared_folder(spark, "predictions")
    sinks.write_predictions(rows, path)
    back = sinks.read_predictions(spark, path, sig)
    return back.groupBy(F.col("sequence").cast("long").alias("sequence"), "pred").agg(
        F.count(F.lit(1)).alias("n"))


@register("paired_models", V.with_sql(V.POINTS_SQL, f"""
 both_models as (select sequence, frame_id, 'a' as model, truth, least(pred, 4) as pred from points where truth < 4
  union all select sequence, frame_id, 'b', truth, {RULE} from points where truth < 4),
 counts as (select sequence, frame_id, model, truth, pred, count(*) as n from both_models group by all)""", body=f"""
 select sequence, frame_id, round(max(miou) filter (where model='b') - max(miou) filter (where model='a'), 9) as delta_miou
 from ({S.scores_sql('counts', ('sequence', 'frame_id', 'model'))}) s group by 1, 2"""))
def paired_models(spark, sf):
    """Per-frame mean IoU of the rule predictor minus that of the stored predictions."""
    from scangrid.operators import metrics as M
    p = V.points(spark, sf).where("truth < 4")
    a = p.select(*K, F.lit("a").alias("model"), "truth", "pred")
    b = predict.apply_predictor(p).select(*K, F.lit("b").alias("model"), "truth", "pred")
    by = [*K, "model"]
    sc = M.scores(M.confusion(a.unionByName(b), by), by).withColumn("miou", F.round("miou", 9))
    return M.paired_delta(sc, K, "model", "a", "b", ["miou"]).select(*K, r("delta_miou"))


@register("previous_frame_pairs", V.with_sql(V.POSES_SQL, body="""
 select a.sequence, a.frame_id, b.frame_id as previous_frame from poses a join poses b on a.sequence=b.sequence and a.frame_id=b.frame_id+1
 where a.frame_id % 4 <> 0 and b.frame_id % 4 <> 0"""))
def previous_frame_pairs(spark, sf):
    """Only true predecessors pair up: every fourth frame is missing here."""
    from scangrid.operators.motion import ego_transforms
    kept = V.poses(spark, sf).where("frame_id % 4 <> 0")
    return ego_transforms(kept).select(*K, "previous_frame")
