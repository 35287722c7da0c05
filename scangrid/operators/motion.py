"""Ego motion from poses: previous-frame windows over one row per frame."""
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import geom as G
from ..schema import POSE_FIELDS


def lidar_poses(poses: DataFrame, calib: DataFrame) -> DataFrame:
    """World-from-sensor pose: world-from-camera times camera-from-sensor (per sequence)."""
    cal = calib.select("sequence", *[F.col(f).alias(f"c_{f}") for f in POSE_FIELDS])
    joined = poses.join(cal, "sequence")
    out = G.rigid_compose(G.rigid("t"), G.rigid("c_t"))
    keep = [c for c in poses.columns if c not in POSE_FIELDS]
    return joined.select(*keep, *[v.alias(f"t{r}{c}") for (r, c), v in out.items()])


def with_previous_pose(poses: DataFrame, keys=("sequence",), order="frame_id",
                       adjacent_only=False) -> DataFrame:
    """Add the previous frame's pose as ``p_t..`` and its time; NULL for the first frame.

    With ``adjacent_only`` a gap in frame numbers also gives NULL. The window runs
    over one small row per frame, never over points.
    """
    w = W.partitionBy(*keys).orderBy(order)
    out = poses
    for f in (*POSE_FIELDS, "ts_s", order):
        prior = F.lag(f).over(w)
        if adjacent_only:
            prior = F.when(F.lag(order).over(w) == F.col(order) - 1, prior)
        out = out.withColumn(f"p_{f}", prior)
    return out


def frame_motion(poses: DataFrame, fixed_dt=0.1, speed_floor=0.1, keys=("sequence",)) -> DataFrame:
    """Speed and heading per frame relative to the previous one; zero for the first.

    ``fixed_dt=None`` uses the time stamps instead (no motion unless time advances),
    and ``speed_floor=None`` keeps the heading at any speed.
    """
    paired = with_previous_pose(poses, keys)
    rel = G.relative_transform(G.rigid("p_t"), G.rigid("t"))
    dt = F.lit(fixed_dt) if fixed_dt else F.col("ts_s") - F.col("p_ts_s")
    speed, heading = G.planar_motion(rel, dt, speed_floor)
    moved = F.col("p_t00").isNotNull() & (dt > 0)
    return paired.select(*keys, "frame_id", F.when(moved, dt).alias("dt"),
                         F.when(moved, speed).otherwise(0.0).alias("speed"),
                         F.when(moved, heading).otherwise(0.0).alias("heading"))


def ego_transforms(poses: DataFrame, keys=("sequence",), adjacent_only=True) -> DataFrame:
    """Per frame, the transform ``e_t..`` from the previous sensor frame into this one."""
    paired = with_previous_pose(poses, keys, adjacent_only=adjacent_only)
    rel = G.relative_transform(G.rigid("t"), G.rigid("p_t"))
    return (paired.where("p_t00 is not null")
            .select(*keys, "frame_id", F.col("p_frame_id").alias("previous_frame"),
                    (F.col("ts_s") - F.col("p_ts_s")).alias("dt"),
                    *[v.alias(f"e_t{r}{c}") for (r, c), v in rel.items()]))
