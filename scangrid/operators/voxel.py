"""Local voxel occupancy."""
from pyspark.sql import DataFrame, functions as F

from ..functions.geom import voxel_index

LOCAL_BOX = ((-10.0, 10.0), (-10.0, 10.0), (-3.0, 1.0))


def crop_box(points: DataFrame, box=LOCAL_BOX) -> DataFrame:
    """Half-open crop: lower bounds included, upper bounds not."""
    keep = F.lit(True)
    for d, (lo, hi) in zip("xyz", box):
        keep = keep & (F.col(d) >= lo) & (F.col(d) < hi)
    return points.where(keep)


def occupied_voxels(points: DataFrame, keys=("sequence", "frame_id"), size=0.05,
                    box=LOCAL_BOX) -> DataFrame:
    cells = [voxel_index(d, size, lo).alias(f"v{d}") for d, (lo, _) in zip("xyz", box)]
    return crop_box(points, box).groupBy(*keys, *cells).agg(F.count(F.lit(1)).alias("points"))


def voxel_summary(points: DataFrame, keys=("sequence", "frame_id"), size=0.05,
                  box=LOCAL_BOX) -> DataFrame:
    dense = 1
    for lo, hi in box:
        dense *= int(round((hi - lo) / size))
    n = F.count(F.lit(1))
    return occupied_voxels(points, keys, size, box).groupBy(*keys).agg(
        n.alias("occupied"), F.sum("points").alias("point_count"),
        F.lit(dense).cast("long").alias("dense_bytes"), (n * 8).alias("sparse_bytes"))
