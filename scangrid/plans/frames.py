"""Whole-frame products composed from the operators, for any number of frames at once."""
from pyspark.sql import DataFrame, functions as F

from ..operators import cluster, ground, grid, metrics, motion, scale, tracks
from ..schema import FRAME_KEYS, LEAF_BYTES


def process_frames(points: DataFrame, poses: DataFrame) -> dict:
    """Grids, boxes with tracks, ribbons, class shares and motion of every frame."""
    keys = list(FRAME_KEYS)
    moved = motion.frame_motion(poses, fixed_dt=None, speed_floor=None).drop("dt")
    cells = grid.grid_cells(points, ("uniform", "adaptive"), moved)
    planes = ground.ground_plane(points)
    boxes = tracks.attach_tracks(cluster.object_proposals(points), motion.ego_transforms(
        poses, adjacent_only=False))
    return {"motion": moved, "cells": cells, "leaves": grid.leaves(cells), "boxes": boxes,
            "ribbons": cluster.terrain_ribbons(ground.with_height(points, planes)),
            "shares": metrics.class_share(points, keys), "planes": planes}


def frame_documents(points, leaves, boxes, shares, motion_rows, render_cells=16000) -> DataFrame:
    """One nested document per frame.

    Arrays hold at most ``render_cells`` evenly spaced leaves for display; counts and
    bytes always cover all of them.
    """
    keys = list(FRAME_KEYS)
    by = [*keys, "policy"]
    totals = leaves.groupBy(*by).agg(
        F.count(F.lit(1)).alias("active_cells"), (F.count(F.lit(1)) * LEAF_BYTES).alias("bytes"),
        F.count_if(F.col("class_confidence") < 0.5).alias("uncertain"))
    order = ["size_mm", "lx", "ly"]
    shown = scale.evenly_spaced(leaves, by, order, F.col("size_mm") * 8192 + F.col("lx") + 4096,
                                render_cells)
    row = F.array(*[F.round(F.col(c).cast("double"), 4) for c in (
        "x", "y", "size", "dominant_class", "mean_z", "class_confidence", "min_z", "max_z",
        "height_variance")])
    drawn = shown.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(
        *order, row.alias("row")))), lambda s: s["row"]).alias("cells"))
    grids = totals.join(drawn, by).groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(
            "policy", F.struct("active_cells", "bytes", "cells"))))).alias("grids"),
        F.max(F.when(F.col("policy") == "adaptive", F.col("uncertain"))).alias("uncertain_cells"))
    share = shares.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        "class", "share", "confidence"))).alias("weightage"))
    # Boxes per frame: tens, and each stands for at least one 20 cm voxel.
    box = boxes.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(
            "class", "object_id", "center_x", "center_y", "center_z", "size_u", "size_v",
            "size_z", "yaw", "confidence", "points", "fallback"))).alias("boxes"),
        F.count_if(F.col("confidence") < 0.5).alias("uncertain_clusters"))
    count = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("point_count"))
    return (count.join(grids, keys, "left").join(share, keys, "left").join(box, keys, "left")
            .join(motion_rows, keys, "left"))


def regrid(points: DataFrame, motions: DataFrame) -> DataFrame:
    """Leaves for several speed/heading settings; ``motions`` carries a ``variant``."""
    return grid.build_grid(points, ("adaptive",), motions)
