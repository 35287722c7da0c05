"""Frame-to-frame association of object boxes."""
from pyspark.sql import DataFrame, functions as F

from ..functions.geom import rigid, rigid_apply
from ..session import cut_lineage
from .spatial import XY, XYZ, around, square_distance


def track_candidates(boxes: DataFrame, ego: DataFrame, keys=("sequence",), reach=2.0) -> DataFrame:
    """Pairs of dynamic, non-fallback boxes of consecutive frames closer than ``reach``."""
    keys = list(keys)
    b = boxes.where("class = 3 and not fallback").select(
        *keys, "frame_id", "object_id", F.col("center_x").alias("x"),
        F.col("center_y").alias("y"), F.col("center_z").alias("z"))
    old = b.withColumnRenamed("frame_id", "previous_frame").join(ego, [*keys, "previous_frame"])
    warped = rigid_apply(rigid("e_t"), "x", "y", "z")
    old = old.select(*keys, "frame_id", "dt", F.col("object_id").alias("previous_id"),
                     *[v.alias(f"s_{d}") for v, d in zip(warped, XYZ)])
    old = old.select("*", *[F.floor(F.col(f"s_{d}") / reach).alias(f"_c{d}") for d in XY])
    pairs = around(b, XY, reach).join(old, [*keys, "frame_id", "_cx", "_cy"])
    return (pairs.where(square_distance() < reach * reach)
            .withColumn("distance", F.sqrt(square_distance())).drop("_cx", "_cy"))


def attach_tracks(boxes: DataFrame, ego: DataFrame, keys=("sequence",), reach=2.0) -> DataFrame:
    """One-to-one association: boxes choose in id order, each the nearest box still free.

    A box may choose as soon as no earlier box still wants the same previous box.
    All such choices are made at once, so the rounds follow the longest chain of
    conflicts, not the number of boxes.
    """
    keys = [*keys, "frame_id"]
    open_pairs = cut_lineage(track_candidates(boxes, ego, keys[:-1], reach))
    chosen = None
    while True:
        best = open_pairs.groupBy(*keys, "object_id").agg(
            F.min(F.struct("distance", "previous_id")).alias("_b"))
        claim = open_pairs.groupBy(*keys, "previous_id").agg(F.min("object_id").alias("object_id"))
        accepted = best.select(*keys, "object_id", F.col("_b.previous_id").alias("previous_id")).join(
            claim, [*keys, "previous_id", "object_id"])
        accepted = cut_lineage(accepted)
        rows = open_pairs.join(accepted, [*keys, "object_id", "previous_id"], "left_semi")
        chosen = rows if chosen is None else chosen.unionByName(rows)
        open_pairs = cut_lineage(
            open_pairs.join(accepted.select(*keys, "object_id"), [*keys, "object_id"], "left_anti")
            .join(accepted.select(*keys, "previous_id"), [*keys, "previous_id"], "left_anti"))
        if not open_pairs.limit(1).count():
            break
    trail = chosen.select(
        *keys, "object_id", "previous_id", F.col("distance").alias("displacement_m"),
        F.when(F.col("dt") > 0, F.col("distance") / F.col("dt")).alias("speed_mps"),
        *[F.col(f"s_{d}").alias(f"from_{d}") for d in XYZ])
    return boxes.join(trail, [*keys, "object_id"], "left")
