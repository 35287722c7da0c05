"""Map policies compared against labels, on their own leaves and on shared 5 cm cells.

Every 5 cm cell already carries the leaf that covers it, so the shared-support
comparison needs no join at all.
"""
from pyspark.sql import DataFrame, functions as F

from ..functions import geom as G
from ..functions.semantics import distance_band, is_obstacle
from ..schema import FRAME_KEYS, LEAF_BYTES, UNIT_M
from . import metrics as M
from .grid import leaves

BY = (*FRAME_KEYS, "policy")


def with_bands(cells: DataFrame) -> DataFrame:
    """`leaf_band` from the leaf centre, `fine_band` from the 5 cm cell centre."""
    half = F.col("size") / 2
    return (cells.withColumn("leaf_band",
                             distance_band(G.radius(F.col("x") + half, F.col("y") + half)))
            .withColumn("fine_band", distance_band(
                G.radius(F.col("ix") * UNIT_M + 0.025, F.col("iy") * UNIT_M + 0.025))))


def leaf_confusion(cells, by=BY) -> DataFrame:
    """Majority truth against the dominant class, one vote per leaf."""
    rows = with_bands(leaves(cells).withColumn("ix", F.lit(0)).withColumn("iy", F.lit(0)))
    return M.confusion(rows.where("leaf_band is not null"), (*by, "leaf_band"),
                       "truth_class", "dominant_class").withColumnRenamed("leaf_band", "band")


def common_confusion(cells, by=BY) -> DataFrame:
    """Truth of each 5 cm cell against the class of the leaf covering it."""
    return M.confusion(with_bands(cells).where("fine_band is not null"), (*by, "fine_band"),
                       "fine_truth", "dominant_class").withColumnRenamed("fine_band", "band")


def elevation_errors(cells, by=BY) -> DataFrame:
    """Leaf height minus 5 cm cell height: mean, lowest and highest return."""
    rows = with_bands(cells).where("fine_band is not null").withColumnRenamed("fine_band", "band")
    by = [*by, "band"]
    kinds = F.array(*[F.struct(F.lit(k).alias("statistic"), e.alias("error")) for k, e in (
        ("mean", F.col("mean_z") - F.col("fine_mean_z")),
        ("min", F.col("min_z") - F.col("fine_min_z")),
        ("max", F.col("max_z") - F.col("fine_max_z")))])
    return M.error_stats(rows.select(*by, F.inline(kinds)), [*by, "statistic"], "error")


def obstacle_iou(cells, by=BY) -> DataFrame:
    """Obstacle overlap on labelled 5 cm cells, and cells mixing heights over 0.5 m."""
    t, p = is_obstacle("fine_truth"), is_obstacle("dominant_class")
    known = F.col("fine_truth") < 4
    both, either = F.count_if(known & t & p), F.count_if(known & (t | p))
    return (with_bands(cells).where("fine_band is not null")
            .withColumnRenamed("fine_band", "band").groupBy(*by, "band")
            .agg(M.ratio(both, either).alias("obstacle_iou"),
                 F.count_if(F.col("max_z") - F.col("min_z") > 0.5).alias("multi_height_cells")))


def leaf_histogram(cells, by=BY) -> DataFrame:
    """Leaves, bytes, and count, area and area share of each size, zeros included."""
    rows = with_bands(leaves(cells).withColumn("ix", F.lit(0)).withColumn("iy", F.lit(0)))
    rows = rows.where("leaf_band is not null").withColumnRenamed("leaf_band", "band")
    sizes = ((50, "0.05"), (100, "0.1"), (250, "0.25"), (500, "0.5"))
    counts = [F.count_if(F.col("size_mm") == mm).alias(f"n_{mm}") for mm, _ in sizes]
    wide = rows.groupBy(*by, "band").agg(F.count(F.lit(1)).alias("cells"), *counts)
    area = {mm: F.col(f"n_{mm}") * ((mm / 1000) ** 2) for mm, _ in sizes}
    total = sum((area[mm] for mm, _ in sizes[1:]), area[sizes[0][0]])

    def as_map(values):
        pairs = []
        for (mm, label) in sizes:
            pairs += [F.lit(label), values[mm]]
        return F.create_map(*pairs)
    return wide.select(
        *by, "band", "cells", (F.col("cells") * LEAF_BYTES).alias("bytes"),
        as_map({mm: F.col(f"n_{mm}") for mm, _ in sizes}).alias("histogram"),
        as_map(area).alias("area_m2"),
        as_map({mm: M.ratio(area[mm], total) for mm, _ in sizes}).alias("area_fraction"))


def complexity_sizes(cells, by=BY) -> DataFrame:
    """Mean covering-leaf size where the 5 cm cell is complex, and where it is not."""
    return cells.groupBy(*by).agg(
        F.avg(F.when(F.col("fine_complex"), F.col("size"))).alias("complex_mean_cell_m"),
        F.avg(F.when(~F.col("fine_complex"), F.col("size"))).alias("simple_mean_cell_m"))


def boundary_distance(points, cells, by=BY, keys=FRAME_KEYS) -> DataFrame:
    """Distance to the nearest leaf edge of points in leaves holding several true classes."""
    keys = list(keys)
    mixed = cells.where("truth_kinds > 1").select(
        *keys, "policy", "ix", "iy", F.col("x").alias("ox"), F.col("y").alias("oy"), "size")
    rows = (points.where(G.in_range()).select(*keys, "x", "y", G.cell_index("x").alias("ix"),
                                              G.cell_index("y").alias("iy"))
            .join(mixed, [*keys, "ix", "iy"])
            .withColumn("edge", G.edge_distance("x", "y", "ox", "oy", "size")))
    return M.error_stats(rows, by, "edge", prefix="boundary_")


def retention(points, by=FRAME_KEYS) -> DataFrame:
    return points.groupBy(*by).agg(
        (F.count_if(G.in_range()) / F.greatest(F.count(F.lit(1)), F.lit(1)))
        .alias("retained_fraction"))


def point_confusion(points, cells, by=("policy",), keys=FRAME_KEYS, policies=None) -> DataFrame:
    """Truth of labelled points under 100 m against their leaf's class, per band.

    Points are counted per 5 cm cell before the join, so a crowded cell sends one
    row per (truth, band), not one per point.
    """
    keys = list(keys)
    counted = (points.where(G.in_range() & (F.col("truth") < 4))
               .groupBy(*keys, G.cell_index("x").alias("ix"), G.cell_index("y").alias("iy"),
                        "truth", distance_band(G.radius()).alias("band"))
               .agg(F.count(F.lit(1)).alias("n")))
    joined = counted.join(cells.select(*keys, "policy", "ix", "iy", "dominant_class"),
                          [*keys, "ix", "iy"])
    return M.confusion(joined, (*by, "band"), "truth", "dominant_class", weight="n")
