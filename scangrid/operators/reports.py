"""Report tables over map policies: one cube of summed confusions, read by every table.

Scores of a policy, band, interval or stratum are made of the sum of all its frames'
confusions, not of averaged scores; what is an average over frames (cells, bytes, spread)
says so.
"""
from pyspark.sql import DataFrame, functions as F

from ..functions.semantics import clip_pred, is_obstacle, temporal_interval
from ..schema import FRAME_KEYS, LEAF_BYTES
from ..session import cut_lineage
from . import metrics as M
from .quality import obstacle_iou, retention, with_bands
from .scale import null_safe_join

#: Dimensions that each level of the cube keeps.
LEVELS = {"policy": ("policy",), "band": ("policy", "band"), "interval": ("policy", "time_interval", "band"),
          "stratum": ("policy", "scene_stratum"), "frame": ("policy", "band", *FRAME_KEYS)}


def report_cube(counts: DataFrame, strata: DataFrame, interval=None, keys=FRAME_KEYS) -> DataFrame:
    """Scores of every level of ``LEVELS`` from one pass over frame confusions.

    ``counts``: keys, policy, band, truth, pred, n. ``strata``: keys, scene_stratum. ``level``
    tells which dimensions a row keeps, so a dimension that is null in the data is not taken
    for one that was summed up.
    """
    keys = list(keys)
    dims = ["policy", "band", "time_interval", "scene_stratum", *keys]
    interval = temporal_interval("frame_id") if interval is None else interval
    rows = null_safe_join(counts.withColumn("time_interval", interval), strata, keys, "left")
    sets = [[d for d in dims if d in kept] for kept in LEVELS.values()]
    number = {name: sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in kept)
              for name, kept in LEVELS.items()}
    wide = rows.groupingSets(sets, *dims).agg(F.grouping_id().alias("_id"), *M.wide_sums())
    level = F.create_map(*[F.lit(x) for name, n in number.items() for x in (n, name)])[F.col("_id").cast("int")]
    return cut_lineage(M.wide_scores(wide.withColumn("level", level), ["level", *dims]))


def frame_sums(cells: DataFrame, keys=FRAME_KEYS) -> DataFrame:
    """What every report needs of the cells, from one pass: sums per frame, policy, band, truth and class.

    Its rows with a band and a label are the counts of ``report_cube``. Band and truth may be null.
    """
    rows = with_bands(cells).withColumnRenamed("fine_band", "band")
    hard = F.col("fine_complex")
    return cut_lineage(rows.groupBy(*keys, "policy", "band", F.col("fine_truth").alias("truth"),
                                    clip_pred("dominant_class").alias("pred")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_leaf").alias("leaves"), F.sum("splits").alias("splits"),
        *[F.count_if(test).alias(f"{name}_n") for name, test in (("complex", hard), ("simple", ~hard))],
        *[F.sum(F.when(test, F.col("size"))).alias(f"{name}_size") for name, test in (("complex", hard), ("simple", ~hard))]))


def labelled_counts(sums: DataFrame) -> DataFrame:
    """The confusions over shared cells in ``frame_sums``."""
    return sums.where("band is not null and truth < 4").drop(
        "leaves", "splits", *[f"{c}_{s}" for c in ("complex", "simple") for s in ("n", "size")])


def band_report(cube: DataFrame, cells: DataFrame, keys=FRAME_KEYS) -> DataFrame:
    """Scores per policy and band, the spread of the frames' mean IoU, and mean obstacle overlap.

    ``cells``: map cells, or their ``frame_sums``.
    """
    by = ["policy", "band"]
    spread = cube.where("level = 'frame'").groupBy(*by).agg(
        F.stddev_pop("miou").alias("spread"), F.count("miou").alias("frames"))
    of_frames = summed_obstacle_iou if "leaves" in cells.columns else obstacle_iou
    obstacles = of_frames(cells, [*keys, "policy"]).groupBy(*by).agg(F.avg("obstacle_iou").alias("obstacle_iou"))
    own = cube.where("level = 'band'").select(*by, "accuracy", "miou", "labelled")
    return null_safe_join(null_safe_join(own, spread, by, "left"), obstacles, by, "left")


def summed_obstacle_iou(sums: DataFrame, by) -> DataFrame:
    """``quality.obstacle_iou`` from ``frame_sums``."""
    t, p = is_obstacle("truth"), is_obstacle("pred")

    def known(test):
        return F.sum(F.when((F.col("truth") < 4) & test, F.col("n")).otherwise(0))
    return sums.where("band is not null").groupBy(*by, "band").agg(
        M.ratio(known(t & p), known(t | p)).alias("obstacle_iou"))


def interval_report(cube: DataFrame, reference="uniform", policy="adaptive") -> DataFrame:
    """Per interval and band: mean IoU of a policy minus that of the reference, over summed confusions."""
    by = ["time_interval", "band"]

    def of(name):
        return F.max(F.when(F.col("policy") == name, F.col("miou")))
    return cube.where("level = 'interval'").groupBy(*by).agg(
        (of(policy) - of(reference)).alias("delta_miou"),
        F.max(F.when(F.col("policy") == policy, F.col("labelled"))).alias("labelled"))


def stratum_report(cube: DataFrame, strata: DataFrame) -> DataFrame:
    """Scores per policy and scene stratum, with the stratum's frames."""
    frames = strata.groupBy("scene_stratum").agg(F.count(F.lit(1)).alias("frames"))
    own = cube.where("level = 'stratum'").select("policy", "scene_stratum", "accuracy", "miou", "labelled")
    return null_safe_join(own, frames, ["scene_stratum"], "left")


def policy_report(cube: DataFrame, sums: DataFrame, points: DataFrame, keys=FRAME_KEYS) -> DataFrame:
    """Per policy: means over frames of cells, bytes, refinements, kept returns and leaf sizes; scores."""
    keys = list(keys)
    by = [*keys, "policy"]
    frames = sums.groupBy(*by).agg(
        F.sum("leaves").alias("cells"), (F.sum("leaves") * LEAF_BYTES).alias("bytes"),
        F.sum("splits").alias("refined_nodes"),
        *[M.ratio(F.sum(f"{c}_size"), F.sum(f"{c}_n")).alias(f"{c}_mean_cell_m") for c in ("complex", "simple")])
    frames = null_safe_join(frames, retention(points, keys), keys, "left")
    values = ["cells", "bytes", "refined_nodes", "retained_fraction", "complex_mean_cell_m", "simple_mean_cell_m"]
    means = frames.groupBy("policy").agg(F.count(F.lit(1)).alias("frames"),
                                         *[F.avg(v).alias(f"mean_{v}") for v in values])
    own = cube.where("level = 'policy'").select("policy", "accuracy", "miou", "labelled")
    return null_safe_join(means, own, ["policy"], "left")
