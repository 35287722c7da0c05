"""Reductions of per-frame rows into report tables."""
from pyspark.sql import DataFrame, functions as F

from ..functions.semantics import scene_stratum


def policy_summary(rows: DataFrame, by=("policy",), ms="latency_ms") -> DataFrame:
    """Frames, mean milliseconds, frames per second and population spread."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("frames"), F.avg(ms).alias("mean_ms"),
        (1000 / F.avg(ms)).alias("fps"), F.stddev_pop(ms).alias("spread"))


def frame_strata(points: DataFrame, keys=("sequence", "frame_id")) -> DataFrame:
    share = {k: F.avg((F.col("truth") == k).cast("double")) for k in (1, 2, 3)}
    return points.groupBy(*keys).agg(
        scene_stratum(share[3], share[2], share[1]).alias("scene_stratum"))


def strata_summary(frame_scores: DataFrame, strata: DataFrame, keys=("sequence", "frame_id"),
                   value="miou") -> DataFrame:
    """Frames per stratum and mean of each frame's mean-over-bands score."""
    per_frame = frame_scores.groupBy(*keys).agg(F.avg(value).alias("_v"))
    return strata.join(per_frame, list(keys), "left").groupBy("scene_stratum").agg(
        F.count(F.lit(1)).alias("frames"), F.avg("_v").alias(f"mean_{value}"))


def throughput(rows: DataFrame, by, ts="ts") -> DataFrame:
    """Completed frames, seconds between first and last, frames per second."""
    at = F.col(ts).cast("timestamp")
    elapsed = (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 1e6
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(n.alias("completed"), elapsed.alias("elapsed_s"),
                                 F.when(elapsed > 0, n / elapsed).alias("fps"))
