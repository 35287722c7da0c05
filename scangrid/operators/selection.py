"""Choosing and ordering frames, scans and challenge cases."""
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geom import as_col, radius
from ..session import cut_lineage
from .scale import evenly_spaced, first_n, with_rank

RANGES, SAMPLE = 64, 8192


def natural_key(name) -> Column:
    """Sort key where digit runs compare as numbers: each run without leading zeros, after its length."""
    def part(run):
        digits = F.regexp_replace(run, "^0+(?=[0-9])", "")
        return F.when(run.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)
                      ).otherwise(run)
    runs = F.regexp_extract_all(F.lower(as_col(name)), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, part), "")


def number_frames(files: DataFrame, keys, name="name", limit=None) -> DataFrame:
    """Frame number and time of the files per key in natural order, or of the first ``limit``.

    A long list is split at keys of a bounded sample (``SAMPLE`` names by smallest hash);
    which keys those are decides how evenly the work is dealt, not the result.
    """
    sample = files.select(F.col(name).alias("_name")).where("_name is not null").orderBy(
        F.xxhash64("_name")).limit(SAMPLE)
    picked = sorted(r[0] for r in sample.select(natural_key("_name")).collect())
    edges = sorted(set(picked[::max(1, len(picked) // RANGES)]))
    # The key is bound outside the filter: named inside, it is worked out again for every edge.
    place = F.lit(0) if not edges else F.transform(F.array("_key"), lambda k: F.size(F.filter(
        F.array(*map(F.lit, edges)), lambda e: e <= k)))[0]
    # Written once, as ranking reads keys and ranges several times.
    keyed = cut_lineage(files.withColumn("_key", natural_key(name)).withColumn("_place", place))
    if limit is None:
        out = with_rank(keyed, keys, ["_key", name], F.col("_place"), "frame_id").drop("frame_id_total")
    else:
        out = first_n(keyed, keys, ["_key", name], F.col("_place"), limit, "frame_id")
    return out.withColumn("timestamp", F.col("frame_id") * 0.1).drop("_key", "_place")


def spread_frames(frames: DataFrame, keys, n, order="frame_id", width=1000) -> DataFrame:
    return evenly_spaced(frames, keys, [order], F.floor(F.col(order) / width), n)


def strided_frames(frames: DataFrame, keys, n, order="frame_id", width=1000) -> DataFrame:
    """Like :func:`spread_frames` with positions rounded half to even."""
    ranked = with_rank(frames, keys, [order], F.floor(F.col(order) / width), "_r")
    total, r = F.col("_r_total"), F.col("_r")
    k = F.least(F.lit(n), total)
    step = (total - 1) / F.when(k > 1, k - 1).otherwise(1)
    hit = (k == 1) & (r == 0)
    for shift in (-1, 0, 1):
        i = F.when(step > 0, F.floor(r / step)).otherwise(0) + shift
        hit = hit | ((k > 1) & (i >= 0) & (i < k) & (F.rint(i * step) == r))
    return ranked.where(hit).drop("_r", "_r_total")


def first_clip(frames: DataFrame, keys, longest=8, order="frame_id", width=1000) -> DataFrame:
    """First run of consecutive frames per key, at most ``longest`` long."""
    head = first_n(frames, keys, [order], F.floor(F.col(order) / width), longest, "position")
    start = frames.groupBy(*keys).agg(F.min(order).alias("_start"))
    return head.join(start, list(keys)).where(
        F.col(order) - F.col("_start") == F.col("position")).drop("_start")


def challenge_errors(points: DataFrame, challenges, keys=("sequence", "frame_id")) -> DataFrame:
    """Target points, error share and rank of each challenge group per frame.

    Needs ``label`` (name), ``truth`` and ``pred``. Frames with fewer than two
    targets are left out.
    """
    groups = F.array_compact(F.array(*[
        F.when(F.expr(rule) & (radius() > floor if floor else F.lit(True)), name)
        for name, (rule, floor) in challenges.items()]))
    rows = points.where((F.col("truth") < 4) & (radius() < 100)).select(
        *keys, F.explode(groups).alias("challenge"),
        (F.col("pred") != F.col("truth")).cast("double").alias("_wrong"))
    out = rows.groupBy(*keys, "challenge").agg(
        F.count(F.lit(1)).alias("target_points"), F.avg("_wrong").alias("error_fraction"))
    return out.where("target_points >= 2").withColumn(
        "rank", F.col("error_fraction") + F.least("target_points", F.lit(100)) / 1000)


def worst_case(errors: DataFrame, by=("challenge",), order=("sequence", "frame_id")) -> DataFrame:
    """Highest rank per group; the earliest frame on ties."""
    rest = [c for c in errors.columns if c not in by]
    key = F.struct("rank", *[(-F.col(c)).alias(c) for c in order])
    return errors.groupBy(*by).agg(F.max_by(F.struct(*rest), key).alias("_w")).select(*by, "_w.*")
