"""Metric 10 m blocks: resampling, augmentation, training sets, label transfer."""
import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import geom as G
from .ground import shuffle_key
from .scale import with_rank
from .spatial import nearest_capped

BLOCK_KEYS = ("sequence", "frame_id", "bx", "by")


def with_blocks(points: DataFrame) -> DataFrame:
    return points.where(G.in_range()).withColumn("bx", G.block_index("x")).withColumn(
        "by", G.block_index("y"))


def block_sizes(points: DataFrame, n=4096, far_n=None, keys=BLOCK_KEYS) -> DataFrame:
    """Returns per block and how many samples it gets: ``far_n`` if wholly beyond 25 m."""
    want = F.lit(n)
    if far_n:
        want = F.when(G.near_block_distance("bx", "by") >= 25, far_n).otherwise(n)
    return with_blocks(points).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("original_count"),
        F.count_if(F.col("truth") < 4).alias("labelled")).withColumn("samples", want)


def point_reduction(points: DataFrame, n=4096, far_n=None,
                    by=("sequence", "frame_id")) -> DataFrame:
    """Points fed to a predictor per frame."""
    return block_sizes(points, n, far_n).groupBy(*by).agg(
        F.sum("samples").alias("network_points"), F.sum("original_count").alias("input_points"),
        F.count(F.lit(1)).alias("blocks"))


def _uniform(salt, *columns) -> Column:
    """Repeatable pseudo-random number in (0, 1) from ids."""
    return (F.pmod(F.xxhash64(F.lit(salt), *columns), F.lit(1 << 32)) + 0.5) / float(1 << 32)


def _normal(salt, *columns) -> Column:
    a, b = _uniform(salt, *columns), _uniform(salt + 1, *columns)
    return F.sqrt(-2 * F.ln(a)) * F.cos(b * (2 * math.pi))


def resample_blocks(points: DataFrame, n=4096, far_n=None, sigma=0.002, seed=0,
                    keys=BLOCK_KEYS) -> DataFrame:
    """Exactly ``n`` (or ``far_n``) rows per block, coordinates relative to the block.

    Blocks with enough points give a hash-ordered subset, each point once. Smaller
    blocks repeat their points in turn; repeats get a small offset (the height
    channel follows the vertical one).
    """
    keys = list(keys)
    sizes = block_sizes(points, n, far_n, keys)
    ordered = with_rank(with_blocks(points).withColumn("_h", shuffle_key(seed)), keys,
                        ["_h", "point_id"], F.floor(F.col("_h") / 2000), "_rank")
    rows = ordered.drop("_rank_total").join(sizes.drop("labelled"), keys).where(
        F.col("_rank") < F.col("samples"))
    # Slots of one point: its rank, then every original_count further on.
    copies = F.floor((F.col("samples") - 1 - F.col("_rank")) / F.col("original_count"))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), copies)))
    rows = rows.withColumn("slot", F.col("_rank") + F.col("_copy") * F.col("original_count"))
    ids = [F.col("point_id"), F.col("slot")]
    repeat = F.col("_copy") > 0
    jitter = {d: F.when(repeat, _normal(seed + 10 + 2 * i, *ids) * sigma).otherwise(0.0)
              for i, d in enumerate("xyz")}
    out = rows.withColumn("jitter_z", jitter["z"]).withColumn(
        "x", F.col("x") - F.col("bx") * 10 + jitter["x"]).withColumn(
        "y", F.col("y") - F.col("by") * 10 + jitter["y"]).withColumn(
        "z", F.col("z") + F.col("jitter_z"))
    if "height" in points.columns:
        out = out.withColumn("height", F.col("height") + F.col("jitter_z"))
    return out.withColumn("is_repeat", repeat).drop("_h", "_rank", "_copy", "jitter_z")


def augment(samples: DataFrame, seed=0, keys=BLOCK_KEYS) -> DataFrame:
    """Random rotation per block about its centre and a random row order."""
    theta = (_uniform(seed + 31, *keys) * 2 - 1) * math.pi
    rx, ry = G.rotate_block("x", "y", F.col("_theta"))
    return (samples.withColumn("_theta", theta).withColumn("_rx", rx).withColumn("_ry", ry)
            .withColumn("x", F.col("_rx")).withColumn("y", F.col("_ry"))
            .withColumn("order_key", F.xxhash64(F.lit(seed), F.col("point_id"), F.col("slot")))
            .drop("_theta", "_rx", "_ry"))


def usable_blocks(sizes: DataFrame) -> DataFrame:
    return sizes.where((F.col("labelled") > 32) & (F.col("original_count") >= 32))


def capped_blocks(sizes: DataFrame, per_scan, limit=None, seed=0) -> DataFrame:
    """At most ``per_scan`` blocks per frame in shuffled order, then an overall limit.

    A frame has at most 400 blocks, so its window is small whatever the data size.
    """
    order = ((F.col("bx") + 16) * 64 + F.col("by") + 16 + F.col("frame_id") * 4099
             + seed) * 7919 % 1000003
    w = W.partitionBy("sequence", "frame_id").orderBy(order, "bx", "by")
    out = sizes.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= per_scan)
    if limit:
        out = out.orderBy(order, "sequence", "frame_id", "bx", "by").limit(limit)
    return out


def block_tensors(samples: DataFrame, channels, keys=BLOCK_KEYS) -> DataFrame:
    """One row per block: channel-major features and labels in slot order.

    A block holds a fixed number of samples, which bounds the collected arrays.
    """
    row = F.struct("slot", *channels, "truth")
    packed = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_r"),
                                        F.first("original_count").alias("original_points"))
    def channel(name):
        return F.transform("_r", lambda r: r[name].cast("float"))
    features = F.array(*[channel(c) for c in channels])
    return packed.select(*keys, "original_points", features.alias("features"),
                         F.transform("_r", lambda r: r["truth"]).alias("labels"))


def snapped(column, step) -> Column:
    """Nearest multiple of ``step``, which divides one."""
    parts = round(1 / step)
    return F.floor(F.col(column) * parts + 0.5) / parts


def transfer_labels(points: DataFrame, predicted: DataFrame, keys=BLOCK_KEYS,
                    columns=("pred", "conf"), step=None) -> DataFrame:
    """Give every point the prediction of the nearest sampled point of its block.

    ``predicted`` has block-relative x, y, z and ``sample_id``. With ``step`` the points'
    block-relative x and y are rounded to multiples of it, as those of the samples have to
    be, so that equal distances compare equal. Ties go to the smaller id.
    """
    keys = list(keys)
    local = with_blocks(points.drop(*columns)).withColumn("_gx", F.col("x")).withColumn(
        "_gy", F.col("y")).withColumn("x", F.col("x") - F.col("bx") * 10).withColumn(
        "y", F.col("y") - F.col("by") * 10)
    if step:
        local = local.withColumns({c: snapped(c, step) for c in ("x", "y")})
    near = nearest_capped(local, predicted, keys, 1e4, source_id="sample_id", carry=columns, rooted=True)
    return (near.withColumn("x", F.col("_gx")).withColumn("y", F.col("_gy")).drop("_gx", "_gy", "nearest_id", "distance"))
