"""Local occupancy map: blocked, observed free, unknown."""
import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geom as G
from ..functions.semantics import is_ground, is_obstacle
from .scale import exact_percentiles

# --- fixed values: sensor vehicle footprint and decision limits ---
NOSE_M, TAIL_M, HALF_WIDTH_M, SELF_Z = 2.8, -3.0, 1.25, (-1.5, 0.5)
FREE, OCCUPIED, UNKNOWN = 0, 100, -1
SECTORS = 720


def is_self_return() -> Column:
    return (F.col("x").between(TAIL_M, NOSE_M) & (F.abs("y") <= HALF_WIDTH_M)
            & F.col("z").between(*SELF_Z))


def near_field(points: DataFrame, extent=20.0) -> DataFrame:
    """Finite returns inside the map square, without the vehicle's own body."""
    half = extent / 2
    return points.where((F.abs("x") < half) & (F.abs("y") < half)
                        & (F.abs("z") < float("inf")) & ~is_self_return())


def scan_base(near: DataFrame, keys) -> DataFrame:
    """15th percentile of height over close ground returns, else over all of them."""
    core = near.where((G.radius() < 6) & (F.col("pred") <= 1))
    a = exact_percentiles(core, keys, "z", (0.15,), 0.01, names=["_core"])
    b = exact_percentiles(near, keys, "z", (0.15,), 0.01, names=["_all"])
    return b.join(a, list(keys), "left").select(*keys, F.coalesce("_core", "_all").alias("base"))


def with_local_ground(near: DataFrame, keys) -> DataFrame:
    """Ground height per 1 x 1.5 m tile, where ten ground returns support it."""
    keys = list(keys)
    tiled = near.withColumn("tx", F.floor("x")).withColumn("ty", F.floor(F.col("y") / 1.5))
    tiles = exact_percentiles(tiled.where(is_ground("pred")), [*keys, "tx", "ty"], "z", (0.15,),
                              0.01, names=["_tile"], count_name="_n").where("_n >= 10").drop("_n")
    return (tiled.join(scan_base(near, keys), keys).join(tiles, [*keys, "tx", "ty"], "left")
            .withColumn("ground", F.coalesce("_tile", "base").cast("float"))
            .drop("_tile", "base", "tx", "ty"))


def with_blocked(near: DataFrame, keys) -> DataFrame:
    g, z = F.col("ground"), F.col("z")
    low, high = F.lit(0.10).cast("float"), F.lit(0.22).cast("float")
    return with_local_ground(near, keys).withColumn(
        "blocked", (is_obstacle("pred") & (z > g + low)) | (z > g + high))


def sector_limits(marked: DataFrame, keys) -> DataFrame:
    """Farthest observed free distance per azimuth sector, short of its first obstacle."""
    keys = list(keys)
    m = marked.withColumn("sector", G.azimuth_bin("x", "y", SECTORS)).withColumn("r", G.radius())
    nearest = m.groupBy(*keys, "sector").agg(
        F.min(F.when(F.col("blocked"), F.col("r"))).cast("float").alias("nearest"))
    limit = F.coalesce(F.col("nearest") - F.lit(0.1).cast("float"), F.lit(float("inf")))
    # Only the ring that holds the limit needs its single returns; of the rings inside
    # it the farthest return is enough, and those beyond do not count.
    ground = m.where(is_ground("pred")).withColumn("ring", F.floor(F.col("r") * 10))
    rings = ground.groupBy(*keys, "sector", "ring").agg(F.max("r").alias("r"))
    edge = F.floor(limit.cast("double") * 10)
    bounded = nearest.withColumn("_edge", edge)
    inside = (rings.join(nearest, [*keys, "sector"]).where(F.col("r") < limit)
              .select(*keys, "sector", "r"))
    at_edge = (ground.join(bounded.withColumnRenamed("_edge", "ring"), [*keys, "sector", "ring"])
               .where(F.col("r") < limit).select(*keys, "sector", "r"))
    far = inside.unionByName(at_edge).groupBy(*keys, "sector").agg(
        F.max("r").cast("float").alias("farthest"))
    return nearest.join(far, [*keys, "sector"], "left")


def ray_cells(limits: DataFrame, keys, extent=20.0, res=0.2) -> DataFrame:
    """Map cells passed by each free ray, stepped at half a cell."""
    half, width = extent / 2, int(round(extent / res))
    far = F.col("farthest").cast("double")
    steps = F.ceil(far / (res / 2)).cast("int")
    angle = (F.col("sector") + 0.5) * (2 * math.pi / SECTORS) - math.pi
    rays = (limits.where(F.col("farthest") > F.lit(0.3).cast("float"))
            .withColumn("_d", F.explode(F.sequence(F.lit(0), steps - 1)))
            .withColumn("_d", F.col("_d") * (res / 2))
            .withColumn("ix", F.floor((F.col("_d") * F.cos(angle) + half) / res))
            .withColumn("iy", F.floor((F.col("_d") * F.sin(angle) + half) / res)))
    return rays.where(F.col("ix").between(0, width - 1) & F.col("iy").between(0, width - 1)).select(
        *keys, "ix", "iy")


def occupancy_cells(points: DataFrame, keys=("sequence", "frame_id"), extent=20.0,
                    res=0.2) -> DataFrame:
    """Known cells with value 0 (free) or 100 (occupied); all others are unknown."""
    keys = list(keys)
    half, width = extent / 2, int(round(extent / res))
    if not 0 < width <= 1024:
        raise ValueError("map width must be 1..1024 cells")
    marked = with_blocked(near_field(points, extent), keys)

    def at(c):
        return F.least(F.greatest(F.floor((F.col(c) + half) / res), F.lit(0)), F.lit(width - 1))
    rays = ray_cells(sector_limits(marked, keys), keys, extent, res).withColumn(
        "value", F.lit(FREE))
    hits = marked.where(F.col("blocked") | is_ground("pred")).select(
        *keys, at("x").alias("ix"), at("y").alias("iy"),
        F.when(F.col("blocked"), OCCUPIED).otherwise(FREE).alias("value"))
    return rays.unionByName(hits).groupBy(*keys, "ix", "iy").agg(F.max("value").alias("value"))


def occupancy_counts(cells: DataFrame, frames: DataFrame, keys=("sequence", "frame_id"),
                     extent=20.0, res=0.2):
    """Cells per state of every frame in ``frames``, also of those without a known cell."""
    keys, width = list(keys), int(round(extent / res))
    known = cells.groupBy(*keys).agg(
        F.count_if(F.col("value") == FREE).alias("free"),
        F.count_if(F.col("value") == OCCUPIED).alias("occupied"))
    none = F.lit(0).cast("long")
    out = frames.select(*keys).distinct().join(known, keys, "left").select(
        *keys, F.coalesce("free", none).alias("free"), F.coalesce("occupied", none).alias("occupied"))
    return out.withColumn("unknown", F.lit(width * width) - F.col("free") - F.col("occupied"))


def corridor_status(points: DataFrame, cells: DataFrame, keys=("sequence", "frame_id"),
                    extent=20.0, res=0.2) -> DataFrame:
    """STOP, REVIEW or CLEAR for the 3 m ahead of the nose, and the nearest obstruction."""
    keys = list(keys)
    half, width = extent / 2, int(round(extent / res))
    marked = with_blocked(near_field(points, extent), keys)
    ahead = (F.col("x") > NOSE_M) & (F.col("x") < NOSE_M + 3) & (F.abs("y") < 1.5)
    closest = marked.where(ahead & F.col("blocked")).groupBy(*keys).agg(
        F.min(F.col("x") - NOSE_M).alias("nearest_obstruction_m"))
    y0, y1 = max(0, math.floor((-1.5 + half) / res)), min(width, math.ceil((1.5 + half) / res))
    x0 = max(0, math.floor((NOSE_M + half) / res))
    x1 = min(width, math.ceil((NOSE_M + 3 + half) / res))
    seen = cells.where(F.col("ix").between(x0, x1 - 1) & F.col("iy").between(y0, y1 - 1)).groupBy(
        *keys).agg((F.count(F.lit(1)) / ((x1 - x0) * (y1 - y0))).alias("_seen"))
    frames = points.select(*keys).distinct()
    status = (F.when(F.col("nearest_obstruction_m").isNotNull(), "STOP")
              .when(F.coalesce("_seen", F.lit(0.0)) < 0.7, "REVIEW").otherwise("CLEAR"))
    return (frames.join(closest, keys, "left").join(seen, keys, "left")
            .select(*keys, status.alias("operator_status"), "nearest_obstruction_m"))


def flatten_map(cells: DataFrame, frames: DataFrame, keys=("sequence", "frame_id"), extent=20.0,
                res=0.2):
    """Row-major array of the whole map of every frame in ``frames``, -1 where unknown.

    Map rows with a known cell are filled first (at most W cells each); the others come
    from one constant, so no blank cells are shuffled.
    """
    keys, width = list(keys), int(round(extent / res))
    rows = cells.groupBy(*keys, "iy").agg(F.map_from_entries(
        F.collect_list(F.struct(F.col("ix").cast("int"), "value"))).alias("_row"))
    rows = rows.select(*keys, F.col("iy").cast("int").alias("iy"), F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: F.coalesce(F.try_element_at("_row", i), F.lit(UNKNOWN))).alias("_row"))
    maps = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("iy", "_row"))).alias("_map"))
    blank = F.array_repeat(F.lit(UNKNOWN), width)
    data = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                                 lambda j: F.coalesce(F.try_element_at("_map", j), blank)))
    return frames.select(*keys).distinct().join(maps, keys, "left").select(*keys, data.alias("data"))
