"""Ground plane per frame by repeatable random consensus."""
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import geom as G
from ..session import cut_lineage
from .scale import prefix_sums, small
from .spatial import XYZ

GOLDEN = 0.6180339887498949


def shuffle_key(salt=0, column="point_id"):
    """Repeatable pseudo-random order in [0, 1000003) for ids, by modular arithmetic."""
    return ((F.col(column) % 1000003 + 1000003 + salt) % 1000003 * 7919) % 1000003


def lsq_plane(points: DataFrame, keys) -> DataFrame:
    """Least-squares z = a x + b y + c per key, from centred sums."""
    s = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.avg("z").alias("mz"), F.var_pop("x").alias("sxx"), F.var_pop("y").alias("syy"),
        F.covar_pop("x", "y").alias("sxy"), F.covar_pop("x", "z").alias("sxz"),
        F.covar_pop("y", "z").alias("syz"))
    fit = _fitted(*[F.col(c) for c in ("n", "mx", "my", "mz", "sxx", "syy", "sxy", "sxz", "syz")])
    return s.select(*keys, "n", *[f.alias(v) for f, v in zip(fit, "abc")])


#: Height of a histogram bin; only the bin with the wanted rank is looked at more closely.
BIN_M = 0.05
#: Each slot gives its first and its last low return by shuffled order as corners of planes.
SLOTS = 120
ORDER = 1 << 43


#: Sums that the least-squares fit needs, in the order of ``_fitted``.
SUMS = (("x", ""), ("y", ""), ("z", ""), ("x", "x"), ("y", "y"), ("x", "y"), ("x", "z"), ("y", "z"))


def _usable():
    return G.is_finite("x") & G.is_finite("y") & G.is_finite("z")


def _value_at(counted: DataFrame, keys, name) -> DataFrame:
    """Interpolated value at rank ``_pos`` of counted values ``(keys, _v, _n, _pos)``."""
    ranked = prefix_sums(counted, keys, ["_v"], F.floor(F.col("_v") / BIN_M * 64), {"_end": F.col("_n")})
    lo, hi = F.floor("_pos"), F.ceil("_pos")

    def at(rank):
        return F.max(F.when((rank >= F.col("_end") - F.col("_n")) & (rank < F.col("_end")), F.col("_v")))
    found = ranked.groupBy(*keys).agg(at(lo).alias("_lo"), at(hi).alias("_hi"), F.max("_pos").alias("_pos"))
    return found.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo"))
                                * (F.col("_pos") - F.floor("_pos"))).alias(name))


def _fitted(n, mx, my, mz, sxx, syy, sxy, sxz, syz):
    """Least-squares a, b, c from centred sums; null where they do not fix a plane."""
    det = sxx * syy - sxy * sxy
    a = F.when(F.abs(det) > 1e-12, (sxz * syy - syz * sxy) / det)
    b = F.when(F.abs(det) > 1e-12, (syz * sxx - sxz * sxy) / det)
    return a, b, mz - a * mx - b * my


def height_ranks(points: DataFrame, keys, quantile=0.35) -> DataFrame:
    """Per frame, from one histogram: which returns count, and the bins around a quantile of height.

    ``_wide``: fewer than ten returns lie within 35 m, so all count. ``_from``, ``_to``:
    bins of the wanted ranks; ``_pos``: the rank, counted from the first return in ``_from``.
    """
    near = G.radius() < 35
    bins = points.select(*keys, near.alias("_near"), F.when(
        _usable(), F.floor(F.col("z") / BIN_M)).alias("_bin")).groupBy(
        *keys, "_near", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    frame = W.partitionBy(*keys)
    known = F.when(F.col("_bin").isNotNull(), F.col("_n")).otherwise(0)
    bins = bins.withColumn("_wide", F.sum(F.when(F.col("_near"), known).otherwise(0)).over(frame) < 10)
    bins = bins.withColumn("_n", F.when(F.col("_wide") | F.col("_near"), known).otherwise(0))
    up_to = frame.orderBy("_bin").rangeBetween(W.unboundedPreceding, 0)
    bins = bins.withColumn("_end", F.sum("_n").over(up_to)).withColumn(
        "_pos", (F.sum("_n").over(frame) - 1) * float(quantile))

    def first(rank, column):
        return F.min(F.when((F.col("_n") > 0) & (F.col("_end") > rank), column))
    out = bins.groupBy(*keys).agg(
        F.max("_wide").alias("_wide"), first(F.floor("_pos"), F.col("_bin")).alias("_from"),
        first(F.ceil("_pos"), F.col("_bin")).alias("_to"),
        F.coalesce(F.max(F.when(F.col("_end") <= F.floor("_pos"), F.col("_end"))), F.lit(0)).alias("_base"),
        F.max("_pos").alias("_pos"))
    return out.withColumn("_pos", F.col("_pos") - F.col("_base")).drop("_base")


def candidate_planes(points: DataFrame, ranks: DataFrame, keys, triples, max_slope) -> DataFrame:
    """``_cut``, ``_low`` (returns up to it) and ``_planes`` (array of t, a, b, c) per frame, in one scan.

    Returns below the cut's bin are low for certain; those in its bin are counted by value.
    Both keep the corners of each slot.
    """
    h = shuffle_key()
    bin_ = F.floor(F.col("z") / BIN_M)
    order = h * ORDER + F.pmod("point_id", F.lit(ORDER))
    rows = (points.select(*keys, "point_id", *XYZ).join(small(ranks.where("_from is not null")), keys)
            .where((F.col("_wide") | (G.radius() < 35)) & _usable() & (bin_ <= F.col("_to")))
            .select(*keys, "_pos", F.when(bin_ >= F.col("_from"), F.col("z")).alias("_v"),
                    (h % SLOTS).alias("_slot"), order.alias("_key"), *XYZ))
    ends = [F.min("_key").alias("_k0"), F.max("_key").alias("_k1")]
    ends += [pick(F.col(d), F.col("_key")).alias(f"{d}{i}") for i, pick in enumerate((F.min_by, F.max_by)) for d in XYZ]
    rows = cut_lineage(rows.groupBy(*keys, "_v", "_slot", "_pos").agg(F.count(F.lit(1)).alias("_n"), *ends))
    cut = _value_at(rows.where("_v is not null").groupBy(*keys, "_v", "_pos").agg(F.sum("_n").alias("_n")),
                    keys, "_cut")
    again = [F.sum("_n").alias("_n"), F.min("_k0").alias("_k0"), F.max("_k1").alias("_k1")]
    again += [pick(F.col(f"{d}{i}"), F.col(f"_k{i}")).alias(f"{d}{i}")
              for i, pick in enumerate((F.min_by, F.max_by)) for d in XYZ]
    slots = rows.join(cut, keys).where("_v is null or _v <= _cut").groupBy(*keys, "_cut", "_slot").agg(*again)

    def corner(i):
        return F.struct(F.col("_slot"), F.col(f"_k{i}").alias("_key"), *[F.col(f"{d}{i}").alias(d) for d in XYZ])
    corners = F.when(F.col("_k0") == F.col("_k1"), F.array(corner(0))).otherwise(F.array(corner(0), corner(1)))
    frames = slots.groupBy(*keys, "_cut").agg(
        F.sum("_n").alias("_low"), F.array_sort(F.flatten(F.collect_list(corners))).alias("_at"))
    turn = "(t * 3 + {c} + 1) * " + repr(GOLDEN) + "D"
    pick = ", ".join(f"_at[int(size(_at) * ({turn.format(c=c)} - floor({turn.format(c=c)})))] as p{c}" for c in range(3))
    parts = [
        f"transform(sequence(0, {triples - 1}), t -> struct(t, {pick}))",
        """transform(_planes, q -> struct(q.t, q.p0, q.p1.x - q.p0.x as dx1, q.p2.x - q.p0.x as dx2, q.p1.y - q.p0.y as dy1,
           q.p2.y - q.p0.y as dy2, q.p1.z - q.p0.z as dz1, q.p2.z - q.p0.z as dz2))""",
        "filter(_planes, q -> abs(q.dx1 * q.dy2 - q.dx2 * q.dy1) >= 1e-5D)",
        """transform(_planes, q -> struct(q.t, q.p0, (q.dz1 * q.dy2 - q.dz2 * q.dy1) / (q.dx1 * q.dy2 - q.dx2 * q.dy1) as a,
           (q.dx1 * q.dz2 - q.dx2 * q.dz1) / (q.dx1 * q.dy2 - q.dx2 * q.dy1) as b))""",
        f"filter(_planes, q -> sqrt(q.a * q.a + q.b * q.b) <= {float(max_slope)}D)",
        "transform(_planes, q -> struct(q.t, q.a, q.b, q.p0.z - q.a * q.p0.x - q.b * q.p0.y as c))"]
    for part in parts:
        frames = frames.withColumn("_planes", F.expr(part))
    return frames.select(*keys, "_cut", "_low", "_planes")


def ground_plane(points: DataFrame, keys=("sequence", "frame_id"), triples=40, tolerance=0.12,
                 max_slope=0.35) -> DataFrame:
    """Plane (a, b, c) and ``valid`` per frame, voted for by all low returns, in three scans.

    The first scan makes a histogram of heights; the second finds the cut below which
    returns are low and the corners of candidate planes; the third gives every candidate its
    votes together with the sums of the least-squares fit over the voters. Each scan leaves its
    sums in the checkpoint folder, so none is made twice. A frame whose candidates all fail
    gets its median low height; one with fewer than three low returns gets zeros.
    Returns that are not finite take no part.
    """
    keys = list(keys)
    ranks = cut_lineage(height_ranks(points, keys))
    frames = cut_lineage(candidate_planes(points, ranks, keys, triples, max_slope))
    low = (points.select(*keys, *XYZ).join(small(ranks.select(*keys, "_wide")), keys)
           .where((F.col("_wide") | (G.radius() < 35)) & _usable())
           .join(small(frames.where("_low >= 3")), keys).where("z <= _cut"))
    p = F.col("_p")
    off = F.abs(F.col("z") - (p["a"] * F.col("x") + p["b"] * F.col("y") + p["c"]))
    voted = low.select(*keys, *XYZ, "_low", F.explode_outer("_planes").alias("_p")).where(
        p.isNull() | (off < tolerance))
    votes = cut_lineage(voted.groupBy(*keys, "_low", p["t"].alias("_t"), F.when(p.isNull(), F.col("z")).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.max(p[v]).alias(v) for v in "abc"],
        *[F.sum(F.col(a) * F.col(b) if b else F.col(a)).alias(f"_s{a}{b}") for a, b in SUMS]))
    rank = F.col("_n") * 1024 + (1023 - F.col("_t"))  # most votes, then the earliest
    fields = ["_n", "a", "b", "c", *[f"_s{a}{b}" for a, b in SUMS]]
    best = votes.where("_t is not null").groupBy(*keys).agg(*[F.max_by(f, rank).alias(f) for f in fields])
    mean = {d: F.col(f"_s{d}") / F.col("_n") for d in XYZ}
    fit = _fitted("_n", *mean.values(), *[F.col(f"_s{a}{b}") / F.col("_n") - mean[a] * mean[b] for a, b in SUMS[3:]])
    best = best.select(*keys, "_n", *[F.coalesce(f, F.col(v)).alias(v) for f, v in zip(fit, "abc")])
    median = _value_at(votes.where("_t is null").select(
        *keys, "_v", "_n", ((F.col("_low") - 1) * 0.5).alias("_pos")), keys, "_median")
    out = ranks.select(*keys).join(best, keys, "left").join(median, keys, "left")
    return out.select(
        *keys, F.coalesce("a", F.lit(0.0)).alias("plane_a"), F.coalesce("b", F.lit(0.0)).alias("plane_b"),
        F.coalesce("c", "_median", F.lit(0.0)).alias("plane_c"),
        F.coalesce(F.col("_n") >= 3, F.lit(False)).alias("valid"))


def with_height(points: DataFrame, planes: DataFrame, keys=("sequence", "frame_id")) -> DataFrame:
    """Height above the frame's plane (zero where there is none)."""
    flat = ((F.col("plane_a") == 0) & (F.col("plane_b") == 0) & (F.col("plane_c") == 0)
            & ~F.col("valid"))
    height = G.height_above_plane("x", "y", "z", "plane_a", "plane_b", "plane_c")
    return points.join(planes, list(keys)).withColumn(
        "height", F.when(flat, 0.0).otherwise(height)).drop(
        "plane_a", "plane_b", "plane_c", "valid")
