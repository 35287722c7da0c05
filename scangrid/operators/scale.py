"""Building blocks that keep ordered operations distributed.

A plain window over a frame, class or whole table puts that whole group in one
task. The helpers here split each group into value ranges first: range totals
are summed in a small window, then each range is processed on its own.
"""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.geom import is_finite


#: Tables of up to this many rows may go to every executor.
SMALL_ROWS = 20_000


def small(df: DataFrame, rows=SMALL_ROWS) -> DataFrame:
    """Mark a written or checkpointed table for broadcast if its counted size allows it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def prefix_sums(df: DataFrame, keys, order, bucket: Column, sums: dict,
                totals=False) -> DataFrame:
    """Running inclusive sums per key in a given order.

    ``bucket`` must be a non-decreasing function of the order; it decides how
    finely a hot key is split. With ``totals`` also adds ``<name>_total``.
    """
    keys = list(keys)
    tagged = df.withColumn("_bucket", bucket)
    for name, expr in sums.items():
        tagged = tagged.withColumn(f"_m_{name}", expr)
    across = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    base = tagged.groupBy(*keys, "_bucket").agg(
        *[F.sum(f"_m_{n}").alias(f"_s_{n}") for n in sums])
    base = base.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(f"_s_{n}").over(across), F.lit(0)).alias(f"_b_{n}") for n in sums],
        *[F.sum(f"_s_{n}").over(whole).alias(f"{n}_total") for n in sums if totals])
    within = (W.partitionBy(*keys, "_bucket").orderBy(*order)
              .rowsBetween(W.unboundedPreceding, 0))
    joined = tagged.join(base, [*keys, "_bucket"])
    for name in sums:
        joined = joined.withColumn(
            name, F.col(f"_b_{name}") + F.sum(f"_m_{name}").over(within))
    return joined.drop("_bucket", *[f"_m_{n}" for n in sums], *[f"_b_{n}" for n in sums])


def with_rank(df: DataFrame, keys, order, bucket: Column, name="rank") -> DataFrame:
    """Zero-based dense position per key (``name``) and the group size (``name_total``)."""
    out = prefix_sums(df, keys, order, bucket, {name: F.lit(1)}, totals=True)
    return out.withColumn(name, F.col(name) - 1)


def evenly_spaced(df: DataFrame, keys, order, bucket: Column, n: int) -> DataFrame:
    """Keep ``n`` rows per key at equally spaced positions, first and last included.

    Positions are the truncated values of a linear ramp from 0 to N-1.
    """
    ranked = with_rank(df, keys, order, bucket, "_r")
    total, r = F.col("_r_total"), F.col("_r")
    k = F.least(F.lit(n), total)
    step = (total - 1) / F.when(k > 1, k - 1).otherwise(1)
    guess = F.when(step > 0, F.floor(r / step)).otherwise(0)
    hit = F.lit(False)
    for shift in (0, 1):
        i = guess + shift
        hit = hit | ((i < k - 1) & (F.floor(i * step) == r))
    hit = hit | ((k > 1) & (r == total - 1)) | ((k == 1) & (r == 0))
    return ranked.where(hit).drop("_r", "_r_total")


def first_n(df: DataFrame, keys, order, bucket: Column, n, name="rank") -> DataFrame:
    """The first ``n`` rows per key in order; ranges past the n-th row are never sorted."""
    keys = list(keys)
    tagged = df.withColumn("_bucket", bucket)
    across = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    base = (tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
            .select(*keys, "_bucket",
                    F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_base"))
            .where(F.col("_base") < n))
    within = W.partitionBy(*keys, "_bucket").orderBy(*order)
    out = tagged.join(base, [*keys, "_bucket"]).withColumn(
        name, F.col("_base") + F.row_number().over(within) - 1)
    return out.where(F.col(name) < n).drop("_bucket", "_base")


def null_safe_join(left: DataFrame, right: DataFrame, keys, how="inner") -> DataFrame:
    """Join on keys of which nulls equal each other; the keys come from ``left``."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                         *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(named, same, how).drop(*[f"_r_{k}" for k in keys])


#: Ranges of a group, and the accuracy of the splitters: no range holds more than about
#: 1/RANGES + 2/ACCURACY of the group's rows, unless they are equal.
RANGES, ACCURACY = 128, 2000


def even_ranges(df: DataFrame, keys, value: str, name="_range", ranges=RANGES) -> DataFrame:
    """Add the number of a value range of the row's group; ranges hold like numbers of rows.

    The splitters are approximate quantiles, a bounded sketch per group that tasks merge.
    A range's number does not decrease with the value.
    """
    keys = list(keys)
    at = [i / ranges for i in range(1, ranges)]
    splits = df.groupBy(*keys).agg(F.percentile_approx(value, at, ACCURACY).alias("_splits"))
    below = F.size(F.filter("_splits", lambda s: s < F.col(value)))
    return null_safe_join(df, splits, keys).withColumn(name, F.coalesce(below, F.lit(0))).drop("_splits")


def exact_percentiles(df: DataFrame, keys, value, probs, width=None, names=None,
                      count_name=None) -> DataFrame:
    """Exact linearly interpolated percentiles per key, without holding a group.

    Equal values are counted first, the counts are summed in value ranges, and only the
    ranges holding a wanted position are sorted. Ranges hold about as many distinct values
    each, whatever their distribution; a caller who knows that values are spread out may
    give a ``width`` instead, which saves the splitters. Groups without a finite value
    have no row.
    """
    keys = list(keys)
    names = names or [f"p{round(p * 100)}" for p in probs]
    source = df if keys else df.withColumn("_all", F.lit(1))
    by = keys or ["_all"]
    value = F.col(value) if isinstance(value, str) else value
    counted = (source.select(*by, value.cast("double").alias("_v")).where(is_finite("_v"))
               .groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c")))
    if width is None:
        counted = even_ranges(counted, by, "_v", "_bin")
    else:
        counted = counted.withColumn("_bin", F.floor(F.col("_v") / width))
    bins = counted.groupBy(*by, "_bin").agg(F.sum("_c").alias("_n"))
    across = W.partitionBy(*by).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.select(*by, "_bin", "_n",
                       F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_base"),
                       F.sum("_n").over(W.partitionBy(*by)).alias("_total"))
    wanted = F.lit(False)
    ranks = []
    for p in probs:
        pos = (F.col("_total") - 1) * float(p)
        lo, hi = F.floor(pos), F.ceil(pos)
        ranks.append((pos, lo, hi))
        for rank in (lo, hi):
            wanted = wanted | ((rank >= F.col("_base")) & (rank < F.col("_base") + F.col("_n")))
    chosen = bins.where(wanted).drop("_n")
    within = (W.partitionBy(*by, "_bin").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    ordered = (null_safe_join(counted, chosen, [*by, "_bin"])
               .withColumn("_end", F.col("_base") + F.sum("_c").over(within))
               .withColumn("_start", F.col("_end") - F.col("_c")))
    aggs = [F.max("_total").alias("_total")]
    for i, (_, lo, hi) in enumerate(ranks):
        for side, rank in (("lo", lo), ("hi", hi)):
            inside = (rank >= F.col("_start")) & (rank < F.col("_end"))
            aggs.append(F.max(F.when(inside, F.col("_v"))).alias(f"_{side}{i}"))
    found = ordered.groupBy(*by).agg(*aggs)
    outs = [(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (pos - lo)).alias(name)
            for i, ((pos, lo, _), name) in enumerate(zip(ranks, names))]
    if count_name:
        outs.append(F.col("_total").alias(count_name))
    return found.select(*keys, *outs)
