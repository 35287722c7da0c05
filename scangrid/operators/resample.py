"""Bootstrap intervals over paired frames."""
from pyspark.sql import Column, DataFrame, functions as F

from .scale import exact_percentiles, with_rank

BLOCK = 16


PRIME = 2147483647


def _fifth(name) -> Column:
    """Fifth power modulo 2^31 - 1, a one-to-one map that no straight line survives."""
    x = F.col(name)
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME


def with_draw(df: DataFrame, draw, item, n: Column, out) -> DataFrame:
    """Adds ``out``: a repeatable pseudo-random position in [0, n) per draw and item.

    Every draw has straight-line coefficients of its own for the mixed items, so draws
    are not shifts of each other; two 31-bit values make positions for any n below 2^61.
    """
    d, i = F.col(draw).cast("long"), F.col(item).cast("long")
    mixed = df.withColumn("_i", (i % PRIME + F.floor(i / PRIME) * 69621 + 12345) % PRIME)
    for k, c in enumerate((104729, 7919, 15485863, 32452843)):
        mixed = mixed.withColumn(f"_d{k}", (d * c + c + k) % PRIME)
    mixed = mixed.select(*df.columns, *[_fifth(c).alias(c) for c in ("_i", "_d0", "_d1", "_d2", "_d3")])
    mixed = mixed.withColumn("_u", (F.col("_i") * F.col("_d0") + F.col("_d1")) % PRIME).withColumn(
        "_v", (F.col("_i") * F.col("_d2") + F.col("_d3")) % PRIME)
    mixed = mixed.withColumn("_u", _fifth("_u")).withColumn("_v", _fifth("_v"))
    return mixed.select(*df.columns, ((F.col("_u") * PRIME + F.col("_v")) % n).alias(out))


def _positions(deltas, keys, order, value, width):
    known = deltas.where(F.col(value).isNotNull())
    return with_rank(known.select(*keys, order, value), keys, [order],
                     F.floor(F.col(order) / width), "pos")


def _interval(draws, keys, source, value):
    ci = exact_percentiles(draws, keys, "mean", (0.025, 0.975), 0.001, names=["low", "high"])
    mean = source.groupBy(*keys).agg(F.avg(value).alias("delta"), F.count(F.lit(1)).alias("n"))
    return mean.join(ci, list(keys))


def block_bootstrap_ci(deltas: DataFrame, keys, order, value, draws=1000, width=1000) -> DataFrame:
    """Mean and 95 % interval from circular blocks of 16 consecutive frames.

    Each possible block is summed once; a draw then adds up n/16 block sums, so the
    work is draws x n/16, not draws x n.
    """
    keys = list(keys)
    rows = _positions(deltas, keys, order, value, width)
    n = F.col("pos_total")
    length = F.least(F.lit(BLOCK), n)
    blocks = F.ceil(n / length)
    tail = n - length * (blocks - 1)
    offset = F.explode(F.sequence(F.lit(0).cast("long"), length - 1))
    sums = (rows.withColumn("_o", offset)
            .withColumn("start", F.pmod(F.col("pos") - F.col("_o"), n))
            .groupBy(*keys, "start").agg(
                F.sum(value).alias("_full"), F.max(n).alias("_n"),
                F.sum(F.when(F.col("_o") < tail, F.col(value))).alias("_part")))
    size = rows.groupBy(*keys).agg(F.max("pos_total").alias("_n"))
    length = F.least(F.lit(BLOCK), F.col("_n"))
    plan = (size.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
            .withColumn("_last", F.ceil(F.col("_n") / length) - 1)
            .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last")))))
    plan = with_draw(plan, "draw", "block", F.col("_n"), "start")
    means = (plan.select(*keys, "draw", "block", "_last", "start").join(sums, [*keys, "start"])
             .groupBy(*keys, "draw").agg(
                 (F.sum(F.when(F.col("block") < F.col("_last"), F.col("_full"))
                        .otherwise(F.col("_part"))) / F.max("_n")).alias("mean")))
    return _interval(means, keys, rows, value)


def frame_bootstrap_ci(deltas: DataFrame, keys, order, value, draws=2000, width=1000) -> DataFrame:
    """Mean and 95 % interval from independently drawn frames."""
    keys = list(keys)
    rows = _positions(deltas, keys, order, value, width)
    picks = (rows.select(*keys, F.col("pos").alias("item"), F.col("pos_total").alias("_n"))
             .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))))
    picks = with_draw(picks, "draw", "item", F.col("_n"), "pos")
    # Picks of the same frame in one draw are counted before they meet its value.
    counted = picks.groupBy(*keys, "draw", "pos").agg(F.count(F.lit(1)).alias("_c"))
    means = counted.join(rows.select(*keys, "pos", value, "pos_total"), [*keys, "pos"]).groupBy(
        *keys, "draw").agg((F.sum(F.col("_c") * F.col(value)) / F.max("pos_total")).alias("mean"))
    return _interval(means, keys, rows, value)
