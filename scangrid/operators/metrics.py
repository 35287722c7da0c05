"""Confusion matrices, scores, error statistics and distributions."""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.geom import as_col
from ..functions.semantics import clip_pred
from .scale import exact_percentiles, null_safe_join


def confusion(df: DataFrame, by=(), truth="truth", pred="pred", weight=None) -> DataFrame:
    """Counts per (truth, pred); unknown predictions fall in column 4, unlabelled rows drop."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return (df.where(as_col(truth) < 4)
            .groupBy(*by, as_col(truth).alias("truth"), clip_pred(pred).alias("pred"))
            .agg(n.alias("n")))


def dense_confusion(counts: DataFrame, by=()) -> DataFrame:
    """All 20 entries per group, zeros included."""
    cells = F.array(*[F.struct(F.lit(t).alias("truth"), F.lit(p).alias("pred"),
                               F.coalesce(F.col(f"c{t}{p}"), F.lit(0)).alias("n"))
                      for t in range(4) for p in range(5)])
    return _wide(counts, by).select(*by, F.inline(cells))


def _wide(counts: DataFrame, by) -> DataFrame:
    return counts.groupBy(*by).agg(*wide_sums())


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def mean_known(values) -> Column:
    """Mean of the values that are not NULL."""
    known = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    return F.when(known > 0, total / known)


def scores(counts: DataFrame, by=(), unknown_column=True) -> DataFrame:
    """Per class IoU, precision, recall and F1; accuracy, mean IoU, labelled points.

    With ``unknown_column`` off, predictions outside the four classes are ignored.
    """
    return wide_scores(_wide(counts, by), by, unknown_column)


def wide_sums() -> list[Column]:
    """The 20 sums of a confusion matrix, from ``truth``, ``pred`` and ``n``."""
    return [F.sum(F.when((F.col("truth") == t) & (F.col("pred") == p), F.col("n")).otherwise(0))
            .alias(f"c{t}{p}") for t in range(4) for p in range(5)]


def wide_scores(wide: DataFrame, by, unknown_column=True) -> DataFrame:
    """Scores of matrices that lie in the columns c00 .. c34."""
    width = 5 if unknown_column else 4
    c = [[F.col(f"c{t}{p}") for p in range(width)] for t in range(4)]
    rows = [sum(c[t][1:], c[t][0]) for t in range(4)]
    cols = [sum((c[t][p] for t in range(1, 4)), c[0][p]) for p in range(4)]
    diag = [c[k][k] for k in range(4)]
    total = sum(rows[1:], rows[0])
    out, ious = [], []
    for k in range(4):
        iou = ratio(diag[k], rows[k] + cols[k] - diag[k])
        p, r = ratio(diag[k], cols[k]), ratio(diag[k], rows[k])
        f1 = F.when((p == 0) | (r == 0), 0.0).otherwise(2 * p * r / (p + r))
        ious.append(iou)
        out += [iou.alias(f"iou_{k}"), p.alias(f"precision_{k}"), r.alias(f"recall_{k}"),
                f1.alias(f"f1_{k}")]
    right = sum(diag[1:], diag[0])
    return wide.select(
        *by, *out, ratio(right, total).alias("accuracy"), mean_known(ious).alias("miou"),
        total.alias("labelled"))


def distribution(df: DataFrame, by, value) -> DataFrame:
    """Count, mean and exact p50/p95/p99 of the finite values per group.

    A group without finite values has a count of zero and no figures.
    """
    from ..functions.geom import is_finite
    value = as_col(value)
    known = F.when(is_finite(value), value)
    base = df.groupBy(*by).agg(F.count(known).alias("n"), F.avg(known).alias("mean"))
    tails = exact_percentiles(df, by, value, (0.5, 0.95, 0.99))
    if not by:
        return base.join(tails, how="left")  # single rows
    return null_safe_join(base, tails, by, "left")


def error_stats(df: DataFrame, by, error, prefix="") -> DataFrame:
    """Mean absolute error, root mean square error and exact p95 of the absolute error."""
    e = as_col(error)
    base = df.where(e.isNotNull()).groupBy(*by).agg(
        F.avg(F.abs(e)).alias(f"{prefix}mae"), F.sqrt(F.avg(e * e)).alias(f"{prefix}rmse"))
    tail = exact_percentiles(df, by, F.abs(e), (0.95,), names=[f"{prefix}p95"])
    return null_safe_join(base, tail, by)


def class_share(df: DataFrame, by, cls="pred", conf="conf") -> DataFrame:
    """Share and mean confidence of each of the four classes; NULL mean if absent."""
    cls, conf = as_col(cls), as_col(conf)
    aggs = [F.count(F.lit(1)).alias("n")]
    for k in range(4):
        aggs += [F.count_if(cls == k).alias(f"n{k}"), F.avg(F.when(cls == k, conf)).alias(f"m{k}")]
    rows = F.array(*[F.struct(F.lit(k).alias("class"),
                              (F.col(f"n{k}") / F.col("n")).alias("share"),
                              F.col(f"m{k}").alias("confidence")) for k in range(4)])
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(rows))


def paired_delta(df: DataFrame, pair_keys, side, a, b, metrics) -> DataFrame:
    """Metric of side ``b`` minus side ``a`` for every key that has both."""
    side = as_col(side)
    aggs = [F.max(F.when(side == s, F.lit(1))).alias(f"_has_{n}") for n, s in (("a", a), ("b", b))]
    for m in metrics:
        aggs.append((F.max(F.when(side == b, F.col(m))) - F.max(F.when(side == a, F.col(m))))
                    .alias(f"delta_{m}"))
    return (df.groupBy(*pair_keys).agg(*aggs)
            .where(F.col("_has_a").isNotNull() & F.col("_has_b").isNotNull())
            .drop("_has_a", "_has_b"))


def best_so_far(curve: DataFrame, keys, order, value) -> DataFrame:
    """Running best, whether this row improved it strictly, and rows since the last gain.

    A curve is one training run, a row per epoch, so a window per run is small.
    """
    w = W.partitionBy(*keys).orderBy(order)
    before = F.max(value).over(w.rowsBetween(W.unboundedPreceding, -1))
    improved = before.isNull() | (F.col(value) > before)
    out = curve.withColumn("improved", improved)
    last = F.max(F.when(F.col("improved"), F.col("_pos"))).over(
        w.rowsBetween(W.unboundedPreceding, 0))
    return (out.withColumn("_pos", F.row_number().over(w))
            .withColumn("best", F.max(value).over(w.rowsBetween(W.unboundedPreceding, 0)))
            .withColumn("bad_epochs", F.col("_pos") - last).drop("_pos"))


def next_epoch_index(history: DataFrame, checkpoints: DataFrame, keys) -> DataFrame:
    """First free epoch base: the larger of the last logged and the checkpoint epoch."""
    logged = history.groupBy(*keys).agg(F.max("epoch").alias("_logged"))
    return (checkpoints.join(logged, list(keys), "left")
            .select(*keys, F.greatest("epoch", F.coalesce("_logged", F.lit(0)))
                    .alias("next_epoch")))


def recommend_profile(profiles: DataFrame, by=(), reference="reference") -> DataFrame:
    """Fastest profile within 0.01 mean IoU and 0.01 near recall of the reference."""
    ref = profiles.where(F.col("profile") == reference).select(
        *by, F.col("miou").alias("_miou"),
        *[F.col(f"near_recall_{k}").alias(f"_recall_{k}") for k in range(4)])
    joined = profiles.join(ref, list(by)) if by else profiles.join(F.broadcast(ref.limit(1)),
                                                                  how="cross")
    ok = F.col("miou") - F.col("_miou") >= -0.01
    for k in range(4):
        ok = ok & (F.col(f"near_recall_{k}") >= F.col(f"_recall_{k}") - 0.01)
    return joined.where(ok).groupBy(*by).agg(
        F.max_by("profile", F.struct("fps", "profile")).alias("recommended"),
        F.max("fps").alias("fps"))
