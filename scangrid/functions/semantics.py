"""Class, band and policy-test functions as Column expressions."""
import math

from pyspark.sql import Column, functions as F

from ..schema import BANDS_M, CHI2_99_DF3, INTERVAL_FRAMES, UNKNOWN_CLASS
from .geom import as_col


def argmax4(values, unknown=UNKNOWN_CLASS) -> Column:
    """Index of the largest of four values, first on ties; ``unknown`` if all are 0."""
    values = [as_col(v) for v in values]
    top = F.greatest(*values)
    pick = F.when(top <= 0, unknown)
    for index, value in enumerate(values):
        pick = pick.when(value == top, index)
    return pick


def semantic_split(counts, entropy_limit=0.18, contamination=0.05) -> Column:
    """Is a cell's class mixture too impure to stay one cell?

    Large cells: chi-square test against 95 % dominant / 5 % spread evenly.
    Small cells: normalised entropy.
    """
    counts = [as_col(c).cast("double") for c in counts]
    n = counts[0] + counts[1] + counts[2] + counts[3]
    # sum of -p ln p, written with one logarithm per class plus one for the total
    logs = sum((c * F.ln(F.greatest(c, F.lit(1.0))) for c in counts[1:]),
               counts[0] * F.ln(F.greatest(counts[0], F.lit(1.0))))
    safe = F.greatest(n, F.lit(1.0))
    entropy = F.ln(safe) - logs / safe
    top = F.greatest(*counts)
    rare, main = n * (contamination / 3), n * (1 - contamination)
    squares = sum((c * c for c in counts[1:]), counts[0] * counts[0]) - top * top
    statistic = ((squares - 2 * rare * (n - top)) / rare + 3 * rare
                 + (top - main) * (top - main) / main)
    return F.when(rare >= 5, (top < main) & (statistic > CHI2_99_DF3)).otherwise(
        entropy > entropy_limit * math.log(4))


def distance_band(r) -> Column:
    """Band number 0..3, NULL at 100 m and beyond."""
    r = as_col(r)
    out = F.when(F.lit(False), 0)
    for number, (lo, hi) in enumerate(BANDS_M):
        out = out.when((r >= lo) & (r < hi), number)
    return out


def is_obstacle(c) -> Column:
    return as_col(c).isin(2, 3)


def is_ground(c) -> Column:
    return as_col(c).isin(0, 1)


def clip_pred(c) -> Column:
    return F.least(as_col(c), F.lit(4))


def temporal_interval(frame) -> Column:
    return F.least(F.lit(9), F.floor(as_col(frame) * 10 / INTERVAL_FRAMES))


def scene_stratum(dynamic, static, terrain) -> Column:
    return (F.when(as_col(dynamic) > 0.12, "dense-object")
            .when(as_col(static) > 0.5, "structure-dominant")
            .when(as_col(terrain) > 0.3, "terrain-dominant")
            .otherwise("mixed-road"))


def softmax(logits) -> Column:
    logits = as_col(logits)
    top = F.array_max(logits)
    exps = F.transform(logits, lambda v: F.exp(v - top))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(exps, lambda v: v / total)


def predicted_class(probs) -> Column:
    """First index of the top probability; 255 if the top probability is 0."""
    probs = as_col(probs)
    top = F.array_max(probs)
    return F.when(top == 0, UNKNOWN_CLASS).otherwise(F.array_position(probs, top).cast("int") - 1)
