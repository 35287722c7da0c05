"""Segmentation losses used as evaluation metrics on prediction tables."""
from pyspark.sql import DataFrame, functions as F

from .scale import even_ranges, prefix_sums


def class_weights(preds: DataFrame, by=(), gamma=2.0, scale=2.0, delta=1.02) -> DataFrame:
    """Per class: share among labelled rows, focusing power, weight."""
    by = list(by)
    labelled = preds.where("truth < 4")
    n = labelled.groupBy(*by, "truth").agg(F.count(F.lit(1)).alias("n"))
    if by:
        total = n.groupBy(*by).agg(F.sum("n").alias("_total"))
        n = n.join(total, by)
    else:  # one row
        n = n.join(n.agg(F.sum("n").alias("_total")), how="cross")
    freq = F.col("n") / F.col("_total")
    return n.select(*by, "truth", freq.alias("freq"), (gamma + scale * (1 - freq)).alias("gamma"),
                    (1 / F.ln(delta + freq)).alias("omega"))


def ace_loss(preds: DataFrame, by=(), probs="probs") -> DataFrame:
    """Mean weighted focal cross entropy; the weight table has four rows per group."""
    by = list(by)
    p = F.element_at(probs, F.col("truth").cast("int") + 1)
    pt = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    rows = preds.where("truth < 4").withColumn("pt", pt).join(class_weights(preds, by),
                                                               [*by, "truth"])
    loss = -F.col("omega") * F.pow(1 - F.col("pt"), F.col("gamma")) * F.ln("pt")
    return rows.groupBy(*by).agg(F.avg(loss).alias("ace_loss"))


def lovasz_softmax(preds: DataFrame, by=(), probs="probs") -> DataFrame:
    """Lovasz extension of the Jaccard loss, averaged over the classes present.

    Errors are sorted per class in ranges of like size with prefix sums. Rows with the same
    error are counted together first: their joint contribution does not depend on
    their order, and a huge tie cannot form a hot range.
    """
    by = list(by)
    per_class = F.explode(F.array(*[F.struct(
        F.lit(c).alias("cls"), (F.col("truth") == c).cast("long").alias("fg"),
        F.abs((F.col("truth") == c).cast("double") - F.element_at(probs, c + 1)).alias("err"))
        for c in range(4)]))
    rows = preds.where("truth < 4").select(*by, per_class.alias("e")).select(*by, "e.*")
    ties = rows.groupBy(*by, "cls", "err").agg(
        F.sum("fg").alias("fg"), F.sum(1 - F.col("fg")).alias("bg"))
    ties = even_ranges(ties, [*by, "cls"], "err")
    run = prefix_sums(ties, [*by, "cls"], [F.desc("err")], -F.col("_range"), {"cum_fg": F.col("fg"), "cum_bg": F.col("bg")},
                      totals=True)
    total = F.col("cum_fg_total")

    def jaccard(fg, bg):
        return 1 - (total - fg) / (total + bg)
    before_fg, before_bg = F.col("cum_fg") - F.col("fg"), F.col("cum_bg") - F.col("bg")
    # The very first gradient entry is the Jaccard value itself, as before it is zero.
    gain = jaccard(F.col("cum_fg"), F.col("cum_bg")) - jaccard(before_fg, before_bg)
    per = run.where(total > 0).groupBy(*by, "cls").agg(F.sum(F.col("err") * gain).alias("_l"))
    return per.groupBy(*by).agg(F.avg("_l").alias("lovasz"))
