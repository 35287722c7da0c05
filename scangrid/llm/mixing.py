"""Mixing domains to target weights by soft membership.

A classifier trained on labelled rows predicts how far each document belongs to each
domain. Nonnegative document rates are then fitted so that the expected tokens per domain,
sum(rate * tokens * posterior), match the targets: least squares with each residual divided by
the domain's own tokens, plus ``RIDGE`` times the tokens' squared change of rate, which picks the
smallest change among fits that are equally near. The optimum has the form
rate = max(least, 1 + posterior . dual) with one dual value per domain, found by Newton steps that
end when the optimality condition holds. A step needs one distributed sum; a document's rate
follows from its posteriors, so no state per document is kept, joined or shuffled.

The classifier is fitted on at most ``LABELLED`` rows of the labelled table, by smallest hash of
the id; posteriors, token counts and all sums cover every document. Tokens are words between
white space.

Defined cases: null and empty texts have no tokens and keep rate one; rows without a domain do
not train; a target for a domain that no training row has cannot be met and is left out;
domains without a target get weight zero; repeated rows get the same rate; without training
rows every rate is one.
"""
from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from .common import Scratch, table, vectors
from .features import DIMS, Extractor, Sparse, fit_linear, softmax, sparse_arrays, sparse_rows

LABELLED, STEPS, TOLERANCE = 2000, 60, 1e-5
#: Weight of the change of rates, and the largest violation of optimality as a share of the budget.
RIDGE, OPTIMAL = 1e-6, 1e-8
#: Sharpness of the posteriors is chosen among these on rows kept apart.
SHARPNESS = (1, 2, 4, 8, 16)
TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15}


def _extract(batches):
    get = Extractor(shapes=False)
    for b in batches:
        index, value = sparse_arrays([get(t) for t in b.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([b.column(0), index, value], names=["domain", "index", "value"])


def fit_domains(docs: DataFrame, labels: DataFrame, domain: str):
    """Domain names and weights of the classifier, or no names without training rows."""
    known = labels.select("doc_id").where("doc_id is not null").distinct().orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    got = (docs.where(F.col(domain).isNotNull()).join(F.broadcast(known), "doc_id")
           .select(F.col(domain).cast("string").alias("domain"), "text")
           .orderBy(F.xxhash64("text"), "domain").limit(LABELLED)
           .mapInArrow(_extract, "domain string, index array<int>, value array<float>").toArrow())
    said = np.array(got["domain"].to_pylist(), object)
    names = sorted(set(said))
    if not names:
        return [], None
    rows = sparse_rows(got["index"], got["value"])
    target = np.array([[float(d == n) for n in names] for d in said])
    apart = np.arange(len(rows)) % 5 == 4
    if len(names) == 1 or not apart.any() or apart.all():
        return names, np.zeros((DIMS, len(names)))
    w = fit_linear(Sparse([rows[i] for i in np.flatnonzero(~apart)]), target[~apart], rounds=40)
    held = Sparse([rows[i] for i in np.flatnonzero(apart)]).dot(w)
    loss = [-(np.log(softmax(held * s) + 1e-12) * target[apart]).sum() for s in SHARPNESS]
    return names, w * SHARPNESS[int(np.argmin(loss))]


def with_posteriors(docs: DataFrame, weights: np.ndarray, text="text") -> DataFrame:
    """``docs`` with ``_tokens`` and the array ``_posterior``; ``text`` may be a field of a struct, ``doc.text``."""
    outer, *inner = text.split(".")
    at, names = docs.columns.index(outer), docs.columns

    def run(batches):
        get = Extractor(shapes=False)
        for whole in batches:
            for start in range(0, max(1, len(whole)), 512):
                b = whole.slice(start, 512)
                column = b.column(at)
                for field in inner:
                    column = column.field(field)
                texts = column.to_pylist()
                p = softmax(Sparse([get(t) for t in texts]).dot(weights)) if texts else np.empty((0, 1))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array([len((t or "").split()) for t in texts], pa.int64()),
                     pa.array(list(p), pa.list_(pa.float64()))], names=[*names, "_tokens", "_posterior"])
    schema = StructType([*docs.schema.fields]).add("_tokens", LongType()).add(
        "_posterior", ArrayType(DoubleType()))
    return docs.mapInArrow(run, schema)


def rate_of(residuals, least=0.0):
    """Column: the rate after the given residual vectors, never under ``least``."""
    rate = F.lit(1.0)
    if residuals:
        steps = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in residuals])
        dot = lambda r: F.aggregate(F.zip_with("_posterior", r, lambda a, b: a * b), F.lit(0.0),
                                    lambda s, x: s + x)
        rate = F.aggregate(steps, rate, lambda now, r: F.greatest(F.lit(least), now - dot(r)))
    return F.when(F.col("_tokens") > 0, rate).otherwise(1.0)


def _goal(have, names, targets: dict, budget):
    """Tokens wanted per domain, or None if no target can be aimed at."""
    wish = np.array([float(targets.get(n, 0.0)) for n in names]) * (have > 0)
    if not wish.sum() or not have.sum():
        return None
    wish = wish / wish.sum()
    if budget is None:
        budget = have.sum()
    elif budget == "keep":
        budget = (have[wish > 0] / wish[wish > 0]).max()
    return wish * budget


def fit_rates(scored: DataFrame, names, targets: dict, budget=None, steps=STEPS):
    """Residual vectors of at most ``steps`` plain projected gradient steps, and the totals reached.

    It does not reach the optimum; the operators use ``best_rates``.
    """
    least = 1.0 if budget == "keep" else 0.0

    def totals(residuals):
        # Few numbers: one sum per domain.
        mass = F.col("_tokens") * rate_of(residuals, least)
        row = scored.agg(*[F.sum(mass * F.col("_posterior")[i]) for i in range(len(names))]).collect()[0]
        return np.array([x or 0.0 for x in row])
    have = totals([])
    goal = _goal(have, names, targets, budget)
    if goal is None:
        return [], have
    residuals, got, budget = [], have, goal.sum()
    for _ in range(steps):
        left = np.divide(got - goal, have, out=np.zeros_like(have), where=have > 0)
        if np.abs(got - goal).max() <= TOLERANCE * budget:
            break
        residuals.append(left)
        before, got = got, totals(residuals)
        if np.abs(got - before).max() <= TOLERANCE * budget:  # as near as nonnegative rates come
            break
    return residuals, got


def _sums(scored: DataFrame, duals: np.ndarray, least: float) -> list:
    """For each row of ``duals``: potential, domain totals and their derivatives, in one pass."""
    n, k = duals.shape

    def run(batches):
        out = np.zeros((n, 1 + k + k * k))
        for b in batches:
            t = b.column(0).to_numpy(zero_copy_only=False).astype(float)
            p, some = vectors(b.column(1)).reshape(len(t), -1), t > 0
            t, p = t[some], p[some]
            for i, z in enumerate(1 + duals @ p.T):
                free = z >= least  # at the bound too, else no rate could leave it
                rate = np.where(free, z, least)
                out[i, 0] += t @ np.where(free, z * z / 2, least * z - least * least / 2)
                out[i, 1:1 + k] += (t * rate) @ p
                out[i, 1 + k:] += ((p * (t * free)[:, None]).T @ p).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], names=["at", "x"])
    sums = np.zeros(n * (1 + k + k * k))
    # Fixed size: one row per number, however many documents or partitions there are.
    for r in (scored.select("_tokens", "_posterior").mapInArrow(run, "at long, x double")
              .groupBy("at").agg(F.sum("x").alias("x")).collect()):
        sums[r["at"]] = r["x"]
    return [(s[0], s[1:1 + k], s[1 + k:].reshape(k, k)) for s in sums.reshape(n, -1)]


def best_rates(scored: DataFrame, names, targets: dict, budget=None):
    """One residual vector that gives every document's rate by ``rate_of``, and the totals reached.

    ``budget``: tokens wanted in all; None: as many as there are; "keep": the least with
    which no domain has to lose tokens, with no rate under one.
    """
    least, k = 1.0 if budget == "keep" else 0.0, len(names)
    have = _sums(scored, np.zeros((1, k)), 0.0)[0][1]
    goal = _goal(have, names, targets, budget)
    if goal is None:
        return [], have
    scale = np.where(have > 0, have, 1.0)

    def state(duals):
        """Dual, value to minimise, its gradient, the totals and their derivatives."""
        return [(d, v - goal @ d + RIDGE / 2 * (scale * d) @ d, got - goal + RIDGE * scale * d, got, slope)
                for d, (v, got, slope) in zip(duals, _sums(scored, duals, least))]
    now = state(np.zeros((1, k)))[0]
    while np.abs(now[2]).max() > OPTIMAL * goal.sum():
        dual, value, gradient, _, slope = now
        root = 1 / np.sqrt(scale)
        step = -root * np.linalg.solve(root[:, None] * slope * root + RIDGE * np.eye(k), root * gradient)
        for part in np.split(0.5 ** np.arange(48.0), 3):
            tried = state(dual + part[:, None] * step)
            better = [s for a, s in zip(part, tried) if s[1] <= value + 1e-4 * a * (gradient @ step)]
            # Near the optimum the values differ by less than their rounding; the gradient still tells.
            better = better or [s for s in tried if np.abs(s[2]).max() < 0.9 * np.abs(gradient).max()]
            if better:
                break
        else:
            warnings.warn(f"rates: optimality only to {np.abs(gradient).max() / goal.sum():.1e} of the budget")
            break
        now = better[0]
    return [-now[0]], now[3]


def mixed(docs: DataFrame, labels: DataFrame, targets=None, domain="lang", budget=None) -> DataFrame:
    """``doc_id, tokens, posterior, rate`` for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "mixing")
    names, weights = fit_domains(docs, labels, domain)
    if not names:
        words = F.filter(F.split(F.coalesce("text", F.lit("")), r"(?U)\s+"), lambda w: w != "")
        return docs.select("doc_id", F.size(words).cast("long").alias("tokens"),
                           F.lit(None).cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate"))
    scored = scratch.write(with_posteriors(docs.select("doc_id", "text"), weights).drop("text"))
    residuals, _ = best_rates(scored, names, targets or TARGETS, budget)
    return scored.select("doc_id", F.col("_tokens").alias("tokens"), F.col("_posterior").alias("posterior"),
                         rate_of(residuals, 1.0 if budget == "keep" else 0.0).alias("rate"))


def resampled(docs: DataFrame, labels: DataFrame, targets=None, domain="lang", budget=None) -> DataFrame:
    """``docs`` with every row repeated by its rate: the whole part always, the rest by a hash draw."""
    scratch = Scratch(docs.sparkSession, "mixing")
    names, weights = fit_domains(docs, labels, domain)
    if not names:
        return docs
    scored = scratch.write(with_posteriors(docs.select("text"), weights).drop("text"))
    residuals, _ = best_rates(scored, names, targets or TARGETS, budget)
    rate = rate_of(residuals, 1.0 if budget == "keep" else 0.0)
    draw = F.pmod(F.xxhash64(F.lit("mix"), "doc"), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("int")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    out = with_posteriors(whole, weights, "doc.text").withColumn("_copies", copies).where("_copies > 0")
    return out.select("doc", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("doc.*")


def op10_mixing(spark, sf_dir) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
