"""Trained operators: held-out accuracy, targets reached, odd rows."""
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scangrid.llm import cotraining, licences, mixing, toxicity

SF = "/root/testdata/sf0.01"
ODD = [None, "", " \n ", "x" * 200000, "word " * 40000, "\x00�😀", "a b c", "a b c"]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held(df):
    return df[[zlib.crc32(str(i).encode()) % 5 == 0 for i in df.doc_id]]


def test_quality_on_held_out_rows(spark, corpus):
    docs, labels = corpus
    some = docs
    got = held(cotraining.scored(some, labels, "doc_id").toPandas().merge(labels.toPandas(), on="doc_id"))
    assert ((got.score >= 0.5) == got.quality).mean() > 0.95
    assert (got[got.quality == 1].score >= 0.5).mean() > 0.98
    assert got[["text_score", "meta_score", "score"]].stack().between(0, 1).all()


def test_quality_of_odd_rows(spark, documents, corpus):
    docs = documents(ODD + ["fine text here"] * 30, ids=[None, *range(1, 38)], sources=[None] * 38, langs=[None] * 38)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8, 38)] + [(None, 1, 0), (3, None, None)],
                                   "doc_id long, quality int, toxic int")
    kept = cotraining.good_documents(docs, labels)
    assert kept.columns == docs.columns
    assert cotraining.scored(docs, labels, "doc_id").count() == 38
    one = labels.where("quality = 1")
    assert cotraining.good_documents(docs, one).count() == 38  # only good labels: none is rejected
    assert cotraining.good_documents(docs.where("false"), labels).count() == 0
    assert cotraining.good_documents(docs, labels.where("false")).count() == 38


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.scored(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    got = got[got.held_out]
    assert (got.predicted == got.toxic).mean() > 0.95
    assert (got[got.toxic == 0].predicted == 0).mean() > 0.98
    assert (got[got.toxic == 1].predicted == 1).mean() > 0.6


def test_short_segments_save_bytes():
    """Every place of the dictionary is found; beside another match five bytes already tell."""
    filler = b" ".join(b"w%05d" % (i * 7919 % 99991) for i in range(3000))
    segments = [b" scum", b" vequ", b" idiot", b" worthless"]
    distance = toxicity.Distance(filler, segments)
    for words in ("scum kxw vequance", "scum kxw idiot", "worthless"):
        text = f"w07919 {words} pfg"
        saved, *counts, size = distance(text)
        plain, both = (len(c.compress(b" " + text.encode() + b" ")) for c in (distance.plain, distance.both))
        assert saved == plain - both >= 1 and size == 0
    assert distance("w07919 kxw pfg mnb")[0] <= 0


def test_toxicity_of_odd_rows(spark, documents):
    docs = documents(ODD + [f"you rotten fool number {i}" for i in range(20)] + [f"a fine day number {i}" for i in range(20)],
                     ids=[None, *range(1, 48)])
    labels = spark.createDataFrame([(i, 1, int(i < 28)) for i in range(8, 48)] + [(None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == 48 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.scored(docs, labels.where("toxic = 0")).agg(F.max("score")).first()[0] == 0
    assert toxicity.scored(docs.where("false"), labels).count() == 0


def test_mixing_meets_targets(spark, corpus):
    docs, labels = corpus
    got = mixing.mixed(docs, labels).toPandas()
    mass = (np.array(got.posterior.tolist()) * (got.tokens * got.rate).values[:, None]).sum(0)
    names = sorted(mixing.TARGETS)
    assert np.abs(mass / mass.sum() - [mixing.TARGETS[n] for n in names]).max() < 1e-3
    assert abs(mass.sum() / got.tokens.sum() - 1) < 1e-3 and (got.rate >= 0).all()
    said = docs.select("doc_id", "lang").toPandas().merge(got, on="doc_id")
    best = np.array(names)[np.array(said.posterior.tolist()).argmax(1)]
    assert (best == said.lang).mean() > 0.95
    raised = mixing.resampled(docs.where("doc_id < 500"), labels, budget="keep")
    assert raised.columns == docs.columns and raised.select("doc_id").distinct().count() == 500
    assert raised.count() > 500


def test_mixing_fits_like_brute_force(spark):
    """Posteriors that overlap and a target that pushes some rates to zero."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.5] * 3, 200)
    tokens = rng.integers(0, 50, 200)
    rows = spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(tokens, p)],
                                 "_tokens long, _posterior array<double>")
    steps, reached = mixing.fit_rates(rows, ["a", "b", "c"], {"a": 0.9, "b": 0.1})
    rates = np.array([r[0] for r in rows.select(mixing.rate_of(steps)).collect()])
    want = np.ones(200)
    have = (p * tokens[:, None]).sum(0)
    goal = np.array([0.9, 0.1, 0.0]) * have.sum()
    for _ in range(len(steps)):
        left = ((p * (tokens * want)[:, None]).sum(0) - goal) / have
        want = np.where(tokens > 0, np.maximum(0, want - p @ left), 1)
    assert np.allclose(rates, want) and (rates == 0).any()
    start = (((have - goal) ** 2) / have).sum()
    assert (((reached - goal) ** 2) / have).sum() < 0.2 * start


def nonnegative(a, b):
    """Least squares with no negative part (Lawson and Hanson)."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    while (g := np.where(used, -1, a.T @ (b - a @ x))).max() > 1e-10:
        used[g.argmax()] = True
        while True:
            z = np.zeros_like(x)
            z[used] = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            if (z[used] > 0).all():
                x = z
                break
            low = used & (z <= 0)
            x = x + (x[low] / (x[low] - z[low])).min() * (z - x)
            used &= x > 1e-14
    return x


@pytest.mark.parametrize("budget", [None, "keep"])
def test_mixing_reaches_least_squares(spark, budget):
    """Soft posteriors and a rare domain: totals as near the targets as rates can come."""
    rng = np.random.default_rng(5)
    said = rng.choice(4, 2000, p=[0.7, 0.2, 0.095, 0.005])
    p = rng.gamma(0.3 + 5 * np.eye(4)[said]) + 1e-9
    p /= p.sum(1, keepdims=True)
    tokens = rng.integers(0, 50, 2000)
    rows = spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(tokens, p)],
                                 "_tokens long, _posterior array<double>").repartition(3)
    names, least = ["a", "b", "c", "d"], float(budget == "keep")
    residuals, reached = mixing.best_rates(rows, names, dict(zip(names, [0.5, 0.2, 0.15, 0.15])), budget)
    have = p.T @ tokens
    wish = np.array([0.5, 0.2, 0.15, 0.15])
    total = have.sum() if budget is None else (have / wish).max()
    a = (p * tokens[:, None]).T / np.sqrt(have)[:, None]
    x = nonnegative(a / 25, (wish * total - least * have) / np.sqrt(have) / 25)
    want = least * have + p.T @ (tokens * x)
    assert np.abs(reached - want).max() < 1e-3 * total
    got = [(r["_tokens"], r["_posterior"], r["rate"]) for r in
           rows.withColumn("rate", mixing.rate_of(residuals, least)).collect()]
    assert np.allclose(sum(t * r * np.array(q) for t, q, r in got), reached)
    assert min(r for *_, r in got) >= least


def test_mixing_of_odd_rows(spark, documents):
    docs = documents(ODD, ids=[None, 1, 2, 3, 4, 5, 6, 6], langs=["en", "de", None, "en", "de", "en", "de", "de"])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(8)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = mixing.mixed(docs, labels).collect()
    assert len(got) == 8 and all(r["rate"] >= 0 for r in got)
    assert sorted(r["tokens"] for r in got) == [0, 0, 0, 1, 1, 3, 3, 40000]
    assert mixing.resampled(docs, labels, budget="keep").count() >= 8
    plain = mixing.mixed(docs, labels.where("false")).collect()
    assert {r["rate"] for r in plain} == {1.0}
    assert sorted(r["tokens"] for r in plain) == [0, 0, 0, 1, 1, 3, 3, 40000]
    assert mixing.mixed(docs.where("false"), labels).count() == 0


def test_licences_are_recognised(spark, documents):
    texts = [t for ts in licences.TEMPLATES.values() for t in ts]
    family = [f for f, ts in licences.TEMPLATES.items() for _ in ts]
    lines = ["Some text before.\n" + t + "\nand text after it" for t in texts]
    extra = ["LICENSED UNDER THE MIT LICENSE", "This is released under the MIT license by us", "all rights reserved",
             "He lost his licence and went home", None, "", "x" * 100000, "permission " * 20000]
    docs = documents(lines + extra)
    got = {r["doc_id"]: r for r in licences.notices(docs).collect()}
    for i, f in enumerate(family):
        if f == "none":
            assert i not in got
        else:
            assert got[i]["family"] == f and got[i]["paragraph"] == 1
            assert got[i]["confirmed"] == (f != "unknown")
    at = len(lines)
    assert got[at]["family"] == got[at + 1]["family"] == "MIT" and got[at]["confirmed"]
    assert got[at + 2]["family"] == "unknown" and at + 3 not in got and at + 4 not in got
    assert licences.notices(docs.where("false")).count() == 0
    assert licences.notices(documents([texts[0], texts[0]], ids=[4, 4])).count() == 2


def test_licence_scores_match_brute_force(spark, corpus):
    docs, _ = corpus
    model = licences.fit(docs)
    lines = licences.candidate_lines(docs).select("line")
    got = {r["line"]: r for r in licences.classified(lines, model).collect()}
    at = {g: i for i, g in enumerate(model.vocabulary)}
    for line in {r["line"] for r in lines.collect()}:
        x = np.zeros(len(at))
        x[[at[g] for g in licences.ngrams(line) if g in at]] = 1
        p = licences.softmax((model.sharpness * (x @ model.weights + model.bias))[None])[0]
        name = model.classes[int(p.argmax())]
        assert (line in got) == (name != "none")
        if line in got:
            assert abs(got[line]["probability"] - p.max()) < 1e-9
            assert got[line]["family"] == (name if p.max() >= model.least else "unknown")


def test_licence_lines_without_usual_words_are_scored(spark, documents):
    texts = ["Apache-2.0", "MPL-2.0", "CC0 1.0 Universal",
             "including any person obtaining a copy of this\nsoftware and associated documentation files, to deal in the Software",
             "the red fox ran over the hill\nand the river was cold", "", None] + ["some plain words of no use"] * 30
    docs = documents(texts)
    ids = [r.doc_id for r in docs.select("doc_id", "text").collect() if r.text in texts[:4]]
    model = licences.fit(docs)
    found = {(r.doc_id, r.paragraph) for r in licences.notices(docs).collect()}
    assert {i for i, _ in found} == set(ids) and max(p for _, p in found) == 1
    # No line is left out that the model itself puts under a class.
    lines = {line for t in texts if t for line in t.split("\n")}
    at = {g: i for i, g in enumerate(model.vocabulary)}
    def best(line):
        return model.classes[int(np.argmax(model.bias + sum(model.weights[at[g]] for g in licences.ngrams(line) if g in at)))]
    kept = {r.line for r in licences.candidate_lines(docs, model).collect()}
    assert kept == {line for line in lines if best(line) != "none"}


def test_licence_grams_of_the_vocabulary_only(spark):
    lines = ["Licensed under the MIT License.", "...the. MIT,license ... the MIT license", "the the the MIT", ". .the", "", "..", "of",
             "x MIT License x", "a." * 100000 + " of the", "\u212a of\u00a0the", "v. 2.0 2.0. of..the of.the", "the\tof\r\nthe of"]
    vocabulary = ["the", "of", "mit", "license", "2.0", "k", "of the", "the of", "the mit", "mit license", "v 2.0", "2.0 2.0", "of..the"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    grams = licences.known_grams(df, vocabulary, "i")
    got = {r.i: r.grams for r in grams.collect()}
    for i, line in enumerate(lines):
        assert len(got[i]) == len(set(got[i])) and set(got[i]) == licences.ngrams(line) & set(vocabulary), line
    plain = {r.i: set(r.grams) & set(vocabulary) for r in df.select("i", licences._grams(F.col("line")).alias("grams")).collect()}
    assert plain == {i: set(g) for i, g in got.items()}
