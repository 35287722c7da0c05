"""Licence notices in documents: trained paragraph classifier with template comparison.

A paragraph is a line. Every line is described by its distinct words and word pairs and
classified by a sparse logistic regression into licence families, "unknown" (a notice of no
known family) and "none". The sharpness of the probabilities and the least probability of a named family are
calibrated on examples kept apart. A family is confirmed when the line holds most words of
one of its templates.

The model is fitted on the driver from the templates and at most ``SAMPLE_LINES`` lines (of up to
``SAMPLE_CHARS`` characters) of the
corpus, by smallest hash. Scoring is DataFrame work only: lines whose score is highest for "none"
go first, equal lines among the others are merged, and the joined tables are the model's own, of
fixed size.

Defined cases: null and empty texts have no notices; repeated rows each get their notices;
very long lines are one paragraph; ties in probability go to the first name; other columns are
ignored; an empty table gives no rows.
"""
from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, table
from .features import softmax

SAMPLE_LINES, SAMPLE_CHARS, CONFIRMED = 500, 400, 0.8
#: Distinct notice lines of which the hashes may go to every executor.
BROADCAST = 500_000

# Usual notices of each family.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License.",
        "This project is released under the Apache 2.0 license.", "Apache-2.0", "SPDX-License-Identifier: Apache-2.0"],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
        "Licensed under the BSD 3-Clause License.", "Released under the BSD 2-Clause License."],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation.",
        "Released under the GPL, version 2 or later."],
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.", "MPL-2.0", "SPDX-License-Identifier: MPL-2.0"],
    "unknown": [
        "All rights reserved.", "Copyright by the authors.", "Licensed under the terms of the owner's own agreement.",
        "Released under the license that comes with this work.", "Used with permission under a proprietary license.",
        "Copyright 2020 the publisher, all rights reserved.", "See the license file for the terms.",
        "No warranty is given and redistribution is not permitted.", "CC0 1.0 Universal"],
    "none": [
        "She renewed her driving licence last week.", "The warranty covers repairs for two years.",
        "They asked for permission to enter the park.", "The pilot lost his license after the hearing.",
        "A fishing licence is needed at the lake.", "He spoke about copyright law in the lecture.",
        "The council redistributed the funds.", "Without a warrant the officers waited outside."],
}
def ngrams(line: str) -> set[str]:
    """Distinct words and pairs of neighbours, as in ``_grams``."""
    words = [w for w in (x.strip(".") for x in re.split(r"[^a-z0-9.+-]+", line.lower())) if w]
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}


def _grams(line):
    """Column: distinct words and pairs of neighbours of a line."""
    words = F.filter(F.transform(F.split(F.lower(line), r"[^a-z0-9.+-]+"), lambda w: F.btrim(w, F.lit("."))),
                     lambda w: w != "")
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, rest), F.slice(words, 2, rest), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, pairs))


def known_grams(lines: DataFrame, vocabulary, *keep: str) -> DataFrame:
    """``keep`` and ``grams``: those of ``_grams(line)`` that are in ``vocabulary``.

    A pair is put together only where both of its words occur in pairs of the vocabulary.
    """
    pairs = [g.split(" ") for g in vocabulary if " " in g]
    first, second = (sorted({p[i] for p in pairs}) for i in (0, 1))
    # Words as in ``_grams``: no full stop at either end.
    words = F.regexp_extract_all(F.lower("line"), F.lit(r"[a-z0-9+-](?:[a-z0-9.+-]*[a-z0-9+-])?"), F.lit(0))
    split = lines.select(*keep, words.alias("_words"))
    both = F.zip_with("_words", F.slice("_words", 2, F.size("_words")), lambda a, b: F.when(
        a.isin(first) & b.isin(second), F.concat_ws(" ", a, b)))
    known = F.filter(F.concat("_words", both), lambda g: g.isin(vocabulary))
    return split.select(*keep, F.array_distinct(known).alias("grams"))


class Model:
    """Weights per n-gram and class, biases, sharpness and the least probability of a family."""

    def __init__(self, lines):
        names = list(TEMPLATES)
        self.classes = names
        grams = [(c, ngrams(t)) for c in names for t in TEMPLATES[c]]
        self.vocabulary = sorted(set().union(*(g for _, g in grams)))
        at = {g: i for i, g in enumerate(self.vocabulary)}
        examples = []
        for c in names:
            for t in TEMPLATES[c]:
                words = t.split()
                least = max(2, (7 * len(words)) // 10)
                # Long notices are often wrapped, so their stretches of a line's length count too.
                wrapped = {12} if len(words) > 17 else set()
                for n in {len(words), least, (len(words) + least) // 2} | wrapped:
                    examples += [(c, ngrams(" ".join(words[i:i + n]))) for i in range(len(words) - n + 1)]
        for line in lines:
            own = ngrams(line)
            # A sampled line that resembles a notice says nothing about ordinary text.
            if max((len(own & g) / len(g) for c, g in grams if c != "none"), default=0) < 0.6:
                examples.append(("none", own))
        x = np.zeros((len(examples), len(at)))
        for i, (_, own) in enumerate(examples):
            x[i, [at[g] for g in own if g in at]] = 1
        label = np.array([names.index(c) for c, _ in examples])
        y = np.eye(len(names))[label]
        apart = np.arange(len(examples)) % 4 == 3
        self.weights, self.bias = self._fit(x[~apart], y[~apart])
        score = x[apart] @ self.weights + self.bias
        loss = {s: -np.log(softmax(s * score)[y[apart] > 0] + 1e-12).mean() for s in (0.5, 1.0, 2.0, 4.0)}
        self.sharpness = min(loss, key=loss.get)
        self.weights, self.bias = self._fit(x, y)
        own = softmax(self.sharpness * score)[y[apart] > 0]
        named = np.isin(label[apart], [i for i, c in enumerate(names) if c not in ("unknown", "none")])
        self.least = float(np.clip(np.quantile(own[named], 0.05), 0.4, 0.8))

    @staticmethod
    def _fit(x, y, rounds=400, ridge=1e-3):
        weight = 1 / (y.sum(0) + 1e-9)
        weight = y @ weight / y.shape[1]  # classes count alike
        w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
        look, look_b = w, b
        rate = 1 / (0.5 * (x.sum(1).max() + 1))
        for i in range(rounds):
            g = (softmax(x @ look + look_b) - y) * weight[:, None]
            new, new_b = look - rate * (x.T @ g + ridge * look), look_b - rate * g.sum(0)
            step = i / (i + 3)
            look, look_b = new + step * (new - w), new_b + step * (new_b - b)
            w, b = new, new_b
        return w, b


def candidate_lines(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, paragraph, line`` of all lines that the model does not put under "none"."""
    model = model or fit(docs)
    none = model.classes.index("none")
    # How much a gram favours each class over "none"; scores are linear in the grams.
    lead = np.delete(model.weights - model.weights[:, [none]], none, axis=1)
    base = np.delete(model.bias - model.bias[none], none)
    leads = docs.sparkSession.createDataFrame(
        [(g, [float(v) for v in w]) for g, w in zip(model.vocabulary, lead)], "gram string, lead array<double>")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line")).where("line <> ''")
    bare = float(base.max()) > -1e-9  # then lines without any known gram count too
    each, how = (F.explode_outer, "left") if bare else (F.explode, "inner")
    grams = known_grams(lines.select(F.monotonically_increasing_id().alias("_at"), F.xxhash64("line").alias("_line"),
                                     "line"), model.vocabulary, "_at", "_line")
    if not bare:  # nothing but a gram that favours some class lifts a line over "none"
        favour = [g for g, w in zip(model.vocabulary, lead) if max(w) > 0]
        grams = grams.where(F.exists("grams", lambda g: g.isin(favour)))
    grams = grams.select("_at", "_line", each("grams").alias("gram"))
    sums = grams.join(F.broadcast(leads), "gram", how).groupBy("_at").agg(
        F.min("_line").alias("_line"), *[F.sum(F.col("lead")[i]).alias(f"l{i}") for i in range(len(base))])
    best = F.greatest(*[F.coalesce(f"l{i}", F.lit(0.0)) + float(v) for i, v in enumerate(base)])
    # Lines are known by a hash here; one that merely shares it is put under "none" later.
    wanted = Scratch(docs.sparkSession, "licences").write(sums.where(best > -1e-9).select("_line").distinct())
    if wanted.count() <= BROADCAST:  # hashes only; beyond that the lines are shuffled
        wanted = F.broadcast(wanted)
    return lines.withColumn("_line", F.xxhash64("line")).join(wanted, "_line", "left_semi").drop("_line")


def fit(docs: DataFrame) -> Model:
    sample = (docs.select(F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") <= SAMPLE_CHARS)
              .orderBy(F.xxhash64("line"), "line").limit(SAMPLE_LINES).collect())
    return Model([r["line"] for r in sample])


def classified(lines: DataFrame, model: Model) -> DataFrame:
    """``line, family, probability, similarity`` of every distinct ``line``; "none" left out."""
    spark = lines.sparkSession
    classes = model.classes
    table_ = spark.createDataFrame(
        [(g, [float(v) for v in w]) for g, w in zip(model.vocabulary, model.weights)],
        "gram string, weight array<double>")
    words = spark.createDataFrame(
        [(c, f"{c} {i}", w, len(own)) for c, ts in TEMPLATES.items() if c not in ("none", "unknown")
         for i, t in enumerate(ts) for own in [{g for g in ngrams(t) if " " not in g}] for w in sorted(own)],
        "template_family string, template string, gram string, size int")
    distinct = lines.select("line").distinct()
    grams = distinct.select("line", F.explode(_grams(F.col("line"))).alias("gram"))
    # Both tables come from the templates above and have a fixed size.
    sums = grams.join(F.broadcast(table_), "gram").groupBy("line").agg(
        *[F.sum(F.col("weight")[i]).alias(f"s{i}") for i in range(len(classes))])
    match = (grams.join(F.broadcast(words), "gram").groupBy("line", "template_family", "template")
             .agg((F.count(F.lit(1)) / F.max("size")).alias("part"))
             .groupBy("line", "template_family").agg(F.max("part").alias("part")))
    logit = [model.sharpness * (F.coalesce(f"s{i}", F.lit(0.0)) + float(model.bias[i]))
             for i in range(len(classes))]
    top = F.array_max("z")
    spread = F.aggregate("z", F.lit(0.0), lambda t, x: t + F.exp(x - top))
    name = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("z", top).cast("int"))
    scored = (distinct.join(sums, "line", "left").select("line", F.array(*logit).alias("z"))
              .select("line", name.alias("best"), (1 / spread).alias("probability")))
    scored = scored.where("best <> 'none'")
    named = scored.join(match, (scored["line"] == match["line"]) & (scored["best"] == match["template_family"]),
                        "left").select(scored["line"], "best", "probability",
                                       F.coalesce("part", F.lit(0.0)).alias("similarity"))
    # A short name such as Apache-2.0 is one word of evidence, but all of its template.
    sure = (F.col("probability") >= model.least) | (F.col("similarity") == 1)
    return named.select("line", F.when(sure, F.col("best")).otherwise("unknown").alias("family"),
                        "probability", "similarity")


def notices(docs: DataFrame) -> DataFrame:
    """``doc_id, paragraph, family, probability, similarity, confirmed`` of every notice."""
    model = fit(docs)
    # Read twice below, and texts are not to be searched twice.
    lines = Scratch(docs.sparkSession, "licences").write(candidate_lines(docs, model))
    found = classified(lines, model)
    return lines.join(found, "line").select(
        "doc_id", "paragraph", "family", "probability", "similarity",
        ((F.col("similarity") >= CONFIRMED) & (F.col("family") != "unknown")).alias("confirmed"))


def op6_licences(spark, sf_dir) -> DataFrame:
    return notices(table(spark, sf_dir, "documents"))
