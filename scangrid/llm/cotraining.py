"""Quality scores by co-training a text view and a page-metadata view.

The text view is a logistic regression over hashed words and word shapes. The metadata view
is one over source, language, length and layout (lines, shares of character classes). Each
round, either view labels the pool documents it is surest of for the other one. Then each
view is calibrated on labelled rows kept apart, and a logistic combination of the calibrated
views scores every document of the corpus.

Fitting uses at most ``LABELLED`` labelled rows and a pool of ``POOL`` other documents, both by
smallest hash of the id. Labels with crc32(doc_id) mod 5 = 0 are never used, so that accuracy
can be measured on them.

Defined cases: null and empty texts are scored as texts without words; null metadata is a
value of its own; repeated rows score alike; labels of several rows of an id count by the
largest; without labels of both kinds all documents score the share of good labels (1 if none).
"""
from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import fit_logistic, sigmoid, table
from .features import Extractor, Sparse, fit_linear, sparse_arrays, sparse_rows
from .toxicity import held_out

LABELLED, POOL, ROUNDS, CONFIDENT, EXCHANGED = 3000, 2000, 3, 0.95, 200
THRESHOLD = 0.5
#: A filtering stage drops a document only if bad is at least twice as likely as good.
REJECTED_BELOW = 1 / 3
META_DIMS = 64
_MARKS = np.zeros(256, bool)
_MARKS[list(b"|#$%&*!")] = True


def _shares(text: str):
    """Shares of capitals, digits, other marks, table marks and white space."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    low = code[code < 256]
    upper = ((low >= 65) & (low <= 90)) | ((low >= 192) & (low <= 222) & (low != 215))
    digit = (low >= 48) & (low <= 57)
    space = (low <= 32)
    mark = (low > 32) & (low < 128) & ~digit & ~upper & ~((low >= 97) & (low <= 122))
    return [x.sum() / max(1, len(code)) for x in (upper, digit, mark, _MARKS[low], space)]


def metadata(source, lang, n_chars, text) -> np.ndarray:
    """Source and language hashed to one place each, and numbers of the page's layout."""
    out = np.zeros(2 * META_DIMS + 9)
    out[zlib.crc32(repr(source).encode()) % META_DIMS] = 1
    out[META_DIMS + zlib.crc32(repr(lang).encode()) % META_DIMS] = 1
    text = text or ""
    size, lines = max(1, len(text)), text.count("\n") + 1
    words = text.split()
    out[2 * META_DIMS:] = (math.log1p(size if n_chars is None else max(0, n_chars)), math.log1p(lines),
                           math.log1p(size / lines), len(set(words)) / max(1, len(words)),
                           *_shares(text))
    return out


def _meta_fit(x, y):
    return fit_logistic(x, y, ridge=1.0)


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class CoTrained:
    """Both fitted views and their combination."""

    def __init__(self, text_rows, meta, label):
        """``label``: 0 or 1, NaN in the pool."""
        known = ~np.isnan(label)
        apart = known & (np.arange(len(label)) % 4 == 0)
        train = {v: np.where(known & ~apart, label, np.nan) for v in ("text", "meta")}
        pool = np.flatnonzero(~known)
        for turn in range(ROUNDS + 1):
            have = ~np.isnan(train["text"])
            picked = np.flatnonzero(have)
            self.text = fit_linear(Sparse([text_rows[i] for i in picked]), train["text"][picked][:, None])
            have = ~np.isnan(train["meta"])
            self.meta = _meta_fit(meta[have], train["meta"][have])
            if turn == ROUNDS or not len(pool):
                break
            sure = {"meta": self._text([text_rows[i] for i in pool]), "text": self.meta(meta[pool])}
            for to, p in sure.items():
                for value, score in ((1.0, p), (0.0, 1 - p)):
                    best = np.argsort(-score, kind="stable")[:EXCHANGED]
                    best = best[score[best] >= CONFIDENT]
                    mine = pool[best]
                    train[to][mine] = np.where(np.isnan(train[to][mine]), value, train[to][mine])
        y = label[apart]
        views = self._views([text_rows[i] for i in np.flatnonzero(apart)], meta[apart])
        self.calibrated = [fit_logistic(v[:, None], y, ridge=0.1) for v in views.T]
        self.combined = fit_logistic(self._calibrated(views), y, ridge=0.1)

    def _text(self, rows):
        return sigmoid(Sparse(rows).dot(self.text)[:, 0])

    def _views(self, rows, meta):
        return np.stack([logit(self._text(rows)), logit(self.meta(meta))], axis=1)

    def _calibrated(self, views):
        return np.stack([logit(f(v[:, None])) for f, v in zip(self.calibrated, views.T)], axis=1)

    def scores(self, rows, meta):
        """Calibrated text and metadata scores and their combination."""
        each = self._calibrated(self._views(rows, meta))
        return sigmoid(each[:, 0]), sigmoid(each[:, 1]), self.combined(each)


def _extract(batches):
    get = Extractor()
    for b in batches:
        text, source, lang, size = (b.column(i).to_pylist() for i in (2, 3, 4, 5))
        index, value = sparse_arrays([get(t) for t in text])
        meta = [metadata(s, la, n, t) for s, la, n, t in zip(source, lang, size, text)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), index, value, pa.array(meta, pa.list_(pa.float64()))],
            names=["doc_id", "label", "index", "value", "meta"])


def fit(docs: DataFrame, labels: DataFrame):
    """A fitted model, or a constant score where labels of one kind are missing."""
    known = (labels.where(~held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id")
             .agg(F.max("quality").cast("double").alias("label")))
    mine = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    some = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(
        2 * (POOL + LABELLED)).distinct()
    pool = some.join(labels.select("doc_id"), "doc_id", "left_anti").limit(POOL).select(
        "doc_id", F.lit(None).cast("double").alias("label"))
    # Bounded by LABELLED + POOL rows.
    chosen = F.broadcast(mine.unionByName(pool))
    kind = docs.schema["doc_id"].dataType.simpleString()
    need = docs.select("doc_id", "text", "source", "lang", "n_chars")
    got = (need.join(chosen, "doc_id").select("doc_id", "label", "text", "source", "lang", "n_chars")
           .mapInArrow(_extract, f"doc_id {kind}, label double, index array<int>, value array<float>, "
                                 "meta array<double>")
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * (LABELLED + POOL)).toArrow())
    label = np.array([np.nan if x is None else x for x in got["label"].to_pylist()], float)
    seen = label[~np.isnan(label)]
    if min((seen == 0).sum(), (seen == 1).sum()) < 8:
        return float(seen.mean()) if len(seen) else 1.0
    return CoTrained(sparse_rows(got["index"], got["value"]), np.array(got["meta"].to_pylist()), label)


def scored(docs: DataFrame, labels: DataFrame, carry: str) -> DataFrame:
    """``carry, text_score, meta_score, score``; ``carry``: doc_id, or doc for the whole row as a struct."""
    model = fit(docs, labels)
    need = ("text", "source", "lang", "n_chars")
    # A whole row holds what is needed; its text does not travel twice.
    source = (docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")) if carry == "doc"
              else docs.select(carry, *need))
    if isinstance(model, float):
        return source.select(carry, *[F.lit(model).alias(c) for c in ("text_score", "meta_score", "score")])

    def run(batches):
        get = Extractor()
        for whole in batches:
            for at in range(0, max(1, len(whole)), 512):
                b = whole.slice(at, 512)
                get_column = b.column(0).field if carry == "doc" else b.column
                text, source, lang, size = (get_column(c).to_pylist() for c in need)
                if text:
                    meta = np.array([metadata(s, la, n, t) for s, la, n, t in zip(source, lang, size, text)])
                    cols = model.scores([get(t) for t in text], meta)
                else:
                    cols = [np.empty(0)] * 3
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *map(pa.array, cols)],
                    names=[carry, "text_score", "meta_score", "score"])
    schema = StructType([source.schema[0]])
    for c in ("text_score", "meta_score", "score"):
        schema = schema.add(c, DoubleType())
    return source.mapInArrow(run, schema)


def good_documents(docs: DataFrame, labels: DataFrame, threshold=REJECTED_BELOW) -> DataFrame:
    """Rows of ``docs`` that the combined score does not reject."""
    return scored(docs, labels, "doc").where(F.col("score") >= threshold).select("doc.*")


def op4_cotraining(spark, sf_dir) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = scored(docs, labels, "doc_id")
    return out.select("doc_id", "text_score", "meta_score", "score",
                      (F.col("score") >= THRESHOLD).alias("kept"))
