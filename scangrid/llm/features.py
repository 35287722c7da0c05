"""Hashed features of whole texts, and linear models over them."""
from __future__ import annotations

import re
import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa

from .common import sigmoid

DIMS = 1 << 14
_LETTERS = re.compile(r"[^\W\d_]+")
_SHAPES = ((re.compile(r"[0-9]+"), "0"),)


def _shape(word: str) -> str:
    """Letters by case, digits and repeated marks folded: ``Abc,`` -> ``Aa,``."""
    if word.isalpha():
        return "a" if word.islower() else "A" if len(word) > 1 and word.isupper() else "Aa"

    def letters(m):
        t = m[0]
        return "A" if len(t) > 1 and t.isupper() else "Aa" if t[0].isupper() else "a"
    out = _LETTERS.sub(letters, word[:64])
    for pattern, by in _SHAPES:
        out = pattern.sub(by, out)
    return re.sub(r"(.)\1+", r"\1\1", out)


class _Words(dict):
    """Word -> row of ``table`` with its feature numbers, filled as words are met."""

    def __init__(self, shapes: bool):
        self.shapes = shapes
        self.table = np.empty((1 << 12, 4 if shapes else 2), np.int32)

    def __missing__(self, word):
        low = word.lower().encode()
        keys = [zlib.crc32(low), zlib.crc32(word[-3:].lower().encode(), 1)]
        if self.shapes:
            keys += [zlib.crc32(word[:3].lower().encode(), 2), zlib.crc32(_shape(word).encode(), 3)]
        at = self[word] = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[at] = [k % DIMS for k in keys]
        return at


class Extractor:
    """Sparse features of texts: short words whole and longer ones by their two ends, and word
    ends; with ``shapes`` also word beginnings, word shapes and repetition."""

    KEEP = 1 << 20

    def __init__(self, shapes=True):
        self.shapes = shapes
        self.words = _Words(shapes)
        self.extra = np.array([zlib.crc32(k) % DIMS for k in (b"same", b"lines", b"any")])

    def __call__(self, text: str | None):
        """Sorted feature numbers and values; the squares of the values sum to one."""
        if len(self.words) > self.KEEP:
            self.words = _Words(self.shapes)
        words = (text or "").split()
        count = Counter([w if len(w) <= 6 else w[:3] + w[-3:] for w in words])
        ids = np.fromiter(map(self.words.__getitem__, count), np.int64, len(count))
        index = self.words.table[ids]
        weight = np.repeat(np.fromiter(count.values(), float, len(count)), index.shape[1])
        extra = np.array([0, 0, max(1, len(words))], float)
        if self.shapes:
            lines = Counter(x for x in (text or "").split("\n") if len(x) > 20)
            extra[:2] = (4 * sum(map(eq, words, words[1:])), 20 * sum(n for n in lines.values() if n > 1))
        total = np.bincount(np.concatenate([index.ravel(), self.extra]),
                            np.concatenate([weight, extra]), DIMS)
        at = np.flatnonzero(total)
        value = np.sqrt(total[at])
        return at.astype(np.int32), (value / np.sqrt(total.sum())).astype(np.float32)


class Sparse:
    """Rows of (index, value) as one compressed matrix; no row is empty."""

    def __init__(self, rows):
        self.starts = np.cumsum([0] + [len(i) for i, _ in rows])[:-1]
        self.index = np.concatenate([i for i, _ in rows]) if rows else np.empty(0, np.int32)
        self.value = np.concatenate([v for _, v in rows]).astype(float) if rows else np.empty(0)
        self.row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows]) if rows else np.empty(0, int)
        self.count = len(rows)

    def dot(self, w):
        """``w``: features x classes."""
        return np.stack([np.add.reduceat(w[self.index, c] * self.value, self.starts)
                         for c in range(w.shape[1])], axis=1)

    def back(self, g):
        return np.stack([np.bincount(self.index, self.value * g[self.row, c], DIMS)
                         for c in range(g.shape[1])], axis=1)


def softmax(x):
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_linear(rows: Sparse, target: np.ndarray, weight=None, ridge=1e-4, rounds=80):
    """Weights (features x classes) of logistic regression by accelerated gradient steps.

    One column of targets in [0, 1] gives a binary model, several a softmax. The feature
    rows have length one, so the step size is known.
    """
    classes = target.shape[1]
    weight = np.full(rows.count, 1.0) if weight is None else weight
    weight = weight / weight.sum()
    link = sigmoid if classes == 1 else softmax
    w = look = np.zeros((DIMS, classes))
    rate = 1 / (0.5 + ridge)  # weights sum to one and rows have length one
    for i in range(rounds):
        g = rows.back((link(rows.dot(look)) - target) * weight[:, None]) + ridge * look
        new = look - rate * g
        look = new + i / (i + 3) * (new - w)
        w = new
    return w


def sparse_arrays(pairs):
    """Arrow list columns of feature numbers and values."""
    return (pa.array([p[0] for p in pairs], pa.list_(pa.int32())),
            pa.array([p[1] for p in pairs], pa.list_(pa.float32())))


def sparse_rows(index_column, value_column):
    return [(np.array(i.as_py(), np.int32), np.array(v.as_py(), np.float32))
            for i, v in zip(index_column, value_column)]
