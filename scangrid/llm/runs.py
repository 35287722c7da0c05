"""Periodic runs of words, and texts with the repeats of every run folded away.

A run is a stretch of words with smallest period q, at least ``LEAST`` words and
``REPEATS`` periods long, that neither neighbour extends. A run of period q holds at least
three neighbouring points of the grid 0, q, 2q, ...; all grids of a text together have
n log n points. Where three words of a grid agree, the longest common extension (LCE) of
the first two places tells how far the period reaches to the right; the beginning is found
by halving the step before, with LCEs again.

LCEs come from a difference cover: of every ``CYCLE`` places the ``COVER`` ones are
sampled, so that any two places meet in sampled ones after less than a cycle. Only suffixes
at sampled places are sorted, by doubling; the common lengths of sorted neighbours go into
a sparse table of range minima. An LCE compares the words up to the synchronised places and
reads the rest from the table.

The texts of an Arrow batch are handled together, up to ``BATCH_WORDS`` words, with a word
of its own after each, which no run can cross. Rows need no shuffle; memory grows with the
longest text only.

Defined cases: a null text has no words, a collapsed text of "" and no runs; repeated rows
and ids give a row each; other columns are ignored.
"""
from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import table, word_blocks

LEAST, REPEATS = 24, 3
#: Every difference of two places, modulo CYCLE, is a difference of two members of COVER.
CYCLE, COVER = 21, (0, 1, 4, 14, 16)
BATCH_WORDS, GRID_POINTS = 1 << 17, 1 << 20


def numbered(keys):
    """Dense ranks of rows of integer columns, the first column first."""
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), np.int64)
    for k in keys:
        fresh[1:] |= k[order][1:] != k[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh)
    return rank, order


class Lce:
    """Longest common extensions in ``words`` (whole numbers from 1; the last one occurs once)."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words = np.concatenate([words, np.zeros(CYCLE, words.dtype)])
        cover = np.zeros(CYCLE, bool)
        cover[list(COVER)] = True
        #: Least shift that takes both of two places, modulo CYCLE, to sampled ones.
        self.shift = np.array([[next(h for h in range(CYCLE) if cover[(i + h) % CYCLE] and cover[(j + h) % CYCLE])
                                for j in range(CYCLE)] for i in range(CYCLE)], np.int8)
        place = np.flatnonzero(np.resize(cover, n))
        self.number = np.full(n + 1, len(place), np.int64)
        self.number[place] = np.arange(len(place))
        self.order, levels = self._sort(place, n)
        self.rank = np.empty(len(place), np.int64)
        self.rank[self.order] = np.arange(len(place))
        self._minima(self._neighbours(place, levels, n))

    def _sort(self, place, n):
        """Order of the sampled suffixes, and their ranks by the first CYCLE * 2**k words."""
        bits = max(1, int(self.words.max()).bit_length())
        each = max(1, 62 // bits)
        keys = []
        for at in range(0, CYCLE, each):
            key = np.zeros(len(place), np.int64)
            for t in range(at, min(CYCLE, at + each)):
                key = key << bits | self.words[place + t]
            keys.append(key)
        rank, order = numbered(keys)
        levels, reach = [rank], CYCLE
        while len(rank) and rank.max() < len(rank) - 1:
            after = np.append(rank + 1, 0)[self.number[np.minimum(place + reach, n)]]
            rank, order = numbered([rank << 32 | after])
            levels.append(rank)
            reach *= 2
        return order, levels

    def _neighbours(self, place, levels, n):
        """Common length of each sampled suffix and the one sorted before it."""
        one, two = place[self.order[:-1]].copy(), place[self.order[1:]].copy()
        common = np.zeros(len(one), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            rank = np.append(levels[k], -1)
            a, b = (self.number[np.minimum(x + common, n)] for x in (one, two))
            same = (a < len(place)) & (b < len(place)) & (rank[a] == rank[b])
            common[same] += CYCLE << k
        return common + self._compare(one + common, two + common, np.full(len(one), CYCLE))

    def _compare(self, one, two, most):
        """Equal words from two places on, ``most`` of them at most."""
        equal = np.zeros(len(one), np.int64)
        live = np.flatnonzero(most > 0)
        last = len(self.words) - 1
        while len(live):
            a, b = one[live] + equal[live], two[live] + equal[live]
            live = live[self.words[np.minimum(a, last)] == self.words[np.minimum(b, last)]]
            equal[live] += 1
            live = live[equal[live] < most[live]]
        return equal

    def _minima(self, common):
        self.minima = [common]
        width = 1
        while 2 * width <= len(common):
            below = self.minima[-1]
            self.minima.append(np.minimum(below[:-width], below[width:]))
            width *= 2

    def __call__(self, one, two):
        """Common length of the suffixes at two arrays of places, no two of them the same."""
        shift = self.shift[one % CYCLE, two % CYCLE].astype(np.int64)
        common = self._compare(one, two, shift)
        on = np.flatnonzero(common == shift)
        a, b = self.rank[self.number[one[on] + shift[on]]], self.rank[self.number[two[on] + shift[on]]]
        low, high = np.minimum(a, b), np.maximum(a, b)  # neighbours low+1 .. high
        level = np.frexp(high - low)[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            least = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << k)])
            common[on[at]] += least
        return common


def grid_points(words, start, size, repeats):
    """Places i and periods q with equal words at i, i + q, ..., q apart on the grids of every text."""
    text = np.repeat(np.arange(len(size)), size // repeats)
    first = np.cumsum(size // repeats) - size // repeats
    period = np.arange(len(text)) - first[text] + 1
    points = (size[text] - 1) // period - repeats + 2
    ends = np.cumsum(points)
    at = 0
    while at < len(text):
        base = ends[at] - points[at]
        end = max(at + 1, int(np.searchsorted(ends, base + GRID_POINTS, side="right")))
        count = points[at:end]
        q = np.repeat(period[at:end], count)
        origin = np.repeat(start[text[at:end]] - (ends[at:end] - count - base) * period[at:end], count)
        i = origin + np.arange(len(q)) * q
        for k in range(1, repeats):
            same = words[i] == words[i + k * q]
            i, q, origin = i[same], q[same], origin[same]
        yield i, q
        at = end


def find_runs(words, start, size, least=LEAST, repeats=REPEATS):
    """``start, end, period`` of all runs, by start and period, as places in ``words``.

    ``words`` holds texts one after the other, each followed by a word that occurs once;
    ``start`` and ``size`` tell where they lie.
    """
    if not len(words) or not (size >= repeats).any():
        return [np.zeros(0, np.int64)] * 3
    lce = Lce(words)
    # Short texts have no run at all.
    start, size = start[size >= least], size[size >= least]
    found = []
    for i, q in grid_points(words, start, size, repeats):
        reach = lce(i, i + q)
        keep = reach > q * (repeats - 2)
        i, q, end = i[keep], q[keep], (i + q + reach)[keep]
        begin = start[np.searchsorted(start, i, side="right") - 1]
        # The period may begin up to a step before; a whole step before, another point tells of it.
        low, high = np.maximum(begin, i - q), i.copy()
        if len(i):
            same = i > low
            same[same] = lce(low[same], (low + q)[same]) >= (i - low)[same]
            known = same & (i - q >= begin)
            high[same] = low[same]
            i, q, end, low, high = (x[~known] for x in (i, q, end, low, high))
        while (low < high).any():
            at = np.flatnonzero(low < high)
            middle = (low[at] + high[at]) // 2
            holds = lce(middle, middle + q[at]) >= i[at] - middle
            high[at[holds]] = middle[holds]
            low[at[~holds]] = middle[~holds] + 1
        long = end - low >= np.maximum(least, repeats * q)
        found.append((low[long], end[long], q[long]))
    begin, end, period = (np.concatenate(c) for c in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
    order = np.lexsort((period, end, begin))
    begin, end, period = begin[order], end[order], period[order]
    if len(begin):  # of the periods of one stretch only the smallest counts
        fresh = np.append(True, (begin[1:] != begin[:-1]) | (end[1:] != end[:-1]))
        begin, end, period = begin[fresh], end[fresh], period[fresh]
    order = np.lexsort((period, begin))
    return begin[order], end[order], period[order]


def _fold(ids, begin, end, period, first, vocabulary):
    """Text of the words that no run repeats, joined by single spaces."""
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, begin + period - first, 1)
    np.add.at(change, end - first, -1)
    kept = ids[np.cumsum(change[:-1]) == 0]
    return b" ".join(map(vocabulary.__getitem__, kept.tolist()))


def collapse_runs(docs: DataFrame, key="doc_id", text="text", least=LEAST, repeats=REPEATS,
                  reorder=None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every whole text; runs by start, then period.

    ``collapsed`` keeps of each run the first period. ``reorder(doc_id, n)`` may give the
    word numbers to read in place of 0 .. n-1.
    """
    names = [key, "n_words", "runs", "collapsed"]
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def settle(keys, texts, vocabulary):
        size = np.array([*map(len, texts)], np.int64)
        start = np.cumsum(size + 1) - size - 1
        ids = np.empty(int(size.sum()) + len(size), np.int64)
        for i, (own, at) in enumerate(zip(texts, start)):
            ids[at:at + len(own)] = own
            ids[at + len(own)] = len(vocabulary) + i
        begin, end, period = find_runs(ids + 1, start, size, least, repeats)
        cuts = np.searchsorted(begin, np.append(start, len(ids)))
        names_of = [*vocabulary]
        collapsed = [_fold(own, begin[a:b], end[a:b], period[a:b], first, names_of)
                     for own, first, a, b in zip(texts, start, cuts, cuts[1:])]
        owner = np.repeat(start, np.diff(cuts))
        runs = pa.StructArray.from_arrays([pa.array(begin - owner), pa.array(end - begin), pa.array(period)],
                                          fields=[*run_type])
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(keys), pa.array(size),
             pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), runs),
             pa.array(collapsed, pa.binary()).cast(pa.string())], names=names)

    def run(batches):
        for batch in batches:
            keys, texts, total, vocabulary = [], [], 0, _fresh()
            for row in range(len(batch)):
                value = batch.column(1)[row]
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                ids = [np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))
                       for words in word_blocks(data)]
                own = np.concatenate(ids) if ids else np.zeros(0, np.int64)
                name = batch.column(0).slice(row, 1)
                other = reorder(name[0].as_py(), len(own)) if reorder else None
                keys.append(name)
                texts.append(own if other is None else own[other])
                total += len(own)
                if total >= BATCH_WORDS:
                    yield settle(keys, texts, vocabulary)
                    keys, texts, total, vocabulary = [], [], 0, _fresh()
            if keys:
                yield settle(keys, texts, vocabulary)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, "
             "collapsed string")


def _fresh():
    """Words numbered in the order in which they come."""
    vocabulary = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    return vocabulary


def planted(doc_id, n):
    """Word numbers of a document whose tail repeats: one in ten, by the checksum of its id."""
    if doc_id is None or not n:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    at = g % n
    period = 1 + (n - at) // (3 + g % 8)
    words = np.arange(n)
    words[at:] = at + (words[at:] - at) % period
    return words


def op11_runs(spark, sf_dir) -> DataFrame:
    found = collapse_runs(table(spark, sf_dir, "documents"), reorder=planted)
    # Lengths times periods of two runs compare their length/period as whole numbers.
    best = F.expr("""aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (a, r) ->
        case when a is null or r.length * a.period > a.length * r.period then r else a end)""")
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\\n'), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
