"""Vector codes: parts of a vector as numbers of codebook entries, found through a GNAT.

Components become whole numbers floor(scale * x). A vector is cut into consecutive parts;
each position has a codebook. Rounds assign every part to its nearest entry and move each
entry to the rounded-down mean of its parts. All of it is integer arithmetic, so neither
tasks nor their order change a result.

The nearest entry is searched in a geometric near-neighbour access tree over the entries:
a node's split points hold, for each child, the least and the greatest distance to the
child's entries. Once a query's distance to a split point is known, every child whose
distances lie farther off than the best entry so far is left out, by strict comparison with
all rounding against leaving it out; entries at the same distance therefore meet, and are
told apart as integers, then by number. Queries go down the tree a batch at a time.

A round is one pass over the vectors that sums per task, part and entry, and hands the
driver one row per part and entry. The codebooks go out with the next pass.

Defined cases: vectors that are null, empty or hold null or non-finite components are left
out, as are those of another length than the most frequent one (ties: the shorter); parts
of lengths that cannot be equal differ by one at most, the longer first; with fewer vectors
than entries the codebooks are smaller; equal ids are ordered by their vectors and null ids
come last; components beyond 2**62 count as that, and an error beyond 64 bits is null; an
empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Split points of a node, and entries that need no further node.
SPLITS, LEAF = 4, 4
#: Share by which distances are widened before anything is left out.
SLACK = 1e-12
WIDEST = 1 << 62


def narrow(width: int) -> int:
    """Squared distances of components below this fit 64 bits."""
    return int((2 ** 60 / max(1, width)) ** 0.5) // 2


def whole(rows: np.ndarray, scale=SCALE) -> np.ndarray:
    """floor(scale * x), as 64-bit integers or, where squares need more, Python's."""
    x = np.floor(rows * scale)
    if np.abs(x).max(initial=0) < narrow(x.shape[1]):
        return x.astype(np.int64)
    return np.array([[max(-WIDEST, min(WIDEST, int(c))) for c in r] for r in x], object)


def squares(a, b):
    gap = a - b
    return (gap * gap).sum(-1)


class Gnat:
    """Tree over integer entries; ``numbers`` are the entries' numbers in the codebook."""

    def __init__(self, entries: np.ndarray, numbers=None):
        numbers = np.arange(len(entries)) if numbers is None else numbers
        self.entries, self.numbers, self.children = entries, numbers, None
        if len(numbers) <= LEAF:
            return
        at = self._spread(entries)
        rest = np.setdiff1d(np.arange(len(numbers)), at)
        gap = np.sqrt(squares(entries[:, None], entries[at][None]).astype(float))
        home = gap[rest].argmin(1)
        self.split, self.split_number = entries[at], numbers[at]
        groups = [rest[home == j] for j in range(len(at))]
        self.children = [Gnat(entries[g], numbers[g]) for g in groups]
        # Distances from split point i to the entries below child j.
        self.low = np.array([[gap[g, i].min(initial=np.inf) for g in groups] for i in range(len(at))])
        self.high = np.array([[gap[g, i].max(initial=-np.inf) for g in groups] for i in range(len(at))])

    @staticmethod
    def _spread(entries):
        """Split points far from each other, beginning with the first entry."""
        at = [0]
        near = squares(entries, entries[0])
        for _ in range(SPLITS - 1):
            near[at[-1]] = -1
            at.append(int(near.argmax()))
            near = np.minimum(near, squares(entries, entries[at[-1]]))
        return at

    def search(self, rows, best=None, number=None, index=None):
        """Number of the nearest entry of each row and the squared distance."""
        if best is None:
            best = squares(rows, self.entries[0]) if len(self.entries) else None
            number = np.full(len(rows), int(self.numbers[0]))
            index = np.arange(len(rows))
        if self.children is None:
            for entry, mine in zip(self.entries, self.numbers):
                self._meet(rows, index, entry, mine, best, number)
            return number, best
        open_ = np.ones((len(index), len(self.children)), bool)
        for i, (entry, mine) in enumerate(zip(self.split, self.split_number)):
            far = np.sqrt(self._meet(rows, index, entry, mine, best, number).astype(float))
            reach = np.sqrt(best[index].astype(float)) * (1 + SLACK)
            with np.errstate(invalid="ignore"):
                open_ &= far[:, None] * (1 - SLACK) - self.high[i] * (1 + SLACK) <= reach[:, None]
                open_ &= self.low[i] * (1 - SLACK) - far[:, None] * (1 + SLACK) <= reach[:, None]
        for j, child in enumerate(self.children):
            if open_[:, j].any():
                child.search(rows, best, number, index[open_[:, j]])
        return number, best

    @staticmethod
    def _meet(rows, index, entry, mine, best, number):
        gap = squares(rows[index], entry)
        better = (gap < best[index]) | ((gap == best[index]) & (mine < number[index]))
        best[index[better]], number[index[better]] = gap[better], mine
        return gap


def usable(vecs: DataFrame, vector="embedding") -> DataFrame:
    """Rows whose vector can be coded."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vecs.where(v.isNotNull() & (F.size(v) > 0) & ~bad)


def _edges(width, parts):
    return np.cumsum([0, *(len(p) for p in np.array_split(np.arange(width), parts))])


def _rows(column):
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class Codebooks:
    def __init__(self, books, edges):
        self.books, self.edges = books, edges
        self.trees = [Gnat(b) for b in books]

    def assign(self, rows):
        """Entry number per row and part, and the squared distances."""
        found = [tree.search(rows[:, a:b]) for tree, a, b in zip(self.trees, self.edges, self.edges[1:])]
        return np.stack([n for n, _ in found], 1), np.stack([d for _, d in found], 1)

    def sha256(self):
        text = ",".join(str(int(c)) for book in self.books for entry in book for c in entry)
        return hashlib.sha256(text.encode()).hexdigest()

    def moved(self, sums):
        """Entries at the rounded-down means of ``part, entry, n, totals`` rows; others stay."""
        books = [b.copy() for b in self.books]
        for r in sums:
            mean = [int(t) // r["n"] for t in r["totals"]]
            book = books[r["part"]]
            if book.dtype != object and any(abs(m) >= narrow(int(self.edges[-1])) for m in mean):
                books[r["part"]] = book = book.astype(object)
            book[r["entry"]] = mean
        return Codebooks(books, self.edges)


def _sums(books: Codebooks, scale):
    def run(batches):
        count, total = {}, {}
        for batch in batches:
            if not len(batch):
                continue
            rows = whole(_rows(batch.column(0)), scale)
            numbers, _ = books.assign(rows)
            for p, (a, b) in enumerate(zip(books.edges, books.edges[1:])):
                for e in np.unique(numbers[:, p]):
                    own = rows[numbers[:, p] == e, a:b]
                    key = (p, int(e))
                    count[key] = count.get(key, 0) + len(own)
                    # Python's integers: a task's sums may need more than 64 bits.
                    total[key] = total.get(key, 0) + own.sum(0).astype(object)
        keys = [*count]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
             pa.array([count[k] for k in keys], pa.int64()),
             pa.array([[Decimal(int(t)) for t in total[k]] for k in keys], pa.list_(pa.decimal128(38, 0)))],
            names=["part", "entry", "n", "totals"])
    return run


def fit(vecs: DataFrame, key="vec_id", parts=PARTS, entries=ENTRIES, rounds=ROUNDS, scale=SCALE):
    """Codebooks of ``embedding`` after all rounds; None for an empty table."""
    first = vecs.select(key, "embedding").orderBy(F.col(key).asc_nulls_last(), "embedding").limit(entries)
    start = np.array([r["embedding"] for r in first.collect()], float)
    if not len(start):
        return None
    edges = _edges(start.shape[1], parts)
    start = whole(start, scale)
    books = Codebooks([start[:, a:b] for a, b in zip(edges, edges[1:])], edges)
    for _ in range(rounds):
        partial = vecs.select("embedding").mapInArrow(
            _sums(books, scale), "part int, entry int, n long, totals array<decimal(38,0)>")
        sums = (partial.select("part", "entry", "n", F.posexplode("totals").alias("place", "t"))
                .groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
                .groupBy("part", "entry").agg(F.first("n").alias("n"), F.array_sort(
                    F.collect_list(F.struct("place", "t"))).getField("t").alias("totals")))
        books = books.moved(sums.collect())
    return books


def encode(vecs: DataFrame, books: Codebooks, key="vec_id", others=(), scale=SCALE) -> DataFrame:
    """``vec_id, others, code, error``: entry numbers of all parts (array) and summed squared distance."""
    def run(batches):
        for batch in batches:
            rows = whole(_rows(batch.column(0)), scale) if len(batch) else np.zeros((0, 0))
            if not len(batch):
                continue
            numbers, gaps = books.assign(rows)
            error = [int(e) if e < 2 ** 63 else None for e in gaps.astype(object).sum(1)]
            code = pa.FixedSizeListArray.from_arrays(
                pa.array(numbers.ravel(), pa.int32()), numbers.shape[1]).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], code, pa.array(error, pa.int64())],
                names=[*batch.schema.names[1:], "code", "error"])
    kept = [key, *others]
    kinds = ", ".join(f"`{c}` {vecs.schema[c].dataType.simpleString()}" for c in kept)
    return vecs.select("embedding", *kept).mapInArrow(run, f"{kinds}, code array<int>, error long")


def compress(vecs: DataFrame, key="vec_id", others=(), parts=PARTS, entries=ENTRIES, rounds=ROUNDS,
             scale=SCALE):
    """Codes of all usable vectors, and the codebooks they refer to."""
    vecs = usable(vecs)
    sizes = vecs.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), "d").limit(1).collect()
    vecs = vecs.where(F.size("embedding") == (common[0]["d"] if common else 0))
    books = fit(vecs, key, parts, entries, rounds, scale)
    if books is None:
        books = Codebooks([], np.zeros(1, int))
    return encode(vecs, books, key, others, scale), books


def op12_codes(spark, sf_dir) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"), others=["label"])
    coded = Scratch(spark, "codes").write(coded)
    label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    same = coded["label"].eqNullSafe(label["label"])
    return coded.join(label, same).select(
        "vec_id", F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"),
        "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
