"""Near-duplicate vectors through a forest of random-projection trees with spill.

Each tree halves a bounded sample by random directions until its leaves are small; of a few
random directions it takes the one with the fewest sample points near the cut. Every vector
then goes down every tree, and down both sides where it lies within the spill of a cut, so
one vector reaches several leaves. Vectors are compared within leaves, in double precision;
a pair counts in the first leaf it shares, so no pair counts twice. Leaves beyond
``BLOCK_ROWS`` are compared in pairs of blocks dealt over tasks. A task emits sums of links
per vector and at most one joining link per vector and block, never all pairs.

Equal vectors are merged first and carry their number.

The sample (``SAMPLE_ROWS`` vectors by smallest hash) only places the cuts; all vectors are
dealt and compared.

Defined cases: vectors that are null, empty, zero, of an unusual length or hold null or
non-finite parts link with nothing and are their own component; equal rows link with each
other; a null vec_id counts as a link but never names a component that has an id.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, components, spanning_links, table, usable_vectors, vectors

THRESHOLD, TREES, SAMPLE_ROWS, LEAF_ROWS, BLOCK_ROWS = 0.95, 4, 20000, 512, 1024
#: Half of the spill, in standard deviations of the projected gap of a pair at the threshold.
SPILL = 0.75


def units(column) -> np.ndarray:
    v = vectors(column)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


class Tree:
    """Cuts of one tree: direction, place and children (negative: leaf) per node."""

    def __init__(self, sample, leaf, margin, rng, first_leaf):
        self.directions, self.cuts, self.children, self.margin = [], [], [], margin
        self.leaves = first_leaf
        self.root = self._grow(sample, leaf, rng)

    def _leaf(self):
        self.leaves += 1
        return -self.leaves

    def _grow(self, points, leaf, rng):
        if len(points) <= leaf:
            return self._leaf()
        tries = rng.standard_normal((8, points.shape[1]))
        tries /= np.linalg.norm(tries, axis=1, keepdims=True)
        at = points @ tries.T
        middle = np.median(at, axis=0)
        near = (np.abs(at - middle) <= self.margin).sum(0)
        best = int(near.argmin())
        if near[best] > 0.8 * len(points):  # one tight group: cutting only copies it
            return self._leaf()
        node = len(self.cuts)
        self.directions.append(tries[best])
        self.cuts.append(middle[best])
        self.children.append(None)
        side = at[:, best] - middle[best]
        self.children[node] = (self._grow(points[side <= self.margin], leaf, rng),
                               self._grow(points[side >= -self.margin], leaf, rng))
        return node

    def deal(self, points):
        """Index and leaf of every place where a point lands."""
        out, todo = [], [(self.root, np.arange(len(points)))]
        while todo:
            node, index = todo.pop()
            if not len(index):
                continue
            if node < 0:
                out.append((index, np.full(len(index), -node - 1)))
                continue
            side = points[index] @ self.directions[node] - self.cuts[node]
            low, high = self.children[node]
            todo.append((low, index[side <= self.margin]))
            todo.append((high, index[side >= -self.margin]))
        return [np.concatenate(c) for c in zip(*out)]


def grow_forest(sample, total, trees, leaf_rows, threshold):
    margin = SPILL * np.sqrt((2 - 2 * threshold) / sample.shape[1])
    leaf = max(16, int(leaf_rows * len(sample) / max(1, total)))
    forest, rng = [], np.random.default_rng(5)
    for _ in range(trees):
        forest.append(Tree(sample, leaf, margin, rng, forest[-1].leaves if forest else 0))
    return forest


def _deal(forest, points):
    index, leaf = (np.concatenate(c) for c in zip(*[t.deal(points) for t in forest]))
    order = np.lexsort((leaf, index))
    return index[order], leaf[order]


def _block_links(own, block, weight, unit, leaves, leaf, threshold):
    """Link sums and joining links among the rows of one block or pair of blocks."""
    near = unit @ unit.T
    close = near >= threshold
    for i, j in zip(*np.nonzero(np.abs(near - threshold) < 1e-9)):  # too near to trust the product
        close[i, j] = (own[i] * own[j]).sum() / np.sqrt(
            (own[i] ** 2).sum() * (own[j] ** 2).sum()) >= threshold
    np.fill_diagonal(close, False)
    if len(np.unique(block)) > 1:
        close &= block[:, None] != block[None, :]  # the rest belongs to the blocks themselves
    if not close.any():
        return np.zeros(len(own), np.int64), []
    links = spanning_links(lambda i, others: close[i, others], len(own))
    busy = np.nonzero(close.any(1))[0]
    earlier = np.unique(np.concatenate([leaves[i] for i in busy]))
    earlier = earlier[earlier < leaf]
    if len(earlier):
        member = np.zeros((len(busy), len(earlier)), np.float32)
        for k, i in enumerate(busy):
            member[k] = np.isin(earlier, leaves[i])
        close[np.ix_(busy, busy)] &= ~(member @ member.T > 0)
    return close @ weight, links


def _compare(threshold):
    def run(batches):
        held, key = [], None

        def settle():
            cols = {c: [h[c] for h in held] for c in ("node", "copies", "block", "embedding", "leaves")}
            own = np.array(cols["embedding"], np.float64)
            unit = own / np.sqrt((own * own).sum(1, keepdims=True))
            counts, links = _block_links(own, np.array(cols["block"]), np.array(cols["copies"], np.int64),
                                         unit, [np.array(x) for x in cols["leaves"]], key[0], threshold)
            node = np.array(cols["node"], np.int64)
            some = np.nonzero(counts)[0]
            a = np.array([x for x, _ in links], int)
            b = np.array([x for _, x in links], int)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([node[some], node[a]])),
                 pa.array(np.concatenate([np.full(len(some), -1), node[b]])),
                 pa.array(np.concatenate([counts[some], np.zeros(len(a), np.int64)]))],
                names=["node", "other", "links"])
        for batch in batches:
            for r in batch.to_pylist():
                at = (r["leaf"], r["bi"], r["bj"])
                if at != key and held:
                    yield settle()
                    held = []
                key = at
                held.append(r)
        if held:
            yield settle()
    return run


def linked(vecs: DataFrame, threshold=THRESHOLD, trees=TREES, sample_rows=SAMPLE_ROWS,
           leaf_rows=LEAF_ROWS, block_rows=BLOCK_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vecs(vec_id, embedding)``."""
    spark = vecs.sparkSession
    scratch = Scratch(spark, "vectors")
    merged = usable_vectors(vecs).groupBy("embedding").agg(
        F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    merged = scratch.write(merged.withColumn("node", F.monotonically_increasing_id()))
    total = merged.count()
    sample = merged.select("embedding").orderBy(F.xxhash64("embedding")).limit(sample_rows).toArrow()
    if total:
        forest = grow_forest(units(sample.column(0).combine_chunks()), total, trees, leaf_rows, threshold)

        def sizes(batches):
            count = {}
            for b in batches:
                if len(b):
                    for leaf, n in zip(*np.unique(_deal(forest, units(b.column(0)))[1], return_counts=True)):
                        count[int(leaf)] = count.get(int(leaf), 0) + int(n)
            yield pa.RecordBatch.from_pydict({"leaf": pa.array(list(count), pa.int64()),
                                              "n": pa.array(list(count.values()), pa.int64())})
        # The forest is grown on the bounded sample, so its leaves are few.
        counted = (merged.select("embedding").mapInArrow(sizes, "leaf long, n long")
                   .groupBy("leaf").agg(F.sum("n").alias("n")).collect())
        blocks = {r["leaf"]: -(-r["n"] // block_rows) for r in counted}

        def deal(batches):
            for whole in batches:
                for at in range(0, len(whole), 512):
                    b = whole.slice(at, 512)
                    node = b.column(0).to_numpy()
                    index, leaf = _deal(forest, units(b.column(2)))
                    ends = np.searchsorted(index, np.arange(len(b) + 1))
                    own = [leaf[ends[i]:ends[i + 1]].tolist() for i in range(len(b))]
                    rows = []
                    for i, x in zip(index.tolist(), leaf.tolist()):
                        n = blocks[x]
                        mine = int(node[i]) * 2654435761 % (1 << 32) % n
                        rows += [(i, x, mine, min(mine, o), max(mine, o)) for o in range(n)]
                    i, x, mine, bi, bj = (np.array(c, np.int64) for c in zip(*rows))
                    take = pa.array(i)
                    yield pa.RecordBatch.from_arrays(
                        [*[c.take(take) for c in b.columns], pa.array(x), pa.array(mine), pa.array(bi),
                         pa.array(bj), pa.array([own[k] for k in i], pa.list_(pa.int64()))],
                        names=["node", "copies", "embedding", "leaf", "block", "bi", "bj", "leaves"])
        kind = vecs.schema["embedding"].dataType.simpleString()
        found = (merged.select("node", "copies", "embedding")
                 .mapInArrow(deal, f"node long, copies long, embedding {kind}, leaf long, block long, "
                                   "bi long, bj long, leaves array<long>")
                 .repartition("leaf", "bi", "bj").sortWithinPartitions("leaf", "bi", "bj")
                 .mapInArrow(_compare(threshold), "node long, other long, links long"))
        found = scratch.write(found)
    else:
        found = spark.createDataFrame([], "node long, other long, links long")
    roots = components(found.where("other >= 0").select(F.col("node").alias("a"), F.col("other").alias("b")),
                       scratch)
    links = found.where("other < 0").groupBy("node").agg(F.sum("links").alias("links"))
    named = scratch.write(merged.join(roots, "node", "left").join(links, "node", "left").select(
        "embedding", "low", F.coalesce("root", "node").alias("root"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(least, "root").select("embedding", "n_links", "component_id")
    out = vecs.select("vec_id", "embedding").join(named, "embedding", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_vector_dedup(spark, sf_dir) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))
