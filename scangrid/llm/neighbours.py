"""Nearest neighbours by cosine: stable projections, a kd-tree and a chi-square test.

Unit vectors are projected on ``PROJECTIONS`` Gaussian directions. The squared projected
distance of two vectors is their squared distance times a chi-square variable, so once the
projected distances still to come exceed the ``CONFIDENCE`` quantile times the squared
distance of the k-th best found, no nearer vector is expected and the search stops.

The projected space is cut by a kd-tree: upper cells are placed on a bounded sample
(``SAMPLE_ROWS`` vectors by smallest hash) and hold every vector; a cell is dealt over
shards of about ``SHARD_ROWS``, each with a kd-tree of its own. A query first visits its home
shard, which bounds its k-th distance, and then only cells within reach of the test. Shards
and queries meet by a shuffle; queries stream past a shard, so neither side is held whole.

Equal vectors are merged; of each the k + 1 smallest ids can appear in a result, so those
are kept. That is exact.

Defined cases: vectors that are null, empty, zero, of an unusual length or hold null or
non-finite parts take no part, nor do rows without an id; a row repeated with its id is one
candidate; a query never finds its own id; an empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import Scratch, table, usable_vectors, vectors

K, PROJECTIONS, CONFIDENCE = 5, 8, 0.97
SAMPLE_ROWS, SHARD_ROWS, CELLS, LEAF_ROWS = 20000, 8192, 256, 128


def chi_square_quantile(p: float, degrees: int) -> float:
    """Quantile for an even number of degrees, by bisection of the closed form."""
    def below(x):
        term, total = 1.0, 1.0
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        return 1 - np.exp(-x / 2) * total
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def projection(dim: int, m: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((dim, m))


class KdTree:
    """Median cuts along the widest side; ``cell`` numbers the leaves."""

    def __init__(self, points, leaves):
        self.cuts = []
        self.count = 0
        self.root = self._grow(points, leaves)

    def _grow(self, points, leaves):
        if leaves <= 1 or len(points) < 2:
            self.count += 1
            return -self.count
        axis = int(np.ptp(points, axis=0).argmax())
        cut = float(np.median(points[:, axis]))
        right = points[:, axis] > cut
        if not right.any():
            self.count += 1
            return -self.count
        node = len(self.cuts)
        self.cuts.append(None)
        self.cuts[node] = (axis, cut, self._grow(points[~right], leaves // 2),
                           self._grow(points[right], leaves - leaves // 2))
        return node

    def cell(self, points):
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, index = todo.pop()
            if node < 0:
                out[index] = -node - 1
                continue
            axis, cut, low, high = self.cuts[node]
            right = points[index, axis] > cut
            todo += [(low, index[~right]), (high, index[right])]
        return out


class Shard:
    """Vectors of one shard under their kd-tree."""

    def __init__(self, node, low, own, project, leaf_rows):
        norm = np.sqrt((own * own).sum(1))
        at = (own / norm[:, None]) @ project
        tree = KdTree(at, max(1, -(-len(own) // leaf_rows)))
        cell = tree.cell(at)
        order = np.argsort(cell, kind="stable")
        self.node, self.low, self.own, self.norm, self.at = (
            x[order] for x in (node, low, own, norm, at))
        self.ends = np.searchsorted(cell[order], np.arange(tree.count + 1))
        full = [i for i in range(tree.count) if self.ends[i] < self.ends[i + 1]]
        self.leaves = [(self.ends[i], self.ends[i + 1]) for i in full]
        self.box0 = np.array([self.at[a:b].min(0) for a, b in self.leaves])
        self.box1 = np.array([self.at[a:b].max(0) for a, b in self.leaves])

    def search(self, own, norm, at, bound, k, quantile):
        """Index and score of the k best, nearest first; ``bound``: squared distance to beat."""
        gap = np.maximum(0, np.maximum(self.box0 - at, at - self.box1))
        least = (gap * gap).sum(1)
        index, score = np.empty(0, np.int64), np.empty(0)
        for leaf in np.argsort(least, kind="stable"):
            if least[leaf] > quantile * bound:
                break
            a, b = self.leaves[leaf]
            away = self.at[a:b] - at
            pick = a + np.nonzero((away * away).sum(1) <= quantile * bound)[0]
            got = (self.own[pick] * own).sum(1) / (self.norm[pick] * norm)
            index, score = np.concatenate([index, pick]), np.concatenate([score, got])
            if len(score) > k:
                best = np.lexsort((self.low[index], -score))[:k]
                index, score = index[best], score[best]
            if len(score) == k:
                bound = min(bound, max(0.0, 2 - 2 * score.min()) + 1e-12)
        best = np.lexsort((self.low[index], -score))
        return index[best], score[best]


def _search(project, k, quantile, leaf_rows):
    """Rows arrive by shard, its vectors before its queries."""
    def run(batches):
        key, held, shard = None, [], None
        for whole in batches:
            cell, sub, query = (whole.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            change = np.nonzero((np.diff(cell) != 0) | (np.diff(sub) != 0) | (np.diff(query) != 0))[0] + 1
            ends = [0, *change.tolist(), len(whole)]
            out = ([], [], [])
            for a, b in zip(ends, ends[1:]):
                if a == b:
                    continue
                if (cell[a], sub[a]) != key:
                    key, held, shard = (cell[a], sub[a]), [], None
                part = whole.slice(a, b - a)
                node, low = part.column(3).to_numpy(), part.column(4).to_numpy()
                own, bound = vectors(part.column(5)), part.column(6).to_numpy()
                if not query[a]:
                    held.append((node, low, own))
                    continue
                if held:
                    shard = Shard(*(np.concatenate(c) for c in zip(*held)), project, leaf_rows)
                    held = []
                if shard is None:
                    continue
                norm = np.sqrt((own * own).sum(1))
                at = (own / norm[:, None]) @ project
                for i in range(len(own)):
                    index, score = shard.search(own[i], norm[i], at[i], bound[i], k, quantile)
                    out[0].append(np.full(len(index), node[i]))
                    out[1].append(shard.node[index])
                    out[2].append(score)
            cols = [np.concatenate(c) if c else np.empty(0) for c in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2])],
                names=["query", "node", "score"])
    return run


def nearest(vecs: DataFrame, is_query, k=K, projections=PROJECTIONS, confidence=CONFIDENCE,
            sample_rows=SAMPLE_ROWS, shard_rows=SHARD_ROWS, cells=CELLS, leaf_rows=LEAF_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest other rows of every query row."""
    spark = vecs.sparkSession
    scratch = Scratch(spark, "neighbours")
    fine = usable_vectors(vecs).where("vec_id is not null").distinct()
    order = W.partitionBy("embedding").orderBy("vec_id")
    merged = (fine.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
              .groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    merged = scratch.write(merged.withColumn("node", F.monotonically_increasing_id()))
    total = merged.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = scratch.write(fine.where(is_query).join(merged.select("embedding", "node"), "embedding")
                          .select(F.col("vec_id").alias("query_id"), "node"))
    sample = vectors(merged.select("embedding").orderBy(F.xxhash64("embedding")).limit(sample_rows)
                     .toArrow().column(0).combine_chunks())
    project = projection(sample.shape[1], projections)
    quantile = chi_square_quantile(confidence, projections)
    unit = sample / np.sqrt((sample * sample).sum(1, keepdims=True))
    tree = KdTree(unit @ project, min(cells, -(-total // shard_rows)))

    def place(batches):
        for b in batches:
            v = vectors(b.column(2)) if len(b) else np.zeros((0, len(project)))
            at = (v / np.sqrt((v * v).sum(1, keepdims=True))) @ project
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(tree.cell(at)), *[pa.array(at[:, i]) for i in range(projections)]],
                names=[*b.schema.names, "cell", *[f"y{i}" for i in range(projections)]])
    kind = vecs.schema["embedding"].dataType.simpleString()
    ys = [f"y{i}" for i in range(projections)]
    placed = scratch.write(merged.select("node", F.col("ids")[0].alias("low"), "embedding").mapInArrow(
        place, f"node long, low long, embedding {kind}, cell long, " + ", ".join(f"{y} double" for y in ys)))
    # One row per upper cell, of which there are at most ``cells``.
    boxes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[F.min(y).alias(f"a{y}") for y in ys],
                                       *[F.max(y).alias(f"b{y}") for y in ys]).orderBy("cell").collect()
    box0 = np.array([[r[f"a{y}"] for y in ys] for r in boxes])
    box1 = np.array([[r[f"b{y}"] for y in ys] for r in boxes])
    cell_of = np.array([r["cell"] for r in boxes])
    subs = np.array([-(-r["n"] // shard_rows) for r in boxes])
    shards = F.create_map(*[F.lit(int(x)) for p in zip(cell_of, subs) for x in p])
    sub = F.pmod(F.xxhash64("node"), shards[F.col("cell").cast("int")]).cast("long")
    data = placed.select("cell", sub.alias("sub"), F.lit(0).alias("query"), "node", "low", "embedding",
                         F.lit(0.0).alias("bound"))
    queries = placed.join(asked.select("node").distinct(), "node", "left_semi")
    look = _search(project, k + 1, quantile, leaf_rows)

    def meet(asking):
        return (data.unionByName(asking).repartition("cell", "sub")
                .sortWithinPartitions("cell", "sub", "query")
                .mapInArrow(look, "query long, node long, score double"))
    home = queries.select("cell", sub.alias("sub"), F.lit(1).alias("query"), "node", "low", "embedding",
                          F.lit(4.0).alias("bound"))
    first = meet(home).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
    bound = F.when(F.col("n") > k, F.greatest(F.lit(0.0), 2 - 2 * F.col("worst")) + 1e-12).otherwise(4.0)
    bounded = queries.join(first.withColumnRenamed("query", "node"), "node", "left").select(
        "node", "low", "embedding", F.coalesce(bound, F.lit(4.0)).alias("bound"),
        F.array(*ys).alias("at"))

    def reach(batches):
        for whole in batches:
            for start in range(0, len(whole), 256):
                b = whole.slice(start, 256)
                at, limit = vectors(b.column(4)), b.column(3).to_numpy()
                gap = np.maximum(0, np.maximum(box0[None] - at[:, None], at[:, None] - box1[None]))
                i, c = np.nonzero((gap * gap).sum(2) <= quantile * limit[:, None])
                repeat = subs[c]
                i, c = np.repeat(i, repeat), np.repeat(c, repeat)
                s = np.concatenate([np.arange(n) for n in repeat]) if len(repeat) else np.empty(0, np.int64)
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell_of[c]), pa.array(s.astype(np.int64)), pa.array(np.ones(len(i), np.int32)),
                     *[b.column(n).take(take) for n in range(4)]],
                    names=["cell", "sub", "query", "node", "low", "embedding", "bound"])
    visits = bounded.mapInArrow(reach, f"cell long, sub long, query int, node long, low long, "
                                       f"embedding {kind}, bound double")
    hits = meet(visits).join(merged.select("node", "ids"), "node")
    best = W.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    hits = hits.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
    each = hits.select("query", "score", F.explode("ids").alias("id"))
    top = W.partitionBy("query").orderBy(F.desc("score"), "id")
    lists = (each.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= k + 1)
             .groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_n", "id", "score"))).alias("found")))
    lists = scratch.write(lists)
    named = asked.join(lists.withColumnRenamed("query", "node"), "node")
    own = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    return named.select("query_id", F.posexplode(own).alias("p", "x")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"),
        F.col("x.score").alias("score"))


def op1_neighbours(spark, sf_dir) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
