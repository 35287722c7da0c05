"""Helpers shared by the training-data operators."""
from __future__ import annotations

import gc
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes that travel to a Python worker at once; a longer row is a batch of its own.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes unless the session already does.

    By rows alone 10,000 documents are one batch, which the executor and its Python
    workers hold several times over.
    """
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


class Scratch:
    """Intermediate tables as Parquet in the shared folder of ``spark.checkpoint.dir``.

    A table written here cuts the lineage and survives lost executors. It lives as
    long as the checkpoint folder, unless ``drop`` removes it earlier.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            ensure_checkpoint_dir(spark)
            base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
        self.spark = spark
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths = {}

    def write(self, df: DataFrame, *by: str) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.partitionBy(*by).parquet(path)
        # Shuffle files of the finished phase go once the driver has no reference to them.
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Remove tables that no result reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for frame in frames:
            _, path = self.paths.pop(id(frame))
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)

    def drop_others(self, *kept: DataFrame) -> None:
        """Remove all tables but those that a result still reads."""
        for frame, _ in [*self.paths.values()]:
            if not any(frame is k for k in kept):
                self.drop(frame)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; one root per connected component.

    Every round points each node at the smallest of itself and its neighbours and
    contracts the edges to those, which at least halves the nodes that still have
    edges. The pointers of the rounds are then chained. Joins are plain shuffle
    joins on node ids, so a node with very many edges is split at run time.
    """
    live = scratch.write(edges.where("a <> b").select("a", "b").distinct())
    levels = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
                            .select("node", F.least("node", "b").alias("to")))
        levels.append(low)
        moved = (live.join(low.select(F.col("node").alias("a"), F.col("to").alias("u")), "a")
                 .join(low.select(F.col("node").alias("b"), F.col("to").alias("v")), "b")
                 .where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct())
        following = scratch.write(moved)
        scratch.drop(live)
        live = following
    if not levels:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = levels.pop().withColumnRenamed("to", "root")
    while levels:
        step = levels.pop()
        further = roots.select(F.col("node").alias("to"), "root")
        roots = step.join(further, "to", "left").select(
            "node", F.coalesce("root", "to").alias("root"))
    return scratch.write(roots)


def spanning_links(close, count: int):
    """Links ``(new, from)`` that join everything within reach inside a small group.

    ``close(i, others)`` tells which of ``others`` (indexes) are linked with ``i``.
    At most ``count - 1`` links come out, however dense the group is.
    """
    todo = np.arange(count)
    out = []
    while len(todo):
        queue, todo = [todo[0]], todo[1:]
        while queue and len(todo):
            at = queue.pop()
            hit = close(at, todo)
            for new in todo[hit]:
                out.append((new, at))
                queue.append(new)
            todo = todo[~hit]
    return out


def word_blocks(data: bytes, size=1 << 22):
    """Words of a text, a block of it at a time, so that a long text is never one list."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
                end += 1
        yield data[at:end].split()
        at = end


def vectors(column) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths as one matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable_vectors(df: DataFrame, key="vec_id", vector="embedding") -> DataFrame:
    """``key, embedding`` of vectors that can be compared by cosine.

    Left out: null, empty or zero vectors, those holding null or non-finite parts,
    and those of another length than the most frequent one (ties: the shorter).
    """
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    fine = df.select(F.col(key), v.alias("embedding")).where(
        v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0))
    lengths = fine.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    best = lengths.orderBy(F.desc("n"), "d").limit(1).collect()
    return fine.where(F.size("embedding") == (best[0]["d"] if best else 0))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight=None, ridge=1e-2, rounds=50):
    """Function from feature rows to probabilities; Newton steps on standardised columns."""
    weight = np.ones(len(y)) if weight is None else weight
    mean, scale = x.mean(0), x.std(0) + 1e-9

    def design(rows):
        return np.concatenate([np.ones((len(rows), 1)), (rows - mean) / scale], axis=1)
    z, w = design(x), np.zeros(x.shape[1] + 1)
    penalty = ridge * np.eye(len(w))
    for _ in range(rounds):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty,
                               z.T @ (weight * (y - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return lambda rows: sigmoid(design(rows) @ w)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
