"""Near-duplicate texts by the Jaccard similarity of their word shingles.

Texts whose sets of ``SHINGLE`` consecutive words have a similarity of ``SIMILAR`` or more are
linked. Candidates share one of ``BANDS`` keys of ``ROWS`` minimum hashes each; every candidate
is then compared exactly, so no pair under the bound is linked, and a pair at the bound shares
no key with probability (1 - 0.8^3)^16, about 1e-5 (at 0.9: 8e-10).

Groups with one key that hold more than ``BUCKET_SHINGLES`` shingles are cut into chunks,
and every two chunks are compared in a task of their own: nothing is left out, but the work
of a hot group grows with the square of its different sets. Equal sets are merged before.

Defined cases: texts of less than ``SHINGLE`` words are one shingle; null and empty texts are
equal; a shingle counts once, however often it occurs; letters are compared in lower case.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, components, spanning_links, word_blocks

SHINGLE, SIMILAR, BANDS, ROWS, SEED = 5, 0.8, 16, 3, 42
#: Keys of rows, 16 bytes each, that may go to every task.
SMALL_ROWS = 500_000
#: Shingles of the sets of one key compared in one task.
BUCKET_SHINGLES = 1 << 21
_RANDOM = np.random.default_rng(SEED)
_TIMES = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles."""
    parts, tail, words = [], [], 0
    for block in word_blocks((text or "").encode().lower()):
        words += len(block)
        tail += block
        hashes = b"".join([xxhash.xxh64_digest(b"%b %b %b %b %b" % t, SEED)
                           for t in zip(*[tail[i:] for i in range(SHINGLE)])])
        parts.append(np.unique(np.frombuffer(hashes, np.uint64)))
        if len(tail) >= SHINGLE:
            tail = tail[1 - SHINGLE:]
    if words < SHINGLE:
        return np.frombuffer(xxhash.xxh64_digest(b" ".join(tail), SEED), np.uint64)
    return np.unique(np.concatenate(parts))


def bands(hashes: np.ndarray) -> np.ndarray:
    """Key of every band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 14):
        mixed = hashes[at:at + (1 << 14)] * _TIMES + _PLUS
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(1))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), SEED) for b in least.reshape(BANDS, ROWS)], np.uint64)


def sketches(docs: DataFrame, keys, extra=None) -> DataFrame:
    """``keys, fp, size, bands``: number, shingles and band keys of the set of every text.

    ``extra`` may give a further 64-bit number of every text, column ``extra``.
    """
    keys = list(keys)
    source = docs.select(*keys, "text")
    names = ["fp", "size", "bands", *(["extra"] if extra else [])]

    def run(batches):
        for whole in batches:
            for start in range(0, len(whole), 256):
                b = whole.slice(start, 256)
                fps, sizes, own, more = [], [], [], []
                for t in b.column(len(keys)):
                    s = shingles(t.as_py())
                    fps.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                    sizes.append(len(s))
                    own.append(bands(s).view(np.int64))
                    more += [extra(t.as_py())] if extra else []
                out = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()),
                       pa.array(own, pa.list_(pa.int64()))]
                out += [pa.array(np.array(more, np.uint64).view(np.int64))] if extra else []
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out], names=[*keys, *names])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])
    return source.mapInArrow(run, f"{schema}, fp long, size long, bands array<long>" + (", extra long" if extra else ""))


def similar_links(fps, marks):
    """Links ``(a, b)`` between indexes of similar sets, enough to join all of them."""
    sizes = np.array([len(m) for m in marks], np.int64)
    flat = np.unique(np.concatenate(marks), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    member = np.zeros(flat.max() + 1, bool)

    def close(i, others):
        own = flat[ends[i] - sizes[i]:ends[i]]
        member[own] = True
        both = np.add.reduceat(member[flat].astype(np.int64), ends - sizes)[others]
        member[own] = False
        # Whole numbers, so that a similarity of exactly the bound counts.
        return both * 10 >= round(10 * SIMILAR) * (sizes[i] + sizes[others] - both)
    return spanning_links(close, len(fps))


def _compare(batches):
    """Links inside each group of texts; the rows of a group follow each other, equal sets too."""
    key, fps, marks = None, [], []

    def settle():
        found = similar_links(fps, marks) if len(fps) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([fps[a] for a, _ in found], pa.int64()),
                                           pa.array([fps[b] for _, b in found], pa.int64())], names=["a", "b"])
    for batch in batches:
        for group, fp, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if group != key:
                if len(fps) > 1:
                    yield settle()
                key, fps, marks = group, [], []
            if not fps or fps[-1] != fp:
                fps.append(fp)
                marks.append(shingles(text.as_py()))
    if len(fps) > 1:
        yield settle()


def groups(prints: DataFrame, scratch: Scratch, bucket=BUCKET_SHINGLES) -> DataFrame:
    """``fp, group``: sets that share a band key, every different group once.

    Sets alike in many bands meet in as many groups, most of them the same; a group is
    known by the number and the mixed hashes of its members. A group of more than
    ``bucket`` shingles is cut into chunks of about half of that, and any two chunks
    are a group.
    """
    rows = scratch.write(prints.select("fp", "size", F.posexplode("bands").alias("t", "key")).distinct())
    first, second = F.xxhash64("fp"), F.xxhash64("fp", F.lit(1))
    sizes = rows.groupBy("t", "key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"), F.bit_xor(first).alias("x"),
        F.bit_xor(second).alias("y")).where("n > 1")
    whole = F.xxhash64("t", "key")
    once = sizes.groupBy("n", "shingles", "x", "y").agg(F.min_by("t", whole).alias("t"), F.min_by("key", whole).alias("key"))
    chunks = F.when(F.col("shingles") <= bucket, 1).otherwise(F.ceil(2 * F.col("shingles") / bucket)).cast("int")
    own = F.pmod(F.xxhash64("fp"), "chunks").cast("int")
    return (rows.join(once.withColumn("chunks", chunks).select("t", "key", "chunks"), ["t", "key"])
            .withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            # Pairs inside a chunk are met together with any other chunk.
            .where("chunks = 1 or own <> other")
            .select("fp", F.struct("t", "key", F.least("own", "other").alias("low"),
                                   F.greatest("own", "other").alias("high")).alias("group")))


def classes(docs: DataFrame, prints: DataFrame, scratch: Scratch, row="_row", bucket=BUCKET_SHINGLES) -> DataFrame:
    """``fp, root``: the component of every distinct set.

    ``prints`` are the sketches of ``docs`` under the key ``row``. Only texts of sets with a
    band key in common are read again, one text of every set; their shingles are made where
    they are compared, and never written.
    """
    texts = prints.groupBy("fp").agg(F.min(row).alias(row))
    wanted = scratch.write(groups(prints, scratch, bucket).join(texts, "fp"))
    some = scratch.write(wanted.select(row).distinct())
    source = docs.select(row, "text")
    if some.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:  # else all texts are shuffled
        source = source.join(F.broadcast(some), row, "left_semi")
    found = (source.join(wanted, row).select("group", "fp", "text")
             .repartition("group").sortWithinPartitions("group", "fp").mapInArrow(_compare, "a long, b long"))
    found = components(scratch.write(found), scratch)
    return prints.select("fp").distinct().join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"))
