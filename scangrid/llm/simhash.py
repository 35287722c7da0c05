"""SimHash near-duplicates through covering locality-sensitive hashing.

Fingerprints of word shingles are linked when at most ``RADIUS`` bits differ. Bit i
carries a vector m(i) of RADIUS + 1 bits; for every nonzero vector v, table v keeps
the bits whose m(i) has odd overlap with v. Any RADIUS positions span less than the
whole space, so some v is orthogonal to all of them, and that table keeps none of the
differing bits: every pair within the radius collides in at least one table.

Defined cases: null and empty texts have fingerprint zero and are linked with each
other; repeated rows and repeated ids each give a row; a null doc_id never becomes a
component id unless its whole component is null; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import minhash
from .minhash import SMALL_ROWS
from .common import Scratch, components, spanning_links, table, word_blocks

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
#: Fingerprints of one bucket compared in one task; larger buckets go another way.
BUCKET_ROWS = 4096


def fingerprint(text: str | None) -> int:
    """Majority bits over the XXH64 of all shingles, repeats included."""
    ones, total, tail, words = np.zeros(BITS, np.int64), 0, [], 0
    for block in word_blocks((text or "").encode().lower()):
        words += len(block)
        tail += block
        for at in range(0, len(tail) - SHINGLE + 1, 1 << 16):
            part = tail[at:at + (1 << 16) + SHINGLE - 1]
            hashes = b"".join([xxhash.xxh64_digest(b"%b %b %b" % t, SEED)
                               for t in zip(part, part[1:], part[2:])])
            bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(0, dtype=np.int64)
            total += len(bits)
        if len(tail) >= SHINGLE:
            tail = tail[1 - SHINGLE:]
    if 0 < words < SHINGLE:
        digest = xxhash.xxh64_digest(b" ".join(tail), SEED)
        return int.from_bytes(digest, "big")
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, keys=("doc_id",)) -> DataFrame:
    """``keys, fp``: the fingerprint of every text as a signed long."""
    keys = list(keys)
    source = docs.select(*keys, "text")

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py()) for t in batch.column(len(keys))]
            signed = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(signed)], names=[*keys, "fp"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])
    return source.mapInArrow(run, f"{schema}, fp long")


def masks(bits=BITS, radius=RADIUS) -> list[int]:
    """Bit masks of the covering tables, as signed longs."""
    top = (1 << (radius + 1)) - 1
    vector = [1 + i % top for i in range(bits)]
    out = []
    for v in range(1, top + 1):
        mask = sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return out


def _pairs(batches):
    """Links inside each collected bucket."""
    for batch in batches:
        left, right = [], []
        for fps in batch.column(0):
            f = np.array(fps.as_py(), np.int64)
            links = spanning_links(
                lambda i, others, f=f: np.bitwise_count((f[others] ^ f[i]).view(np.uint64)) <= RADIUS,
                len(f))
            left += [int(f[a]) for a, _ in links]
            right += [int(f[b]) for _, b in links]
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())],
                                         names=["a", "b"])


def links(distinct: DataFrame, bucket_rows=BUCKET_ROWS) -> DataFrame:
    """``a, b``: enough links between the fingerprints ``fp`` to join all within the radius.

    Buckets up to ``bucket_rows`` are compared inside a task. In larger ones two
    fingerprints within two bits share a midpoint one flip away from both, and all
    that share a midpoint are linked; only free bits of the table can differ, so a
    midpoint row per free bit and fingerprint is enough, whatever the bucket's size.
    """
    keep = masks()
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                       for i, m in enumerate(keep)])
    rows = distinct.select("fp", F.explode(tables).alias("b")).select("fp", "b.t", "b.key")
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = rows.join(sizes, ["t", "key"])
    small = (shared.where(F.col("n") <= bucket_rows).groupBy("t", "key")
             .agg(F.collect_list("fp").alias("fps")).select("fps")
             .mapInArrow(_pairs, "a long, b long"))
    flips = F.create_map(*[x for i, m in enumerate(keep) for x in (F.lit(i), F.array(
        F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(BITS) if not m >> b & 1]))])
    middle = (shared.where(F.col("n") > bucket_rows)
              .select("fp", "t", "key", F.explode(flips[F.col("t")]).alias("flip"))
              .select("fp", "t", "key", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid")))
    low = middle.groupBy("t", "key", "mid").agg(F.min("fp").alias("b"))
    large = middle.join(low, ["t", "key", "mid"]).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return small.unionByName(large.distinct())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def classes(prints: DataFrame, scratch: Scratch, bucket_rows=BUCKET_ROWS) -> DataFrame:
    """``fp, root``: the component of every distinct fingerprint; copies are merged first."""
    distinct = scratch.write(prints.select("fp").distinct())
    found = components(links(distinct, bucket_rows), scratch)
    return distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, bucket_rows=BUCKET_ROWS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(fingerprints(docs))
    rooted = scratch.write(classes(prints, scratch, bucket_rows))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("low")).join(rooted, "fp")
    ids = least.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def _joined(prints: DataFrame, similar: DataFrame, scratch: Scratch) -> DataFrame:
    """``fp, root``: the classes ``similar(fp, root)``, joined where fingerprints are linked.

    ``prints(fp, extra)`` has the fingerprint of every text as ``extra``. The classes under one
    component of fingerprints are linked with the smallest of them.
    """
    near = classes(prints.select(F.col("extra").alias("fp")), scratch).select(
        F.col("fp").alias("extra"), F.col("root").alias("component"))
    met = scratch.write(prints.select("fp", "extra").distinct().join(near, "extra").join(similar, "fp")
                        .select("component", "root").distinct())
    least = met.groupBy("component").agg(F.min("root").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = components(met.join(least, "component").select(F.col("root").alias("a"), "b"), scratch)
    further = found.select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return similar.join(further, "root", "left").select("fp", F.coalesce("_to", "root").alias("root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with one document of every group of similar texts, the smallest id.

    Similar is what op7's fingerprints link. As those join only almost identical texts, what
    ``minhash`` links is similar too; groups are the components over both kinds of links.
    Rows without an id come last; of rows equal in every column one stays.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.select(F.struct(*columns).alias("doc"), "doc_id", "text", F.xxhash64(*columns).alias("_row"))
    prints = scratch.write(minhash.sketches(marked, ("doc_id", "_row"), fingerprint))
    similar = scratch.write(minhash.classes(marked, prints, scratch))
    rooted = scratch.write(_joined(prints, similar, scratch))
    keep = (prints.join(rooted, "fp").groupBy("root")
            .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("k"))
            .select(F.col("k.doc_id").alias("_id"), F.col("k._row").alias("_row")).distinct())
    copies = (prints.groupBy(F.col("doc_id").alias("_id"), "_row")
              .agg((F.count(F.lit(1)) > 1).alias("_many")))
    same = [F.col("l._row") == F.col("r._row"), F.col("l._id").eqNullSafe(F.col("r._id"))]
    keep = scratch.write(keep.alias("l").join(copies.alias("r"), same).select("l._id", "l._row", "_many"))

    def among(left, right, how):
        """Rows whose id and hash are in ``right(_id, _row)``, or are not."""
        return left.alias("d").join(right.alias("k"), [
            F.col("d._row") == F.col("k._row"), F.col("d.doc_id").eqNullSafe(F.col("k._id"))], how)
    gone = scratch.write(among(prints.select("doc_id", "_row").distinct(), keep, "left_anti")
                         .select(F.col("doc_id").alias("_id"), "_row"))
    twice = keep.where("_many")
    if gone.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS and twice.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        # Few rows go: every task knows them, and documents stay where they are.
        kept = among(marked, F.broadcast(gone), "left_anti")
        single = among(kept, F.broadcast(twice), "left_anti")
        many = among(kept, F.broadcast(twice), "left_semi")
        scratch.drop_others(keep, gone)
    else:
        kept = among(marked, keep, "inner")
        single, many = (kept.where(c).select("d.doc", "d.doc_id", "d._row") for c in ("not _many", "_many"))
        scratch.drop_others(keep)
    many = many.dropDuplicates(["_row", "doc_id"])
    return single.select("doc.*").unionByName(many.select("doc.*"))


def op7_simhash(spark, sf_dir) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")
