"""Exact substring deduplication by bucket-pointer refinement of sampled suffixes.

Every byte covered by a ``WINDOW``-byte string that also starts somewhere else goes.

* Sampling. Of the q-grams in a window, the smallest hash (leftmost of equal ones) is
  its anchor. Equal windows have their anchor at the same offset, so only the suffixes
  that start at anchors are sorted into buckets, about one in ``SPREAD / 2`` bytes.
* Initial buckets are q-grams. Buckets of one suffix hold no repeat.
* Refinement. A bucket is split by the identifier of all bytes that windows of its anchor
  can reach. Suffixes that stay together are repeats as a whole; the identifier settles
  them and they share one representative from then on. Identifiers are content hashes
  taken from running sums, so those of any later offset are a difference of two values
  that all refinement steps reuse.
* Only buckets that hold several different surroundings are refined further: by the
  identifiers of windows at every offset, inside one task where the bucket is small. In
  larger ones ranges of offsets are refined first: a range is settled when the string that
  spans all its windows is shared, dropped when the string common to them is not, and only
  the rest is refined by single offsets.

Identifiers are 64-bit and compared only within a q-gram bucket, that is 128 bits.

Defined cases: a null text is empty; a text shorter than the window loses nothing; equal
rows are copies of each other; a null doc_id is a document of its own; other columns are
ignored by ``spans``/``digest`` and kept by ``remove_repeats``.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructType

from .common import Scratch, table

WINDOW, QGRAM, WORD = 400, 64, 8
SPREAD = WINDOW - QGRAM + 1          # windows an anchor can serve
REACH = SPREAD - 1                   # bytes before an anchor that its windows reach
#: Different surroundings of one q-gram that are refined inside one task.
BUCKET_ROWS = 8192
#: Rows of one key that a join may gather in one task.
HOT_ROWS = 1 << 14
#: Ranges of offsets in larger buckets.
RANGES = 8
CHUNK = 1 << 16

_TABLES = {}


def _powers():
    """Powers of an odd base and of its inverse, modulo 2^64; made once per process."""
    if not _TABLES:
        base, count = 0x9E3779B97F4A7C15, CHUNK + 4 * WINDOW
        for i, b in enumerate((base, pow(base, -1, 1 << 64))):
            _TABLES[i] = np.cumprod(np.array([1] + [b] * count, np.uint64))
    return _TABLES


def _sums(data) -> np.ndarray:
    """Running sums from which the identifier of any substring follows.

    ``data``: one row of bytes, or a matrix of rows. The terms are mixed words of eight
    bytes, so equal sums come from equal bytes but for 64-bit accidents.
    """
    flat = np.ascontiguousarray(data)
    n = flat.shape[-1] - WORD + 1
    words = np.lib.stride_tricks.as_strided(
        flat, (*flat.shape[:-1], n, WORD), (*flat.strides, 1))
    g = np.ascontiguousarray(words).view("<u8")[..., 0]
    g = g * np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    g *= np.uint64(0x94D049BB133111EB)
    g ^= g >> np.uint64(29)
    g *= _powers()[0][:n]
    out = np.zeros((*flat.shape[:-1], n + 1), np.uint64)
    np.cumsum(g, axis=-1, out=out[..., 1:])
    return out


def _ids(sums, start, length):
    """Identifiers of the substrings at ``start`` (array) with ``length`` bytes (or an array)."""
    h = (sums[start + (length - WORD + 1)] - sums[start]) * _powers()[1][start]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(31))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(values)
    pad = np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)
    grid = np.concatenate([values, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def anchors(data: bytes):
    """``position, right, q-gram, surroundings`` of every anchor; empty below the window."""
    total = len(data)
    if total < WINDOW:
        return [np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64)]
    whole = np.frombuffer(data, np.uint8)
    found = []
    for at in range(0, total - WINDOW + 1, CHUNK):
        # Windows that start in [at, stop); their anchors reach REACH further.
        stop = min(at + CHUNK, total - WINDOW + 1)
        low, high = max(0, at - REACH), min(total, stop + REACH + WINDOW)
        sums = _sums(whole[low:high])
        grams = _ids(sums, np.arange(at - low, stop - low + REACH), QGRAM)
        index = np.arange(len(grams), dtype=np.uint64)
        low_bits = np.uint64((1 << 20) - 1)
        least = _least((grams & ~low_bits) | index, SPREAD) & low_bits
        first = np.concatenate([[True], least[1:] != least[:-1]])
        pick = least[first].astype(np.int64)
        pos = pick + at
        left, right = np.minimum(REACH, pos), np.minimum(WINDOW, total - pos)
        around = _ids(sums, pos - left - low, left + right)
        around ^= (left * 1024 + right).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        found.append((pos, right, grams[pick].view(np.int64), around.view(np.int64)))
    pos, right, gram, around = (np.concatenate(c) for c in zip(*found))
    once = np.concatenate([[True], pos[1:] != pos[:-1]])  # chunks may meet at one anchor
    return [pos[once], right[once], gram[once], around[once]]


def _keyed(docs: DataFrame) -> DataFrame:
    """``row`` tells documents apart; equal rows share it, and their removed spans."""
    return docs.withColumn("row", F.xxhash64("doc_id", "text"))


ANCHOR = "row long, doc_id {id}, pos long, right long, gram long, around long"


def _find_anchors(batches):
    for batch in batches:
        rows, parts = [], []
        for i, text in enumerate(batch.column(2)):
            got = anchors((text.as_py() or "").encode())
            rows.append(np.full(len(got[0]), i))
            parts.append(got)
        take = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64), pa.int64())
        cols = [pa.array(np.concatenate(c)) for c in zip(*parts)] if parts else [
            pa.array([], pa.int64())] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), *cols],
            names=["row", "doc_id", "pos", "right", "gram", "around"])


def _surroundings(batches):
    """Bytes that the windows of wanted anchors can reach, the anchor at a fixed column."""
    for batch in batches:
        out = {k: [] for k in ("gram", "copies", "row", "doc_id", "pos", "left", "right", "bytes", "large")}
        for row, doc_id, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            data = (text or "").encode()
            for w in wanted:
                pos = w["pos"]
                left, right = min(REACH, pos), min(WINDOW, len(data) - pos)
                for k, v in (("gram", w["gram"]), ("copies", w["copies"]), ("row", row),
                             ("doc_id", doc_id), ("pos", pos), ("left", left), ("right", right),
                             ("bytes", data[pos - left:pos + right]), ("large", w["large"])):
                    out[k].append(v)
        types = [pa.int64(), pa.int64(), pa.int64(), batch.schema.field(1).type, *[pa.int64()] * 3,
                 pa.binary(), pa.bool_()]
        for at in range(0, max(1, len(out["row"])), 4096):
            yield pa.RecordBatch.from_arrays(
                [pa.array(v[at:at + 4096], t) for v, t in zip(out.values(), types)],
                names=list(out))


def _matrix(left, blobs):
    grid = np.zeros((len(blobs), REACH + WINDOW), np.uint8)
    for i, (shift, blob) in enumerate(zip(left, blobs)):
        at = REACH - shift
        grid[i, at:at + len(blob)] = np.frombuffer(blob, np.uint8)
    return grid


def repeated_windows(left, right, blobs) -> np.ndarray:
    """For each member of a bucket and window offset: does another member hold the window?"""
    left, right, n = np.asarray(left), np.asarray(right), len(blobs)
    offset = np.arange(SPREAD)
    valid = (offset >= (REACH - left)[:, None]) & (offset + WINDOW <= (REACH + right)[:, None])
    span = WINDOW - WORD + 1
    ids = np.empty((n, SPREAD), np.uint64)
    for at in range(0, n, 1024):
        sums = _sums(_matrix(left[at:at + 1024], blobs[at:at + 1024]))
        ids[at:at + 1024] = (sums[:, span:span + SPREAD] - sums[:, :SPREAD]) * _powers()[1][:SPREAD]
    ids = np.where(valid, ids, np.arange(n, dtype=np.uint64)[:, None])
    out = np.zeros((n, SPREAD), bool)
    for at in range(0, SPREAD, max(1, (1 << 18) // n)):
        part = slice(at, at + max(1, (1 << 18) // n))
        order = np.argsort(ids[:, part], axis=0)
        ranked = np.take_along_axis(ids[:, part], order, 0)
        same = ranked[1:] == ranked[:-1]
        edge = np.zeros((1, ranked.shape[1]), bool)
        hit = np.concatenate([edge, same]) | np.concatenate([same, edge])
        np.put_along_axis(out[:, part], order, hit, 0)
    return out & valid


def _runs(flags: np.ndarray):
    """``row, first, last`` of every run of true values along the second axis."""
    wide = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    wide[:, 1:-1] = flags
    step = np.diff(wide, axis=1)
    row, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)
    return row, first, last - 1


SPAN = "row long, doc_id {id}, start long, stop long"


def _span_batch(rows, ids, pos, runs, kind):
    row, first, last = runs
    base = np.asarray(pos, np.int64)[row] - REACH if len(row) else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array([rows[i] for i in row], pa.int64()), pa.array([ids[i] for i in row], kind),
         pa.array(base + first), pa.array(base + last + WINDOW)],
        names=["row", "doc_id", "start", "stop"])


def _refine_small(batches):
    """Repeats inside buckets, which arrive whole and one after the other."""
    held, gram, kind = [], None, None

    def settle():
        keep = ["copies", "row", "doc_id", "pos", "left", "right", "bytes"]
        once = {(h["row"], h["doc_id"], h["pos"]): h for h in held}.values()  # equal rows
        c = {k: [h[k] for h in once] for k in keep}
        flags = repeated_windows(c["left"], c["right"], c["bytes"])
        flags &= np.array([n == 1 for n in c["copies"]])[:, None]  # copies are settled already
        return _span_batch(c["row"], c["doc_id"], c["pos"], _runs(flags), kind)
    for batch in batches:
        kind = batch.schema.field(3).type
        for r in batch.to_pylist():
            if r["gram"] != gram and held:
                yield settle()
                held = []
            gram = r["gram"]
            held.append(r)
    if held:
        yield settle()


def _range_keys(batches):
    """Per range of offsets: what all its windows share, and the string that spans them."""
    edges = np.linspace(0, SPREAD, RANGES + 1).astype(int)
    for batch in batches:
        d = batch.to_pydict()
        for at in range(0, len(d["row"]), 1024):
            part = slice(at, at + 1024)
            left, right = np.array(d["left"][part]), np.array(d["right"][part])
            sums = _sums(_matrix(left, d["bytes"][part]))
            out = []
            for k in range(RANGES):
                j0, j1 = int(edges[k]), int(edges[k + 1]) - 1
                some = (j1 >= REACH - left) & (j0 + WINDOW <= REACH + right)
                all_ = (j0 >= REACH - left) & (j1 + WINDOW <= REACH + right)
                core = (sums[:, j0 + WINDOW - WORD + 1] - sums[:, j1]) * _powers()[1][j1]
                whole = (sums[:, j1 + WINDOW - WORD + 1] - sums[:, j0]) * _powers()[1][j0]
                i = np.nonzero(some)[0]
                out.append((i, np.full(len(i), k), core[i].view(np.int64),
                            whole[i].view(np.int64), all_[i]))
            i, k, core, whole, full = (np.concatenate(c) for c in zip(*out))
            take = pa.array(i + at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n).take(take) for n in (0, 1, 2, 3, 4)]
                + [pa.array(k), pa.array(core), pa.array(whole, mask=~full)],
                names=["gram", "copies", "row", "doc_id", "pos", "range", "core", "whole"])


def _offset_keys(batches):
    """Identifier of every window of the ranges that are still open."""
    edges = np.linspace(0, SPREAD, RANGES + 1).astype(int)
    for batch in batches:
        d = batch.to_pydict()
        for at in range(0, len(d["row"]), 256):
            part = slice(at, at + 256)
            left, right = np.array(d["left"][part]), np.array(d["right"][part])
            sums = _sums(_matrix(left, d["bytes"][part]))
            take, offset, ids = [], [], []
            for i, ranges in enumerate(d["ranges"][part]):
                for k in ranges:
                    j = np.arange(max(edges[k], REACH - left[i]),
                                  min(edges[k + 1], REACH + right[i] - WINDOW + 1))
                    take.append(np.full(len(j), i + at))
                    offset.append(j)
                    ids.append((sums[i, j + WINDOW - WORD + 1] - sums[i, j]) * _powers()[1][j])
            pick = pa.array(np.concatenate(take), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(n).take(pick) for n in (0, 1, 2, 3, 4)]
                + [pa.array(np.concatenate(offset)), pa.array(np.concatenate(ids).view(np.int64))],
                names=["gram", "copies", "row", "doc_id", "pos", "offset", "id"])


def _refine_large(members: DataFrame, kind: str, scratch: Scratch) -> DataFrame:
    """Repeats inside buckets of any size, by counting identifiers across tasks."""
    head = f"gram long, copies long, row long, doc_id {kind}, pos long, "
    edges = np.linspace(0, SPREAD, RANGES + 1).astype(int)
    ranges = scratch.write(members.mapInArrow(_range_keys, head + "range long, core long, whole long"))
    cores = ranges.groupBy("gram", "range", "core").agg(F.sum("copies").alias("cores"),
                                                        F.count(F.lit(1)).alias("kinds"))
    wholes = ranges.where("whole is not null").groupBy("gram", "range", "whole").agg(
        F.sum("copies").alias("wholes"))
    judged = scratch.write(
        ranges.join(cores.where("kinds > 1"), ["gram", "range", "core"])
        .join(wholes, ["gram", "range", "whole"], "left").where("copies = 1")
        .select("gram", "row", "doc_id", "pos", "range", (F.coalesce("wholes", F.lit(0)) > 1).alias("done")))
    first = F.array(*[F.lit(int(e)) for e in edges[:-1]])[F.col("range")]
    last = F.array(*[F.lit(int(e) - 1) for e in edges[1:]])[F.col("range")]
    at = F.col("pos") - REACH
    settled = judged.where("done").select(
        "row", "doc_id", (at + first).alias("start"), (at + last + WINDOW).alias("stop"))
    # A settled member still is a partner in the ranges that stay open for others.
    busy = judged.where("not done").select("gram", "range").distinct()
    partner = ranges.join(busy, ["gram", "range"]).join(
        cores.where("kinds > 1").select("gram", "range", "core"), ["gram", "range", "core"])
    live = partner.groupBy("gram", "row", "doc_id", "pos").agg(F.collect_list("range").alias("ranges"))
    same = [F.col("l.doc_id").eqNullSafe(F.col("m.doc_id")),
            *[F.col(f"l.{c}") == F.col(f"m.{c}") for c in ("gram", "row", "pos")]]
    wanted = members.alias("m").join(live.alias("l"), same).select("m.*", "l.ranges")
    single = scratch.write(wanted.mapInArrow(_offset_keys, head + "offset long, id long"))
    many = single.groupBy("gram", "offset", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hits = single.where("copies = 1").join(many, ["gram", "offset", "id"]).select(
        "row", "doc_id", (at + F.col("offset")).alias("start"),
        (at + F.col("offset") + WINDOW).alias("stop"))
    return settled.unionByName(hits)


def _parts(rows: DataFrame, groups: DataFrame, keys, n: str, limit: int):
    """``rows`` of the ``groups(keys, n)`` over ``limit``, and those of the other groups.

    Groups over the limit are few, at most one in ``limit`` rows, and every task knows
    them: their rows stay where they are, so that no task gathers a whole group.
    """
    hot = F.broadcast(groups.where(F.col(n) > limit).select(*keys))
    rest = groups.where(F.col(n) <= limit).select(*keys)
    return rows.join(hot, keys, "left_semi"), rows.join(hot, keys, "left_anti").join(rest, keys, "left_semi")


def repeated_spans(docs: DataFrame, scratch: Scratch, bucket_rows=BUCKET_ROWS, hot_rows=HOT_ROWS) -> DataFrame:
    """``row, doc_id, spans``: all stretches (start, stop) of repeated windows per document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = _keyed(docs).select("row", "doc_id", "text")
    marks = scratch.write(keyed.where(F.octet_length("text") >= WINDOW)
                          .mapInArrow(_find_anchors, ANCHOR.format(id=kind)))
    # A bucket of one suffix holds no repeat, and most buckets do.
    repeated = scratch.write(marks.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    hot, rest = _parts(marks, repeated, ["gram"], "n", hot_rows)
    shared = scratch.write(hot.unionByName(rest).select(*marks.columns))
    scratch.drop(marks, repeated)
    kinds = shared.groupBy("gram", "around").agg(
        F.count(F.lit(1)).alias("copies"), F.min("row").alias("row"),
        F.min_by("doc_id", "row").alias("doc_id"), F.min_by("pos", "row").alias("pos"))
    kinds = scratch.write(kinds)
    crowd = scratch.write(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    hot, rest = _parts(shared, kinds.where("copies > 1"), ["gram", "around"], "copies", hot_rows)
    settled = hot.unionByName(rest)
    left = F.least(F.lit(REACH).cast("long"), "pos")
    settled = settled.where(left + F.col("right") >= WINDOW).select(
        "row", "doc_id", (F.col("pos") - left).alias("start"),
        (F.col("pos") + F.col("right")).alias("stop"))
    hot, rest = _parts(kinds, crowd, ["gram"], "kinds", bucket_rows)
    both = hot.withColumn("large", F.lit(True)).unionByName(rest.withColumn("large", F.lit(False)))
    wanted = both.groupBy("row", "doc_id").agg(F.collect_list(
        F.struct("gram", "copies", "pos", "large")).alias("wanted"))
    same = [F.col("d.row") == F.col("w.row"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))]
    texts = keyed.alias("d").join(wanted.alias("w"), same).select("d.row", "d.doc_id", "d.text", "w.wanted")
    members = scratch.write(texts.mapInArrow(
        _surroundings, f"gram long, copies long, row long, doc_id {kind}, pos long, left long, "
                       "right long, bytes binary, large boolean"), "large")
    small = (members.where("not large").drop("large").repartition("gram").sortWithinPartitions("gram")
             .mapInArrow(_refine_small, SPAN.format(id=kind)))
    spans = settled.unionByName(small)
    large = members.where("large").drop("large")
    if not large.isEmpty():
        large = large.dropDuplicates(["gram", "row", "doc_id", "pos"])
        spans = spans.unionByName(_refine_large(scratch.write(large), kind, scratch))
    found = scratch.write(spans.groupBy("row", "doc_id").agg(
        F.collect_list(F.struct("start", "stop")).alias("spans")))
    scratch.drop(shared, kinds, crowd, members)
    return found


def _merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of a list of stretches."""
    out = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


def _kept(data: bytes, runs) -> bytes:
    at, parts = 0, []
    for start, stop in runs:
        parts.append(data[at:start])
        at = stop
    return b"".join([*parts, data[at:]])


def _with_spans(docs: DataFrame, bucket_rows) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "suffix")
    spans = repeated_spans(docs, scratch, bucket_rows)
    same = [F.col("d.row") == F.col("s.row"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id"))]
    return _keyed(docs).alias("d").join(spans.alias("s"), same, "left").select("d.*", "s.spans")


def digest(docs: DataFrame, bucket_rows=BUCKET_ROWS) -> DataFrame:
    """Per document what was removed, and the SHA-256 of the rest."""
    def run(batches):
        for batch in batches:
            size, gone, count, sha = [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                data, runs = (text.as_py() or "").encode(), _merged(spans.as_py())
                size.append(len(data))
                gone.append(sum(b - a for a, b in runs))
                count.append(len(runs))
                sha.append(hashlib.sha256(_kept(data, runs)).hexdigest())
            longs = [pa.array(c, pa.int64()) for c in (size, gone, count)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *longs, pa.array(sha, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_spans(docs.select("doc_id", "text"), bucket_rows).select("doc_id", "text", "spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, bucket_rows=BUCKET_ROWS) -> DataFrame:
    """``docs`` with repeated bytes taken out of ``text`` and ``n_chars`` counted anew.

    A character that loses some of its bytes goes as a whole. Rows stay, even empty ones.
    """
    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(0), batch.column(1)):
                t, s = text.as_py(), spans.as_py()
                out.append(_kept(t.encode(), _merged(s)).decode(errors="ignore") if s else t)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.string())],
                                             names=["rest", "text"])
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")
    source = _with_spans(docs.select("doc_id", "text", rest), bucket_rows).select("text", "spans", "rest")
    out = source.mapInArrow(run, StructType([source.schema["rest"]]).add("text", StringType()))

    def column(c):
        if c == "text":
            return F.col("text")
        if c == "n_chars":
            return F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema[c].dataType).alias(c)
        return F.col(f"rest.`{c}`")
    return out.select(*map(column, docs.columns))


def op2_suffix_dedup(spark, sf_dir) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
