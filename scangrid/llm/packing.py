"""Packing token sequences as vector bins with the dot-product heuristic.

A bin has simultaneous limits on tokens, segments and loss-bearing tokens. The bin under
construction takes, of the pieces that fit into what is left of it, the one whose demand
has the largest weighted dot product with that rest; a limit's weight is the mean demand
on it. When nothing fits whole, a piece is cut at the largest prefix that does. Pieces
longer than a bin are cut into full bins first.

Each task packs its own rows with a pool of ``POOL`` pieces, so there is no shuffle and
memory does not grow with the input. A bin that cannot be filled (at the end of a task, or
by the limits on segments or loss) is split at powers of two, which need no padding.

Defined cases: null and empty texts are one end id; repeated rows and ids are packed each;
items with no ids give no piece; other columns are ignored.
"""
from __future__ import annotations

import base64
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import table

POOL = 1024
#: Pieces that leave a task at once.
BATCH = 1024
END = 1


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


# White space of the vocabulary's own splitting rule; a single one stays inside its part.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}")
_SPECIAL = "<|endoftext|>"


class _Seen(dict):
    """Part of a text -> its ids, filled as parts are met."""

    def __init__(self, encode, before):
        self.encode, self.before = encode, before

    def __missing__(self, part):
        ids = self[part] = np.array(self.encode(self.before + part), "<u4").tobytes()
        return ids


class Encoder:
    """Ids of the byte-level vocabulary at ``path`` (ranks), as little-endian 32-bit bytes.

    A single space between two other characters always starts a token, so a text is cut
    there and the parts are looked up; only parts not seen before are encoded. Runs of white
    space are parts of their own, but for their last character.
    """

    KEEP = 1 << 17

    def __init__(self, path: str):
        import tiktoken
        import public_tokenizers
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                   special_tokens={})._core_bpe.encode_ordinary
        self.special = np.array([len(ranks)], "<u4").tobytes()
        self.first, self.later = _Seen(encode, ""), _Seen(encode, " ")

    def _words(self, text: str):
        first, *later = text.split(" ")
        if first:
            yield self.first[first]
        yield b"".join(map(self.later.__getitem__, later))

    def _plain(self, text: str):
        at = 0
        for run in _RUN.finditer(text):
            yield from self._words(text[at:run.start()])
            # The last of several white-space characters belongs to what follows.
            at = run.end() - (run.end() < len(text))
            yield self.first[text[run.start():at]]
        yield from self._words(text[at:])

    def __call__(self, text: str) -> bytes:
        for seen in (self.first, self.later):
            if len(seen) > self.KEEP:
                seen.clear()
        return self.special.join(b"".join(self._plain(p)) for p in text.split(_SPECIAL))


class Packer:
    """Takes items one by one and yields finished pieces ``key, start, total, sequence, offset, ids``."""

    def __init__(self, limits: Limits, first_sequence: int, pool=POOL):
        self.limits, self.sequence, self.size = limits, first_sequence, pool
        self.items, self.need = [], np.zeros((0, 3))
        self.cap = np.array([limits.tokens, limits.segments, limits.loss], float)

    def add(self, key, ids: bytes, loss: bytes | None = None):
        total = len(ids) // 4
        at = 0
        step = min(self.limits.tokens, self.limits.loss)
        while total - at >= step:
            cut = at + step
            if loss is not None:  # up to the loss limit, counted
                counts = np.cumsum(np.frombuffer(loss, np.uint8)[at:at + self.limits.tokens])
                cut = at + int(np.searchsorted(counts, self.limits.loss, side="right"))
                if cut - at < self.limits.tokens:
                    break
            yield from self._close([(key, at, total, ids[4 * at:4 * cut])])
            at = cut
        if at < total:
            self._push((key, at, total, ids[4 * at:], None if loss is None else loss[at:]))
        if len(self.items) >= 2 * self.size:
            while len(self.items) >= self.size:
                yield from self._fill()

    def finish(self):
        while self.items:
            yield from self._fill()

    def _demand(self, item):
        tokens = len(item[3]) // 4
        return tokens, 1, tokens if item[4] is None else item[4].count(1)

    def _push(self, item):
        if len(self.items) == len(self.need):
            self.need = np.concatenate([self.need, np.zeros((max(64, len(self.need)), 3))])
        self.need[len(self.items)] = self._demand(item)
        self.items.append(item)

    def _pop(self, i):
        item, last = self.items[i], self.items.pop()
        if i < len(self.items):
            self.items[i] = last
            self.need[i] = self.need[len(self.items)]
        return item

    def _fill(self):
        left, chosen = self.cap.copy(), []
        weight = self.need[:len(self.items)].mean(0) / self.cap ** 2
        while self.items and left[0] > 0 and left[1] > 0:
            need = self.need[:len(self.items)]
            fits = (need <= left).all(1)
            score = np.where(fits, need @ (weight * left), -1.0)
            best = int(score.argmax())
            if score[best] >= 0:
                item = self._pop(best)
                left -= self._demand(item)
                chosen.append(item[:4])
                continue
            # Nothing fits whole: cut the shortest piece, which leaves the least behind.
            item = self._pop(int(need[:, 0].argmin()))
            key, start, total, ids, loss = item
            cut = min(int(left[0]), len(ids) // 4)
            if loss is None:
                cut = min(cut, int(left[2]))
            else:
                counts = np.cumsum(np.frombuffer(loss, np.uint8)[:cut])
                cut = int(np.searchsorted(counts, left[2], side="right"))
            if cut:
                chosen.append((key, start, total, ids[:4 * cut]))
            if 4 * cut < len(ids):
                self._push((key, start + cut, total, ids[4 * cut:], loss and loss[cut:]))
            break
        yield from self._close(chosen)

    def _close(self, pieces):
        """Emit one full bin, or several whose lengths are powers of two."""
        room = sum(len(p[3]) // 4 for p in pieces)
        size, offset = 0, 0
        for key, start, total, ids in pieces:
            at = 0
            while at < len(ids):
                if offset == size:
                    size = room if room == self.limits.tokens else 1 << room.bit_length() - 1
                    room -= size
                    offset = 0
                    self.sequence += 1
                part = ids[at:at + 4 * (size - offset)]
                yield key, start + at // 4, total, self.sequence - 1, offset, part
                offset += len(part) // 4
                at += len(part)


def _pack(items, kind, limits, pool):
    """Pieces as Arrow batches from an iterator of ``key, ids, loss``."""
    names = [f.name for f in kind] + ["start", "doc_tokens", "sequence_id", "offset", "ids"]
    types = [f.type for f in kind] + [pa.int64()] * 4 + [pa.binary()]
    packer = Packer(limits, TaskContext.get().partitionId() << 40, pool)
    rows = []

    def batch():
        cols = list(zip(*rows)) or [[] for _ in range(6)]
        keys = list(zip(*cols[0])) or [[] for _ in kind]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip([*keys, *cols[1:]], types)], names=names)
    for item in items:
        rows += packer.add(*item)
        if len(rows) >= BATCH:
            yield batch()
            rows.clear()
    for row in packer.finish():
        rows.append(row)
        if len(rows) >= BATCH:
            yield batch()
            rows.clear()
    yield batch()


PIECE = "start long, doc_tokens long, sequence_id long, offset long, ids binary"


def _schema(df: DataFrame, keys) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys) + PIECE


def pack_items(items: DataFrame, keys, limits=Limits(), pool=POOL) -> DataFrame:
    """Pack ``keys, ids, loss``: ids as 32-bit little-endian bytes, loss one byte (0/1) per id or null."""
    keys = list(keys)

    def run(batches):
        kind = []

        def rows():
            for b in batches:
                kind[:] = [b.schema.field(i) for i in range(len(keys))]
                for *key, ids, loss in zip(*(c.to_pylist() for c in b.columns)):
                    yield key, ids or b"", loss
        source = rows()
        first = next(source, None)
        if first is not None:
            from itertools import chain
            yield from _pack(chain([first], source), kind, limits, pool)
    return items.select(*keys, "ids", "loss").mapInArrow(run, _schema(items, keys))


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pack_documents(docs: DataFrame, vocabulary=None, limits=Limits(), pool=POOL) -> DataFrame:
    """Tokenise every text, add the end id and pack; one row per piece with its ids."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        encode, end = Encoder(path), np.array([END], "<u4").tobytes()
        kind = []

        def rows():
            for b in batches:
                kind[:] = [b.schema.field(0)]
                for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                    yield (key,), encode(text.as_py() or "") + end, None
        source = rows()
        first = next(source, None)
        if first is not None:
            from itertools import chain
            yield from _pack(chain([first], source), kind, limits, pool)
    return docs.select("doc_id", "text").mapInArrow(run, _schema(docs, ["doc_id"]))


def piece_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark, sf_dir) -> DataFrame:
    return piece_digest(pack_documents(table(spark, sf_dir, "documents")))
