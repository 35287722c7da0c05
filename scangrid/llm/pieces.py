"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

A text becomes symbols, at first its characters. An agenda holds the adjacent pairs whose
join is a piece, best score first and leftmost among equals; the best pair is joined, its
new neighbours enter the agenda, and pairs that lost a member are passed over when their
turn comes. What is no piece in the end falls back to its UTF-8 bytes.

Where no piece holds a space mark after another character (checked when a vocabulary is
read), no join crosses such a place, so a text is cut there and equal parts are encoded
once, the short new ones of a batch together: every part has its own agenda, and each
round joins the best pair of every agenda. In each Arrow batch the library encodes the new
parts and decodes the ids of the whole texts; a difference fails the task.

Every row is handled in its own task; there is no shuffle.

Defined cases: null and empty texts have no ids and decode to the empty text; repeated rows
and ids give a row each; a text without spaces is one part, whose agenda grows with its
length times the logarithm; other columns are ignored.
"""
from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import table

MARK = "▁"
#: Parts up to this many characters are remembered, this many at a time.
KEEP_CHARS, KEEP = 64, 1 << 20
#: Pairs of characters below this code point have a table of their own.
NEAR = 0x250
#: Bytes of text encoded at once.
BATCH_BYTES = 1 << 20


class Vocabulary:
    """Pieces of a merge-type model without special normalisation, read through the library."""

    def __init__(self, path: str):
        import sentencepiece
        self.library = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.merged, self.bytes, self.surface = {}, {}, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            raw = piece.replace(MARK, " ").encode()
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.bytes[value] = i
                raw = bytes([value])
            elif model.is_control(i):
                raw = b""
            elif model.is_unknown(i):
                self.unknown, raw = i, " ⁇ ".encode()
            elif not model.is_unused(i):
                self.merged[piece] = (-model.get_score(i), i)
            self.surface.append(raw)
        self.cut = not any(MARK in p.lstrip(MARK) for p in self.merged)
        self.parts = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.seen = {}
        self._tables()

    def _tables(self):
        """Pairs of symbols as numbers; a symbol is a piece or a character, the latter by its code point."""
        points = 0x110000
        names = [p for p in self.merged if len(p) > 1]
        number = {p: points + k for k, p in enumerate(names)}
        rows = []
        best = {score: r for r, score in enumerate(sorted({self.merged[p][0] for p in names}))}

        def symbol(text):
            return ord(text) if len(text) == 1 else number.get(text)
        for p in names:
            for i in range(1, len(p)):
                left, right = symbol(p[:i]), symbol(p[i:])
                if left is not None and right is not None:
                    rows.append((left << 32 | right, best[self.merged[p][0]], number[p]))
        rows.sort()
        self.pair_key, rank, self.joined = (np.array(c, np.int64) for c in zip(*rows or [(-2, 0, 0)]))
        self.rank = np.append(rank, len(best))  # the last one, also number -1, is no pair
        left, right = np.divmod(np.arange(NEAR * NEAR), NEAR)
        self.near = self._search(left << 32 | right).astype(np.int32)
        own = self

        class Coded(dict):
            def __missing__(self, s):
                name = chr(s) if s < points else names[s - points]
                ids = self[s] = np.array(own._ids(name), "<i4").tobytes()
                return ids
        self.coded = Coded()

    def _ids(self, symbol: str) -> list[int]:
        if symbol in self.merged:
            return [self.merged[symbol][1]]
        return [self.bytes[b] for b in symbol.encode()] if self.bytes else [self.unknown]

    def agenda(self, part: str) -> list[int]:
        """Ids of one part, joined pair by pair in the order of scores."""
        merged = self.merged
        symbols = list(part)
        after = [*range(1, len(symbols)), -1]
        before = [*range(-1, len(symbols) - 1)]
        waiting = []

        def offer(left, right):
            joined = symbols[left] + symbols[right]
            if joined in merged:
                # A pair that begins at the same place and is as long is the same pair.
                heapq.heappush(waiting, (merged[joined][0], left, len(joined)))
        for left in range(len(symbols) - 1):
            offer(left, left + 1)
        while waiting:
            _, left, size = heapq.heappop(waiting)
            if symbols[left] is None:
                continue
            right = after[left]
            if right < 0 or len(symbols[left]) + len(symbols[right]) != size:
                continue
            symbols[left] += symbols[right]
            symbols[right] = None
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        return [i for s in symbols if s is not None for i in self._ids(s)]

    def agendas(self, parts: list[str]) -> list[bytes]:
        """Ids of many short parts at once: each round joins the best pair of every part's agenda."""
        size = np.array([len(p) for p in parts])
        points = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")
        symbol, number = points.astype(np.int64), np.arange(len(parts))
        done = []
        pair = np.append(self._pairs(symbol), -1)
        while len(number):
            start = np.cumsum(size) - size
            pair[start + size - 1] = -1  # the last of a part has no neighbour
            place = np.arange(len(symbol)) - np.repeat(start, size)
            best = np.minimum.reduceat(self.rank[pair] << 8 | place, start)
            over = best >= self.rank[-1] << 8
            if over.any():
                row = np.repeat(over, size)
                done.append((np.repeat(number[over], size[over]), symbol[row]))
                symbol, pair, number, size, best = symbol[~row], pair[~row], number[~over], size[~over], best[~over]
                start = np.cumsum(size) - size
            if not len(number):
                break
            at = start + (best & 255)
            symbol[at] = self.joined[pair[at]]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            symbol, pair, size = symbol[stay], pair[stay], size - 1
            at -= np.arange(len(at))  # every part before has lost one symbol
            for left in (at, at - 1):
                left = left[(left >= 0) & (left < len(symbol) - 1)]
                pair[left] = self._pairs(symbol[left], symbol[left + 1])
        owner, symbol = (np.concatenate(c) for c in zip(*done))
        order = np.argsort(owner, kind="stable")
        coded = [*map(self.coded.__getitem__, symbol[order].tolist())]
        ends = np.searchsorted(owner[order], np.arange(len(parts) + 1)).tolist()
        return [b"".join(coded[a:b]) for a, b in zip(ends, ends[1:])]

    def _search(self, key):
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, at, -1)

    def _pairs(self, symbol, after=None):
        """Number in the table of pairs for each symbol and the next one; -1: none."""
        if after is None:
            symbol, after = symbol[:-1], symbol[1:]
        out = np.empty(len(symbol), np.int64)
        near = (symbol < NEAR) & (after < NEAR)
        out[near] = self.near[symbol[near] * NEAR + after[near]]
        out[~near] = self._search(symbol[~near] << 32 | after[~near])
        return out

    def encode(self, texts: list[str], check=False) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        cut = [[] if not t else self.parts.findall(MARK + t.replace(" ", MARK)) if self.cut
               else [MARK + t.replace(" ", MARK)] for t in texts]
        if len(self.seen) >= KEEP:
            self.seen.clear()
        new = set().union(*cut).difference(self.seen)
        short = [p for p in new if len(p) <= KEEP_CHARS]
        short = dict(zip(short, self.agendas(short))) if short else {}
        long = {p: np.array(self.agenda(p), "<i4").tobytes() for p in new if len(p) > KEEP_CHARS}
        if check:
            for found in (short, long):
                self.check_parts([*found], found.values())
        self.seen.update(short)
        if long:
            return [b"".join([long.get(p) or self.seen[p] for p in parts]) for parts in cut]
        return [b"".join(map(self.seen.__getitem__, parts)) for parts in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of ids; the space before the first word is taken off again."""
        if not len(ids):
            return b""
        raw = b"".join(map(self.surface.__getitem__, ids.tolist()))
        first = self.surface[ids[0]]
        if first[:1] == b" " and int(ids[0]) != getattr(self, "unknown", -1):
            raw = raw[1:]
        return raw

    def check_parts(self, parts, ids):
        """Compare parts with the library, which sets the first space mark itself."""
        theirs = self.library.encode([p[1:].replace(MARK, " ") for p in parts], num_threads=1)
        if MARK in parts:  # nothing is left of a single space mark
            theirs[parts.index(MARK)] = [self.library.piece_to_id(MARK)]
        for part, mine, other in zip(parts, ids, theirs):
            if mine != np.array(other, "<i4").tobytes():
                raise ValueError(f"ids of {part[:100]!r} differ from the library's")

    def check_decoded(self, ids, decoded):
        """Compare decoded texts with the library's."""
        for mine, other in zip(decoded, self.library.decode([i.tolist() for i in ids], num_threads=1)):
            if mine != other.encode():
                raise ValueError(f"decoded text differs from the library's: {other[:100]!r}")


def _portions(column):
    """Stretches of rows with at most ``BATCH_BYTES`` bytes of text, one row at least."""
    length = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(column):
        end = at + max(1, int(np.searchsorted(np.cumsum(length[at:]), BATCH_BYTES, side="right")))
        yield at, min(end, len(column))
        at = end


def encode_texts(docs: DataFrame, vocabulary: str | None = None, key="doc_id", text="text",
                 check=True) -> DataFrame:
    """``doc_id, ids, decoded``: ids of every whole text and what they decode to."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        own = None
        for b in batches:
            own = own or Vocabulary(path)
            for at, end in _portions(b.column(1)):
                texts = [t or "" for t in b.column(1).slice(at, end - at).to_pylist()]
                raw = own.encode(texts, check)
                ids = [np.frombuffer(r, "<i4") for r in raw]
                decoded = [own.decode(i) for i in ids]
                if check:
                    own.check_decoded(ids, decoded)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, end - at), lists,
                     pa.array(decoded, pa.binary()).cast(pa.string())], names=[key, "ids", "decoded"])
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op13_pieces(spark, sf_dir) -> DataFrame:
    coded = encode_texts(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
