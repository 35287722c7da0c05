"""Toxicity by compression distance between two zstandard dictionaries.

One dictionary is trained on ordinary text and one on toxic text. What the toxic one holds
besides, ordinary text has too, so only its segments are kept that many toxic and hardly any
ordinary training documents contain. A window of a text is compressed with the ordinary
dictionary alone and with the toxic segments added; it is nearer to toxic text by the bytes
saved. Both dictionaries have the same length, so offsets cost the same. A document's
score comes from calibrated counts of windows above several savings.

Training uses at most ``TOXIC_DOCS`` and ``ORDINARY_DOCS`` labelled documents of up to
``TRAIN_CHARS`` characters, by smallest hash of the id; near copies among them count once.
Only labels of rows with crc32(doc_id) mod 5 <> 0 are seen. Every whole text is scored.

Defined cases: null and empty texts score as texts without savings; repeated rows score
alike; without labels of both kinds every score is the share of toxic labels (0 if none);
null ids are held out like others by the checksum of nothing (false); other columns are ignored.
"""
from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zs
from pyspark.sql import DataFrame, functions as F

from .common import fit_logistic, table
from .simhash import word_blocks

WINDOW_BYTES, TOXIC_BYTES, ORDINARY_BYTES, SEGMENT = 40, 65536, 32768, 16
TOXIC_DOCS, ORDINARY_DOCS, TRAIN_CHARS = 2000, 3000, 32768
#: Bytes that a window must save to count.
SAVINGS = (1, 2, 4)
#: A segment is toxic from this many toxic documents and this ratio of shares on.
LEAST_DOCS, LEAST_RATIO = 4, 15


def windows(text: str | None):
    """Whole words, lower case, until a window is full; very long words are cut with overlap."""
    held = b""
    for block in word_blocks((text or "").lower().encode()):
        for word in block:
            parts = [word] if len(word) <= 64 else [word[i:i + 64] for i in range(0, len(word), 48)]
            for part in parts:
                held += b" " + part
                if len(held) >= WINDOW_BYTES:
                    yield held + b" "
                    held = b""
    if held:
        yield held + b" "


def train_dictionary(texts, size) -> bytes:
    samples = [w for t in texts for w in windows(t)]
    try:
        return zs.train_dictionary(size, samples, k=SEGMENT, d=6).as_bytes()
    except zs.ZstdError:  # too little text to train on
        return b"".join(samples)[-size:]


def thinned(texts):
    """Texts without near copies of earlier ones, by eight minimum hashes."""
    seen, out = set(), []
    for text in texts:
        words = text.lower().encode().split()
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]))
                      for i in range(max(1, len(words) - 2))], np.uint64)
        keys = [(i, int((h * np.uint64(2 * i + 3) * np.uint64(0x9E3779B97F4A7C15)).min()))
                for i in range(8)]
        if sum(k in seen for k in keys) < 2:
            seen.update(keys)
            out.append(text)
    return out


def _starts(words):
    """Beginnings of words, 5 to 11 bytes with the space before them."""
    return {(b" " + w)[:n] for w in words for n in range(5, min(len(w) + 1, 11) + 1)}


def toxic_segments(dictionary: bytes, toxic, ordinary) -> list[bytes]:
    """Segments of the toxic dictionary that tell toxic from ordinary documents."""
    count = {1: Counter(), 0: Counter()}
    known = _starts(set(dictionary.split()))
    for label, texts in ((1, toxic), (0, ordinary)):
        for t in texts:
            count[label].update(_starts(set(t.lower().encode().split())) & known)
    inside, outside = count[1], count[0]
    good = sorted((s for s in known if inside[s] >= LEAST_DOCS and inside[s] * len(ordinary)
                   >= LEAST_RATIO * (outside[s] + 1) * len(toxic)), key=lambda s: (len(s), s))
    longer = {}
    for s in known:
        longer.setdefault(s[:-1], []).append(s)
    out = []
    for s in good:
        if any(s.startswith(k) or k.startswith(s) for k in out):
            continue
        while grown := [x for x in longer.get(s, ()) if inside[x] >= 0.9 * inside[s]]:
            s = min(grown)
        out.append(s)
    return out


def compressor(content: bytes):
    own = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    level = zs.ZstdCompressionParameters.from_level(
        3, source_size=WINDOW_BYTES, dict_size=len(content), min_match=4, write_content_size=0,
        # Faster strategies index every third place of a dictionary and miss short segments.
        strategy=zs.STRATEGY_BTOPT, write_checksum=0, write_dict_id=0, format=zs.FORMAT_ZSTD1_MAGICLESS)
    own.precompute_compress(compression_params=level)
    return zs.ZstdCompressor(dict_data=own, compression_params=level)


class Distance:
    """Savings of a text's windows, as features of the document."""

    def __init__(self, ordinary: bytes, segments):
        toxic = b"\0".join([b"", *sorted(segments), b""])
        self.plain, self.both = compressor(ordinary + bytes(len(toxic))), compressor(ordinary + toxic)

    def __call__(self, text):
        plain, both = self.plain.compress, self.both.compress
        saved = np.array([len(plain(w)) - len(both(w)) for w in windows(text)] or [0])
        return [saved.max(), *[np.log1p((saved >= s).sum()) for s in SAVINGS], np.log(len(saved))]


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, toxic: int, count: int) -> list[str]:
    """Texts of a bounded number of labelled rows that are not held out."""
    known = (labels.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .where(F.col("toxic") == toxic).select("doc_id")
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(count))
    # Bounded by ``count`` rows on either side of the join.
    rows = (docs.where("text is not null").where(F.length("text") <= TRAIN_CHARS)
            .join(F.broadcast(known), "doc_id").select("doc_id", "text")
            .orderBy(F.xxhash64("doc_id", "text")).limit(count).collect())
    return [r["text"] for r in rows]


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    kept = docs.select("doc_id", "text")
    toxic = thinned(training_texts(docs, labels, 1, TOXIC_DOCS))
    ordinary = thinned(training_texts(docs, labels, 0, ORDINARY_DOCS))
    if len(toxic) < 4 or len(ordinary) < 4:
        share = len(toxic) / max(1, len(toxic) + len(ordinary))
        out = kept.select("doc_id", F.lit(float(share)).alias("score"))
    else:
        cut_t, cut_o = -(-3 * len(toxic) // 4), -(-len(ordinary) // 2)
        base = train_dictionary(ordinary[:cut_o], ORDINARY_BYTES)
        segments = toxic_segments(train_dictionary(toxic[:cut_t], TOXIC_BYTES), toxic[:cut_t], ordinary[:cut_o])
        distance = Distance(base, segments)
        rest = toxic[cut_t:] + ordinary[cut_o:]
        x = np.array([distance(t) for t in rest])
        y = np.array([1.0] * (len(toxic) - cut_t) + [0.0] * (len(ordinary) - cut_o))
        probability = fit_logistic(x, y)

        def run(batches):
            own = Distance(base, segments)
            for b in batches:
                rows = [own(t.as_py()) for t in b.column(1)]
                score = probability(np.array(rows)) if rows else np.empty(0)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())],
                                                 names=["doc_id", "score"])
        kind = docs.schema["doc_id"].dataType.simpleString()
        out = kept.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity(spark, sf_dir) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
