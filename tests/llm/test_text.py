"""Text operators against brute force and on odd rows."""
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scangrid.llm import chat, minhash, packing, simhash, suffix_dedup
from scangrid.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def words_of(rng, n, alphabet="abcdefg"):
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(1, 7))) for _ in range(n))


# --- SimHash ---------------------------------------------------------------

def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(values, near):
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@pytest.fixture(scope="module")
def near_texts():
    rng = random.Random(1)
    base = [words_of(rng, 120) for _ in range(6)]
    out = [None, "", " \t\n", "One", "one", "TWO words", *base]
    for t in base:
        for _ in range(6):
            w = t.split()
            w[rng.randrange(len(w))] = "zz"
            out.append(" ".join(w))
    return out + [base[0], words_of(rng, 80000), "é\x0bÀB c\x1cd e"]


@pytest.mark.parametrize("bucket", [4096, 1])
def test_simhash_is_exact(spark, documents, near_texts, bucket):
    got = simhash.near_duplicates(documents(near_texts), bucket_rows=bucket).collect()
    got = sorted(got, key=lambda r: r["doc_id"])
    want = [slow_fingerprint(t) for t in near_texts]
    assert [r["fp"] % (1 << 64) for r in got] == want
    assert [r["component_id"] for r in got] == slow_components(
        want, lambda a, b: (a ^ b).bit_count() <= 2)


def test_covering_masks_meet_all_pairs():
    for i in range(64):
        for j in range(i, 64):
            flips = (1 << i) | (1 << j)
            assert any(not (m % (1 << 64)) & flips for m in simhash.masks())


@pytest.mark.parametrize("small", [500_000, -1])
def test_one_of_each_keeps_rows_whole(spark, documents, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL_ROWS", small)
    monkeypatch.setattr(minhash, "SMALL_ROWS", small)
    texts = ["a b c d e f", "a b c d e f", None, "", "other text of its own here", "a b c d e f"]
    kept = simhash.one_of_each(documents(texts, ids=[5, 3, 7, None, 9, 3]))
    assert kept.columns == documents(texts).columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [
        (3, "a b c d e f"), (7, None), (9, "other text of its own here")]
    near = " ".join(f"w{i}" for i in range(60))
    kept = simhash.one_of_each(documents([near, near + " end", "x", near, near], ids=[4, 2, 6, 2, 2]))
    assert sorted((r["doc_id"], r["text"][:2]) for r in kept.collect()) == [(2, "w0"), (6, "x")]


@pytest.mark.parametrize("bucket", [minhash.BUCKET_SHINGLES, 500])
def test_one_of_each_takes_similar_texts(spark, documents, tmp_path, bucket):
    """Changed words at random places, so similarities lie on both sides of 0.8."""
    rng = np.random.default_rng(2)
    texts = []
    for group in range(12):
        base = [f"w{x}" for x in rng.integers(0, 500, 120)]
        for _ in range(6):
            own = list(base)
            for at in rng.choice(120, rng.integers(0, 7), replace=False):
                own[at] = f"new{rng.integers(0, 10**6)}"
            texts.append(" ".join(own))
    texts += ["Too short", "too  SHORT", "too short a", "", None]
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    alike = [[len(a & b) / len(a | b) >= 0.8 for b in sets] for a in sets]
    root = list(range(len(texts)))
    for _ in texts:
        root = [min(root[j] for j in range(len(texts)) if alike[i][j]) for i in range(len(texts))]
    docs = documents(texts)
    if bucket == minhash.BUCKET_SHINGLES:
        assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == sorted(set(root))
        assert len(set(root)) < len({tuple(sorted(s)) for s in sets})
    scratch = Scratch(spark, "test")
    prints = scratch.write(minhash.sketches(docs, ("doc_id",)))
    got = prints.join(minhash.classes(docs, prints, scratch, "doc_id", bucket), "fp").collect()
    lowest = {r["root"]: min(x["doc_id"] for x in got if x["root"] == r["root"]) for r in got}
    assert [lowest[r["root"]] for r in sorted(got, key=lambda r: r["doc_id"])] == root


def test_equal_groups_are_compared_once(spark, documents):
    long = " ".join(f"w{i}" for i in range(300))
    docs = documents([long, long + " more", long, " ".join(f"v{i}" for i in range(90000)), long + " other"])
    scratch = Scratch(spark, "test")
    prints = scratch.write(minhash.sketches(docs, ("doc_id",)))
    members = minhash.groups(prints, scratch).collect()
    per_group = collections.Counter(r["group"] for r in members)
    held = {g: frozenset(r["fp"] for r in members if r["group"] == g) for g in per_group}
    assert len(set(held.values())) == len(held) and len(members) <= 9
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == [0, 3]


def test_simhash_of_nothing(spark, documents):
    assert simhash.near_duplicates(documents(["x"]).where("false")).count() == 0
    assert simhash.one_of_each(documents(["x"]).where("false")).count() == 0


# --- repeated substrings -----------------------------------------------------

def slow_digest(texts):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(d[p:p + 400] for d in data for p in range(len(d) - 399))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, np.int8)
        for p in range(len(d) - 399):
            if count[d[p:p + 400]] > 1:
                gone[p + 1:p + 401] = 1
        kept = bytes(x for x, g in zip(d, gone[1:-1]) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def repeating_texts():
    rng = random.Random(2)
    passage = "".join(rng.choices("abcdef gh", k=620))
    texts = [words_of(rng, 300) for _ in range(8)]
    texts += [None, "", "x" * 400, "b" + "x" * 400, "a" * 1500, "ab" * 500, "é" * 350, texts[0], texts[1][:700]]
    for _ in range(25):
        a, b = rng.randrange(150), 620 - rng.randrange(150)
        texts.append(words_of(rng, rng.randrange(60), "klm") + passage[a:b] + words_of(rng, rng.randrange(60), "klm"))
    long = "".join(rng.choices("abcdefgh ", k=140000))
    return texts + [long + long[65100:66900], long[131000:131700]]


@pytest.mark.parametrize("bucket", [8192, 4])
def test_suffix_dedup_is_exact(spark, documents, repeating_texts, bucket):
    got = sorted(suffix_dedup.digest(documents(repeating_texts), bucket).collect(), key=lambda r: r["doc_id"])
    assert [tuple(r)[1:] for r in got] == slow_digest(repeating_texts)


def test_suffix_dedup_leaves_hot_keys_in_place(spark, documents, repeating_texts):
    rows = spark.range(0, 4000, 1, 8).selectExpr("if(id % 10 = 0, id, 1) AS gram", "id")
    counts = rows.groupBy("gram").count().where("count > 1")
    hot, rest = suffix_dedup._parts(rows, counts, ["gram"], "count", 100)
    where = hot.groupBy(F.spark_partition_id()).count().collect()
    assert len(where) == 8 and {r["count"] for r in where} == {450} and rest.count() == 0

    def spans(hot_rows):
        found = suffix_dedup.repeated_spans(documents(repeating_texts), Scratch(spark, "hot"), 3, hot_rows)
        return sorted((r.doc_id, suffix_dedup._merged(r.spans)) for r in found.collect())
    assert spans(1) == spans(1 << 14) and spans(1)


def test_suffix_dedup_of_equal_rows_and_null_ids(spark, documents):
    text = "".join(random.Random(3).choices("abcdefgh ", k=500))
    got = suffix_dedup.digest(documents([text, text, text + "!", "short"], ids=[1, 1, None, None])).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in got) == [(5, 0), (500, 500), (500, 500), (501, 500)]


def test_remove_repeats_keeps_columns(spark, documents):
    text = "".join(random.Random(4).choices("abcdefgh ", k=450))
    docs = documents([text + "tail é", "head " + text, None, ""])
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()) == [
        (0, "tail é", 6), (1, "head ", 5), (2, None, 0), (3, "", 0)]
    assert suffix_dedup.remove_repeats(docs.where("false")).count() == 0
    assert suffix_dedup.digest(docs.where("false")).count() == 0


# --- packing ---------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_matches_tokenizer(tokenizer):
    encode, rng = packing.Encoder(packing.default_vocabulary()), random.Random(5)
    parts = [" ", "  ", "\n", "\t", "a", "b'", "'s", "'ll", "12", "é", "中", " ", "\x85", "\xa0", "!?",
             "<|endoftext|>", "the", " the", "\x1c", "​", "😀", "\r\n"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(16)))
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check_pieces(rows, want, limits):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(want)
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["start"])
        assert b"".join(bytes(p["ids"]) for p in pieces) == want[doc]
        at = 0
        for p in pieces:
            assert p["start"] == at and p["doc_tokens"] == len(want[doc]) // 4
            at += len(p["ids"]) // 4
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for p in pieces:
            assert p["offset"] == at
            at += len(p["ids"]) // 4
        assert at <= limits.tokens and len(pieces) <= limits.segments
        assert at == limits.tokens or at & (at - 1) == 0


def test_packing_places_every_id_once(spark, documents, tokenizer):
    rng = random.Random(6)
    texts = [words_of(rng, rng.choice([0, 1, 3, 50, 400])) for _ in range(300)] + [None, "", words_of(rng, 30000)]
    end = np.array([1], "<u4").tobytes()
    want = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() + end
            for i, t in enumerate(texts)}
    for limits in (packing.Limits(), packing.Limits(256, 5, 256)):
        check_pieces(packing.pack_documents(documents(texts), limits=limits, pool=64).collect(), want, limits)
    pieces = packing.piece_digest(packing.pack_documents(documents(texts))).collect()
    for r in pieces:
        part = want[r["doc_id"]][4 * r["start"]:4 * (r["start"] + r["length"])]
        assert r["ids_crc32"] == zlib.crc32(part) and len(part) == 4 * r["length"]
    assert packing.pack_documents(documents(["x"]).where("false")).count() == 0


def test_packing_respects_loss_limit(spark):
    rng = random.Random(7)
    rows, want, loss = [], {}, {}
    for i in range(200):
        n = rng.randrange(0, 300)
        want[i] = np.arange(n, dtype="<u4").tobytes()
        loss[i] = bytes(rng.choices([0, 1], k=n))
        rows.append((i, bytearray(want[i]), bytearray(loss[i])))
    rows.append((200, None, None))
    limits = packing.Limits(128, 8, 50)
    got = packing.pack_items(spark.createDataFrame(rows, "doc_id long, ids binary, loss binary"),
                             ["doc_id"], limits, pool=32).collect()
    check_pieces(got, {k: v for k, v in want.items() if v}, limits)
    bearing = collections.Counter()
    for r in got:
        bearing[r["sequence_id"]] += sum(loss[r["doc_id"]][r["start"]:r["start"] + len(r["ids"]) // 4])
    assert max(bearing.values()) <= limits.loss


# --- chat ------------------------------------------------------------------

def test_chat_reads_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<<SYS>>[ROLE]x[TEXT]", "", None, "é<", "[", "😀" * 50, "a\n" * 40000]
    rng, rows = random.Random(8), []
    for c in [*range(40), None]:
        for t in range(rng.randint(1, 5)):
            rows.append((c, t, rng.choice(["system", "user", "assistant", "tool[TEXT]", None]), rng.choice(nasty), "x"))
    rows += [(99, 0, "user", "a", "x"), (99, 0, "user", "a", "x"), (99, None, "assistant", "b", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(turns)).collect()}
    plain = collections.defaultdict(list)
    for c, t, role, text, _ in rows:
        plain[c].append((t is not None, t or 0, role or "", text or "", role is not None, text is not None))
    assert set(got) == set(plain)
    for c, ts in plain.items():
        ts.sort(key=lambda x: (x[0], x[1], x[4], x[2], x[5], x[3]))
        sha = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t, _, _ in ts).encode()).hexdigest()
        loss = "".join(t for _, _, r, t, _, _ in ts if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (
            len(ts), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_chat(turns.where("false"))).count() == 0


def test_chat_order_is_validated(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"),
            (3, 0, "user", "u"), (3, 1, "user", "u"), (4, 0, "user", "u"), (4, 1, "system", "s")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(turns)
    assert {r["conv_id"]: r["valid"] for r in chat.read_back(out).collect()} == {
        1: True, 2: False, 3: False, 4: False}
    assert all(r["loss"] == (r["text"] == "a") for r in out.collect())
