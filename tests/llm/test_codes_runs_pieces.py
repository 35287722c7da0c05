"""Vector codes, periodic runs and pieces against brute force, the library and on odd rows."""
import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece

from scangrid.llm import codes, pieces, runs
from scangrid.llm.common import table

SF = "/root/testdata/sf0.001"


# --- Vector codes ----------------------------------------------------------

def slow_codes(rows, parts=8, entries=16, rounds=6):
    """Codebooks, numbers and errors from (vec_id, components), with Python's integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[int(np.floor(float(c) * 4096)) for c in v] for _, v in rows]
    cuts = np.cumsum([0, *(len(p) for p in np.array_split(np.arange(len(x[0])), parts))])
    cut = [[r[a:b] for a, b in zip(cuts, cuts[1:])] for r in x]
    books = [[r[p] for r in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        gaps = [sum((int(a) - int(b)) ** 2 for a, b in zip(part, e)) for e in book]
        return gaps.index(min(gaps)), min(gaps)
    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(r[p], books[p])[0] for r in cut]
            for e in range(len(books[p])):
                mine = [r[p] for r, o in zip(cut, own) if o == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [[nearest(r[p], books[p]) for p in range(parts)] for r in cut]
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    return rows, [[n for n, _ in f] for f in found], [sum(g for _, g in f) for f in found], \
        hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("splits", [4, 2])
def test_tree_finds_the_nearest_entry_and_the_lowest_of_equals(splits, monkeypatch):
    monkeypatch.setattr(codes, "SPLITS", splits)
    rng = np.random.default_rng(1)
    for size in (1, 3, 5, 16, 100):
        for width, kind in ((8, np.int64), (2, np.int64), (3, object)):
            entries = rng.integers(-6, 7, (size, width)).astype(kind)  # many ties and equal entries
            rows = rng.integers(-9, 10, (300, width)).astype(kind)
            number, gap = codes.Gnat(entries).search(rows)
            want = ((rows[:, None] - entries[None]) ** 2).sum(2).astype(np.int64)
            assert number.tolist() == want.argmin(1).tolist()
            assert gap.tolist() == want.min(1).tolist()


def test_tree_leaves_subtrees_out():
    rng = np.random.default_rng(2)
    entries = (rng.integers(0, 8, (64, 1)) * 10000 + rng.integers(-50, 50, (64, 4))).astype(np.int64)
    met = []
    tree = codes.Gnat(entries)
    plain = codes.Gnat._meet
    try:
        codes.Gnat._meet = staticmethod(lambda rows, index, *a: (met.append(len(index)), plain(rows, index, *a))[1])
        number, _ = tree.search(entries)
    finally:
        codes.Gnat._meet = staticmethod(plain)
    assert sum(met) < 0.6 * 64 * 64


def test_codes_equal_brute_force(spark):
    got = {r["vec_id"]: r for r in codes.op12_codes(spark, SF).collect()}
    data = [(r["vec_id"], r["embedding"], r["label"]) for r in table(spark, SF, "embeddings").collect()]
    rows, code, error, sha = slow_codes([(i, v) for i, v, _ in data])
    label = {i: lab for i, _, lab in data}
    assert len(got) == len(rows)
    for (i, _), c, e in zip(rows, code, error):
        assert (got[i]["code"], got[i]["error"], got[i]["codebooks_sha256"]) == ("".join("%02x" % n for n in c), e, sha)
        assert got[i]["label_error"] == sum(x for (j, _), x in zip(rows, error) if label[j] == label[i])


def test_codes_of_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    good = [[float(i * 7 % 5), -0.5, 1e-4 * i, 2.0, 3.0, 0.0, -1e-9, 1.0, 0.25, float(i % 2)] for i in range(21)]
    rows = [(i, v, None if i % 3 else 1, "x") for i, v in enumerate(good)]
    rows += [(3, good[3], 1, "x"), (3, good[4], 2, "x"), (None, good[5], 2, "x")]
    bad = [(50, None, 1, "x"), (51, [], 1, "x"), (52, [nan] * 10, 1, "x"), (53, [inf] + [0.0] * 9, 1, "x"),
           (54, [None] + [0.0] * 9, 1, "x"), (55, [1.0, 2.0], 1, "x")]
    schema = "vec_id long, embedding array<float>, label int, code string"
    path = str(tmp_path)
    spark.createDataFrame(rows + bad, schema).write.parquet(f"{path}/embeddings.parquet")
    got = codes.op12_codes(spark, path).collect()
    kept = [(r[0], np.array(r[1], np.float32).tolist()) for r in rows]
    want, code, error, sha = slow_codes(kept)
    assert {r["codebooks_sha256"] for r in got} == {sha}
    label = {(i, tuple(v)): r[2] for r, (i, v) in zip(rows, kept)}
    label = [label[i, tuple(v)] for i, v in want]
    sums = {x: sum(e for e, y in zip(error, label) if x == y) for x in label}
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in got) == sorted(
        (str(i), "".join("%02x" % n for n in c), e, sums[x])
        for (i, _), c, e, x in zip(want, code, error, label))


def test_codes_of_wide_numbers_and_empty_tables(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(i, [1e6 * (i % 7), -3e7 + i, 0.5, float(i)]) for i in range(40)]
    coded, books = codes.compress(spark.createDataFrame(rows, schema), parts=2)
    want, code, error, sha = slow_codes(rows, parts=2)
    assert books.sha256() == sha
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in coded.collect()) == [
        (i, c, e) for (i, _), c, e in zip(want, code, error)]
    huge, _ = codes.compress(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], schema), parts=2, entries=1)
    assert {r["error"] for r in huge.collect()} == {None}
    none, books = codes.compress(spark.createDataFrame([], schema))
    assert none.collect() == [] and books.books == []


# --- Periodic runs ---------------------------------------------------------

def slow_runs(w, least=24, repeats=3):
    out = {}
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, repeats * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in out.items())


def slow_row(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted(slow_runs(w), key=lambda r: (r[0], r[2]))
    gone = set()
    for s, length, q in found:
        gone.update(range(s + q, s + length))
    best = None
    for s, length, q in found:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def text_of(words):
    return " ".join(map(str, words))


def test_cover_has_every_difference():
    assert {(a - b) % runs.CYCLE for a in runs.COVER for b in runs.COVER} == set(range(runs.CYCLE))


def test_extensions_and_runs_equal_brute_force():
    rng = random.Random(5)
    for trial in range(120):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n = rng.choice([0, 1, 23, 24, 60, 150])
            part = [rng.randint(0, 2) for _ in range(rng.randint(1, 30))]
            mixed = [x for _ in range(8) for x in [rng.randint(0, 3) for _ in range(rng.randint(1, 8))] * rng.randint(1, 7)]
            texts.append(rng.choice([[0] * n, (part * n)[:n], mixed[:n], [rng.randint(0, 1) for _ in range(n)]]))
        size = np.array([*map(len, texts)])
        start = np.cumsum(size + 1) - size - 1
        words = np.array([x for k, t in enumerate(texts) for x in [*t, 100 + k]]) + 1
        begin, end, period = runs.find_runs(words, start, size)
        want = [(s + o, length, q) for t, o in zip(texts, start.tolist()) for s, length, q in slow_runs(t)]
        assert sorted(zip(begin.tolist(), (end - begin).tolist(), period.tolist())) == sorted(want)
        lce = runs.Lce(words)
        one, two = (np.random.default_rng(trial + k).integers(0, len(words), 40) for k in (0, 1000))
        one, two = one[one != two], two[one != two]
        for a, b, got in zip(one, two, lce(one, two)):
            same = 0
            while max(a, b) + same < len(words) and words[a + same] == words[b + same]:
                same += 1
            assert same == got


def test_runs_equal_brute_force_on_a_table(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in runs.op11_runs(spark, SF).collect()}
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    assert got == {i: slow_row(i, t) for i, t in docs.items()}
    assert sum(r[0] for r in got.values()) > 5


@pytest.mark.parametrize("batch_words", [1 << 17, 10])
def test_runs_of_odd_texts(spark, documents, tmp_path, monkeypatch, batch_words):
    monkeypatch.setattr(runs, "BATCH_WORDS", batch_words)
    texts = [None, "", " \t\x0b", "a", text_of([1] * 23), text_of([1] * 24), text_of([1, 2] * 30 + [1, 1] * 20),
             " é " * 40, text_of(range(3000)), text_of([5, 6, 7] * 20000), text_of([1] * 24), text_of(["x\x1cy"] * 30)]
    ids = [*range(200, 200 + len(texts) - 1), None]
    path = str(tmp_path)
    documents(texts, ids=ids).write.parquet(f"{path}/documents.parquet")
    got = sorted(tuple(r) for r in runs.op11_runs(spark, path).collect() if r["doc_id"] is not None)
    want = sorted((i, *slow_row(i, t)) for i, t in zip(ids, texts) if i is not None and len(t or "") < 20000)
    assert [r for r in got if r[0] != 209] == want
    whole = [r for r in got if r[0] == 209][0]
    assert whole[1:6] == (1, 0, 60000, 3, 20000000)
    assert runs.op11_runs(spark, path).where("doc_id is null").collect()[0]["n_runs"] == 1


def test_runs_of_an_empty_table(spark, documents):
    assert runs.collapse_runs(documents([])).collect() == []


def test_collapsed_texts_and_runs_come_out(spark, documents):
    row = runs.collapse_runs(documents([text_of(["start", *["a", "b"] * 20, "end"])])).collect()[0]
    assert (row["n_words"], row["collapsed"]) == (42, "start a b end")
    assert [tuple(r) for r in row["runs"]] == [(1, 40, 2)]


# --- Pieces ----------------------------------------------------------------

@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_vocabulary())


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(7)
    bits = ["a", "b", "the", "ing", " ", "  ", "▁", "\n", "\t", "é", "中", "🤗", "\x00", "<0x41>", "</s>", "1", "23",
            "th", "　", "\xa0", "é", "==", "----", "    "]
    out = [None, "", " ", "▁", "a ", " a", "͸\U000e0001", "x" * 70, "ab" * 3000, " " * 500, "▁" * 65 + "q"]
    out += ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(1500)]
    out += ["".join(chr(rng.choice([rng.randint(1, 0x2fff), rng.randint(0x20, 0x7e), rng.randint(0xe000, 0x10ffff)]))
                    for _ in range(rng.randint(1, 90))) for _ in range(500)]
    return out


@pytest.mark.parametrize("check", [True, False])
def test_pieces_equal_the_library(spark, documents, odd_texts, model, check):
    got = sorted(pieces.encode_texts(documents(odd_texts), check=check).collect(), key=lambda r: r["doc_id"])
    want = model.encode([t or "" for t in odd_texts])
    assert [r["ids"] for r in got] == want
    assert [r["decoded"] for r in got] == model.decode(want)


def test_both_agendas_agree(odd_texts):
    own = pieces.Vocabulary(pieces.default_vocabulary())
    parts = {p for t in odd_texts for p in own.parts.findall(pieces.MARK + (t or "").replace(" ", pieces.MARK))}
    short = [p for p in parts if len(p) <= pieces.KEEP_CHARS]
    assert [np.frombuffer(b, "<i4").tolist() for b in own.agendas(short)] == [own.agenda(p) for p in short]


def test_a_difference_from_the_library_is_noticed():
    own = pieces.Vocabulary(pieces.default_vocabulary())
    with pytest.raises(ValueError):
        own.check_parts(["▁the"], [np.array([5], "<i4").tobytes()])
    with pytest.raises(ValueError):
        own.check_decoded([np.array([264], np.int32)], [b"b"])


def test_piece_digests(spark, model):
    got = {r["doc_id"]: tuple(r)[1:] for r in pieces.op13_pieces(spark, SF).collect()}
    for r in table(spark, SF, "documents").collect():
        ids = model.encode(r["text"] or "")
        assert got[r["doc_id"]] == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(model.decode(ids).encode()).hexdigest())


def test_pieces_of_long_repeated_and_no_rows(spark, documents, model):
    long = " ".join(str(i * 7919 % 100003) for i in range(200000))
    rows = pieces.encode_texts(documents([long, "a", "a"], ids=[1, 2, 2])).collect()
    assert sorted((r["doc_id"], len(r["ids"])) for r in rows) == [(1, len(model.encode(long))), (2, 1), (2, 1)]
    assert pieces.encode_texts(documents([])).collect() == []
