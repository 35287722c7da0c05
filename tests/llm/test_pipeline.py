"""The pipeline's stages and its registration."""
import collections
import zlib

import pyarrow as pa

import __spark_entry__ as entry
import corpus_pipeline
from scangrid.llm import packing

SF = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None
    assert len(corpus_pipeline.STAGES) == 5


def one_of_each(rows):
    """Smallest id of every group of texts whose sets of five words have a similarity of 0.8."""
    rows = sorted((r["doc_id"], r["text"] or "") for r in rows)
    sets = []
    for _, text in rows:
        w = text.encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [rows[i][0] for i in range(len(rows)) if find(i) == i]


def without_repeats(rows, size=400):
    """Texts without the bytes of strings of ``size`` that also start anywhere else."""
    data = {i: (t or "").encode() for i, t in rows}
    count = collections.Counter(d[p:p + size] for d in data.values() for p in range(len(d) - size + 1))
    out = {}
    for i, d in data.items():
        gone = bytearray(len(d))
        for p in range(len(d) - size + 1):
            if count[d[p:p + size]] > 1:
                gone[p:p + size] = b"\1" * size
        # A cut inside a character leaves bytes that are no text; the stage drops those.
        out[i] = bytes(x for x, g in zip(d, gone) if not g).decode(errors="ignore").encode()
    return out


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if name != "pack":
            assert docs.columns == columns
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
            bad = [d for d, q in labels.items() if q == 0]
            good = [d for d, q in labels.items() if q == 1]
            assert sum(d in kept for d in good) >= 0.98 * len(good)
            assert sum(d in kept for d in bad) <= 0.1 * len(bad)
        if name == "near_duplicates":
            assert sorted(r["doc_id"] for r in docs.collect()) == one_of_each(before.select("doc_id", "text").collect())
        if name == "repeats":
            want = without_repeats([(r["doc_id"], r["text"]) for r in before.collect()])
            assert {r["doc_id"]: r["text"].encode() for r in docs.collect()} == want
        if name == "mix":
            assert docs.count() >= before.count()
            assert docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    ids = collections.Counter()
    for r in docs.collect():
        ids[r["doc_id"]] += len(r["ids"]) // 4
    assert set(ids) == {r["doc_id"] for r in before.select("doc_id").collect()}
    assert packing.piece_digest(docs).where("ids_crc32 < 0").count() == 0
    row = docs.first()
    assert packing.piece_digest(docs.limit(1)).columns[0] == "doc_id" and zlib.crc32(bytes(row["ids"])) >= 0


def test_near_duplicates_follow_simhash_links(spark):
    from scangrid.llm import minhash, simhash
    body = "one two three " * 200
    tails = [" ".join(f"{t}{i}" for i in range(12)) for t in "abc"]
    texts = [body + t for t in tails]
    prints = [simhash.fingerprint(t) for t in texts]
    assert all((p ^ prints[0]).bit_count() <= simhash.RADIUS for p in prints)
    sets = [set(minhash.shingles(t).tolist()) for t in texts]
    assert len(sets[0] & sets[1]) < .5 * len(sets[0] | sets[1])
    other = " ".join(f"w{i}" for i in range(60))
    rows = [(5, texts[0]), (3, texts[1]), (9, texts[2]), (4, other), (8, other + " end"), (7, "quite another text of its own")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [3, 4, 7]


def test_stages_bound_arrow_batches_by_bytes(spark, documents):
    from scangrid.llm import common
    spark.conf.unset(common._BATCH)
    docs = documents(["word " * 200_000] * 12, clash=False).coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["rows"])
    try:
        corpus_pipeline.pack(spark, docs, SF)
        assert max(r.rows for r in docs.mapInArrow(sizes, "rows long").collect()) <= 4
        spark.conf.set(common._BATCH, "64m")
        corpus_pipeline.mix(spark, docs.limit(0), SF)
        assert spark.conf.get(common._BATCH) == "64m"
    finally:
        spark.conf.unset(common._BATCH)


def test_texts_of_whole_rows_travel_once(spark, documents):
    import numpy as np
    from pyspark.sql import functions as F
    from scangrid.llm import features, mixing
    docs = documents(["a few words", None, "of text", ""])
    weights = np.random.default_rng(1).random((features.DIMS, 3))
    plain = mixing.with_posteriors(docs.select("doc_id", "text"), weights).drop("text").collect()
    whole = mixing.with_posteriors(docs.select(F.struct("doc_id", "text").alias("doc")), weights, "doc.text")
    assert whole.columns == ["doc", "_tokens", "_posterior"]
    assert whole.select("doc.doc_id", "_tokens", "_posterior").collect() == plain
