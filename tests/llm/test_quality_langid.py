from __future__ import annotations

import math
import random
import tracemalloc
import zlib

import numpy as np

from skyledger.llm import langid, quality_cnn, queries

BIG = "/root/testdata/sf0.01"


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_cnn.fit_quality(docs, labels)
    rows = quality_cnn.score_quality(docs, model).join(labels.withColumnRenamed("doc_id", "id"), "id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9
    good = [r.score for r in held if r.quality == 1]
    bad = [r.score for r in held if r.quality == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.9


def test_whole_text_counts():
    model = quality_cnn.ByteCnn()
    text = b"a" * 5000
    assert model.probability(text) != model.probability(text + b"### *** ###")
    top, _ = model.pooled(quality_cnn.laid_out(text))
    assert len(top) == 10


def test_responses_by_hand():
    model = quality_cnn.ByteCnn()
    data = quality_cnn.laid_out(bytes(range(256)) * 3)
    want = [sum(model.w[j, data[p + j]] for j in range(quality_cnn.WIDTH)) for p in range(0, 512, quality_cnn.STRIDE)]
    assert np.allclose(model.pooled(data)[0][0], np.max(want, axis=0), atol=1e-4)


def test_gradient_agrees_with_differences():
    model, text = quality_cnn.ByteCnn(), b"some text to judge " * 40
    model.w = model.w.astype(np.float64)
    model.v = model.v.astype(np.float64)
    data = quality_cnn.laid_out(text)
    grad = {k: np.zeros_like(getattr(model, k), dtype=np.float64) for k in "wbvc"}
    model._backward(data, 1.0, 1.0, grad)

    def loss():
        return -np.log(model._combine(np.maximum(model.pooled(data)[0].astype(np.float64) + model.b, 0))[0])

    for name, at in (("v", (3,)), ("v", (20,)), ("c", (0,)), ("b", (2,))):
        p = getattr(model, name).astype(np.float64)
        setattr(model, name, p)
        before, h = p[at], 1e-3
        p[at] = before + h
        up = loss()
        p[at] = before - h
        down = loss()
        p[at] = before
        assert abs((up - down) / (2 * h) - grad[name][at]) < 2e-3


def test_quality_edges(make_docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = make_docs([(1, None), (2, ""), (None, "x"), (1, None)])
    found = quality_cnn.score_quality(rows, quality_cnn.fit_quality(rows, labels)).collect()
    assert len(found) == 4 and all(r.score == 0.5 for r in found)
    assert quality_cnn.score_quality(make_docs([]), quality_cnn.ByteCnn()).count() == 0
    kept = quality_cnn.keep_good(rows, quality_cnn.ByteCnn().fit([], []))
    assert kept.columns == rows.columns and kept.count() == 4


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    model = langid.fit_languages(docs)
    rows = langid.predict_languages(docs, model).join(docs.select("lang", docs.doc_id.alias("id")), "id").collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(make_docs):
    rows = make_docs([(1, "le chat est sur la table et le chien"), (2, "the cat is on the table and the dog"), (3, None), (4, "123 !!"), (5, "")])
    found = {r.id: r for r in langid.predict_languages(rows, langid.fit_languages(rows)).collect()}
    assert found[3].lang_pred == found[4].lang_pred == found[5].lang_pred == "und" and found[3].score == 0
    none = langid.fit_languages(make_docs([]))
    assert {r.lang_pred for r in langid.predict_languages(rows, none).collect()} == {"und"}


def test_counts_by_hand():
    raw = langid.counts([b"Abc", b"", b"xyz abc"])
    assert raw.sum(axis=1).tolist() == [2 * (3 + 2), 2 * 2, 2 * (7 + 2)]
    assert (langid.counts([b"xyz abc"])[0] == raw[2]).all() and (langid.counts([b"abc"])[0] == raw[0]).all()


def test_blocks_change_nothing(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab é世.  \n9Z", k=rng.randrange(0, 200))).encode() for _ in range(200)] + [b"", b" ", b"...", b"a", b" " * 50 + b"b" + b" " * 50]
    want = langid.counts(texts)
    for block in (1, 2, 7, 64):
        monkeypatch.setattr(langid, "BLOCK", block)
        assert (langid.counts([memoryview(t) for t in texts]) == want).all()
        assert [langid.has_letter(memoryview(t)) for t in texts] == [any(map(str.isalpha, t.decode())) for t in texts]


def test_memory_does_not_grow_with_a_text():
    text = memoryview("Ein langer Text, immer wieder. ".encode() * 1_300_000)  # 40 MB
    tracemalloc.start()
    raw = langid.counts([text])
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 100_000_000 and raw.sum() > 2 * 30_000_000


def test_prediction_is_the_nearest_centroid_by_plain_search(docs):
    model = langid.fit_languages(docs)
    rows = docs.orderBy("doc_id").limit(60).collect()
    found = {r.id: r for r in langid.predict_languages(docs, model).collect()}
    for r in rows:
        text = " ".join("".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or ord(c) > 127 else " " for c in r.text or "").split()).encode()
        padded, vector = b" " + text + b"   ", {}
        for i in range(len(text) + 2):
            a, b, c = padded[i : i + 3]
            two = (a * 0x9E3779B1 + b * 0x85EBCA77) % 2**32
            three = ((two ^ 0x27D4EB2F) + c * 0xC2B2AE3D) % 2**32
            for x in (two, three):
                bucket = ((x ^ x >> 15) * 0x2C1B3C6D) % 2**32 >> 20
                vector[bucket] = vector.get(bucket, 0) + 1
        weighted = {k: math.log1p(n) * float(model.idf[k]) for k, n in vector.items()}
        norm = math.sqrt(sum(x * x for x in weighted.values()))
        cosine = [sum(x * float(c[k]) for k, x in weighted.items()) / norm for c in model.centroids]
        best = max(range(len(cosine)), key=cosine.__getitem__)
        if any(map(str.isalpha, r.text or "")):
            assert found[r.doc_id].lang_pred == model.names[best] and abs(found[r.doc_id].score - max(0.0, cosine[best])) < 1e-4
            assert found[r.doc_id].rejected == (found[r.doc_id].score < model.limits[best])
        else:
            assert (found[r.doc_id].lang_pred, found[r.doc_id].score) == ("und", 0.0)


def test_quality_query_by_brute_force(spark, sf):
    """Every score of the query from windows taken one by one."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_cnn.fit_quality(docs, labels)
    found = {r.doc_id: r for r in queries.op3_quality(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert set(found) == {r.doc_id for r in rows}
    for r in sorted(rows, key=lambda r: len(r.text or ""))[:: max(1, len(rows) // 40)]:
        text = (r.text or "").encode()[:60_000]
        n = max(1, -(-len(text) // quality_cnn.CHUNK))
        data = text + b" " * (n * quality_cnn.CHUNK + quality_cnn.WIDTH - len(text))
        chunks = []
        for k in range(n):
            windows = [sum(model.w[j, data[p + j]] for j in range(quality_cnn.WIDTH)) for p in range(k * quality_cnn.CHUNK, (k + 1) * quality_cnn.CHUNK, quality_cnn.STRIDE)]
            chunks.append(np.maximum(np.max(windows, axis=0) + model.b, 0))
        pooled = np.concatenate((np.mean(chunks, axis=0), np.max(chunks, axis=0)))
        score = 1 / (1 + math.exp(-max(-30, min(30, float(pooled @ model.v + model.c[0])))))
        if len(text) == len((r.text or "").encode()):
            assert abs(found[r.doc_id].score - score) < 1e-4 and found[r.doc_id].predicted == int(found[r.doc_id].score >= 0.3)
            assert found[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
