import zlib

import numpy as np
import pytest

from rosterflow.llm import quality, toxicity


def held_out_marks(spark, sf, found, label):
    marks = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = found.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    return [(marks[r.doc_id], r.predicted, r.score) for r in rows if r.held_out and r.doc_id in marks]


# there are only some 300 toxic texts in four languages to learn from here
@pytest.mark.parametrize(("query", "label", "threshold", "least"), [(quality.op4_quality, "quality", 0.5, 0.95), (toxicity.op7_toxicity, "toxic", 0.7, 0.8)])
def test_held_out_accuracy(spark, sf, query, label, threshold, least):
    sf = sf.replace("0.001", "0.1")
    own = held_out_marks(spark, sf, query(spark, sf), label)
    assert all(p == (s >= threshold) for _, p, s in own)
    hits = {k: np.mean([m == p for m, p, _ in own if m == k]) for k in (0, 1)}
    assert min(hits.values()) > least, hits


@pytest.mark.parametrize(("classify", "label"), [(quality.classify, "quality"), (toxicity.classify, "toxic")])
def test_odd_rows(spark, odd, none, classify, label):
    marks = spark.createDataFrame([(5, 1, 1), (7, 0, 0), (8, 0, 1), (5, 1, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    assert classify(odd, marks).count() == odd.count()
    assert all(0 <= r.score <= 1 for r in classify(odd, marks.limit(0)).collect())
    assert classify(none, marks).count() == 0


def test_chunks_cover_texts_of_every_length():
    net = quality.Network.random(3)
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, 256, n, np.uint8).tobytes() for n in [*range(40), 64, 1000]]
    together = net.logits(texts)
    alone = np.concatenate([net.logits([t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-4)
    for t in texts[1:]:
        other = t[:-1] + bytes([t[-1] ^ 0xFF])
        assert not np.array_equal(net.pooled([t]), net.pooled([other])) or len(t) > 16


def test_quality_scores_against_chunks_one_by_one(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    sample = quality.labelled_sample(docs, labels, "quality", quality.FIT_ROWS)
    p = quality.fit([t for t, _ in sample], np.array([m for _, m in sample], np.float64)).p

    def plain(text):
        code = np.frombuffer(text, np.uint8)
        n = max(1, -(-len(code) // 8) - 1)
        code = np.concatenate([code, np.zeros(8 * (n + 1) - len(code), np.uint8)])
        best = np.full(quality.FILTERS, -np.inf)
        for k in range(n):
            chunk = code[8 * k : 8 * k + 16]
            seen = p["embed"][chunk].ravel()
            lags = [sum(code[i] != 0 and i >= lag and code[i] == code[i - lag] for i in range(8 * k, 8 * k + 16)) / 16 for lag in range(1, quality.LAGS + 1)]
            best = np.maximum(best, seen[:32] @ p["near"] + seen[32:] @ p["far"] + np.array(lags) @ p["lags"] + p["bias"])
        return float(np.maximum(best, 0) @ p["top"] + p["base"][0])

    got = {r.doc_id: r.score for r in quality.op4_quality(spark, sf).collect()}
    short = [r for r in docs.collect() if len(r.text) < 1500]
    assert len(short) > 50
    for r in short:
        assert abs(got[r.doc_id] - quality.sigmoid(np.array(plain(r.text.encode())))) < 1e-3


def test_toxicity_scores_against_words_one_by_one(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    weights, base = toxicity.learned(docs, labels)
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.op7_toxicity(spark, sf).collect()}
    for r in docs.collect():
        words = {w.strip(toxicity.EDGES) for w in r.text.encode().lower().split()} - {b""}
        each = sorted((max([0.0, weights.get((0, w), 0.0), *(weights.get((n, w[:n]), 0.0) for n in range(4, 9) if len(w) > n)]) for w in words), reverse=True)
        want = 1 / (1 + np.exp(-(base + sum(each[:3]))))
        assert abs(got[r.doc_id][0] - want) < 1e-9 and got[r.doc_id][1] == (want >= 0.7)


def test_risks_against_texts_one_by_one(spark):
    rng = np.random.default_rng(9)
    weights = np.append(rng.normal(0.5, 1, 12), 0.0)
    rows = [[tuple(sorted(set(rng.integers(0, 12, rng.integers(1, 5)).tolist()))) for _ in range(rng.integers(0, 7))] for _ in range(50)]
    rows = [sorted(set(r)) for r in rows]
    counts = rng.integers(1, 4, 50)
    want = {"n": counts.sum(), "loss": 0.0, "slope": 0.0, "clean": np.zeros(13)}
    for r, c in zip(rows, counts):
        top = sorted(((max(weights[i] for i in ids), ids) for ids in r), reverse=True)[:3]
        top = [(x, ids) for x, ids in top if x > 0]
        s = 1 / (1 + np.exp(-(sum(x for x, _ in top) - 1.0)))
        want["loss"] -= c * np.log1p(-s)
        want["slope"] += c * s
        for x, ids in top:
            want["clean"][[i for i in ids if weights[i] == x][0]] += c * s
    flat = [([x for ids in r for x in (*ids, -1)], int(c)) for r, c in zip(rows, counts)]
    got = toxicity.risks_over(spark.createDataFrame(flat, "flat array<int>, n bigint").repartition(4), weights, -1.0)
    assert got["n"] == want["n"] and abs(got["loss_clean"] - want["loss"]) < 1e-9 and abs(got["slope_clean"] - want["slope"]) < 1e-9
    assert np.allclose(got["clean"], want["clean"])
