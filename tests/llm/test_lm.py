import math
import zlib
from collections import Counter

import numpy as np

from rosterflow.llm import lm


def plain_base(rows):
    """doc_id -> (held_out, n_tokens, n_known, N, base)."""
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = Counter(w for d, t in rows if not out(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    found = []
    for d, t in rows:
        own = tokens(t)
        found.append((str(d), out(d), len(own), sum(w in c for w in own), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), 6)))
    return sorted(found)


def base_of(rows):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)


def test_query_against_counts_whatever_travels(spark, sf, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want, scores = plain_base(rows), []
    for frequent in (lm.FREQUENT, 600):
        monkeypatch.setattr(lm, "FREQUENT", frequent)
        got = lm.op9_lm(spark, sf).collect()
        assert base_of(got) == want
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)
        scores.append({r.doc_id: r.score for r in got})
    assert all(math.isclose(scores[0][d], scores[1][d], rel_tol=1e-9) for d in scores[0])


def test_class_probabilities_add_up():
    rng = np.random.default_rng(1)
    pairs = rng.poisson(rng.random((2, 1, lm.CLASSES)) * 3, (2, lm.CLASSES, lm.CLASSES)).astype(float)
    t = lm.tabulated(*lm.train(pairs, steps=20))
    for a, b in ((0, 0), (5, 200), (511, 128)):
        total = np.exp(t["one"][a].astype(float) + t["two"][b] + t["bias"] - t["norms"][a, b]).sum()
        assert math.isclose(total, 1, rel_tol=1e-4)


def test_training_finds_what_follows():
    pairs = np.ones((2, lm.CLASSES, lm.CLASSES)) * 0.01
    for k in range(0, 100, 2):
        pairs[0, k, k + 1] = 500
    q, r, b = lm.train(pairs, steps=150)
    s = q[0] @ r.T + b
    assert np.mean([s[k].argmax() == k + 1 for k in range(0, 100, 2)]) > 0.9


def test_weights_suit_all_training_texts(spark):
    rng = np.random.default_rng(8)
    vocabulary = {lm.END: lm.SHARED} | {f"w{i}".encode(): lm.SHARED + 1 + i for i in range(20)}
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 20, n)) for n in rng.integers(0, 30, 60)] + [" ".join(f"w{i % 20}" for i in range(20_000)), ""]
    pairs = lm.class_pairs(spark.createDataFrame([(t,) for t in texts], "text string"), spark.sparkContext.broadcast(vocabulary))
    q, r, b = lm.train(pairs, steps=30)
    lines = [[lm.SHARED, lm.SHARED, *(vocabulary[w] for w in t.encode().split()), lm.SHARED] for t in texts]
    t2, t1, t0 = np.array([x for s in lines for x in zip(s, s[1:], s[2:])]).T
    counted = np.zeros((lm.CLASSES, lm.CLASSES))
    np.add.at(counted, (t2, t1), 1)
    assert (lm.contexts(pairs) == counted).all()
    fits = {}
    for w1 in (0.4, 0.6, 0.8, 1.0):
        for w2 in (0.0, 0.2, 0.4, 0.6, 0.8):
            one, two = w1 * (q[0] @ r.T), w2 * (q[1] @ r.T)
            fits[w1, w2] = (one[t1, t0] + two[t2, t0] + b[t0] - lm.log_norms(one, two, b)[t1, t2]).sum()
    w1, w2 = max(fits, key=fits.get)
    got = lm.mixed(q, r, b, pairs)
    assert np.allclose(got[0], w1 * q[0]) and np.allclose(got[1], w2 * q[1])


def test_steps_follow_the_gradient():
    rng = np.random.default_rng(4)
    q, r, b = rng.normal(0, 0.1, (2, lm.CLASSES, lm.WIDTH)), rng.normal(0, 0.1, (lm.CLASSES, lm.WIDTH)), np.full(lm.CLASSES, -6.0)
    noise = np.full(lm.CLASSES, 1 / lm.CLASSES)
    # what follows depends on both classes before, which neither tells alone
    t2, t1 = rng.integers(0, 2, (2, 400_000))
    t0 = 10 + 2 * t2 + t1
    trainer = lm.Trainer(q, r, b, noise, seed=1, rate=0.2)
    for k in range(0, len(t0), 1000):
        trainer.step(t2[k : k + 1000], t1[k : k + 1000], t0[k : k + 1000])
    assert trainer.tokens == len(t0)
    p = trainer.p
    for a in (0, 1):
        for c in (0, 1):
            scores = (p["q1"][c] + p["q2"][a]) @ p["r"].T + p["b"]
            assert scores.argmax() == 10 + 2 * a + c


def test_all_partitions_train_and_are_averaged(spark):
    rng = np.random.default_rng(5)
    vocabulary = {lm.END: lm.SHARED} | {f"w{i}".encode(): lm.SHARED + 1 + i for i in range(20)}
    docs = spark.createDataFrame([(" ".join(f"w{i}" for i in rng.integers(0, 20, 50)),) for _ in range(40)], "text string").repartition(3)
    shared = spark.sparkContext.broadcast(vocabulary)
    pairs = lm.class_pairs(docs, shared)
    q, r, b = lm.train(pairs, steps=30)
    share = pairs[0].sum(0) + 0.5
    got = lm.refined(docs, shared, q, r, b, share)
    assert [x.shape for x in got] == [q.shape, r.shape, b.shape] and not np.allclose(got[0], q)
    same = lm.refined(docs, shared, q, r, b, share)
    assert all(np.allclose(x, y) for x, y in zip(got, same))
    none = lm.refined(docs.limit(0), shared, q, r, b, share)
    assert all(np.allclose(x, y) for x, y in zip(none, (q, r, b)))


def test_odd_rows(odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = lm.score(odd).collect()
    assert base_of(got) == plain_base(rows) and all(r.score < 0 for r in got)
    assert lm.score(none).count() == 0
    assert lm.score(odd, odd["doc_id"] < 0).count() == len(rows)
