import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterflow.llm import suffix


def plain_flags(texts, length, keep):
    """For each text, which bytes go; texts are in their order."""
    seen = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            seen.setdefault(t[s : s + length], []).append((i, s))
    out = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        for i, s in places[1 if keep == "first" else 0 :] if len(places) > 1 else ():
            out[i][s : s + length] = True
    return out


def plain_report(rows, length, keep):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    texts = [(rows[i][1] or "").encode() for i in order]
    out = []
    for i, text, gone in zip(order, texts, plain_flags(texts, length, keep)):
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        out.append((str(rows[i][0]), len(text), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(found):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.removal_report(*found).collect())


def in_common(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=60), min_size=1, max_size=5), st.integers(1, 40), st.booleans())
def test_longest_factors_against_all_pairs(texts, length, later):
    texts = [bytes(97 + b % 2 for b in t) for t in texts]
    whole, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
    places = [(s, int(e)) for e, t in zip(ends, texts) for s in range(e - len(t), max(e - len(t), e - length + 1))]
    starts, stops = np.array(places, np.int64).reshape(-1, 2).T
    got = suffix.longest_factors(np.frombuffer(whole, np.uint8), starts, stops, length, later)
    for k, (s, e) in enumerate(places):
        others = places if later else places[:k]
        want = max((in_common(whole[s:e], whole[x:y]) for x, y in others if x != s), default=0)
        assert got[k] == want or want > length <= got[k] <= want


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=80), st.integers(1, 30))
def test_common_lengths(text, depth):
    text = bytes(97 + b % 2 for b in text)
    order = suffix.SuffixOrder(np.frombuffer(text, np.uint8), depth)
    i, j = (x.ravel() for x in np.mgrid[: len(text), : len(text)])
    for a, b, n in zip(i.tolist(), j.tolist(), order.common(i, j).tolist()):
        want = in_common(text[a:], text[b:])
        assert n == want or want > depth <= n <= want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=40, unique=True))
def test_smaller_neighbours(values):
    before, after = suffix.smaller_neighbours(np.array(values, np.int64))
    n = len(values)
    for i, v in enumerate(values):
        assert before[i] == max((j for j in range(i) if values[j] < v), default=-1)
        assert after[i] == min((j for j in range(i + 1, n) if values[j] < v), default=n)


def test_equal_runs_have_equal_anchors():
    rng = random.Random(8)
    run = bytes(rng.randrange(256) for _ in range(200))
    texts = [bytes(rng.randrange(256) for _ in range(n)) + run + bytes(rng.randrange(256) for _ in range(m)) for n, m in ((0, 0), (5, 900), (333, 1), (150, 150))]
    row, position, h = suffix.anchors(texts, 200)
    found = []
    for i, t in enumerate(texts):
        at = t.index(run)
        found.append({(p - at, x) for r, p, x in zip(row.tolist(), position.tolist(), h.tolist()) if r == i and 0 <= p - at <= 100})
    assert set.intersection(*found)


def corpus(rng, n=60):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared, rows = [prose(rng.randint(20, 90)) for _ in range(6)], []
    for i in range(n):
        parts = [prose(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            text = rng.choice(shared)
            cut = rng.randint(0, len(text) // 2)
            parts += [text[cut:] if rng.random() < 0.5 else text, prose(rng.randint(0, 40))]
        rows.append((i, "".join(parts)))
    rows += [(n + i, rows[i][1]) for i in range(5)]
    rows += [(n + 10 + i, rows[i][1][:150] + "X" + rows[i][1][150:]) for i in range(8)]
    rows += [(n + 30, "ab " * 400), (n + 31, "ab " * 300), (n + 32, "z" * 1000), (n + 33, "z" * 199), (n + 34, "")]
    return rows


@pytest.mark.parametrize("keep", ["first", "none"])
@pytest.mark.parametrize("widest", [suffix.WIDEST, 3])
def test_corpus_against_all_substrings(spark, monkeypatch, keep, widest):
    monkeypatch.setattr(suffix, "WIDEST", widest)
    monkeypatch.setattr(suffix, "BUCKET", 40)
    rows = corpus(random.Random(21))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(suffix.duplicate_spans(docs, 200, keep)) == plain_report(rows, 200, keep)


def test_query_against_all_substrings(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.op5_suffix(spark, sf).collect())
    assert found == plain_report(rows, 200, "none")


def test_odd_rows(odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert got(suffix.duplicate_spans(odd, 20, "none")) == plain_report(rows, 20, "none")
    assert suffix.removal_report(*suffix.duplicate_spans(none)).count() == 0
