import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterflow.llm import decontam


def plain_edits(item, text):
    """Least edit distance of ``item`` to a substring of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row = row, [i] * (len(text) + 1)
        for j, b in enumerate(text, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a != b))
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=12), st.binary(max_size=30), st.integers(0, 9))
def test_bit_parallel_distance(item, text, most):
    item, text = bytes(b % 4 for b in item), bytes(b % 4 for b in text)
    assert decontam.least_edits(item, text, most) == min(plain_edits(item, text), most + 1)


def test_query_finds_every_exact_leak(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = [(r.doc_id, decontam.plain(r.text.encode())) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, decontam.plain(r.text.encode())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.op10_decontamination(spark, sf).collect()}
    want = {(d, i) for d, t in docs for i, b in items if b in t}
    assert {k for k, v in got.items() if v == 0} == want
    texts, wanted = dict(docs), dict(items)
    assert all(plain_edits(wanted[i], texts[d]) == v for (d, i), v in got.items() if v and len(texts[d]) < 5000)


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        rng.choice([lambda: out.pop(at), lambda: out.insert(at, rng.choice("aeiou")), lambda: out.__setitem__(at, rng.choice("xyz"))])()
    return "".join(out)


def test_recall_of_edited_leaks(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(15, 60)))) for i in range(40)]
    docs, planted = [], {}
    for i, text in items:
        for k, share in enumerate((0, 0.01, 0.03, 0.05, 0.07, 0.09)):
            edits = int(share * len(text))
            docs.append((10 * i + k, " ".join(word() for _ in range(rng.randint(0, 50))) + " " + edited(rng, text, edits) + "\n" + word()))
            planted[10 * i + k, i] = edits
    docs += [(1000 + i, " ".join(word() for _ in range(300))) for i in range(50)]
    found = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.distance for r in found.collect()}
    assert set(got) <= set(planted)
    assert len(got) >= 0.97 * len(planted)
    assert all(v <= planted[k] for k, v in got.items())


def test_no_leak_within_a_tenth_is_lost():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))
    items = []
    for n in (150, 400, 800, 1500):
        items += [decontam.plain(" ".join(word() for _ in range(n // 5)).encode())[:n] for _ in range(25)]
    texts = [(word() + " " + edited(rng, t.decode(), len(t) // 10) + " " + word()).encode() for t in items]
    found = {(row, item) for row, item, _ in decontam.Items(items, 0.1).leaks(texts)}
    assert found == {(i, i) for i in range(len(items))}


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "Three FOUR\nfive six"), (2, None), (3, ""), (None, "日本語"), (4, "a row without an id"), (1, "three four five six")], "item_id long, text string")
    got = sorted((str(r.doc_id), str(r.item_id)) for r in decontam.leaks(odd, items).collect())
    assert got == sorted([("1", "1")] * 4 + [("7", "1")] * 2 + [("8", "None"), ("None", "4")])
    assert decontam.leaks(none, items).count() == decontam.leaks(odd, items.limit(0)).count() == 0


def test_items_beyond_a_block_are_all_searched(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 30)
    items = spark.createDataFrame([(i, f"item number {i} of a longer list") for i in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x item number {i} of a longer list y") for i in range(9)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items, max_edit=0.0).collect()} == {(i, i) for i in range(9)}


def test_walks_are_the_same_alone_and_together():
    rng = np.random.default_rng(2)
    bits = decontam.walk_bits(60)
    buffer = rng.integers(0, 256, 500).astype(np.uint8)
    starts, lengths = rng.integers(0, 470, 20), rng.integers(1, 30, 20)
    together = decontam.embed(buffer, starts, lengths, bits)
    for i in range(20):
        own = np.append(buffer[starts[i] : starts[i] + lengths[i]], 0).astype(np.uint8)
        assert (decontam.embed(own, np.array([0]), lengths[i : i + 1], bits) == together[i]).all()


def test_walks_of_edited_items_agree_too_seldom_to_find_them_by():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))
    recall = []
    for k in range(30):
        item = " ".join(word() for _ in range(100))[:400]
        bits = np.random.default_rng(k).integers(0, 2, (1200, 256))
        x, y = (decontam.embed(np.frombuffer((t + " " * 60).encode(), np.uint8), np.array([0]), np.array([400]), bits)[0] for t in (item, edited(rng, item, 36)))
        agree = (x == y)[(x > 0) | (y > 0)].mean()
        recall.append(1 - (1 - agree**12) ** 512)
    assert np.mean(recall) < 0.6
