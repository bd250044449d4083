import hashlib

from pyspark.sql import functions as F

from rosterflow.llm import fingerprint as fp


def test_query_edits_and_orders(spark, sf):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in fp.op3_fingerprint(spark, sf).collect()}
    assert len(got) == len(docs)
    text_of, better, prints = dict(docs), 0, {}
    for i, (d, text) in enumerate(docs):
        follows, r = docs[(i + 1) % len(docs)][1], got[d]
        half = len(text) // 2
        edited = text[: len(text) - half] + follows[:half]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        better += r.near_edited > r.near_next or follows == text
        prints.setdefault(text_of[d], set()).add(r.fingerprint)
        prints.setdefault(edited, set()).add(r.edited_fingerprint)
    assert all(len(v) == 1 for v in prints.values())
    assert len({min(v) for v in prints.values()}) == len(prints)
    assert better >= 0.97 * len(docs)


def test_fingerprints_do_not_depend_on_order_and_take_edits(spark):
    rows = [("a\nb b\nc", "c\na\nb b", "a\nc", "b b"), ("x" * 300 + "\ny\nx", "y\n" + "x" * 300 + "\nx", "x" * 300 + "\nx", "y")]
    df = spark.createDataFrame(rows, "whole string, mixed string, less string, one string")
    for c in df.columns:
        df = fp.with_fingerprint(df, c, f"f_{c}")
    for r in df.select("*", fp.add(F.col("f_less"), F.col("f_one")).alias("plus"), fp.subtract(F.col("f_whole"), F.col("f_one")).alias("minus")).collect():
        assert r.f_whole == r.f_mixed == r.plus
        assert r.minus == r.f_less != r.f_whole


def test_odd_rows(spark, odd, none):
    rows = fp.edited_fingerprints(odd).collect()
    texts = odd.select("doc_id", "text").collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in rows) == sorted((str(t.doc_id), len(t.text or "")) for t in texts)
    assert len({r.fingerprint for r in rows if r.doc_id in (2, 4)}) == 1
    assert fp.edited_fingerprints(none).count() == 0
    one = fp.edited_fingerprints(spark.createDataFrame([(3, "abc\ndef")], "doc_id long, text string")).first()
    assert (one.near_next, one.edited_sha256) == (1.0, hashlib.sha256(b"abc\nabc").hexdigest())


def test_next_row_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 7)
    ids = [i * i % 9973 for i in range(500)]
    rows = [(i if i % 5 else None, f"text {i} {k}") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fp.with_next(docs, ["doc_id", "text"]).collect()
    pairs = {(r.text, r.next_text): (r.doc_id, r.next_doc_id) for r in got}
    assert len(got) == len(rows) and len({r.next_text for r in got}) == len(rows)
    named = sorted(d for d, _ in rows if d is not None)
    steps = sorted((a, b) for a, b in pairs.values() if a is not None and b is not None)
    assert steps == sorted(zip(named, named[1:]))
    assert [b for a, b in pairs.values() if a is None].count(named[0]) == 1


def test_likeness_of_texts_with_many_equal_runs(spark):
    many = "\n".join(["one short line"] * 40_000)
    df = spark.createDataFrame([(many, many[: len(many) // 2], "another\n" * 40_000)], "a string, b string, c string")
    for c in "abc":
        df = fp.with_fingerprint(df, c, f"f_{c}")
    at = {c: fp.coordinates(F.col(f"f_{c}")) for c in "abc"}
    r = df.select(fp.likeness(F.col("f_a"), F.col("f_b"), at["a"], at["b"]).alias("half"), fp.likeness(F.col("f_a"), F.col("f_c"), at["a"], at["c"]).alias("other")).first()
    assert r.half > 0.99 and r.other < 0.5
