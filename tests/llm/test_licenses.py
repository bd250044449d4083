import math
import re
import textwrap

from rosterflow.llm import licenses


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    cut = lambda s: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", s) if w]
    words = cut(low)
    places, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += found
        base |= {label} if found else set()
    labels, best = set(base), 0.0
    lines = low.split("\n")
    for i in range(len(lines)):
        block = set(cut("\n".join(lines[i : i + licenses.LINES])))
        for label, notice in licenses.TEMPLATES:
            want = set(licenses.template_words(notice))
            if len(want & block) >= math.ceil(licenses.THRESHOLD * len(want) - 1e-9):
                labels.add(label)
                best = max(best, len(want & block) / len(want))
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else best)


def values(r):
    return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)


def test_query_against_all_templates(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: values(r) for r in licenses.op8_licenses(spark, sf).collect()}
    assert got == {d: plain(t) for d, t in docs}
    assert any(v[5] != v[4] for v in got.values())


def test_notices_and_near_notices(spark):
    texts = [notice for _, notice in licenses.TEMPLATES]
    texts += [" ".join(t.split()[:-1]) for t in texts] + ["x " + t.upper().replace(" ", " -- ") + " y" for t in texts]
    texts += ["CC BY cc-by", "xcc by", "cc byx", "cc. By", "All rights\nreserved", "ALL RIGHTS RESERVED all rights reserved", "écc by", "cc byé", "a_cc by_", "the General\n\nPublic  License."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: values(r) for r in licenses.report(licenses.scan(df)).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_notices_that_wrap(spark):
    texts = ["\n".join(["before it", *textwrap.wrap(notice, width), "after it"]) for _, notice in licenses.TEMPLATES for width in (40, 60, 76)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: values(r) for r in licenses.report(licenses.scan(df)).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert all(r[5] for r in got.values()) and all(label in got[3 * i][5] for i, (label, _) in enumerate(licenses.TEMPLATES))


def test_lower_case_of_every_letter(spark):
    from pyspark.sql import functions as F

    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c,) for c in every], "text string")
    for r in df.select("text", licenses.lowered(F.col("text")).alias("low")).toLocalIterator():
        if r.text.isascii():
            assert r.low == (r.text.lower() if "A" <= r.text <= "Z" else r.text)
        else:
            assert not any(c.isascii() for c in r.low)


def test_odd_rows(odd, none):
    got = sorted((str(r.doc_id), str(values(r))) for r in licenses.report(licenses.scan(odd)).collect())
    assert got == sorted((str(r.doc_id), str(plain(r.text))) for r in odd.select("doc_id", "text").collect())
    assert licenses.report(licenses.scan(none)).count() == 0
