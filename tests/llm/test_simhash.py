import numpy as np
import xxhash

from rosterflow.llm import components, simhash
from rosterflow.llm.components import connected
from rosterflow.llm.workspace import Workspace


def plain_fingerprint(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps):
    """[(doc_id, fp)] -> component of each row, comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(fps):
        groups.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return [least[find(i)] for i in range(len(fps))]


def test_query_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [(r.doc_id, plain_fingerprint(r.text, 3)) for r in docs]
    want = {d: (f"{f:016x}", c) for (d, f), c in zip(fps, plain_components(fps))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1_simhash(spark, sf).collect()}
    assert got == want


def test_odd_rows(spark, odd, none):
    rows = simhash.near_duplicates(odd, 3).collect()
    texts = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    fps = [(d, plain_fingerprint(t, 3)) for d, t in texts]
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    want = sorted(((d, f, c) for (d, f), c in zip(fps, plain_components(fps))), key=key)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in rows), key=key) == want
    assert simhash.near_duplicates(none, 3).count() == 0


def test_index_finds_every_pair_in_a_dense_cluster(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2**63))
    some = {base}
    while len(some) < 300:
        x = base
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            x ^= 1 << int(b)
        some.add(x)
    signed = [x - 2**64 if x >= 2**63 else x for x in some]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = connected(Workspace(spark), spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_few_links_are_labelled_at_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(-900, 900, (700, 2))] + [(5000 + i, 5000 + (i + 1) % 300) for i in range(299)] + [(-(2**63), 2**63 - 1), (7, 7)]
    links, rows = spark.createDataFrame(edges, "a long, b long"), lambda df: sorted(map(tuple, df.collect()))
    work, written = Workspace(spark), []
    monkeypatch.setattr(work, "settle", lambda df, f=work.settle: written.append(1) or f(df))
    got = rows(connected(work, links))
    assert len(written) == 1
    monkeypatch.setattr(components, "FEW", 0)
    assert got == rows(connected(work, links)) and len(written) > 2
