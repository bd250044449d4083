import random

import numpy as np
import pytest

import corpus_pipeline
from rosterflow.llm import decontam, packing, simhash, suffix, toxicity
from rosterflow.llm.quality import sigmoid

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def grams(text, width=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in low).split(" ") if w]
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} or ({" ".join(words)} if words else set())


def plain_survivors(rows, similar=0.8):
    """Ids of the first row of each group that any pair of similar texts links."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    root, sets = list(range(len(rows))), [grams(r[1]) for r in rows]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][1] == rows[j][1] or (both and both >= similar * len(sets[i] | sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [rows[i][0] for i in range(len(rows)) if find(i) == i]


def near_corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts = []
    for _ in range(40):
        words = [word() for _ in range(rng.randint(30, 400))]
        texts.append(words)
        for _ in range(rng.choice([0, 0, 1, 3, 50])):
            copy = list(words)
            for _ in range(max(1, len(copy) * rng.randint(0, 2) // 100)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("hot", [simhash.HOT, 4])
def test_near_copies_against_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rows = near_corpus(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in simhash.one_of_each_group(docs).collect()}
    want = set(plain_survivors(rows))
    # nothing goes that no link reaches, and the index finds nearly every link
    assert want <= got
    assert len(got - want) <= 0.02 * len(rows)


def star(seed, copies=300, words=400, changed=7):
    """A base behind its copies, which are like the base but rarely like each other."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, texts = [word() for _ in range(words)], []
    for _ in range(copies):
        places = set(rng.sample(range(words), changed))
        texts.append([word() if i in places else w for i, w in enumerate(base)])
    return [(i, " ".join(t)) for i, t in enumerate([*texts, base])]


def test_copies_linked_through_their_base_alone_are_one_group(spark):
    rows = star(5)
    assert plain_survivors(rows) == [0]
    got = [r.doc_id for r in simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    # what is left is what the index itself misses
    assert 0 in got and len(got) <= 0.05 * len(rows)


def test_every_link_at_the_threshold_is_found(spark):
    rows = star(5)
    rows += [(1000 + i, t) for i, t in star(6, copies=100, words=100, changed=2)] + [(2000 + i, t) for i, t in star(7, copies=100, words=30, changed=1)]
    got = sorted(r.doc_id for r in simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain_survivors(rows)


def loose_copies(seed, copies, words=136):
    """Copies of one text with one to five edits: some are like it, some like other copies, some like none."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, texts = [word() for _ in range(words)], []
    for _ in range(copies):
        places = set(rng.sample(range(words), rng.randint(1, 5)))
        texts.append([word() if i in places else w for i, w in enumerate(base)])
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_pairs_of_one_large_group_grow_with_its_size(spark, monkeypatch):
    met = []

    def counted(work, texts, sketches, found, *more, of=simhash.similar_pairs):
        found = work.settle(found)
        met[-1] += found.count()
        return of(work, texts, sketches, found, *more)

    monkeypatch.setattr(simhash, "similar_pairs", counted)
    for copies in (150, 600):
        met.append(0)
        rows = loose_copies(4, copies)
        got = sorted(r.doc_id for r in simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == plain_survivors(rows)
    assert met[1] <= 6 * met[0]


def test_differences_from_a_middle_lose_no_link(spark):
    rng = random.Random(8)
    sets, group = {}, {}
    for main, size in ((-1, 40), (-2, 9), (-3, 60)):
        base = [rng.getrandbits(40) for _ in range(size)]
        for i in range(90):
            few = rng.choice([0.02, 0.05, 0.1, 0.15, 0.5])
            own = {g for g in base if rng.random() > few} | {rng.getrandbits(40) for _ in range(rng.randint(0, int(few * size) + 1))}
            t = -main * 1000 + i
            sets[t], group[t] = own | {7}, main if i % 3 == 0 else t
    # no middle: a main group of unlike texts
    for i in range(30):
        sets[9000 + i], group[9000 + i] = {rng.randrange(12) for _ in range(6)}, -9 if i < 9 else 9000 + i
    main = {t: -(t // 1000) for t in sets}
    members = spark.createDataFrame([(main[t], t, g) for t, g in group.items()], "main long, t long, group long")
    grams = spark.createDataFrame([(t, sorted(v)) for t, v in sets.items()], "t long, grams array<long>")
    told = np.array([], np.int64), np.array([], np.int64)
    described = simhash.unlike_middle(members, grams, simhash.middles(members, grams), told, 0.8)
    found, _ = simhash.met_by_difference(simhash.Workspace(spark), described, 0.8)

    def groups(pairs):
        root = {x: x for x in [*sets, *main.values()]}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in [*group.items(), *pairs]:
            root[find(a)] = find(b)
        found = [find(t) for t in sets]
        return [found.index(f) for f in found]

    like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = [(a, b) for a in sets for b in sets if a < b and main[a] == main[b] and like(a, b)]
    met = {(min(r), max(r)) for r in found.collect()}
    assert groups(p for p in met if like(*p)) == groups(want)
    assert len(groups(want)) > len(set(groups(want))) > 3 and len(met) < len(want)


def test_common_shingles_are_counted_in_all_texts(spark, monkeypatch):
    texts = ["a b c d e f", "a b c d e g", "a b c d e f", "b c d e f h", "unlike all the other texts here"]
    rows = spark.createDataFrame(list(enumerate(texts)), "t long, text string")
    count = lambda: [int(c) for c in simhash.common_shingles(simhash.Workspace(spark), rows, 5)[1]]
    monkeypatch.setattr(simhash, "COMMON", 2)
    # "a b c d e" and "b c d e f" are in three texts each
    assert sorted(count()) == [3, 3]
    monkeypatch.setattr(simhash, "COMMON", 1)
    monkeypatch.setattr(simhash, "TOLD", 2)
    assert sorted(count()) == [3, 3]
    # a level that does not fit is left out as a whole
    monkeypatch.setattr(simhash, "TOLD", 1)
    assert count() == []


def test_stages_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "Three FOUR\nfive six")], "item_id long, text string")
    stages = [
        lambda d: toxicity.clean(d, labels, threshold=1.1),
        simhash.one_of_each_group,
        suffix.deduplicated,
        lambda d: decontam.clean(d, items),
    ]
    for stage in stages:
        assert stage(none).count() == 0
        assert stage(odd).columns == odd.columns and stage(odd).schema.simpleString() == odd.schema.simpleString()
    assert stages[0](odd).count() == odd.count()
    kept = sorted(str(r.doc_id) for r in stages[1](odd).collect())
    assert kept == ["1", "2", "5", "6", "8", "None"]
    assert sorted(str(r.doc_id) for r in stages[3](odd).collect()) == ["2", "4", "5", "6", "8", "None"]


def test_all_stages_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    labels = spark.createDataFrame([(5, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "Three FOUR\nfive six")], "item_id long, text string")
    for name, docs in (("odd", odd.select(NAMES)), ("none", none.select(NAMES))):
        for table_, rows in (("documents", docs), ("labels", labels), ("benchmark", items)):
            rows.coalesce(1).write.parquet(f"{tmp_path}/{name}/{table_}.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(got) == (name == "odd") and all(0 <= r.offset and r.offset + r.length <= packing.LIMIT for r in got)
    assert packing.pack(odd).count() == packing.pack(odd.select(NAMES)).count() and packing.pack(none).count() == 0


def test_cuts_without_a_count_and_with_ties(spark):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(400))
    rows = [(1, passage + " A"), (1, passage + " B"), (2, "C " + passage), (2, "C " + passage), (None, passage + " D")]
    got = sorted(r.text for r in suffix.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # the two rows of the first id are in the order of their hashes, and one of them keeps the passage
    assert sum(passage in t for t in got) == 1 and len(got) == 5 and sum(t.startswith("C") for t in got) == 2


def test_cuts_keep_first_copies_and_whole_characters(spark):
    rng = random.Random(3)
    passage = "".join(rng.choice("äöüßabc é") for _ in range(300))
    rows = [(2, "é" + passage + "ñ tail"), (1, "head ü" + passage + "ö"), (3, passage), (4, None), (5, "unlike")]
    docs = spark.createDataFrame([(*r, "de", "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in suffix.deduplicated(docs).collect()}
    assert set(got) == {1, 2, 4, 5}
    assert got[1] == (rows[1][1], len(rows[1][1])) and got[4] == (None, 0) and got[5] == ("unlike", 6)
    text, n = got[2]
    assert n == len(text) and passage[5:-5] not in text and text.startswith("é") and text.endswith("ñ tail") and "�" not in text


def characters(text, a, b):
    """The largest range of whole characters in bytes a to b."""
    while a < len(text) and text[a] & 0xC0 == 0x80:
        a += 1
    while b < len(text) and text[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def test_run_against_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select(*NAMES).collect()]
    benchmark = [decontam.plain(r.text.encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    weights, base = toxicity.learned(docs, labels)

    def toxic(text):
        hot = {w: max(weights.get(f, 0.0) for f in toxicity.features(w)) for w in toxicity.words_of(text.encode())}
        import numpy as np

        return sigmoid(np.array(base + sum(sorted(v for v in hot.values() if v > 0)[-3:]))) >= toxicity.THRESHOLD

    rows = [r for r in rows if not toxic(r[1])]
    keep = set(plain_survivors(rows))
    rows = sorted(r for r in rows if r[0] in keep)
    from tests.llm.test_suffix import plain_flags

    cut = []
    for r, gone in zip(rows, plain_flags([r[1].encode() for r in rows], 200, "first")):
        text = r[1].encode()
        edges = [i for i in range(1, len(gone)) if gone[i] != gone[i - 1]]
        ranges, inside = [], False
        bounds = [0, *edges, len(gone)]
        for a, b in zip(bounds, bounds[1:]):
            inside = bool(len(gone)) and bool(gone[a]) if a < len(gone) else False
            if inside:
                ranges.append(characters(text, a, b))
        left = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in ranges)], [*(a for a, _ in ranges), len(text)])).decode()
        if left.strip() or not ranges:
            cut.append((r[0], left))
    clean = [(d, t) for d, t in cut if not any(b in decontam.plain(t.encode()) for b in benchmark)]
    got = corpus_pipeline.run(spark, sf).collect()
    from tests.llm.test_packing import plain_pieces

    want = sorted(plain_pieces(clean))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert max(r.offset + r.length for r in got) <= packing.LIMIT
