import json
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

from rosterflow.llm import packing


def plain_pieces(rows, limit=packing.LIMIT):
    tokenizer, out = Tokenizer.from_file(packing.default_tokenizer()), []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]
        for k in range(0, len(ids), limit):
            part = ids[k : k + limit]
            out.append((doc_id, k // limit, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def check(rows, got, limit=packing.LIMIT):
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(plain_pieces(rows, limit), key=key)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= limit
    return len(places)


def plain_best_fit(lengths, limit):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(limit - n)
    return len(rooms)


def test_query_against_the_plain_tokenizer(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = packing.op6_packing(spark, sf).collect()
    assert check(rows, got) == plain_best_fit([r.length for r in got], packing.LIMIT)


def test_runs_place_like_one_by_one():
    rng = random.Random(5)
    for limit in (1, 7, 30, 100):
        for _ in range(30):
            lengths = [min(limit, rng.choice([1, 2, 3, limit, rng.randint(1, limit)])) for _ in range(rng.randint(1, 200))]
            counts = Counter(lengths)
            places, used = packing.best_fit(counts, limit), defaultdict(list)
            for n, count in counts.items():
                for rank in range(count):
                    start, each, first, offset = [p for p in places[n] if p[0] <= rank][-1]
                    used[first + (rank - start) // each].append((offset + (rank - start) % each * n, n))
            for own in used.values():
                ends = [0, *(o + n for o, n in sorted(own))]
                assert ends[:-1] == sorted(o for o, _ in own) and ends[-1] <= limit
            assert len(used) == plain_best_fit(lengths, limit)


def test_odd_rows(odd, none):
    rows = odd.select("doc_id", "text").collect()
    check(rows, packing.pack(odd).collect())
    check(rows, packing.pack(odd, limit=5).collect(), 5)
    assert packing.pack(none).count() == 0


def test_white_space_and_special_strings(spark):
    texts = ["a\x0bb", "a\x1cb", "a b", "don't  stop", "<|endoftext|> x<|startoftext|>y", "é ́x", "AΣ Σ", " line", "1234 5six", "\u0085 x", "İstanbul ǅ", "Éa, ÀB' c's. d'S l'été.", "e\u0301t A\u030a X", "<|ENDOFTEXT|>", "x<|endoftext|>Y Z", "a..b a.,b ,a (b) c|d &% ß.", "naïve! ÷a×b"]
    rows = list(enumerate(texts))
    check(rows, packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_another_tokenizer_is_given_whole_texts():
    spec = json.loads(Path(packing.default_tokenizer()).read_text(encoding="utf-8"))
    spec["normalizer"] = {"type": "NFC"}
    ids, plain = packing.WordIds(json.dumps(spec)), Tokenizer.from_str(json.dumps(spec))
    for text in ("Some Words, IN capitals", "été É"):
        assert ids(text.encode()) == packing.pack_ids(plain.encode(text, add_special_tokens=False).ids)
    assert not ids.by_words and packing.WordIds(Path(packing.default_tokenizer()).read_text(encoding="utf-8")).by_words
