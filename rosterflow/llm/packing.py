"""Best-fit-decreasing packing of tokenized documents into sequences.

Documents are tokenized and cut into pieces of at most ``limit`` tokens. Best
fit depends on the pieces only through their lengths, so the histogram of
lengths (at most ``limit`` rows, whatever the corpus) is packed on the driver:
lengths in descending order, each into the tightest open sequence that a
segment tree over remaining capacities finds in logarithmic time. Sequences in
the same state are one run, so a step places a whole run of equal pieces. The
pieces then look up their place by their rank among the pieces of their
length; ranks come from salted groups, so no length is hot.

Null text counts as empty: one piece, the end token. Repeated rows are packed
one by one. Extra columns are ignored. An empty table gives an empty result.
"""

import json
import re
import struct
import sys
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from pathlib import Path
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, table

LIMIT, END = 4096, 1
#: Words whose ids a worker remembers; beyond it, it starts anew.
REMEMBERED = 400_000
#: a-z and the small letters of Latin-1, which no normal form changes; then marks that start no contraction.
PLAIN = re.compile(rb"((?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


STAND_IN = {b: c for c, b in byte_alphabet().items()}


#: The parts of a tokenizer file whose ids are those of its words, lower-cased and one after the other.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Words(dict):
    """word -> token ids as little-endian unsigned 32-bit bytes; learns words that it does not know.

    Most words are small letters, then perhaps marks: two pre-tokens whose
    merges are all there is to do.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.merges = tokenizer, tokenizer.model.tokenize
        self.bytes_of = [pack_ids([i]) for i in range(tokenizer.get_vocab_size())]
        self.marks: dict[bytes, bytes] = {}

    def merged(self, letters: str) -> bytes:
        of = self.bytes_of
        return b"".join([of[t.id] for t in self.merges(letters)])

    def __missing__(self, word: bytes) -> bytes:
        # bytes.isalpha is about ASCII letters
        if word.isalpha() and word.islower():
            ids = self.merged(word.decode())
        elif plain := PLAIN.fullmatch(word):
            letters, marks = plain.groups()
            ids = self.get(letters)
            if ids is None:
                ids = self.merged(letters.decode("latin-1").translate(STAND_IN))
            if marks:
                if marks not in self.marks:
                    self.marks[marks] = self.merged(marks.decode())
                ids += self.marks[marks]
        else:
            ids = pack_ids(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)
        self[word] = ids
        return ids


class WordIds:
    """Token ids of a text, as little-endian unsigned 32-bit bytes.

    A tokenizer that is made of BY_WORDS never joins tokens across white
    space, so a text's ids are those of its words one after the other, and
    words are looked up. It lower-cases, so A-Z are lower-cased first, but for
    texts that may hold the names of special tokens. Any other tokenizer is
    given whole texts.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        parts = json.loads(tokenizer_json)
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.by_words = all(parts.get(k) == v for k, v in BY_WORDS.items()) and parts["model"]["type"] == "BPE" and all(t["content"].startswith("<|") for t in parts["added_tokens"])
        self.known = Words(self.tokenizer)

    def __call__(self, text: bytes) -> bytes:
        if not self.by_words:
            return pack_ids(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)
        words = (text if b"<|" in text else text.lower()).split()
        out = b"".join(map(self.known.__getitem__, words))
        if len(self.known) + len(self.known.marks) > REMEMBERED:
            self.known.clear()
            self.known.marks.clear()
        return out


def word_ids(tokenizer_json: str) -> WordIds:
    """The worker's own WordIds of this tokenizer: tasks that a worker runs one after the other share what it has learned."""
    # functions travel to workers by value, so a worker's state needs a place of its own
    held = sys.modules.setdefault("_word_ids_of_this_worker", ModuleType("_word_ids_of_this_worker")).__dict__
    key = zlib.crc32(tokenizer_json.encode()), len(tokenizer_json)
    if held.get("key") != key:
        held["key"], held["ids"] = key, WordIds(tokenizer_json)
    return held["ids"]


def pieces(docs: DataFrame, tokenizer_json: str, limit: int = LIMIT, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each row."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    stop = int(end).to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(spec.value)
        for batch in batches:
            row, piece, length, crc = [], [], [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                ids = memoryview(ids_of(text or b"") + stop)
                for k in range(0, len(ids), 4 * limit):
                    part = ids[k : k + 4 * limit]
                    row.append(i)
                    piece.append(k // (4 * limit))
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            number = pa.array(piece, pa.int32())
            start = pa.array(np.array(piece, np.int64) * limit, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int32())), number, start, pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names)

    narrow = docs.select("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


class Capacities:
    """A segment tree over remaining capacities 0..top; a leaf says whether a sequence with that much room is open."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.open = bytearray(2 * self.size)

    def set(self, room: int, value: bool) -> None:
        i = room + self.size
        self.open[i] = value
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, length: int) -> int:
        """The least open capacity of at least ``length``; -1 if there is none."""
        i = length + self.size
        if self.open[i]:
            return length
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit(counts: dict[int, int], limit: int = LIMIT) -> dict[int, list[tuple[int, int, int, int]]]:
    """Places of ``counts[length]`` pieces of each length.

    length -> [(rank of the first piece, pieces in a sequence, first sequence,
    offset of the first piece in a sequence)], by ascending rank. Best fit
    fills one sequence with equal pieces before it takes the next as tight.
    """
    tree, runs, places, sequences = Capacities(limit), defaultdict(deque), defaultdict(list), 0

    def put(room: int, first: int, n: int) -> None:
        if n:
            if not runs[room]:
                tree.set(room, True)
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                room = limit
                put(room, sequences, -(-left // (limit // length)))
                sequences += runs[room][-1][1]
            first, n = runs[room].popleft()
            if not runs[room]:
                tree.set(room, False)
            each = room // length
            full = min(n, left // each)
            if full:
                places[length].append((rank, each, first, limit - room))
                rank, left = rank + full * each, left - full * each
                put(room - each * length, first, full)
                first, n = first + full, n - full
            if n and left and left < each:
                places[length].append((rank, each, first, limit - room))
                put(room - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(room, first, n)
    return dict(places)


def pack(docs: DataFrame, tokenizer_path: str | None = None, limit: int = LIMIT, end: int = END) -> DataFrame:
    """Every piece with its sequence_id and its offset there. ``docs`` needs doc_id and text.

    Null and empty texts are one piece, the end token; very long texts are cut
    into full pieces and a rest; rows with equal ids or repeated as a whole are
    packed one by one, ties in any order; other columns are ignored, whatever
    their names. An empty table gives an empty result.
    """
    spec = Path(tokenizer_path or default_tokenizer()).read_text(encoding="utf-8")
    work = Workspace(docs.sparkSession)
    made = work.settle(pieces(docs, spec, limit, end))
    histogram = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}
    salts = min(4096, max(16, sum(histogram.values()) // 20_000))
    salted = made.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(salts)))
    salted = work.settle(salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = salted.join(sizes, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    places = docs.sparkSession.sparkContext.broadcast({k: np.array(v, np.int64).T for k, v in best_fit(histogram, limit).items()})
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length):
                own = np.flatnonzero(length == k)
                first_rank, each, first, room = places.value[int(k)]
                run_of = np.searchsorted(first_rank, rank[own], "right") - 1
                inside = rank[own] - first_rank[run_of]
                sequence[own] = first[run_of] + inside // each[run_of]
                offset[own] = room[run_of] + inside % each[run_of] * k
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kind = made.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.select(*names, "rank").mapInArrow(run, schema)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """All whole documents in sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))
