"""Greedy word-piece counts with a linear longest-match automaton.

A trie of the vocabulary has a failure link at each node: where matching goes
on after the longest pieces of what was read are popped. The number of pieces
popped on that link is computed with the trie, so counting the pieces of a
word takes one pass over its bytes and builds no piece.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. The
vocabulary is the byte strings of a public tokenizer's file; single bytes are
always pieces, so every word has a count. Null and blank texts have none.
Repeated rows get a row each, extra columns are ignored, and an empty table
gives an empty result.
"""

import json
from collections import deque
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .packing import byte_alphabet, default_tokenizer
from .workspace import table

#: Words whose counts a worker remembers; beyond it, it starts anew.
REMEMBERED = 500_000
WORD_END = "</w>"


def surfaces(tokenizer_json: str) -> list[bytes]:
    """The byte strings of a byte-level vocabulary, without marks of word ends and special tokens."""
    spec, alphabet = json.loads(tokenizer_json), byte_alphabet()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    found = set()
    for token in spec["model"]["vocab"]:
        text = token.removesuffix(WORD_END)
        if token not in special and text and all(c in alphabet for c in text):
            found.add(bytes(alphabet[c] for c in text))
    return sorted(found)


class LongestMatch:
    """The automaton: ``step[node << 8 | byte]`` is a child, ``fail`` and ``popped`` belong to a node."""

    def __init__(self, vocabulary: list[bytes]):
        self.step: dict[int, int] = {}
        piece, parents = [False], [(0, 0)]
        for token in [*vocabulary, *(bytes([b]) for b in range(256))]:
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = self.step.get(key, 0)
                if not node:
                    node = self.step[key] = len(piece)
                    piece.append(False)
                    parents.append((key >> 8, byte))
            piece[node] = True
        children: dict[int, list[int]] = {}
        for node, (parent, _) in enumerate(parents[1:], 1):
            children.setdefault(parent, []).append(node)
        self.fail, self.popped = [-1] * len(piece), [0] * len(piece)
        queue = deque(children.get(0, ()))
        while queue:
            node = queue.popleft()
            queue.extend(children.get(node, ()))
            parent, byte = parents[node]
            if piece[node]:
                self.fail[node], self.popped[node] = 0, 1
                continue
            at, popped = self.fail[parent], self.popped[parent]
            while at >= 0 and (at << 8 | byte) not in self.step:
                popped += self.popped[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[node], self.popped[node] = self.step[at << 8 | byte], popped

    @classmethod
    def of(cls, step: dict[int, int], fail: list[int], popped: list[int]) -> "LongestMatch":
        made = cls.__new__(cls)
        made.step, made.fail, made.popped = step, fail, popped
        return made

    def count(self, word: bytes) -> int:
        step, fail, popped = self.step, self.fail, self.popped
        node = total = 0
        for byte in word:
            following = step.get(node << 8 | byte)
            while following is None:
                total += popped[node]
                node = fail[node]
                following = step.get(node << 8 | byte)
            node = following
        while node:
            total += popped[node]
            node = fail[node]
        return total


def token_counts(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens of each row. The vocabulary file's path is a parameter; it is read on the driver."""
    vocabulary = surfaces(Path(tokenizer_path or default_tokenizer()).read_text(encoding="utf-8"))
    built = LongestMatch(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((built.step, built.fail, built.popped))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = LongestMatch.of(*shared.value), {}
        for batch in batches:
            words_in, tokens_in = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = (text or b"").lower().split()
                for word in set(words).difference(known):
                    known[word] = automaton.count(word)
                words_in.append(len(words))
                tokens_in.append(sum(map(known.__getitem__, words)))
                if len(known) > REMEMBERED:
                    known = {}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(words_in, np.int64)), pa.array(np.array(tokens_in, np.int64))], ["doc_id", "n_words", "n_tokens"])

    narrow = docs.select("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_tokens bigint")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Word-piece counts of all whole documents."""
    return token_counts(table(spark, sf_dir, "documents"))
