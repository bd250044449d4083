"""Benchmark decontamination: item-sized windows where a piece of an item occurs, a filter that loses none, then exact edit distance.

Texts and items are compared as bytes with A-Z lower-cased and white space
runs as one space. A document leaks an item if some substring of it is within
floor(``max_edit`` x length) edits of the item.

Such a substring keeps, by the pigeonhole principle, at least one of d + 1
disjoint pieces of the item intact, so item-sized windows are laid where a
piece of the item occurs, with the piece at its own offset; no leak is lost
here. Every window is verified, by a count of shared 3-byte runs, which loses
none, and by Myers' bit-parallel edit distance, which also lets a window's
ends move. No window is dropped by chance: sampled positions of a CGK random
walk (Chakraborty, Goldenberg, Koucky 2016; ``embed``) agree too seldom at a
tenth of edits to decide.

Items are a stated query set: they go to the executors in blocks of bounded
size, and each block scans the documents once, without a shuffle. Null and
empty texts and items leak nothing. Repeated rows and items get their own
result rows, extra columns are ignored, and empty tables give empty results.
"""

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import spans
from .workspace import table

MAX_EDIT, SEED = 0.1, 20
#: Bytes of items in a block, of windows that are filtered and of texts that are searched at once.
BLOCK_BYTES, WINDOW_BYTES, SPAN = 1 << 20, 1 << 20, 1 << 22
BITS, GRAM = 22, 3


def plain(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def gram_keys(buffer: np.ndarray, width: int) -> np.ndarray:
    """A 22-bit hash of the ``width`` bytes (1 to 16) from each position of ``buffer``, which has 8 more bytes at its end."""
    n = len(buffer) - 8 - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    eight = np.lib.stride_tricks.sliding_window_view(buffer, 8)
    first = np.ascontiguousarray(eight[:n]).view("<u8").ravel()
    with np.errstate(over="ignore"):
        if width < 8:
            mixed = (first & np.uint64((1 << 8 * width) - 1)) * np.uint64(0x9E3779B97F4A7C15)
        else:
            last = np.ascontiguousarray(eight[width - 8 : width - 8 + n]).view("<u8").ravel()
            mixed = (first * np.uint64(0x9E3779B97F4A7C15) ^ last * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def walk_bits(steps: int) -> np.ndarray:
    """(steps, 256): whether the walk moves on after it reads a byte at a step."""
    return np.random.default_rng(SEED).integers(0, 2, (steps, 256)).astype(np.int64)


def embed(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """(windows, steps): the CGK embedding of each window; zero after its end."""
    out = np.zeros((len(starts), len(bits)), np.uint8)
    at, ends = starts.copy(), np.minimum(starts + lengths, len(buffer) - 1)
    for step in range(len(bits)):
        read = buffer[at] * (at < ends)
        out[:, step] = read
        at = np.minimum(at + bits[step][read], ends)
    return out


def least_edits(item: bytes, text: bytes, most: int) -> int:
    """The least edit distance of ``item`` to a substring of ``text``, or most + 1 if it is above ``most``."""
    if item in text:
        return 0
    n = len(item)
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << n - 1
    up, down, score, best = full, 0, n, n
    for c in text:
        same = masks.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        across_up, across_down = down | ~(diagonal | up) & full, up & diagonal
        score += bool(across_up & top) - bool(across_down & top)
        best = min(best, score)
        across_up, across_down = across_up << 1, across_down << 1
        up = (across_down | ~((same | down) | across_up)) & full
        down = across_up & (same | down) & full
    return min(best, most + 1)


def gram_codes(text: np.ndarray) -> np.ndarray:
    """The runs of GRAM bytes of ``text`` as numbers."""
    wide = text.astype(np.int32)
    return wide[:-2] + (wide[1:-1] << 8) + (wide[2:] << 16)


class Items:
    """A block of items and their pieces to look up."""

    def __init__(self, texts: list[bytes], max_edit: float):
        self.texts = texts
        self.most = [math.floor(max_edit * len(t)) for t in texts]
        self.pieces: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        for i, (text, most) in enumerate(zip(texts, self.most, strict=True)):
            # an exact item is one piece; pieces of 16 bytes are enough to look up
            width = min(16, len(text) // (most + 1))
            step = len(text) // (most + 1)
            if width:
                for k in range(most + 1):
                    piece = text[k * step : k * step + width]
                    self.pieces.setdefault(width, {}).setdefault(piece, []).append((i, k * step))
        self.bitmaps = {}
        for width, found in self.pieces.items():
            bitmap = np.zeros(1 << BITS, bool)
            for piece in found:
                bitmap[gram_keys(np.frombuffer(piece + bytes(8), np.uint8), width)] = True
            self.bitmaps[width] = bitmap
        self.lengths = np.array([len(t) for t in texts], np.int64)

    def windows(self, joined: bytes, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(items, starts) of each window that has a piece of its item in its place, without repeats."""
        found = set()
        for width, pieces in self.pieces.items():
            hits = np.flatnonzero(self.bitmaps[width][gram_keys(buffer, width)])
            for at in hits.tolist():
                for item, offset in pieces.get(joined[at : at + width], ()):
                    found.add((item, at - offset))
        both = np.array(sorted(found), np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def candidates(self, buffer: np.ndarray, items: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which windows, with room for edits at both ends, have enough of their item's runs of GRAM bytes; loses no leak."""
        met = np.ones(len(items), bool)
        order = np.argsort(items, kind="stable")
        place = np.zeros(1 << 8 * GRAM, np.int32)
        for own in np.split(order, np.flatnonzero(np.diff(items[order])) + 1) if len(items) else []:
            item = int(items[own[0]])
            n, most = len(self.texts[item]), self.most[item]
            # an edit spoils no more than GRAM runs
            least = n - GRAM + 1 - GRAM * most
            if least <= 0:
                continue
            codes, weights = np.unique(gram_codes(np.frombuffer(self.texts[item], np.uint8)), return_counts=True)
            place[codes] = np.arange(1, len(codes) + 1)
            span = np.arange(n + 2 * most - GRAM + 1)
            step = max(1, WINDOW_BYTES // len(span))
            for k in range(0, len(own), step):
                part = own[k : k + step]
                at = np.clip(starts[part, None] - most + span, 0, len(buffer) - GRAM)
                there = place[buffer[at] + (buffer[at + 1].astype(np.int32) << 8) + (buffer[at + 2].astype(np.int32) << 16)]
                seen = np.zeros((len(part), len(codes) + 1), bool)
                seen[np.arange(len(part))[:, None], there] = True
                met[part] = seen[:, 1:] @ weights >= least
            place[codes] = 0
        return met

    def leaks(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(text, item, least edits) of all that the texts leak."""
        joined = b"\0".join(texts)
        buffer = np.frombuffer(joined + bytes(8), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        items, starts = self.windows(joined, buffer)
        met = self.candidates(buffer, items, starts)
        best: dict[tuple[int, int], int] = {}
        for item, start in zip(items[met].tolist(), starts[met].tolist(), strict=True):
            n, most = len(self.texts[item]), self.most[item]
            # the piece lies inside its text, and so does some part of the window
            for row in range(max(0, int(np.searchsorted(begins, start, "right")) - 1), len(texts)):
                begin = int(begins[row])
                if begin >= start + n:
                    break
                text = joined[max(begin, start - most) : max(0, min(begin + int(sizes[row]), start + n + most))]
                if len(text) < n - most or best.get((row, item)) == 0:
                    continue
                edits = least_edits(self.texts[item], text, most)
                if edits <= most:
                    best[row, item] = min(edits, best.get((row, item), edits))
        return [(row, item, edits) for (row, item), edits in sorted(best.items())]


def item_blocks(items: DataFrame) -> list[list[tuple]]:
    """(item_id, bytes) in blocks of bounded size; items stream to the driver partition by partition."""
    blocks, size = [[]], 0
    for r in items.select("item_id", "text").toLocalIterator():
        text = plain((r["text"] or "").encode())
        if size + len(text) > BLOCK_BYTES and blocks[-1]:
            blocks.append([])
            size = 0
        if text:
            blocks[-1].append((r["item_id"], text))
            size += len(text)
    return blocks


def leaks(docs: DataFrame, items: DataFrame, max_edit: float = MAX_EDIT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of each row with the item_id that it leaks and the least edits (distance)."""
    narrow = docs.select(*keep, F.col("text").alias("__text"))
    id_kind = items.schema["item_id"].dataType
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "__text")
    schema = f"{schema}, item_id {id_kind.simpleString()}, distance bigint"

    def scan(block: list[tuple]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = [i for i, _ in shared.value]
            own = Items([t for _, t in shared.value], max_edit)
            for batch in batches:
                row, item, distance = [], [], []
                texts, done = [plain(t or b"") for t in batch.column("__text").cast(pa.binary()).to_pylist()], 0
                for part in spans(texts, SPAN):
                    for k, i, edits in own.leaks(part):
                        row.append(done + k)
                        item.append(ids[i])
                        distance.append(edits)
                    done += len(part)
                kept = [batch.column(c).take(pa.array(row, pa.int32())) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(item, to_arrow(id_kind)), pa.array(distance, pa.int64())], [*keep, "item_id", "distance"])

        return narrow.mapInArrow(run, schema)

    return reduce(DataFrame.unionAll, [scan(b) for b in item_blocks(items)])


def clean(docs: DataFrame, items: DataFrame, max_edit: float = MAX_EDIT) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns, whatever their names.

    Null and empty texts and items leak nothing; very long texts are searched
    whole; repeated rows and ties stay or go together. Empty tables give
    ``docs`` or an empty result.
    """

    def without(df: DataFrame, block: list[tuple]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast([t for _, t in block])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Items(shared.value, max_edit)
            for batch in batches:
                texts, done, leaked = [plain(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()], 0, set()
                for part in spans(texts, SPAN):
                    leaked |= {done + k for k, _, _ in own.leaks(part)}
                    done += len(part)
                yield batch.take(pa.array([k for k in range(batch.num_rows) if k not in leaked], pa.int64()))

        return df.mapInArrow(run, df.schema)

    return reduce(without, item_blocks(items), docs)


def to_arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every benchmark item against all whole documents: doc_id, item_id, distance."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
