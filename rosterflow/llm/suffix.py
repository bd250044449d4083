"""Duplicate passages by suffix order and longest-previous-factor tests.

A byte is removed if a run of ``length`` bytes that covers it also starts
elsewhere: at any other place (keep="none") or at an earlier one
(keep="first", which leaves the first copy of everything).

Runs meet through anchors. In every run, the 100-byte gram with the least hash
is its anchor, so equal runs have equal anchors in the same place, and about
one position in 50 is an anchor of anything. Counting anchors by hash leaves
those that occur twice. An anchor's surroundings hold all runs that it can
anchor; where they are equal as a whole, all their runs repeat and no text has
to be compared. What remains (surroundings that differ somewhere) is compared
in buckets of anchors: the texts around them are put in suffix order by prefix
doubling, and the previous and next smaller positions in that order give each
position's longest previous factor; the same searches on greater positions give
later matches. Where a longest factor has ``length`` bytes or more, its bytes go.

An anchor with very many different surroundings (a passage that much of the
corpus quotes) would make a bucket too large. Its runs are instead compared by
128-bit hashes that are grouped across the cluster, first in cells of runs so
that only cells cut by a border are compared run by run.

Text is UTF-8 bytes, null text is empty, and runs never cross rows. Earlier
means a smaller doc_id (null last), then text hash, then position. Rows with
the same id and the same text count as copies of each other for keep="none"
and as one for keep="first". Extra columns are ignored and an empty table
gives an empty result.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import spans
from .simhash import text_key
from .workspace import Workspace, apart, table

LENGTH = 200
#: Surroundings in a bucket that one task compares, and of one anchor; more go by hashes.
BUCKET, WIDEST = 1024, 32_768
SPAN = 1 << 20
#: Runs in a cell.
CELL = 12
FACTOR = 0x9E3779B97F4A7C15


def gram_of(length: int) -> int:
    return max(1, length // 2)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse modulo 2^64."""
    size = 1 << max(16, n.bit_length())
    if size not in _powers:
        out = []
        for factor in (FACTOR, pow(FACTOR, -1, 1 << 64)):
            row = np.full(size, factor, np.uint64)
            row[0] = 1
            out.append(np.multiply.accumulate(row))
        _powers.clear()
        _powers[size] = out[0], out[1]
    return _powers[size]


def gram_hashes(buffer: np.ndarray, gram: int) -> np.ndarray:
    up, down = powers(len(buffer))
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(buffer * up[: len(buffer)], out=sums[1:])
    n = len(buffer) - gram + 1
    h = (sums[gram:] - sums[:n]) * down[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of each anchor of a run that lies in one text."""
    gram = gram_of(length)
    sizes = np.array([len(t) for t in texts], np.int64)
    none = np.empty(0, np.int64)
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    if len(buffer) < length:
        return none, none, none.astype(np.uint64)
    h = gram_hashes(buffer, gram)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, size, least = length - gram + 1, 1, key
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    runs = len(buffer) - length + 1
    least = np.minimum(least[:runs], least[width - size :][:runs])
    ends = np.cumsum(sizes)
    row_of_run = np.repeat(np.arange(len(texts)), sizes)[:runs]
    inside = np.arange(runs) + length <= ends[row_of_run]
    position, at = np.unique((least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64), return_index=True)
    row = row_of_run[inside][at]
    return row, position - (ends - sizes)[row], h[position]


def surroundings(text: bytes, position: int, length: int) -> tuple[int, bytes]:
    """(bytes before the anchor, text) that hold all runs with an anchor there."""
    before = min(position, length - gram_of(length))
    return before, text[position - before : position + length]


def smaller_neighbours(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry, the index of the nearest one before and after it that is smaller; -1 and n where there is none."""
    n = len(order)

    def before(values: np.ndarray) -> np.ndarray:
        at = np.arange(-1, n - 1)
        open_ = np.flatnonzero((at >= 0) & (values[np.maximum(at, 0)] > values)) if n else at
        while len(open_):
            # an index that is not final yet still skips only greater values
            at[open_] = at[at[open_]]
            there = at[open_]
            open_ = open_[(there >= 0) & (values[np.maximum(there, 0)] > values[open_])]
        return at

    return before(order), n - 1 - before(order[::-1])[::-1]


class SuffixOrder:
    """Positions of ``starts`` in suffix order, and the lengths that suffixes have in common.

    Prefix doubling: ranks of ``first`` bytes, then of twice as many each
    round. The ranks of all rounds stay, so the common length of two suffixes
    is read off by descending through them, and the last bytes off their
    difference. Lengths are exact up to ``depth`` bytes or more.
    """

    def __init__(self, buffer: np.ndarray, depth: int):
        padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
        self.size, self.depth = len(buffer), depth
        self.words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: self.size].copy().view(">u8").ravel().astype(np.uint64)
        self.widths = [8 if depth >= 8 else 1]
        ranks = self.words if depth >= 8 else buffer
        self.ranks = [np.unique(ranks, return_inverse=True)[1].astype(np.int64)]
        while self.widths[-1] * 2 <= depth:
            self.ranks.append(np.unique(self.pairs(np.arange(self.size), self.widths[-1]), return_inverse=True)[1].astype(np.int64))
            self.widths.append(self.widths[-1] * 2)

    def pairs(self, at: np.ndarray, step: int) -> np.ndarray:
        """A number that orders the suffixes at ``at`` by the widest rank and the one ``step`` bytes on; nothing comes first."""
        there = at + step
        behind = np.where(there < self.size, self.ranks[-1][np.minimum(there, self.size - 1)] + 1, 0)
        return self.ranks[-1][at] * (self.size + 1) + behind

    def order(self, starts: np.ndarray) -> np.ndarray:
        """``starts`` by their first ``depth`` bytes, equal ones by position."""
        return starts[np.argsort(self.pairs(starts, self.depth - self.widths[-1]), kind="stable")]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at ``i`` and ``j`` have in common, not counting beyond the end of the buffer."""
        i, j, length = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        last = self.size - 1
        for width, rank in zip(self.widths[::-1], self.ranks[::-1], strict=True):
            inside = np.maximum(i, j) + length <= last
            same = inside & (rank[np.minimum(i + length, last)] == rank[np.minimum(j + length, last)])
            length += width * same
        inside = np.maximum(i, j) + length <= last
        differ = self.words[np.minimum(i + length, last)] ^ self.words[np.minimum(j + length, last)]
        for k in range(1, 9):
            length += inside & (differ >> np.uint64(64 - 8 * k) == 0)
        return np.minimum(length, self.size - np.maximum(i, j))


def longest_factors(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int, later: bool) -> np.ndarray:
    """The longest previous factor of each of ``starts`` (ascending): the most bytes that it has in common with an earlier one.

    The earlier suffix with the most in common is the previous or the next
    smaller position in suffix order. With ``later``, matches at greater
    positions count too, by the same two searches on greater positions. A
    match ends where either suffix's text does (``ends``); lengths are exact
    up to ``depth`` and at least ``depth`` beyond it.
    """
    longest = np.zeros(len(starts), np.int64)
    if len(starts) < 2:
        return longest
    suffixes = SuffixOrder(buffer, depth)
    order = suffixes.order(starts)
    own = np.searchsorted(starts, order)
    for values in (order, -order) if later else (order,):
        for near in smaller_neighbours(values):
            there = np.flatnonzero((near >= 0) & (near < len(order)))
            i, j = own[there], own[near[there]]
            shared = suffixes.common(starts[i], starts[j])
            shared = np.minimum(shared, np.minimum(ends[i] - starts[i], ends[j] - starts[j]))
            longest[i] = np.maximum(longest[i], shared)
    return longest


def compare_bucket(docs: list, positions: list[int], befores: list[int], texts: list[bytes], length: int, keep: str) -> list[tuple[int, int, int]]:
    """(index of a row of the same document, start, stop) of repeated bytes among the surroundings; ``docs`` are sortable ids."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i], positions[i] - befores[i]))
    parts, at = [], 0
    regions: list[tuple[int, int, int]] = []
    last_doc, last_stop = None, 0
    for i in order:
        begin = positions[i] - befores[i]
        stop = begin + len(texts[i])
        if docs[i] == last_doc and begin <= last_stop:
            new = texts[i][last_stop - begin :] if stop > last_stop else b""
            last_stop = max(stop, last_stop)
        else:
            regions.append((at, i, begin))
            new, last_doc, last_stop = texts[i], docs[i], stop
        parts.append(new)
        at += len(new)
    buffer = np.frombuffer(b"".join(parts), np.uint8)
    bounds = np.array([r[0] for r in regions] + [at], np.int64)
    starts = np.concatenate([np.arange(a, max(a, b - length + 1)) for a, b in zip(bounds, bounds[1:])])
    region = np.searchsorted(bounds, starts, "right") - 1
    factors = longest_factors(buffer, starts, bounds[region + 1], length, keep == "none")
    met = factors >= length
    starts, region, stops = starts[met], region[met], (starts + factors)[met]
    out = []
    if len(starts):
        # factors that touch are one run
        reach = np.maximum.accumulate(stops + region * (at + 1))
        cuts = np.flatnonzero(starts[1:] + region[1:] * (at + 1) > reach[:-1]) + 1
        for run in np.split(np.arange(len(starts)), cuts):
            first, i, begin = regions[region[run[0]]]
            out.append((i, int(starts[run[0]]) - first + begin, int(stops[run].max()) - first + begin))
    return out


def _with_key(docs: DataFrame) -> DataFrame:
    """text and (n, d, t): 1 if the id is null, the id, the text's hash, which order rows and name equal ones alike."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(text.alias("text"), F.col("doc_id").isNull().cast("int").alias("n"), F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("d"), F.xxhash64(text).alias("t"))


ROW = ["n", "d", "t"]
ROW_KIND = "n int, d bigint, t bigint"
#: Surroundings that a worker hands on at once.
HANDED = 8192


def binary(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def anchored(rows: DataFrame, length: int) -> DataFrame:
    """(n, d, t), p, h and around (a hash of the surroundings) of each anchor of ``rows`` (text, n, d, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in spans(binary(batch, "text"), SPAN):
                row, position, h = anchors(part, length)
                around = np.empty(len(row), np.uint64)
                for i, (r, p) in enumerate(zip(row.tolist(), position.tolist(), strict=True)):
                    before, own = surroundings(part[r], p, length)
                    around[i] = xxhash.xxh3_64_intdigest(own, before)
                ids = [batch.column(c).take(pa.array(row + done)) for c in ROW]
                done += len(part)
                yield pa.RecordBatch.from_arrays([*ids, pa.array(position.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(around.view(np.int64))], [*ROW, "p", "h", "around"])

    return rows.select("text", *ROW).mapInArrow(run, f"{ROW_KIND}, p int, h bigint, around bigint")


def cut_around(held: DataFrame, length: int) -> DataFrame:
    """A row for each asked anchor (arrays h, wide, p) of ``held``, with its surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c) for c in ("h", "wide", "p")]
            flat = [c.flatten() for c in lists]
            sizes = np.diff(lists[0].offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            texts, places = binary(batch, "text"), flat[2].to_numpy()
            for k in range(0, len(row), HANDED):
                part, at = row[k : k + HANDED], places[k : k + HANDED]
                around = [surroundings(texts[r], p, length)[1] for r, p in zip(part.tolist(), at.tolist(), strict=True)]
                before = np.minimum(at, length - gram_of(length)).astype(np.int32)
                ids = [batch.column(c).take(pa.array(part)) for c in ROW]
                yield pa.RecordBatch.from_arrays([*ids, *(c.slice(k, len(part)) for c in flat), pa.array(before), pa.array(around, pa.binary())], [*ROW, "h", "wide", "p", "before", "around"])

    return held.select(*ROW, "h", "wide", "p", "text").mapInArrow(run, f"{ROW_KIND}, h bigint, wide boolean, p int, before int, around binary")


def runs_of(spans_: DataFrame) -> DataFrame:
    """(n, d, t), starts and stops (ascending, apart from each other) of the merged ranges a to b of each row."""
    ahead = Window.partitionBy(*ROW).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    sofar = Window.partitionBy(*ROW).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = spans_.withColumn("opens", F.coalesce(F.col("a") > F.max("b").over(ahead), F.lit(True)).cast("int"))
    numbered = opens.withColumn("run", F.sum("opens").over(sofar))
    ranges = numbered.groupBy(*ROW, "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    listed = ranges.groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("ranges"))
    return listed.select(*ROW, F.col("ranges.a").alias("starts"), F.col("ranges.b").alias("stops"))


def repeats(work: Workspace, rows: DataFrame, length: int, keep: str) -> DataFrame:
    """(n, d, t), starts and stops: merged byte ranges to remove, for the rows of ``rows`` (text, n, d, t) that have any."""
    placed = work.settle(anchored(rows, length))
    seen = placed.groupBy("h").agg(F.count("*").alias("c"), F.min("around").alias("least"), F.max("around").alias("most"))
    twice = work.settle(seen.where("c > 1").select("h", (F.col("least") == F.col("most")).alias("alike")))
    # sizes grow with the corpus, so the plan is the one that holds at every size
    shared = work.settle(placed.join(twice.hint("merge"), "h"))
    work.drop(placed, twice)
    here = F.struct(*ROW, "p")
    groups = work.settle(shared.groupBy("h", "around", "alike").agg(F.count("*").alias("m"), F.min(here).alias("first")))
    # surroundings that occur twice: all their runs repeat
    again = groups.where("m > 1").select("h", "around", F.col("first").alias("first_at"))
    whole = shared.join(again, ["h", "around"])
    if keep == "first":
        whole = whole.where(here > F.col("first_at"))
    before = F.least(F.col("p"), F.lit(length - gram_of(length)))
    whole = whole.select(*ROW, (F.col("p") - before).alias("a"), (F.col("p") + length).alias("b"))
    # surroundings that differ: compare texts
    mixed = groups.where("not alike")
    wide = work.settle(mixed.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > WIDEST).select("h"))
    compared = mixed.count()
    buckets = max(1, compared // BUCKET)
    asked = mixed.join(wide.withColumn("wide", F.lit(True)), "h", "left").select("h", F.coalesce("wide", F.lit(False)).alias("wide"), *[F.col(f"first.{c}").alias(c) for c in (*ROW, "p")])
    asked = asked.groupBy(*ROW).agg(*[F.collect_list(c).alias(c) for c in ("h", "wide", "p")])
    around = cut_around(rows.join(asked, ROW), length)
    hashed = bool(wide.limit(1).count())
    if hashed:
        around = work.settle(around)
    narrow = around.where("not wide").withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)).cast("int"))

    def compare(group: pa.Table) -> pa.Table:
        ids = list(zip(*(group.column(c).to_pylist() for c in ROW), strict=True))
        found = compare_bucket(ids, group.column("p").to_pylist(), group.column("before").to_pylist(), group.column("around").to_pylist(), length, keep)
        own = group.select(ROW).take(pa.array([i for i, _, _ in found], pa.int64()))
        return own.append_column("a", pa.array([x[1] for x in found], pa.int32())).append_column("b", pa.array([x[2] for x in found], pa.int32()))

    parts = [whole, narrow.groupBy("bucket").applyInArrow(compare, f"{ROW_KIND}, a int, b int")]
    if hashed:
        parts += _by_hashes(work, around.where("wide"), length, keep)
    removed = parts[0]
    for part in parts[1:]:
        removed = removed.unionByName(part)
    found = work.settle(runs_of(removed))
    # the ranges are all that is read from here on
    work.drop(shared, groups, wide, around)
    return found


def _by_hashes(work: Workspace, around: DataFrame, length: int, keep: str) -> list[DataFrame]:
    """(n, d, t, a, b) for surroundings of anchors with too many of them, by grouped hashes.

    A cell is CELL runs that start one after the other, counted from the
    anchor, so equal runs lie in equal cells. If the bytes of all its runs
    together repeat, all its runs do; if not even the bytes that they share
    repeat, none does; cells between, and cells that a text's end cuts, are
    compared run by run.
    """
    reach = length - gram_of(length)
    columns = ["n", "d", "t", "h", "p", "before", "around"]

    def split(df: DataFrame, ranges: Callable) -> DataFrame:
        """A row for each of ``ranges`` (cell, begin, stop): the hash x, y of those bytes and their place a, b in the text."""
        listed = "open" in df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, cell, x, y, a, b = [], [], [], [], [], []
                opens = batch.column("open").to_pylist() if listed else [None] * batch.num_rows
                for i, (p, before, own, open_) in enumerate(zip(batch.column("p").to_pylist(), batch.column("before").to_pylist(), batch.column("around").to_pylist(), opens, strict=True)):
                    for c, begin, stop in ranges(before, len(own), open_):
                        digest = xxhash.xxh3_128_intdigest(own[begin:stop], before - begin)
                        row.append(i)
                        cell.append(c)
                        x.append(digest >> 64)
                        y.append(digest & (1 << 64) - 1)
                        a.append(p - before + begin)
                        b.append(p - before + stop)
                ids = [batch.column(c).take(pa.array(row, pa.int32())) for c in columns[:5]]
                made = [pa.array(np.array(v, np.uint64).view(np.int64)) for v in (x, y)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(cell, pa.int32()), *made, pa.array(a, pa.int32()), pa.array(b, pa.int32())], [*columns[:5], "cell", "x", "y", "a", "b"])

        own = df.select(*columns, *(["open"] if listed else []))
        return own.mapInArrow(run, "n int, d bigint, t bigint, h bigint, p int, cell int, x bigint, y bigint, a int, b int")

    def repeated(df: DataFrame) -> DataFrame:
        at = F.struct("n", "d", "t", "a")
        met = df.groupBy("h", "x", "y").agg(F.min(at).alias("low"), F.max(at).alias("high")).where("low <> high").select("h", "x", "y", "low")
        return df.join(met, ["h", "x", "y"]).withColumn("later", at > F.col("low"))

    def starts(c: int) -> tuple[int, int]:
        """Runs of a cell start this far before the anchor: from, to."""
        return c * CELL, min(c * CELL + CELL - 1, reach)

    def cut(c: int, before: int, size: int) -> bool:
        near, far = starts(c)
        return before < far or before - near + length > size

    cells = range(reach // CELL + 1)

    def together(before, size, _):
        return [(c, before - starts(c)[1], before - starts(c)[0] + length) for c in cells if not cut(c, before, size)]

    def common(before, size, _):
        # where a text's end cuts a cell, what all its runs share is still inside if any run is
        return [(c, before - starts(c)[0], before - starts(c)[1] + length) for c in cells if before >= starts(c)[0] and before - starts(c)[1] + length <= size]

    def one_by_one(before, size, open_):
        out = []
        for c in cells:
            if c in open_ or cut(c, before, size):
                near, far = starts(c)
                out += [(c, s, s + length) for s in range(max(0, before - far), min(before - near, size - length) + 1)]
        return out

    whole = work.settle(repeated(split(around, together)).select(*columns[:5], "cell", "a", "b", "later"))
    maybe = repeated(split(around, common)).select(*columns[:5], "cell")
    # the first of equal cells still shows its runs, for cells that share only some of them
    opened = maybe.join(whole.where("later").select(*columns[:5], "cell"), [*columns[:5], "cell"], "left_anti").groupBy(*columns[:5]).agg(F.collect_set("cell").alias("open"))
    rest = around.join(opened, columns[:5], "left").withColumn("open", F.coalesce("open", F.array().cast("array<int>")))
    single = repeated(split(rest, one_by_one))
    return [(part.where("later") if keep == "first" else part).select("n", "d", "t", "a", "b") for part in (whole, single)]


def duplicate_spans(docs: DataFrame, length: int = LENGTH, keep: str = "first") -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, and their names: starts and ends of the byte ranges to remove, merged and ascending; null for none."""
    work, names = Workspace(docs.sparkSession), docs.columns
    own = {c: apart(f"__{c}", names) for c in (*ROW, "starts", "stops")}
    found = repeats(work, _with_key(docs), length, keep)
    found = found.select(*[F.col(c).alias(k) for c, k in own.items()])
    keyed = docs.select(*names, *[k.alias(own[c]) for c, k in zip(ROW, text_key(), strict=True)])
    starts, stops = own["starts"], own["stops"]
    # a text's last surroundings may reach beyond its end
    size = F.octet_length("text")
    out = keyed.join(found.hint("merge"), [own[c] for c in ROW], "left")
    return out.select(*names, starts, F.transform(stops, lambda b: F.least(b, size)).alias(stops)), starts, stops


def left_over(starts: Column, stops: Column) -> Column:
    """The bytes of ``text`` outside the ranges, in order, as a string."""
    none = F.lit([]).cast("array<int>")
    begins = F.concat(F.array(F.lit(0)), F.coalesce(stops, none))
    ends = F.concat(F.coalesce(starts, none), F.array(F.octet_length(F.coalesce("text", F.lit("")))))
    # the text's bytes are taken once, for all pieces
    text = F.array(F.coalesce("text", F.lit("")).cast("binary"))
    return F.get(F.transform(text, lambda t: F.array_join(F.zip_with(begins, ends, lambda a, b: F.substring(t, a + 1, b - a).cast("string")), "")), F.lit(0))


def whole_characters(starts: Column, stops: Column) -> Column:
    """array<struct<a, b>>: the ranges without bytes of characters that they cut."""

    def inside(t: Column, at: Column) -> Column:
        byte = F.substring(t, at + 1, F.lit(1))
        return (byte >= F.lit(b"\x80")) & (byte < F.lit(b"\xc0"))

    def moved(t: Column, at: Column, step: int) -> Column:
        # a character has at most three bytes after its first
        out = at + 3 * step
        for k in (2, 1, 0):
            out = F.when(inside(t, at + k * step), out).otherwise(at + k * step)
        return out

    text = F.array(F.col("text").cast("binary"))
    both = F.transform(text, lambda t: F.zip_with(starts, stops, lambda a, b: F.struct(moved(t, a, 1).alias("a"), moved(t, b, -1).alias("b"))))
    return F.filter(F.get(both, F.lit(0)), lambda r: r["a"] < r["b"])


def deduplicated(docs: DataFrame, length: int = LENGTH, keep: str = "first") -> DataFrame:
    """``docs`` with repeated runs cut out of ``text`` and, where there is such a column, n_chars counted anew.

    Cuts never split a character. A document that loses all its text but white
    space goes; all others stay as they are. Null and empty texts have no runs
    and stay, as do very long texts, which are cut whole. Of equal runs, the one
    in the smallest doc_id (null last), then text hash, then position stays;
    rows repeated as a whole (id and text) are cut alike. Other columns are
    carried, whatever their names. An empty table gives an empty result.
    """
    names = docs.columns
    found, starts, stops = duplicate_spans(docs, length, keep)
    ranges = apart("__ranges", found.columns)
    marked = found.withColumn(ranges, F.when(F.size(F.coalesce(F.col(starts), F.lit([]).cast("array<int>"))) > 0, whole_characters(F.col(starts), F.col(stops))))
    cut = F.when(F.col(ranges).isNull(), F.col("text")).otherwise(left_over(F.col(f"{ranges}.a"), F.col(f"{ranges}.b")))
    text = apart("__text", marked.columns)
    marked = marked.withColumn(text, cut).where(F.col(ranges).isNull() | F.col(text).rlike(r"[^\x09-\x0D\x20]"))
    made = {"text": F.col(text)}
    if "n_chars" in names:
        counted = F.char_length(text).cast(docs.schema["n_chars"].dataType)
        made["n_chars"] = F.when(F.col(ranges).isNull(), F.col("n_chars")).otherwise(counted)
    return marked.select(*[made.get(c, F.col(f"`{c}`")).alias(c) for c in names])


def removal_report(found: DataFrame, starts: str, stops: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the rows of duplicate_spans()."""
    none = F.lit([]).cast("array<int>")
    first, last = F.coalesce(F.col(starts), none), F.coalesce(F.col(stops), none)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda x, y: x + y)
    return found.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), (total(last) - total(first)).alias("n_removed"),
        F.size(first).cast("bigint").alias("n_spans"), F.sha2(left_over(first, last).cast("binary"), 256).alias("kept_sha256"),
    )


def op5_suffix(spark, sf_dir: str) -> DataFrame:
    """Every byte of whole documents that a 200-byte run with another occurrence covers."""
    return removal_report(*duplicate_spans(table(spark, sf_dir, "documents"), LENGTH, "none"))
