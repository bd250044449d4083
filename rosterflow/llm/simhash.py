"""SimHash near-duplicate detection with multi-index hashing.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its
word shingles. Fingerprints that differ in at most two of 64 bits are linked.
The pigeonhole behind the index: split the bits into halves A and B. Two bits
of difference fall as (0, <=2), (<=2, 0) or (1, 1), so a linked pair either
agrees on one half and on one third of the other half, or is found by probing
the Hamming ball of radius one around A together with one exact half of B.
Every probe fetches table entries by an equi-join on a 52-bit key and the
complete distance is verified after it.

Null and blank texts have fingerprint zero and link like any other
fingerprint. Repeated rows each get their own result row. Extra columns are
ignored. An empty table gives an empty result.
"""

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .workspace import Workspace, apart

RADIUS = 2


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words, lower-cased A-Z, joined by one space."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n < width:
        return np.array([digest(joined, 42)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    first, last = (end - size)[: n - width + 1].tolist(), end[width - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(first, last, strict=True)), np.uint64, n - width + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits set in more than half of the hashes, as a signed integer."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp`` (bigint bit pattern) of each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text").cast(pa.binary()).to_pylist()
            fp = pa.array([majority(shingle_hashes(t or b"", width)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), fp], [*keep, "fp"])

    narrow = docs.select(*keep, F.col("text").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "__text")
    return narrow.mapInArrow(run, f"{schema}, fp bigint")


def _key(kind: int, half: Column, part: Column) -> Column:
    return F.lit(kind << 48).bitwiseOR(F.shiftleft(half, 16)).bitwiseOR(part)


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a < b: every pair of different fingerprints in ``fps`` (distinct ``fp``) within two bits."""
    half = {
        "A": F.shiftrightunsigned("fp", 32),
        "B": F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)),
    }

    def third(name: str, j: int) -> Column:
        return F.shiftright(half[name], 11 * j).bitwiseAND(F.lit(0x7FF))

    def two(j: int) -> Column:
        return F.shiftright(half["B"], 16 * j).bitwiseAND(F.lit(0xFFFF))

    exact = [_key(j, half["A"], third("B", j)) for j in range(3)]
    exact += [_key(3 + j, half["B"], third("A", j)) for j in range(3)]
    stored = exact + [_key(6 + j, half["A"], two(j)) for j in range(2)]
    # Of two halves that differ in one bit, one has it unset: only that side probes.
    ball = [F.when(half["A"].bitwiseAND(F.lit(1 << b)) == 0, _key(6 + j, half["A"].bitwiseOR(F.lit(1 << b)), two(j))) for b in range(32) for j in range(2)]
    entries = fps.select(F.col("fp").alias("y"), F.explode(F.array(*stored)).alias("key"))
    probes = fps.select(F.col("fp").alias("x"), F.explode(F.array_compact(F.array(*exact, *ball))).alias("key"))
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= RADIUS
    ordered = (F.col("x") < F.col("y")) | (F.col("key") >= F.lit(6 << 48))
    found = probes.join(entries, "key").where(near & ordered)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, fp, component_id for each row; component_id is the smallest doc_id reachable over links.

    Rows with a null doc_id link too; component_id is null only where no row
    of the component has an id. Copies collapse to one fingerprint before the
    index is probed, and the hot fingerprint of a large group of copies only
    meets partial aggregates and joins that Spark can split.
    """
    work = Workspace(docs.sparkSession)
    rows = work.settle(fingerprints(docs, width))
    distinct = work.settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    edges = links(distinct.select("fp"))
    labels = connected(work, edges)
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    named = work.settle(named.select("fp", "first_id", F.coalesce("component", "fp").alias("root")))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = named.join(smallest, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


# Near copies by shingle similarity.

SIMILAR = 0.8
#: Texts under a shared shingle that are compared with its least text before they meet each other.
HOT = 2
#: Texts under a shared shingle from which on they meet by their differences; where fewer are still in several groups, they meet each other.
WIDE = 32
#: The count that makes a shingle common, and how many common ones at most are told to workers.
COMMON, TOLD = 32, 250_000
#: Levels of counts in each doubling, by which those that are told are chosen.
LEVELS = 16
#: Shares of the shingles that are looked up one after the other: only one of them is shuffled at a time.
SLICES = 4
#: Longs of a text's sketch.
SKETCH = 16


def text_key() -> list[Column]:
    """Columns n, d, t that name a row: whether its id is null, the id, and the hash of its text."""
    return [F.col("doc_id").isNull().cast("int").alias("__n"), F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("__d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__t")]


def common_shingles(work: Workspace, texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of the most common shingles, counted in all texts; any answer gives the same links.

    Those told are all above a count, the least by which they are no more than TOLD.
    """
    counts = shingle_sets(texts, width).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("c"))
    often = work.settle(counts.where(F.col("c") >= COMMON).withColumn("level", F.floor(F.log2("c") * LEVELS).cast("int")))
    least, told = 0, 0
    # a level is a share of a doubling, so there are at most 64 x LEVELS rows
    for row in often.groupBy("level").agg(F.count("*").alias("rows")).orderBy(F.desc("level")).collect():
        told += row.rows
        if told > TOLD:
            least = row.level + 1
            break
    found = often.where(F.col("level") >= least).select("gram", "c").toArrow()
    work.drop(often)
    hashes, counted = found["gram"].to_numpy(), found["c"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counted[order]


def heat(grams: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The counts of shingles, 0 for those that are not ``common``."""
    hashes, counts = common
    if not len(hashes):
        return np.zeros(len(grams), np.int64)
    at = np.minimum(np.searchsorted(hashes, grams), len(hashes) - 1)
    return np.where(hashes[at] == grams, counts[at], 0)


def prefix(grams: np.ndarray, common: tuple[np.ndarray, np.ndarray], similar: float) -> np.ndarray:
    """The first shingles, rare ones first, of which two texts at ``similar`` or more have one in common."""
    return grams[np.lexsort((grams, heat(grams, common)))][: len(grams) - math.ceil(similar * len(grams) - 1e-9) + 1]


def sketch(grams: np.ndarray) -> np.ndarray:
    """For each of 64 x SKETCH bits, whether an odd number of shingles falls on it: sets that differ in k shingles differ in at most k bits."""
    bits = np.bincount((grams.view(np.uint64) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(bool), bitorder="little").view(np.int64)


def apart_by(a: str, b: str) -> Column:
    """In how many bits two sketches differ."""
    differ = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(differ, F.lit(0), lambda x, y: x + y)


def prefix_index(texts: DataFrame, width: int, similar: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """t, n (distinct shingles), first (their prefix), sketch and fp (fingerprint) of each row of ``texts`` (t, text) that has a word."""
    told = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, size, first, sketches, fp = [], [], [], [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                hashes = shingle_hashes(text or b"", width)
                grams = np.unique(hashes.view(np.int64))
                if len(grams):
                    kept.append(i)
                    size.append(len(grams))
                    first.append(prefix(grams, told.value, similar))
                    sketches.append(sketch(grams))
                    fp.append(majority(hashes))
            arrays = [batch.column("t").take(pa.array(kept, pa.int32())), pa.array(size, pa.int32()), *(pa.array(v, pa.list_(pa.int64())) for v in (first, sketches)), pa.array(fp, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["t", "n", "first", "sketch", "fp"])

    return texts.select("t", "text").mapInArrow(run, "t bigint, n int, first array<bigint>, sketch array<bigint>, fp bigint")


def met_by_fingerprint(prints: DataFrame) -> DataFrame:
    """(t, u) to be verified, by SimHash: each text (t, fp) with the first of its fingerprint, and the first ones of fingerprints within RADIUS bits."""
    first = prints.groupBy("fp").agg(F.min("t").alias("u"))
    same = prints.join(first, "fp").where("t <> u").select("t", "u")
    one, other = first.select(F.col("fp").alias("a"), F.col("u").alias("t")), first.select(F.col("fp").alias("b"), "u")
    return same.unionAll(links(first.select("fp")).join(one, "a").join(other, "b").select("t", "u"))


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """t, grams (distinct shingle hashes) of each row of ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t or b"", width)).view(np.int64) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(sets, pa.list_(pa.int64()))], ["t", "grams"])

    return texts.select("t", "text").mapInArrow(run, "t bigint, grams array<bigint>")


def similar_pairs(work: Workspace, texts: DataFrame, sketches: DataFrame, found: DataFrame, width: int, similar: float) -> DataFrame:
    """(a, b), a < b, of the pairs of texts in ``found`` (t, u) that share enough shingles.

    ``sketches`` (t, n, sketch) rule out most others before any shingles are
    fetched; they never rule out a similar pair.
    """
    pairs = work.settle(found.select(F.least("t", "u").alias("a"), F.greatest("t", "u").alias("b")).distinct())
    one, other = (sketches.select(F.col("t").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in ("a", "b"))
    close = work.settle(pairs.join(one, "a").join(other, "b").where(apart_by("sa", "sb") <= unlike(similar, "na", "nb")).select("a", "b"))
    asked = close.select(F.col("a").alias("t")).unionAll(close.select(F.col("b").alias("t"))).distinct()
    sets = work.settle(shingle_sets(texts.join(asked, "t").dropDuplicates(["t"]), width))
    left, right = sets.select(F.col("t").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("t").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    linked = work.settle(close.join(left, "a").join(right, "b").where(both >= similar * (F.size("ga") + F.size("gb") - both)).select("a", "b"))
    work.drop(pairs, close, sets)
    return linked


def unlike(similar: float, n: str, m: str) -> Column:
    """In how many shingles texts with ``n`` and ``m`` of them differ at most, if they are similar."""
    return (F.col(n) + F.col(m)) * ((1 - similar) / (1 + similar)) + 1e-6


def all_outside(split: DataFrame) -> DataFrame:
    """Rows of ``split`` (key, t, n, i, group, main), each with all texts (u, m, j) under its key that are in another group, neither of them the main one or only one."""
    other = split.where("group <> main").select("key", F.col("group").alias("other"), F.col("t").alias("u"), F.col("n").alias("m"), F.col("i").alias("j"))
    once = (F.col("group") == F.col("main")) | (F.col("t") < F.col("u"))
    return split.join(other, "key").where((F.col("group") != F.col("other")) & once)


def middles(members: DataFrame, sets: DataFrame) -> DataFrame:
    """main, middle: the shingles (gram) that over half of a main group's texts have, and how many of these lack each."""
    own = members.where("group = main")
    counts = own.join(sets, "t").select("main", F.explode("grams").alias("gram")).groupBy("main", "gram").agg(F.count("*").alias("c"))
    often = counts.join(own.groupBy("main").agg(F.count("*").alias("size")), "main").where(F.col("c") * 2 > F.col("size"))
    return often.groupBy("main").agg(F.collect_list(F.struct("gram", (F.col("size") - F.col("c")).alias("lacking"))).alias("middle"))


def unlike_middle(members: DataFrame, sets: DataFrame, middle: DataFrame, common: tuple[np.ndarray, np.ndarray], similar: float) -> DataFrame:
    """main, t, group, n, d (in how many shingles the text and the middle differ) and first (those shingles, rare ones first) of each row of ``members``.

    A pair at ``similar`` differs in no more shingles than (1 - similar) / similar
    of either text's, so all but that many of each text's d are in common, and
    ``first`` need not be longer.
    """
    told = members.sparkSession.sparkContext.broadcast(common)
    spare = (1 - similar) / similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, far, first = [], [], []
            texts, grams, lacking = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("grams", "gram", "lacking"))
            for text, shared, less in zip(texts, grams, lacking, strict=True):
                has, lacks = ~np.isin(text, shared), ~np.isin(shared, text)
                differ = np.concatenate([text[has], shared[lacks]])
                rare = np.concatenate([heat(text[has], told.value), less[lacks]])
                size.append(len(text))
                far.append(len(differ))
                first.append(differ[np.lexsort((differ, rare))][: math.floor(spare * len(text) + 1e-6) + 1])
            arrays = [*(batch.column(c) for c in ("main", "t", "group")), *(pa.array(v, pa.int32()) for v in (size, far)), pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["main", "t", "group", "n", "d", "first"])

    grams, lacking = (F.coalesce(f"middle.{c}", F.array().cast("array<bigint>")).alias(c) for c in ("gram", "lacking"))
    rows = members.join(sets, "t").join(middle, "main", "left").select("main", "t", "group", "grams", grams, lacking)
    return rows.mapInArrow(run, "main bigint, t bigint, group bigint, n int, d int, first array<bigint>")


def met_by_difference(work: Workspace, rows: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """(t, u) to be verified, and the table they come from: every pair of similar texts of one main of ``rows``, but for what other pairs link.

    Sets that differ from the middle in d and b shingles differ from each other
    in d + b less twice those differences that they have in common. Texts may
    differ in k(n) + k(m). So where d - k(n) and b - k(m) are 0 or less in sum, the
    texts are linked, each also with the text in which this is least, the nearest:
    they meet that one only. All others must have half that sum of their
    differences in common, which makes a prefix filter. The edits of copies of one
    text are all there is in it, and they share few of them.
    """
    share = (1 - similar) / (1 + similar)
    over = F.col("d") - share * F.col("n")
    nearest = rows.groupBy("main").agg(F.min(over).alias("least"), F.min_by("t", F.struct(over.alias("over"), "t")).alias("nearest"))
    placed = work.settle(rows.withColumn("over", over).join(nearest, "main").withColumn("far", F.col("over") + F.col("least") > -1e-6))
    found = placed.where("over + least < 1e-6 and t <> nearest").select("t", F.col("nearest").alias("u"))
    # far texts meet all, the others only far ones
    common = F.greatest((F.col("over") + F.when(F.col("far"), F.col("least")).otherwise(-F.col("least"))) / 2, F.col("d") - (1 - similar) / similar * F.col("n"))
    length = F.col("d") - F.greatest(F.ceil(common - 1e-6), F.lit(1)) + 1
    entries = placed.select("main", "t", "group", "n", "d", "over", "far", F.posexplode(F.slice("first", F.lit(1), F.greatest(length, F.lit(0)).cast("int"))).alias("i", "key"))
    other = entries.where("far").select("main", "key", *(F.col(a).alias(b) for a, b in (("group", "other"), ("t", "u"), ("n", "m"), ("d", "b"), ("over", "above"), ("i", "j"))))
    once = ~F.col("far") | (F.col("t") < F.col("u"))
    sizes = F.least("n", "m") >= similar * F.greatest("n", "m") - 1e-6
    fits = F.least(F.col("d") - F.col("i"), F.col("b") - F.col("j")) >= (F.col("over") + F.col("above")) / 2 - 1e-6
    across = entries.join(other, ["main", "key"]).where((F.col("group") != F.col("other")) & once & sizes & fits)
    return found.unionAll(across.select("t", "u")), placed


def one_of_each_group(docs: DataFrame, width: int = 5, similar: float = SIMILAR) -> DataFrame:
    """``docs`` without near copies: of texts linked by a Jaccard similarity of word shingles of ``similar`` or more, one row stays.

    Equal texts collapse first; the row with the smallest id stays (null last)
    and stands for them. SimHash finds the closest ones: fingerprints that
    differ in two bits or fewer, by multi-index hashing, verified like all
    others. All other links are found exactly, by a prefix filter: texts at
    ``similar`` have one of their first n - ceil(similar x n) + 1 shingles in
    common, in any order that is the same for all texts. Rare shingles come
    first in it, so what many texts share is seldom looked up. Pairs that the
    sizes and places of the shared shingle and the sketches of both texts allow
    are verified by all their shingles. Of every linked group the text that is
    first by row stays, and the rest goes.

    Texts under a key that more than HOT of them share are compared with one
    of them first. Where that leaves several groups under a key, its texts meet those of
    other groups if they are fewer than WIDE. More texts are described by how they
    differ from the middle of the key's largest group, and meet by these
    differences, again by a prefix filter that loses no link, so groups are those of all
    links whatever the size of a key. Texts only go when all groups are known.
    A text without words (null counts as empty) only has equal ones; very long
    texts are compared whole; of rows that are repeated as a whole one stays. All
    columns are kept, whatever their names. An empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession)
    names = docs.columns
    own = [apart(f"__{c}", names) for c in ("n", "d", "t")]
    keyed = docs.select(*names, *[k.alias(c) for k, c in zip(text_key(), own, strict=True)])
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), *text_key()).withColumnRenamed("__t", "t")
    firsts = work.settle(texts.groupBy("t").agg(F.min(F.struct("__n", "__d")).alias("first")))
    common = common_shingles(work, texts, width)
    index = work.settle(prefix_index(texts, width, similar, common).dropDuplicates(["t"]))
    sketches = work.settle(index.select("t", "n", "sketch"))
    prints = work.settle(index.select("t", "fp"))
    slices = []
    for k in range(SLICES):
        entries = index.select("t", "n", F.posexplode("first").alias("i", "key")).where(F.pmod("key", F.lit(SLICES)) == k)
        shared = entries.groupBy("key").agg(F.count("*").alias("c"), F.min("t").alias("least")).where("c > 1")
        slices.append(work.settle(entries.join(shared, "key")))
    work.drop(index)
    hits = reduce(DataFrame.unionAll, slices)
    # of a linked pair, the first shingle in common leaves enough behind it on both sides
    fits = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= similar / (1 + similar) * (F.col("n") + F.col("m")) - 1e-9
    met = hits.where((F.col("c") <= HOT) | (F.col("t") == F.col("least"))).select("key", F.col("t").alias("u"), F.col("n").alias("m"), F.col("i").alias("j"))
    found = hits.join(met, "key").where((F.col("t") != F.col("u")) & fits)
    found = met_by_fingerprint(prints).unionAll(found.select("t", "u"))
    labels = work.settle(connected(work, similar_pairs(work, texts, sketches, found, width, similar)))
    work.drop(prints)
    # where a hot key still has several groups, texts meet those in others, or by their differences from the middle of the largest
    group = labels.select(F.col("node").alias("t"), "component")
    grouped = hits.where(F.col("c") > HOT).join(group, "t", "left").select("key", "t", "n", "i", "c", F.coalesce("component", "t").alias("group"))
    groups = grouped.groupBy("key", "group").agg(F.count("*").alias("c"))
    several = groups.groupBy("key").agg(F.max_by("group", F.struct("c", "group")).alias("main"), F.count("*").alias("groups")).where("groups > 1")
    split = work.settle(grouped.join(several.select("key", "main"), "key"))
    members = work.settle(split.where(F.col("c") >= WIDE).select("main", "t", "group").distinct())
    sets = work.settle(shingle_sets(texts.join(members.select("t").distinct(), "t").dropDuplicates(["t"]), width))
    middle = work.settle(middles(members, sets))
    rows = work.settle(unlike_middle(members, sets, middle, common, similar))
    work.drop(sets, middle)
    differing, placed = met_by_difference(work, rows, similar)
    found = differing.unionAll(all_outside(split.where(F.col("c") < WIDE)).where(fits).select("t", "u"))
    labels = work.settle(connected(work, similar_pairs(work, texts, sketches, found, width, similar).unionAll(labels.select("node", "component"))))
    work.drop(split, members, rows, placed)
    work.drop(*slices)
    who = labels.join(firsts, labels["node"] == firsts["t"])
    stays = who.groupBy("component").agg(F.min_by("node", "first").alias("stays"))
    removed = labels.join(stays, "component").where("node <> stays").select(F.col("node").alias("t"))
    kept = firsts.select(F.col("first.__n").alias(own[0]), F.col("first.__d").alias(own[1]), "t").join(removed, "t", "left_anti").withColumnRenamed("t", own[2])
    out = keyed.join(kept, own).dropDuplicates(own)
    return out.select(*names)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Three-word shingles over whole documents: doc_id, fingerprint (16 hex digits), component_id."""
    from .workspace import table

    found = near_duplicates(table(spark, sf_dir, "documents"), width=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
