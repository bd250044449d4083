"""Toxicity: a numpy classifier trained by non-negative positive-unlabelled learning.

The classifier knows confirmed toxic texts and unlabelled ones, never texts
confirmed clean. With the share p of toxic text (the class prior), the risk on
clean text is the risk on unlabelled text less p times that on toxic text;
where that difference falls below zero the step is reversed, so the flexible
classifier cannot fit it away (Kiryo et al. 2017).

A word's features are itself and its first four to eight bytes. A word scores
by its best feature and a text by the three best of its distinct words, so
neither long nor short texts are favoured. Words are runs of bytes other than
ASCII white space, A-Z lower-cased, without punctuation at their ends.

The toxic texts are a sample of labelled rows whose size is a parameter. The
unlabelled side is every document outside the held-out third: how many of them
have each feature of the toxic texts is counted, and features that are not much
more frequent among toxic texts are left out. The prior is how much rarer texts
with many such features are among all texts. Then the weights follow the
gradient of the risk over all documents, which each pass sums over a table of
the features that documents have.

Scoring reads every word of every row and shuffles nothing. Null text counts
as empty, and very long texts are read whole. Repeated rows get a row each,
rows labelled twice count once, extra columns are ignored, and an empty table
gives an empty result. Without toxic labels every score is a half.
"""

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import labelled_sample, score, sigmoid
from .workspace import Workspace, apart, held_out, table

#: Toxic texts to fit on; features of them that get a weight, and how much more frequent among them they are at least.
FIT_TOXIC, FEATURES, LIFT = 3000, 4096, 4.0
BEST, LEAST_TEXTS, THRESHOLD = 3, 4, 0.7
#: The share of toxic texts above a level that may tell the prior.
TELLING = 0.9
STEMS = range(4, 9)
#: Words whose scores a worker remembers; beyond it, it starts anew.
REMEMBERED = 400_000
EDGES = b".,;:!?\"'()[]{}<>|*#%&$-_/\\"


def words_of(text: bytes) -> set[bytes]:
    return {w.strip(EDGES) for w in text.lower().split()} - {b""}


def features(word: bytes) -> list[tuple[int, bytes]]:
    return [(0, word), *((n, word[:n]) for n in STEMS if len(word) > n)]


class Words(dict):
    """word -> numbers of its features in ``known``; remembers REMEMBERED words."""

    def __init__(self, known: dict[tuple[int, bytes], int]):
        self.known = known

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        bare = word.strip(EDGES)
        ids = tuple(sorted({self.known[f] for f in features(bare) if f in self.known})) if bare else ()
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = ids
        return ids

    def of(self, text: bytes) -> list[tuple[int, ...]]:
        """The features of each distinct word of ``text`` that has any."""
        return [ids for ids in set(map(self.__getitem__, set(text.lower().split()))) if ids]


class Bags:
    """Texts as words and words as features, all in flat arrays; ``counts`` says how many texts a row stands for."""

    def __init__(self, rows: list[list[tuple[int, ...]]], counts: np.ndarray, none: int):
        most = 1 + len(STEMS)
        words = [(i, ids) for i, row in enumerate(rows) for ids in row]
        self.counts, self.row = counts.astype(np.float64), np.array([i for i, _ in words], np.int64)
        self.words = np.full((len(words), most), none, np.int64)
        for k, (_, ids) in enumerate(words):
            self.words[k, : len(ids)] = ids

    def best(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum of the best positive word scores of each row, and the (row, feature) that they come from."""
        scores = weights[self.words]
        which = scores.argmax(1)
        scores = np.take_along_axis(scores, which[:, None], 1)[:, 0]
        some = np.flatnonzero(scores > 0)
        order = some[np.lexsort((-scores[some], self.row[some]))]
        row = self.row[order]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        order = order[place < BEST]
        row = self.row[order]
        return np.bincount(row, scores[order], len(self.counts)), row, self.words[order, which[order]]

    def risks(self, weights: np.ndarray, base: float) -> dict[str, np.ndarray | float]:
        """Sums over all texts: of both logistic losses, and of the gradients by weights and base that the loss as clean has, and that as toxic."""
        sums, row, feature = self.best(weights)
        s = sigmoid(sums + base)
        clean, toxic = self.counts * s, self.counts * (s - 1)
        return {
            "n": self.counts.sum(), "loss_clean": (-np.log1p(-np.minimum(s, 1 - 1e-12)) * self.counts).sum(), "slope_clean": clean.sum(), "slope_toxic": toxic.sum(),
            "clean": np.bincount(feature, clean[row], len(weights)), "toxic": np.bincount(feature, toxic[row], len(weights)),
        }


def without_copies(texts: list[bytes]) -> list[bytes]:
    """``texts`` without those that share half of their eight least word hashes with one text before them.

    A group of copies would make every word of it look like a mark of its label.
    """
    seen: dict[int, list[int]] = {}
    kept = []
    for text in texts:
        least = sorted({zlib.crc32(w) for w in words_of(text)})[:8]
        shared = Counter(k for h in least for k in seen.get(h, ()))
        if not shared or max(shared.values()) * 2 < len(least):
            for h in least:
                seen.setdefault(h, []).append(len(kept))
            kept.append(text)
    return kept


def toxic_features(toxic: list[bytes]) -> dict[tuple[int, bytes], int]:
    """feature -> how many of the texts have it, for features of LEAST_TEXTS or more."""
    seen: Counter = Counter()
    for text in toxic:
        seen.update({f for w in words_of(text) for f in features(w)})
    return {f: n for f, n in seen.items() if n >= LEAST_TEXTS}


def unlabelled(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out("doc_id", 3, 1)).select("text")


def document_counts(docs: DataFrame, known: dict[tuple[int, bytes], int]) -> tuple[int, np.ndarray]:
    """(documents, how many of them have each feature) over all of ``docs`` (text)."""
    told = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, seen = Words(told.value), 0, np.zeros(len(told.value), np.int64)
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                own = {i for ids in words.of(text or b"") for i in ids}
                seen[np.fromiter(own, np.int64, len(own))] += 1
                n += 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(seen[some], n))], ["feature", "n"])

    # no more rows than the toxic sample has features
    found = docs.mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    feature, n = found["feature"].to_numpy(), found["n"].to_numpy()
    out = np.zeros(len(known) + 1, np.int64)
    out[feature] = n
    return int(out[-1]), out[:-1]


def bags_of(docs: DataFrame, known: dict[tuple[int, bytes], int]) -> DataFrame:
    """flat (features of a word, -1 after each word), n: how many of ``docs`` (text) have just these words with features."""
    told = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(told.value)
        for batch in batches:
            flat = [[x for ids in sorted(words.of(t or b"")) for x in (*ids, -1)] for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(flat, pa.list_(pa.int32()))], ["flat"])

    return docs.mapInArrow(run, "flat array<int>").groupBy("flat").agg(F.count("*").alias("n"))


def words_in(flat: list[int]) -> list[tuple[int, ...]]:
    out, own = [], []
    for x in flat:
        if x < 0:
            out.append(tuple(own))
            own = []
        else:
            own.append(x)
    return out


def risks_over(bags: DataFrame, weights: np.ndarray, base: float) -> dict[str, np.ndarray | float]:
    """Bags.risks() of all rows of ``bags``, summed over the cluster."""
    told = bags.sparkSession.sparkContext.broadcast((weights, base))
    names = ("n", "loss_clean", "slope_clean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = told.value
        for batch in batches:
            found = Bags([words_in(f) for f in batch.column("flat").to_pylist()], batch.column("n").to_numpy(), len(w) - 1).risks(w, b)
            some = np.flatnonzero(found["clean"])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-3, -2, -1], some])), pa.array(np.concatenate([[found[k] for k in names], found["clean"][some]]))], ["feature", "x"])

    summed = bags.mapInArrow(run, "feature bigint, x double").groupBy("feature").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(len(weights) + 3)
    out[summed["feature"].to_numpy() + 3] = summed["x"].to_numpy()
    told.unpersist()
    return {"clean": out[3:]} | dict(zip(names, out[:3].tolist(), strict=True))


def fit(toxic: Bags, bags: DataFrame, start: np.ndarray, prior: float, passes: int = 40, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """(weights, base) that minimise the non-negative risk of the logistic loss; each pass is over all documents."""
    weights, base = start.copy(), float(np.log(prior / (1 - prior)))
    squares, base_square = np.full(len(weights), 1e-6), 1e-6
    for step in range(passes):
        u, p = risks_over(bags, weights, base), toxic.risks(weights, base)
        if not u["n"]:
            break
        # the risk on clean texts is that on all texts, less the toxic share of them
        clean = u["loss_clean"] / u["n"] - prior * p["loss_clean"] / p["n"]
        g, slope = u["clean"] / u["n"] - prior * p["clean"] / p["n"], u["slope_clean"] / u["n"] - prior * p["slope_clean"] / p["n"]
        if clean >= 0:
            g, slope = g + prior * p["toxic"] / p["n"], slope + prior * p["slope_toxic"] / p["n"]
        else:
            g, slope = -g, -slope
        g[-1] = 0
        squares += g * g
        base_square += slope * slope
        pace = rate * (1 - step / passes)
        weights -= pace * g / np.sqrt(squares)
        base -= pace * slope / np.sqrt(base_square)
    return weights, base


def prior_of(toxic: Bags, bags: DataFrame, start: np.ndarray) -> float:
    """The share of toxic texts among all.

    Texts that score at least so much are as much rarer among all texts as
    toxic ones are, if hardly any of them is clean; else the ratio is larger.
    So it is the least ratio over levels that hold TELLING of the toxic texts
    that have a feature, each by its sure side (a standard deviation).
    """
    scores = toxic.best(start)[0]
    levels = np.unique(np.quantile(scores[scores > 0], np.linspace(0, 1 - TELLING, 11))) if (scores > 0).any() else np.empty(0)
    told = bags.sparkSession.sparkContext.broadcast((start, levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, own = told.value
        for batch in batches:
            n = batch.column("n").to_numpy()
            sums = Bags([words_in(f) for f in batch.column("flat").to_pylist()], n, len(w) - 1).best(w)[0]
            above = [n[sums >= t].sum() for t in own]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(own))), pa.array(np.array([n.sum(), *above], np.int64))], ["level", "n"])

    counted = {r["level"]: r["n"] for r in bags.mapInArrow(run, "level bigint, n bigint").groupBy("level").agg(F.sum("n").alias("n")).collect()}
    every, least = counted.get(-1, 0), 0.5
    for k, t in enumerate(levels.tolist() if every else []):
        n, m = (scores >= t).sum(), counted[k]
        if n > 1:
            least = min(least, (m + np.sqrt(m) + 1) / every / ((n - np.sqrt(n)) / len(scores)))
    return max(float(least), 1e-3)


def learned(docs: DataFrame, labels: DataFrame, toxic_rows: int = FIT_TOXIC) -> tuple[dict[tuple[int, bytes], float], float]:
    """(weight of each feature, base) from toxic rows of ``labels`` and all documents, but for the held-out third."""
    toxic = without_copies([t for t, _ in labelled_sample(docs, labels.where("toxic = 1"), "toxic", toxic_rows)])
    if not toxic:
        return {}, 0.0
    counted = toxic_features(toxic)
    names = sorted(counted)
    every, in_all = document_counts(unlabelled(docs), {f: i for i, f in enumerate(names)})
    in_toxic = np.array([counted[f] for f in names], np.float64)
    lift = (in_toxic - np.sqrt(in_toxic)) / len(toxic) / ((in_all + 1) / (every + 1))
    kept = [i for i in np.argsort(-lift, kind="stable")[:FEATURES].tolist() if lift[i] >= LIFT]
    known = {names[i]: k for k, i in enumerate(kept)}
    work = Workspace(docs.sparkSession)
    bags = work.settle(bags_of(unlabelled(docs), known))
    words = Words(known)
    own = Bags([words.of(t) for t in toxic], np.ones(len(toxic)), len(known))
    start = np.append(np.log(lift[kept]), 0.0)
    weights, base = fit(own, bags, start, prior_of(own, bags, start))
    work.drop(bags)
    return {f: float(weights[i]) for f, i in known.items()}, base


def scorer(docs: DataFrame, labels: DataFrame, toxic_rows: int = FIT_TOXIC):
    """A function from texts to logits, learned from toxic rows of ``labels`` and all documents, but for the held-out third."""
    weights, base = learned(docs, labels, toxic_rows)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    memo: dict[bytes, float] = {}

    def logits(texts: list[bytes]) -> np.ndarray:
        out, weight = np.empty(len(texts)), shared.value
        if len(memo) > REMEMBERED:
            memo.clear()
        for i, text in enumerate(texts):
            words = set(text.lower().split())
            for word in words.difference(memo):
                bare = word.strip(EDGES)
                memo[word] = max(weight.get(f, 0.0) for f in features(bare)) if bare else 0.0
            hot = {w.strip(EDGES): memo[w] for w in words if memo[w] > 0}
            out[i] = base + sum(sorted(hot.values())[-BEST:])
        return out

    return logits


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **limits) -> DataFrame:
    """Toxicity of every row of ``docs``; ``limits`` are those of scorer()."""
    return score(docs, scorer(docs, labels, **limits), threshold)


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **limits) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns, whatever their names.

    Null and empty texts score like any text without a feature; repeated rows
    and ties stay or go together. An empty table gives an empty result.
    """
    name = apart("__score", docs.columns)
    scored = score(docs, scorer(docs, labels, **limits), threshold, carry=name)
    return scored.where(F.col(name) < threshold).select(*docs.columns)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity scores of all whole documents."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
