"""Language-model scores: a log-bilinear model trained in numpy by noise-contrastive estimation.

Tokens are words (runs of bytes other than ASCII white space, A-Z lower-cased)
and one end a text. The model predicts a token's class: the most frequent
words are classes of their own, the end is one, and other words share classes
by their last two bytes. A context vector is the sum of the vectors of the two
classes before, a class scores by its product with the context vector plus a
bias, and scores are normalised over all classes. Within a shared class a word
has its share of the class's counts, plus one.

Everything gathered covers all training documents: the count of every word,
how often each class follows each class at a distance of one and two, and then
every token with both classes before it. Training starts on the counts, in
which the objective of noise-contrastive estimation (data against unigram
noise) is a sum over pairs of classes, made of matrix products; there the
distances are apart, and the weights that give all training tokens the best
sum of log scores bring them together. Then every partition goes through its
own tokens once, with the summed context and noise classes drawn from the
unigram counts, and the models of all partitions are averaged by their tokens.
Products of all contexts and classes are tabulated once, and scoring a token
is a lookup. The number of classes is a constant: what grows with the corpus
is what is counted and trained on, not the model.

The most frequent words (a constant number of at most 64 bytes each) travel to
the executors; all other words meet their counts in a join.

Null text counts as empty: one token, the end. Repeated rows get a row each,
extra columns are ignored, and an empty table gives an empty result.
"""

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, held_out, table

CLASSES, SHARED, WIDTH = 512, 128, 24
#: Tokens of a step, and noise classes that are drawn for it.
STEP, DRAWN = 8192, 32
FREQUENT, FREQUENT_BYTES = 262_144, 64
NOISE = 8
#: No word holds white space, so a line feed can stand for the end of a text.
END = b"\n"
#: Words that a worker counts before it hands them on.
COUNTED = 200_000


def tokens_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def shared_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SHARED


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), c of all tokens of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                seen.update(tokens_of(text))
                seen[END] += 1
                if len(seen) > COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])

    return docs.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class ClassOf(dict):
    """word -> class; words without a class of their own have a shared one."""

    def __missing__(self, word: bytes) -> int:
        return shared_class(word)


def class_pairs(docs: DataFrame, vocabulary) -> np.ndarray:
    """(2, CLASSES, CLASSES): how often a class follows another at a distance of one and two; ``vocabulary`` is a broadcast list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ClassOf(vocabulary.value)
        found = np.zeros((2, CLASSES * CLASSES), np.int64)
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = tokens_of(text)
                classes = np.fromiter(map(own.__getitem__, words), np.int64, len(words))
                seen = np.concatenate([[SHARED, SHARED], classes, [SHARED]])
                for lag in (1, 2):
                    np.add.at(found[lag - 1], seen[2 - lag : -lag] * CLASSES + seen[2:], 1)
        lag, cell = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array((lag * CLASSES * CLASSES + cell).astype(np.int64)), pa.array(found[lag, cell])], ["cell", "n"])

    cells = docs.select("text").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(2 * CLASSES * CLASSES, np.float64)
    got = cells.toArrow()  # at most 2 * CLASSES^2 rows
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(2, CLASSES, CLASSES)


def train(pairs: np.ndarray, steps: int = 300, rate: float = 0.05, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context vectors of both distances, class vectors, biases) by Adam on the noise-contrastive objective."""
    rng = np.random.default_rng(seed)
    share = pairs[0].sum(0) + 0.5
    noise = share / share.sum()
    p = {"q": rng.normal(0, 0.1, (2, CLASSES, WIDTH)), "r": rng.normal(0, 0.1, (CLASSES, WIDTH)), "b": np.log(noise)}
    if not pairs.sum():
        return p["q"] * 0, p["r"], p["b"]
    data = pairs / pairs.sum((1, 2), keepdims=True)
    against = NOISE * data.sum(2, keepdims=True) * noise
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    for step in range(1, steps + 1):
        s = p["q"] @ p["r"].T + p["b"]
        real = 1 / (1 + np.exp(-np.clip(s - np.log(NOISE * noise), -50, 50)))
        g = against * real - data * (1 - real)
        grads = {"q": g @ p["r"], "r": np.einsum("lcw,lcd->wd", g, p["q"]), "b": g.sum((0, 1))}
        for k, x in grads.items():
            # rare contexts have small gradients: Adam takes them to scale
            m, v = moment[k]
            m += 0.1 * (x - m)
            v += 0.01 * (x * x - v)
            p[k] = p[k] - rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return p["q"], p["r"], p["b"]


def log_norms(first: np.ndarray, second: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """log of the sum over classes, for each pair of classes before; ``first`` and ``second`` are (context, class)."""
    # exp(a + b + c) over classes is one matrix product of exponentials
    top_1, top_2 = first.max(1, keepdims=True), second.max(1, keepdims=True)
    products = np.exp(first - top_1) @ np.exp(second - top_2 + bias).T
    return np.log(np.maximum(products, 1e-300)) + top_1 + top_2.T


def contexts(pairs: np.ndarray) -> np.ndarray:
    """How often a class at a distance of two is followed by one at a distance of one, before a token, from the counts of ``class_pairs``."""
    # all neighbours but a text's last word and its end, and two ends before each text
    out = pairs[0].copy()
    out[:, SHARED] = 0
    out[SHARED, SHARED] = pairs[0][:, SHARED].sum()
    return out


def mixed(q: np.ndarray, r: np.ndarray, b: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The context vectors of both distances, by the weights that give all tokens counted in ``pairs`` the best sum of log scores."""
    one, two = q[0] @ r.T, q[1] @ r.T
    if not pairs.size or not pairs.sum():
        return q
    # a sum of log scores over tokens needs pairs of classes only
    before, of_one, of_two, of_bias = contexts(pairs), (pairs[0] * one).sum(), (pairs[1] * two).sum(), pairs[0].sum(0) @ b
    best = None
    for w1 in (0.4, 0.6, 0.8, 1.0):
        for w2 in (0.0, 0.2, 0.4, 0.6, 0.8):
            fit = w1 * of_one + w2 * of_two + of_bias - (before * log_norms(w1 * one, w2 * two, b).T).sum()
            if best is None or fit > best[0]:
                best = fit, w1, w2
    return np.stack([best[1] * q[0], best[2] * q[1]])


def scattered(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """(CLASSES, WIDTH): sums of ``values`` by the classes in ``rows``."""
    out = np.zeros((CLASSES, values.shape[1]), values.dtype)
    order = np.argsort(rows, kind="stable")
    first = np.flatnonzero(np.diff(rows[order], prepend=-1))
    out[rows[order[first]]] = np.add.reduceat(values[order], first, axis=0)
    return out


class Trainer:
    """Adagrad on the noise-contrastive objective of tokens with the summed context of two classes before."""

    def __init__(self, q: np.ndarray, r: np.ndarray, b: np.ndarray, noise: np.ndarray, seed: int, rate: float = 0.02):
        self.p = {k: v.astype(np.float32) for k, v in (("q1", q[0]), ("q2", q[1]), ("r", r), ("b", b))}
        self.squares = {k: np.full_like(v, 1e-3) for k, v in self.p.items()}
        self.noise, self.log_noise, self.rate = noise, np.log(NOISE * noise).astype(np.float32), np.float32(rate)
        self.rng, self.tokens = np.random.default_rng(seed), 0

    def step(self, t2: np.ndarray, t1: np.ndarray, t0: np.ndarray) -> None:
        p, n = self.p, len(t0)
        drawn = self.rng.choice(CLASSES, DRAWN, p=self.noise)
        context = p["q1"][t1] + p["q2"][t2]
        own = p["r"][t0]
        real = np.einsum("bw,bw->b", context, own) + p["b"][t0] - self.log_noise[t0]
        false = context @ p["r"][drawn].T + (p["b"] - self.log_noise)[drawn]
        # gradients of -log s(real) - NOISE x mean of log(1 - s(false)), by scores
        g_real = -1 / (1 + np.exp(np.clip(real, -50, 50)))
        g_false = np.float32(NOISE / DRAWN) / (1 + np.exp(-np.clip(false, -50, 50)))
        g_context = g_real[:, None] * own + g_false @ p["r"][drawn]
        spread = np.zeros((CLASSES, WIDTH), np.float32)
        np.add.at(spread, drawn, g_false.T @ context)
        grads = {
            "q1": scattered(t1, g_context), "q2": scattered(t2, g_context), "r": scattered(t0, g_real[:, None] * context) + spread,
            "b": np.bincount(t0, g_real, CLASSES) + np.bincount(drawn, g_false.sum(0), CLASSES),
        }
        for k, g in grads.items():
            g = (g / n).astype(np.float32)
            self.squares[k] += g * g
            p[k] -= self.rate * g / np.sqrt(self.squares[k])
        self.tokens += n


def refined(docs: DataFrame, vocabulary, q: np.ndarray, r: np.ndarray, b: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model after every partition of ``docs`` has trained it on all its tokens, averaged by their numbers."""
    start = docs.sparkSession.sparkContext.broadcast((q, r, b, share / share.sum()))
    names = ("q1", "q2", "r", "b")
    sizes = [CLASSES * WIDTH] * 3 + [CLASSES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ClassOf(vocabulary.value)
        trainer = Trainer(*start.value, seed=TaskContext.get().partitionId())
        held: list[np.ndarray] = []
        waiting = 0
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = tokens_of(text)
                line = np.empty(len(words) + 3, np.int64)
                line[[0, 1, -1]] = SHARED
                line[2:-1] = np.fromiter(map(own.__getitem__, words), np.int64, len(words))
                held.append(np.stack([line[:-2], line[1:-1], line[2:]]))
                waiting += len(words) + 1
                if waiting >= STEP:
                    some = np.concatenate(held, 1)
                    for k in range(0, waiting, STEP):
                        trainer.step(*some[:, k : k + STEP])
                    held, waiting = [], 0
        if held:
            trainer.step(*np.concatenate(held, 1))
        if trainer.tokens:
            flat = np.concatenate([trainer.p[k].ravel() for k in names]).astype(np.float64) * trainer.tokens
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(flat))), pa.array(np.concatenate([[float(trainer.tokens)], flat]))], ["cell", "x"])

    # as many rows as the model has numbers
    summed = docs.select("text").mapInArrow(run, "cell bigint, x double").groupBy("cell").agg(F.sum("x").alias("x")).toArrow()
    cells = np.zeros(sum(sizes) + 1)
    cells[summed["cell"].to_numpy() + 1] = summed["x"].to_numpy()
    if not cells[0]:
        return q, r, b
    parts = np.split(cells[1:] / cells[0], np.cumsum(sizes)[:-1])
    return np.stack([parts[0], parts[1]]).reshape(2, CLASSES, WIDTH), parts[2].reshape(CLASSES, WIDTH), parts[3]


def tabulated(q: np.ndarray, r: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """Tables of natural log scores: of a class after each class at both distances, and their norms for each two classes before."""
    one, two = q[0] @ r.T, q[1] @ r.T
    return {"one": one.astype(np.float32), "two": two.astype(np.float32), "bias": b.astype(np.float32), "norms": log_norms(one, two, b).astype(np.float32)}


def frequent_words(counts: DataFrame) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """(words with a class of their own, words that travel, their counts).

    The least count that travels comes from a histogram of logarithms of
    counts, so no task sorts the vocabulary.
    """
    short = counts.where((F.octet_length("word") <= FREQUENT_BYTES) & (F.col("word") != F.lit(END)))
    own = [bytes(r["word"]) for r in short.orderBy(F.desc("c"), "word").limit(CLASSES - SHARED - 1).collect()]
    level = F.floor(F.log2("c") * 16)
    room, least = FREQUENT - len(own) - 1, None
    for r in sorted(short.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    travels = F.col("word").isin([END, *own])
    if least is not None:
        travels = travels | (level >= least)
    found = counts.where((F.octet_length("word") <= FREQUENT_BYTES) & travels).toArrow()
    return own, found["word"].to_pylist(), found["c"].to_numpy()


def score(docs: DataFrame, train_on=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs``.

    ``train_on`` is a Column that marks training rows; all but those whose
    crc32(doc_id as text) mod 7 is 2 if None.
    """
    spark, work = docs.sparkSession, Workspace(docs.sparkSession)
    out = held_out("doc_id", 7, 2)
    training = docs.where(~out if train_on is None else train_on)
    counts = work.settle(word_counts(training))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    own, words, numbers = frequent_words(counts)
    vocabulary = {END: SHARED} | {w: SHARED + 1 + i for i, w in enumerate(own)}
    shared_vocabulary = spark.sparkContext.broadcast(vocabulary)
    pairs = class_pairs(training, shared_vocabulary)
    q, r, b = train(pairs)
    tables = tabulated(*refined(training, shared_vocabulary, mixed(q, r, b, pairs), r, b, pairs[0].sum(0) + 0.5))
    tail = F.when(F.octet_length("word") <= 2, F.col("word")).otherwise(F.substring("word", F.octet_length("word") - 1, F.lit(2)))
    masses = counts.groupBy((F.crc32(tail) % SHARED).alias("k")).agg(F.sum(F.col("c") + 1).alias("mass")).collect()
    mass = np.ones(CLASSES)
    for r in masses:
        mass[r["k"]] += r["mass"]
    count_of = dict(zip(words, numbers.tolist(), strict=True))
    for w in vocabulary:
        if w in count_of:
            mass[shared_class(w)] -= count_of[w] + 1
    mass[SHARED:] = 1
    classes = np.fromiter((vocabulary[w] if w in vocabulary else shared_class(w) for w in words), np.int64, len(words))
    logs = np.log10(numbers + 1.0)
    known = {
        "words": words, "class": classes, "log": logs,
        # what a token of its class adds beside log10(c + 1)
        "inside": np.where(classes >= SHARED, -logs, 0.0), "mass": np.log10(mass), **tables,
    }
    shared = spark.sparkContext.broadcast(known)
    has_end = END in count_of
    log_end = math.log10(count_of.get(END, 0) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = shared.value
        at = {w: i for i, w in enumerate(k["words"])}
        next_row = TaskContext.get().partitionId() << 36
        one, two, bias, norms = (k[x] for x in ("one", "two", "bias", "norms"))
        for batch in batches:
            cols: dict[str, list] = {c: [] for c in ("n_tokens", "n_known", "sum_log", "model", "rare")}
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                tokens = tokens_of(text)
                found = np.fromiter((at.get(w, -1) for w in tokens), np.int64, len(tokens))
                seen = found >= 0
                rare = Counter(tokens[i] for i in np.flatnonzero(~seen).tolist())
                kind = np.where(seen, k["class"][found] if len(k["words"]) else 0, 0)
                for i in np.flatnonzero(~seen).tolist():
                    kind[i] = shared_class(tokens[i])
                line = np.concatenate([[SHARED, SHARED], kind, [SHARED]])
                t2, t1, t0 = line[:-2], line[1:-1], line[2:]
                logp = (one[t1, t0] + two[t2, t0] + bias[t0] - norms[t1, t2]).sum(dtype=np.float64) / math.log(10)
                own = found[seen]
                sum_log = k["log"][own].sum() + log_end if len(own) else log_end
                inside = (k["inside"][own].sum() if len(own) else 0.0) - k["mass"][t0].sum() - log_end
                cols["n_tokens"].append(len(tokens) + 1)
                cols["n_known"].append(len(own) + has_end)
                cols["sum_log"].append(float(sum_log))
                cols["model"].append(float(logp + inside))
                cols["rare"].append([{"word": w, "n": n} for w, n in rare.items()])
            rows = np.arange(next_row, next_row + batch.num_rows)
            next_row += batch.num_rows
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))
            made = [pa.array(v, kind) for v, kind in zip(cols.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column("doc_id"), batch.column("held_out"), *made], ["row", "doc_id", "held_out", *cols])

    narrow = docs.select("doc_id", out.alias("held_out"), "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    scored = work.settle(narrow.mapInArrow(run, f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, sum_log double, model double, rare array<struct<word:binary,n:bigint>>"))
    rare = scored.select("row", F.inline("rare")).join(counts, "word")
    rare = rare.groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_log"))
    whole = scored.drop("rare").join(rare, "row", "left")
    sum_log = F.col("sum_log") + F.coalesce("more_log", F.lit(0.0))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (sum_log - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"), (sum_log + F.col("model")).alias("score"),
    )


def op9_lm(spark, sf_dir: str) -> DataFrame:
    """Unigram and log-bilinear scores of all whole documents."""
    return score(table(spark, sf_dir, "documents"))
