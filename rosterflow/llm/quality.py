"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes. Each byte has a learned embedding and, at a series
of lags, a flag that it equals the byte that far before it. Learned filters
run over chunks of 16 bytes that start every 8 bytes, to the end of the text;
each filter keeps its largest response (max pooling), and a logistic layer
combines the pooled responses into one probability.

The network is fitted on the driver on a sample of labelled rows whose size
is a parameter; scoring reads every byte of every row and shuffles nothing.
Null text counts as empty and has a score too. Repeated rows get a row each,
extra columns are ignored, and an empty table gives an empty result. Without
labels of both kinds every score is the share of label 1 (0.5 without labels).
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .workspace import held_out, table

BLOCK, LAGS, EMBED, FILTERS = 8, 24, 4, 16
GAP = LAGS // BLOCK
#: Labelled rows to fit on, per label.
FIT_ROWS = 1500
#: Bytes that are scored at once.
SPAN = 1 << 20


def blocks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first block, chunks) of texts laid out in blocks of 8 bytes, with blank blocks between them.

    Chunk k of a text is its blocks k and k + 1; its blocks cover all its bytes.
    """
    size = np.array([len(t) for t in texts], np.int64)
    chunks = np.maximum(1, -(-size // BLOCK) - 1)
    first = np.cumsum(np.concatenate([[0], chunks + 1 + GAP]))[:-1] + GAP
    buffer = np.zeros((int(first[-1] + chunks[-1]) + 1) * BLOCK, np.uint8)
    for text, at in zip(texts, (first * BLOCK).tolist(), strict=True):
        buffer[at : at + len(text)] = np.frombuffer(text, np.uint8)
    return buffer, first, chunks


def repeats(buffer: np.ndarray) -> np.ndarray:
    """For each block and lag, the share of bytes that equal the byte that far before."""
    out = np.zeros((len(buffer) // BLOCK, LAGS), np.float32)
    there = buffer != 0
    for lag in range(1, LAGS + 1):
        same = np.zeros(len(buffer), np.uint8)
        same[lag:] = (buffer[lag:] == buffer[:-lag]) & there[lag:]
        with np.errstate(over="ignore"):
            out[:, lag - 1] = (same.view(np.uint64) * np.uint64(0x0101010101010101)) >> np.uint64(56)
    return out * np.float32(1 / (2 * BLOCK))


class Network:
    """Parameters: embed (256, 4), near and far (the chunk's two blocks, 32 x F), lags (24 x F), bias, top, base."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters

    @classmethod
    def random(cls, seed: int) -> "Network":
        rng = np.random.default_rng(seed)
        shapes = {"embed": (256, EMBED), "near": (BLOCK * EMBED, FILTERS), "far": (BLOCK * EMBED, FILTERS), "lags": (LAGS, FILTERS)}
        scale = {"embed": 0.5, "near": 0.15, "far": 0.15, "lags": 0.5}
        p = {k: rng.normal(0, scale[k], s).astype(np.float32) for k, s in shapes.items()}
        return cls(p | {"bias": np.zeros(FILTERS, np.float32), "top": rng.normal(0, 0.3, FILTERS).astype(np.float32), "base": np.zeros(1, np.float32)})

    def responses(self, buffer: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        """Of each filter to the chunk that starts at each block."""
        p = self.p
        seen = p["embed"][buffer].reshape(-1, BLOCK * EMBED)
        own = seen @ p["near"] + repeated @ p["lags"] + p["bias"]
        own[:-1] += seen[1:] @ p["far"] + repeated[1:] @ p["lags"]
        return own

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        buffer, first, chunks = blocks_of(texts)
        own = self.responses(buffer, repeats(buffer))
        bounds = np.stack([first, first + chunks], 1).ravel()
        if bounds[-1] == len(own):
            bounds = bounds[:-1]
        return np.maximum.reduceat(own, bounds, axis=0)[::2]

    def logits(self, texts: list[bytes]) -> np.ndarray:
        return np.maximum(self.pooled(texts), 0) @ self.p["top"] + self.p["base"]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -500, 500)))


def spans(texts: list[bytes], most: int = SPAN) -> Iterator[list[bytes]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= most or len(part) >= 2048:
            yield part
            part, size = [], 0
    if part:
        yield part


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7, epochs: int = 8, batch: int = 32, rate: float = 0.01) -> Network:
    """Adam on the class-balanced logistic loss."""
    net, rng = Network.random(seed), np.random.default_rng(seed)
    share = float(labels.mean())
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    steps = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            chosen = order[i : i + batch]
            grads = gradients(net, [texts[k] for k in chosen], labels[chosen], weight[chosen])
            steps += 1
            for k, g in grads.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                pace = rate * (1 - epoch / epochs)
                net.p[k] -= pace * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-6)
    return net


def gradients(net: Network, texts: list[bytes], labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    p = net.p
    buffer, first, chunks = blocks_of(texts)
    repeated = repeats(buffer)
    own = net.responses(buffer, repeated)
    best = np.stack([a + own[a : a + n].argmax(0) for a, n in zip(first, chunks, strict=True)])
    top = own[best, np.arange(FILTERS)]
    active = np.maximum(top, 0)
    error = ((sigmoid(active @ p["top"] + p["base"]) - labels) * weight / len(texts)).astype(np.float32)
    back = error[:, None] * p["top"] * (top > 0)
    codes = buffer.reshape(-1, BLOCK)
    out = {"top": active.T @ error + 1e-3 * p["top"], "base": error.sum(keepdims=True), "bias": back.sum(0), "embed": np.zeros_like(p["embed"])}
    lags = repeated[best] + repeated[np.minimum(best + 1, len(repeated) - 1)]
    out["lags"] = np.einsum("df,dfl->lf", back, lags) + 1e-4 * p["lags"]
    for name, at in (("near", best), ("far", best + 1)):
        bytes_at = codes[at]
        seen = p["embed"][bytes_at].reshape(*at.shape, -1)
        out[name] = np.einsum("df,dfi->if", back, seen) + 1e-4 * p[name]
        np.add.at(out["embed"], bytes_at, (back[:, :, None] * p[name].T[None]).reshape(*at.shape, BLOCK, EMBED))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> list[tuple[bytes, int]]:
    """Up to about ``rows`` texts of each label, from rows that are not held out, chosen by a hash of the id; ids with both labels count as the lesser."""
    own = labels.where(F.col(label).isin(0, 1) & ~held_out("doc_id", 3, 1)).groupBy("doc_id").agg(F.min(label).alias("label"))
    counts = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    span = 1 << 20
    keep = F.lit(False)
    for value, n in counts.items():
        keep = keep | ((F.col("label") == value) & (F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(span)) < int(span * min(1.0, rows / n))))
    chosen = own.where(keep)
    # about as many as the parameter says, whatever the tables; sent to the texts once that is seen to be so
    if chosen.count() <= 4 * rows * max(1, len(counts)):
        chosen = F.broadcast(chosen)
    found = docs.select("doc_id", "text").where("text is not null").join(chosen, "doc_id").select("doc_id", "text", "label").collect()
    return [(r["text"].encode(), r["label"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["text"]))]


def score(docs: DataFrame, logits, threshold: float, carry: str | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; ``logits`` maps a list of texts to numbers on the executors.

    With ``carry``, all columns of ``docs`` and the score under that name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            made = np.concatenate([logits(part) for part in spans(texts)]) if texts else np.empty(0)
            out = batch if carry else batch.select(["doc_id", "held_out"])
            names = [*out.schema.names, carry or "score"]
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(sigmoid(made))], names)

    if carry:
        return docs.mapInArrow(run, StructType([*docs.schema, StructField(carry, DoubleType())]))
    narrow = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """Quality of every row of ``docs``, learned from ``labels`` (doc_id, quality) outside the held-out third; an id labelled both ways counts as 0."""
    sample = labelled_sample(docs, labels, "quality", rows)
    marks = np.array([m for _, m in sample], np.float64)
    if not len(marks) or marks.min() == marks.max():
        share = float(np.clip(marks.mean() if len(marks) else 0.5, 1e-6, 1 - 1e-6))
        flat = float(np.log(share / (1 - share)))
        return score(docs, lambda texts: np.full(len(texts), flat), threshold)
    parameters = fit([t for t, _ in sample], marks).p
    return score(docs, lambda texts: Network(parameters).logits(texts), threshold)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all whole documents."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
