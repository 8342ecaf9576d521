"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages.  Each passage is encoded (character classes,
word lengths, repetition, a hashed bag of words, then a learned tanh layer);
gated attention, learned from document labels only, weighs the passages, and a
logistic layer scores the weighted sum.

The model is fitted on the driver to at most `sample` labelled documents (those
of least hash of the id), each whole: while all have `sample` * `passages`
passages at most, so that long texts make the rows fewer, never shorter;
scoring reads every passage of every document.  Inputs of a score are the text
alone.

Defined results: a null or empty text is one empty passage and gets a score;
null or conflicting labels: null labels are ignored, of several labels of a
document the largest counts, and of several texts of one id the least is learned from;
without labels every score is 0.5; with one class the score is that class's smoothed
share.  Repeated rows score alike; a null key is carried; very long texts are read whole;
an empty table gives one; the input row is kept as a struct, so that no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm import anchors as A
from pagemill.llm.simhash import small_batches
from pagemill.runtime import ship_package, written

PASSAGE_WORDS = 96
BUCKETS = 48
CODE = A.mix(np.arange(1, 257, dtype=np.uint64))


def _byte_classes() -> np.ndarray:
    """Class of each byte: other 0, lower, upper, digit, blank, line end, stop, comma, bar, cry, symbol, UTF-8 lead, UTF-8 tail."""
    table = np.zeros(256, np.int64)
    for number, members in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t", b"\r\n", b".", b",;:", b"|", b"!?", b"#*$%&<>", range(192, 256), range(128, 192)), 1):
        table[list(members)] = number
    return table


CLASS = _byte_classes()
CLASSES = 13
WIDTH = CLASSES + 8 + BUCKETS


def passage_features(text: str | None) -> np.ndarray:
    """(passages, WIDTH) float32."""
    data = (text or "").encode("utf-8")
    starts, ends = A.word_spans(data)
    words = len(starts)
    if not words:
        return np.zeros((1, WIDTH), np.float32)
    raw = np.frombuffer(data, np.uint8)
    first = np.arange(0, words, PASSAGE_WORDS)
    count = len(first)
    size = np.diff(np.append(first, words)).astype(np.float64)
    owner = np.arange(words) // PASSAGE_WORDS
    at = np.zeros(len(raw), np.int64)
    at[starts[first[1:]]] = 1
    classes = np.bincount(np.cumsum(at) * CLASSES + CLASS[raw], minlength=count * CLASSES).reshape(count, CLASSES)
    length = (ends - starts).astype(np.float64)
    mean = np.add.reduceat(length, first) / size
    spread = np.sqrt(np.maximum(np.add.reduceat(length**2, first) / size - mean**2, 0))
    hashes = A.span_hash(A.prefix_hash(CODE[raw]), starts, ends)
    with np.errstate(over="ignore"):
        local = np.unique((hashes & ~np.uint64(0xFFFFF)) ^ A.mix(owner.astype(np.uint64)), return_index=True)[1]
    distinct = np.bincount(owner[local], minlength=count)
    same = np.zeros(words)
    same[1:] = hashes[1:] == hashes[:-1]
    tail = CLASS[raw[ends - 1]]
    odd = np.isin(tail, (8, 9, 10)).astype(np.float64)
    bag = np.bincount(owner * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=count * BUCKETS).reshape(count, BUCKETS)
    total = np.maximum(classes.sum(axis=1, keepdims=True), 1)
    return np.concatenate(
        [
            classes / total,
            np.stack([mean / 10, spread / 10, np.maximum.reduceat(length, first) / 50, distinct / size, np.add.reduceat(same, first) / size, np.add.reduceat(odd, first) / size, np.log1p(size) / 5, classes[:, 5] / size], axis=1),
            np.sqrt(bag / size[:, None]),
        ],
        axis=1,
    ).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        x = np.clip((passage_features(text) - self.mean) / self.scale, -5, 5)
        return float(_forward(self.weights, x, np.array([0]))[0][0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray):
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    a = (t * g) @ w["w"]
    bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    e = np.exp(a - np.maximum.reduceat(a, first)[bag])
    share = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(share[:, None] * h, first)
    return _sigmoid(z @ w["c"] + w["d"]), h, t, g, share, z, bag


def gradients(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted log loss of bags (x, first passages) with labels y, and 1e-4 / 2 times the squares of W and c."""
    p, h, t, g, share, z, bag = _forward(w, x, first)
    err = (p - y) * weight
    dz = err[:, None] * w["c"]
    dh = share[:, None] * dz[bag]
    ds = (h * dz[bag]).sum(axis=1)
    da = share * (ds - np.add.reduceat(share * ds, first)[bag])
    dt, dg = da[:, None] * w["w"] * g * (1 - t**2), da[:, None] * w["w"] * t * g * (1 - g)
    dh += dt @ w["V"].T + dg @ w["U"].T
    du = dh * (1 - h**2)
    return {"W": x.T @ du + 1e-4 * w["W"], "b": du.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ da, "c": z.T @ err + 1e-4 * w["c"], "d": err.sum()}


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, attention: int = 12, epochs: int = 30, seed: int = 11) -> Model:
    """Adam on the class-balanced log loss of document labels."""
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(np.zeros(WIDTH), np.ones(WIDTH), {}, 0.5 if len(labels) == 0 else float((labels.sum() + 1) / (len(labels) + 2)))
    everything = np.concatenate(bags)
    mean, scale = everything.mean(axis=0), np.maximum(everything.std(axis=0), 1e-3)
    bags = [np.clip((x - mean) / scale, -5, 5).astype(np.float64) for x in bags]
    r = np.random.default_rng(seed)
    w = {"W": r.normal(0, WIDTH**-0.5, (WIDTH, hidden)), "b": np.zeros(hidden), "V": r.normal(0, hidden**-0.5, (hidden, attention)), "U": r.normal(0, hidden**-0.5, (hidden, attention)), "w": r.normal(0, attention**-0.5, attention), "c": r.normal(0, hidden**-0.5, hidden), "d": np.zeros(())}
    first_moment, second_moment = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    weight = np.where(labels == 1, len(labels) / (2 * labels.sum()), len(labels) / (2 * (len(labels) - labels.sum())))
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(bags))
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            x = np.concatenate([bags[i] for i in some])
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in some])[:-1]])
            grads = gradients(w, x, first, labels[some], weight[some] / len(some))
            step += 1
            rate = 0.005 * min(1.0, 2 * (1 - epoch / epochs))
            for k, v in grads.items():
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * v
                second_moment[k] = 0.999 * second_moment[k] + 0.001 * v**2
                w[k] = w[k] - rate * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second_moment[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, passages: int = 64, text: str = "text", key: str = "doc_id", label: str = "quality") -> Model:
    """Fit to a bounded sample of the labelled documents that aren't held out: whole ones, of sample * passages passages in all."""
    ship_package(docs.sparkSession)
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
    chosen = usable.groupBy(F.col(key).cast("long").alias("k")).agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("k"), "k").limit(sample)
    # at most `sample` rows: the parameter bounds what is broadcast and collected
    copies = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).join(F.broadcast(chosen), "k")
    # one text an id, the least, however many rows have it
    texts = copies.groupBy("k", "y").agg(F.min("t").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [passage_features(x) for x in batch.column(2).to_pylist()]
            counts, rows = pa.array([len(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts, rows], ["k", "y", "n", "f"])

    bags = written(texts.mapInArrow(run, "k long, y int, n long, f binary"), "bags")
    sizes = bags.select("k", "n").orderBy(F.xxhash64("k"), "k").collect()
    total = np.cumsum([r["n"] for r in sizes])
    used = [r["k"] for r, t in zip(sizes, total.tolist()) if t <= max(sample * passages, sizes[0]["n"])] if sizes else []
    rows = {r["k"]: (r["y"], r["f"]) for r in bags.where(F.col("k").isin(used)).select("k", "y", "f").collect()}
    ordered = [rows[k] for k in sorted(rows)]
    bags = [np.frombuffer(bytes(f), np.float32).reshape(-1, WIDTH) for _, f in ordered]
    return fit(bags, np.array([y for y, _ in ordered], np.float64))


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(row, score): row is the whole input row as a struct, so that no column name can clash."""
    ship_package(df.sparkSession)
    chosen = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    where = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column(0).field(where).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(x) for x in texts], pa.float64())], ["row", "score"])

    return chosen.mapInArrow(run, T.StructType([*chosen.schema.fields, T.StructField("score", T.DoubleType())]))
