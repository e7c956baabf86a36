"""Quality classifier: random-indexing word vectors, a two-layer network, calibrated probabilities.

Every word enters by two terms: the word itself and its form (the classes of its characters, runs
taken together, and whether it repeats the word before). A term has a sparse random index vector, and
its word vector is the sum of the index vectors met within two words of it in all documents. Terms
share a fixed number of hashed slots, so the vectors have a fixed size however large the vocabulary.
A document is the mean of its word vectors and the mean of its form vectors. A small network, fitted
on a bounded sample of labelled documents, and a temperature turn it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tillroll.llm.common import Batches, batch_of, labelled_sample, packed, small_batches

SLOTS = 1 << 13           # hashed terms of each kind
DIMS = 48
REACH = 2                 # neighbours on either side
NONZERO = 2               # entries +1 or -1 of an index vector
BATCH_BYTES = 1 << 20
SAMPLE = 12_000           # labelled documents a network is fitted on at most
HIDDEN = 24
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_POWERS = np.cumprod(np.full(256, _ODD, np.uint64))
SPACE, LOWER, UPPER, DIGIT, OTHER = range(5)  # other characters are classes of their own


def _classes() -> np.ndarray:
    """Class of each byte; bytes of longer characters count as small letters."""
    out = np.arange(256, dtype=np.uint8) + OTHER
    out[ord("a"):ord("z") + 1] = LOWER
    out[ord("A"):ord("Z") + 1] = UPPER
    out[ord("0"):ord("9") + 1] = DIGIT
    out[128:] = LOWER
    out[[9, 10, 11, 12, 13, 32]] = SPACE
    return out


_CLASS = _classes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (_mixed(hashes) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word slot, form slot, text number) of every word of the texts."""
    flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = _CLASS[flat]
    if len(flat) > 1:  # capitals of two bytes, as in "É"
        tail = np.flatnonzero((flat[:-1] == 0xC3) & (flat[1:] >= 0x80) & (flat[1:] <= 0x9E))
        kind[tail] = UPPER
        kind[tail + 1] = UPPER
    inside = kind != SPACE
    start = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none
    end = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
    number = np.repeat(np.arange(len(start)), end - start)
    at = np.flatnonzero(inside)
    place = at - start[number]
    first = np.searchsorted(at, start)
    word = np.add.reduceat((flat[at] + np.uint64(1)) * _POWERS[place & 255], first)
    # the form: one symbol for each run of a class
    held = kind[at]
    new = np.concatenate(([True], held[1:] != held[:-1]))
    new[first] = True
    order = np.cumsum(new) - 1
    step = np.minimum(order - order[first][number], 15)
    form = np.add.reduceat(np.where(new, (held + np.uint64(1)) * _POWERS[step + 32], np.uint64(0)), first)
    again = np.concatenate(([False], word[1:] == word[:-1]))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    owner = np.searchsorted(ends, start, side="right")
    again[1:] &= owner[1:] == owner[:-1]
    return _slot(word), _slot(form * _ODD + again.astype(np.uint64)), owner


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(positions, signs) of every slot's index vector."""
    spots = _mixed(np.arange(SLOTS * NONZERO, dtype=np.uint64) * _ODD + np.uint64(1)).reshape(SLOTS, NONZERO)
    return (spots % np.uint64(DIMS)).astype(np.int64), np.where(spots >> np.uint64(60) & np.uint64(1), 1, -1)


def _parts(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(texts):
        upto, total = at, 0
        while upto < len(texts) and (upto == at or total + len(texts[upto]) <= BATCH_BYTES):
            total += len(texts[upto])
            upto += 1
        yield at, texts[at:upto]
        at = upto


def _context_rows(batches: Batches) -> Iterator[pa.RecordBatch]:
    """A task's sums of neighbours' index vectors: one row for each kind and slot met."""
    spots, signs = _index_vectors()
    sums = np.zeros((2, SLOTS * DIMS), np.int64)
    for batch in batches:
        for _, texts in _parts([t or b"" for t in batch.column("text").to_pylist()]):
            word, form, owner = terms(texts)
            for kind, slots in enumerate((word, form)):
                for reach in range(1, REACH + 1):
                    near = np.flatnonzero(owner[reach:] == owner[:-reach])
                    for here, there in ((slots[near], slots[near + reach]), (slots[near + reach], slots[near])):
                        for n in range(NONZERO):
                            sums[kind] += np.bincount(here * DIMS + spots[there, n], signs[there, n],
                                                      SLOTS * DIMS).astype(np.int64)
    found = sums.reshape(2, SLOTS, DIMS)
    kind, slot = np.nonzero(found.any(axis=2))
    schema = pa.schema([("kind", pa.int32()), ("slot", pa.int32()), ("sums", pa.list_(pa.int64()))])
    yield batch_of(schema, kind.astype(np.int32), slot.astype(np.int32),
                   pa.array(list(found[kind, slot]), pa.list_(pa.int64())))


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit vectors (2 kinds x SLOTS x DIMS) from all documents; a fixed size, whatever the input."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(
        _context_rows, "kind int, slot int, sums array<bigint>")
    summed = rows.groupBy("kind", "slot").agg(F.array(*[
        F.sum(F.col("sums")[d]) for d in range(DIMS)]).alias("sums")).collect()  # 2 * SLOTS rows at most
    out = np.zeros((2, SLOTS, DIMS))
    for r in summed:
        out[r["kind"], r["slot"]] = r["sums"]
    return (out / np.maximum(np.linalg.norm(out, axis=2, keepdims=True), 1e-12)).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Document vectors: mean word vector, mean form vector, and whether there is any word."""
    out = np.zeros((len(texts), 2 * DIMS + 1), np.float32)
    for at, part in _parts(texts):
        word, form, owner = terms(part)
        if not len(owner):
            continue
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        count = np.diff(np.append(first, len(owner)))[:, None]
        rows = at + owner[first]
        out[rows, :DIMS] = np.add.reduceat(vectors[0][word], first, axis=0) / count
        out[rows, DIMS:-1] = np.add.reduceat(vectors[1][form], first, axis=0) / count
        out[rows, -1] = 1
    return out


# --- the network ---------------------------------------------------------------------------

@dataclass
class Network:
    """Two layers over standardised document vectors, and the temperature of the output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _temperature(logits: np.ndarray, labels: np.ndarray, share: np.ndarray) -> float:
    """The temperature under which held-back labels are likeliest."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        z = logits / t
        return float(np.mean(share * (np.logaddexp(0, z) - labels * z)))

    return min((2.0 ** (k / 8) for k in range(-16, 33)), key=loss)


def fit_network(x: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None, seed: int = 11,
                epochs: int = 60) -> Network:
    """Adam on the weighted log loss of four fifths of the rows; the rest sets the temperature."""
    rng = np.random.default_rng(seed)
    share = np.ones(len(labels)) if weights is None else weights / max(1e-12, weights.mean())
    if not len(labels) or labels.min() == labels.max():
        only = float(labels[0]) if len(labels) else 0.5
        zero = np.zeros((2 * DIMS + 1, HIDDEN))
        return Network(np.zeros(2 * DIMS + 1), np.ones(2 * DIMS + 1), zero, np.zeros(HIDDEN), np.zeros(HIDDEN),
                       4.0 * (2 * only - 1))
    order = rng.permutation(len(labels))
    back, fit = np.split(order, [len(order) // 5])
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    z = (x - mean) / scale
    w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN),
         rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for batch in np.array_split(fit, max(1, len(fit) // 64)):
            hidden = np.tanh(z[batch] @ w[0] + w[1])
            out = 1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3], -40, 40)))
            error = share[batch] * (out - labels[batch]) / len(batch)
            inner = np.outer(error, w[2]) * (1 - hidden ** 2)
            slopes = [z[batch].T @ inner + 1e-4 * w[0], inner.sum(axis=0),
                      hidden.T @ error + 1e-4 * w[2], np.array([error.sum()])]
            step += 1
            for p, g, m, v in zip(w, slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.003 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    net = Network(mean, scale, w[0], w[1], w[2], float(w[3][0]))
    net.temperature = _temperature(net.logits(x[back]), labels[back], share[back])
    return net


@dataclass
class Model:
    vectors: np.ndarray
    network: Network


def _pooled_rows(shared):
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pooled([t or b"" for t in batch.column("text").to_pylist()], shared.value)
            schema = pa.schema([("label", pa.int32()), ("vector", pa.list_(pa.float32()))])
            yield batch_of(schema, batch.column("label"), pa.array(list(found), pa.list_(pa.float32())))

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Word vectors from all documents, a network from at most ``sample`` labelled ones of each label.

    The sample takes the ids with the smallest hashes, and of their texts each distinct one once. A text
    counts for as many as its label stands for among all labelled ids, in the network and in the
    temperature, so probabilities do not shift with the size of the table. An id with two labels has
    the greater one; rows without id or label are passed over. With one label only, every text gets a
    probability near it; without labels, one half.
    """
    spark = docs.sparkSession
    vectors = word_vectors(docs, text_col)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna() \
        .where("label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    texts = labelled_sample(docs, known, {1: sample // 2, 0: sample // 2}, id_col, text_col).select(
        F.col("text").cast("binary").alias("text"), "label")
    rows = texts.mapInArrow(_pooled_rows(spark.sparkContext.broadcast(vectors)), "label int, vector array<float>") \
        .collect()  # small vectors of the sample
    x = np.array([r["vector"] for r in rows], np.float64).reshape(-1, 2 * DIMS + 1)
    y = np.array([r["label"] for r in rows], np.float64)
    order = np.lexsort((*x.T[:4], y))  # one order, however the rows arrived
    drawn = np.bincount(y.astype(int), minlength=2)
    each = np.array([counts.get(k, 0) / max(1, drawn[k]) for k in (0, 1)])
    return Model(vectors, fit_network(x[order], y[order], each[y[order].astype(int)]))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, score) of every row; row holds the other columns. Null and empty texts have a score too."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.vectors, model.network))  # fixed size

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for batch in batches:
            found = pooled([t or b"" for t in batch.column("text").to_pylist()], vectors)
            schema = pa.schema([("row", batch.column("row").type), ("score", pa.float64())])
            yield batch_of(schema, batch.column("row"), network.probabilities(found.astype(np.float64)))

    whole = packed(docs).select(
        F.struct(*[F.col("row")[c].alias(c) for c in docs.columns if c != text_col]).alias("row"),
        F.col("row")[text_col].cast("binary").alias("text"))
    return whole.mapInArrow(run, T.StructType([whole.schema["row"], T.StructField("score", T.DoubleType())]))
