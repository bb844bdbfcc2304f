"""Document quality by a factorisation machine.

A document's features are its hashed words (logarithm of the count, scaled to length one), statistics of
its structure and its length as metadata, the last two as one-of-n bins. The score is
sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), the pair term in linear time as
half the sum over factors of (sum v_if x_i)^2 - sum (v_if x_i)^2.

Rows: a null text is the empty text, which has the bins of no length and is scored like any other;
repeated rows are each scored; an empty table gives no rows; without labels of both kinds every score
is the prior. Only doc_id, text and the labels are read; lang, source and labels enter no score.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factorloom.llm import common, words

#: Labelled documents that the machine is fitted to, about.
SAMPLE_DOCS = 8_000
WORD_BITS = 15
BINS = 16
FACTORS = 8
EPOCHS = 8
#: A document is good from this score on.
THRESHOLD = 0.5

SCORE = "doc_id long, held_out boolean, score double, predicted int"

_CLASSES = 7


def _byte_classes() -> np.ndarray:
    """A row for each class of bytes, true for its members."""
    b = np.arange(256)
    letter = ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)
    digit = (b >= 48) & (b <= 57)
    space = b == 32
    line = b == 10
    point = np.isin(b, np.frombuffer(b".,;:!?'\"()-", np.uint8))
    upper = (b >= 65) & (b <= 90)
    return np.stack([letter, digit, space, line, point, upper, ~(letter | digit | space | line | point)])


_TABLE = _byte_classes()


def structure(texts: pa.Array, coded: words.Ragged) -> np.ndarray:
    """A bin (0 to BINS - 1) for each statistic of each text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    full = size > 0
    starts = (offsets - offsets[0])[:-1][full]
    counts = np.zeros((_CLASSES, len(texts)))
    for k, members in enumerate(_TABLE if full.any() else ()):
        counts[k, full] = np.add.reduceat(members[raw], starts, dtype=np.int64)
    n = np.maximum(1, coded.lengths())
    row, _, times = words.counted(coded)
    distinct = np.bincount(row, minlength=len(texts))
    most = np.zeros(len(texts))
    np.maximum.at(most, row, times)
    same = coded.values[1:] == coded.values[:-1]
    inside = coded.row_of()
    again = np.bincount(inside[1:][same & (inside[1:] == inside[:-1])], minlength=len(texts))
    per = np.maximum(1, size)
    lines = counts[3] + 1
    parts = [
        np.log2(1 + size) / 20,
        *(counts[:_CLASSES] / per),
        distinct / n * np.minimum(1, np.log2(1 + n) / 10),
        most / n,
        again / n,
        size / n / 20,
        np.log2(1 + n / lines) / 12,
        np.log2(1 + counts[6]) / 12,
        counts[4] / n,
        counts[6] / n,
    ]
    values = np.clip(np.stack(parts, axis=1), 0, 1)
    values[:, 1:] = np.where(full[:, None], values[:, 1:], 0)
    return np.minimum(BINS - 1, (np.sqrt(values) * BINS).astype(np.int64))


STATISTICS = 16
FEATURES = (1 << WORD_BITS) + STATISTICS * BINS


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, feature numbers and values of the texts; rows ascend."""
    stream = words.hashed_words(texts)
    bins = structure(texts, stream)
    bucketed = words.Ragged(stream.values >> np.uint64(64 - WORD_BITS), stream.offsets)
    row, bucket, times = words.counted(bucketed)
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(row, value**2, minlength=len(texts)))
    value = value / norm[row]
    n, k = bins.shape
    own = (1 << WORD_BITS) + np.arange(k) * BINS + bins
    rows = np.concatenate([row, np.repeat(np.arange(n), k)])
    order = np.argsort(rows, kind="stable")
    return rows[order], np.concatenate([bucket.astype(np.int64), own.ravel()])[order], np.concatenate([value, np.full(n * k, 0.5)])[order].astype(np.float32)


@dataclass(frozen=True)
class Machine:
    """Weights of a factorisation machine."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, n: int, row: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Log-odds of n rows, in time linear in the number of features."""
        out = self.bias + np.bincount(row, self.linear[index] * value, minlength=n)
        for f in range(self.factors.shape[1]):
            each = self.factors[index, f] * value
            total = np.bincount(row, each, minlength=n)
            out += 0.5 * (total**2 - np.bincount(row, each**2, minlength=n))
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(len(texts), *features(texts)), -35, 35)))


def fit(label: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], n_features: int = FEATURES, factors: int = FACTORS, epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Fit by AdaGrad on the logistic loss, in mini-batches."""
    rng = np.random.default_rng(seed)
    p = (label.sum() + 1) / (len(label) + 2)
    bias, linear = float(np.log(p / (1 - p))), np.zeros(n_features, np.float32)
    if len(np.unique(label)) < 2:
        return Machine(bias, linear, np.zeros((n_features, factors), np.float32))
    v = rng.normal(0, 0.05, (n_features, factors)).astype(np.float32)
    g0, gw, gv = 1.0, np.full(n_features, 1e-1, np.float32), np.full((n_features, factors), 1e-1, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            own = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            index = np.concatenate([rows[i][0] for i in batch])
            value = np.concatenate([rows[i][1] for i in batch])
            each = v[index] * value[:, None]
            total = np.zeros((len(batch), factors), np.float32)
            np.add.at(total, own, each)
            square = np.bincount(own, (each**2).sum(axis=1), minlength=len(batch))
            raw = bias + np.bincount(own, linear[index] * value, minlength=len(batch)) + 0.5 * ((total**2).sum(axis=1) - square)
            miss = (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - label[batch]).astype(np.float32) / len(batch)
            g0 += miss.sum() ** 2
            bias -= rate * miss.sum() / np.sqrt(g0)
            used, at_used = np.unique(index, return_inverse=True)
            step = np.bincount(at_used, miss[own] * value, minlength=len(used)).astype(np.float32) + decay * linear[used]
            gw[used] += step**2
            linear[used] -= rate * step / np.sqrt(gw[used])
            pull = (miss[own] * value)[:, None] * (total[own] - each)
            move = np.stack([np.bincount(at_used, pull[:, f], minlength=len(used)) for f in range(factors)], axis=1).astype(np.float32) + decay * v[used]
            gv[used] += move**2
            v[used] -= rate * move / np.sqrt(gv[used])
    return Machine(bias, linear, v)


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", bound: int = SAMPLE_DOCS) -> Machine:
    """Fit to about `bound` labelled documents that are not held out; executors send their features."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
            row, index, value = features(common.as_text(part.column("text")))
            ends = np.searchsorted(row, np.arange(part.num_rows + 1))
            pieces = [(index[a:b].astype("<i4").tobytes(), value[a:b].astype("<f4").tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            return pa.record_batch([part.column("label"), pa.array([x for x, _ in pieces], pa.binary()), pa.array([x for _, x in pieces], pa.binary())], ["label", "at", "value"])

        return kernel

    got = common.map_text(common.labelled_sample(docs, labels, column, bound), "text", make, "label int, at binary, value binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["at"], r["value"], r["label"]))  # the order of rows doesn't matter to the fit
    return fit(np.array([r["label"] for r in got], float), [(np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f4")) for r in got])


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """Score and decision for every document."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
            s = held.value.score(common.as_text(part.column("text")))
            return pa.record_batch([part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return kernel

    return common.scored(docs, make, SCORE)


def keep_good(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The documents of at least the threshold, in all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(machine)
    return common.kept(docs, lambda: lambda texts: pa.array(held.value.score(texts) >= threshold))
