"""Quality classifier: a support vector machine over Naive Bayes features.

Features are indicators of n-grams: of bytes (2 and 4), of word shapes (first and last
character class, 2 words) and of repetition marks (is a word the same as one of the three
before it, 4 words), hashed into one space. Each indicator is scaled by its log-count ratio between
the classes, rows are brought to length 1, and a linear hinge-loss model is fitted by dual
coordinate descent. A logistic curve over the margins of rows left out of the fit gives the
score.

Fitting uses at most FIT_ROWS labelled rows, taken in the order of a hash of their id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import fresh, over_batches, quoted
from .words import NOT_SPACE, Words, chunks, mix

FIT_ROWS = 4000  # most labelled rows that a model is fitted on
SPACE = 1 << 17  # hashed features
EPOCHS = 8
COST = 1.0
SEED = 7

# Classes of a character: lower, upper, digit, beyond ASCII, sentence mark, other mark.
_KIND = np.full(256, 5, np.uint64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 3
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 4

_STREAMS = np.array(
    [0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8BB84B93962EACC9, 0x2D358DCCAA6C78A5], np.uint64
)


def _slots(values: np.ndarray, stream: int) -> np.ndarray:
    return (mix(values + _STREAMS[stream]) & np.uint64(SPACE - 1)).astype(np.int32)


def _short(values: np.ndarray, stream: int) -> np.ndarray:
    """The same for numbers of 32 bits, of which there are many: the top of one product."""
    mixed = (values + np.uint32(stream)) * np.uint32(0x9E3779B1)
    return (mixed >> np.uint32(33 - SPACE.bit_length())).astype(np.int32)


def features(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The sorted different feature numbers of each row of a chunk."""
    b = data.astype(np.uint32)
    pair = b[:-1] | (b[1:] << np.uint32(8))
    two = _short(pair, 0)
    four = _short(pair[: max(len(pair) - 2, 0)] | (pair[2:] << np.uint32(16)), 1)
    words = Words(data, bounds, NOT_SPACE)
    shape = _KIND[data[words.starts]] * np.uint64(8) + _KIND[data[words.ends - 1]]
    shapes = _slots(shape[:-1] * np.uint64(64) + shape[1:], 2)
    hashes = words.hashes()
    again = np.zeros(len(hashes), np.uint64)
    for k in (1, 2, 3):
        again[k:] |= (hashes[k:] == hashes[:-k]).astype(np.uint64)
    marks = np.zeros(max(len(again) - 3, 0), np.uint64)
    for k in range(4):
        marks |= again[k : k + len(marks)] << np.uint64(k)
    marks = _slots(marks, 3)
    flag = np.zeros(SPACE, bool)
    found = []
    for r in range(len(bounds) - 1):
        low, high = int(bounds[r]), int(bounds[r + 1])
        first, last = int(words.rows[r]), int(words.rows[r + 1])
        parts = (
            two[low : max(high - 1, low)], four[low : max(high - 3, low)],
            shapes[first : max(last - 1, first)], marks[first : max(last - 3, first)],
        )
        for p in parts:
            flag[p] = True
        found.append(np.flatnonzero(flag).astype(np.int32))
        flag[found[-1]] = False
    return found


@dataclass
class Model:
    ratio: np.ndarray  # log-count ratio of each feature
    weight: np.ndarray  # of the scaled features
    bias: float
    slope: float  # score = 1 / (1 + exp(-(slope * margin + shift)))
    shift: float

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        scaled = self.weight * self.ratio
        square = self.ratio * self.ratio
        return np.array(
            [scaled[r].sum() / max(np.sqrt(square[r].sum()), 1e-9) + self.bias for r in rows]
        )

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(rows) + self.shift, -30, 30)))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = np.ones((2, SPACE))
    for r, label in zip(rows, y, strict=True):
        counts[int(label > 0), r] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(
    rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int
) -> tuple[np.ndarray, float]:
    """min |w|^2 / 2 + sum cost_i max(0, 1 - y_i w.x_i) over rows of length 1 and a constant 1."""
    weight, bias = np.zeros(SPACE), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([v @ v for v in values]) + 1.0
    rng = np.random.default_rng(SEED)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            gradient = y[i] * (weight[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                weight[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return weight, bias


def _logistic(margin: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve over margins, by damped Newton steps."""
    x = np.stack([margin, np.ones_like(margin)], 1)
    at = np.array([4.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        at = at - np.clip(np.linalg.solve(hessian, x.T @ (p - target) + 1e-2 * (at - [4.0, 0.0])), -2, 2)
    return max(float(at[0]), 1e-3), float(at[1])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """A model of rows of features; with one class or none, a constant score."""
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        zero = np.zeros(SPACE)
        return Model(zero, zero, 0.0, 1.0, float(np.log(share / (1 - share))))
    ratio = log_count_ratio(rows, y)
    values = []
    for r in rows:
        own = ratio[r]
        values.append(own / max(float(np.sqrt(own @ own)), 1e-9))
    share = max((y > 0).mean(), 1e-3)
    cost = COST * np.where(y > 0, 0.5 / share, 0.5 / max(1 - share, 1e-3))
    held = np.arange(len(rows)) % 5 == 4
    inside = np.flatnonzero(~held)
    if len(set(y[inside].tolist())) == 2 and held.any():
        weight, bias = dual_coordinate_descent(
            [rows[i] for i in inside], [values[i] for i in inside], y[inside], cost[inside], EPOCHS
        )
        trial = Model(ratio, weight, bias, 1.0, 0.0)
        slope, shift = _logistic(trial.margins([rows[i] for i in np.flatnonzero(held)]), (y[held] > 0) * 1.0)
    else:
        slope, shift = 4.0, 0.0
    weight, bias = dual_coordinate_descent(rows, values, y, cost, EPOCHS)
    return Model(ratio, weight, bias, slope, shift)


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """``text, label, place`` of at most ``rows`` labelled documents, in a fixed mixed order.

    Rows without id or label are left out; a doc_id with several labels counts by the largest.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    chosen = chosen.groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = chosen.withColumn("place", F.xxhash64(F.lit(SEED), "doc_id")).orderBy("place", "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label", "place")


def _featured(docs: DataFrame, keep: list[str]) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> dict:
            found = []
            for _, _, data, bounds in chunks(batch.column(0)):
                found += [f.tobytes() for f in features(data, bounds)]
            return {"features": pa.array(found, pa.binary())}

        return work

    return over_batches(docs.select("text", *keep), make, "features binary", keep)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> Model:
    """Fit on the given labelled rows, at most ``rows`` of them; repeated documents count once."""
    chosen = _featured(labelled(docs, labels, label, rows), ["label", "place"])
    found = sorted({(r.place, r.label, bytes(r.features)) for r in chosen.collect()})
    return fit([np.frombuffer(f, np.int32) for _, _, f in found], np.array([y for _, y, _ in found]))


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with its score in a new last column (``column``, or column_1 where that exists).

    Null and empty texts get the score of a row without features. All other columns, whatever
    their names, and repeated rows are kept as they are.
    """
    name, copy = fresh(docs, column), fresh(docs, "_text")

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            found = []
            for _, _, data, bounds in chunks(batch.column(batch.schema.get_field_index(copy))):
                found.append(model.scores(features(data, bounds)))
            return {name: pa.array(np.concatenate(found) if found else np.zeros(0))}

        return work

    with_copy = docs.withColumn(copy, F.col(quoted(text)))
    return over_batches(with_copy, make, f"{quoted(name)} double", docs.columns)
