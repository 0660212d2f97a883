"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

The input of a word is the sum of hashed embeddings of the whole word and of its characters (its
first three to eight bytes and its last four). Two gated recurrent units read a window of
words from both sides, attention pools their states, and a linear layer gives the window's
logit. All overlapping windows of a text are scored; a logistic curve over their maximum,
the mean of the highest ones and the number of windows gives the text's score.

Fitting takes at most FIT_ROWS labelled rows of each class, in the order of a hash of their
id. As labels belong to texts, each pass trains on the window of each text that scores
highest, and on one more window of the texts that are not toxic.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import fresh, over_batches, quoted
from .words import ALNUM, LOWER, Words, chunks, mix

FIT_ROWS = 1500  # most labelled rows of each class that a model is fitted on
SLOTS = 1 << 16  # hashed embeddings
WIDTH = 12  # of an embedding
STATE = 8  # of a recurrent unit
SPAN, STEP = 24, 16  # words of a window, and from one to the next
EPOCHS = 6
BATCH = 256
HIGHEST = 3
SEED = 11

_SALT = np.array([0x9E3779B97F4A7C15 * (k + 1) % 2**64 for k in range(8)], np.uint64)


def _lower(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 (in UTF-8) in lower case."""
    out = LOWER[data]
    capital = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E)
    out[1:][capital] += 32
    return out


@dataclass
class Texts:
    """Words of a chunk: ``features`` of its different words (8 slots each), ``word`` (which of
    them stands where), and the words of row i are ``rows[i]`` to ``rows[i + 1] - 1``."""

    features: np.ndarray
    word: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, bounds: np.ndarray) -> Texts:
        low = _lower(data)
        words = Words(low, bounds, ALNUM)
        hashes, first, word = np.unique(words.hashes(), return_index=True, return_inverse=True)
        start, end = words.starts[first], words.ends[first]
        padded = np.concatenate([low, np.zeros(8, np.uint8)])
        eights = np.ndarray((len(low) + 1,), "<u8", padded, strides=(1,))
        head, length = eights[start], end - start
        parts = [hashes]
        for size in range(3, 9):
            bits = np.minimum(length, size).astype(np.uint64) * np.uint64(8)
            kept = head & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.maximum(bits, np.uint64(8))))
            parts.append(kept + np.uint64(size) * (length >= size))
        parts.append(eights[np.maximum(end - 4, start)] & np.uint64(0xFFFFFFFF))
        slots = [mix(p + _SALT[k]) & np.uint64(SLOTS - 1) for k, p in enumerate(parts)]
        return cls(np.stack(slots, 1).astype(np.int32), word.astype(np.int64), words.rows)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The different words in all windows (their number behind a short text), and the rows."""
        count = np.diff(self.rows)
        number = np.where(count > 0, np.maximum(-(-(count - SPAN) // STEP), 0) + 1, 0)
        row = np.repeat(np.arange(len(count)), number)
        place = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
        start = np.minimum(place * STEP, np.maximum(count[row] - SPAN, 0))
        at = start[:, None] + np.arange(SPAN)
        inside = at < count[row][:, None]
        at = np.where(inside, at + self.rows[row][:, None], 0)
        words = self.word[at] if len(self.word) else at
        return np.where(inside, words, len(self.features)), row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


@dataclass
class Net:
    """Weights, all float32; the two directions are the first axis of w, u and b."""

    embedding: np.ndarray
    w: np.ndarray
    u: np.ndarray
    b: np.ndarray
    attend: np.ndarray
    query: np.ndarray
    out: np.ndarray
    curve: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0, 0.0]))

    @classmethod
    def new(cls, rng: np.random.Generator) -> Net:
        def some(*shape, scale=0.3):
            return rng.normal(0, scale, shape).astype(np.float32)

        bias = np.zeros((2, 3 * STATE), np.float32)
        return cls(
            some(SLOTS, WIDTH, scale=0.02), some(2, WIDTH, 3 * STATE), some(2, STATE, 3 * STATE),
            bias, some(2 * STATE, STATE), some(STATE), some(2 * STATE + 1),
        )

    def vectors(self, features: np.ndarray) -> np.ndarray:
        total = self.embedding[features[:, 0]].copy()
        for k in range(1, features.shape[1]):
            total += self.embedding[features[:, k]]
        return total

    def padded(self, features: np.ndarray) -> np.ndarray:
        return np.concatenate([self.vectors(features), np.zeros((1, WIDTH), np.float32)])

    def forward(self, vectors: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logits of windows whose words are rows of ``vectors`` (the last one is padding).

        Windows run along the last axis of all arrays, so that every gate is one stretch of
        memory.
        """
        places = np.ascontiguousarray(at.T)
        real = (places < len(vectors) - 1).astype(np.float32)
        whole = bool(real.all())
        states = np.empty((SPAN, 2 * STATE, len(at)), np.float32)
        memory: list[list] = [[], []]
        words = vectors[places]
        for d in (0, 1):
            h = np.zeros((STATE, len(at)), np.float32)
            bring, bias = np.ascontiguousarray(self.w[d].T), self.b[d][:, None]
            turn = np.ascontiguousarray(self.u[d].T)
            for t in range(SPAN) if d == 0 else range(SPAN - 1, -1, -1):
                x = bring @ words[t].T + bias
                g = turn @ h
                gates = _sigmoid(x[: 2 * STATE] + g[: 2 * STATE])
                z, r = gates[:STATE], gates[STATE:]
                inner = g[2 * STATE :]
                n = np.tanh(x[2 * STATE :] + r * inner)
                new = n + z * (h - n)
                if not whole:
                    new = h + real[t] * (new - h)
                if keep:
                    memory[d].append((t, h, z, r, n, inner))
                h = new
                states[t, d * STATE : (d + 1) * STATE] = h
        hidden = np.tanh(self.attend.T @ states)
        score = self.query @ hidden
        if not whole:
            score = np.where(real > 0, score, np.float32(-1e9))
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, None] * states).sum(axis=0)
        logit = self.out[:-1] @ pooled + self.out[-1]
        return (logit, (real, states, memory, hidden, weight, pooled)) if keep else logit

    def logits(self, features: np.ndarray, at: np.ndarray, size: int = 1024) -> np.ndarray:
        vectors = self.padded(features)
        parts = [self.forward(vectors, at[k : k + size]) for k in range(0, len(at), size)]
        return np.concatenate([np.zeros(0, np.float32), *parts])

    def scores(self, texts: Texts) -> np.ndarray:
        at, row = texts.windows()
        found = evidence(self.logits(texts.features, at), row, len(texts.rows) - 1)
        return 1 / (1 + np.exp(-np.clip(found @ self.curve, -30, 30)))

    def gradients(self, features: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Gradients of the weighted log loss over windows, by propagation through time."""
        vectors = self.padded(features)
        logit, (real, states, memory, hidden, alpha, pooled) = self.forward(vectors, at, keep=True)
        d_logit = ((_sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
        d_out = np.append(pooled @ d_logit, d_logit.sum())
        d_pooled = self.out[:-1, None] * d_logit
        d_alpha = (d_pooled * states).sum(axis=1)
        d_score = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        d_query = (hidden * d_score[:, None]).sum(axis=(0, 2))
        d_hidden = d_score[:, None] * self.query[:, None] * (1 - hidden * hidden)
        d_attend = (states @ d_hidden.transpose(0, 2, 1)).sum(axis=0)
        d_states = alpha[:, None] * d_pooled + self.attend @ d_hidden
        d_w, d_u, d_b = np.zeros_like(self.w), np.zeros_like(self.u), np.zeros_like(self.b)
        d_vectors = np.zeros_like(vectors)
        for d in (0, 1):
            d_h = np.zeros((STATE, len(at)), np.float32)
            for t, h, z, r, n, inner in reversed(memory[d]):
                d_h = d_h + d_states[t, d * STATE : (d + 1) * STATE]
                d_new = d_h * real[t]
                d_n = d_new * (1 - z) * (1 - n * n)
                d_z = d_new * (h - n) * z * (1 - z)
                d_r = d_n * inner * r * (1 - r)
                d_x = np.concatenate([d_z, d_r, d_n])
                d_g = np.concatenate([d_z, d_r, d_n * r])
                d_w[d] += (d_x @ vectors[at[:, t]]).T
                d_b[d] += d_x.sum(axis=1)
                d_u[d] += h @ d_g.T
                np.add.at(d_vectors, at[:, t], (self.w[d] @ d_x).T)
                d_h = d_h * (1 - real[t]) + d_new * z + self.u[d] @ d_g
        dense = {"w": d_w, "u": d_u, "b": d_b, "attend": d_attend, "query": d_query, "out": d_out}
        return dense, d_vectors[:-1]


def evidence(logits: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """For each text: highest logit, mean of the highest, log of the number of windows, 1."""
    out = np.zeros((rows, 4))
    out[:, :2], out[:, 3] = -4.0, 1.0
    order = np.lexsort((-logits, row))
    logits, row = logits[order], row[order]
    first = np.searchsorted(row, np.arange(rows + 1))
    top = np.arange(len(row)) - first[row] < HIGHEST
    number = np.diff(first)
    some = number > 0
    sums = np.bincount(row[top], weights=logits[top], minlength=rows)
    out[some, 0] = logits[first[:-1][some]]
    out[some, 1] = sums[some] / np.minimum(number[some], HIGHEST)
    out[:, 2] = np.log1p(number)
    return out


def _start(net: Net, texts: Texts, y: np.ndarray, rows: np.ndarray) -> None:
    """Two dimensions of the embedding begin as the log-count ratio of the slot between classes;
    slots seen in fewer than three texts begin near 0."""
    counts = np.zeros((2, SLOTS))
    for i in rows.tolist():
        words = np.unique(texts.word[texts.rows[i] : texts.rows[i + 1]])
        counts[int(y[i]), np.unique(texts.features[words])] += 1
    totals = np.array([(y[rows] == 0).sum(), (y[rows] == 1).sum()]) + 2.0
    ratio = np.log((counts[1] + 1) / totals[1]) - np.log((counts[0] + 1) / totals[0])
    ratio = np.where(counts.sum(axis=0) >= 3, np.clip(ratio, -3, 3), 0).astype(np.float32)
    net.embedding[:, 0] += 0.4 * ratio
    net.embedding[:, 1] += 0.4 * np.maximum(ratio - 1, 0)


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    at, prior = np.array([1.0, 0.0, 0.0, 0.0]), 0.05 * np.eye(4)
    center = at.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + prior
        at = at - np.clip(np.linalg.solve(hessian, x.T @ (p - y) + prior @ (at - center)), -2, 2)
    return at


def fit(texts: Texts, labels: np.ndarray, toxic: float | None = None) -> Net:
    """A net of labelled texts; with one class or none, a constant score.

    ``toxic`` is the share of toxic rows among all labelled ones, if the given ones are balanced:
    scores are chances under that share.
    """
    y = (np.asarray(labels) > 0).astype(np.float32)
    rng = np.random.default_rng(SEED)
    net = Net.new(rng)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        net.curve = np.array([0.0, 0.0, 0.0, float(np.log(share / (1 - share)))])
        return net
    held = np.arange(len(y)) % 5 == 4
    at, row = texts.windows()
    inside = np.flatnonzero(~held[row])  # windows that are trained on
    _start(net, texts, y, np.flatnonzero(~held))
    dense_names = ("w", "u", "b", "attend", "query", "out")
    moments = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in dense_names}
    squares = np.full((SLOTS, 1), 1e-6, np.float32)
    share = float(np.clip(y[~held].mean(), 1e-3, 1 - 1e-3))
    step = 0
    for epoch in range(EPOCHS):
        if epoch:
            value = net.logits(texts.features, at[inside])
        else:  # the network knows nothing yet: the sum of log-count ratios picks
            ratio = np.append(np.maximum(net.vectors(texts.features)[:, 0], 0), 0)
            value = ratio[at[inside]].sum(axis=1)
        order = np.lexsort((-value, row[inside]))
        best = inside[order[np.unique(row[inside][order], return_index=True)[1]]]
        clean = inside[y[row[inside]] == 0]
        others = rng.permutation(clean)[: int((y[row[best]] == 0).sum())]
        chosen = rng.permutation(np.unique(np.append(best, others)))
        for part in np.array_split(chosen, -(-len(chosen) // BATCH)):
            step += 1
            used, where = np.unique(at[part], return_inverse=True)
            used = used[used < len(texts.features)]  # the padding is last
            target = y[row[part]]
            weight = np.where(target > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
            features = texts.features[used]
            dense, d_words = net.gradients(features, where.reshape(len(part), SPAN), target, weight)
            for k, g in dense.items():
                first, second = moments[k]
                first += 0.1 * (g - first)
                second += 0.01 * (g * g - second)
                scale = (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - 0.02 * scale).astype(np.float32))
            slots, slot = np.unique(features, return_inverse=True)
            slot = slot.reshape(features.shape)
            grad = np.zeros((len(slots), WIDTH), np.float32)
            for k in range(features.shape[1]):
                np.add.at(grad, slot[:, k], d_words)
            squares[slots] += (grad * grad).mean(axis=1, keepdims=True)
            net.embedding[slots] -= 0.05 * grad / np.sqrt(squares[slots])
    found = evidence(net.logits(texts.features, at), row, len(y))
    net.curve = _curve(found[held], y[held].astype(float))
    if toxic is not None and 0 < toxic < 1:
        given = float(np.clip(y[held].mean(), 1e-3, 1 - 1e-3))
        net.curve[3] += np.log(toxic / (1 - toxic)) - np.log(given / (1 - given))
    return net


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``text, label, place``: at most ``rows`` documents of each class, in a fixed mixed order.

    Rows without id or label are left out; a doc_id with several labels counts by the largest.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label"))
    known = known.withColumn("place", F.xxhash64(F.lit(SEED), "doc_id"))
    kinds = [known.where(F.col("label") == k).orderBy("place", "doc_id").limit(rows) for k in (0, 1)]
    chosen = kinds[0].unionByName(kinds[1])
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label", "place")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> Net:
    """Fit on the given labelled rows; repeated documents count once."""
    chosen = labelled(docs, labels, label, rows)
    found = sorted({(r.place, r.label, r.text or "") for r in chosen.collect()})
    toxic = labels.where(F.col(label).isNotNull()).agg(F.avg((F.col(label) > 0).cast("double"))).first()[0]
    texts = [text.encode() for _, _, text in found]
    bounds = np.cumsum([0, *map(len, texts)])
    whole = Texts.of(np.frombuffer(b"".join(texts), np.uint8), bounds)
    return fit(whole, np.array([y for _, y, _ in found]), toxic)


def score(docs: DataFrame, net: Net, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with its score in a new last column (``column``, or column_1 where that exists).

    Null and empty texts get the score of a text without windows. All other columns, whatever
    their names, and repeated rows are kept as they are.
    """
    name, copy = fresh(docs, column), fresh(docs, "_text")

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            found = [np.zeros(0)]
            for _, _, data, bounds in chunks(batch.column(batch.schema.get_field_index(copy))):
                found.append(net.scores(Texts.of(data, bounds)))
            return {name: pa.array(np.concatenate(found))}

        return work

    with_copy = docs.withColumn(copy, F.col(quoted(text)))
    return over_batches(with_copy, make, f"{quoted(name)} double", docs.columns)
