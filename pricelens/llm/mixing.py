"""Soft-membership mixing: document rates whose expected domain token totals meet targets.

Domains are classes of the labelled table. One classifier for each domain, normalized to sum
1, gives every document its posteriors p; a document of n tokens and rate r adds r n p_k
expected tokens to domain k. Rates begin at 1 and are fitted by accelerated projected-gradient
least squares on the totals: y = r + b (r - last r), r <- max(0, y - p . P (totals(y) - targets)).
With M = sum of n p p^T, the curvature, P is M^-1 first, for which 1 is the step of the largest
eigenvalue; reachable targets are met so in few steps. If they can't be met, P becomes the plain
step 1 / (largest eigenvalue of M) until the sum of squares no longer falls. The momentum b is
reset whenever that sum rises. Each step is one aggregation over all documents that moves a few
numbers for each domain; what is sent back is a list of steps, and a document's rate is the fold
of the steps over its posteriors. The fold is written down every ``FOLD`` steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import Model, features, fit
from .tables import Workspace, cut, fresh, over_batches, quoted
from .words import NOT_SPACE, Words, chunks

FIT_ROWS = 3000  # most labelled rows that the classifier is fitted on
STEPS = 1000  # passes at most; nearly always fewer than 30 are needed
THIN_STEPS = 40  # of a thinning, whose targets often can't be met: about 0.2 % off is near enough
FOLD = 40  # most steps that a task folds
CLOSE = 1e-6  # of the targets' total
FLAT = 1e-6  # fall of the sum of squares over WINDOW steps that counts as none
WINDOW = 20
SEED = 13

DOMAINS = ("clean", "low", "toxic")
#: Target share of the tokens of each domain.
TARGETS = {"clean": 0.97, "low": 0.02, "toxic": 0.01}


def domain(labels: DataFrame) -> DataFrame:
    """``doc_id, domain``: toxic, else low (quality 0), else clean; null where no label says."""
    named = F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") <= 0, "low")
    named = named.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), "clean")
    return labels.select("doc_id", named.alias("domain"))


def train(
    docs: DataFrame, labels: DataFrame, domains: tuple[str, ...] = DOMAINS, rows: int = FIT_ROWS
) -> list[Model]:
    """One classifier for each domain, on at most ``rows`` labelled rows in a fixed mixed order.

    A doc_id with several domains counts by the last name of the alphabet; rows without id or
    domain are left out. A domain without rows, or with all, gets a constant score.
    """
    known = labels.where(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("domain").alias("domain"))
    known = known.withColumn("place", F.xxhash64(F.lit(SEED), "doc_id")).orderBy("place", "doc_id").limit(rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "domain", "place")
    featured = _described(chosen, None, ["domain", "place"])
    found = sorted({(r.place, r.domain, bytes(r.features)) for r in featured.collect()})
    rows_ = [np.frombuffer(f, np.int32) for _, _, f in found]
    return [fit(rows_, np.array([d == name for _, d, _ in found])) for name in domains]


def posteriors(rows: list[np.ndarray], models: list[Model]) -> np.ndarray:
    scores = np.stack([m.scores(rows) for m in models], 1) if rows else np.zeros((0, len(models)))
    return scores / scores.sum(axis=1, keepdims=True)


def _described(docs: DataFrame, models: list[Model] | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``features`` or, given models, with ``tokens`` and ``p``."""
    copy = fresh(docs, "_source")
    names = [fresh(docs, n) for n in ("tokens", "p")]

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            found, tokens, shares = [], [], [np.zeros((0, len(models or ())))]
            for _, _, data, bounds in chunks(batch.column(batch.schema.get_field_index(copy))):
                own = features(data, bounds)
                if models is None:
                    found += [f.tobytes() for f in own]
                else:
                    tokens += np.diff(Words(data, bounds, NOT_SPACE).rows).tolist()
                    shares.append(posteriors(own, models))
            if models is None:
                return {"features": pa.array(found, pa.binary())}
            flat = np.concatenate(shares)
            ends = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))
            return {names[0]: pa.array(tokens, pa.int64()), names[1]: lists}

        return work

    schema = "features binary" if models is None else f"{quoted(names[0])} bigint, {quoted(names[1])} array<double>"
    with_copy = docs.withColumn(copy, F.col(quoted(text)))
    return over_batches(with_copy, make, schema, keep)


class Step(NamedTuple):
    """One move of all rates: the momentum, and what is taken off for each domain."""

    momentum: float
    move: np.ndarray


def folded(p: np.ndarray, r: np.ndarray, last: np.ndarray, steps: list[Step]) -> tuple[np.ndarray, np.ndarray]:
    """Rates, and those one step before, after ``steps``; a row of ``p`` is a document."""
    for momentum, move in steps:
        r, last = np.maximum(0.0, r + momentum * (r - last) - p @ move), r
    return r, last


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Tokens, posteriors, rates and last rates of a batch; rates begin at 1."""
    names = batch.schema.names
    tokens = batch.column(names.index("tokens")).to_numpy().astype(np.float64)
    lists = batch.column(names.index("p"))
    p = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(tokens), -1)
    rates = [batch.column(names.index(c)).to_numpy() if c in names else np.ones(len(tokens)) for c in ("_r", "_last")]
    return tokens, p, *rates


def totals(narrow: DataFrame, domains: int, steps: list[Step], momentum: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of each domain after ``steps``, and at the point that ``momentum`` leads to.

    One pass over the documents; a task sends two numbers for each domain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, domains))
        for batch in batches:
            tokens, p, r, last = _rows(batch)
            if len(tokens):
                r, last = folded(p, r, last, steps)
                sums += np.stack([(tokens * r) @ p, (tokens * (r + momentum * (r - last))) @ p])
        yield pa.RecordBatch.from_arrays([pa.array([s]) for s in sums.ravel().tolist()], names=names)

    names = [f"s{k}" for k in range(2 * domains)]
    parts = narrow.mapInArrow(run, ", ".join(f"{n} double" for n in names))
    row = parts.agg(*[F.sum(n) for n in names]).first()
    found = np.array([x or 0.0 for x in row]).reshape(2, domains)
    return found[0], found[1]


def with_rates(narrow: DataFrame, steps: list[Step], names: dict[str, str], keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the folded ``rate`` and ``last`` under the given names."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            _, p, r, last = _rows(batch)
            if len(r):
                r, last = folded(p, r, last, steps)
            found = {"rate": r, "last": last}
            return {name: pa.array(found[which], pa.float64()) for which, name in names.items()}

        return work

    return over_batches(narrow, make, ", ".join(f"{quoted(n)} double" for n in names.values()), keep)


def curvature(narrow: DataFrame, domains: int) -> np.ndarray:
    product: Callable = lambda j, k: F.sum(F.col("tokens") * F.get("p", F.lit(j)) * F.get("p", F.lit(k)))
    pairs = [(j, k) for j in range(domains) for k in range(j + 1)]
    row = narrow.agg(*[product(j, k).alias(f"s{j}_{k}") for j, k in pairs]).first()
    matrix = np.zeros((domains, domains))
    for (j, k), value in zip(pairs, row, strict=True):
        matrix[j, k] = matrix[k, j] = value or 0.0
    return matrix


def targets_of(held: np.ndarray, shares: np.ndarray, grow: bool = True) -> np.ndarray:
    """Target totals: the domain with the largest share keeps the tokens it has, the others
    follow from their shares. Without ``grow`` none gets more than the corpus holds."""
    anchor = int(np.argmax(shares))
    wanted = shares / shares[anchor] * held[anchor]
    return wanted if grow else np.minimum(wanted, held)


class Solver:
    """The steps of the fit, given what each of them finds; where the documents are is not its matter."""

    def __init__(self, matrix: np.ndarray, targets: np.ndarray):
        k = len(targets)
        self.targets, self.scale = targets, max(float(targets.sum()), 1.0)
        self.inverse = np.linalg.pinv(matrix + 1e-12 * max(float(np.trace(matrix)), 1.0) * np.eye(k))
        self.plain = np.eye(k) / max(float(np.linalg.eigvalsh(matrix)[-1]), 1.0)
        self._restart(self.inverse)

    def _restart(self, p: np.ndarray) -> None:
        self.p, self.sums, self.pace, self.before = p, [], 1.0, np.inf

    def momentum(self) -> float:
        """How far the next step looks ahead."""
        following = (1 + np.sqrt(1 + 4 * self.pace**2)) / 2
        return (self.pace - 1) / following

    def step(self, reached: np.ndarray, ahead: np.ndarray) -> Step | None:
        """The next step from totals at the rates and ahead of them; None at the optimum."""
        residual = reached - self.targets
        if np.abs(residual).sum() <= CLOSE * self.scale:
            return None
        square = float(residual @ self.p @ residual)
        self.sums.append(square)
        if len(self.sums) > WINDOW and square > self.sums[-WINDOW] * (1 - FLAT):
            if self.p is self.plain:
                return None
            self._restart(self.plain)
            return Step(0.0, self.p @ residual)
        momentum = self.momentum()
        if square > self.before:  # too far: go on from the rates themselves
            self.pace, momentum, ahead = 1.0, 0.0, reached
        self.pace = (1 + np.sqrt(1 + 4 * self.pace**2)) / 2
        self.before = square
        return Step(momentum, self.p @ (ahead - self.targets))


def fitted(narrow: DataFrame, targets: np.ndarray, steps: int = STEPS) -> tuple[list[Step], np.ndarray]:
    """Projected-gradient fit over ``tokens, p``: all steps, and the totals they reach."""
    solver = Solver(curvature(narrow, len(targets)), targets)
    made: list[Step] = []
    late: list[Step] = []  # those that the table doesn't hold yet
    reached, _ = totals(narrow, len(targets), late)
    ahead = reached
    for _ in range(steps):
        step = solver.step(reached, ahead)
        if step is None:
            break
        made.append(step)
        late.append(step)
        if len(late) == FOLD:
            narrow = cut(with_rates(narrow, late, {"rate": "_r", "last": "_last"}, ["tokens", "p"]))
            late = []
        reached, ahead = totals(narrow, len(targets), late, solver.momentum())
    return made, reached


def mixed(
    docs: DataFrame,
    labels: DataFrame,
    shares: dict[str, float] | None = None,
    grow: bool = True,
    rows: int = FIT_ROWS,
) -> tuple[DataFrame, dict[str, float], dict[str, float]]:
    """``doc_id, tokens, posteriors, rate`` of each row, and totals: reached ones, and targets.

    Targets that rates can meet are met to CLOSE of their total; of others the squares of the
    differences of the totals are least. Null and empty texts have no tokens; they get posteriors
    of a row without features and the rate that follows. Null ids stay null, repeated rows count as often as they come, extra
    columns are ignored. Of an empty table all totals are 0.
    """
    shares = shares or TARGETS
    names = tuple(shares)
    models = train(docs, labels, names, rows)
    narrow = cut(_described(docs.select("doc_id", "text"), models, ["doc_id"]))
    goal = targets_of(totals(narrow, len(names), [])[0], np.array(list(shares.values())), grow)
    steps, reached = fitted(narrow, goal)
    table = with_rates(narrow, steps, {"rate": "rate"}, ["doc_id", "tokens", "p"]).withColumnRenamed("p", "posteriors")
    return table, dict(zip(names, reached.tolist(), strict=True)), dict(zip(names, goal.tolist(), strict=True))


def thinned(
    docs: DataFrame,
    labels: DataFrame,
    shares: dict[str, float] | None = None,
    whole: float = 0.9,
    rows: int = FIT_ROWS,
) -> DataFrame:
    """``docs`` without the rows that the mixture has no room for; no row is doubled.

    Targets don't ask for more than a domain holds, so rates are about 1 in the largest domain;
    the fit takes THIN_STEPS steps at most.
    A row of rate r stays with probability r / ``whole``, by a hash of its id and text: rows
    of rate ``whole`` or more always stay. Columns keep their names, order and values.
    """
    shares = shares or TARGETS
    names = tuple(shares)
    models = train(docs, labels, names, rows)
    columns = docs.columns
    work = Workspace(docs.sparkSession, "mixture")
    named = work.table(_described(docs, models, columns))  # every document is scored once
    tokens, p = (quoted(c) for c in named.columns[-2:])
    narrow = named.select(F.col(tokens).alias("tokens"), F.col(p).alias("p"))
    goal = targets_of(totals(narrow, len(names), [])[0], np.array(list(shares.values())), grow=False)
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    drawn = named.select(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(columns)],
                         F.col(tokens).alias("tokens"), F.col(p).alias("p"), draw.alias("_draw"))
    steps, _ = fitted(narrow, goal, THIN_STEPS)
    own = [f"c{k}" for k in range(len(columns))]
    rated = with_rates(drawn, steps, {"rate": "_rate"}, [*own, "_draw"]).where(F.col("_draw") * whole < F.col("_rate"))
    return rated.select(*[F.col(o).alias(c) for o, c in zip(own, columns, strict=True)])
