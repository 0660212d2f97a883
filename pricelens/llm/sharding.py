"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

1. The partitions that the table has are the source parts. Rows are written once with the number
   of their partition and their place in it, and parts are counted.
2. How many rows of each part go to each shard is drawn from the multivariate hypergeometric
   law, part after part, from the room that is left in the shards: the counts that a uniform
   permutation of all rows would give, with exact shard sizes.
3. Each part is permuted on its own: a seeded permutation of its shard numbers, each as often as
   the matrix says, is laid over its rows.
4. Rows are exchanged once, and each shard is permuted again in cells of bounded size: a row's
   cell and its order in it are hashes of its part and place. Rows get their slots.

What a row holds plays no part, so equal rows spread like others. Everything follows from the
written places and the seed, so a task that runs again after a lost executor gives the same rows.
Only counts reach the driver and the tasks: one number per part and shard, and per cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import Workspace, fresh, quoted
from .words import mix

SHARDS = 16
CELL_ROWS = 50_000  # rows of a cell of a shard, about
SEED = 20_240_601
_NUMPY_LIMIT = 10**9  # numpy draws hypergeometric counts below this population only


def _hypergeometric(good: int, bad: int, sample: int, rng: np.random.Generator) -> int:
    """How many of ``sample`` rows drawn from good + bad ones are good."""
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample))
    low, high = max(0, sample - bad), min(good, sample)

    def log_weight(k: int) -> float:
        parts = (k, good - k, sample - k, bad - sample + k)
        return -sum(math.lgamma(x + 1) for x in parts)

    # Inversion outward from the mode: weights fall off fast on both sides.
    mode = min(max((sample + 1) * (good + 1) // (good + bad + 2), low), high)
    top = log_weight(mode)
    spread = int(40 * math.sqrt(sample * good * bad / (good + bad) ** 2 + 1))
    ks = np.arange(max(low, mode - spread), min(high, mode + spread) + 1)
    weights = np.exp([log_weight(int(k)) - top for k in ks])
    return int(rng.choice(ks, p=weights / weights.sum()))


def communication_matrix(parts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows sent from each part to each shard; row sums are the parts, column sums the shards."""
    total = sum(parts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    rng = np.random.default_rng(seed)
    matrix = np.zeros((len(parts), shards), np.int64)
    for p, rows in enumerate(parts):
        left, others = rows, sum(room)
        for s in range(shards):
            others -= room[s]
            sent = _hypergeometric(room[s], others, left, rng) if left else 0
            matrix[p, s] = sent
            left -= sent
            room[s] -= sent
    return matrix


def _numbered(docs: DataFrame, part: str, place: str) -> DataFrame:
    """``docs`` with the partition of each row and its place in that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch.num_rows
            made = [pa.array(np.full(size, number)), pa.array(np.arange(at, at + size))]
            at += size
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, part, place])

    head = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{head}, {quoted(part)} bigint, {quoted(place)} bigint")


def _hashes(seed: int, part: int, places: np.ndarray) -> np.ndarray:
    start = mix(np.array([seed], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(part))
    return mix(start + places.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def part_shards(row: np.ndarray, part: int, seed: int) -> np.ndarray:
    """The shard of each place of a part, whose row of the matrix is given: a permutation."""
    labels = np.repeat(np.arange(len(row), dtype=np.int32), row)
    return np.random.default_rng([seed, part]).permutation(labels)


def _cells(row: np.ndarray, part: int, cells: int, seed: int) -> np.ndarray:
    """How many rows of a part go to each cell of each shard."""
    labels = part_shards(row, part, seed)
    cell = (_hashes(seed + 1, part, np.arange(len(labels))) % np.uint64(cells)).astype(np.int64)
    return np.bincount(labels * cells + cell, minlength=len(row) * cells)


def shard(
    docs: DataFrame, shards: int = SHARDS, cell_rows: int = CELL_ROWS, seed: int = SEED
) -> DataFrame:
    """``docs`` with two more columns at the end, ``shard`` (0 ...) and ``slot`` (0 ... in it).

    Shard sizes differ by one row at most. Rows are told apart by their places in the table's
    partitions alone, so equal rows and nulls are rows like others; another partitioning of the same
    table gives another shuffle. Columns of ``docs`` keep their values: where it has a ``shard``
    or ``slot`` already, the new column is called ``shard_1`` or ``slot_1``. An empty table
    gives an empty one.
    """
    spark = docs.sparkSession
    names = {n: fresh(docs, n) for n in ("shard", "slot")}
    part, place, cell, order = (fresh(docs, f"_{n}") for n in ("part", "place", "cell", "order"))
    work = Workspace(spark, "shards")
    placed = work.last(_numbered(docs, part, place))
    sizes = dict(placed.groupBy(part).count().collect())  # one row per partition
    used = sorted(sizes)
    matrix = communication_matrix([sizes[p] for p in used], shards, seed)
    cells = max(1, math.ceil(sum(sizes.values()) / shards / cell_rows))

    # Cell sizes follow from the matrix; no row is read for them.
    plan = spark.createDataFrame(
        [(int(p), row.tolist()) for p, row in zip(used, matrix, strict=True)], "part bigint, sent array<bigint>"
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shards * cells, np.int64)
        for batch in batches:
            for number, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += _cells(np.array(row), number, cells, seed)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    counted = plan.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    numbers = np.zeros((shards, cells), np.int64)
    for number, n in counted.collect():
        numbers[divmod(number, cells)] = n
    starts = (np.cumsum(numbers, axis=1) - numbers).ravel()
    sent = spark.sparkContext.broadcast((dict(zip(used, matrix, strict=True)), starts))
    columns = docs.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of, first = sent.value
        known: tuple[int, np.ndarray] = (-1, np.zeros(0, np.int32))
        for batch in batches:
            number, at = batch.column(len(columns)).to_numpy(), batch.column(len(columns) + 1).to_numpy()
            to, where, by = np.empty(len(at), np.int32), np.empty(len(at), np.int64), np.empty(len(at), np.uint64)
            for p in np.unique(number).tolist():
                if known[0] != p:
                    known = (p, part_shards(rows_of[p], p, seed))
                own = number == p
                to[own] = known[1][at[own]]
                where[own] = (_hashes(seed + 1, p, at[own]) % np.uint64(cells)).astype(np.int64)
                by[own] = _hashes(seed + 2, p, at[own])
            made = [pa.array(to), pa.array(where), pa.array(first[to * cells + where]), pa.array(by.view(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(columns)], *made], names=[*columns, names["shard"], cell, place, order]
            )

    head = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema.fields)
    more = f"{names['shard']} int, {cell} bigint, {place} bigint, {order} bigint"
    dealt = placed.mapInArrow(deal, f"{head}, {more}" if head else more)
    inside = Window.partitionBy(names["shard"], cell).orderBy(order)
    slot = (F.col(place) + F.row_number().over(inside) - 1).cast("bigint")
    return dealt.select(*(F.col(quoted(c)) for c in columns), F.col(names["shard"]), slot.alias(names["slot"]))


def shard_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of each row of documents.

    The law is ``rows``: counts differ by one at most. A null text has size 1 and the checksum
    of the empty text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shard(narrow).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
