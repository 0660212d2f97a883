"""Repeated passages: every byte under a string of ``LENGTH`` bytes that starts elsewhere too.

The strings are found with interval expansion on a Burrows-Wheeler transform. Starting from the
intervals of single bytes, all intervals are extended backwards, one byte a level; an extension
that ends before a row shows how long a prefix that row shares with the one above. Common
prefixes so come out by increasing value, and the expansion stops at LENGTH: rows without a value
by then share at least LENGTH bytes with a neighbour.

Nothing global is built. Each start of a string belongs to the smallest hash of the ``gram``-byte
pieces of its string; equal strings have equal smallest hashes. Neighbouring starts with one hash
form a *run*, and the bytes that their strings cover are the run's *context*. Contexts whose hash
occurs once are dropped. Equal contexts are one row with a weight. All contexts of one hash meet
in one block, whose transform is built by a task. A hash with more than ``BLOCK`` bytes of
different contexts is not sent to one task: its contexts are taken as texts of their own and split by
longer pieces (384, then 400 bytes, where a group holds equal strings only, hence one row).

Hashes of 64 bits choose the groups; equality of whole contexts and of whole texts is told by
128 bits (hash and context hash, two text hashes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Workspace, fresh, quoted
from .words import mix, text_bytes

LENGTH = 400  # bytes of a string that counts as repeated
GRAMS = (128, 384, 400)  # bytes that all strings of a group share, by level
BLOCK = 1 << 21  # most bytes of different contexts with one hash that one task takes
SEGMENT = 1 << 19  # bytes hashed at once; longer texts are hashed in segments
LONGEST_RUN = 4096

_BASE = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base % 2**64, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of all pieces of a byte array from prefix sums, kept powers included."""

    def __init__(self, size: int):
        self.up = _powers(_BASE, size + 1)
        self.down = _powers(pow(_BASE, -1, 2**64), size + 1)

    def sums(self, data: np.ndarray) -> np.ndarray:
        found = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * self.up[: len(data)], out=found[1:])
        return found

    def pieces(self, sums: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        whole = (sums[starts + lengths] - sums[starts]) * self.down[starts]
        return mix(whole + lengths.astype(np.uint64))

    def grams(self, sums: np.ndarray, size: int) -> np.ndarray:
        return mix((sums[size:] - sums[:-size]) * self.down[: len(sums) - size])


def _sliding(values: np.ndarray, width: int, best: np.ufunc, worst: int) -> np.ndarray:
    """``best`` of every ``width`` values in a row."""
    count = len(values) - width + 1
    if width == 1:
        return values.copy()
    padded = np.concatenate([values, np.full(-len(values) % width, worst, values.dtype)])
    rows = padded.reshape(-1, width)
    before = best.accumulate(rows, axis=1).ravel()
    after = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(after[:count], before[width - 1 : width - 1 + count])


def _segments(column: pa.Array, length: int, segment: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes to hash at once: data, and for each part of a row its bounds, row and place in it.

    Parts of one long row overlap by ``length - 1`` bytes, so every start is in one part. Rows
    of fewer than ``length`` bytes have no starts.
    """
    whole, bounds = text_bytes(column)
    parts: list[tuple[int, int, int, int]] = []
    size = 0
    for row in range(len(column)):
        low, high = int(bounds[row]), int(bounds[row + 1])
        for at in range(low, high - length + 1, segment):
            end = min(at + segment + length - 1, high)
            if parts and size + end - at > segment + length:  # a part alone is at most that long
                yield _packed(whole, parts)
                parts, size = [], 0
            parts.append((at, end, row, at - low))
            size += end - at
    if parts:
        yield _packed(whole, parts)


def _packed(whole: np.ndarray, parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    table = np.array(parts, dtype=np.int64)
    data = np.concatenate([whole[a:b] for a, b, _, _ in parts])
    return data, np.concatenate([[0], np.cumsum(table[:, 1] - table[:, 0])]), table[:, 2], table[:, 3]


def runs_of(
    data: np.ndarray, bounds: np.ndarray, gram: int, hasher: Hasher, length: int = LENGTH
) -> dict[str, np.ndarray]:
    """Runs of starts with one smallest hash: hash, context hash, part, start in the part, number
    of starts, and whether two strings of the run itself may be equal."""
    width = length - gram + 1
    sums = hasher.sums(data)
    grams = hasher.grams(sums, gram)
    least = _sliding(grams, width, np.minimum, 2**64 - 1)
    # Starts whose string lies inside one part.
    edge = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(edge, bounds[:-1], 1)
    np.add.at(edge, np.maximum(bounds[1:] - length + 1, bounds[:-1]), -1)
    good = np.cumsum(edge)[: len(least)] > 0
    first = np.zeros(len(data) + 1, dtype=bool)
    first[bounds] = True
    new = np.ones(len(least), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (good[1:] != good[:-1]) | first[1 : len(least)]
    marks = np.append(np.flatnonzero(new), len(least))
    keep = good[marks[:-1]]
    starts, counts = marks[:-1][keep], np.diff(marks)[keep]
    if len(counts) and counts.max() > LONGEST_RUN:
        cuts = -(-counts // LONGEST_RUN)
        inner = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        starts = np.repeat(starts, cuts) + inner * LONGEST_RUN
        counts = np.minimum(np.repeat(counts, cuts) - inner * LONGEST_RUN, LONGEST_RUN)
    # A smallest piece that returns while it is still the smallest: its strings may be equal.
    seen = _sliding(
        np.concatenate([np.zeros(width - 1, np.uint64), np.where(good, least, 0), np.zeros(width - 1, np.uint64)]),
        width, np.maximum, 0,
    )
    chosen = np.flatnonzero(seen[: len(grams)] == grams)
    twice = chosen[:-1][grams[chosen[1:]] == grams[chosen[:-1]]]
    doubled = np.zeros(len(starts) + 1, dtype=np.int32)
    np.add.at(doubled, np.maximum(np.searchsorted(starts, twice - width + 1, side="right") - 1, 0), 1)
    np.add.at(doubled, np.searchsorted(starts, twice, side="right"), -1)
    part = np.searchsorted(bounds, starts, side="right") - 1
    return {
        "m": least[starts].view(np.int64),
        "ctx": hasher.pieces(sums, starts, counts + length - 1).view(np.int64),
        "part": part,
        "start": starts - bounds[part],
        "n": counts,
        "twice": np.cumsum(doubled)[:-1] > 0,
    }


_RUNS = "m long, ctx long, key1 long, key2 long, start long, n int, w long, twice int"


def _runs(texts: DataFrame, gram: int) -> DataFrame:
    """All runs of ``key1, key2, w, text``; ``w`` is the weight of the text, ``twice`` is 1 where
    a run may repeat itself."""

    segment = SEGMENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(segment + 2 * LENGTH)
        for batch in batches:
            key1, key2, weight = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key1", "key2", "w"))
            for data, bounds, rows, places in _segments(batch.column(batch.schema.get_field_index("text")), LENGTH, segment):
                found = runs_of(data, bounds, gram, hasher)
                row = rows[found["part"]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found["m"]), pa.array(found["ctx"]), pa.array(key1[row]), pa.array(key2[row]),
                        pa.array(found["start"] + places[found["part"]]), pa.array(found["n"].astype(np.int32)),
                        pa.array(weight[row]), pa.array(found["twice"].astype(np.int32)),
                    ],
                    names=["m", "ctx", "key1", "key2", "start", "n", "w", "twice"],
                )

    return texts.select("key1", "key2", "w", "text").mapInArrow(run, _RUNS)


def suffixes(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of contexts that end in 0; equal ends are ordered by context.

    Prefix doubling that sorts again only what is not told apart yet.
    """
    size = len(symbols)
    wide = np.concatenate([symbols.astype(np.int64), np.zeros(7, np.int64)])
    key = np.zeros(size, dtype=np.int64)
    open_ = np.ones(size, dtype=np.int64)
    for k in range(7):  # nothing behind an end is looked at
        key = (key << 9) | wide[k : k + size] * open_
        open_ &= wide[k : k + size] > 0
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(size, dtype=bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | ((sorted_key[1:] & 511) == 0)
    place = np.arange(size)
    rank = np.empty(size, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    h = 7
    alone = new & np.append(new[1:], True)
    todo = order[~alone]
    while len(todo):
        pair = (rank[todo] << 32) | rank[todo + h]
        by = np.argsort(pair, kind="stable")
        todo, pair = todo[by], pair[by]
        group = pair >> 32
        new = np.ones(len(todo), dtype=bool)
        new[1:] = pair[1:] != pair[:-1]
        begin = np.ones(len(todo), dtype=bool)
        begin[1:] = group[1:] != group[:-1]
        place = np.arange(len(todo))
        at = np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(begin, place, 0))
        rank[todo] = group + at
        todo = todo[~(new & np.append(new[1:], True))]
        h *= 2
    found = np.empty(size, dtype=np.int64)
    found[rank] = np.arange(size)
    return found


def repeated_rows(symbols: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which rows of the suffix array share ``length`` or more bytes with a neighbour row.

    Backward extension of all intervals, breadth first. ``ended[i]`` is set in the level in which
    the common prefix of rows i - 1 and i is known; only intervals that end before a row whose
    value is new are extended further, so a block of N rows has at most N extensions.
    """
    size = len(symbols)
    bwt = symbols[order - 1]
    to = np.empty(size, dtype=np.int64)
    to[np.argsort(bwt, kind="stable")] = np.arange(size)
    change = np.append(True, bwt[1:] != bwt[:-1])
    run = np.cumsum(change) - 1
    run_low = np.flatnonzero(change)
    run_high = np.append(run_low[1:], size) - 1

    heads = symbols[order]
    ended = np.zeros(size + 1, dtype=bool)
    ended[size] = True
    ended[:-1] = np.append(True, heads[1:] != heads[:-1]) | (heads == 0)
    ends = np.flatnonzero(ended[:-1])
    if len(ends) < size:  # the row behind the last end symbol begins an interval anyway
        low, high = ends, np.append(ends[1:], size) - 1
    else:
        low = high = ends
    for _ in range(1, length):
        if not len(low):
            break
        first_run, last_run = run[low], run[high]
        single = first_run == last_run
        begin, end = [low[single]], [high[single]]
        if not single.all():
            l, h, r = low[~single], high[~single], first_run[~single]
            count = last_run[~single] - r + 1
            parent = np.repeat(np.arange(len(l)), count)
            piece = np.repeat(r - (np.cumsum(count) - count), count) + np.arange(len(parent))
            a, b = np.maximum(l[parent], run_low[piece]), np.minimum(h[parent], run_high[piece])
            by = np.argsort(to[a])
            a, b, parent = a[by], b[by], parent[by]
            joins = (to[a[1:]] == to[b[:-1]] + 1) & (parent[1:] == parent[:-1]) & (bwt[a[1:]] == bwt[b[:-1]])
            begin.append(a[np.append(True, ~joins)])
            end.append(b[np.append(~joins, True)])
        a, b = np.concatenate(begin), np.concatenate(end)
        real = bwt[a] > 0
        low, high = to[a[real]], to[b[real]]
        fresh_ = ~ended[high + 1]
        low, high = low[fresh_], high[fresh_]
        ended[high + 1] = True
    return ~ended[:-1] | ~ended[1:]


def block_ranges(contexts: list[np.ndarray], weights: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Ranges of repeated starts in the contexts of a block: context, first start, last start + 1."""
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    symbols = np.zeros(begins[-1], dtype=np.uint16)
    for c, at in zip(contexts, begins.tolist(), strict=False):
        symbols[at : at + len(c)] = c
        symbols[at : at + len(c)] += 1
    order = suffixes(symbols)
    hit = np.zeros(len(symbols) + 1, dtype=np.int8)
    hit[order[repeated_rows(symbols, order, length)]] = 1
    for k in np.flatnonzero(weights > 1).tolist():
        hit[begins[k] : begins[k] + max(sizes[k] - length + 1, 0)] = 1
    step = np.diff(hit, prepend=np.int8(0))
    first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    which = np.searchsorted(begins, first, side="right") - 1
    return {"which": which, "a": first - begins[which], "b": last - begins[which]}


def _expanded(contexts: DataFrame) -> DataFrame:
    """``m, ctx, a, b`` of ``m, ctx, w, bytes``: one block after the other in each task."""

    def flush(rows: list) -> pa.RecordBatch:
        found = block_ranges([np.frombuffer(r[3], dtype=np.uint8) for r in rows], np.array([r[2] for r in rows]))
        m, ctx = (np.array([r[k] for r in rows], dtype=np.int64)[found["which"]] for k in (0, 1))
        return pa.RecordBatch.from_arrays(
            [pa.array(m), pa.array(ctx), pa.array(found["a"]), pa.array(found["b"])], names=["m", "ctx", "a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        size, last = 0, None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for row in zip(*columns, strict=True):
                if row[0] != last and size >= BLOCK // 2:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
                last = row[0]
        if rows:
            yield flush(rows)

    grouped = contexts.select("m", "ctx", "w", "bytes").repartition("m").sortWithinPartitions("m", "ctx")
    return grouped.mapInArrow(run, "m long, ctx long, a long, b long")


def _ranges(texts: DataFrame, work: Workspace, level: int = 0) -> DataFrame:
    """``key1, key2, a, b``: ranges of repeated starts in texts ``key1, key2, w, text``."""
    gram = GRAMS[level]
    runs = work.table(_runs(texts, gram))
    often = runs.groupBy("m").agg(F.sum(F.col("w") + F.col("twice")).alias("w")).where("w > 1").select("m")
    found = work.table(runs.join(often, "m", "left_semi"))
    place = F.struct("key1", "key2", "start", "n")
    rows = found.groupBy("m", "ctx").agg(F.sum("w").alias("w"), F.min(place).alias("at"))
    rows = rows.select("m", "ctx", "w", "at.*")
    last = level + 1 == len(GRAMS)
    if last:
        sized = rows.withColumn("hot", F.lit(False))
    else:
        sizes = rows.groupBy("m").agg(F.sum(F.col("n") + LENGTH - 1).alias("_bytes"))
        sized = rows.join(sizes.where(F.col("_bytes") > BLOCK).withColumn("hot", F.lit(True)), "m", "left")
        sized = sized.withColumn("hot", F.coalesce("hot", F.lit(False))).drop("_bytes")
    wanted = sized.groupBy("key1", "key2").agg(F.collect_list(F.struct("m", "ctx", "w", "start", "n", "hot")).alias("runs"))
    once = texts.groupBy("key1", "key2").agg(F.first("text").alias("text"))
    cut = F.transform(
        "runs",
        lambda r: F.struct(
            r["m"].alias("m"), r["ctx"].alias("ctx"), r["w"].alias("w"), r["hot"].alias("hot"),
            F.substring(F.col("text"), r["start"].cast("int") + 1, r["n"] + (LENGTH - 1)).alias("bytes"),
        ),
    )
    contexts = once.join(wanted, ["key1", "key2"]).select(F.explode(cut).alias("c")).select("c.*")
    if last:
        spans = _expanded(contexts)
    else:
        hot = sized.where("hot")
        if hot.isEmpty():
            spans = _expanded(contexts)
        else:
            contexts = work.table(contexts)
            spans = _expanded(contexts.where("not hot"))
            inner = contexts.where("hot").select(
                F.col("m").alias("key1"), F.col("ctx").alias("key2"), "w", F.col("bytes").alias("text")
            )
            deeper = _ranges(inner, work, level + 1)
            spans = spans.unionByName(deeper.toDF("m", "ctx", "a", "b"))
    spans = work.table(spans)
    moved = found.select("m", "ctx", "key1", "key2", "start").distinct().join(spans, ["m", "ctx"])
    return moved.select("key1", "key2", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))


_OUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the size, the removed spans and the digest of what is left of each text.

    Adds ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``spans`` (byte ranges to
    remove); existing columns of these names are replaced. A null text counts as empty; texts of
    fewer than LENGTH bytes keep everything; equal rows, and rows without an id, are texts like
    any other and repeat each other. An empty table gives an empty table.
    """
    from hashlib import sha256

    work = Workspace(docs.sparkSession, "repeats")
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names])
    value = F.coalesce(F.col(quoted(text)), F.lit(""))
    key1, key2, got = fresh(docs, "key1"), fresh(docs, "key2"), fresh(docs, "_ranges")
    keys = [F.xxhash64(value), F.xxhash64(F.lit(7), value)]
    texts = docs.select(keys[0].alias("key1"), keys[1].alias("key2"), F.lit(1).cast("long").alias("w"), value.cast("binary").alias("text"))
    ranges = _ranges(texts, work)
    per_text = ranges.groupBy("key1", "key2").agg(F.collect_list(F.struct("a", "b")).alias(got))
    per_text = work.last(per_text.toDF(key1, key2, got))
    joined = docs.withColumns({key1: keys[0], key2: keys[1]}).join(per_text, [key1, key2], "left")
    kept = [f for f in docs.schema.fields]
    asked = [f.name for f in kept if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, bounds = text_bytes(batch.column(batch.schema.get_field_index(text)))
            found = batch.column(batch.schema.get_field_index(got)).to_pylist()
            rows = []
            for k, pairs in enumerate(found):
                data = whole[bounds[k] : bounds[k + 1]]
                spans = []
                for a, b in sorted((p["a"], p["b"] + LENGTH - 1) for p in pairs or ()):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                digest, at = sha256(), 0
                for a, b in spans:
                    digest.update(data[at:a])
                    at = b
                digest.update(data[at:])
                rows.append((len(data), sum(b - a for a, b in spans), len(spans), digest.hexdigest(),
                             [{"start": a, "end": b} for a, b in spans]))
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)]
            same = [batch.column(batch.schema.get_field_index(n)) for n in [*asked, text]]
            yield pa.RecordBatch.from_arrays([*same, *made], names=[*asked, text, *names])

    fields = [next(f for f in kept if f.name == n) for n in [*asked, text]]
    head = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in fields)
    out = joined.select(*[F.col(quoted(n)) for n in [*asked, text]], got).mapInArrow(run, f"{head}, {_OUT}")
    return out.select(*[F.col(quoted(c)) for c in docs.columns], *names)


_TYPES = [
    pa.int64(), pa.int64(), pa.int64(), pa.string(),
    pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
]


def report(docs: DataFrame) -> DataFrame:
    """The digest columns per document; the texts themselves are read once more, not returned."""
    found = remove_repeats(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
