"""Benchmark passages in documents by a distributed positional inverted index.

Terms are lower-cased words. Benchmark items are cut into windows (every run of ten words; a
shorter item is one window). Corpus counts of the benchmark's terms tell the rarest terms of
each window; for these the documents' postings (term, document, positions) are stored. Each
window intersects the lists of its rarest terms, rarest first, after moving positions by the
terms' offsets in the window. What is left is verified against all words of the window.

The same index gives proximity matches: the chosen terms within a distance, in any order. Postings
of one text lie together, so these need no exchange: a text's lists are searched for the nearest
positions of the other terms around each place of the rarest one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, mapped, over_batches
from .words import ALNUM, LOWER, Words, chunks

WINDOW = 10
RAREST = 3  # terms of a window whose lists are intersected
BLOCK_WINDOWS = 200_000  # windows of the benchmark matched at once (about 16 MB of hashes)


@dataclass
class Query:
    """Windows of one block of the benchmark: ids and hashed words (0 behind a short one)."""

    ids: list[int]
    words: np.ndarray
    length: np.ndarray
    table: DataFrame


def term_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, hashes of all words, and where the words of each row begin, by chunks."""
    for low, _, data, bounds in chunks(column):
        words = Words(LOWER[data], bounds, ALNUM)
        yield low, words.hashes(), words.rows


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``item_id, words`` (hashes): the different windows of each item."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            ids = batch.column(0).to_pylist()
            items, found = [], []
            for low, hashes, rows in term_hashes(batch.column(1)):
                signed = hashes.view(np.int64)
                for r in range(len(rows) - 1):
                    own = signed[rows[r] : rows[r + 1]]
                    starts = range(max(len(own) - WINDOW + 1, 1)) if len(own) else ()
                    for k in starts:
                        items.append(ids[low + r])
                        found.append(own[k : k + WINDOW].tolist())
            yield {
                "item_id": pa.array(items, pa.int64()),
                "words": pa.array(found, pa.list_(pa.int64())),
            }

        return work

    made = mapped(benchmark.select("item_id", "text"), make, "item_id bigint, words array<bigint>")
    return made.where("item_id is not null").distinct()


def query_blocks(benchmark: DataFrame, block: int = BLOCK_WINDOWS) -> Iterator[Query]:
    """The benchmark in blocks of ``block`` windows: what one pass sends to all tasks is bounded
    by that number, whatever the benchmark's size."""
    windows = item_windows(benchmark).groupBy("words").agg(
        F.sort_array(F.collect_set("item_id")).alias("items")
    )
    windows = cut(windows.withColumn("window", F.monotonically_increasing_id()))
    blocks = -(-windows.count() // block)
    for k in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k)
        rows = sorted(part.select("window", "words").collect())
        words = np.zeros((len(rows), WINDOW), np.int64)
        for i, r in enumerate(rows):
            words[i, : len(r.words)] = r.words
        length = np.array([len(r.words) for r in rows], np.int64)
        if rows:
            yield Query([r.window for r in rows], words, length, part)


def term_counts(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of the sorted ``terms`` comes in all documents."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            total = np.zeros(len(terms), np.int64)
            for _, hashes, _ in term_hashes(batch.column(0)):
                place, hit = _find(terms, hashes.view(np.int64))
                total += np.bincount(place[hit], minlength=len(terms))
            some = np.flatnonzero(total)
            yield {"term": pa.array(terms[some]), "n": pa.array(total[some])}

        return work

    counted = mapped(docs.select("text"), make, "term bigint, n bigint").groupBy("term").agg(F.sum("n"))
    counts = np.zeros(len(terms), np.int64)
    for term, n in counted.collect():
        counts[np.searchsorted(terms, term)] = n
    return counts


def _find(ordered: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return place, ordered[place] == values


def rarest_terms(query: Query, terms: np.ndarray, counts: np.ndarray, most: int) -> list[list[tuple]]:
    """For each window its rarest terms with their offsets, rarest first."""
    chosen = []
    for row, length in zip(query.words, query.length, strict=True):
        own = row[:length]
        weight = counts[np.searchsorted(terms, own)]
        order = np.lexsort((np.arange(length), weight))[:most]
        chosen.append([(int(own[o]), int(o)) for o in order])
    return chosen


def postings(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """The positional index of ``terms``: ``term, doc_id, positions, row``, one row for each text.

    Rows of a text lie together, by term; ``row`` tells the texts of a partition apart.
    """

    def make():
        done = 0

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            nonlocal done
            ids = batch.column(0)
            for low, hashes, rows in term_hashes(batch.column(1)):
                place, hit = _find(terms, hashes.view(np.int64))
                at = np.flatnonzero(hit)
                row = np.searchsorted(rows, at, side="right") - 1
                position = (at - rows[row]).astype(np.int32)
                order = np.lexsort((position, place[at], row))
                row, term, position = row[order], place[at][order], position[order]
                new = np.concatenate(([True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])))
                first = np.flatnonzero(new[: len(row)])
                ends = np.append(first, len(row)).astype(np.int32)
                yield {
                    "term": pa.array(terms[term[first]]),
                    "doc_id": ids.take(pa.array(low + row[first])),
                    "positions": pa.ListArray.from_arrays(pa.array(ends), pa.array(position)),
                    "row": pa.array(done + low + row[first]),
                }
            done += batch.num_rows

        return work

    schema = "term bigint, doc_id bigint, positions array<int>, row bigint"
    made = mapped(docs.select("doc_id", "text"), make, schema)
    return made.where("doc_id is not null")


def phrase_starts(index: DataFrame, ids: list[int], chosen: list[list[tuple]]) -> DataFrame:
    """``doc_id, window, start`` where all chosen terms of a window stand at their offsets.

    Lists are intersected one after the other, rarest first. The window side is as large as a
    block of the benchmark, so it is sent to all tasks and no list, however long, meets in one.
    """
    spark = index.sparkSession
    keys = ["doc_id", "window", "start"]
    found = None
    for step in range(max(map(len, chosen))):
        asked = [(w, *t[step], len(t) - 1) for w, t in zip(ids, chosen, strict=True) if len(t) > step]
        wanted = spark.createDataFrame(asked, "window bigint, term bigint, shift int, last int")
        lists = index.join(F.broadcast(wanted), "term").select(
            "doc_id", "window", "last", "shift", F.explode("positions").alias("position")
        )
        lists = lists.withColumn("start", F.col("position") - F.col("shift")).where("start >= 0")
        if found is None:
            found = lists.select(*keys, "last")
        else:
            more = found.where(F.col("last") >= step).join(lists.select(*keys), keys, "left_semi")
            found = found.where(F.col("last") < step).unionByName(more)
    return found.select(*keys)


class _Near:
    """The chosen terms of a block's windows, found by the rarest one."""

    def __init__(self, ids: list[int], chosen: list[list[tuple]]):
        most = max(map(len, chosen))
        rarest = np.array([c[0][0] for c in chosen], np.int64)
        order = np.argsort(rarest, kind="stable")
        self.rarest, self.ids = rarest[order], np.array(ids, np.int64)[order]
        # A window with fewer terms asks for its rarest one again.
        full = [[t for t, _ in c] + [c[0][0]] * (most - len(c)) for c in chosen]
        self.others = np.array(full, np.int64)[order, 1:]

    def matches(self, terms: np.ndarray, places: list[np.ndarray], distance: int) -> Iterator[tuple[int, int]]:
        """Window and place of its rarest term, for one text: ordered terms and their positions."""
        low, high = np.searchsorted(self.rarest, terms, "left"), np.searchsorted(self.rarest, terms, "right")
        size = high - low
        own = np.repeat(np.arange(len(terms)), size)
        window = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
        at, hit = _find(terms, self.others[window])
        whole = hit.all(axis=1)
        for k, row, rest in zip(window[whole].tolist(), own[whole].tolist(), at[whole].tolist(), strict=True):
            first = places[row]
            near = np.ones(len(first), dtype=bool)
            for other in rest:
                spots = places[other]
                after = np.searchsorted(spots, first)
                right = spots[np.minimum(after, len(spots) - 1)]
                left = spots[np.maximum(after - 1, 0)]
                near &= np.minimum(np.abs(right - first), np.abs(first - left)) <= distance
            for spot in first[near].tolist():
                yield int(self.ids[k]), spot


def near_matches(index: DataFrame, ids: list[int], chosen: list[list[tuple]], distance: int) -> DataFrame:
    """``doc_id, window, first``: documents in which all chosen terms of a window lie within
    ``distance`` words of the rarest one, in any order; first is where that stands.

    The postings of a text are read together where they lie; nothing is exchanged or paired.
    """
    sent = index.sparkSession.sparkContext.broadcast(_Near(ids, chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, last = sent.value, [], None
        found: list[tuple] = []

        def flush() -> None:
            if held:
                terms = np.array([t for t, _ in held], np.int64)
                found.extend((last[1], *f) for f in block.matches(terms, [p for _, p in held], distance))

        def made() -> pa.RecordBatch:
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
            found.clear()
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "window", "first"])

        for batch in batches:
            lists = batch.column(2)
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            rows = zip(*(batch.column(k).to_pylist() for k in (3, 1, 0)), strict=True)
            for k, (row, doc_id, term) in enumerate(rows):
                if (row, doc_id) != last:
                    flush()
                    held, last = [], (row, doc_id)
                held.append((term, values[ends[k] : ends[k + 1]]))
            yield made()
        flush()
        yield made()

    columns = index.select("term", "doc_id", "positions", "row")
    return columns.mapInArrow(run, "doc_id bigint, window bigint, first bigint")


def _verify():
    """Candidate windows of each text against all their words."""

    def work(batch: pa.RecordBatch) -> dict:
        spots = batch.column(1).to_pylist()
        total, hits, found = [], [], []
        for low, hashes, rows in term_hashes(batch.column(0)):
            signed = hashes.view(np.int64)
            for r in range(len(rows) - 1):
                own = signed[rows[r] : rows[r + 1]]
                inside, met = set(), set()
                for spot in spots[low + r] or ():
                    start, words = spot["start"], spot["words"]
                    if own[start : start + len(words)].tolist() == words:
                        inside.update(range(start, start + len(words)))
                        met.update(spot["items"])
                total.append(len(own))
                hits.append(sorted(inside))
                found.append(sorted(met))
        return {
            "n_words": pa.array(total, pa.int64()),
            "hit": pa.array(hits, pa.list_(pa.int32())),
            "items": pa.array(found, pa.list_(pa.int64())),
        }

    return work


def _candidates(docs: DataFrame, query: Query, distance: int | None) -> tuple[DataFrame, DataFrame | None]:
    """``doc_id, start, words, items`` of the windows of one block that may stand in a text, and
    ``doc_id, window, first`` of those whose rarest terms are near one another."""
    terms = np.unique(query.words[np.arange(WINDOW) < query.length[:, None]])
    chosen = rarest_terms(query, terms, term_counts(docs, terms), RAREST)
    kept = np.unique(np.array([t for c in chosen for t, _ in c], np.int64))
    index = cut(postings(docs, kept))
    starts = phrase_starts(index, query.ids, chosen)
    near = near_matches(index, query.ids, chosen, distance) if distance is not None else None
    return starts.join(F.broadcast(query.table), "window").drop("window"), near


def matches(
    docs: DataFrame, benchmark: DataFrame, block: int = BLOCK_WINDOWS, distance: int | None = WINDOW
) -> DataFrame:
    """``doc_id, n_near, n_words, hit, items`` of each row of ``doc_id, text``.

    ``n_near`` counts the windows whose rarest terms stand within ``distance`` words in a text of
    this doc_id, in any order (0 if no distance is given).

    ``hit`` has the positions of the words inside an occurrence of a window, ``items`` the
    items with such windows. Null texts have no words. A row without doc_id is counted but not
    matched, rows of one doc_id are matched each by its own text. Repeated items and windows
    count once; items without words or without item_id are left out. With an empty benchmark
    nothing is hit. Extra columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    spots, close = None, None
    for query in query_blocks(benchmark, block):
        found, near = _candidates(docs, query, distance)
        spots = found if spots is None else spots.unionByName(found)
        if near is not None:
            close = near if close is None else close.unionByName(near)
    if spots is None:
        none = F.lit(None).cast("array<struct<start:int,words:array<bigint>,items:array<bigint>>>")
        joined = docs.select("text", none.alias("spots"), "doc_id", F.lit(0).cast("bigint").alias("n_near"))
    else:
        lists = spots.groupBy("doc_id").agg(
            F.collect_list(F.struct("start", "words", "items")).alias("spots")
        )
        if close is None:
            lists = lists.withColumn("n_near", F.lit(0))
        else:
            windows = close.select("doc_id", "window").distinct().groupBy("doc_id")
            lists = lists.join(windows.agg(F.count(F.lit(1)).alias("n_near")), "doc_id", "full")
        near = F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near")
        joined = docs.join(lists.hint("shuffle_hash"), "doc_id", "left").select("text", "spots", "doc_id", near)
    schema = "n_words bigint, hit array<int>, items array<bigint>"
    return over_batches(joined, _verify, schema, ["doc_id", "n_near"])


def report(
    docs: DataFrame, benchmark: DataFrame, block: int = BLOCK_WINDOWS, distance: int | None = WINDOW
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near`` of each document."""
    found = matches(docs, benchmark, block, distance)
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words",
        F.size("hit").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
        "n_near",
    )
