"""Phrases whose words belong together, counted in suffix subtrees cut off at four words.

Every word of a piece begins a suffix; only its first four words matter. The suffixes are parted
vertically by their first words. A group holds the prefixes that one hash deals to it, about half
of ``BUDGET`` suffixes; a word that alone begins more is a prefix that is extended by one more
word, and a pair that is still too frequent is extended to all four. Tasks send equal suffixes of a
chunk as one row with a count. For each group, independently of all others, a task sorts the
suffixes it got, which are then the leaves of the group's subtrees; the count of an inner node is
the total of the leaves below it. Only where a pair had to be extended, totals of its shorter
phrases come from several groups and are added afterwards.

Words too rare for any phrase end a suffix early. They are told by one bit of ``BITS``: a rare word
that shares its bit with a frequent one is only counted in vain.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import Workspace
from .words import LOWER, Words, chunks

LEAST = 30  # occurrences of a phrase
LONGEST = 4  # words of a phrase
BUDGET = 1 << 21  # suffixes that one task sorts at once
BITS = 1 << 24  # 2 MB sent to the tasks
CHUNK = 1 << 23  # bytes of text whose equal suffixes are combined
TOP = 2000
COVER = 80  # percent of a phrase's occurrences inside a longer one that make it redundant
SALTS = 64

_PIECE_ENDS = np.frombuffer(b".,;:!?\x0a\x0b\x0c\x0d", dtype=np.uint8)
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[_PIECE_ENDS] = False
_IN_WORD[[0x20, 0x09]] = False
_ENDS = np.zeros(256, dtype=bool)
_ENDS[_PIECE_ENDS] = True


class Tokens:
    """Words of one language in a chunk: a dictionary, the words as codes, and whether a word
    and the next one are neighbours in a piece."""

    def __init__(self, vocabulary: list[bytes], codes: np.ndarray, followed: np.ndarray):
        self.vocabulary, self.codes, self.followed = vocabulary, codes, followed


def tokens(text: pa.Array, lang: pa.Array) -> Iterator[tuple[str, Tokens]]:
    """The words of a text column by language, chunk by chunk; whole texts only."""
    names = lang.fill_null("und").dictionary_encode()
    which = names.indices.to_numpy()
    for first, last, data, bounds in chunks(text, CHUNK):
        lower = LOWER[data]
        words = Words(lower, bounds, _IN_WORD)
        if not len(words.starts):
            continue
        sizes = words.ends - words.starts
        member = _IN_WORD[lower]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        packed = pa.Array.from_buffers(
            pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(lower[member])]
        ).dictionary_encode()
        row = np.repeat(np.arange(first, last), np.diff(words.rows))
        breaks = np.cumsum(_ENDS[lower])[words.starts]
        followed = np.append((row[1:] == row[:-1]) & (breaks[1:] == breaks[:-1]), False)
        vocabulary, codes = packed.dictionary.to_pylist(), packed.indices.to_numpy()
        by_lang = which[row]
        for k in np.unique(by_lang).tolist():
            own = by_lang == k
            yield names.dictionary[k].as_py(), Tokens(vocabulary, codes[own], followed[own])


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, f`` of ``text, lang``: all occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, found in tokens(_column(batch, "text"), _column(batch, "lang")):
                f = np.bincount(found.codes, minlength=len(found.vocabulary))
                seen = np.flatnonzero(f)
                words = [found.vocabulary[k].decode() for k in seen.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(seen)), pa.array(words), pa.array(f[seen])], names=["lang", "word", "f"]
                )

    counted = docs.mapInArrow(run, "lang string, word string, f long")
    return counted.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _pair_counts(docs: DataFrame, hot: set[tuple[str, bytes]]) -> DataFrame:
    """``lang, word, next, f`` of the pairs that begin with one of the ``hot`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, found in tokens(_column(batch, "text"), _column(batch, "lang")):
                known = np.array([(lang, w) in hot for w in found.vocabulary])
                at = np.flatnonzero(known[found.codes] & found.followed)
                pairs, f = np.unique(found.codes[at].astype(np.int64) << 32 | found.codes[at + 1], return_counts=True)
                words = [[found.vocabulary[k].decode() for k in half.tolist()] for half in (pairs >> 32, pairs & 0xFFFFFFFF)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(f), pa.string()), *(pa.array(w, pa.string()) for w in words), pa.array(f, pa.int64())],
                    names=["lang", "word", "next", "f"],
                )

    counted = docs.mapInArrow(run, "lang string, word string, next string, f long")
    return counted.groupBy("lang", "word", "next").agg(F.sum("f").alias("f"))


def _hash(lang: str, word: bytes) -> int:
    return crc32(lang.encode() + b"\0" + word)


def _bit_hash(lang: Column, word: Column) -> Column:
    """What ``_hash`` is in tasks."""
    return F.crc32(F.concat(lang.cast("binary"), F.unhex(F.lit("00")), word.cast("binary")))


def _frequent_bits(words: DataFrame) -> bytes:
    """One bit for each word hash that has a word with LEAST occurrences."""
    bit = (_bit_hash(F.col("lang"), F.col("word")) % BITS).alias("bit") + 1  # positions begin at 1
    marked = words.where(F.col("f") >= LEAST).select(
        F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("place")
    )
    found = marked.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    whole = bytearray(BITS // 8)
    for row in found.collect():  # 4 KB each, BITS / 2**15 at most
        at = (row.bucket - 1) * 4096
        whole[at : at + 4096] = row.bits
    return bytes(whole)


def _keys(matrix: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows of codes below ``size`` as one or two sort keys."""
    wide = matrix.astype(np.uint64)
    if size <= 1 << 16:
        return [reduce(lambda key, k: key << np.uint64(16) | wide[:, k], range(1, LONGEST), wide[:, 0])]
    return [wide[:, k] << np.uint64(32) | wide[:, k + 1] for k in (0, 2)]


def _order(keys: list[np.ndarray]) -> np.ndarray:
    return np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])


def suffix_rows(
    lang: str, found: Tokens, bits: np.ndarray, groups: int, hot: set, hot_pairs: set
) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray]]:
    """Suffixes of two to four frequent words by group: words, rows of codes, counts.

    Code 0 stands for no word, code k for word k - 1 of the group's list.
    """
    hashes = np.array([_hash(lang, w) for w in found.vocabulary], dtype=np.uint64)
    place = hashes % np.uint64(BITS)
    often = (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
    new = np.zeros(len(often), dtype=np.int64)
    new[often] = np.arange(1, often.sum() + 1)
    codes = new[found.codes]
    follow = found.followed
    matrix = np.zeros((len(codes), LONGEST), dtype=np.int64)
    matrix[:, 0] = codes
    alive = codes > 0
    for k in range(1, LONGEST):
        alive = alive[:-1] & follow[k - 1 : len(codes) - 1] & (codes[k:] > 0)
        matrix[: len(alive), k] = np.where(alive, codes[k:], 0)
    matrix = matrix[matrix[:, 1] > 0]
    if not len(matrix):
        return
    words = [found.vocabulary[k] for k in np.flatnonzero(often).tolist()]
    keys = _keys(matrix, len(words) + 1)
    by = _order(keys)
    matrix = matrix[by]
    change = np.append(True, reduce(np.logical_or, [k[by][1:] != k[by][:-1] for k in keys]))
    at = np.flatnonzero(change)
    counts = np.diff(np.append(at, len(by)))
    matrix = matrix[at]

    word_hash = np.concatenate([np.zeros(1, np.uint64), hashes[often]])
    deal = word_hash[matrix[:, 0]]
    known = np.array([False] + [(lang, w) in hot for w in words])
    longer = known[matrix[:, 0]]
    if longer.any():
        pair = deal * np.uint64(0x9E3779B1) + word_hash[matrix[:, 1]]
        deal = np.where(longer, pair, deal)
        code = {w: k for k, w in enumerate(words, 1)}
        ends = [(code[a] << 32) + code[b] for g, a, b in hot_pairs if g == lang and a in code and b in code]
        whole = longer & np.isin((matrix[:, 0] << 32) + matrix[:, 1], np.array(ends, dtype=np.int64))
        for k in (2, 3):
            deal = np.where(whole, deal * np.uint64(0x9E3779B1) + word_hash[matrix[:, k]], deal)
    deal = (deal ^ (deal >> np.uint64(17))) * np.uint64(0xD6E8FEB86659FD93)
    group = ((deal >> np.uint64(20)) % np.uint64(groups)).astype(np.int64)
    by = np.argsort(group, kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(group[by])) + 1):
        used, inner = np.unique(matrix[part], return_inverse=True)
        inner = inner.reshape(-1, LONGEST)
        if used[0] > 0:
            inner = inner + 1
        yield int(group[part[0]]), [words[k - 1] for k in used.tolist() if k], inner, counts[part]


def _suffixes(docs: DataFrame, bits: bytes, groups: int, hot: set, hot_pairs: set) -> DataFrame:
    """``lang, grp, words, codes, counts``: for each group and chunk one row of packed suffixes."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(sent.value, dtype=np.uint8)
        for batch in batches:
            for lang, found in tokens(_column(batch, "text"), _column(batch, "lang")):
                rows = [
                    (lang, group, b" ".join(words), codes.astype("<u2" if len(words) < 1 << 16 else "<u4").tobytes(),
                     b"" if (counts == 1).all() else counts.astype("<u4").tobytes())
                    for group, words, codes, counts in suffix_rows(lang, found, marks, groups, hot, hot_pairs)
                ]
                types = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["lang", "grp", "words", "codes", "counts"]
                )

    return docs.mapInArrow(run, "lang string, grp int, words binary, codes binary, counts binary")


def subtree_counts(
    matrix: np.ndarray, counts: np.ndarray, words: list[bytes], least: int, partial: set[tuple[bytes, bytes]]
) -> Iterator[tuple[int, bytes, int]]:
    """Nodes of depth 2 and more with ``least`` occurrences: depth, phrase, count.

    The rows of ``matrix`` are leaves in any order. Nodes below a pair of ``partial`` that
    are no leaves are given whatever their count is.
    """
    by = _order(_keys(matrix, len(words) + 1))
    matrix, counts = matrix[by], counts[by]
    code = {w: k for k, w in enumerate(words, 1)}
    ends = [(code[a] << 32) + code[b] for a, b in partial if a in code and b in code]
    split = np.isin((matrix[:, 0] << 32) + matrix[:, 1], np.array(ends, dtype=np.int64))
    new = np.zeros(len(matrix), dtype=bool)
    new[0] = True
    for depth in range(1, LONGEST + 1):
        column = matrix[:, depth - 1]
        new[1:] |= column[1:] != column[:-1]
        if depth == 1:
            continue
        starts = np.flatnonzero(new)
        totals = np.add.reduceat(counts, starts)
        wanted = (totals >= least) | (split[starts] & (depth < LONGEST))
        wanted &= column[starts] > 0
        for row, total in zip(matrix[starts[wanted], :depth].tolist(), totals[wanted].tolist(), strict=True):
            yield depth, b" ".join([words[k - 1] for k in row]), total


def phrase_counts(docs: DataFrame, work: Workspace, words: DataFrame) -> DataFrame:
    """``lang, phrase, size, f`` of all phrases of 2 to 4 words with LEAST occurrences."""
    total = words.agg(F.sum("f")).first()[0] or 0
    groups = max(1, -(-2 * total // BUDGET))
    hot = {(r.lang, r.word.encode()) for r in words.where(F.col("f") > BUDGET).collect()}  # total / BUDGET at most
    pairs: set = set()
    if hot:
        often = _pair_counts(docs, hot).where(F.col("f") > BUDGET).collect()
        pairs = {(r.lang, r.word.encode(), r.next.encode()) for r in often}
    least = LEAST

    def read(held: pa.Table) -> pa.Table:
        lang = held.column("lang")[0].as_py()
        code: dict[bytes, int] = {}
        matrices, totals = [], []
        for names, packed, counts in zip(*(held.column(c).to_pylist() for c in ("words", "codes", "counts")), strict=True):
            own = names.split(b" ")
            to = np.array([0] + [code.setdefault(w, len(code) + 1) for w in own], dtype=np.int64)
            rows = np.frombuffer(packed, dtype="<u2" if len(own) < 1 << 16 else "<u4").reshape(-1, LONGEST)
            matrices.append(to[rows])
            totals.append(np.frombuffer(counts, dtype="<u4").astype(np.int64) if counts else np.ones(len(rows), np.int64))
        partial = {(a, b) for g, a, b in pairs if g == lang}
        found = list(subtree_counts(np.concatenate(matrices), np.concatenate(totals), list(code), least, partial))
        return pa.table(
            {
                "lang": pa.array([lang] * len(found), pa.string()),
                "phrase": pa.array([p.decode() for _, p, _ in found], pa.string()),
                "size": pa.array([d for d, _, _ in found], pa.int32()),
                "f": pa.array([n for _, _, n in found], pa.int64()),
            }
        )

    rows = _suffixes(docs, _frequent_bits(words), groups, hot, pairs)
    found = rows.groupBy("lang", "grp").applyInArrow(read, "lang string, phrase string, size int, f long")
    if pairs:
        found = found.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= LEAST)
    return work.table(found)


def _part(words: Column, first: int, count: int) -> Column:
    return F.array_join(F.slice(words, first, count), " ")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """The best ``top`` phrases of each language of ``text, lang``.

    Returns ``lang, rank, phrase, a, l, r, n, score``: occurrences of the phrase, of both sides of
    its weakest cut (the lowest score; of equal ones the first) and of all words. Counts cover
    whole texts of all rows, repeated rows included; a null text is empty, a null language is
    ``und``; other columns don't matter. A language without phrases has no rows.
    """
    work = Workspace(docs.sparkSession, "collocations")
    docs = docs.select("text", "lang")
    words = work.table(word_counts(docs))
    phrases = phrase_counts(docs, work, words)
    singles = words.where(F.col("f") >= LEAST).select("lang", F.col("word").alias("phrase"), "f")
    known = phrases.select("lang", "phrase", "f").unionByName(singles)

    parts = F.split("phrase", " ")
    cuts = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col("size") > k,
                    F.struct(
                        F.lit(k).alias("k"), _part(parts, 1, k).alias("first"),
                        _part(parts, k + 1, LONGEST).alias("rest"),
                    ),
                )
                for k in range(1, LONGEST)
            ]
        )
    )
    cut = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    for side, value in (("first", "l"), ("rest", "r")):
        cut = cut.join(known.select("lang", F.col("phrase").alias(side), F.col("f").alias(value)), ["lang", side])
    score = F.expr("2000000 * cast(a as decimal(28, 0)) div (l + r)")
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))

    inner = [
        F.when((F.col("size") > size) & (F.col("size") >= at + size - 1), _part(parts, at, size))
        for size in range(2, LONGEST)
        for at in range(1, LONGEST - size + 2)
    ]
    inside = phrases.where("size > 2").select("lang", "f", F.explode(F.array_compact(F.array(*inner))).alias("phrase"))
    covered = inside.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = scored.join(covered, ["lang", "phrase"], "left").where(F.expr(f"most is null or 100 * most < {COVER} * a"))
    kept = kept.select("lang", "phrase", "a", "b.*")

    # The best of each salted part first, so that no task orders all phrases of a language.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    local = Window.partitionBy("lang", "_salt").orderBy(*order)
    best = kept.withColumn("_salt", salt).withColumn("rank", F.row_number().over(local)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    found = ranked.where(F.col("rank") <= top).join(totals, "lang")
    return work.last(found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
