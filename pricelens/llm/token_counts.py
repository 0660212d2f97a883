"""Token counts that follow edits.

A text is cut into segments where a character that is no space is followed by a blank or a line
end: there a pre-token of the vocabulary's pattern always begins, whatever stands around, so
segments are encoded on their own and their counts add up. A segment tree over the segments
keeps sums of characters and tokens. An edit re-encodes the segments that it touches (with one
character of context on both sides) and updates the sums on their paths to the root.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Workspace, over_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEGMENT = 240  # characters of a segment, at least; it ends at the next safe place

# Fixed pattern of the vocabulary's pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: start, end (code points, end exclusive), text put in their place
Edit = tuple[int, int, str]
Counter = Callable[[list[str]], list[int]]


def counter(path: str = VOCABULARY) -> Counter:
    """A function that counts the tokens of texts; special tokens are ordinary text."""
    lines = Path(path).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]


def safe(text: str, at: int) -> bool:
    """A pre-token begins at ``at`` whatever the rest of the text is."""
    return 0 < at < len(text) and text[at] in " \n" and not text[at - 1].isspace()


def cuts(text: str, size: int = SEGMENT) -> list[int]:
    """Where the segments of a text begin, and its length at the end."""
    found, at, line = [0], size, -1
    while at < len(text):
        blank = text.find(" ", at)
        if line < at:  # looked for again only once it is passed
            line = text.find("\n", at)
            if line < 0:
                line = len(text)
        at = line if blank < 0 else min(blank, line)
        if at >= len(text):
            break
        if safe(text, at):
            found.append(at)
            at += size
        else:
            at += 1
    return [*found, len(text)] if text else [0]


class Tree:
    """Sums of characters and tokens over segments; node k has the children 2k and 2k + 1."""

    def __init__(self, sums: np.ndarray):
        self.sums = sums  # two rows (characters, tokens), 2 ** d columns twice
        self.leaves = sums.shape[1] // 2

    @classmethod
    def of(cls, lengths: list[int], tokens: list[int]) -> Tree:
        leaves = 1 << max(len(lengths) - 1, 0).bit_length()
        sums = np.zeros((2, 2 * leaves), np.int64)
        sums[0, leaves : leaves + len(lengths)] = lengths
        sums[1, leaves : leaves + len(tokens)] = tokens
        half = leaves
        while half > 1:
            sums[:, half // 2 : half] = sums[:, half : 2 * half : 2] + sums[:, half + 1 : 2 * half : 2]
            half //= 2
        return cls(sums)

    @classmethod
    def stored(cls, values: np.ndarray) -> Tree:
        """A tree from the array that a table keeps of it."""
        return cls(np.array(values, dtype=np.int64).reshape(2, -1))

    @property
    def segments(self) -> int:
        return int(np.count_nonzero(self.sums[0, self.leaves :]))

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def length(self) -> int:
        return int(self.sums[0, 1])

    def find(self, at: int) -> tuple[int, int]:
        """The segment that holds character ``at`` (the last one beyond the end) and its start."""
        node, start = 1, 0
        while node < self.leaves:
            node *= 2
            if at >= start + self.sums[0, node] and self.sums[0, node + 1] > 0:
                start += int(self.sums[0, node])
                node += 1
        return node - self.leaves, start

    def put(self, leaf: int, length: int, tokens: int) -> None:
        node = leaf + self.leaves
        change = np.array([length, tokens]) - self.sums[:, node]
        while node:
            self.sums[:, node] += change
            node //= 2


def build(text: str, count: Counter) -> Tree:
    at = cuts(text)
    parts = [text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return Tree.of([len(p) for p in parts], count(parts))


def edit(tree: Tree, text: str, change: Edit, count: Counter) -> tuple[str, int]:
    """The text after one edit, and how many characters were encoded for it.

    Positions outside the text are moved to its ends. The tree is updated in place; segments
    that an edit joins become one segment and empty ones.
    """
    start = min(max(change[0], 0), len(text))
    end = min(max(change[1], start), len(text))
    first, low = tree.find(max(start - 1, 0))
    last, begin = tree.find(min(end, max(len(text) - 1, 0)))
    high = begin + int(tree.sums[0, last + tree.leaves])
    new = text[:start] + change[2] + text[end:]
    region = new[low : high + len(new) - len(text)]
    tree.put(first, len(region), count([region])[0] if region else 0)
    for leaf in range(first + 1, last + 1):
        if tree.sums[0, leaf + tree.leaves]:
            tree.put(leaf, 0, 0)
    return new, len(region)


def apply_edits(tree: Tree, text: str, edits: list[Edit], count: Counter) -> tuple[str, int]:
    """All edits of one text; positions are those of the text before any of them. They are made
    from the last to the first, and one that overlaps a later one is cut off where that begins."""
    encoded, limit = 0, len(text)
    for start, end, put in sorted(edits, reverse=True):
        start, end = min(max(start, 0), limit), min(max(end, 0), limit)
        text, more = edit(tree, text, (start, max(end, start), put), count)
        encoded += more
        limit = start
    return text, encoded


_KEPT = "n_tokens bigint, n_segments bigint, sums array<bigint>"


def trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, text, n_tokens, n_segments, sums`` of each row: what is kept to count edits.

    ``sums`` is the segment tree, characters and then tokens of its nodes. A null text counts as
    empty and stays null; repeated rows give repeated results; extra columns are ignored.
    """

    def make():
        count = counter(vocabulary)

        def work(batch: pa.RecordBatch) -> dict:
            made = [build(value.as_py() or "", count) for value in batch.column(1)]
            return {
                "n_tokens": pa.array([t.tokens for t in made], pa.int64()),
                "n_segments": pa.array([t.segments for t in made], pa.int64()),
                "sums": pa.array([t.sums.ravel() for t in made], pa.list_(pa.int64())),
            }

        return work

    return over_batches(docs.select("doc_id", "text"), make, _KEPT, ["doc_id", "text"])


def edited(kept: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Kept trees after the edits of each row: only what an edit touches is encoded again.

    ``kept`` has the columns of :func:`trees` and ``edits``, an array of structs ``start, end, put``.
    Returns the columns of :func:`trees` after the edits, so that it can be edited again, and
    ``n_tokens_before, n_segments_before, n_edits, n_chars, n_chars_encoded``. Null edits and null
    entries count as none, null positions as 0 and a null ``put`` as the empty text. A null text is
    an empty one; after an edit it is a text.
    """
    entry = "struct<start:int,end:int,put:string>"
    changes = F.transform(
        F.filter("edits", lambda e: e.isNotNull()),
        lambda e: F.struct(
            F.coalesce(e["start"], F.lit(0)).cast("int").alias("start"),
            F.coalesce(e["end"], F.lit(0)).cast("int").alias("end"),
            F.coalesce(e["put"], F.lit("")).alias("put"),
        ),
    )
    changes = F.coalesce(changes, F.array().cast(f"array<{entry}>"))
    narrow = kept.select(
        F.col("text").alias("_text"), F.col("sums").alias("_sums"), F.to_json(changes).alias("_edits"),
        F.col("n_tokens").alias("n_tokens_before"), F.col("n_segments").alias("n_segments_before"), "doc_id",
    )
    names = ["n_edits", "n_chars", "n_chars_encoded"]

    def make():
        count = counter(vocabulary)

        def work(batch: pa.RecordBatch) -> dict:
            texts, found, rows = [], [], []
            for value, sums, listed in zip(*(batch.column(k) for k in range(3)), strict=True):
                text, edits = value.as_py(), [(e["start"], e["end"], e["put"]) for e in json.loads(listed.as_py())]
                tree = Tree.stored(sums.values.to_numpy())
                new, encoded = apply_edits(tree, text or "", edits, count)
                texts.append(new if edits or text is not None else None)
                found.append(tree)
                rows.append((len(edits), tree.length, encoded))
            made = {
                "text": pa.array(texts, pa.string()),
                "n_tokens": pa.array([t.tokens for t in found], pa.int64()),
                "n_segments": pa.array([t.segments for t in found], pa.int64()),
                "sums": pa.array([t.sums.ravel() for t in found], pa.list_(pa.int64())),
            }
            return made | {n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(names)}

        return work

    schema = f"text string, {_KEPT}, " + ", ".join(f"{n} bigint" for n in names)
    return over_batches(narrow, make, schema, ["doc_id", "n_tokens_before", "n_segments_before"])


def counted(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Counts before and after the edits of each row of ``doc_id, text, edits``.

    Trees are built, written to the shared folder, and edited there. Returns ``doc_id, n_tokens,
    n_segments, n_edits, n_tokens_edited, n_chars_edited, n_chars_encoded, sums``: the last is the tree
    after the edits. Special cases are those of :func:`trees` and :func:`edited`.
    """
    work = Workspace(docs.sparkSession, "trees")
    carried = docs.select("doc_id", "text", "edits")
    kept = work.last(_with_edits(carried, vocabulary))
    found = edited(kept, vocabulary)
    return found.select(
        "doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_segments_before").alias("n_segments"),
        "n_edits", F.col("n_tokens").alias("n_tokens_edited"), F.col("n_chars").alias("n_chars_edited"),
        "n_chars_encoded", "sums",
    )


def _with_edits(docs: DataFrame, vocabulary: str) -> DataFrame:
    """:func:`trees` of ``doc_id, text, edits`` that carries the edits along."""
    carried = docs.select(F.struct("doc_id", "edits").alias("doc_id"), "text")
    found = trees(carried, vocabulary)
    return found.select("doc_id.*", *[c for c in found.columns if c != "doc_id"])


def line_edits(text: str = "text"):
    """Edits that a clean-up of boilerplate makes: the first line goes, the last line is cut off
    at its first blank, and a mark is put in the middle. A text of one line keeps it."""
    own = F.coalesce(F.col(text), F.lit(""))
    size = F.length(own)
    head = F.locate("\n", own)
    tail = size - F.length(F.substring_index(own, "\n", -1))
    blank = F.locate(" ", F.substring_index(own, "\n", -1))
    some = head > 0

    def one(start, end, put):
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(put).alias("put"))

    made = F.array(
        F.when(some, one(F.lit(0), head, "")),
        one(F.floor(size / 2), F.floor(size / 2), "\n\n"),
        F.when(some & (blank > 0), one(tail + blank - 1, size, "")),
    )
    return F.filter(made, lambda e: e.isNotNull())
