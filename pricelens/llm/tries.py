"""Prefix trie of conversations: one row for each distinct beginning.

Conversations become rows of turn ids, sorted and dealt over range shards. A shard is read in
blocks of neighbouring rows. In a block the rows form a matrix padded with 0; ``lexsort`` orders
them, and a mask per column, OR-accumulated from left to right, marks where a beginning of that
many turns is new. These marks are the block's nodes, and ``reduceat`` over them gives their members.

Because the rows are sorted over all shards, a node is split between blocks only if it lies on the
path of a block's first or last row. These *open* nodes are written as partial sums, one path
after the other, and one ordered pass with a stack as deep as a path adds them up. That pass
sees two paths for each block of ``CELLS`` matrix cells; everything else stays distributed.

A node is known by 128 bits that chain the hashes of its turns; a turn is known by 64 bits, and
matters only among turns that follow the same beginning.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Workspace
from .words import mix

CELLS = 1 << 20  # cells of one padded matrix; a longer conversation is a block of its own
STEP = 20  # conversations that share a base
NO_ENDS = sha256(b"").hexdigest()
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

_CLOSED = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_MADE = (
    f"{_CLOSED}, kind string, key1 long, key2 long, up1 long, up2 long, words long, part long, block long, side int, ends string"
)


def words_of(text: Column) -> Column:
    """Number of words between the spaces of ASCII."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def rows_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns (id, words) in the order of ``turn``.

    A null turn comes first; turns with one number are ordered by role, then by a hash of the
    text. Null roles and texts are empty ones. Rows without conv_id belong to no conversation.
    One conversation is one row: the ids of its turns, not the texts, meet in a task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(
        F.col("turn").alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("id"), words_of(text).alias("words"),
    )
    named = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", turn.alias("t"))
    whole = named.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    slim = F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words")))
    return whole.select("conv_id", slim.alias("turns"))


def with_base_heads(rows: DataFrame) -> DataFrame:
    """Rebuilt conversations: the first h turns of conversation ``c - c % 20`` replace the own ones.

    h is the unsigned crc32 of the decimal id, modulo 4; ``c % 20`` has the sign of the id. A base
    that has fewer turns gives all, an absent one none; what is left of a conversation may be empty.
    """
    heads = rows.where(F.col("conv_id") % STEP == 0).select(
        F.col("conv_id").alias("_base"), F.slice("turns", 1, 3).alias("_head")
    )
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    empty = F.array().cast(rows.schema["turns"].dataType)
    joined = rows.withColumn("_base", F.col("conv_id") - F.col("conv_id") % STEP).join(heads, "_base", "left")
    head = F.slice(F.coalesce("_head", empty), F.lit(1), h)
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return joined.select("conv_id", F.concat(head, own).alias("turns"))


def _chain(key1: np.ndarray, key2: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mix(key1 * _ONE + turn + _TWO), mix(key2 * _TWO + (turn ^ _ONE) + _ONE)


def block_nodes(conv: np.ndarray, ids: list[np.ndarray], words: list[np.ndarray]) -> list[dict[str, np.ndarray]]:
    """The nodes of one block, a group of columns per depth; sums cover this block only.

    ``parent`` is the place of the parent among the nodes one depth up; ``open`` tells whether
    the node lies on the path of the first row (1) or only on that of the last one (2).
    """
    lengths = np.array([len(i) for i in ids], dtype=np.int64)
    depth, count = int(lengths.max()), len(conv)
    cell = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row = np.repeat(np.arange(count), lengths)
    flat = np.concatenate(ids) if len(row) else np.zeros(0, np.int64)
    known, code = np.unique(flat, return_inverse=True)
    matrix = np.zeros((count, depth), dtype=np.int32)
    matrix[row, cell] = code + 1
    weight = np.zeros((count, depth), dtype=np.int64)
    weight[row, cell] = np.concatenate(words) if len(row) else flat
    order = np.lexsort((conv, *matrix.T[::-1]))
    matrix, weight, lengths, conv = matrix[order], weight[order], lengths[order], conv[order]

    new = np.zeros(count, dtype=bool)
    new[0] = True
    levels = []
    place = np.zeros(count, dtype=np.int64)  # of each row's node, one depth up
    zero = np.zeros(1, dtype=np.uint64)
    for d in range(depth + 1):
        if d:
            new = new.copy()
            new[1:] |= matrix[1:, d - 1] != matrix[:-1, d - 1]
        starts = np.flatnonzero(new)
        real = lengths[starts] >= d
        first = starts[real]
        size = np.diff(np.append(starts, count))[real]
        level = {
            "first": first,
            "n": size,
            "conv": np.minimum.reduceat(conv, starts)[real],
            "words": weight[first, d - 1] if d else np.zeros(1, np.int64),
            "parent": place[first],
        }
        if d:
            above = levels[-1]
            turn = known[matrix[first, d - 1] - 1].view(np.uint64)
            level["key1"], level["key2"] = _chain(above["key1"][level["parent"]], above["key2"][level["parent"]], turn)
        else:
            level["key1"] = level["key2"] = zero
        place = np.searchsorted(first, np.arange(count), side="right") - 1
        on_first = first == 0
        on_last = (first + size == count) & ~on_first
        level["open"] = np.where(on_first, 1, np.where(on_last, 2, 0))
        ends = np.flatnonzero(lengths == d)
        level["ends"] = [conv[e] for e in np.split(ends, np.searchsorted(ends, first)[1:])] if len(first) else []
        levels.append(level)
    for d in range(depth, -1, -1):
        level = levels[d]
        below = levels[d + 1] if d < depth else None
        inner = level["n"] * 0
        children, leaves, saved = inner.copy(), inner.copy(), inner.copy()
        if below is not None:
            closed = below["open"] == 0
            up = below["parent"]
            np.add.at(children, up[closed], 1)
            np.add.at(leaves, up[closed], below["leaves"][closed])
            np.add.at(saved, up[closed], below["saved"][closed])
        closed = level["open"] == 0
        leaves[closed & (children == 0)] = 1
        saved[closed] += ((level["n"] - 1) * level["words"])[closed]
        level |= {"children": children, "leaves": leaves, "saved": saved}
    return levels


def _digest(ids: np.ndarray) -> str:
    return sha256(",".join(map(str, ids.tolist())).encode()).hexdigest() if len(ids) else NO_ENDS


def _block(part: int, block: int, rows: list) -> pa.RecordBatch:
    """A block's closed nodes, its open nodes as partial sums, and the ids that end in those."""
    levels = block_nodes(
        np.array([r[0] for r in rows], dtype=np.int64),
        [np.array(r[1], dtype=np.int64) for r in rows],
        [np.array(r[2], dtype=np.int64) for r in rows],
    )
    out: dict[str, list] = {f.name: [] for f in _SCHEMA}
    for d, level in enumerate(levels):
        above = levels[d - 1] if d else None
        up = level["parent"]
        count = len(up)
        closed = level["open"] == 0
        free = closed & (above["open"][up] == 0) if above is not None else closed
        signed = {k: level[k].view(np.int64) for k in ("key1", "key2")}
        over = {k: above[k].view(np.int64)[up] if above is not None else np.zeros(count, np.int64) for k in ("key1", "key2")}
        out["conv_id"].append(level["conv"])
        out["depth"].append(np.full(count, d))
        out["parent_conv_id"].append(np.where(free, above["conv"][up] if above is not None else 0, 0))
        out["n_convs"].append(level["n"])
        out["n_children"].append(level["children"])
        out["n_leaves"].append(level["leaves"])
        out["saved_tokens"].append(level["saved"])
        out["ends_sha256"] += [_digest(e) if c else None for e, c in zip(level["ends"], closed, strict=True)]
        out["kind"] += ["open" if not c else "free" if f else "below" for c, f in zip(closed, free, strict=True)]
        out["key1"].append(signed["key1"])
        out["key2"].append(signed["key2"])
        out["up1"].append(over["key1"])
        out["up2"].append(over["key2"])
        out["words"].append(level["words"])
        out["part"].append(np.full(count, part))
        out["block"].append(np.full(count, block))
        out["side"].append(level["open"].astype(np.int32))
        out["ends"] += [
            None if c or not len(e) else ",".join(map(str, e.tolist())) for e, c in zip(level["ends"], closed, strict=True)
        ]
    columns = [pa.array(v if f.type == pa.string() else np.concatenate(v), f.type) for f, v in zip(_SCHEMA, out.values(), strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


_SCHEMA = pa.schema(
    [
        (name, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind])
        for name, kind in (c.strip().split(" ") for c in _MADE.split(","))
    ]
)


def _blocks(rows: DataFrame, cells: int) -> DataFrame:
    """Nodes of all blocks of ``conv_id, ids, words``, sorted over range shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        held: list = []
        wide = 1
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                wider = max(wide, len(row[1]))
                if held and (len(held) + 1) * wider > cells:
                    yield _block(part, block, held)
                    held, block, wider = [], block + 1, max(len(row[1]), 1)
                held.append(row)
                wide = wider
        if held:
            yield _block(part, block, held)

    ranged = rows.repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    return ranged.mapInArrow(run, _MADE)


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open nodes added up, from partial sums in the order of paths: a stack of one path."""
    names = ["depth", "key1", "key2", "conv_id", "n_convs", "words", "n_children", "n_leaves", "saved_tokens"]
    stack: list[list] = []  # depth, key1, key2, conv, n, words, children, leaves, saved
    done: list[tuple] = []

    def pop() -> None:
        depth, key1, key2, conv, n, words, children, leaves, saved = stack.pop()
        leaves = leaves if children else 1
        saved += (n - 1) * words
        up1, up2 = (stack[-1][1], stack[-1][2]) if stack else (None, None)
        done.append((conv, depth, n, children, leaves, saved, key1, key2, up1, up2))
        if stack:
            stack[-1][6] += 1
            stack[-1][7] += leaves
            stack[-1][8] += saved

    def flush() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in done], pa.int64()) for k in range(10)],
            names=["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "key1", "key2", "up1", "up2"],
        )
        done.clear()
        return found

    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True):
            depth = row[0]
            same = depth < len(stack) and stack[depth][1:3] == list(row[1:3])
            if same:
                top = stack[depth]
                top[3] = min(top[3], row[3])
                for k in (4, 6, 7, 8):
                    top[k] += row[k]
            else:
                while len(stack) > depth:
                    pop()
                stack.append(list(row))
        if len(done) > 10000:
            yield flush()
    while stack:
        pop()
    yield flush()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the ids that end in each open node, from pieces in ascending order."""
    last, digest = None, None
    rows: list[tuple] = []
    for batch in batches:
        for key1, key2, ends in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if (key1, key2) != last:
                if last is not None:
                    rows.append((*last, digest.hexdigest()))
                last, digest = (key1, key2), sha256()
            else:
                digest.update(b",")
            digest.update(ends.encode())
        if rows:
            yield _ended(rows)
            rows = []
    if last is not None:
        yield _ended([*rows, (*last, digest.hexdigest())])


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["key1", "key2", "sha"])


def trie(rows: DataFrame) -> DataFrame:
    """All nodes of the trie over ``conv_id, turns`` (``rows_of`` or ``with_base_heads``).

    Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``. Conversations
    without turns end in the root. Equal conversations share their nodes. Without any
    conversation there is no node at all. A conversation id must be unique.
    """
    spark = rows.sparkSession
    work = Workspace(spark, "trie")
    ids = F.transform("turns", lambda t: t["id"]).alias("ids")
    words = F.transform("turns", lambda t: t["words"]).alias("words")
    ready = work.table(rows.select("conv_id", ids, words))  # ranges are drawn from a written table
    made = work.table(_blocks(ready, CELLS))
    partial = made.where("kind = 'open'")
    order = ["part", "block", "side", "depth"]
    one = partial.drop("ends").repartition(1).sortWithinPartitions(*order)
    schema = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, key1 long, key2 long, up1 long, up2 long"
    opened = work.table(one.mapInArrow(_finished, schema))
    pieces = partial.where("ends is not null").repartition("key1", "key2").sortWithinPartitions("key1", "key2", *order)
    digests = pieces.select("key1", "key2", "ends").mapInArrow(_ends, "key1 long, key2 long, sha string")
    full = opened.join(digests, ["key1", "key2"], "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(NO_ENDS)))

    # The nodes below an open node learn its smallest member. An open node, the root above all, can
    # have very many children; the few open nodes are repeated for every salt.
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below = made.where("kind = 'below'").select(*columns, "up1", "up2").unionByName(full.select(*columns, "up1", "up2"))
    salted = below.withColumn("_salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(salts)).cast("int"))
    parents = opened.select(
        F.col("key1").alias("up1"), F.col("key2").alias("up2"), F.col("conv_id").alias("parent_conv_id"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
    )
    named = salted.join(parents.hint("shuffle_hash"), ["up1", "up2", "_salt"], "left")
    names = [c.split(" ")[0] for c in _CLOSED.split(", ")]
    free = made.where("kind = 'free'").select(*names)
    return work.last(free.unionByName(named.select(*names)))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of ``conv_id, turn, role, text``."""
    return trie(with_base_heads(rows_of(conversations.select("conv_id", "turn", "role", "text"))))
