"""N-gram Jaccard join by token-combination prefixes.

Tokens of a document are its distinct five-word shingles. All documents order their tokens
alike: rare ones first, then those of the frequent class. With n tokens, at least
o = ceil(0.8 n) must be shared with any partner, so:

* the n - o + 1 first tokens of two partners meet. Rare tokens among them are indexed singly;
* partners that share no rare token share only frequent ones. Their prefix is extended to
  n - o + l tokens, l = floor(n / 4) + 2, of which partners share l or more. At most l - 2
  tokens (a quarter of the overlap) are in one of them only, so two shared tokens stand next
  to each other in both orders: neighbours are indexed as combinations of two tokens.

The index therefore grows in proportion to the documents. A short posting list gives pairs
with counts; these and what is left of both documents behind the last shared token must
reach the overlap that the pair needs. A long list joins its documents to one block group instead of listing their pairs. Block groups are verified in
blocks of bounded size by counting shared tokens, and give links as spanning forests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import cut, mapped
from .words import chunks, mix, shingle_sets

FREQUENT = 12  # documents from which a token is of the frequent class
TOP_TOKENS = 200_000  # frequent tokens that are sent to all tasks (3.2 MB); others count as rare
LONG_LIST = 48  # documents from which a posting list gives no pairs but a block group
SPLIT = 4096  # documents of a combination that are indexed in one place
BLOCK_TOKENS = 1 << 17  # tokens of one block while verifying
SHINGLE = 5
POSITION = 1 << 32  # size * POSITION + position of the token

_COMBINED = np.uint64(0x8CB92BA72F3D8DD7)


def overlap_needed(n):
    """Tokens that a set of n must share with any partner: ceil(0.8 n)."""
    return -(-4 * n // 5)


def linked(shared, n_a, n_b):
    """Shared tokens are 80 % of the union or more."""
    return 100 * shared >= 80 * (n_a + n_b - shared)


def set_key(tokens: np.ndarray) -> int:
    """One signed 64-bit number for a whole set."""
    total = mix(tokens ^ _COMBINED).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def sets(docs: DataFrame) -> DataFrame:
    """``doc_id, set_key, n`` of each row of ``doc_id, text``."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            ids = batch.column(0)
            for low, high, data, bounds in chunks(batch.column(1)):
                found = shingle_sets(data, bounds, SHINGLE)
                yield {
                    "doc_id": ids.slice(low, high - low),
                    "set_key": pa.array([set_key(s) for s in found], pa.int64()),
                    "n": pa.array([len(s) for s in found], pa.int64()),
                }

        return work

    return mapped(docs.select("doc_id", "text"), make, "doc_id bigint, set_key bigint, n bigint")


def frequent_tokens(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The heaviest tokens, sorted, and about how many different sets hold each.

    A task counts a token in the different sets of each stretch of its rows and reports it if it
    comes twice there, so what is shuffled is the repeated part only. The class only orders
    tokens and guides splitting: any estimate gives the same links.
    """

    def make():
        seen: set[int] = set()

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            held: list[np.ndarray] = []
            size = 0

            def report() -> dict:
                tokens, counts = np.unique(np.concatenate(held), return_counts=True)
                often = counts > 1
                return {
                    "token": pa.array(tokens[often].view(np.int64)),
                    "docs": pa.array(counts[often].astype(np.int64)),
                }

            for _, _, data, bounds in chunks(batch.column(0)):
                for tokens in shingle_sets(data, bounds, SHINGLE):
                    key = set_key(tokens)
                    if len(tokens) and key not in seen:
                        seen.add(key)
                        held.append(tokens)
                        size += len(tokens)
                if size > 4_000_000:
                    yield report()
                    held, size = [], 0
            if held:
                yield report()

        return work

    counted = mapped(docs.select("text"), make, "token bigint, docs bigint")
    top = (
        counted.groupBy("token")
        .agg(F.sum("docs").alias("docs"))
        .where(F.col("docs") >= FREQUENT)
        .orderBy(F.desc("docs"), "token")
        .limit(TOP_TOKENS)
        .toPandas()
    )
    tokens = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], top["docs"].to_numpy(np.int64)[order]


def index_entries(
    tokens: np.ndarray, frequent: np.ndarray, weights: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Keys of one set: single tokens, combinations, weight of each combination, and whether
    the prefix reaches the frequent class."""
    n = len(tokens)
    need = overlap_needed(n)
    if len(frequent):
        place = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        often = frequent[place] == tokens
    else:
        often = np.zeros(n, bool)
    rare = tokens[~often]
    if len(rare) > n - need:
        return rare[: n - need + 1], tokens[:0], np.zeros(0, np.int64), False
    chosen = np.flatnonzero(often)[: n - need + n // 4 + 2 - len(rare)]
    common, weight = tokens[chosen], weights[place[chosen]]
    pairs = mix(mix(common[:-1] ^ _COMBINED) + common[1:])
    return rare, pairs, np.minimum(weight[:-1], weight[1:]), True


def postings(docs: DataFrame, frequent: np.ndarray, weights: np.ndarray) -> DataFrame:
    """The index: ``key, node, n, parent``. n holds the size of the set and, in the low half, the
    position of a single token; it is negative for prefixes that reach the frequent class.
    parent is not 0 where one combination is kept in several places."""

    def make():
        seen: set[int] = set()

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for _, _, data, bounds in chunks(batch.column(0)):
                keys, nodes, sizes, parents, counts = [], [], [], [], []
                for tokens in shingle_sets(data, bounds, SHINGLE):
                    if len(tokens) < 2:
                        continue
                    node = set_key(tokens)
                    if node in seen:
                        continue
                    seen.add(node)
                    single, pair, weight, reaches = index_entries(tokens, frequent, weights)
                    places = weight // SPLIT + 1
                    own = np.uint64(node & (2**64 - 1)) % places.astype(np.uint64)
                    split = np.where(places > 1, mix(pair + own + np.uint64(1)), pair)
                    keys += [single, split]
                    parents += [np.zeros(len(single), np.uint64), np.where(places > 1, pair, 0)]
                    nodes.append(node)
                    counts.append(len(single) + len(pair))
                    place = np.append(np.arange(1, len(single) + 1), np.zeros(len(pair), np.int64))
                    sizes.append((len(tokens) * POSITION + place) * (-1 if reaches else 1))
                if keys:
                    yield {
                        "key": pa.array(np.concatenate(keys).view(np.int64)),
                        "node": pa.array(np.repeat(np.array(nodes, np.int64), counts)),
                        "n": pa.array(np.concatenate(sizes).astype(np.int64)),
                        "parent": pa.array(np.concatenate(parents).astype(np.uint64).view(np.int64)),
                    }

        return work

    return mapped(docs.select("text"), make, "key bigint, node bigint, n bigint, parent bigint")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Sorted postings, repeated ones left out, so that every list but a long one is whole.

    A list that goes on in the next batch is held back while it is short; of a long one the
    first posting goes in front of the rest, so that all parts meet in the same node.
    """
    held = None
    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)])
        if held is not None:
            rows = np.concatenate([held, rows], axis=1)
        if not rows.shape[1]:
            continue
        key, node = rows[0], rows[1]
        same = (key[1:] == key[:-1]) & (node[1:] == node[:-1])
        rows = rows[:, np.concatenate(([True], ~same))]
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        tail = rows[:, last:]
        if tail.shape[1] > LONG_LIST:
            yield tuple(rows)
            held = tail[:, : LONG_LIST + 1]
        else:
            if last:
                yield tuple(rows[:, :last])
            held = tail
    if held is not None and held.shape[1]:
        yield tuple(held)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["a", "b", "n_a", "n_b", "shared", "rest"]

    def out(*values):
        columns = [pa.array(np.asarray(x, np.int64)) for x in values]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for key, node, n, parent in _lists(batches):
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        length = np.diff(np.append(first, len(key)))
        wide = np.repeat((length > LONG_LIST) | (parent[first] != 0), length)
        center = np.repeat(node[first], length)
        zero = np.zeros(int(wide.sum()), np.int64)
        if wide.any():
            alone = n % POSITION != 0  # lists of single tokens; of combinations else
            other = np.where(alone, key, center)[wide]
            yield out(node[wide], other, zero, alone[wide], zero, zero)
            kept = first[parent[first] != 0]
            none = np.zeros(len(kept), np.int64)
            yield out(node[kept], parent[kept], none, none, none, none)
        for size in np.unique(length[(length > 1) & (length <= LONG_LIST)]).tolist():
            at = first[(length == size) & (parent[first] == 0)]
            left, right = np.triu_indices(size, 1)
            for part in np.array_split(at, len(at) * len(left) // 500_000 + 1):
                a, b = (part[:, None] + left).ravel(), (part[:, None] + right).ravel()
                n_a, n_b = np.abs(n[a]) // POSITION, np.abs(n[b]) // POSITION
                fits = np.minimum(n_a, n_b) >= overlap_needed(np.maximum(n_a, n_b))
                a, b, n_a, n_b = a[fits], b[fits], n_a[fits], n_b[fits]
                rest = np.minimum(n_a - np.abs(n[a]) % POSITION, n_b - np.abs(n[b]) % POSITION)
                one = np.ones(len(a), np.int64)
                yield out(node[a], node[b], n_a * np.sign(n[a]), n_b * np.sign(n[b]), one, rest)


def candidates(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges ``a, b``: pairs of sets that may be partners, and stars of long combination lists;
    and ``node, root``: the sets of each long list of a single token, equal lists once."""
    dealt = index.repartition("key").sortWithinPartitions("key", "node")
    schema = "a bigint, b bigint, n_a bigint, n_b bigint, shared bigint, rest bigint"
    found = dealt.mapInArrow(_candidates, schema).groupBy("a", "b", "n_a", "n_b")
    found = found.agg(F.sum("shared").alias("shared"), F.min("rest").alias("rest"))
    small, large = F.least(F.abs("n_a"), F.abs("n_b")), F.greatest(F.abs("n_a"), F.abs("n_b"))
    # The smallest s with 100 s >= 80 (n_a + n_b - s).
    needed = F.ceil((small + large) * 4 / F.lit(9))
    # Tokens behind the last shared one, and behind the prefix that ends first.
    more = F.least(F.col("rest"), F.ceil(large * 4 / F.lit(5)) - 1)
    reach = (F.col("n_a") < 0) & (F.col("n_b") < 0)
    wide = F.col("n_a") == 0
    kept = found.where(wide | reach | (F.col("shared") + more >= needed))
    kept = cut(kept.select("a", "b", (wide & (F.col("n_b") == 1)).alias("listed")))
    members = kept.where("listed").select(F.col("a").alias("node"), F.col("b").alias("key")).distinct()
    # Tokens of one passage have the same documents: such lists are checked once.
    lists = members.groupBy("key").agg(
        F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("content"), F.count(F.lit(1)).alias("size")
    )
    first = lists.groupBy("content", "size").agg(F.min("key").alias("key")).select("key")
    members = members.join(first, "key").select("node", F.col("key").alias("root"))
    return kept.where("not listed").select("a", "b"), members


def _count_shared(members: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token sets as one list of local token numbers, for tokens of more than one set."""
    owner = np.repeat(np.arange(len(members)), [len(m) for m in members])
    tokens, number, count = np.unique(
        np.concatenate(members), return_inverse=True, return_counts=True
    )
    often = count[number] > 1
    return number[often], owner[often], np.cumsum(np.append(0, np.where(count > 1, count, 0)))


def block_links(
    members: list[np.ndarray],
    weight: np.ndarray,
    first: np.ndarray,
    second: np.ndarray,
    here: Callable[[int, int], bool] = lambda x, y: True,
) -> tuple[list[tuple[int, int]], np.ndarray]:
    """All linked pairs between the sets of two sides: a spanning forest, and the weight of
    the partners of each set.

    ``first`` and ``second`` say which sets belong to which side; within one block both do.
    ``here`` says of a linked pair whether it is counted in this group.
    """
    sizes = np.array([len(m) for m in members])
    label = np.arange(len(members))
    degree = np.zeros(len(members), np.int64)
    number, owner, begin = _count_shared(members)
    by_token = owner[np.argsort(number, kind="stable")]
    start = np.searchsorted(owner, np.arange(len(members) + 1))
    forest = []
    for x in np.flatnonzero(first).tolist():
        own = number[start[x] : start[x + 1]]
        if not len(own):
            continue
        low, length = begin[own], begin[own + 1] - begin[own]
        skipped = np.append(0, np.cumsum(length)[:-1])
        spots = np.arange(length.sum()) + np.repeat(low - skipped, length)
        shared = np.bincount(by_token[spots], minlength=len(members))
        partner = second & linked(shared, sizes[x], sizes) & (shared > 0)
        partner[first] &= np.flatnonzero(first) > x  # a pair inside one block is taken once
        found = np.array([y for y in np.flatnonzero(partner).tolist() if here(x, y)], np.int64)
        degree[x] += weight[found].sum()
        degree[found] += weight[x]
        apart = found[label[found] != label[x]]
        for y in apart[np.unique(label[apart], return_index=True)[1]].tolist():
            forest.append((x, y))
            label[label == label[y]] = label[x]
    return forest, degree


def _verify(table: pa.Table) -> pa.Table:
    nodes, copies, sides, members, homes, lists = [], [], [], [], [], []
    seen = set()
    for batch in table.to_batches():
        named = dict(zip(batch.schema.names, batch.columns, strict=True))
        i, j = named["i"][0].as_py(), named["j"][0].as_py()
        found = []
        for _, _, data, bounds in chunks(named["text"]):
            found += shingle_sets(data, bounds, SHINGLE)
        root, listed = named["root"][0].as_py(), named["listed"][0].as_py()
        columns = (named[c].to_pylist() for c in ("node", "copies", "block", "home", "lists"))
        for node, count, block, home, own, tokens in zip(*columns, found, strict=True):
            if (node, set_key(tokens)) not in seen:  # else the same row once more
                seen.add((node, set_key(tokens)))
                nodes.append(node)
                copies.append(count)
                sides.append(block)
                members.append(tokens)
                homes.append(home)
                lists.append(set(own or ()))

    def here(x: int, y: int) -> bool:
        """A pair that meets in several groups counts in its block group, else its first list."""
        if not listed:
            return True
        return (homes[x] is None or homes[x] != homes[y]) and min(lists[x] & lists[y]) == root

    side, named_nodes = np.array(sides), np.array(nodes, np.int64)
    forest, degree = block_links(members, np.array(copies), side == i, side == j, here)
    ends = np.array(forest, np.int64).reshape(-1, 2)
    some = np.flatnonzero(degree)
    columns = {
        "a": np.concatenate([named_nodes[ends[:, 0]], named_nodes[some]]),
        "b": np.concatenate([named_nodes[ends[:, 1]], named_nodes[some]]),
        "links": np.concatenate([np.zeros(len(ends), np.int64), degree[some]]),
    }
    return pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()})


def verified(docs: DataFrame, classes: DataFrame, groups: DataFrame, lists: DataFrame) -> DataFrame:
    """``a, b, links``: forests of links between sets, and (a = b) the links of each set."""
    home = groups.select("node", F.col("root").alias("home"))
    own = lists.groupBy("node").agg(F.collect_set("root").alias("lists"))  # at most the prefix
    member = groups.withColumn("listed", F.lit(False)).unionByName(lists.withColumn("listed", F.lit(True)))
    member = member.join(classes, "node").join(home, "node", "left").join(own, "node", "left")
    sizes = member.groupBy("root").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("sets"))
    blocks = F.ceil(F.col("tokens") / F.lit(BLOCK_TOKENS)).cast("int")
    sizes = sizes.where("sets > 1").select("root", blocks.alias("blocks"))
    placed = member.join(sizes, "root").withColumn("block", F.expr("cast(pmod(node, blocks) as int)"))
    others = F.expr("transform(sequence(0, blocks - 1), k -> struct(least(block, k) as i, greatest(block, k) as j))")
    kept = ["node", "root", "listed", "copies", "block", "home", "lists"]
    spread = placed.select("doc_id", *kept, F.explode(others).alias("to"))
    texts = docs.select("doc_id", "text").join(spread.hint("shuffle_hash"), "doc_id")
    texts = texts.select(*kept, "to.i", "to.j", "text")
    return texts.groupBy("root", "i", "j").applyInArrow(_verify, "a bigint, b bigint, links bigint")


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for each row of ``doc_id, text``.

    component_id is the smallest doc_id that links lead to, n_links the number of other rows
    linked directly. Null and wordless texts have no shingles and no links. Rows of one doc_id
    are one vertex; a row without doc_id links nothing and has no component. Extra columns are
    ignored, an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    own = cut(sets(docs))
    known = own.where("doc_id is not null and n > 0")
    classes = known.groupBy(F.col("set_key").alias("node")).agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")
    )
    texts = docs.where("doc_id is not null")
    frequent, weights = frequent_tokens(texts)
    edges, lists = candidates(postings(texts, frequent, weights))
    groups = components(edges).select(F.col("vertex").alias("node"), "root")
    checked = cut(verified(docs, classes, groups, lists))
    # Vertices are doc_ids from here on: sets stand for their smallest document.
    first = classes.select("node", F.col("doc_id").alias("first"))
    forest = checked.where("a != b").select("a", "b")
    named = forest.join(first.select(F.col("node").alias("a"), F.col("first").alias("x")), "a")
    named = named.join(first.select(F.col("node").alias("b"), F.col("first").alias("y")), "b")
    near = named.select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = known.join(first, known.set_key == first.node).where("doc_id != first")
    repeated = known.groupBy("doc_id").agg(F.count_distinct("set_key").alias("k")).where("k > 1")
    same = same.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    # An exact copy has one edge, so only copies whose doc_id has several texts need the walk.
    copies = same.join(repeated.select(F.col("doc_id").alias("a")), "a", "left_semi")
    joined = components(near.unionByName(copies)).select(F.col("vertex").alias("first"), "root")
    degrees = checked.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    per_set = classes.join(degrees, "node", "left").select(
        "node", F.col("doc_id").alias("first"), "copies", F.coalesce("links", F.lit(0)).alias("links")
    )
    per_set = per_set.join(joined, "first", "left").select(
        "node", F.coalesce("root", "first").alias("root"),
        (F.col("links") + F.col("copies") - 1).alias("n_links"),
    )
    linked_rows = own.join(per_set, (own.set_key == per_set.node) & (own.n > 0) & own.doc_id.isNotNull(), "left")
    return linked_rows.select(
        own.doc_id, own.n.alias("n_shingles"),
        F.coalesce("root", own.doc_id).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
