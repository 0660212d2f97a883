import random
import re

import numpy as np
import pytest

from pricelens.llm import components, similarity, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    own = WORD.findall((text or "").translate(LOWER))
    return {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()


def brute(rows):
    """doc_id -> n_shingles, component, links of rows with different ids."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(sets, 0)
    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 80 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), links[i]) for i in sets}


def corpus(seed, families=6, copies=12, hot=90):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(400)
    texts = []
    passage = [word() for _ in range(60)]
    for f in range(families):
        base = [word() for _ in range(rng.choice([4, 8, 30, 120, 300]))]
        for _ in range(hot if f == 0 else copies):
            own = list(base if f else passage + base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    for _ in range(30):  # unrelated documents that share a passage
        texts.append(" ".join([word() for _ in range(rng.randrange(200))] + passage))
    texts += ["", "one", "ONE", "one two", "a b c d", "A b c d", "a b c d e", " \t\n", texts[0], texts[0]]
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("seed", [1, 2])
def test_all_links_and_classes(docs, seed, monkeypatch):
    rows = corpus(seed)
    # Small limits, so that combinations, long lists, split keys and several blocks are met.
    monkeypatch.setattr(similarity, "FREQUENT", 6)
    monkeypatch.setattr(similarity, "BLOCK_TOKENS", 4000)
    found = similarity.jaccard_classes(docs(rows))
    assert found.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == brute(rows)


def test_given_limits(docs):
    rows = corpus(3)
    found = similarity.jaccard_classes(docs(rows)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == brute(rows)


def test_odd_rows(docs, clashing):
    long = " ".join(f"x{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"),
            (5, "A B c d e f"), (6, long), (7, long + " y"), (8, "q" * 200_000)]
    found = similarity.jaccard_classes(clashing(docs(rows))).collect()
    got = sorted([(r.doc_id or 0, r.n_shingles, r.component_id) for r in found], key=str)
    assert got == sorted(
        [(1, 0, 1), (2, 0, 2), (3, 2, 3), (3, 2, 3), (0, 2, None), (5, 2, 3), (6, 29_996, 6), (7, 29_997, 6), (8, 1, 8)],
        key=str,
    )
    assert similarity.jaccard_classes(docs([])).collect() == []


def test_rows_of_one_id_are_one_vertex(docs):
    rows = [(1, "a b c d e f g h"), (2, "z y x w v u t"), (1, "z y x w v u t")]
    found = similarity.jaccard_classes(docs(rows)).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(1, 1), (2, 1)}


def test_prefix_finds_partners():
    """Any two sets that link meet in a key, whatever tokens are frequent."""
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(2, 60))
        base = np.unique(rng.integers(0, 10**6, n).astype(np.uint64))
        other = base[rng.random(len(base)) > 0.1]
        other = np.unique(np.append(other, rng.integers(0, 10**6, int(rng.integers(0, 4))).astype(np.uint64)))
        shared = len(np.intersect1d(base, other))
        if len(other) < 2 or len(base) < 2 or not similarity.linked(shared, len(base), len(other)):
            continue
        frequent = np.sort(rng.permutation(np.union1d(base, other))[: int(rng.integers(0, len(base) + 1))])
        weights = np.full(len(frequent), 100)
        keys = [np.concatenate(similarity.index_entries(s, frequent, weights)[:2]) for s in (base, other)]
        assert len(np.intersect1d(*keys))


def test_components_of_a_path(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, 500), (None, 3), (700, 650), (650, 600)]
    found = components.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    got = {r.vertex: r.root for r in found.collect()}
    assert got == {k: 0 for k in range(201)} | {700: 600, 650: 600, 600: 600}


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    texts = ["a", "ab", "b", "x" * 8, "x" * 9, "x" * 16, "x" * 17, "x" * 64, "x" * 65, "x" * 66, "é", "e"]
    found = []
    for _, _, data, bounds in words.chunks(pa.array(texts)):
        found += words.Words(data, bounds, words.NOT_SPACE).hashes().tolist()
    assert len(set(found)) == len(texts)


@pytest.mark.parametrize("seed", [4])
def test_long_lists_of_tokens_taken_for_rare(docs, seed, monkeypatch):
    """No token is known to be frequent: passages make long lists, pairs meet in several."""
    monkeypatch.setattr(similarity, "FREQUENT", 10**9)
    monkeypatch.setattr(similarity, "LONG_LIST", 8)
    monkeypatch.setattr(similarity, "BLOCK_TOKENS", 3000)
    rows = corpus(seed)
    found = similarity.jaccard_classes(docs(rows)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == brute(rows)
