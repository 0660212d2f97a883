"""Repeated passages against brute force over all strings of 400 bytes."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.llm import repeats
from pricelens.llm.words import mix


def brute(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, sha256(kept).hexdigest()))
    return out


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(n))


def check(docs, texts, **columns):
    df = docs(list(enumerate(texts)))
    for name, value in columns.items():
        df = df.withColumn(name, F.lit(value))
    rows = repeats.remove_repeats(df).orderBy("doc_id").collect()
    got = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows]
    assert got == brute(texts)
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    return rows


def test_block_against_brute_force():
    rng = random.Random(3)
    for trial in range(60):
        length = rng.choice([2, 3, 5, 12])
        parts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(3)]
        contexts = ["".join(rng.choices(parts, k=rng.randint(1, 8))) for _ in range(rng.randint(1, 6))]
        weights = np.array([rng.choice([1, 1, 1, 2]) for _ in contexts])
        seen = Counter()
        for c, w in zip(contexts, weights.tolist(), strict=True):
            for i in range(len(c) - length + 1):
                seen[c[i : i + length]] += w
        wanted = {(k, i) for k, c in enumerate(contexts) for i in range(len(c) - length + 1) if seen[c[i : i + length]] > 1}
        arrays = [np.frombuffer(c.encode(), dtype=np.uint8) for c in contexts]
        found = repeats.block_ranges(arrays, weights, length)
        got = {(int(k), i) for k, a, b in zip(*found.values(), strict=True) for i in range(a, b)}
        assert got == wanted, (trial, length, contexts)


def test_suffix_order():
    rng = np.random.default_rng(2)
    for _ in range(30):
        pieces = [rng.integers(1, 4, rng.integers(0, 60)).astype(np.uint16) for _ in range(5)]
        symbols = np.concatenate([np.append(p, 0) for p in pieces]).astype(np.uint16)
        ends = np.flatnonzero(symbols == 0)
        named = symbols.astype(np.int64) + len(ends)
        named[ends] = np.arange(len(ends))  # every end is a symbol of its own
        wanted = sorted(range(len(symbols)), key=lambda i: named[i : ends[np.searchsorted(ends, i)] + 1].tolist())
        assert repeats.suffixes(symbols).tolist() == wanted


def test_runs_cover_each_start_once():
    rng = np.random.default_rng(1)
    hasher = repeats.Hasher(1 << 14)
    data = rng.integers(97, 100, 9000).astype(np.uint8)
    data[3000:5000] = 97  # one byte over and over
    bounds = np.array([0, 10, 10, 4800, 9000])
    for gram in repeats.GRAMS:
        found = repeats.runs_of(data, bounds, gram, hasher)
        starts = [
            (int(p), int(s) + k) for p, s, n in zip(found["part"], found["start"], found["n"], strict=True) for k in range(n)
        ]
        wanted = [(p, s) for p in range(4) for s in range(bounds[p + 1] - bounds[p] - 399)]
        assert sorted(starts) == wanted
        by = {}
        for p, s, m in ((int(p), int(s) + k, int(m)) for p, s, n, m in zip(found["part"], found["start"], found["n"], found["m"], strict=True) for k in range(n)):
            by.setdefault(data[bounds[p] + s :][:400].tobytes(), set()).add(m)
        assert all(len(m) == 1 for m in by.values())
    assert mix(np.array([1], np.uint64))[0] != 1


def test_passages_copies_and_edges(docs):
    rng = random.Random(5)
    shared, other = prose(rng, 130), prose(rng, 300)
    exact = prose(rng, 200)
    texts = [
        prose(rng, 50) + shared + prose(rng, 40), shared + prose(rng, 5), prose(rng, 90) + shared,
        exact, exact, exact, None, "", "short", "short", prose(rng, 400),
        other + "x" + other[:700] + "y" + other[300:], "ab" * 1500, "q" * 399, "z" * 400, "z" * 401,
        shared[:399], "w" * 100 + shared[:398], shared[5:],
    ]
    check(docs, texts, key1="a", KEY2="b", m=1, start=2, spans="s", n_bytes="n", _ranges=0)


@pytest.mark.parametrize("seed", range(3))
def test_random_edits(docs, seed):
    rng = random.Random(seed)
    base = [prose(rng, 250) for _ in range(3)]
    texts = []
    for _ in range(25):
        t = "".join(rng.choice(base)[rng.randint(0, 400) :][: rng.randint(300, 1400)] for _ in range(rng.randint(1, 3)))
        cut = rng.randint(0, len(t))
        texts.append(t[:cut] + rng.choice(["", "#", "##"]) + t[cut:])
    check(docs, texts)


def test_hot_passage_is_split(docs, monkeypatch):
    rng = random.Random(9)
    line, long = prose(rng, 60)[:250], prose(rng, 150)[:396]
    texts = [prose(rng, 60) + line + prose(rng, 60) for _ in range(15)]
    texts += [prose(rng, 60) + long + prose(rng, 60) for _ in range(15)]
    texts += [texts[0], texts[20][:900], "-" + long + long, "-" + long + long]
    monkeypatch.setattr(repeats, "BLOCK", 1 << 11)
    check(docs, texts)


def test_long_text_in_segments(docs, monkeypatch):
    rng = random.Random(4)
    passage = prose(rng, 200)
    long = prose(rng, 2000) + passage + prose(rng, 3000) + "0" * 5000 + passage
    monkeypatch.setattr(repeats, "SEGMENT", 1 << 11)
    check(docs, [long, prose(rng, 20) + passage, "0" * 450])


def test_empty_table(docs):
    assert repeats.remove_repeats(docs([])).collect() == []
    assert repeats.report(docs([(1, None), (None, "a")])).count() == 2
