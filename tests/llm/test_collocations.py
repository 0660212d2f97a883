"""Phrases against plain counting of all windows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.llm import collocations


def brute(rows, least, top=2000):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for d in range(1, 5):
                for i in range(len(words) - d + 1):
                    counts[lang, tuple(words[i : i + d])] += 1
    often = {k: f for k, f in counts.items() if f >= least}
    cover = Counter()
    for (lang, w), f in often.items():
        for d in range(2, len(w)):
            for i in range(len(w) - d + 1):
                cover[lang, w[i : i + d]] = max(cover[lang, w[i : i + d]], f)
    out = {}
    for (lang, w), a in often.items():
        if len(w) < 2 or (cover[lang, w] and 100 * cover[lang, w] >= 80 * a):
            continue
        cuts = [(counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w))]
        score, _, l, r = min((2000000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(cuts))
        out.setdefault(lang, []).append((score, a, " ".join(w), l, r))
    rows = []
    for lang, found in out.items():
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        rows += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(found[:top])]
    return sorted(rows)


def made(df, **more):
    found = collocations.collocations(df, **more)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in found.collect())


def corpus(seed, rows=60, words=8):
    rng = random.Random(seed)
    vocabulary = ["The", "é", "b", "New", "york", "x-y", "z", "Ünder", "\x00", "q" * 80][:words]
    out = []
    for _ in range(rows):
        parts = []
        for _ in range(rng.randint(0, 80)):
            parts.append(rng.choice(["new York city hall", rng.choice(vocabulary), rng.choice(vocabulary), f"rare{rng.randint(0, 9999)}"]))
        text = "".join(p + rng.choice([" ", " ", "\t ", ". ", ",", "\n"]) for p in parts)
        out.append((rng.choice(["en", "en", "en", "fr", None, "und"]), rng.choice([text, text, text, "", None])))
    return out


def frame(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(parts)
    return df.withColumn("phrase", F.lit("p")).withColumn("f", F.lit(1)).withColumn("grp", F.lit("g"))


@pytest.mark.parametrize("budget", [1 << 21, 400, 60])
def test_phrases_against_counting(spark, docs, monkeypatch, budget):
    rows = corpus(budget) + [("en", "hot pair " * 300)] * 2
    monkeypatch.setattr(collocations, "BUDGET", budget)  # small ones extend words, then pairs
    assert made(frame(spark, rows)) == brute(rows, 30)


def test_top_and_ties(spark, docs):
    rng = random.Random(1)
    pairs = [f"w{k} v{k}" for k in range(40)]
    rows = [("en", ". ".join(rng.sample(pairs, 40))) for _ in range(31)]
    assert made(frame(spark, rows), top=7) == brute(rows, 30, 7)


def test_empty_and_rare(spark, docs):
    assert made(frame(spark, [])) == []
    assert made(frame(spark, [(None, None), ("en", ""), ("en", "only words here"), ("en", "...")])) == []


def test_long_text_and_chunks(spark, docs, monkeypatch):
    rows = [("en", "a b c d e f " * 30000), ("en", "b c d")]
    assert made(frame(spark, rows)) == brute(rows, 30)


def test_many_words_take_two_keys():
    rng = np.random.default_rng(4)
    words = [b"w%d" % k for k in range(70000)]
    matrix = np.zeros((3000, 4), dtype=np.int64)
    matrix[:, 0] = rng.integers(69000, 69003, 3000)
    matrix[:, 1] = rng.integers(1, 4, 3000)
    matrix[:, 2] = rng.integers(0, 3, 3000)
    matrix[:, 3] = np.where(matrix[:, 2] > 0, rng.integers(0, 3, 3000), 0)
    counts = rng.integers(1, 5, 3000)
    wanted = Counter()
    for row, c in zip(matrix.tolist(), counts.tolist(), strict=True):
        for d in range(2, 5):
            if row[d - 1]:
                wanted[d, b" ".join(words[k - 1] for k in row[:d])] += c
    found = {(d, p): n for d, p, n in collocations.subtree_counts(matrix, counts, words, 50, set())}
    assert found == {k: n for k, n in wanted.items() if n >= 50}
