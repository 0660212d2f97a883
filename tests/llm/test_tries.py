"""The trie of conversations against a plain tree of tuples."""

import math
import random
import re
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from pricelens.llm import tries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows, rebuild=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = own
    if rebuild:
        built = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 4
            built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append((c, len(turns) == d))
    below = {k: [j for j in nodes if j[: len(k)] == k] for k in nodes}
    direct = {k: sum(1 for j in below[k] if len(j) == len(k) + 1) for k in nodes}
    saved = {k: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0 for k, m in nodes.items()}
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c, e in sorted(members) if e)
        out.append((
            min(c for c, _ in members), len(k), min(c for c, _ in nodes[k[:-1]]) if k else None, len(members),
            direct[k], sum(direct[j] == 0 for j in below[k]), sum(saved[j] for j in below[k]),
            sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def made(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names
    return sorted((tuple(r) for r in df.collect()), key=str)


def conversations(seed, count=120):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 400), count):
        for t in range(rng.randint(1, 6)):
            turn = None if rng.random() < 0.02 else t
            rows.append((c, turn, rng.choice(["user", "bot", None]) if t > 2 else "user", rng.choice(["a b", "a", "c  d e", "", None])))
    ordered = {}
    for c, turn, role, text in rows:  # one row for each number of a turn
        ordered[(c, turn)] = (c, turn, role, text)
    return list(ordered.values())


@pytest.mark.parametrize("cells", [8, 64, 1 << 20])
def test_trie_against_plain_tree(spark, docs, monkeypatch, cells):
    rows = conversations(cells)
    rows += [(7000 + k, t, "user", "same words here") for k in range(60) for t in range(3)]  # a hot conversation
    rows += [(8000 + k, 0, "user", "hot first") for k in range(40)] + [(8000 + k, 1, "user", f"w{k} x") for k in range(40)]
    rows += [(9000, t, "user", f"turn {t}") for t in range(40)] + [(9020, t, "user", f"turn {t}") for t in range(55)]
    rows += [(None, 1, "user", "lost"), (-3, 0, "user", "minus"), (12345678901234, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("depth", F.lit("x")).withColumn("key1", F.lit(1))
    monkeypatch.setattr(tries, "CELLS", cells)
    assert made(tries.prefix_trie(df)) == brute(rows)


def test_general_trie_has_no_rebuilding(spark, docs):
    rows = conversations(1, 30)
    df = spark.createDataFrame(rows, SCHEMA)
    assert made(tries.trie(tries.rows_of(df))) == brute(rows, rebuild=False)


def test_equal_numbers_have_an_order(spark, docs):
    rows = [(c, 1, role, text) for c in (1, 2) for role, text in (("a", "x"), ("b", "y"), ("a", "x"))]
    one = made(tries.prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert one == made(tries.prefix_trie(spark.createDataFrame(rows[::-1], SCHEMA)))


def test_empty_tables(spark, docs):
    assert made(tries.prefix_trie(spark.createDataFrame([], SCHEMA))) == []
    assert made(tries.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))) == []
    # crc32 of 3 takes one or more turns from a base that is not there.
    rows = [(c, 0, "a", "b") for c in (1, 2, 3, 5, 6, 7)]
    assert made(tries.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
