"""Classifiers, mixing and sharding."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.llm import mixing, quality, sharding, toxicity
from pricelens.llm.queries import op1_quality, op5_toxicity

SF = "/root/testdata/sf0.01"


def labelled_rows(n=160):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.randrange(30, 90))]
        bad = k % 3 == 0
        if bad:
            words = [w.upper() + "!!" for w in words]
        toxic = k % 4 == 1
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zzqx", "vvkw"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(not bad), int(toxic)))
    return rows, labels


def accuracy(rows, truth):
    return np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in rows if r.doc_id in truth])


ODD = [(900, None), (901, ""), (None, "text"), (902, "word " * 50_000), (902, "word " * 50_000)]


@pytest.mark.parametrize("which", [quality, toxicity])
def test_classifier(spark, docs, clashing, which):
    rows, labels = labelled_rows()
    column = "quality" if which is quality else "toxic"
    frame = spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id bigint, quality int, toxic int")
    model = which.train(docs([*rows[:110], *ODD]), frame.where("doc_id < 110"))
    table = clashing(docs([*rows, *ODD]))
    scored = which.score(table, model)
    name = scored.columns[-1]
    assert name == "score_1" and scored.columns[:-1] == table.columns
    found = scored.select("doc_id", F.col(name).alias("score")).collect()
    assert len(found) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in found)
    truth = {i: bool(q if column == "quality" else t) for i, q, t in labels if i >= 110}
    assert accuracy(found, truth) > 0.9
    assert which.score(docs([]), model).collect() == []


@pytest.mark.parametrize("which", [quality, toxicity])
def test_one_class_or_none(spark, docs, which):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "doc_id bigint, quality int, toxic int")
    for part in (labels, labels.limit(0)):
        model = which.train(docs([(1, "a b"), (2, "c")]), part)
        assert {r.score > 0 for r in which.score(docs([(1, "a b"), (2, None)]), model).collect()} == {True}


@pytest.mark.parametrize("query, fold, label, least", [(op1_quality, (3, 1), "quality", 0.97), (op5_toxicity, (5, 0), "toxic", 0.85)])
def test_held_out_accuracy(spark, query, fold, label, least):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = query(spark, SF).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1])
        assert r.predicted == int(r.score >= 0.5)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id][label] for r in held]) >= least


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.permutation(20)[:6]) for _ in range(80)]
    values = [rng.normal(size=6) for _ in rows]
    values = [v / np.sqrt(v @ v) for v in values]
    y = np.where(rng.random(80) > 0.5, 1.0, -1.0)
    cost = np.full(80, 0.7)
    weight, bias = quality.dual_coordinate_descent(rows, values, y, cost, 400)

    def objective(w, b):
        loss = [max(0, 1 - t * (w[r] @ v + b)) for r, v, t in zip(rows, values, y, strict=True)]
        return (w @ w + b * b) / 2 + 0.7 * sum(loss)

    best = objective(weight, bias)
    for _ in range(200):
        step = rng.normal(size=21) * 10.0 ** -rng.integers(1, 5)
        moved = weight.copy()
        moved[:20] += step[:20]
        assert objective(moved, bias + step[20]) >= best - 1e-6


def test_network_gradients():
    rng = np.random.default_rng(1)
    net = toxicity.Net.new(rng)
    for k in ("embedding", "w", "u", "b", "attend", "query", "out"):
        setattr(net, k, rng.normal(0, 0.4, getattr(net, k).shape))
    features = rng.integers(0, 50, (20, 8))
    at = rng.integers(0, 20, (5, toxicity.SPAN))
    at[0, 10:] = 20  # padding
    y, weight = np.array([0, 1, 0, 1, 1.0]), np.array([1, 2, 1, 1, 0.5])
    dense, d_words = net.gradients(features, at, y, weight)

    def loss():
        p = toxicity._sigmoid(net.logits(features, at).astype(float))
        return float((weight * -(y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum())

    slot = int(features[at[1, 3], 2])
    expected = sum(d_words[w] * (features[w] == slot).sum() for w in range(20))
    for k, place in [("w", (0, 2, 5)), ("u", (1, 3, 20)), ("b", (0, 9)), ("attend", (4, 1)), ("query", (2,)),
                     ("out", (16,)), ("embedding", (slot, 4))]:
        array, step = getattr(net, k), 1e-2
        old = array[place]
        array[place] = old + step
        high = loss()
        array[place] = old - step
        low = loss()
        array[place] = old
        got = expected[4] if k == "embedding" else dense[k][place]
        assert abs((high - low) / (2 * step) - got) < 1e-4 + 0.01 * abs(got)


def test_windows_cover_all_words():
    for n in (1, 23, 24, 25, 40, 41, 100):
        data = np.frombuffer(" ".join(f"w{k}" for k in range(n)).encode(), np.uint8)
        at, row = toxicity.Texts.of(data, np.array([0, 0, len(data)])).windows()
        assert set(row.tolist()) == {1} and set(at.ravel().tolist()) - {n} == set(range(n))
        assert len(at) == 1 or (at < n).all()


def test_rates_meet_targets(spark, docs, clashing):
    rows, labels = labelled_rows()
    table = mixing.domain(spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    shares = {"clean": 0.6, "low": 0.25, "toxic": 0.15}
    rates, reached, goal = mixing.mixed(clashing(docs([*rows, *ODD])), table, shares)
    found = rates.collect()
    assert len(found) == len(rows) + len(ODD) and all(r.rate >= 0 for r in found)
    totals = np.sum([np.array(r.posteriors) * r.rate * r.tokens for r in found], axis=0)
    assert np.allclose(totals, list(reached.values()), rtol=1e-6)
    assert np.allclose(totals, list(goal.values()), rtol=1e-3)
    assert all(abs(sum(r.posteriors) - 1) < 1e-9 for r in found)


def solved(p, n, targets):
    """The fit over arrays: rates, and how many passes it took."""
    solver = mixing.Solver((p * n[:, None]).T @ p, targets)
    r = last = np.ones(len(n))
    for passes in range(mixing.STEPS):
        ahead = r + solver.momentum() * (r - last)
        step = solver.step((n * r) @ p, (n * ahead) @ p)
        if step is None:
            break
        r, last = mixing.folded(p, r, last, [step])
    return r, passes


def least_squares(p, n, targets):
    """Nonnegative least squares by many plain steps."""
    matrix = (p * n[:, None]).T @ p
    size, r = 1 / np.linalg.eigvalsh(matrix)[-1], np.ones(len(n))
    y, pace = r, 1.0
    for _ in range(20000):
        moved = np.maximum(0, y - size * (p @ ((n * y) @ p - targets)))
        following = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        if (moved - r) @ (n * (y - moved)) > 0:
            following = 1.0
        y, r, pace = moved + (pace - 1) / following * (moved - r) * (following > 1), moved, following
    return r


def test_reachable_targets_are_reached():
    rng = np.random.default_rng(6)
    took = []
    for _ in range(200):
        k, rows = rng.integers(2, 7), rng.integers(20, 300)
        p = rng.dirichlet(rng.choice([0.05, 0.3, 1, 5]) * rng.uniform(0.1, 3, k), rows)
        n = rng.integers(0, 2000, rows).astype(float)
        targets = (n * rng.gamma(rng.choice([0.03, 0.3, 2]), 1, rows)) @ p
        r, passes = solved(p, n, targets)
        assert (r >= 0).all() and np.abs((n * r) @ p - targets).sum() <= 1e-4 * max(targets.sum(), 1)
        took.append(passes)
    assert np.median(took) < 10 and max(took) < mixing.STEPS - 1


def test_other_targets_get_least_squares():
    rng = np.random.default_rng(7)
    for _ in range(25):
        k, rows = rng.integers(2, 5), rng.integers(20, 60)
        p = rng.dirichlet(rng.uniform(2, 6, k), rows)
        n = rng.integers(1, 200, rows).astype(float)
        targets = rng.dirichlet(np.full(k, 0.3)) * n.sum()  # mostly beyond any mixture of rows
        errors = [((n * r) @ p - targets) @ ((n * r) @ p - targets) for r in (solved(p, n, targets)[0], least_squares(p, n, targets))]
        assert errors[0] <= errors[1] * 1.001 + 1e-8 * targets.sum() ** 2


@pytest.mark.parametrize("fold", [2, 40])
def test_mixture_over_tables(spark, docs, monkeypatch, fold):
    """The same rates as the fit over arrays, also where the fold is written down between."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.2, 0.1, 0.1], 300)
    n = rng.integers(0, 300, 300)
    targets = (n * rng.gamma(0.1, 1, 300)) @ p
    wanted, passes = solved(p, n.astype(float), targets)
    monkeypatch.setattr(mixing, "FOLD", fold)
    rows = [(i, int(t), [float(x) for x in row]) for i, (t, row) in enumerate(zip(n, p, strict=True))]
    narrow = spark.createDataFrame(rows, "doc_id int, tokens bigint, p array<double>").repartition(3)
    steps, reached = mixing.fitted(narrow, targets)
    assert len(steps) == passes and np.abs(reached - targets).sum() <= 1e-6 * targets.sum()
    found = mixing.with_rates(narrow, steps, {"rate": "rate"}, ["doc_id"]).orderBy("doc_id").collect()
    assert np.allclose([r.rate for r in found], wanted, atol=1e-6)


def test_mixture_of_long_texts(spark, docs):
    rows, labels = labelled_rows()
    table = mixing.domain(spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    long = [(5000, "word " * 400_000), (5001, "x" * 2_000_000)]
    rates, reached, goal = mixing.mixed(docs([*rows, *long]), table, {"clean": 0.6, "low": 0.3, "toxic": 0.1})
    assert {r.doc_id: r.tokens for r in rates.where("doc_id >= 5000").collect()} == {5000: 400_000, 5001: 1}
    assert rates.count() == len(rows) + 2 and all(r.rate >= 0 for r in rates.collect())


def test_mixture_drops_what_has_no_room(spark, docs):
    rows, labels = labelled_rows()
    table = mixing.domain(spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    kept = mixing.thinned(docs([*rows, (950, None)]), table)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [r.doc_id for r in kept.collect()]
    clean = [i for i, q, t in labels if q and not t]
    rest = [i for i, q, t in labels if not q or t]
    assert len(ids) == len(set(ids)) and len(set(clean) & set(ids)) >= 0.98 * len(clean)
    assert len(set(rest) & set(ids)) < 0.3 * len(rest)
    assert mixing.thinned(docs([]), table).collect() == []


def test_communication_matrix_is_hypergeometric():
    parts = [5, 0, 9, 2]
    seen = []
    for seed in range(3000):
        m = sharding.communication_matrix(parts, 3, seed)
        assert m.sum(axis=1).tolist() == parts and m.sum(axis=0).tolist() == [6, 5, 5]
        seen.append(m[2, 0])
    mean, var = 9 * 6 / 16, 9 * (6 / 16) * (10 / 16) * (16 - 9) / 15
    assert abs(np.mean(seen) - mean) < 0.1 and abs(np.var(seen) - var) < 0.12


def test_large_populations():
    rng = np.random.default_rng(2)
    draws = [sharding._hypergeometric(10**10, 3 * 10**10, 4000, rng) for _ in range(300)]
    assert abs(np.mean(draws) - 1000) < 8 and abs(np.std(draws) - 27.4) < 4


def test_equal_rows_spread(spark, docs):
    """A table of equal rows: every part still goes to all shards, and cells stay small."""
    table = docs([(7, "same")] * 4000).repartition(6)
    found = sharding.shard(table, shards=5, cell_rows=200)
    got = [(r["shard"], r.slot) for r in found.collect()]
    assert sorted(got) == [(s, k) for s in range(5) for k in range(800)]
    cells = sharding._cells(np.array([800, 800, 0, 800, 800]), 3, 4, sharding.SEED)
    assert cells.sum() == 3200 and cells.reshape(5, 4).sum(axis=1).tolist() == [800, 800, 0, 800, 800]
    assert cells[cells > 0].max() < 280


def test_shuffle_is_uniform(spark, docs):
    """Over many seeds a row's slot is anywhere in the whole table, each place about as often."""
    table = docs([(k, str(k)) for k in range(12)]).coalesce(1).repartition(3).cache()
    seen = np.zeros((12, 12))
    for seed in range(40):
        for r in sharding.shard(table, shards=3, cell_rows=2, seed=seed).collect():
            seen[r.doc_id, r["shard"] * 4 + r.slot] += 1
    assert (seen.sum(axis=0) == 40).all() and seen.max() <= 14  # 3.3 on average
    table.unpersist()


def test_parts_are_permuted():
    row = np.array([3, 0, 5])
    one, other = sharding.part_shards(row, 1, 9), sharding.part_shards(row, 2, 9)
    assert np.bincount(one, minlength=3).tolist() == [3, 0, 5] and one.tolist() != sorted(one)
    assert one.tolist() != other.tolist() and one.tolist() == sharding.part_shards(row, 1, 9).tolist()
    hits = np.mean([sharding.part_shards(row, p, 1) == 0 for p in range(4000)], axis=0)
    assert np.abs(hits - 3 / 8).max() < 0.04


def test_shards(docs, clashing):
    rows = [(k, f"text {k % 40}") for k in range(1000)] + [(None, None), (None, None), (7, "text 7"), (2000, "y" * 100_000)]
    table = clashing(docs(rows))
    found = sharding.shard(table, shards=7, cell_rows=30)
    assert found.columns == [*table.columns, "shard_1", "slot"]
    got = found.select("doc_id", "text", "shard_1", "slot").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard_1, []).append(r.slot)
    assert sorted(by) == list(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    again = sharding.shard(table, shards=7, cell_rows=30)
    key = lambda r: (str(r.doc_id), r.shard_1, r.slot)
    assert sorted(map(key, again.collect())) == sorted(map(key, got))
    # Neighbours in the input are spread: no shard holds a run of ids.
    assert len({r.doc_id // 100 for r in got if r.doc_id is not None and r.shard_1 == 0}) > 8
    assert sharding.shard(docs([])).collect() == []
    assert len(sharding.shard(docs([(1, "a")])).collect()) == 1


def test_shard_rows(docs):
    rows = sharding.shard_rows(docs([(1, "é"), (2, None), (3, "")])).collect()
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == {(1, 3, zlib.crc32("é".encode())), (2, 1, 0), (3, 1, 0)}
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
