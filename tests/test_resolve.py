"""Resolving, comparing and numbering against a plain loop over the offers."""

import random

import pytest
from pyspark.sql import functions as F

from pricelens.functions.titles import match_key, normalize_title
from pricelens.operators import compare as C
from pricelens.operators.dedup import first_wins
from pricelens.operators.numbering import number_rows
from pricelens.operators.offers import (
    by_source_rank,
    invalid_sources,
    validate_sources,
    with_ord,
)
from pricelens.operators.resolve import best_offers, canonical_keys, pivot_sources, product_groups
from pricelens.plans.jobs import report
from pricelens.schema import DEFAULT_SOURCES

OFFER = "name string, cash_price double, installment_price double, source string, pos bigint"
TITLES = [
    "iPhone 15 128GB Blue", "Apple iPhone 15 128 GB (Nano-Sim)", "iPhone 15 (eSim) 128GB",
    "iPhone 15 8GB/128GB Red", "Galaxy S24 8GB/256GB", "Galaxy S24 12GB/256GB (dual sim)",
    "Galaxy S24 8/256GB Nano-Sim", "Poco X6",
]


def random_offers(seed, n):
    rng = random.Random(seed)
    prices = [None, 0.0, 90000.0, 95000.0, 97000.0, 100000.0, 100000.0]
    return [
        (rng.choice(TITLES), rng.choice(prices), rng.choice(prices),
         rng.choice(DEFAULT_SOURCES).id, i)
        for i in range(n)
    ]


def ordered(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, OFFER).repartition(partitions)
    return with_ord(df, ["pos"]).drop("pos")


def by_hand(rows, keys):
    """Products in first-seen order: {base: (key, {source: (name, cash, installment)})}."""
    rank = {s.id: i for i, s in enumerate(DEFAULT_SOURCES)}
    found = {}
    for name, cash, installment, source, _ in sorted(rows, key=lambda r: (rank[r[3]], r[4])):
        key, base = keys[name]
        product = found.setdefault(base, {"key": base, "best": {}})
        if product["key"] == base and key != base:
            product["key"] = key
        old = product["best"].get(source)
        cost = float("inf") if cash is None else cash
        if old is None or cost < (float("inf") if old[1] is None else old[1]):
            product["best"][source] = (name, cash, installment)
    return found


@pytest.fixture(scope="module")
def keys(spark):
    df = spark.createDataFrame([(t,) for t in TITLES], "name string")
    k = normalize_title(F.col("name"))
    return {r.name: (r.k, r.b) for r in df.select("name", k.alias("k"), match_key(k).alias("b")).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_equal_a_plain_loop(spark, keys, seed):
    rows = random_offers(seed, 60)
    expected = by_hand(rows, keys)
    groups = product_groups(ordered(spark, rows))
    assert {r.base_key: r.product_key for r in canonical_keys(groups).collect()} == {
        base: p["key"] for base, p in expected.items()
    }
    best = {
        (r.base_key, r.source): (r.name, r.cash_price, r.installment_price)
        for r in best_offers(groups).collect()
    }
    assert best == {
        (base, s): offer for base, p in expected.items() for s, offer in p["best"].items()
    }
    numbered = number_rows(groups.select("base_key", "first_ord"), ["first_ord"]).collect()
    assert [r.base_key for r in sorted(numbered, key=lambda r: r.n)] == list(expected)


def test_partitioning_does_not_matter(spark):
    rows = random_offers(9, 80)
    results = []
    for partitions in (1, 7):
        shuffled = rows[:]
        random.Random(partitions).shuffle(shuffled)
        out = report(ordered(spark, shuffled, partitions)).collect()
        results.append(sorted((r.n, r.product_key, r.message) for r in out))
    assert results[0] == results[1] and results[0]


def test_hot_title_and_source(spark):
    """One title of one source holds most rows; its cheapest offer still is found."""
    hot = [("iPhone 15 128GB", 90000.0 + i % 7000, None, "shop_b", i) for i in range(20000)]
    rows = [*hot, ("iPhone 15 128GB", 99000.0, None, "anchor", 0), *random_offers(4, 30)]
    groups = product_groups(ordered(spark, rows, 8)).where("base_key = 'iphone 15 128gb'")
    best = {r.source: r.cash_price for r in best_offers(groups).collect()}
    assert best["shop_b"] <= 90000.0


MESSAGE = """1. *iPhone 15 128GB*
Anchor - 100 000 - 110 000
Shop B - ❗90 000 - ❗95 000
Shop C - Առկա չէ
Shop D - Արժեքները նույնն են
Shop E - — - ✅120 000"""


def test_message(spark):
    rows = [
        ("iPhone 15 128GB Blue", 100000.0, 110000.0, "anchor", 0),
        ("iPhone 15 128GB", 90000.0, 95000.0, "shop_b", 0),
        ("Apple iPhone 15 128 GB", 100000.0, None, "shop_d", 0),
        ("iPhone 15 128GB", None, 120000.0, "shop_e", 0),
        ("Only here", 1.0, None, "shop_e", 1),
    ]
    out = report(ordered(spark, rows), group_sep=" ").collect()
    assert [r.message for r in out] == [MESSAGE]
    assert out[0].alert_key == "*iPhone 15 128GB*"


def test_installment_alone_can_alert(spark):
    rows = [
        ("Poco X6", 100.0, None, "anchor", 0),
        ("Poco X6", 100.0, 80.0, "shop_b", 0),
        ("Poco F5", 100.0, None, "anchor", 1),
        ("Poco F5", 95.0, None, "shop_b", 1),
    ]
    messages = C.build_messages(product_groups(ordered(spark, rows)))
    assert {r.product_key: r.has_alert for r in messages.collect()} == {
        "poco x6": True, "poco f5": False,
    }
    pairs = C.product_alerts(C.compare_offers(product_groups(ordered(spark, rows))))
    assert {r.product_key: r.has_alert for r in pairs.collect()} == {
        "poco x6": True, "poco f5": False,
    }


def test_pivot(spark):
    rows = [("Poco X6", 5.0, None, "shop_c", 0)]
    row = pivot_sources(product_groups(ordered(spark, rows))).first()
    assert row.anchor is None and row.shop_c.cash_price == 5.0


def test_first_wins_with_a_hot_key(spark):
    rows = [("hot", 5000 - i) for i in range(5000)] + [("a", 3), ("a", 2)]
    df = spark.createDataFrame(rows, "url string, ord int").withColumn("v", F.col("ord") * 2)
    out = {r.url: (r.ord, r.v) for r in first_wins(df.repartition(6), ["url"]).collect()}
    assert out == {"hot": (1, 2), "a": (2, 4)}


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_numbering_is_dense_and_ordered(spark, n):
    df = spark.range(n).select((F.col("id") * 7919 % 1009).alias("v"), "id").repartition(5)
    out = sorted((r.n, r.v, r.id) for r in number_rows(df, ["v", "id"]).collect())
    assert [r[0] for r in out] == list(range(1, n + 1))
    assert [r[1:] for r in out] == sorted(r[1:] for r in out)


def test_unknown_source_is_an_error(spark):
    rows = [("x", 1.0, None, "anchor", 0), ("y", 1.0, None, "nowhere", 1)]
    df = spark.createDataFrame(rows, OFFER)
    assert [(r.source, r.rows) for r in invalid_sources(df).collect()] == [("nowhere", 1)]
    with pytest.raises(Exception, match="unknown source: nowhere"):
        validate_sources(df).collect()
    assert validate_sources(df.where("source = 'anchor'")).count() == 1
    known = by_source_rank(spark.createDataFrame([("shop_c",), ("anchor",)], "source string"))
    assert [r.source for r in known.collect()] == ["anchor", "shop_c"]
