"""Variant matching against loops over the options, and lookups under skew."""

import random

from pyspark.sql import functions as F

from pricelens.operators import details as D
from pricelens.operators import variants as V

OPTION = "page int, option string, product_id int, pos int"


def random_options(rng, names, pages=40):
    return [
        (page, name, product, pos)
        for page in range(pages)
        for name in names
        for pos, product in enumerate(rng.sample(range(8), rng.randint(0, 4)))
    ]


def as_lists(rows):
    lists = {}
    for page, name, product, _ in rows:
        lists.setdefault(page, {}).setdefault(name, []).append(product)
    return lists


def test_option_pairs(spark):
    rng = random.Random(3)
    storage, ram = random_options(rng, ["128", "256"]), random_options(rng, ["8", "12"])
    disabled = {(page, rng.randrange(8)) for page in range(40)}
    s, r = as_lists(storage), as_lists(ram)
    expected = set()
    for page, options in s.items():
        for so, products in options.items():
            for ro, others in r.get(page, {}).items():
                for p in products:
                    if p in others and (page, p) not in disabled:
                        expected.add((page, so, ro, p))
                        break
    found = V.option_pairs(
        spark.createDataFrame(storage, OPTION), spark.createDataFrame(ram, OPTION),
        spark.createDataFrame(list(disabled), "page int, product_id int"),
    ).collect()
    assert {(x.page, x.storage, x.ram, x.product_id) for x in found} == expected
    assert len(found) == len(expected)


def test_sim_pairs_use_up_their_labels(spark):
    """The first option of a label counts even if a later one would lead to a product."""
    schema = "page int, option int, label string, option_pos int, product_id int, pos int"
    sims = [(1, 1, "eSim", 1, 10, 0), (1, 2, "eSim", 2, 20, 0), (1, 3, "Nano", 3, 20, 0)]
    storages = [(1, 1, "128", 1, 20, 0), (1, 1, "128", 1, 30, 1), (1, 2, "256", 2, 10, 0)]
    found = V.sim_storage_pairs(
        spark.createDataFrame(sims, schema), spark.createDataFrame(storages, schema)
    ).collect()
    assert {(x.storage, x.sim, x.product_id) for x in found} == {
        ("256", "eSim", 10), ("128", "Nano", 20),
    }


def test_variants_or_simple(spark):
    variants = spark.createDataFrame([(1, 5.0), (1, 6.0)], "page int, cash_price double")
    simple = spark.createDataFrame([(1, 9.0), (2, 8.0)], "page int, cash_price double")
    found = V.variants_or_simple(variants, simple).collect()
    assert sorted((r.page, r.cash_price) for r in found) == [(1, 5.0), (1, 6.0), (2, 8.0)]


def test_hot_and_missing_keys_are_split(spark):
    """Half the listing on one url, a quarter without any: the adaptive join splits both."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        key = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 4 == 1, F.col("id").cast("string"))
        listing = spark.range(40_000, numPartitions=8).select(
            key.alias("url"), F.col("id").cast("string").alias("name"), F.lit(1.0).alias("cash_price"), "id"
        )
        detail = spark.range(40_000).select(
            F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string")).alias("url"),
            F.lit("d").alias("name"), F.lit(2.0).alias("cash_price"), F.lit(3.0).alias("installment_price"),
        )
        found = D.listing_with_detail(listing, detail)
        counts = {r.name == "d": r.n for r in found.groupBy(F.col("name") == "d").agg(
            F.count("*").alias("n"), F.first("name").alias("name")).collect()}
        assert counts == {True: 30_000, False: 10_000}
        found.collect()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_last_stored_page_of_a_url(spark):
    rows = spark.createDataFrame([("u", 1, "a"), ("u", 3, "c"), ("u", 2, "b"), ("v", 1, "d")], "url string, at int, name string")
    assert {tuple(r) for r in D.latest_per_url(rows, "at").collect()} == {("u", "c"), ("v", "d")}


def test_listing_without_detail_is_kept(spark):
    listing = spark.createDataFrame(
        [("a", "list a", 1.0), ("b", "list b", 2.0), ("c", "list c", 3.0)],
        "url string, name string, cash_price double",
    )
    detail = spark.createDataFrame(
        [("a", "page a", 9.0, 10.0), ("b", None, None, 5.0)],
        "url string, name string, cash_price double, installment_price double",
    )
    out = D.listing_with_detail(listing, detail).collect()
    assert sorted((r.url, r.name, r.cash_price, r.installment_price or 0) for r in out) == [
        ("a", "page a", 9.0, 10.0), ("b", "list b", 2.0, 5.0), ("c", "list c", 3.0, 0),
    ]


def test_variant_details(spark):
    parents = spark.createDataFrame([("a", "A"), ("b", "B")], "url string, name string")
    links = spark.createDataFrame(
        [("a", 0, "a"), ("a", 1, "b"), ("a", 2, "b"), ("a", 3, "same"), ("a", 4, "free"),
         ("a", 5, "gone"), ("a", 6, "nameless"), ("b", 0, "a")],
        "url string, pos int, link string",
    )
    detail = spark.createDataFrame(
        [("a", "A", 1.0, None), ("b", "B", 2.0, 3.0), ("same", "A", 4.0, None),
         ("free", "F", None, None), ("nameless", None, 5.0, None)],
        "url string, name string, cash_price double, installment_price double",
    )
    out = D.variant_details(parents, links, detail).collect()
    assert sorted((r.url, r.link, r.pos, r.name) for r in out) == [
        ("a", "b", 1, "B"), ("b", "a", 0, "A"),
    ]
