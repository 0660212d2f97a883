"""Products kept up to date equal a full rebuild; values carried forward equal a plain loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pricelens.operators.incremental import asof_latest
from pricelens.operators.offers import source_rank
from pricelens.operators.resolve import product_groups
from pricelens.plans import delta_runs
from pricelens.sources import versions

ROW = "name string, cash_price double, installment_price double, source string, ord bigint"
SHOPS = ["anchor", "shop_b", "shop_c"]
TITLES = ["Apple iPhone {} 128 ГБ", "iphone {} 128GB (Nano-SIM)", "iPhone {} 128gb Black", "iPhone {} 128GB eSIM"]


def delivery(rng, shop):
    rows = []
    for i in range(rng.randrange(1, 14)):
        name = None if rng.random() < 0.1 else rng.choice(TITLES).format(rng.randrange(5))
        rows.append((name, rng.choice([None, 0.0, 10.0, 20.0]), rng.choice([None, 5.0]), shop, i))
    return rows


def state(df):
    return sorted(
        (r.base_key, r.product_key, [e and (e.name, e.cash_price, e.installment_price) for e in r.entries]) for r in df.collect()
    )


def order(df):
    return [r.base_key for r in df.orderBy("first_ord").collect()]


def test_random_runs_equal_a_full_rebuild(spark, tmp_path):
    rng, store, held, changed = random.Random(2), str(tmp_path / "store"), {}, []
    assert delta_runs.current_products(spark, store) is None
    for step in range(5):
        changes = {s: delivery(rng, s) for s in rng.sample(SHOPS, rng.choice([1, 1, 2]) if step else 3)}
        if step == 3:
            changes = {"shop_b": held["shop_b"]}  # the same again
        frames = {s: spark.createDataFrame(rows, ROW) for s, rows in changes.items()}
        _, touched = delta_runs.run(spark, frames, store, f"2024-01-0{step + 1} 00:00:00+00:00")
        changed.append(touched)
        held |= changes
        every = spark.createDataFrame([r for rows in held.values() for r in rows], ROW)
        whole = product_groups(every.withColumn("ord", F.struct(source_rank(F.col("source")).alias("rank"), "ord")))
        found = delta_runs.current_products(spark, store)
        assert state(found) == state(whole) and order(found) == order(whole)
    assert changed[3] == 0 and changed[0] > 0


def test_only_touched_products_change(spark, tmp_path):
    store = str(tmp_path / "store")
    many = [(f"phone {k}", 10.0, None, "anchor", k) for k in range(200)]
    other = [(f"phone {k}", 9.0, None, "shop_b", k) for k in range(200)]
    delta_runs.run(spark, {"anchor": spark.createDataFrame(many, ROW), "shop_b": spark.createDataFrame(other, ROW)}, store, "2024-01-01 00:00:00+00:00")
    other[7] = ("phone 7", 8.0, None, "shop_b", 7)
    other[9] = ("phone new", 8.0, None, "shop_b", 9)
    number, touched = delta_runs.run(spark, {"shop_b": spark.createDataFrame(other, ROW)}, store, "2024-01-02 00:00:00+00:00")
    assert (number, touched) == (2, 3)  # one price, one gone, one new
    # Nothing delivered: nothing changes. An older version can still be read.
    assert delta_runs.run(spark, {"shop_b": spark.createDataFrame([], ROW)}, store, "2024-01-03 00:00:00+00:00") == (2, 0)
    assert versions.current(spark, store, 1).folders["anchor"] == versions.current(spark, store).folders["anchor"]


TAKEN = "key string, ts timestamp, value int, note string"
START = dt.datetime(2024, 1, 1)


def by_hand(asked, taken):
    out = []
    for key, ts, i in asked:
        seen = [t for t in taken if key and ts and t[1] and t[0] == key and t[1] <= ts]
        last = max(seen, key=lambda t: (t[1], t[2], t[3])) if seen else (None,) * 4
        out.append((key, ts, i, last[2], last[3]))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [60, 3600, 10**6])
def test_carried_values_equal_a_loop(spark, width):
    rng = random.Random(width)
    keys = ["hot"] * 8 + ["a", "b", None]

    def time():
        return None if rng.random() < 0.03 else START + dt.timedelta(seconds=60 * rng.randrange(600))

    taken = [(rng.choice(keys), time(), rng.randrange(50), rng.choice("xyz")) for _ in range(250)]
    asked = [(rng.choice([*keys, "never"]), time(), i) for i in range(150)]
    taken.append(("a", START, 1, "x"))
    found = asof_latest(
        spark.createDataFrame(asked, "key string, ts timestamp, i int"), spark.createDataFrame(taken, TAKEN), "key", width_s=width
    )
    assert found.columns == ["key", "ts", "i", "value", "note"]
    assert sorted(map(tuple, found.collect()), key=str) == by_hand(asked, taken)


def test_one_source_is_not_one_partition(spark):
    """All rows of one key: they are sorted bucket by bucket, in several tasks."""
    rows = spark.range(20000).select(F.lit("one").alias("key"), F.timestamp_seconds(F.col("id") * 30).alias("ts"), F.col("id").alias("value"))
    asked = rows.select("key", (F.col("ts") + F.expr("interval 1 second")).alias("ts"))
    found = asof_latest(asked, rows, "key")
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in text and "_bucket" in text
    assert found.where(F.unix_timestamp("ts") != F.col("value") * 30 + 1).count() == 0
    assert found.count() == 20000
