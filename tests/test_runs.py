"""Snapshots, runs over time, and streams that must equal the batch result."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from pricelens.operators import incremental as I
from pricelens.operators.offers import position
from pricelens.plans import runs
from pricelens.schema import DEFAULT_SOURCES, Source
from pricelens.session import scratch_path
from pricelens.sources import alerts as alert_table
from pricelens.sources import catalog, snapshots
from pricelens.streaming.alerts import stream_new_alerts
from pricelens.streaming.snapshots import stream_snapshots

def stamp():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


OFFER = "name string, cash_price double, installment_price double, source string, pos bigint"


def offers(spark, *rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], OFFER)
    return df.withColumn("ord", position("pos")).drop("pos")


def test_snapshots(spark):
    path = scratch_path(spark, "t")
    assert snapshots.read_snapshot(spark, path, "anchor") is None
    snapshots.write_snapshot(
        offers(spark, ("a", 1.0, None, "anchor"), ("b", 2.0, None, "shop_b")), path, stamp()
    )
    snapshots.write_snapshot(offers(spark, ("c", 3.0, None, "shop_b")), path, stamp())
    snapshots.write_snapshot(offers(spark, ("d", 4.0, None, "shop_b")).limit(0), path, stamp())
    rows = snapshots.load_offers(spark, path).orderBy("ord").collect()
    assert [(r.source, r.name) for r in rows] == [("anchor", "a"), ("shop_b", "c")]
    with pytest.raises(Exception, match="unknown source"):
        snapshots.write_snapshot(offers(spark, ("x", 1.0, None, "who")), path, stamp())
    assert snapshots.clear_snapshots(spark, path, [Source("shop_b", "B")]) == ["shop_b"]
    assert [r.source for r in snapshots.read_all(spark, path).collect()] == ["anchor"]


def test_status_and_staleness(spark):
    rows = [("anchor", dt.datetime(2024, 1, 30, 0, 0)), ("shop_b", dt.datetime(2024, 1, 29, 23, 59, 59)),
            ("shop_b", dt.datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "source string, scraped_at timestamp")
    known = DEFAULT_SOURCES[:3]
    status = {r.source: (r.found, r.offers, r.age_minutes)
              for r in snapshots.snapshot_status(df, stamp(), known).collect()}
    assert status == {
        "anchor": (True, 1, 1440), "shop_b": (True, 2, 1440), "shop_c": (False, None, None),
    }
    # Exactly 24 hours is not stale yet.
    stale = {r.source for r in snapshots.stale_sources(df, stamp(), 24, known).collect()}
    assert stale == {"shop_b", "shop_c"}


def test_alert_table_appends(spark):
    path = scratch_path(spark, "t")
    for text in ("a", "b"):
        alert_table.write_alerts(spark.createDataFrame([(text,)], "message string"), path)
    assert sorted(r.message for r in spark.read.parquet(path).collect()) == ["a", "b"]


def test_run_loop(spark):
    root = scratch_path(spark, "t")
    store, memory = f"{root}/store", f"{root}/memory"
    prices = {"b": 80.0}

    def shop_b():
        return offers(
            spark, ("Poco X6", prices["b"], None, "shop_b"), ("Poco F5", 50.0, None, "shop_b")
        )

    def broken():
        raise ValueError("page gone")

    assert runs.send_report(spark, store, memory) is None
    jobs = {
        "anchor": lambda: offers(
            spark, ("Poco X6", 100.0, None, "anchor"), ("Poco F5", 51.0, None, "anchor")
        ),
        "shop_b": shop_b,
        "shop_c": broken,
    }
    outcome = runs.collect(jobs, store, stamp())
    assert outcome["anchor"] == "stored" and outcome["shop_c"] == "failed: page gone"

    def sent(**options):
        return [(r.n, r.product_key) for r in runs.send_report(spark, store, memory, **options).collect()]

    assert sent(new_only=True) == [(1, "poco x6")]
    assert sent(new_only=True) == []
    assert sent() == [(1, "poco x6")]
    runs.reset_memory(spark, memory)
    assert sent(new_only=True) == [(1, "poco x6")]
    # An alert that was gone for one run is new again.
    prices["b"] = 99.0
    runs.collect({"shop_b": shop_b}, store, stamp())
    assert sent(new_only=True) == []
    prices["b"] = 80.0
    runs.collect({"shop_b": shop_b}, store, stamp())
    assert sent(new_only=True, clear_after=True) == [(1, "poco x6")]
    assert runs.send_report(spark, store, memory) is None


def test_catalog_pages_from_files(spark, tmp_path):
    for brand, page, text in [
        ("x", 2, '{"data":{"products":{"last_page":2,"data":[{"name":"B","cash_price":"5"}]}}}'),
        ("x", 1, '{"data":{"products":{"last_page":2,\n"data":[{"name":"A","price":0,'
         '"attributes":[{"attribute_id":19,"attribute_value":"eSIM"}]}]}}}'),
        ("y", 1, "not json"),
        ("z", 1, '{"data":{"products":{"last_page":3,"data":[{"name":"C","cash_price":"5"}]}}}'),
        ("z", 2, '{"data":{"products":{"last_page":3,"data":[{"name":"D","cash'),
        ("z", 3_000_000_000, '{"data":{}}'),
    ]:
        folder = tmp_path / f"brand={brand}" / f"page={page}"
        folder.mkdir(parents=True)
        (folder / "p.json").write_text(text)
    flat = catalog.read_catalog(spark, str(tmp_path))
    rows = catalog.catalog_offers(flat, "anchor", ["x", "y"]).orderBy("ord").collect()
    assert [(r.name, r.price, r.cash_price, r.ord) for r in rows] == [
        ("A eSim", None, None, [1, 1, 0]), ("B", None, 5.0, [1, 2, 0]),
    ]
    rejected = catalog.rejected_pages(catalog.read_catalog_pages(spark, str(tmp_path))).collect()
    assert sorted(map(tuple, rejected)) == [
        ("y", 1, "not json"), ("z", 2, "not json"), ("z", 3_000_000_000, "no products"),
    ]


def test_page_coverage_counts_claimed_pages_only(spark):
    rows = [("x", 1, 3), ("x", 1, 3), ("x", 3, 3), ("y", 1, 1), ("z", 1, 3), ("z", 2, 3), ("z", 9, 3), ("w", 8, 7)]
    pages = spark.createDataFrame(rows, "brand string, page int, last_page int")
    coverage = {r.brand: tuple(r)[1:] for r in catalog.page_coverage(pages).collect()}
    assert coverage == {
        "x": (3, 2, False, "2-2"), "y": (1, 1, True, ""), "z": (3, 2, False, "3-3"), "w": (7, 0, False, "1-7"),
    }


@pytest.mark.parametrize("limit", ["-1", "10485760"])
def test_calendar_tables_are_sent_to_the_alerts(spark, limit):
    """No exchange of offers or alerts on the run, whatever the broadcast limit is."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        rows = [(START + dt.timedelta(minutes=20 * k), f"p{k % 3}", s, 100.0 * (1 + (k + j) % 4), None, 10 * k + j)
                for k in range(40) for j, s in enumerate(("anchor", "shop_b"))]
        feed = spark.createDataFrame([(t, s, p, c, i, o) for t, p, s, c, i, o in rows], FEED)
        best = I.hourly_runs(feed)
        alerts = I.run_alerts(best, best.select("run").distinct())
        plan = alerts._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"BroadcastHashJoin \[source#\d+, snapshot_run", plan)
        found = sorted(map(str, alerts.collect()))
        assert found and found == sorted(set(found))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


FEED = "ts timestamp, source string, product_key string, cash_price double, installment_price double, ord bigint"
START = dt.datetime(2024, 1, 1, 0, 0)


def random_feed(seed, n, hours):
    rng = random.Random(seed)
    times = sorted(rng.uniform(0, hours * 3600) for _ in range(n))
    return [
        (START + dt.timedelta(seconds=t), rng.choice(DEFAULT_SOURCES).id, f"p{rng.randrange(4)}",
         float(rng.choice([70, 90, 100, 100])), None, i)
        for i, t in enumerate(times)
    ]


def by_hand(rows):
    """Alerts per run and new alerts, one run after the other."""
    snapshots_of, previous, alerts, fresh = {}, set(), set(), set()
    hours = sorted({r[0].replace(minute=0, second=0, microsecond=0) for r in rows})
    for hour in hours:
        taken = {}
        for ts, source, product, cash, _, _ in rows:
            if ts.replace(minute=0, second=0, microsecond=0) == hour:
                best = taken.setdefault(source, {})
                best[product] = min(cash, best.get(product, cash))
        snapshots_of.update(taken)
        now = set()
        for product, anchor in snapshots_of.get("anchor", {}).items():
            for source, best in snapshots_of.items():
                other = best.get(product)
                if source != "anchor" and other and (anchor - other > 20 or anchor - other > anchor * 0.1):
                    now.add(product)
        alerts |= {(hour, p) for p in now}
        fresh |= {(hour, p) for p in now - previous}
        previous = now
    return alerts, fresh


def test_new_alerts_equal_a_plain_loop(spark):
    rows = random_feed(5, 120, 40)
    best = I.hourly_runs(spark.createDataFrame(rows, FEED))
    hours = best.select("run").distinct()
    alerts = I.run_alerts(best, hours, flat=20.0)
    fresh = I.new_alerts_by_run(alerts, hours)
    expected_alerts, expected_fresh = by_hand(rows)
    assert {(r.run, r.product_key) for r in alerts.collect()} == expected_alerts
    assert {(r.run, r.product_key) for r in fresh.collect()} == expected_fresh


def test_stream_equals_batch_over_many_batches(spark, tmp_path):
    """Four files, one micro-batch each, stopped and started again in between."""
    rows = random_feed(6, 160, 48)
    source, root = str(tmp_path / "feed"), scratch_path(spark, "t")
    end = (START + dt.timedelta(days=30), "anchor", "end", 1.0, None, 10**6)

    def land(part, name):
        spark.createDataFrame(part, FEED).coalesce(1).write.mode("append").parquet(f"{source}/{name}")

    def run():
        feed = (
            spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(source)
        )
        stream_new_alerts(
            feed, f"{root}/state", f"{root}/out", f"{root}/cp", flat=20.0
        ).awaitTermination()

    land(rows[:40], "1")
    run()
    for i, name in ((1, "2"), (2, "3")):
        land(rows[40 * i : 40 * (i + 1)], name)
    run()
    land([*rows[120:], end], "4")
    run()
    found = [(r.run, r.product_key) for r in spark.read.parquet(f"{root}/out").collect()]
    _, expected = by_hand(rows)
    assert set(found) == expected and len(found) == len(expected)


def test_stream_keeps_the_latest_run_per_source(spark, tmp_path):
    source, root = str(tmp_path / "feed"), scratch_path(spark, "t")
    rows = [
        (START, "anchor", "a", 5.0, None, 0), (START, "shop_b", "b", 6.0, None, 1),
        (START + dt.timedelta(hours=3), "anchor", "c", 7.0, None, 2),
        (START + dt.timedelta(days=9), "shop_c", "z", 1.0, None, 3),
    ]
    spark.createDataFrame(rows, FEED).write.parquet(source)
    stream_snapshots(
        spark.readStream.schema(FEED).parquet(source), f"{root}/store", f"{root}/state", f"{root}/cp"
    ).awaitTermination()
    stored = spark.read.parquet(f"{root}/store").collect()
    assert {(r.source, r.product_key) for r in stored} == {("anchor", "c"), ("shop_b", "b")}


def test_schedule_forgets_over_night(spark):
    day = dt.datetime(2024, 1, 1)
    hours = [day + dt.timedelta(hours=h) for h in (9, 10, 11, 13, 23, 24 + 3, 24 + 10, 24 + 11)]
    alerts = [(h, "p") for h in hours if h.hour != 13]
    sent = I.alerts_by_schedule(
        spark.createDataFrame(alerts, "run timestamp, product_key string"),
        spark.createDataFrame([(h,) for h in hours], "run timestamp"),
    ).collect()
    # 9 reports all; 10 and 11 repeat; 13 has none, so 23 is new; 3 at night is no run; the
    # next day's first run has no memory.
    assert sorted((r.run, r.run_class) for r in sent) == [
        (hours[0], "full"), (hours[4], "new_only"), (hours[6], "new_only"),
    ]


def test_intermediate_tables_can_be_cleared(spark):
    from pyspark.sql import functions as F

    from pricelens.session import clear_scratch, materialize, scratch_root

    clear_scratch(spark)
    kept = materialize(spark.range(5).withColumn("x", F.lit(1)))
    assert kept.inputFiles()[0].split("//")[-1].lstrip("/").startswith(scratch_root(spark).split("//")[-1].lstrip("/"))
    assert kept.count() == 5 and clear_scratch(spark)
    assert not clear_scratch(spark)  # nothing left
    assert materialize(spark.range(3)).count() == 3
