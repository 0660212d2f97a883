"""The stream over raw offers equals the batch loop; late rows are kept; end marks close hours."""

import datetime as dt
import random

from pyspark.sql import functions as F

from pricelens.plans import runs
from pricelens.session import scratch_path
from pricelens.sources import versions
from pricelens.streaming.reports import FEED, end_mark, stream_reports, with_end_marks

START = dt.datetime(2024, 5, 1)
SHOPS = ["anchor", "shop_b", "shop_c", "shop_d", "shop_e"]
TITLES = ["Apple iPhone {} 128 ГБ", "iphone {} 128GB (Nano-SIM)", "iPhone {} 128gb Black", "iPhone {} 128GB eSIM"]


def offers(seed, n, hours):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = START + dt.timedelta(minutes=rng.randrange(hours * 60))
        price = rng.choice([None, 0.0, *[float(rng.randrange(5000, 20000))] * 8])
        name = rng.choice(TITLES).format(rng.randrange(4)) if rng.random() < 0.95 else None
        rows.append((ts, rng.choice(SHOPS), name, price, rng.choice([None, 9000.0]), i))
    return sorted(rows, key=lambda r: (r[0], r[5]))


def batch_loop(spark, tmp_path, rows):
    """One version and one report after the other, as the hourly job does it."""
    store, reports, sent = str(tmp_path / "store"), str(tmp_path / "reports"), []
    for hour in sorted({r[0].replace(minute=0) for r in rows}):
        own = [r for r in rows if r[0].replace(minute=0) == hour]
        df = spark.createDataFrame(own, FEED).drop("ts")
        at = hour.strftime("%Y-%m-%d %H:%M:%S+00:00")
        number = versions.write_version(df, store, F.lit(at).cast("timestamp"), at)
        found = runs.report_version(spark, store, reports, new_only=True, number=number)
        for r in found.collect():
            sent.append((hour, r.n, r.product_key, r.alert_key, r.message))
    return sorted(sent)


def land(spark, rows, folder, name):
    spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def read(spark, root):
    rows = spark.read.parquet(f"{root}/out").collect()
    return sorted((r.run, r.n, r.product_key, r.alert_key, r.message) for r in rows)


def test_stream_equals_the_batch_loop(spark, tmp_path):
    rows = offers(3, 300, 7)
    source, marks, root = str(tmp_path / "feed"), str(tmp_path / "marks"), scratch_path(spark, "t")

    def run():
        feed = (
            spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(source)
        )
        stream_reports(with_end_marks(feed, marks), root, f"{root}/cp").awaitTermination()

    spark.createDataFrame([], "ts timestamp").write.parquet(marks)
    land(spark, rows[:100], source, "1")
    run()
    first = read(spark, root)
    # Rows of a closed hour, of an open one, and without a time.
    late = (rows[0][0], "shop_b", "iPhone 1 128GB", 1.0, None, 900)
    lost = (None, "shop_b", "iPhone 1 128GB", 1.0, None, 901)
    land(spark, [*rows[100:200], late, lost], source, "2")
    run()
    land(spark, rows[200:], source, "3")
    run()
    expected = batch_loop(spark, tmp_path, rows)
    before = read(spark, root)
    assert set(first) <= set(before) < set(expected)  # the last hours are open
    end_mark(spark, marks, START + dt.timedelta(days=1))
    run()
    assert read(spark, root) == expected and len({e[0] for e in expected}) > 3
    run()  # nothing new
    assert read(spark, root) == expected
    kept = spark.read.parquet(f"{root}/late").collect()
    assert sorted(r.ord for r in kept) == [900, 901]
    counts = spark.read.parquet(f"{root}/counts").agg(F.sum("rows"), F.sum("late")).first()
    assert tuple(counts) == (302, 2)


def test_numbers_have_gaps(spark, tmp_path):
    def row(hour, source, name, price, i):
        return (START + dt.timedelta(hours=hour), source, name, price, None, i)

    rows = [
        row(0, "anchor", "iPhone 1 128GB", 20000.0, 1), row(0, "anchor", "iPhone 2 128GB", 20000.0, 2),
        row(0, "shop_b", "iPhone 1 128GB", 9000.0, 3),
        row(1, "shop_b", "iPhone 1 128GB", 9000.0, 4), row(1, "shop_b", "iPhone 2 128GB", 9000.0, 5),
    ]
    source, marks, root = str(tmp_path / "feed"), str(tmp_path / "marks"), scratch_path(spark, "t")
    land(spark, rows, source, "1")
    end_mark(spark, marks, START + dt.timedelta(days=1))
    feed = spark.readStream.schema(FEED).option("recursiveFileLookup", "true").parquet(source)
    stream_reports(with_end_marks(feed, marks), root, f"{root}/cp").awaitTermination()
    assert [(r[0].hour, r[1], r[3]) for r in read(spark, root)] == [(0, 1, "*iPhone 1 128GB*"), (1, 2, "*iPhone 2 128GB*")]


def test_empty_stream(spark, tmp_path):
    source, marks, root = str(tmp_path / "feed"), str(tmp_path / "marks"), scratch_path(spark, "t")
    land(spark, [], source, "1")
    end_mark(spark, marks, START)
    feed = spark.readStream.schema(FEED).option("recursiveFileLookup", "true").parquet(source)
    stream_reports(with_end_marks(feed, marks), root, f"{root}/cp").awaitTermination()
    assert read(spark, root) == []
