"""The run loop over raw offers: every closed hour emits its numbered new alerts.

Offers come with the titles that the shops gave them, and titles are resolved inside the stream.
A run is an hour. It sees the latest snapshot of every source, numbers all its alerts in load
order, and sends those whose key (the display name) was not among the run before. Numbers
are given before old alerts are left out, so there are gaps.

The job keeps its own event time, as a column of its state, instead of a built-in window: so a row
that comes too late is written to a table of its own and counted, and an end mark can close the
last hours. An hour is closed once the newest row (or mark) of an earlier or this batch is ``delay``
past its end; a row is late if its hour was closed by the batches before. Every batch writes only
below its own number and reads only below smaller ones, so repeating it changes nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.report import NO_BREAK_SPACE
from ..functions.vocabulary import FLAT_LIMIT, SHARE_LIMIT
from ..operators.compare import alerts_only, build_messages
from ..operators.incremental import asof_snapshots, new_alerts_by_run
from ..operators.numbering import number_rows
from ..operators.offers import source_rank
from ..operators.resolve import cash_order, product_groups_by
from ..schema import DEFAULT_SOURCES, Source
from .state import batch_path, drop_before, latest_before

FEED = "ts timestamp, source string, name string, cash_price double, installment_price double, ord bigint"
HOUR = 3_600_000_000


def end_mark(spark: SparkSession, marks: str, ts: dt.datetime) -> None:
    """Say that no more offers up to ``ts`` will come; the next run closes the hours before."""
    spark.createDataFrame([(ts,)], "ts timestamp").coalesce(1).write.mode("append").parquet(marks)


def with_end_marks(feed: DataFrame, marks: str) -> DataFrame:
    """``feed`` with the marks of a folder: rows without a source that only move the time."""
    spark = feed.sparkSession
    read = spark.readStream.schema("ts timestamp").parquet(marks)
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in feed.schema.fields if f.name != "ts"]
    return feed.unionByName(read.select("ts", *nothing))


def _closed(until: int | None) -> Column:
    """Whether the hour ``run`` is closed by the time ``until``, in microseconds."""
    if until is None:
        return F.lit(False)
    return F.unix_micros("run") + HOUR <= F.lit(until)


def hourly_titles(offers: DataFrame) -> DataFrame:
    """Best offer and first position per run, source and title; the minima can be taken again."""
    best = F.min_by(F.struct("cash_price", "installment_price", "ord"), cash_order()).alias("_best")
    grouped = offers.groupBy("run", "source", "name").agg(best, F.min("first_ord").alias("first_ord"))
    return grouped.select("run", "source", "name", "_best.*", "first_ord")


def run_reports(
    closed: DataFrame,
    runs: DataFrame,
    sources: Sequence[Source] = DEFAULT_SOURCES,
    flat: float = FLAT_LIMIT,
    share: float = SHARE_LIMIT,
    group_sep: str = NO_BREAK_SPACE,
) -> DataFrame:
    """``run, n, product_key, alert_key, message`` of all alerts of each run in ``runs``.

    ``closed`` is the output of :func:`hourly_titles`, of all runs that may still be seen.
    """
    seen = asof_snapshots(runs, closed.select("source", "run"), sources)
    visible = closed.withColumnRenamed("run", "snapshot_run").join(seen, ["source", "snapshot_run"])
    rank = source_rank(F.col("source"), sources).alias("rank")
    placed = visible.withColumns(
        {"ord": F.struct(rank, F.col("ord").alias("at")), "first_ord": F.struct(rank, F.col("first_ord").alias("at"))}
    )
    groups = product_groups_by(placed, ["run"], sources)
    messages = alerts_only(build_messages(groups, sources, flat, share, group_sep, keep=["run"]))
    numbered = number_rows(messages, ["run", "first_ord"], "_n")
    starts = numbered.groupBy("run").agg(F.min("_n").alias("_start"))  # one row per run
    placed = numbered.join(starts, "run").withColumn("n", F.col("_n") - F.col("_start") + 1)
    text = F.concat(F.col("n").cast("string"), F.lit(". "), F.col("message"))
    return placed.select("run", "n", "product_key", "alert_key", text.alias("message"))


def stream_reports(
    feed: DataFrame,
    root: str,
    checkpoint: str,
    sources: Sequence[Source] = DEFAULT_SOURCES,
    flat: float = FLAT_LIMIT,
    share: float = SHARE_LIMIT,
    group_sep: str = NO_BREAK_SPACE,
    delay: dt.timedelta = dt.timedelta(hours=1),
) -> StreamingQuery:
    """Run the loop over all offers available now.

    ``feed`` has the columns FEED. New alerts land in ``root/out``, late rows in ``root/late``, and
    for each batch one row of ``rows, late`` in ``root/counts``; all in folders ``batch=…``. Rows
    without a source are end marks; rows without ``ts`` count as late.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def save(df: DataFrame, kind: str) -> DataFrame:
            path = batch_path(f"{root}/{kind}", batch_id)
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        memory = latest_before(spark, f"{root}/memory", batch_id)
        until = spark.read.parquet(f"{memory}/time").first()[0] if memory else None

        # One pass over the batch: rows by hour, the newest time, counts.
        rows = batch.withColumn("run", F.date_trunc("hour", "ts"))
        offer = F.col("source").isNotNull()
        rows = rows.withColumn("_late", offer & (F.col("ts").isNull() | _closed(until)))
        seen = Observation()
        counts = [F.count_if(offer).alias("rows"), F.count_if("_late").alias("late"), F.max(F.unix_micros("ts")).alias("newest")]
        kept = save(rows.observe(seen, *counts), "in")
        found = seen.get
        save(kept.where("_late").drop("_late", "run"), "late")
        save(spark.createDataFrame([(found["rows"], found["late"])], "rows bigint, late bigint").coalesce(1), "counts")

        on_time = hourly_titles(kept.where(~F.col("_late") & offer).withColumn("first_ord", F.col("ord")))
        if memory:
            on_time = hourly_titles(on_time.unionByName(spark.read.parquet(f"{memory}/open")))
        hours = save(on_time, "hours")
        newest = found["newest"]
        past = None if newest is None else newest - delay // dt.timedelta(microseconds=1)
        times = [t for t in (until, past) if t is not None]
        now = max(times) if times else None
        done = hours.where(_closed(now))
        runs = done.select("run").distinct()
        snapshots, remembered, all_runs = done, None, runs
        if memory:
            snapshots = done.unionByName(spark.read.parquet(f"{memory}/snapshots"))
            remembered = spark.read.parquet(f"{memory}/alerts")
            all_runs = runs.unionByName(spark.read.parquet(f"{memory}/last_run"))
        alerts = save(run_reports(snapshots, runs, sources, flat, share, group_sep), "alerts")
        save(new_alerts_by_run(alerts, all_runs, "alert_key", remembered), "out")

        # What the next batch needs: open hours, each source's last snapshot, the last run.
        last = all_runs.agg(F.max("run").alias("run")).where("run is not null")
        latest = snapshots.groupBy("source").agg(F.max("run").alias("run"))
        known = alerts.select("run", "alert_key")
        if remembered is not None:
            known = known.unionByName(remembered)
        folder = batch_path(f"{root}/memory", batch_id)
        parts = {
            "open": hours.where(~_closed(now)),
            "snapshots": snapshots.join(latest, ["source", "run"], "left_semi").select(*hours.columns),
            "alerts": known.join(last, "run", "left_semi"),
            "last_run": last,
            "time": spark.createDataFrame([(now,)], "time bigint").coalesce(1),
        }
        for name, df in parts.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
        for kind in ("in", "hours", "alerts", "memory"):
            drop_before(spark, f"{root}/{kind}", batch_id)

    return (
        feed.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
