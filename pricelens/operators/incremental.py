"""Runs over time: which snapshots a run sees and which of its alerts are new.

Runs are hours, so tables with one row per run (or per run and source) are bounded by the
calendar, not by the data; windows are taken over those tables only.

Offers per run and alerts are each read more than once here. Pass them materialized (see
``session.materialize``) where they are expensive to compute.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prices import installment_reference, is_alert
from ..functions.schedule import COLLECT_HOUR, FULL, NEW_ONLY, class_of_local
from ..functions.vocabulary import FLAT_LIMIT, SHARE_LIMIT
from ..schema import DEFAULT_SOURCES, Source, source_ids


def only_new(alerts: DataFrame, previous: DataFrame, key: str = "alert_key") -> DataFrame:
    """Alerts whose key was not among the previous run's."""
    return alerts.join(previous.select(key).distinct(), key, "left_anti")


def hourly_runs(feed: DataFrame) -> DataFrame:
    """Best offer per run, source and product; a run is the hour of ``ts``."""
    order = F.struct(F.coalesce("cash_price", F.lit(float("inf"))).alias("cash"), "ord")
    best = F.min_by(F.struct("cash_price", "installment_price"), order).alias("_best")
    return (
        feed.withColumn("run", F.date_trunc("hour", "ts"))
        .groupBy("run", "source", "product_key")
        .agg(best)
        .select("run", "source", "product_key", "_best.*")
    )


def asof_snapshots(
    runs: DataFrame, snapshots: DataFrame, sources: Sequence[Source] = DEFAULT_SOURCES
) -> DataFrame:
    """``run, source, snapshot_run``: the latest snapshot of each source a run can see.

    ``runs`` has ``run``, ``snapshots`` has ``source, run``; a source without a snapshot up
    to a run has no row for it.
    """
    ids = F.array(*[F.lit(i) for i in source_ids(sources)])
    grid = runs.select("run").distinct().select("run", F.explode(ids).alias("source"))
    taken = snapshots.select("source", "run").distinct()
    marks = grid.withColumn("_asked", F.lit(True)).join(
        taken.withColumn("_taken", F.col("run")), ["source", "run"], "full"
    )
    upto = Window.partitionBy("source").orderBy("run").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    carried = marks.withColumn("snapshot_run", F.last("_taken", True).over(upto))
    return carried.where(
        F.coalesce("_asked", F.lit(False)) & F.col("snapshot_run").isNotNull()
    ).select("run", "source", "snapshot_run")


def asof_latest(
    asked: DataFrame, taken: DataFrame, key: str, time: str = "ts", width_s: int = 3600
) -> DataFrame:
    """``asked`` with the columns of the last row of ``taken`` that has the same key, up to its time.

    ``taken`` has ``key``, ``time`` and any value columns; of equal times the row with the largest
    values counts. Values are null where nothing was taken before, or where a key or time is null.
    Times are arbitrary, so one key can have very many rows; they are carried forward in two levels:
    inside buckets of ``width_s`` seconds, which are sorted apart from one another, and from
    bucket to bucket over one row for each bucket.
    """
    values = [c for c in taken.columns if c not in (key, time)]
    bucket = F.floor(F.unix_micros(time) / (width_s * 1_000_000))
    value = F.struct(*values)
    marks = taken.where(F.col(time).isNotNull()).select(
        key, F.col(time).alias("_time"), F.lit(0).alias("_asks"), value.alias("_value"), bucket.alias("_bucket"),
        F.lit(None).cast(asked.select(F.struct("*")).schema[0].dataType).alias("_row"),
    )
    rows = asked.select(
        key, F.col(time).alias("_time"), F.lit(1).alias("_asks"),
        F.lit(None).cast(marks.schema["_value"].dataType).alias("_value"), bucket.alias("_bucket"),
        F.struct(*[F.col(c) for c in asked.columns]).alias("_row"),
    )
    # Equal marks ordered by value, requests behind them.
    inside = Window.partitionBy(key, "_bucket").orderBy("_time", "_asks", "_value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = marks.unionByName(rows).withColumn("_near", F.last("_value", True).over(inside)).where("_asks = 1")

    ends = marks.groupBy(key, "_bucket").agg(F.max_by("_value", F.struct("_time", "_value")).alias("_value"))
    needed = rows.select(key, "_bucket").distinct().join(ends, [key, "_bucket"], "full")
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = needed.withColumn("_far", F.last("_value", True).over(before)).select(key, "_bucket", "_far")
    found = local.join(carried, [key, "_bucket"], "left")
    known = F.col("_time").isNotNull() & F.col(key).isNotNull()
    last = F.when(known, F.coalesce("_near", "_far"))
    return found.select("_row.*", *[last[c].alias(c) for c in values])


def run_alerts(
    best: DataFrame,
    runs: DataFrame,
    sources: Sequence[Source] = DEFAULT_SOURCES,
    flat: float = FLAT_LIMIT,
    share: float = SHARE_LIMIT,
) -> DataFrame:
    """``run, product_key`` of every product that raises an alert in a run.

    Each run compares the latest snapshot of every source. ``best`` is the output of
    :func:`hourly_runs`.
    """
    seen = asof_snapshots(runs, best, sources)
    # One row per run and source, bounded by the calendar: sent to the offers, which stay where
    # they are instead of meeting in a few keys per hour.
    offers = best.withColumnRenamed("run", "snapshot_run").join(
        F.broadcast(seen), ["source", "snapshot_run"]
    )
    entry = F.struct("cash_price", "installment_price")
    slots = [
        F.max(F.when(F.col("source") == s.id, entry)).alias(f"_s{i}")
        for i, s in enumerate(sources)
    ]
    wide = offers.groupBy("run", "product_key").agg(*slots).where(F.col("_s0").isNotNull())
    cash, installment = F.col("_s0.cash_price"), F.col("_s0.installment_price")
    reference = installment_reference(cash, installment)
    alerting = [
        is_alert(cash, F.col(f"_s{i}.cash_price"), flat, share)
        | is_alert(reference, F.col(f"_s{i}.installment_price"), flat, share)
        for i in range(1, len(sources))
    ]
    return wide.where(reduce(or_, alerting)).select("run", "product_key")


def previous_runs(runs: DataFrame, within: str | None = None) -> DataFrame:
    """Each run with the run before it, of the same group if ``within`` is given."""
    window = Window.partitionBy(within) if within else Window.partitionBy()
    return runs.withColumn("previous_run", F.lag("run").over(window.orderBy("run")))


def _not_in_previous(alerts: DataFrame, runs: DataFrame, earlier: DataFrame, key: str) -> DataFrame:
    """Alerts missing from the run before; matched on run and key, so no key is hot."""
    known = earlier.select(F.col("run").alias("previous_run"), key).distinct()
    return (
        alerts.join(F.broadcast(runs), "run")
        .join(known, ["previous_run", key], "left_anti")
        .select(*alerts.columns)
    )


def new_alerts_by_run(
    alerts: DataFrame,
    runs: DataFrame,
    key: str = "product_key",
    remembered: DataFrame | None = None,
) -> DataFrame:
    """Alerts whose key did not alert in the run immediately before.

    ``runs`` lists all runs with data, also those without alerts: they empty the memory.
    ``remembered`` adds alerts of earlier runs, for work that continues after a restart.
    """
    ordered = previous_runs(runs.select("run").distinct())
    known = alerts if remembered is None else alerts.select("run", key).unionByName(
        remembered.select("run", key)
    )
    return _not_in_previous(alerts, ordered, known, key)


def alerts_by_schedule(alerts: DataFrame, runs: DataFrame, key: str = "product_key") -> DataFrame:
    """What the daily schedule delivers, from alerts and runs in local time.

    The full run reports all alerts, later runs of the day those not in the run before. The
    memory is dropped at the collecting hour, so a day's first run has none.
    """
    day = F.to_date(F.col("run") - F.expr(f"interval {COLLECT_HOUR} hours"))
    reporting = (
        runs.select("run").distinct()
        .withColumns({"run_class": class_of_local(F.col("run")), "_day": day})
        .where(F.col("run_class").isin(FULL, NEW_ONLY))
    )
    ordered = previous_runs(reporting, "_day")
    classed = alerts.join(F.broadcast(ordered.select("run", "run_class")), "run")
    full = classed.where(F.col("run_class") == FULL)
    fresh = _not_in_previous(
        classed.where(F.col("run_class") == NEW_ONLY),
        ordered.select("run", "previous_run"), alerts, key,
    )
    return full.unionByName(fresh)


def alert_counts(alerts: DataFrame, new_alerts: DataFrame) -> DataFrame:
    """Alerts and new alerts per run."""
    marked = alerts.select("run", F.lit(0).alias("_new")).unionByName(
        new_alerts.select("run", F.lit(1).alias("_new"))
    )
    return marked.groupBy("run").agg(
        F.count_if(F.col("_new") == 0).alias("alerts"),
        F.count_if(F.col("_new") == 1).alias("new_alerts"),
    )
