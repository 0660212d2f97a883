"""The run loop as a stream: every closed hour emits the alerts that are new in it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.vocabulary import FLAT_LIMIT, SHARE_LIMIT
from ..operators.incremental import new_alerts_by_run, run_alerts
from ..schema import DEFAULT_SOURCES, Source
from .state import batch_path, drop_before, latest_before

RUN_LENGTH = "1 hour"


def closed_hours(feed: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Best offer per closed hour, source and product; later rows are dropped.

    The watermark bounds the state to the hours that are still open.
    """
    order = F.struct(F.coalesce("cash_price", F.lit(float("inf"))).alias("cash"), "ord")
    best = F.min_by(F.struct("cash_price", "installment_price"), order).alias("_best")
    return (
        feed.withWatermark("ts", delay)
        .groupBy(F.window("ts", RUN_LENGTH), "source", "product_key")
        .agg(best)
        .select(F.col("window.start").alias("run"), "source", "product_key", "_best.*")
    )


def stream_new_alerts(
    feed: DataFrame,
    state_path: str,
    out_path: str,
    checkpoint: str,
    sources: Sequence[Source] = DEFAULT_SOURCES,
    flat: float = FLAT_LIMIT,
    share: float = SHARE_LIMIT,
    delay: str = "1 hour",
) -> StreamingQuery:
    """Start the run loop over all data available now; new alerts land in ``out_path``.

    Between batches it keeps the latest snapshot of each source and the alerts of the last
    run. One batch may close many hours; they are compared in order inside it.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        closed_path = batch_path(f"{state_path}/closed", batch_id)
        batch.write.mode("overwrite").parquet(closed_path)
        closed = spark.read.parquet(closed_path).where("source is not null")  # no end marks
        if closed.isEmpty():
            return
        runs = closed.select("run").distinct()
        snapshots, remembered, all_runs = closed, None, runs
        before = latest_before(spark, f"{state_path}/memory", batch_id)
        if before:
            snapshots = closed.unionByName(spark.read.parquet(f"{before}/snapshots"))
            remembered = spark.read.parquet(f"{before}/alerts")
            all_runs = runs.unionByName(spark.read.parquet(f"{before}/last_run"))

        alerts_path = batch_path(f"{state_path}/alerts", batch_id)
        found = run_alerts(snapshots, runs, sources, flat, share)
        found.write.mode("overwrite").parquet(alerts_path)
        alerts = spark.read.parquet(alerts_path)
        fresh = new_alerts_by_run(alerts, all_runs, "product_key", remembered)
        fresh.write.mode("overwrite").parquet(batch_path(out_path, batch_id))

        memory = batch_path(f"{state_path}/memory", batch_id)
        last_run = runs.agg(F.max("run").alias("run"))
        latest = snapshots.groupBy("source").agg(F.max("run").alias("run"))
        snapshots.join(latest, ["source", "run"], "left_semi").write.mode(
            "overwrite"
        ).parquet(f"{memory}/snapshots")
        alerts.join(last_run, "run", "left_semi").write.mode("overwrite").parquet(
            f"{memory}/alerts"
        )
        last_run.write.mode("overwrite").parquet(f"{memory}/last_run")
        for kept in ("closed", "alerts", "memory"):
            drop_before(spark, f"{state_path}/{kept}", batch_id)

    return (
        closed_hours(feed, delay)
        .writeStream.outputMode("append")
        .foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
