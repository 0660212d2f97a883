"""The offer store kept up to date by a stream: the latest closed run of each source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .alerts import closed_hours
from .state import batch_path, drop_before


def stream_snapshots(
    feed: DataFrame, path: str, state_path: str, checkpoint: str, delay: str = "1 hour"
) -> StreamingQuery:
    """Replace a source's offers by those of its latest closed run.

    Runs close in time order, so a batch's latest run of a source is newer than what is
    stored. Running a batch again writes the same partitions again.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        closed_path = batch_path(f"{state_path}/closed", batch_id)
        batch.write.mode("overwrite").parquet(closed_path)
        closed = spark.read.parquet(closed_path).where("source is not null")  # no end marks
        latest = closed.groupBy("source").agg(F.max("run").alias("run"))
        replaced = closed.join(latest, ["source", "run"], "left_semi")
        (
            replaced.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("source")
            .parquet(path)
        )
        drop_before(spark, f"{state_path}/closed", batch_id)

    return (
        closed_hours(feed, delay)
        .writeStream.outputMode("append")
        .foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
