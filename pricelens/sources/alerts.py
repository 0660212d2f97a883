"""The alert table, and sending its messages so that a bad one does not hold back the others."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship_package

#: What makes two rows the same message of the same run.
MESSAGE = ("run", "product_key")
_OUTCOME = "status string, error string"


def write_alerts(alerts: DataFrame, path: str) -> None:
    """Append alerts; one row per message, so one bad message cannot hold back another."""
    alerts.write.mode("append").parquet(path)


def deliveries(spark: SparkSession, path: str) -> DataFrame | None:
    """Everything that was ever tried, with ``status`` (sent or failed) and ``error``; None if nothing was."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return None
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


def failures(spark: SparkSession, path: str, keys: Sequence[str] = MESSAGE) -> DataFrame | None:
    """Messages that were tried and never sent, with their last error."""
    tried = deliveries(spark, path)
    if tried is None:
        return None
    sent = tried.where("status = 'sent'").select(*keys).distinct()
    failed = tried.where("status = 'failed'").join(sent, list(keys), "left_anti")
    return failed.groupBy(*keys).agg(F.count(F.lit(1)).alias("attempts"), F.max_by("error", "attempt").alias("error"))


def deliver(
    alerts: DataFrame,
    path: str,
    send: Callable[[dict], None],
    keys: Sequence[str] = MESSAGE,
    attempt: int = 1,
) -> DataFrame:
    """Send every alert that was not sent before, and write down what became of each.

    ``send`` gets a row as a dict and raises if the message can't be delivered. It is called in the
    tasks that hold the rows; an error is kept with its message, and the others go on. Outcomes lie
    below ``path`` in a folder of their own for each call, which counts only if the whole call
    ended. Calling it again with the same alerts sends the failed ones only. Of rows with equal
    ``keys`` one is sent. A task that is run again sends its messages again, as any sink outside
    Spark would see; what was written counts once.
    """
    spark = alerts.sparkSession
    ship_package(spark)
    todo = alerts.dropDuplicates(list(keys))
    before = deliveries(spark, path)
    if before is not None:
        sent = before.where("status = 'sent'").select(*keys).distinct()
        todo = todo.join(sent, list(keys), "left_anti").select(*alerts.columns)
    names = todo.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status, errors = [], []
            for row in batch.to_pylist():
                try:
                    send(row)
                    status.append("sent")
                    errors.append(None)
                except Exception as error:  # noqa: BLE001 - whatever it is, the others go on
                    status.append("failed")
                    errors.append(f"{type(error).__name__}: {error}")
            made = [pa.array(status, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, "status", "error"])

    schema = StructType([*todo.schema.fields, *StructType.fromDDL(_OUTCOME).fields])
    folder = f"{path}/{uuid.uuid4().hex}"
    todo.mapInArrow(run, schema).withColumn("attempt", F.lit(attempt)).write.parquet(folder)
    return spark.read.parquet(folder)
