"""Numbering rows 1..n in a global order without sending them through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def number_rows(df: DataFrame, order: list[str], out: str = "n") -> DataFrame:
    """Add the 1-based position of each row in the order of ``order``.

    Rows are range-partitioned and sorted; the checkpoint fixes which row lies in which
    partition, so the partition sizes (one row per partition, hence broadcast) and the
    rows they belong to cannot disagree when a task is run again.
    """
    shared_dir(df.sparkSession)
    cols = df.columns
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    placed = sorted_rows.withColumn("_id", F.monotonically_increasing_id()).select(
        *cols,
        F.shiftright("_id", _ROW_BITS).alias("_part"),
        F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"),
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    )
    numbered = placed.join(F.broadcast(starts), "_part")
    return numbered.select(*cols, (F.col("_start") + F.col("_row") + 1).alias(out))


def number_alerts(alerts: DataFrame, ord: str = "first_ord") -> DataFrame:
    """Number alerting products in first-seen order and put the number before the message."""
    numbered = number_rows(alerts, [ord], "n")
    return numbered.withColumn(
        "message", F.concat(F.col("n").cast("string"), F.lit(". "), F.col("message"))
    )
