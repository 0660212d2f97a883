"""Table helpers: cutting lineage, safe column names, functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_folder, scratch_path, shared_dir

Row = dict[str, pa.Array]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in ``spark.checkpoint.dir``, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Workspace:
    """The written tables of one operator, below ``spark.checkpoint.dir``.

    :meth:`last` writes the table that the lazy result is read from, and removes all others.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.root, self.made = spark, scratch_path(spark, purpose), 0

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.made}"
        self.made += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def last(self, df: DataFrame) -> DataFrame:
        found = self.table(df)
        for k in range(self.made - 1):
            drop_folder(self.spark, f"{self.root}/{k}")
        return found


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet, in any letter case."""
    taken, found, k = {c.lower() for c in df.columns}, name, 0
    while found.lower() in taken:
        k += 1
        found = f"{name}_{k}"
    return found


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def bucket(column: str, buckets: int):
    """crc32 of an id as text, modulo ``buckets``: the fixed split into folds."""
    return F.crc32(F.col(column).cast("string")) % buckets


def over_batches(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], Row]],
    schema: str,
    keep: list[str] | None = None,
) -> DataFrame:
    """One output row for each input row: the columns ``keep`` and those that a function returns.

    ``make`` runs once in each task and gives the function for the task's batches.
    """
    kept = [f for f in df.schema.fields if f.name in (keep or [])]
    names = [f.name for f in kept]
    head = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            made = work(batch)
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, *made.values()], names=[*names, *made])

    return df.mapInArrow(run, ", ".join(x for x in (head, schema) if x))


def mapped(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[Row]]], schema: str
) -> DataFrame:
    """Any number of output rows: a function returns column groups for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for made in work(batch):
                yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    return df.mapInArrow(run, schema)
