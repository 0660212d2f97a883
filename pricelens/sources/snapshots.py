"""The offer store: the last non-empty set of offers of each source.

A parquet table partitioned by source. Writing replaces only the partitions that are in the
frame, so a source that delivered nothing keeps its old offers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.offers import source_rank, validate_sources
from ..schema import DEFAULT_SOURCES, Source, source_ids


def write_snapshot(
    df: DataFrame,
    path: str,
    scraped_at: Column,
    sources: Sequence[Source] = DEFAULT_SOURCES,
) -> None:
    """Replace the offers of every source in ``df``, stamped with the time of the run.

    Rows are written by the tasks that hold them: no shuffle, and a source with most of the
    rows is written by many tasks.
    """
    stamped = validate_sources(df, sources).withColumn("scraped_at", scraped_at)
    (
        stamped.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("source")
        .parquet(path)
    )


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(hadoop)


def read_snapshot(spark: SparkSession, path: str, source: str) -> DataFrame | None:
    """The offers of one source (only its partition is read), None if nothing is stored."""
    if not _exists(spark, f"{path}/source={source}"):
        return None
    return spark.read.parquet(path).where(F.col("source") == source)


def read_all(
    spark: SparkSession, path: str, sources: Sequence[Source] = DEFAULT_SOURCES
) -> DataFrame:
    """All stored offers with the rank of their source; absent sources have no rows."""
    stored = spark.read.parquet(path).where(F.col("source").isin(source_ids(sources)))
    return stored.withColumn("source_rank", source_rank(F.col("source"), sources))


def load_offers(
    spark: SparkSession, path: str, sources: Sequence[Source] = DEFAULT_SOURCES
) -> DataFrame:
    """All stored offers in load order: by source, then by the ``ord`` they were stored with."""
    stored = read_all(spark, path, sources)
    return stored.withColumn("ord", F.struct("source_rank", "ord")).drop("source_rank")


def last_updated(snapshots: DataFrame) -> DataFrame:
    """When each source was last written."""
    return snapshots.groupBy("source").agg(F.max("scraped_at").alias("updated_at"))


def clear_snapshots(
    spark: SparkSession, path: str, sources: Sequence[Source] = DEFAULT_SOURCES
) -> list[str]:
    """Drop the stored offers of the given sources; returns the ids that had any.

    Removes one folder per source (a fixed, small number); no rows are read.
    """
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    cleared = []
    for source in source_ids(sources):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/source={source}")
        if folder.getFileSystem(configuration).delete(folder, True):
            cleared.append(source)
    spark.catalog.refreshByPath(path)
    return cleared


def _per_source(sources: Sequence[Source]) -> Column:
    return F.explode(F.array(*[F.lit(i) for i in source_ids(sources)]))


def snapshot_status(
    snapshots: DataFrame, now: Column, sources: Sequence[Source] = DEFAULT_SOURCES
) -> DataFrame:
    """Offers and age in minutes per known source; null where nothing is stored."""
    stored = snapshots.groupBy("source").agg(
        F.count(F.lit(1)).alias("offers"), F.max("scraped_at").alias("scraped_at")
    )
    known = snapshots.sparkSession.range(1).select(_per_source(sources).alias("source"))
    seconds = F.unix_micros(now) - F.unix_micros(F.col("scraped_at"))
    return known.join(stored, "source", "left").select(
        "source",
        F.col("scraped_at").isNotNull().alias("found"),
        "offers",
        F.floor(seconds / 60e6 + 0.5).alias("age_minutes"),
    )


def stale_sources(
    snapshots: DataFrame,
    now: Column,
    max_age_h: float = 24,
    sources: Sequence[Source] = DEFAULT_SOURCES,
) -> DataFrame:
    """Known sources without offers, or with offers older than ``max_age_h`` hours."""
    updated = last_updated(snapshots)
    known = snapshots.sparkSession.range(1).select(_per_source(sources).alias("source"))
    age = F.unix_micros(now) - F.unix_micros(F.col("updated_at"))
    too_old = F.col("updated_at").isNull() | (age > F.lit(int(max_age_h * 3600 * 1_000_000)))
    return known.join(updated, "source", "left").where(too_old).select("source")
