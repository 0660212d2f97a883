"""One run after another: collect offers, report alerts, remember what was reported.

The offer store holds the last good offers of each source. The memory holds the alert keys
of the last report, one folder per report, so writing a new one never touches the one that
is being compared with.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import FLAT_LIMIT, SHARE_LIMIT
from ..operators.incremental import only_new
from ..schema import DEFAULT_SOURCES, Source
from ..session import materialize
from ..sources import versions
from ..sources.snapshots import clear_snapshots, load_offers, write_snapshot
from ..streaming.state import batch_path, folders
from .jobs import report

log = logging.getLogger(__name__)


def collect(
    jobs: Mapping[str, Callable[[], DataFrame]],
    store: str,
    scraped_at: Column,
    sources: Sequence[Source] = DEFAULT_SOURCES,
) -> dict[str, str]:
    """Run one extraction job per source and store what it finds.

    A job that fails or finds nothing leaves its source's last offers alone and does not
    keep the others from running. Returns ``stored``, or the error, per source.
    """
    outcome = {}
    for source, job in jobs.items():
        try:
            write_snapshot(job(), store, scraped_at, sources)
            outcome[source] = "stored"
        except Exception as error:  # noqa: BLE001 - any failure keeps the old offers
            log.warning("%s failed, keeping its old offers: %s", source, error)
            outcome[source] = f"failed: {error}"
    return outcome


def send_report(
    spark: SparkSession,
    store: str,
    memory: str,
    new_only: bool = False,
    clear_after: bool = False,
    sources: Sequence[Source] = DEFAULT_SOURCES,
    flat: float = FLAT_LIMIT,
    share: float = SHARE_LIMIT,
) -> DataFrame | None:
    """The report over the stored offers; with ``new_only`` without the last report's alerts.

    Numbers are given before old alerts are left out. All alerts of this report, sent or
    not, become the memory of the next one. Without any stored offers nothing changes and
    the result is None.
    """
    if not folders(spark, store, "source="):
        return None
    offers = load_offers(spark, store, sources)
    if offers.isEmpty():
        return None
    alerts = materialize(report(offers, sources, flat, share))
    earlier = folders(spark, memory, "batch=")
    sent = alerts
    if new_only and earlier:
        last = batch_path(memory, max(earlier))
        sent = materialize(only_new(alerts, spark.read.parquet(last)))
    following = max(earlier, default=-1) + 1
    alerts.select("alert_key").write.mode("overwrite").parquet(batch_path(memory, following))
    if clear_after:
        clear_snapshots(spark, store, sources)
    return sent


def reset_memory(spark: SparkSession, memory: str) -> None:
    """Forget the last report: the next one finds every alert new."""
    following = max(folders(spark, memory, "batch="), default=-1) + 1
    spark.createDataFrame([], "alert_key string").write.mode("overwrite").parquet(
        batch_path(memory, following)
    )


def collect_version(
    spark: SparkSession,
    jobs: Mapping[str, Callable[[], DataFrame]],
    store: str,
    at: str,
    sources: Sequence[Source] = DEFAULT_SOURCES,
) -> tuple[int, dict[str, str]]:
    """Run all extraction jobs and publish what they find as one version of the store.

    Nothing is seen before every job has ended. A job that fails or finds nothing leaves its
    source's last offers alone. Returns the number of the version and the outcome of each source;
    without any new offers the last version stays.
    """
    folders, outcome = {}, {}
    for source, job in jobs.items():
        try:
            staged = versions.stage(job(), store, F.lit(at).cast("timestamp"), sources)
            folders |= staged
            outcome[source] = "stored" if staged else "empty"
        except Exception as error:  # noqa: BLE001 - any failure keeps the old offers
            log.warning("%s failed, keeping its old offers: %s", source, error)
            outcome[source] = f"failed: {error}"
    if not folders:
        return versions.current(spark, store).number, outcome
    return versions.publish(spark, store, folders, at), outcome


def report_version(
    spark: SparkSession,
    store: str,
    reports: str,
    new_only: bool = False,
    number: int | None = None,
    sources: Sequence[Source] = DEFAULT_SOURCES,
    flat: float = FLAT_LIMIT,
    share: float = SHARE_LIMIT,
) -> DataFrame | None:
    """The report over a version of the store; with ``new_only`` without the alerts of the report before.

    A report is kept under the number of its version, whole or not at all, so giving it again
    changes nothing. The one before is that of the last smaller version that has one.
    """
    number = versions.current(spark, store, number).number
    offers = versions.read_version(spark, store, number, sources)
    if offers is None:
        return None
    path = batch_path(reports, number)
    report(offers, sources, flat, share).write.mode("overwrite").parquet(path)
    alerts = spark.read.parquet(path)
    done = [n for n in folders(spark, reports, "batch=") if n < number and _ended(spark, batch_path(reports, n))]
    if new_only and done:
        return only_new(alerts, spark.read.parquet(batch_path(reports, max(done))))
    return alerts


def _ended(spark: SparkSession, folder: str) -> bool:
    """Whether a folder was written to its end."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def pages_to_report(
    spark: SparkSession,
    jobs: Mapping[str, Callable[[], DataFrame]],
    store: str,
    reports: str,
    at: str,
    new_only: bool = True,
    sources: Sequence[Source] = DEFAULT_SOURCES,
    flat: float = FLAT_LIMIT,
    share: float = SHARE_LIMIT,
) -> DataFrame | None:
    """One whole run: stored pages through all jobs into a version, and its report."""
    number, _ = collect_version(spark, jobs, store, at, sources)
    return report_version(spark, store, reports, new_only, number, sources, flat, share)
