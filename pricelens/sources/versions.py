"""The offer store with history: every run is a version, and a version is seen as a whole or not.

Offers are written first, into folders of their own (``data/batch=…/source=…``) that nothing
refers to yet. A version is one small file that names the folder of each source, the unchanged
ones of earlier versions included. It is written under another name and then renamed, which fails
if the number is taken; so a run that dies before that was never there, readers of an older version
are not disturbed, and of two runs that end together the second one is put on top of the first.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.offers import source_rank, validate_sources
from ..schema import DEFAULT_SOURCES, Source, source_ids

LOG = "version long, at timestamp, source string, folder string"
ATTEMPTS = 20


class Version(NamedTuple):
    """A version's number and the folder of each source."""

    number: int
    folders: dict[str, str]


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    files = _files(spark, folder)
    if not files.exists(_path(spark, folder)):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(_path(spark, folder)))


def _numbers(spark: SparkSession, store: str) -> list[int]:
    names = (n.removesuffix(".json") for n in _names(spark, f"{store}/log") if n.endswith(".json"))
    return sorted(int(n) for n in names if n.isdigit())


def _log_file(store: str, number: int) -> str:
    return f"{store}/log/{number:012d}.json"


def history(spark: SparkSession, store: str) -> DataFrame:
    """``version, at, source, folder`` of all versions; a version without sources has one null row."""
    if not _numbers(spark, store):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).json(f"{store}/log/*.json")


def current(spark: SparkSession, store: str, number: int | None = None) -> Version:
    """The last version, or the one with this number; number 0 is the store before the first."""
    found = _numbers(spark, store)
    number = number if number is not None else (found[-1] if found else 0)
    if number == 0:
        return Version(0, {})
    if number not in found:
        raise ValueError(f"version {number} is not in the store; there are {found}")
    rows = spark.read.schema(LOG).json(_log_file(store, number)).where("source is not null").collect()
    return Version(number, {r.source: r.folder for r in rows})


def stage(
    df: DataFrame, store: str, scraped_at: Column, sources: Sequence[Source] = DEFAULT_SOURCES
) -> dict[str, str]:
    """Write offers where no version refers to them yet; returns the folder of each source in them.

    Rows are written by the tasks that hold them. A source without rows is not in the result, so
    its old offers stay.
    """
    spark = df.sparkSession
    batch = f"data/batch={uuid.uuid4().hex}"
    stamped = validate_sources(df, sources).withColumn("scraped_at", scraped_at)
    stamped.write.partitionBy("source").parquet(f"{store}/{batch}")
    names = _names(spark, f"{store}/{batch}")
    return {n.removeprefix("source="): f"{batch}/{n}" for n in names if n.startswith("source=")}


def publish(spark: SparkSession, store: str, folders: Mapping[str, str | None], at: str) -> int:
    """Make staged folders the next version, all of them at once; a source with None is dropped.

    ``at`` is the time of the run, as ISO text with a zone. Returns the number of the version.
    """
    context = spark.sparkContext
    jvm, configuration = context._jvm, context._jsc.hadoopConfiguration()
    for _ in range(ATTEMPTS):
        last = current(spark, store)
        state = {k: v for k, v in {**last.folders, **folders}.items() if v is not None}
        number = last.number + 1
        lines = [{"version": number, "at": at, "source": s, "folder": f} for s, f in sorted(state.items())]
        text = "\n".join(map(json.dumps, lines or [{"version": number, "at": at}]))
        hidden = _path(spark, f"{store}/log/.{uuid.uuid4().hex}")
        out = hidden.getFileSystem(configuration).create(hidden, False)
        out.write(bytearray(text.encode()))
        out.close()
        final = _path(spark, _log_file(store, number))
        context_of_files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            hidden.getFileSystem(configuration).getUri(), configuration
        )
        none = context._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context_of_files.rename(hidden, final, none)
            return number
        except Py4JJavaError as error:
            hidden.getFileSystem(configuration).delete(hidden, False)
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
    raise RuntimeError(f"{ATTEMPTS} other versions were published meanwhile")


def write_version(
    df: DataFrame, store: str, scraped_at: Column, at: str, sources: Sequence[Source] = DEFAULT_SOURCES
) -> int:
    """Stage and publish the offers of one run."""
    return publish(df.sparkSession, store, stage(df, store, scraped_at, sources), at)


def _read(spark: SparkSession, store: str, folders: Sequence[str]) -> DataFrame:
    found = spark.read.option("basePath", f"{store}/data").parquet(*[f"{store}/{f}" for f in folders])
    return found.withColumn("source", F.col("source").cast("string"))


def read_version(
    spark: SparkSession, store: str, number: int | None = None, sources: Sequence[Source] = DEFAULT_SOURCES
) -> DataFrame | None:
    """The offers of the last version, or of one number, in load order; None if it has none."""
    wanted = set(source_ids(sources))
    folders = [f for s, f in sorted(current(spark, store, number).folders.items()) if s in wanted]
    if not folders:
        return None
    ranked = _read(spark, store, folders).drop("batch")
    return ranked.withColumn("ord", F.struct(source_rank(F.col("source"), sources).alias("rank"), "ord"))


def versions_seen(runs: DataFrame, versions: DataFrame) -> DataFrame:
    """``run, version, at, source, folder``: the last version published up to each time ``run``.

    ``versions`` is :func:`history`. A run before the first version has no row. Runs and versions
    are bounded by the calendar, and the window is taken over them only.
    """
    asked = runs.select(F.col("run").alias("at"), F.lit(1).alias("_run"), F.lit(None).cast("long").alias("version"))
    taken = versions.select("at", F.lit(0).alias("_run"), "version").distinct()
    order = Window.partitionBy().orderBy("at", "_run", "version").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    carried = asked.distinct().unionByName(taken).withColumn("version", F.last("version", True).over(order))
    seen = carried.where("_run = 1 and version is not null").select(F.col("at").alias("run"), "version")
    return seen.join(versions, "version").where(F.col("source").isNotNull())


def offers_seen(spark: SparkSession, store: str, runs: DataFrame) -> DataFrame | None:
    """The offers that each run sees, with ``run`` and ``version``: the as-of read of the store.

    A folder seen by several runs is read once; None if no run sees anything.
    """
    seen = versions_seen(runs, history(spark, store))
    folders = sorted(r.folder for r in seen.select("folder").distinct().collect())  # one per run and source
    if not folders:
        return None
    place = F.concat(F.lit("data/batch="), F.col("batch"), F.lit("/source="), F.col("source"))
    offers = _read(spark, store, folders).withColumn("folder", place).drop("batch", "source")
    return offers.join(seen.select("run", "version", "source", "folder"), "folder").drop("folder")


def expire(spark: SparkSession, store: str, keep: int = 10, grace_hours: float = 24.0) -> list[str]:
    """Forget all but the last ``keep`` versions, and remove folders that no kept one names.

    Folders younger than ``grace_hours`` stay: they may belong to a run that has not published yet.
    Returns the removed folders.
    """
    numbers = _numbers(spark, store)
    kept = numbers[-keep:] if keep > 0 else []
    used = {f.rsplit("/", 1)[0] for n in kept for f in current(spark, store, n).folders.values()}
    files = _files(spark, store)
    for number in numbers[: len(numbers) - len(kept)]:
        files.delete(_path(spark, _log_file(store, number)), False)
    now = spark.sparkContext._jvm.java.lang.System.currentTimeMillis()
    removed = []
    for name in _names(spark, f"{store}/data"):
        folder = _path(spark, f"{store}/data/{name}")
        age = now - files.getFileStatus(folder).getModificationTime()
        if f"data/{name}" not in used and age >= grace_hours * 3_600_000:
            files.delete(folder, True)
            removed.append(f"data/{name}")
    return removed
