"""Session settings and the shared folder that state and intermediate tables live in."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "pricelens", **conf: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The reliable folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without the setting gets a temporary folder; a cluster
    without it is refused, because a machine-local folder would not survive an executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is not None:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    folder = tempfile.mkdtemp(prefix="pricelens-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared one, in that of this application; never reused."""
    return f"{scratch_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/pricelens/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> bool:
    """Remove all intermediate tables of this application.

    For applications that live long: call it between runs, when no lazy result of an earlier one
    is read any more. Stores, reports and stream state lie where their caller put them and stay.
    """
    return drop_folder(spark, scratch_root(spark))


def materialize(df: DataFrame, purpose: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and go on from there.

    For narrow tables that several later steps read: their source is not scanned again,
    their size is known to the planner, and a lost executor costs no more than reading the
    written part again.
    """
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> bool:
    """Remove a folder of intermediate tables, on whatever file system it is."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.delete(folder, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="pricelens-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
