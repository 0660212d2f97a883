"""Tables that belong to one micro-batch each.

A batch may be run again after a failure, so it only ever writes below its own number and
only reads what batches with smaller numbers wrote.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def batch_path(root: str, batch_id: int) -> str:
    return f"{root}/batch={batch_id:012d}"


def folders(spark: SparkSession, root: str, prefix: str) -> list:
    """Names below ``root`` behind ``prefix``, as numbers where they are numbers."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    found = [n.removeprefix(prefix) for n in names if n.startswith(prefix)]
    return [int(n) if n.isdigit() else n for n in found]


def drop_before(spark: SparkSession, root: str, batch_id: int) -> None:
    """Remove what no repeated batch can read any more: all but the last folder before it."""
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    earlier = sorted(n for n in folders(spark, root, "batch=") if n < batch_id)
    for n in earlier[:-1]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(batch_path(root, n))
        folder.getFileSystem(configuration).delete(folder, True)


def latest_before(spark: SparkSession, root: str, batch_id: int) -> str | None:
    """Folder of the latest batch below ``batch_id``, None if there is none."""
    earlier = [n for n in folders(spark, root, "batch=") if n < batch_id]
    return batch_path(root, max(earlier)) if earlier else None
