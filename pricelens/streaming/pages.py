"""Pages as a stream of files: a page is read again only if its content changed.

The state has one narrow row per url: when its last version was stored, and a hash of that. Of each
batch the newest version of a url counts, unless a newer one is known; if its hash is the known
one, the page is not read. Deciding that moves urls and hashes only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .state import batch_path, drop_before, folders, latest_before

VERSION = ("url", "stored_at", "hash1", "hash2")


def with_hashes(pages: DataFrame) -> DataFrame:
    """``pages`` with 128 bits that tell their contents apart."""
    return pages.withColumns({"hash1": F.xxhash64("html"), "hash2": F.xxhash64(F.lit(7), "html")})


def newest(versions: DataFrame) -> DataFrame:
    """The last version of each url; of versions stored at one time the one with the largest hash."""
    rest = F.struct(*[c for c in VERSION if c != "url"])
    return versions.groupBy("url").agg(F.max(rest).alias("v")).select("url", "v.*")


def stream_changed_pages(
    pages: DataFrame, parse: Callable[[DataFrame], DataFrame], root: str, checkpoint: str
) -> StreamingQuery:
    """Read all pages available now; what ``parse`` makes of changed ones lands in ``root/out``.

    ``pages`` has ``url, stored_at, html`` and any other columns; ``parse`` gets rows of them and keeps
    ``url``. Rows without url or html are left out. Equal rows of a batch are read once. Running a
    batch again writes the same folders again.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marked = with_hashes(batch.where(F.col("url").isNotNull() & F.col("html").isNotNull()))
        found = newest(marked.select(*VERSION))
        before = latest_before(spark, f"{root}/seen", batch_id)
        known = spark.read.parquet(before) if before else found.limit(0)
        last = known.select("url", *[F.col(c).alias(f"_{c}") for c in VERSION[1:]])
        judged = found.join(last, "url", "left")
        newer = F.col("_stored_at").isNull() | (F.col("stored_at") > F.col("_stored_at"))
        same = (F.col("hash1") == F.col("_hash1")) & (F.col("hash2") == F.col("_hash2"))
        path = batch_path(f"{root}/changed", batch_id)
        changed = judged.where(newer & ~F.coalesce(same, F.lit(False))).select(*VERSION)
        changed.write.mode("overwrite").parquet(path)
        changed = spark.read.parquet(path)
        keys = list(VERSION)
        todo = marked.join(changed, keys, "left_semi")
        if _repeated(marked):
            todo = todo.dropDuplicates(keys)
        parse(todo.drop("hash1", "hash2")).write.mode("overwrite").parquet(batch_path(f"{root}/out", batch_id))
        newest(known.unionByName(found)).write.mode("overwrite").parquet(batch_path(f"{root}/seen", batch_id))
        drop_before(spark, f"{root}/seen", batch_id)

    return (
        pages.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _repeated(marked: DataFrame) -> bool:
    """Whether a version comes twice in a batch; only then pages have to be exchanged."""
    return not marked.groupBy(*VERSION).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def current_rows(spark: SparkSession, root: str) -> DataFrame | None:
    """What ``parse`` made of the last version of each url; None before the first batch."""
    done = folders(spark, f"{root}/out", "batch=")
    if not done:
        return None
    rows = spark.read.option("basePath", f"{root}/out").parquet(*[batch_path(f"{root}/out", n) for n in sorted(done)])
    changed = spark.read.parquet(f"{root}/changed")
    last = changed.groupBy("url").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["url", "batch"], "left_semi").drop("batch")
