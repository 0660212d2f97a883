"""Runs that change some sources: their digests and the products touched, published as versions.

The store of :mod:`..sources.versions` holds one digest per source, and under the name PRODUCTS the
products made from them; both change in one step.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.deltas import DIGEST, products, source_digest, touched_keys, updated
from ..schema import DEFAULT_SOURCES, Source
from ..sources import versions

PRODUCTS = "_products"


def _write(df: DataFrame, store: str) -> str:
    folder = f"data/batch={uuid.uuid4().hex}/all"
    df.write.parquet(f"{store}/{folder}")
    return folder


def run(
    spark: SparkSession,
    changes: Mapping[str, DataFrame],
    store: str,
    at: str,
    sources: Sequence[Source] = DEFAULT_SOURCES,
) -> tuple[int, int]:
    """Replace the offers of the sources in ``changes``; returns the version and the products touched.

    Only these offers are resolved. Of the digests of other sources and of the products, the rows of
    touched keys are joined, everything else is copied as it is. A source that delivers nothing
    keeps its old offers.
    """
    last = versions.current(spark, store)
    folders: dict[str, str] = {}
    touched = None
    for source, offers in changes.items():
        folder = _write(source_digest(offers.where(F.col("source") == source)), store)
        new = spark.read.parquet(f"{store}/{folder}")
        if new.isEmpty():
            continue
        old = spark.read.parquet(f"{store}/{last.folders[source]}") if source in last.folders else new.limit(0)
        keys = touched_keys(old, new)
        touched = keys if touched is None else touched.unionByName(keys)
        folders[source] = folder
    if touched is None:
        return last.number, 0
    place = _write(touched.distinct(), store)
    touched = spark.read.parquet(f"{store}/{place}")
    now = {s: f for s, f in {**last.folders, **folders}.items() if s != PRODUCTS}
    digests = spark.read.parquet(*[f"{store}/{f}" for _, f in sorted(now.items())]).select(*DIGEST)
    if PRODUCTS in last.folders:
        made = updated(spark.read.parquet(f"{store}/{last.folders[PRODUCTS]}"), digests, touched, sources)
    else:
        made = products(digests, sources)
    folders[PRODUCTS] = _write(made, store)
    return versions.publish(spark, store, folders, at), touched.count()


def current_products(spark: SparkSession, store: str) -> DataFrame | None:
    """The products of the last version, as ``product_groups`` would give them."""
    folder = versions.current(spark, store).folders.get(PRODUCTS)
    return spark.read.parquet(f"{store}/{folder}") if folder else None
