"""Filters and checks on offers and listings before they are resolved."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truthy
from ..functions.vocabulary import OUT_OF_STOCK_TEXT
from ..schema import DEFAULT_SOURCES, Source, source_ids


def present(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def drop_incomplete(
    df: DataFrame,
    name: str = "name",
    url: str | None = "url",
    text: str | None = None,
    cash: str | None = "cash_price",
) -> DataFrame:
    """Keep rows with a name, a url, a cash price and no out-of-stock text."""
    keep = present(F.col(name))
    if url:
        keep = keep & present(F.col(url))
    if text:
        keep = keep & ~F.coalesce(F.col(text).contains(OUT_OF_STOCK_TEXT), F.lit(False))
    if cash:
        keep = keep & truthy(F.col(cash))
    return df.where(keep)


def invalid_sources(df: DataFrame, sources: Sequence[Source] = DEFAULT_SOURCES) -> DataFrame:
    """Rows per source that is not in the list of known sources."""
    known = F.col("source").isin(source_ids(sources))
    return df.where(~F.coalesce(known, F.lit(False))).groupBy("source").agg(
        F.count(F.lit(1)).alias("rows")
    )


def validate_sources(df: DataFrame, sources: Sequence[Source] = DEFAULT_SOURCES) -> DataFrame:
    """The same rows; the job fails on the first row of an unknown source."""
    ids = source_ids(sources)
    known = F.coalesce(F.col("source").isin(ids), F.lit(False))
    message = F.concat(
        F.lit("unknown source: "), F.coalesce("source", F.lit("null")),
        F.lit("; known: " + ", ".join(ids)),
    )
    checked = F.when(known, F.col("source")).otherwise(F.raise_error(message).cast("string"))
    return df.withColumn("source", checked)


def source_rank(c: Column, sources: Sequence[Source] = DEFAULT_SOURCES) -> Column:
    """Place of a source in load and report order."""
    rank = F.when(c == sources[0].id, F.lit(0))
    for i, s in enumerate(sources[1:], start=1):
        rank = rank.when(c == s.id, F.lit(i))
    return rank


def position(*columns: str | Column) -> Column:
    """Place of a row as an array of numbers: the same type for every source."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.array(*[p.cast("bigint") for p in parts])


def with_ord(
    df: DataFrame, positions: Sequence[str], sources: Sequence[Source] = DEFAULT_SOURCES
) -> DataFrame:
    """Load order: source order first, then the row's position inside its source.

    ``ord`` is a struct that compares field by field. It needs no global sort, and it is as
    unique as the position columns are.
    """
    return df.withColumn(
        "ord", F.struct(source_rank(F.col("source"), sources).alias("rank"), *positions)
    )


def by_source_rank(df: DataFrame, sources: Sequence[Source] = DEFAULT_SOURCES) -> DataFrame:
    """Rows in report order, the anchor first."""
    return df.orderBy(source_rank(F.col("source"), sources))


def union_sources(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
