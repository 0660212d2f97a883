"""Entity resolution: offers with free-text titles to one row per product.

Every result here is a minimum of something (lowest price, first position), so it can be
taken in steps: per title, then per product. Each step combines rows before its shuffle, and
every distinct title is canonicalized once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.titles import base_key, normalize_title
from ..schema import DEFAULT_SOURCES, Source

ENTRY_FIELDS = ("name", "cash_price", "installment_price")


def cash_order(cash: str = "cash_price", ord: str = "ord") -> Column:
    """Lowest cash price first, a missing one last, equal ones in load order."""
    return F.struct(F.coalesce(F.col(cash), F.lit(float("inf"))).alias("cash"), ord)


def _slot(i: int) -> str:
    return f"_s{i}"


def distinct_titles(
    offers: DataFrame,
    sources: Sequence[Source] = DEFAULT_SOURCES,
    by: Sequence[str] = (),
    first: str = "ord",
    parts: int | None = None,
) -> DataFrame:
    """One row per title: the best offer of each source, and where it was seen first.

    The offers of source ``i`` are in the column ``_s{i}``, null if it has none. With ``by`` there
    is a row for each value of these columns; ``first`` holds the position that counts as seen.

    Making the key of a title takes long for its bytes: ``parts`` deals the titles over so many
    tasks, without it the session decides by bytes.
    """
    offer = F.struct("cash_price", "installment_price", "ord")
    best = [
        F.min_by(offer, F.when(F.col("source") == s.id, cash_order())).alias(_slot(i))
        for i, s in enumerate(sources)
    ]
    named = offers.where(F.col("name").isNotNull())
    titles = named.groupBy(*by, "name").agg(F.min(first).alias("first_ord"), *best)
    return titles.repartition(parts, *by, "name") if parts else titles


def with_product_keys(df: DataFrame, name: str = "name") -> DataFrame:
    keyed = df.withColumn("key", normalize_title(F.col(name)))
    return keyed.withColumn("base_key", base_key(F.col("key")))


def product_groups(
    offers: DataFrame, sources: Sequence[Source] = DEFAULT_SOURCES, parts: int | None = None
) -> DataFrame:
    """``base_key, product_key, first_ord, entries`` with one row per product.

    ``entries`` holds the best offer of each source, in source order, null where a source
    does not sell the product. The number of sources is fixed, so a product is one row of
    bounded size however many offers it has, and comparing sources needs no join.
    """
    return _grouped(with_product_keys(distinct_titles(offers, sources, parts=parts)), sources)


def product_groups_by(
    offers: DataFrame, by: Sequence[str], sources: Sequence[Source] = DEFAULT_SOURCES
) -> DataFrame:
    """Products for each value of the columns ``by``, for instance for each run.

    ``offers`` has ``first_ord`` beside ``ord``: where a title was seen first, which need not be
    its best offer. A title is canonicalized once, however many values it occurs with.
    """
    titles = distinct_titles(offers, sources, by, "first_ord")
    names = with_product_keys(titles.select("name").distinct())
    return _grouped(titles.join(names, "name"), sources, by)


def _grouped(keyed: DataFrame, sources: Sequence[Source], by: Sequence[str] = ()) -> DataFrame:
    """Products of distinct titles with their keys."""
    slots = []
    for i in range(len(sources)):
        cash, ord = F.col(_slot(i))["cash_price"], F.col(_slot(i))["ord"]
        entry = F.struct("name", cash, F.col(_slot(i))["installment_price"])
        order = F.struct(F.coalesce(cash, F.lit(float("inf"))).alias("cash"), ord)
        sold = F.when(F.col(_slot(i)).isNotNull(), order)
        slots.append(F.min_by(entry, sold).alias(_slot(i)))
    other_key = F.min_by("key", F.when(F.col("key") != F.col("base_key"), F.col("first_ord")))
    grouped = keyed.groupBy(*by, "base_key").agg(
        F.coalesce(other_key, F.col("base_key")).alias("product_key"),
        F.min("first_ord").alias("first_ord"),
        *slots,
    )
    return grouped.select(
        *by,
        "base_key",
        "product_key",
        "first_ord",
        F.array(*[_slot(i) for i in range(len(sources))]).alias("entries"),
    )


def canonical_keys(groups: DataFrame) -> DataFrame:
    """The product key of each base key: its first differing key, else the base itself."""
    return groups.select("base_key", "product_key", "first_ord")


def _source_id(position: Column, sources: Sequence[Source]) -> Column:
    return F.element_at(F.array(*[F.lit(s.id) for s in sources]), position + 1)


def source_grid(
    groups: DataFrame, sources: Sequence[Source] = DEFAULT_SOURCES
) -> DataFrame:
    """One row per product and source, also for the sources that do not sell it."""
    rows = groups.select("base_key", "product_key", "first_ord", F.posexplode("entries"))
    return rows.select(
        "base_key",
        "product_key",
        "first_ord",
        _source_id(F.col("pos"), sources).alias("source"),
        F.col("col").isNotNull().alias("present"),
        *[F.col("col")[f].alias(f) for f in ENTRY_FIELDS],
    )


def best_offers(
    groups: DataFrame, sources: Sequence[Source] = DEFAULT_SOURCES
) -> DataFrame:
    """The best offer per product and source, one row each."""
    return source_grid(groups, sources).where("present").drop("present")


def pivot_sources(
    groups: DataFrame, sources: Sequence[Source] = DEFAULT_SOURCES
) -> DataFrame:
    """One struct column per source."""
    return groups.select(
        "base_key",
        "product_key",
        *[F.get("entries", F.lit(i)).alias(s.id) for i, s in enumerate(sources)],
    )
