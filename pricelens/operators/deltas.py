"""Products kept up to date: a run that changes one source resolves that source's offers only.

Every source has a *digest*: one row per product it sells, with its best offer and the positions
that product keys and numbers depend on. Products are minima over the digests, at most one row for
each source. When a source delivers again, its new digest is compared with its old one; products
whose row came, went or changed are *touched*, and only these are put together again. A minimum
that is withdrawn needs no special care: the digests of the other sources still have theirs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_SOURCES, Source
from .offers import source_rank
from .resolve import cash_order, with_product_keys

DIGEST = ("base_key", "source", "first_ord", "other_ord", "other_key", "entry")


def source_digest(offers: DataFrame) -> DataFrame:
    """``base_key, source, first_ord, other_ord, other_key, entry`` of offers with their own ``ord``.

    ``other_key`` is the first key that differs from the base key, null if there is none. Each
    distinct title is canonicalized once; rows are combined before both shuffles.
    """
    offer = F.struct("cash_price", "installment_price", "ord")
    named = offers.where(F.col("name").isNotNull())
    titles = named.groupBy("source", "name").agg(
        F.min("ord").alias("first_ord"), F.min_by(offer, cash_order()).alias("best")
    )
    keyed = with_product_keys(titles)
    order = F.struct(F.coalesce("best.cash_price", F.lit(float("inf"))).alias("cash"), "best.ord")
    entry = F.struct("name", "best.cash_price", "best.installment_price")
    other = F.when(F.col("key") != F.col("base_key"), F.col("first_ord"))
    grouped = keyed.groupBy("base_key", "source").agg(
        F.min("first_ord").alias("first_ord"),
        F.min(other).alias("other_ord"),
        F.min_by("key", other).alias("other_key"),
        F.min_by(entry, order).alias("entry"),
    )
    return grouped.select(*DIGEST)


def touched_keys(old: DataFrame, new: DataFrame) -> DataFrame:
    """``base_key`` of the products whose rows differ between two digests of a source."""
    state = F.struct(*[c for c in DIGEST if c not in ("base_key", "source")])
    before = old.select("base_key", "source", state.alias("_old"))
    after = new.select("base_key", "source", state.alias("_new"))
    both = before.join(after, ["base_key", "source"], "full")
    return both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select("base_key").distinct()


def products(digests: DataFrame, sources: Sequence[Source] = DEFAULT_SOURCES) -> DataFrame:
    """``base_key, product_key, first_ord, entries`` from the digests of all sources.

    The same rows as ``product_groups`` gives for the offers, their ``ord`` being source rank
    and own position. A product has one row per source at most.
    """
    rank = source_rank(F.col("source"), sources)
    placed = digests.withColumns(
        {
            "_first": F.struct(rank.alias("source_rank"), F.col("first_ord").alias("ord")),
            "_other": F.when(
                F.col("other_key").isNotNull(), F.struct(rank.alias("source_rank"), F.col("other_ord").alias("ord"))
            ),
        }
    )
    slots = [
        F.max_by("entry", F.when(F.col("source") == s.id, F.lit(1))).alias(f"_s{i}") for i, s in enumerate(sources)
    ]
    grouped = placed.where(rank.isNotNull()).groupBy("base_key").agg(
        F.coalesce(F.min_by("other_key", "_other"), F.col("base_key")).alias("product_key"),
        F.min("_first").alias("first_ord"),
        *slots,
    )
    return grouped.select(
        "base_key", "product_key", "first_ord", F.array(*[f"_s{i}" for i in range(len(sources))]).alias("entries")
    )


def updated(
    kept: DataFrame, digests: DataFrame, touched: DataFrame, sources: Sequence[Source] = DEFAULT_SOURCES
) -> DataFrame:
    """``kept`` products with the touched ones put together again from the digests.

    ``digests`` are those after the change. A product that no source sells any more is gone.
    """
    same = kept.join(touched, "base_key", "left_anti")
    again = products(digests.join(touched, "base_key", "left_semi"), sources)
    return same.unionByName(again)


