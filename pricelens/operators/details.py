"""Listing rows joined to the detail pages they point to.

All joins are plain equi-joins with unique keys on the page side. A key (or a missing key)
with a large share of the listing makes a skewed partition, which Spark's adaptive skew join
splits by its measured size, whatever the key is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import first_wins


def latest_per_url(parsed: DataFrame, stored: str) -> DataFrame:
    """One row per url, the one stored last; ``stored`` names the column that says when.

    An argmax aggregate over parsed columns: a page stored many times keeps one row per task.
    """
    rest = [c for c in parsed.columns if c not in ("url", stored)]
    last = parsed.groupBy("url").agg(F.max_by(F.struct(*rest), F.col(stored)).alias("_last"))
    return last.select("url", "_last.*")


def listing_with_detail(listing: DataFrame, detail: DataFrame) -> DataFrame:
    """Name and prices of the detail page, of the listing where the page has none.

    ``listing`` is ``url, name, cash_price, …``; ``detail`` is ``url, name, cash_price,
    installment_price`` with unique urls. A listing row without a detail page is kept.
    """
    side = detail.select(
        "url",
        F.col("name").alias("_name"),
        F.col("cash_price").alias("_cash"),
        F.col("installment_price").alias("installment_price"),
    )
    joined = listing.drop("installment_price").join(side, "url", "left")
    return joined.withColumns(
        {
            "name": F.coalesce("_name", "name"),
            "cash_price": F.coalesce("_cash", "cash_price"),
        }
    ).drop("_name", "_cash")


def variant_details(parents: DataFrame, links: DataFrame, detail: DataFrame) -> DataFrame:
    """Offers of the variants a product page links to.

    ``parents`` is ``url, name`` (the product's own page and title) and any columns to carry
    along, ``links`` is ``url, pos, link`` and ``detail`` as above. A variant counts unless
    it is the page itself, its title is empty or the parent's, or it has no cash price.
    """
    fresh = links.where(F.col("link") != F.col("url"))
    fresh = first_wins(fresh.select("url", "link", "pos"), ["url", "link"], "pos")
    usable = detail.where(F.col("name").isNotNull() & F.col("cash_price").isNotNull())
    targets = usable.select(
        F.col("url").alias("link"), "name", "cash_price", "installment_price"
    )
    titled = fresh.join(parents.withColumnRenamed("name", "parent_name"), "url")
    found = titled.join(targets, "link")
    return found.where(~F.col("name").eqNullSafe(F.col("parent_name")))
