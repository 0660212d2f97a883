"""From stored pages to offers, one job per kind of shop, and from offers to the report.

Pages are parsed where they are read, one pass over the html. What is matched with the
listing by url is the few parsed columns; the html itself is never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import (
    title_with_modifier,
    title_with_spec,
    variant_price,
)
from ..functions.report import NO_BREAK_SPACE
from ..functions.text import truthy
from ..functions.vocabulary import FLAT_LIMIT, SHARE_LIMIT
from ..operators.compare import alerts_only, build_messages
from ..operators.dedup import dedup_by_title, dedup_by_url
from ..operators.details import latest_per_url, listing_with_detail, variant_details
from ..operators.numbering import number_alerts
from ..operators.offers import position
from ..operators.resolve import product_groups
from ..operators.variants import ram_variants, sim_variants
from ..schema import DEFAULT_SOURCES, Source
from ..session import materialize
from ..sources.detail import (
    disabled_products,
    extract_buttons,
    extract_detail,
    extract_variant_config,
    links_of,
    simple_offer,
)
from ..sources.html import with_page


def _with_ord(df: DataFrame, *extra: str | Column) -> DataFrame:
    return df.withColumn("ord", position("page_id", "pos", *extra))


def _stored(pages: DataFrame) -> Column:
    """When a page was stored; pages without ``stored_at`` are told apart by their text."""
    time = F.col("stored_at") if "stored_at" in pages.columns else F.lit(0)
    return F.struct(time.alias("at"), F.xxhash64("html").alias("text")).alias("_stored")


def _variants_or_simple(df: DataFrame, source: str) -> DataFrame:
    """One offer per variant; the simple offer where there is no variant; else nothing."""
    simple = F.when(
        F.col("simple.cash_price").isNotNull(),
        F.array(
            F.struct(
                F.col("name"),
                F.col("simple.cash_price").alias("cash_price"),
                F.col("simple.installment_price").alias("installment_price"),
            )
        ),
    )
    offers = F.when(F.size("variants") > 0, F.col("variants")).otherwise(simple)
    rows = df.select("page_id", "pos", F.posexplode(offers).alias("variant", "offer"))
    return _with_ord(rows, "variant").select(
        "offer.name", "offer.cash_price", "offer.installment_price",
        F.lit(source).alias("source"), "ord",
    )


def ram_config_offers(listing: DataFrame, pages: DataFrame, source: str) -> DataFrame:
    """Offers of a shop whose pages embed storage and RAM options.

    ``listing`` is ``page_id, pos, name, url``. Listed twice means offered twice: this shop
    is not deduplicated.
    """
    read = with_page(pages.select("url", "html", _stored(pages)), keep_html=True)
    parsed = extract_variant_config(read).select(
        "url", "attributes", "option_prices", "ok", "_stored",
        F.when(F.col("ok"), disabled_products(F.col("page"), F.col("attributes"))).alias("off"),
        simple_offer(F.col("page"), "button").alias("simple"),
    )
    joined = listing.join(latest_per_url(parsed, "_stored"), "url")
    variants = ram_variants(
        F.col("name"), F.col("attributes"), F.col("option_prices"), F.col("off")
    )
    return _variants_or_simple(
        joined.withColumn("variants", F.when(F.col("ok"), variants)), source
    )


def sim_config_offers(listing: DataFrame, pages: DataFrame, source: str) -> DataFrame:
    """Offers of a shop whose pages embed storage and SIM or RAM options.

    Urls are deduplicated before pages are read, titles afterwards; the first wins.
    """
    unique = dedup_by_url(_with_ord(listing)).drop("ord")
    read = with_page(pages.select("url", "html", _stored(pages)), keep_html=True)
    parsed = extract_variant_config(read).select(
        "url", "attributes", "option_prices", "ok", "_stored",
        simple_offer(F.col("page"), "text").alias("simple"),
    )
    joined = unique.join(latest_per_url(parsed, "_stored"), "url")
    variants = sim_variants(F.col("name"), F.col("attributes"), F.col("option_prices"))
    offers = _variants_or_simple(
        joined.withColumn("variants", F.when(F.col("ok"), variants)), source
    )
    return dedup_by_title(offers)


def detail_link_offers(
    listing: DataFrame,
    pages: DataFrame,
    source: str,
    product_path: str,
    labels: list[str] | None = None,
) -> DataFrame:
    """Offers of a shop whose variants are separate pages that link to each other."""
    unique = materialize(dedup_by_url(_with_ord(listing)).drop("ord"))
    links = links_of(F.col("page"), product_path, labels).alias("links")
    stored = pages.select("page_id", "url", "html", _stored(pages))
    read = extract_detail(stored, links, F.col("_stored")).drop("page_id")
    parsed = materialize(latest_per_url(read, "_stored"))
    products = listing_with_detail(unique, parsed.drop("links"))
    parents = products.select("url", "name", "page_id", F.col("pos").alias("place"))
    own_links = parsed.select("url", F.posexplode("links").alias("pos", "link"))
    found = variant_details(parents, own_links, parsed.drop("links"))
    prices = ["name", "cash_price", "installment_price"]
    variants = found.select(
        *prices, position("page_id", "place", F.col("pos") + 1).alias("ord")
    )
    first = products.select(
        *prices,
        position("page_id", "pos", F.lit(0)).alias("ord"),
    )
    offers = first.unionByName(variants).withColumn("source", F.lit(source))
    return dedup_by_title(offers)


def button_variants(parts: DataFrame) -> DataFrame:
    """Offers of rendered pages: each storage button with the modifiers shown for it.

    ``parts`` is the output of ``extract_buttons`` with the product's ``name`` and
    ``page_at``, its place in the listing.
    """
    labels = F.transform("storage", lambda b: b["label"])
    of_state = F.transform(
        F.filter("storage", lambda b: b["label"] == F.col("state")),
        lambda b: F.struct(b["label"].alias("label"), b["price"].alias("price"),
                           b["loan_price"].alias("loan_price")),
    )
    name = F.col("name")

    def plain(s: Column) -> Column:
        return F.array(
            F.struct(
                title_with_spec(name, F.col("ram_spec"), s["label"]).alias("name"),
                s["price"].alias("cash_price"),
                variant_price(s["loan_price"], F.lit(None).cast("double")).alias(
                    "installment_price"
                ),
            )
        )

    def modified(s: Column) -> Column:
        return F.transform(
            "modifiers",
            lambda m: F.struct(
                title_with_modifier(name, s["label"], m["label"]).alias("name"),
                variant_price(m["price"], s["price"]).alias("cash_price"),
                variant_price(m["loan_price"], s["loan_price"]).alias("installment_price"),
            ),
        )

    with_storage = F.flatten(
        F.transform(
            of_state,
            lambda s: F.when(F.size("modifiers") == 0, plain(s)).otherwise(modified(s)),
        )
    )
    # Without any usable storage button the first button's price is the price.
    simple = F.when(
        F.col("state").isNull() & F.col("first_price").isNotNull(),
        F.array(
            F.struct(
                name, F.col("first_price").alias("cash_price"),
                F.lit(None).cast("double").alias("installment_price"),
            )
        ),
    )
    offers = F.when(F.size("storage") == 0, simple).otherwise(with_storage)
    place = F.coalesce(F.array_position(labels, F.col("state")), F.lit(0))
    rows = parts.select(
        "page_at", place.alias("button"), F.posexplode(offers).alias("variant", "offer")
    )
    return rows.select(
        "offer.name", "offer.cash_price", "offer.installment_price",
        F.concat("page_at", position("button", "variant")).alias("ord"),
    ).where(truthy(F.col("cash_price")))


def button_offers(listing: DataFrame, rendered: DataFrame, source: str) -> DataFrame:
    """Offers of a shop whose variants are buttons; ``rendered`` holds ``url, state, html``."""
    unique = dedup_by_url(_with_ord(listing)).drop("ord")
    named = unique.select("url", position("page_id", "pos").alias("page_at"), "name")
    parts = extract_buttons(rendered.select("url", "state", "html")).join(named, "url")
    offers = button_variants(parts)
    return dedup_by_title(offers.withColumn("source", F.lit(source)))


def report(
    offers: DataFrame,
    sources: Sequence[Source] = DEFAULT_SOURCES,
    flat: float = FLAT_LIMIT,
    share: float = SHARE_LIMIT,
    group_sep: str = NO_BREAK_SPACE,
    parts: int | None = None,
) -> DataFrame:
    """Numbered alert messages, ``n, product_key, alert_key, message``, from raw offers."""
    groups = product_groups(offers, sources, parts)
    messages = alerts_only(build_messages(groups, sources, flat, share, group_sep))
    numbered = number_alerts(messages)
    return numbered.select("n", "product_key", "alert_key", "message")
