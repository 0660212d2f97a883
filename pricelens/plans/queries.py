"""The registered queries: every operator over the given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import prices as P
from ..functions import report as R
from ..functions import titles as N
from ..functions.schedule import local_time, run_class
from ..functions.vocabulary import BUY_WORD
from ..operators import compare as C
from ..operators import details as D
from ..operators import incremental as I
from ..operators import offers as O
from ..operators import resolve as G
from ..operators import variants as V
from ..operators.dedup import dedup_by_title, first_wins
from ..operators.numbering import number_alerts
from ..schema import ATTRIBUTES, CATALOG_PAGE, DEFAULT_SOURCES, Source
from ..session import materialize, scratch_path
from ..sources import alerts as alert_sink_module
from ..sources import catalog, detail, listing, snapshots, versions
from ..sources.html import with_page
from ..sources.tables import EVENT_SOURCES, choose, dealt, feed_from_events, offers, parts_of, price_feed, table
from ..sources.tables import title_feed_from_events
from ..streaming.alerts import stream_new_alerts
from ..streaming.pages import current_rows, stream_changed_pages
from ..streaming.reports import end_mark, stream_reports, with_end_marks
from ..streaming.snapshots import stream_snapshots
from . import delta_runs, fixtures, jobs, runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Values below 500 in the feed: a limit that lets both arms of the comparison decide.
FEED_FLAT = 20.0
STAMP = "2024-01-31 00:00:00"
STORE_URL = "https://shop.example"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---- titles ----------------------------------------------------------------------------


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return offers(spark, sf).select("name").distinct()


def _chain(*rules) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        c = F.col("name")
        for rule in rules:
            c = rule(c)
        return _names(spark, sf).select("name", c.alias("result"))

    return run


QUERIES["norm_units"] = _chain(
    N.lower_trim, N.unit_gb, N.strip_brand, N.storage_spacing
)
QUERIES["norm_plus"] = _chain(N.lower_trim, N.plus_forms)
QUERIES["norm_sim"] = _chain(N.lower_trim, N.paren_sim, N.bare_sim, N.drop_dual)
QUERIES["norm_ram"] = _chain(N.lower_trim, N.unit_gb, N.strip_brand, N.ram_storage)
QUERIES["norm_reorder"] = _chain(N.lower_trim, N.clean_punct, N.reorder_tokens)
QUERIES["normalize_titles"] = _chain(N.normalize_title)
QUERIES["match_key"] = _chain(N.normalize_title, N.match_key)


@query
def strip_colors(spark, sf):
    parts = fixtures.parts(spark, sf)
    phrase = choose(
        F.col("p_partkey") % 6,
        [" space gray", " dual sim lte", " natural titanium 4g", " Deep-blue", "", " goldfish"],
    )
    text = F.concat(F.col("p_name"), phrase)
    return parts.select("p_partkey", N.strip_vocab(N.lower_trim(text)).alias("result"))


@query
def display_name(spark, sf):
    parts = fixtures.parts(spark, sf)
    suffix = choose(F.col("p_partkey") % 4, [" Rose Gold 5G", " desert  titanium", "", " Blueish"])
    return parts.select("p_partkey", N.display_name(F.concat("p_name", suffix)).alias("result"))


# ---- resolving and comparing -----------------------------------------------------------


def _groups(spark, sf):
    return G.product_groups(offers(spark, sf), parts=_parts(spark, sf))


def _parts(spark, sf) -> int:
    """Number of tasks for titles: an offer is a row of lineitem, and most have titles of their own."""
    return parts_of(table(spark, sf, "lineitem"))


@query
def canonical_keys(spark, sf):
    return G.canonical_keys(_groups(spark, sf)).select("base_key", "product_key")


@query
def best_offer(spark, sf):
    return G.best_offers(_groups(spark, sf)).drop("first_ord")


@query
def offer_pivot(spark, sf):
    wide = G.pivot_sources(_groups(spark, sf))
    return wide.select(
        "base_key", "product_key",
        *[F.col(s.id)["cash_price"].alias(s.id) for s in DEFAULT_SOURCES],
    )


@query
def anchor_compare(spark, sf):
    return C.compare_offers(_groups(spark, sf))


@query
def anchor_join(spark, sf):
    """The relational form: best offers in long form, competitors joined to the anchor."""
    titles = G.with_product_keys(G.distinct_titles(offers(spark, sf), parts=_parts(spark, sf)))
    slots = [
        F.struct(F.lit(s.id).alias("source"), F.col(f"_s{i}").alias("slot"))
        for i, s in enumerate(DEFAULT_SOURCES)
    ]
    long = titles.select("base_key", F.inline(F.array(*slots))).where(F.col("slot").isNotNull())
    best = (
        long.select("base_key", "source", "slot.*")
        .groupBy("base_key", "source")
        .agg(F.min_by(F.struct("cash_price", "installment_price"), G.cash_order()).alias("b"))
        .select("base_key", "source", "b.*")
    )
    best = materialize(best)  # both sides read it
    anchor = best.where(F.col("source") == DEFAULT_SOURCES[0].id).drop("source")
    pairs = C.anchor_join(best.where(F.col("source") != DEFAULT_SOURCES[0].id), anchor)
    return C.with_flags(pairs)


@query
def source_grid(spark, sf):
    return C.report_grid(_groups(spark, sf)).drop("first_ord", "name")


@query
def product_alerts(spark, sf):
    return C.product_alerts(C.compare_offers(_groups(spark, sf)))


@query
def report_messages(spark, sf):
    messages = C.build_messages(_groups(spark, sf))
    return messages.select("product_key", "has_alert", "message")


@query
def numbered_alerts(spark, sf):
    alerts = C.alerts_only(C.build_messages(_groups(spark, sf)))
    return number_alerts(alerts).select("n", "product_key")


@query
def alert_keys(spark, sf):
    alerts = C.alerts_only(C.build_messages(_groups(spark, sf)))
    return alerts.select("product_key", "alert_key")


@query
def full_report(spark, sf):
    return jobs.report(offers(spark, sf), parts=_parts(spark, sf))


def _pairs(spark, sf):
    """Price pairs from lineitem, zero and null included."""
    lines = table(spark, sf, "lineitem")
    order, part = F.col("l_orderkey"), F.col("l_partkey")
    price = F.col("l_extendedprice")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(order % 11 == 0, F.lit(0.0)).when(order % 13 != 0, price).alias("anchor_cash"),
        F.when(order % 3 == 0, price + 500).alias("anchor_installment"),
        F.when(part % 7 == 0, price).when(part % 17 != 0, price * F.lit(0.85) + part % 9 * 300)
        .alias("cash_price"),
        F.when(part % 5 == 0, F.lit(0.0)).when(part % 4 == 0, price + 500)
        .when(part % 3 == 0, price * F.lit(0.8)).alias("installment_price"),
    )


_PAIR_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query
def price_flags(spark, sf):
    flag = P.price_flag(F.col("anchor_cash"), F.col("cash_price"))
    return _pairs(spark, sf).select(*_PAIR_KEYS, flag.alias("flag"))


@query
def installment_flags(spark, sf):
    flag = P.installment_flag(
        F.col("anchor_cash"), F.col("anchor_installment"), F.col("installment_price")
    )
    return _pairs(spark, sf).select(*_PAIR_KEYS, flag.alias("flag"))


@query
def price_match(spark, sf):
    same = P.same_price(
        F.col("anchor_cash"), F.col("anchor_installment"), F.col("cash_price"),
        F.col("installment_price"),
    )
    return _pairs(spark, sf).select(*_PAIR_KEYS, same.alias("same"))


@query
def format_price(spark, sf):
    price = F.when(F.col("l_linenumber") == 7, F.lit(0.0)).otherwise(
        F.col("l_extendedprice") * F.col("l_quantity")
    )
    return table(spark, sf, "lineitem").select(
        *_PAIR_KEYS,
        R.format_price(F.round(price, 2)).alias("text"),
        R.format_price(F.floor(price), ".").alias("dotted"),
    )


@query
def format_pair(spark, sf):
    text = R.format_pair(
        F.col("cash_price"), F.col("installment_price"), F.col("anchor_cash"),
        F.col("anchor_installment"), F.col("l_suppkey") % 5 == 0,
    )
    rounded = _pairs(spark, sf).withColumns(
        {c: F.floor(c).cast("double") for c in
         ("cash_price", "installment_price", "anchor_cash", "anchor_installment")}
    )
    return rounded.select(*_PAIR_KEYS, text.alias("text"))


# ---- offers: order, duplicates, checks -------------------------------------------------


@query
def dedup_url(spark, sf):
    pages = table(spark, sf, "pages")
    # Host without its first label, and the first folder: many pages share one.
    bare = F.regexp_extract("url", r"^https?://[^./]*\.([^/]*/[^/?#]*)", 1)
    return first_wins(pages.select(bare.alias("url"), "page_id"), ["url"], "page_id")


@query
def dedup_title(spark, sf):
    firsts = dedup_by_title(offers(spark, sf))
    return firsts.select("source", "name", "cash_price", "installment_price")


@query
def drop_incomplete(spark, sf):
    pages = with_page(table(spark, sf, "pages"))
    cards = pages.select(
        "page_id",
        detail.page_title(F.col("page")).alias("name"),
        F.when(F.col("page_id") % 7 != 0, F.col("url")).alias("url"),
        F.when(F.col("page_id") % 5 == 0, "Առկա չէ").otherwise("in stock").alias("text"),
        F.when(F.col("page_id") % 3 != 0, F.col("page_id") % 4).cast("double").alias("cash_price"),
    )
    return O.drop_incomplete(cards, text="text").select("page_id", "url", "cash_price")


@query
def invalid_sources(spark, sf):
    events = table(spark, sf, "events").select(F.col("event_type").alias("source"))
    known = [Source("view", "V"), Source("click", "C"), Source("purchase", "P")]
    return O.invalid_sources(events, known)


# ---- coercions and labels --------------------------------------------------------------


def _part_text(spark, sf, values: list[str]):
    """A literal text per part, with its retail price in place of ``#``."""
    parts = fixtures.parts(spark, sf)
    text = choose(F.col("p_partkey") % len(values), values)
    whole = F.floor("p_retailprice").cast("string")
    return parts.select("p_partkey", F.replace(text, F.lit("#"), whole).alias("text"))


NUMBER_TEXTS = ["#", " #.5 ", "abc", "0", "#abc", "", "-#", "1e3", "#.25.1", "0.0"]
PRICE_TEXTS = ["#,000 դր.", "1,#դր", "# AMD", "0 դր", "գին՝ 12 #,100դր (20%)", ""]
STORAGE_TEXTS = ["# ԳԲ", "#գբ", "1 ՏԲ", "2 տբ / # ԳԲ", " 128 GB ", "12 ԳԲ"]
MODIFIER_TEXTS = ["eSIM", "Nano-SIM + eSIM", "2 SIM", "e-sim", "Dual", "E SIM", "Global", "nano"]
OPTION_TEXTS = [
    "eSIM+eSIM", "Dual (eSIM + eSIM)", "2 eSIM", "Nano-SIM/eSIM", "SIM + eSIM", " e-SIM ", "eSIM",
    "Physical", "esim only",
]


@query
def coerce_prices(spark, sf):
    c = F.col("text")
    rows = _part_text(spark, sf, NUMBER_TEXTS)
    return rows.select(
        "p_partkey",
        P.num_or_null(c).alias("whole"),
        P.float_prefix(c).alias("float_prefix"),
        P.int_prefix(c).alias("int_prefix"),
        P.round_price(P.float_prefix(c)).alias("rounded"),
    )


@query
def parse_price_text(spark, sf):
    c = F.col("text")
    rows = _part_text(spark, sf, PRICE_TEXTS)
    return rows.select(
        "p_partkey", P.parse_price_text(c).alias("price"), P.digits_price(c).alias("digits")
    )


@query
def storage_label(spark, sf):
    rows = _part_text(spark, sf, STORAGE_TEXTS)
    return rows.select("p_partkey", L.storage_label(F.col("text")).alias("label"))


@query
def strip_prefix(spark, sf):
    parts = fixtures.parts(spark, sf)
    word = choose(F.col("p_partkey") % 4, [f"{BUY_WORD} ", f"{BUY_WORD.lower()}  ", "", BUY_WORD])
    text = F.concat(word, "p_name")
    return parts.select("p_partkey", L.strip_prefix(text).alias("result"))


@query
def sim_class_catalog(spark, sf):
    rows = _part_text(spark, sf, fixtures.SIM_VALUES)
    return rows.select("p_partkey", L.catalog_sim_suffix(F.col("text")).alias("suffix"))


@query
def sim_class_modifier(spark, sf):
    c = F.col("text")
    rows = _part_text(spark, sf, MODIFIER_TEXTS)
    return rows.select(
        "p_partkey", L.modifier_sim(c).alias("token"), L.modifier_suffix(c).alias("suffix")
    )


@query
def sim_class_option(spark, sf):
    rows = _part_text(spark, sf, OPTION_TEXTS)
    return rows.select("p_partkey", L.option_sim(F.col("text")).alias("label"))


@query
def variant_price(spark, sf):
    pairs = _pairs(spark, sf)
    price = L.variant_price(F.col("installment_price"), F.col("anchor_cash"))
    return pairs.select(*_PAIR_KEYS, price.alias("price"))


@query
def compose_title(spark, sf):
    rows = _part_text(spark, sf, [*MODIFIER_TEXTS, "8gb", " 12GB "])
    named = rows.join(fixtures.parts(spark, sf).select("p_partkey", "p_name"), "p_partkey")
    base, storage, text = F.col("p_name"), F.lit("256GB"), F.col("text")
    spec = F.when(F.col("p_partkey") % 2 == 0, F.lit("6GB"))
    return named.select(
        "p_partkey",
        L.title_with_modifier(base, storage, text).alias("with_modifier"),
        L.title_with_spec(base, spec, storage).alias("with_spec"),
        L.title_ram_storage(base, F.trim(text), storage).alias("ram_storage"),
        L.title_storage_sim(base, storage, L.option_sim(text)).alias("storage_sim"),
    )


@query
def is_apple(spark, sf):
    return _names(spark, sf).select("name", N.is_apple(F.col("name")).alias("apple"))


# ---- pages -----------------------------------------------------------------------------


@query
def listing_page_count(spark, sf):
    pages = table(spark, sf, "pages")
    own = F.concat("html", F.lit('<a class="page" href="'), "url", F.lit('">self</a>'))
    return listing.listing_page_count(pages.select("page_id", own.alias("html")))


@query
def extract_listing(spark, sf):
    return listing.extract_links(table(spark, sf, "pages"), STORE_URL)


@query
def next_page(spark, sf):
    """Listing pages with an active, an inactive, a commented-out and no "next" link."""
    key = F.col("p_partkey")
    link = (
        F.when(key % 5 == 0, '<a title="a > b" class=\'action next\' href=/p>')
        .when(key % 5 == 1, '<a class="action next inactive">')
        .when(key % 5 == 2, '<!-- <a class="action next"> -->')
        .when(key % 5 == 3, '<a class="action previous">')
        .otherwise('<a href="?p=2" class="next page-link action">')
    )
    pages = table(spark, sf, "part").select(
        key.alias("page_id"), F.concat(F.lit("<ul>"), link, F.col("p_name"), F.lit("</a></ul>")).alias("html")
    )
    return with_page(pages).select("page_id", listing.has_next_page(F.col("page")).alias("has_next"))


@query
def listing_coverage(spark, sf):
    """Listings by brand: pages that link to a last page, some to a next one, some of them absent."""
    key, size = F.col("p_partkey"), F.col("p_size")
    link = F.when(key % 5 == 0, '<a class="action next" href="/n">').when(key % 5 == 1, '<a class="action next inactive">')
    html = F.concat(
        F.coalesce(link, F.lit("<a>")), F.lit('</a><a href="?page='), (size % 25 + 1).cast("string"), F.lit('">last</a>')
    )
    pages = table(spark, sf, "part").select(
        F.col("p_brand").alias("listing"), (key % 40 + 1).alias("number"), html.alias("html")
    )
    return listing.listing_coverage(pages)


@query
def absolute_urls(spark, sf):
    pages = with_page(table(spark, sf, "pages"))
    links = F.concat(listing.hrefs(F.col("page")), F.array("url"))
    rows = pages.select("page_id", F.posexplode(links).alias("pos", "href"))
    return rows.select("page_id", "pos", L.absolute_url(F.col("href"), STORE_URL).alias("url"))


@query
def extract_detail(spark, sf):
    page = F.col("page")
    return with_page(table(spark, sf, "pages")).select(
        "page_id",
        F.coalesce(detail.heading(page), detail.page_title(page)).alias("name"),
        listing.regular_price(page).alias("cash_price"),
        detail.credit_price(page).alias("installment_price"),
    )


NAV_WORDS = ["the", "and", "to", "of", "The", "la", "des", "en", "und", "der"]


@query
def variant_links(spark, sf):
    links = detail.variant_links(table(spark, sf, "pages"), "/", NAV_WORDS)
    return links.select("page_id", "link")


@query
def listing_detail(spark, sf):
    """Orders as listing rows, two thirds of the customers as their detail pages."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("url"),
        F.concat(F.lit("order "), F.col("o_custkey").cast("string")).alias("name"),
        F.col("o_totalprice").alias("cash_price"),
    )
    price = F.col("c_acctbal")
    details = table(spark, sf, "customer").where(F.col("c_custkey") % 3 != 0).select(
        F.col("c_custkey").alias("url"),
        F.col("c_name").alias("name"),
        F.when(price > 0, price).alias("cash_price"),
        F.when(price > 5000, price + 1).alias("installment_price"),
    )
    return D.listing_with_detail(orders, details)


@query
def variant_detail(spark, sf):
    """Nav links as variant links: the first page whose heading starts with a word is its target;
    every other page has an address of its own."""
    pages = with_page(table(spark, sf, "pages").select("page_id", "html"), keep_html=True)
    word = F.element_at(F.split(F.lower(detail.heading(F.col("page"))), " "), 1)
    base = pages.select("page_id", "html", F.concat(F.lit("/"), word).alias("path"))
    firsts = base.groupBy("path").agg(F.min("page_id").alias("first"))
    own = F.when(F.col("page_id") == F.col("first"), F.col("path")).otherwise(
        F.concat("path", F.lit("/"), F.col("page_id").cast("string"))
    )
    unique = base.join(firsts, "path").select("page_id", "html", own.alias("url"))
    details = detail.extract_detail(unique).drop("page_id").withColumn(
        "cash_price", F.length("name").cast("double")
    )
    links = with_page(unique).select("url", F.posexplode(listing.hrefs(F.col("page"))).alias("pos", "link"))
    found = D.variant_details(details.select("url", "name"), links, details)
    return found.select("url", "link", "name", "cash_price")


@query
def listing_cards(spark, sf):
    """All four card layouts over pages written from part."""
    image = listing.CardSpec(**{**vars(listing.CARD_IMAGE_ALT), "base": fixtures.SHOP})
    text = listing.CardSpec(**{**vars(listing.CARD_LINK_TEXT), "base": fixtures.SHOP})
    found = {
        "image": listing.extract_cards(fixtures.card_pages(spark, sf, "ram"), image),
        "text": listing.extract_cards(fixtures.card_pages(spark, sf, "sim"), text),
        "heading": listing.extract_cards(
            fixtures.card_pages(spark, sf, "detail"), listing.CARD_HEADING
        ),
        "div": listing.extract_headings(
            fixtures.card_pages(spark, sf, "button"), fixtures.SHOP
        ).withColumn("cash_price", F.lit(None).cast("double")),
    }
    rows = [
        df.select(F.lit(k).alias("layout"), "page_id", "name", "url", "cash_price")
        for k, df in found.items()
    ]
    return O.union_sources(*rows)


@query
def variant_config(spark, sf):
    read = with_page(fixtures.config_pages(spark, sf, "ram"), keep_html=True)
    parsed = detail.extract_variant_config(read)
    memory = L.attr_by_code(F.col("attributes"), ["memory"])
    off = detail.disabled_products(F.col("page"), F.col("attributes"))
    return parsed.select(
        "page_id",
        "ok",
        F.coalesce(F.size("attributes"), F.lit(0)).alias("attributes"),
        F.coalesce(F.size("option_prices"), F.lit(0)).alias("prices"),
        F.array_join(F.transform(memory["options"], lambda o: o["label"]), "|").alias("labels"),
        F.array_join(F.array_sort(off), "|").alias("disabled"),
    )


@query
def simple_offer(spark, sf):
    ram = with_page(fixtures.config_pages(spark, sf, "ram")).select(
        "page_id", detail.simple_offer(F.col("page"), "button").alias("o")
    )
    sim = with_page(fixtures.config_pages(spark, sf, "sim")).select(
        "page_id", detail.simple_offer(F.col("page"), "text").alias("o")
    )
    rows = ram.withColumn("kind", F.lit("button")).unionByName(
        sim.withColumn("kind", F.lit("text"))
    )
    return rows.select("kind", "page_id", "o.*").where(F.col("cash_price").isNotNull())


@query
def attr_by_code(spark, sf):
    """Attributes with number keys: the lowest number wins, not the first in the text."""
    parts = fixtures.parts(spark, sf)
    body = F.concat(
        F.lit('{"'), (F.col("p_partkey") % 13 + 5).cast("string"),
        F.lit('":{"code":"sim","options":[{"id":"a","label":"high"}]},"x":{"code":"sim_type",'
              '"options":[{"id":"b","label":"named"}]},"'),
        (F.col("p_partkey") % 7 + 1).cast("string"),
        F.when(F.col("p_partkey") % 7 + 1 == F.col("p_partkey") % 13 + 5, F.lit("99")).otherwise(""),
        F.lit('":{"code":"sim_card","options":[{"id":"c","label":"low"}]}}'),
    )
    found = L.attr_by_code(F.from_json(body, ATTRIBUTES), ["sim_card", "sim", "sim_type"])
    named = L.attr_by_code(F.from_json(body, ATTRIBUTES), ["sim_type", "none"])
    return parts.select(
        "p_partkey", F.get(found["options"], F.lit(0))["label"].alias("label"),
        F.get(named["options"], F.lit(0))["label"].alias("named"),
    )


@query
def button_variants(spark, sf):
    rendered = fixtures.rendered_pages(spark, sf).withColumn("page_at", O.position("page_id"))
    found = jobs.button_variants(detail.extract_buttons(rendered))
    return found.select(_place(0, "page_id"), "name", "cash_price", "installment_price")


def _place(i: int, name: str):
    return F.get("ord", F.lit(i)).alias(name)


# ---- whole jobs ------------------------------------------------------------------------


def _catalog(spark, sf):
    pages = fixtures.catalog_pages(spark, sf)
    return pages.select("brand", "page", F.from_json("value", CATALOG_PAGE).alias("p")).select(
        "brand", "page", "p.*"
    )


@query
def catalog_flatten(spark, sf):
    flat = catalog.flatten_catalog(_catalog(spark, sf))
    rows = catalog.catalog_offers(flat, "anchor", EVENT_SOURCES)
    return rows.select(
        _place(0, "brand"), _place(1, "page"), _place(2, "pos"), "name", "price", "cash_price",
        "installment_price", "source",
    )


@query
def catalog_read(spark, sf):
    """The same catalog, written to JSON files and read back."""
    path = scratch_path(spark, "catalog")
    pages = _catalog(spark, sf)
    pages.write.partitionBy("brand").json(path)
    rows = catalog.read_catalog(spark, path, multi_line=False)
    return rows.select("brand", "page", "pos", "name", "cash_price")


@query
def catalog_rejects(spark, sf):
    """A catalog with cut-off pages, read from files: pages, rejected ones and products by brand."""
    path = scratch_path(spark, "damaged")
    fixtures.damaged_catalog(spark, sf).write.partitionBy("brand").text(path)
    pages = catalog.read_catalog_pages(spark, path, multi_line=False)
    total = pages.groupBy("brand").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.col("data").isNull().cast("int")).alias("without")
    )
    rejected = catalog.rejected_pages(pages).groupBy("brand").agg(
        F.count(F.lit(1)).alias("rejected"), F.min("page").alias("first_rejected"),
        F.max("reason").alias("reason"),
    )
    products = catalog.flatten_catalog(pages).groupBy("brand").agg(F.count(F.lit(1)).alias("products"))
    joined = total.drop("without").join(rejected, "brand", "left").join(products, "brand", "left")
    return joined.fillna(0, ["rejected", "products"])


@query
def page_coverage(spark, sf):
    events = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    pages = events.select(
        F.concat("event_type", F.lit("-"), (F.col("user_id") % 40).cast("string")).alias("brand"),
        (k % 25 + 1).alias("page"), (F.col("user_id") % 20 + 10).alias("last_page"),
    )
    return catalog.page_coverage(pages)


@query
def job_ram_config(spark, sf):
    spec = listing.CardSpec(**{**vars(listing.CARD_IMAGE_ALT), "base": fixtures.SHOP})
    cards = listing.extract_cards(fixtures.card_pages(spark, sf, "ram"), spec)
    found = jobs.ram_config_offers(cards, fixtures.config_pages(spark, sf, "ram"), "shop_b")
    return found.select(_place(0, "page_id"), "name", "cash_price", "installment_price", "source")


@query
def job_sim_config(spark, sf):
    spec = listing.CardSpec(**{**vars(listing.CARD_LINK_TEXT), "base": fixtures.SHOP})
    cards = listing.extract_cards(fixtures.card_pages(spark, sf, "sim"), spec)
    found = jobs.sim_config_offers(cards, fixtures.config_pages(spark, sf, "sim"), "shop_d")
    return found.select(_place(0, "page_id"), "name", "cash_price", "installment_price", "source")


@query
def job_detail_links(spark, sf):
    cards = listing.extract_cards(
        fixtures.card_pages(spark, sf, "detail"), listing.CARD_HEADING
    )
    found = jobs.detail_link_offers(
        cards, fixtures.detail_pages(spark, sf), "shop_c", "shop.example/store/product"
    )
    return found.select(_place(0, "page_id"), "name", "cash_price", "installment_price", "source")


@query
def job_buttons(spark, sf):
    cards = listing.extract_headings(fixtures.card_pages(spark, sf, "button"), fixtures.SHOP)
    rendered = fixtures.rendered_pages(spark, sf).select("url", "state", "html")
    found = jobs.button_offers(cards, rendered, "shop_e")
    return found.select("name", "cash_price", "installment_price", "source")


# ---- relational variants ---------------------------------------------------------------


def _options(spark, sf, option: str) -> DataFrame:
    """Options of a page from lineitem: page = order, product = part."""
    lines = dealt(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", option), "l_orderkey", "l_partkey")
    return lines.select(
        F.col("l_orderkey").alias("page"),
        F.col(option).cast("string").alias("option"),
        F.col("l_partkey").alias("product_id"),
        F.struct("l_linenumber", "l_partkey").alias("pos"),
    )


def _prices(spark, sf) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size")
    return fixtures.parts(spark, sf).where(size % 10 != 0).select(
        F.col("p_partkey").alias("product_id"),
        F.when(size % 7 == 0, F.lit(0.0)).otherwise(price).alias("cash_price"),
        F.when(size % 2 == 0, price + 30).alias("installment_price"),
    )


def _disabled(spark, sf) -> DataFrame:
    """Products of the return flag A of a page are disabled if they are small."""
    small = fixtures.parts(spark, sf).where("p_size < 5").select("p_partkey")
    lines = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "A")
    return lines.join(small, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select(
        F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("product_id")
    ).distinct()


@query
def option_intersection(spark, sf):
    return V.option_pairs(
        _options(spark, sf, "l_returnflag"), _options(spark, sf, "l_linestatus"),
        _disabled(spark, sf),
    )


@query
def disabled_anti(spark, sf):
    products = _options(spark, sf, "l_returnflag").select("page", "option", "product_id")
    return V.drop_disabled(products, _disabled(spark, sf))


@query
def variant_counts(spark, sf):
    """Storage and RAM variants of each page."""
    pairs = V.option_pairs(
        _options(spark, sf, "l_returnflag"), _options(spark, sf, "l_linestatus"),
        _disabled(spark, sf),
    )
    return V.variant_counts(pairs)


@query
def variant_price_join(spark, sf):
    variants = V.option_pairs(
        _options(spark, sf, "l_returnflag"), _options(spark, sf, "l_linestatus")
    )
    return V.variant_prices(variants, _prices(spark, sf))


@query
def sim_storage_variants(spark, sf):
    lines = table(spark, sf, "lineitem")
    line = F.col("l_linenumber")

    def side(label):
        return lines.select(
            F.col("l_orderkey").alias("page"), line.alias("option"), label.alias("label"),
            line.alias("option_pos"), F.col("l_partkey").alias("product_id"),
            F.struct("l_linenumber", "l_partkey").alias("pos"),
        )

    sims = side(L.option_sim(choose(line % 4, ["eSIM", "Nano-SIM", "e-sim", "SIM + eSIM"])))
    storages = side(choose(line % 3, ["128GB", "256GB", "512GB"]))
    return V.variant_prices(V.sim_storage_pairs(sims, storages), _prices(spark, sf))


@query
def variants_or_simple(spark, sf):
    variants = V.variant_prices(
        V.option_pairs(
            _options(spark, sf, "l_returnflag"), _options(spark, sf, "l_linestatus"),
            _disabled(spark, sf),
        ), _prices(spark, sf),
    ).select("page", "cash_price")
    simple = table(spark, sf, "orders").where("o_totalprice > 100000").select(
        F.col("o_orderkey").alias("page"), F.col("o_totalprice").alias("cash_price")
    )
    return V.variants_or_simple(variants, simple)


# ---- snapshots -------------------------------------------------------------------------


def _store(spark, sf) -> str:
    path = scratch_path(spark, "snapshot")
    rows = offers(spark, sf).drop("ord")
    snapshots.write_snapshot(rows, path, F.lit(STAMP).cast("timestamp"))
    return path


@query
def snapshot_roundtrip(spark, sf):
    stored = snapshots.read_all(spark, _store(spark, sf))
    return stored.select("source", "name", "cash_price", "installment_price")


@query
def snapshot_one(spark, sf):
    stored = snapshots.read_snapshot(spark, _store(spark, sf), "shop_c")
    return stored.select("source", "name", "cash_price", "installment_price")


@query
def snapshot_all(spark, sf):
    stored = snapshots.read_all(spark, _store(spark, sf))
    return stored.groupBy("source", "source_rank").agg(
        F.count(F.lit(1)).alias("offers"), F.min("cash_price").alias("lowest")
    )


@query
def snapshot_keep_old(spark, sf):
    """A second run without two of the sources: theirs stay, the others are replaced."""
    path = _store(spark, sf)
    second = offers(spark, sf).drop("ord").where(~F.col("source").isin("shop_b", "shop_d"))
    cheaper = second.where("cash_price < 20000")
    snapshots.write_snapshot(cheaper, path, F.lit(STAMP).cast("timestamp"))
    return snapshots.read_all(spark, path).groupBy("source").agg(
        F.count(F.lit(1)).alias("offers"), F.max("cash_price").alias("highest")
    )


@query
def stored_report(spark, sf):
    """Collect every source into the store, then report from it, twice: nothing new remains."""
    root = scratch_path(spark, "runs")
    rows = materialize(offers(spark, sf).withColumn("ord", F.col("ord").dropFields("rank")))
    found = {
        s.id: lambda s=s: rows.where(F.col("source") == s.id) for s in DEFAULT_SOURCES
    }
    runs.collect(found, f"{root}/store", F.lit(STAMP).cast("timestamp"))
    first = runs.send_report(spark, f"{root}/store", f"{root}/memory")
    again = runs.send_report(spark, f"{root}/store", f"{root}/memory", new_only=True)
    marked = first.withColumn("run", F.lit(1)).unionByName(again.withColumn("run", F.lit(2)))
    return marked.select("run", "n", "product_key", "alert_key")


@query
def snapshot_clear(spark, sf):
    path = _store(spark, sf)
    snapshots.clear_snapshots(spark, path, DEFAULT_SOURCES[1:3])
    return snapshots.read_all(spark, path).groupBy("source").agg(
        F.count(F.lit(1)).alias("offers")
    )


def _page_jobs(spark, sf) -> dict:
    """One job for each shop over its stored pages; the shop with detail pages is the anchor."""

    def cards(kind, layout):
        spec = listing.CardSpec(**{**vars(layout), "base": fixtures.SHOP})
        return listing.extract_cards(fixtures.card_pages(spark, sf, kind), spec)

    def catalog_job():
        flat = catalog.flatten_catalog(_catalog(spark, sf))
        return catalog.catalog_offers(flat, "shop_c", EVENT_SOURCES).drop("price")

    def button_job():
        names = listing.extract_headings(fixtures.card_pages(spark, sf, "button"), fixtures.SHOP)
        rendered = fixtures.rendered_pages(spark, sf).select("url", "state", "html")
        return jobs.button_offers(names, rendered, "shop_e")

    return {
        "anchor": lambda: jobs.detail_link_offers(
            cards("detail", listing.CARD_HEADING), fixtures.detail_pages(spark, sf), "anchor",
            "shop.example/store/product",
        ),
        "shop_b": lambda: jobs.ram_config_offers(
            cards("ram", listing.CARD_IMAGE_ALT), fixtures.config_pages(spark, sf, "ram"), "shop_b"
        ),
        "shop_c": catalog_job,
        "shop_d": lambda: jobs.sim_config_offers(
            cards("sim", listing.CARD_LINK_TEXT), fixtures.config_pages(spark, sf, "sim"), "shop_d"
        ),
        "shop_e": button_job,
    }


@query
def pages_to_report(spark, sf):
    """A whole run over the pages of five shops: extraction, one version of the store, the report."""
    root = scratch_path(spark, "pages")
    return runs.pages_to_report(
        spark, _page_jobs(spark, sf), f"{root}/store", f"{root}/reports", f"{STAMP}+00:00"
    )


@query
def store_as_of(spark, sf):
    """Four versions of the store, one for each part of the offers and each without another source;
    what runs between them see."""
    root = scratch_path(spark, "versions")
    rows = materialize(offers(spark, sf).withColumn("part", F.year("ord.l_shipdate") % 4))
    for k in range(4):
        at = f"2024-03-0{k + 1} 12:00:00"
        part = rows.where((F.col("part") == k) & (F.col("source") != DEFAULT_SOURCES[k + 1].id))
        versions.write_version(
            part.drop("part"), root, F.lit(at).cast("timestamp"), f"{at}+00:00"
        )
    hours = spark.range(-6, 108, 6).select(
        (F.lit("2024-03-01 12:00:00").cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("run")
    )
    seen = versions.offers_seen(spark, root, hours)
    return seen.groupBy("run", "version", "source").agg(
        F.count(F.lit(1)).alias("offers"), F.min("cash_price").alias("lowest")
    ).withColumn("run", _run_name("run"))


def _history(spark, sf) -> DataFrame:
    return price_feed(spark, sf).withColumnRenamed("ts", "scraped_at")



@query
def last_updated(spark, sf):
    updated = snapshots.last_updated(_history(spark, sf))
    text = F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return updated.select("source", text.alias("updated_at"))


@query
def snapshot_status(spark, sf):
    now = F.lit(STAMP).cast("timestamp")
    known = (*DEFAULT_SOURCES, Source("shop_f", "Shop F"))
    status = snapshots.snapshot_status(_history(spark, sf), now, known)
    return status.select("source", "found", "offers", "age_minutes")


@query
def stale_sources(spark, sf):
    now = F.lit(STAMP).cast("timestamp")
    known = (*DEFAULT_SOURCES, Source("shop_f", "Shop F"))
    return snapshots.stale_sources(_history(spark, sf), now, 0.25, known)


@query
def alert_sink(spark, sf):
    """Alerts of two halves of the report appended to one table."""
    path = scratch_path(spark, "alerts")
    messages = C.build_messages(_groups(spark, sf)).select("product_key", "has_alert", "message")
    alerts = C.alerts_only(materialize(messages)).drop("has_alert")
    apple = F.col("product_key").startswith("iphone")
    alert_sink_module.write_alerts(alerts.where(apple), path)
    alert_sink_module.write_alerts(alerts.where(~apple), path)
    return spark.read.parquet(path)


def _picky(divisor: int):
    """A messenger that refuses some messages."""

    def send(row: dict) -> None:
        if len(row["message"]) % divisor == 0:
            raise ValueError(f"{len(row['message'])} characters")

    return send


@query
def alert_delivery(spark, sf):
    """All alerts sent three times: bad messages fail alone, sent ones are not sent again."""
    path = scratch_path(spark, "deliveries")
    messages = C.build_messages(_groups(spark, sf)).where("has_alert")
    alerts = materialize(messages.select(F.lit("r1").alias("run"), "product_key", "alert_key", "message"))
    for attempt, divisor in ((1, 3), (2, 6), (3, 6)):
        alert_sink_module.deliver(alerts, path, _picky(divisor), attempt=attempt)
    tried = alert_sink_module.deliveries(spark, path)
    return tried.select("attempt", "product_key", "alert_key", "status", "error")


# ---- runs ------------------------------------------------------------------------------


def _run_name(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm")


def _feed_alerts(spark, sf):
    best = materialize(I.hourly_runs(price_feed(spark, sf)))
    hours = best.select("run").distinct()
    return materialize(I.run_alerts(best, hours, flat=FEED_FLAT)), hours


@query
def run_classes(spark, sf):
    events = table(spark, sf, "events")
    return events.select("event_id", run_class(F.col("ts")).alias("run_class"))


@query
def asof_snapshots(spark, sf):
    best = materialize(I.hourly_runs(price_feed(spark, sf)))
    seen = I.asof_snapshots(best.select("run"), best)
    return seen.select(
        _run_name("run").alias("run"), "source", _run_name("snapshot_run").alias("snapshot_run")
    )


@query
def asof_events(spark, sf):
    """The last price of every other source at each moment that the anchor shows a price."""
    feed = price_feed(spark, sf)
    others = F.array(*[F.lit(s.id) for s in DEFAULT_SOURCES[1:]])
    asked = feed.where(F.col("source") == DEFAULT_SOURCES[0].id).select("ts", "ord", F.explode(others).alias("source"))
    taken = feed.select("source", "ts", F.col("cash_price").alias("last_price"), F.col("ord").alias("last_ord"))
    return I.asof_latest(asked, taken.select("source", "ts", "last_ord", "last_price"), "source").drop("ts")


@query
def delta_products(spark, sf):
    """Products after all sources delivered and one of them again, with half its offers and lower prices."""
    root = scratch_path(spark, "delta")
    rows = materialize(offers(spark, sf).withColumn("ord", F.col("ord").dropFields("rank")))
    first = {s.id: rows for s in DEFAULT_SOURCES}
    delta_runs.run(spark, first, root, f"{STAMP}+00:00")
    cheaper = rows.where(F.col("ord.l_orderkey") % 2 == 0).withColumn("cash_price", F.col("cash_price") * 0.5)
    delta_runs.run(spark, {"shop_c": cheaper}, root, f"{STAMP}+00:00")
    messages = C.build_messages(delta_runs.current_products(spark, root))
    return messages.select("product_key", "has_alert", "message")


@query
def new_alerts(spark, sf):
    """Alerts of all offers against those of the offers shipped before 2000."""
    rows = offers(spark, sf)
    earlier = rows.where(F.col("ord.l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz"))

    def keyed(df):
        alerts = C.alerts_only(C.build_messages(G.product_groups(df)))
        return alerts.select("product_key", "alert_key")

    return I.only_new(keyed(rows), keyed(earlier)).select("product_key", "alert_key")


@query
def new_alerts_by_run(spark, sf):
    alerts, hours = _feed_alerts(spark, sf)
    fresh = I.new_alerts_by_run(alerts, hours)
    return fresh.select(_run_name("run").alias("run"), "product_key")


@query
def alert_counts(spark, sf):
    alerts, hours = _feed_alerts(spark, sf)
    counts = I.alert_counts(alerts, I.new_alerts_by_run(alerts, hours))
    return counts.select(_run_name("run").alias("run"), "alerts", "new_alerts")


@query
def alerts_by_schedule(spark, sf):
    alerts, hours = _feed_alerts(spark, sf)
    local_alerts = alerts.withColumn("run", local_time(F.col("run")))
    local_runs = hours.select(local_time(F.col("run")).alias("run"))
    sent = I.alerts_by_schedule(local_alerts, local_runs)
    return sent.select(_run_name("run").alias("run"), "product_key", "run_class")


def _event_stream(spark, sf) -> DataFrame:
    schema = table(spark, sf, "events").schema
    events = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    )
    return feed_from_events(events)


@query
def stream_new_alerts_query(spark, sf):
    root = scratch_path(spark, "stream-alerts")
    stream_new_alerts(
        _event_stream(spark, sf), f"{root}/state", f"{root}/out", f"{root}/checkpoint",
        flat=FEED_FLAT,
    ).awaitTermination()
    fresh = spark.read.parquet(f"{root}/out")
    return fresh.select(_run_name("run").alias("run"), "product_key")


@query
def stream_snapshots_query(spark, sf):
    root = scratch_path(spark, "stream-snapshots")
    stream_snapshots(
        _event_stream(spark, sf), f"{root}/store", f"{root}/state", f"{root}/checkpoint"
    ).awaitTermination()
    stored = spark.read.parquet(f"{root}/store")
    return stored.select("source", _run_name("run").alias("run"), "product_key", "cash_price")


def _ended(spark, feed: DataFrame, folder: str) -> DataFrame:
    """The feed with a mark behind its end, so that the last hours are closed too."""
    end_mark(spark, folder, dt.datetime(2100, 1, 1))
    return with_end_marks(feed, folder)


@query
def stream_new_alerts_ended(spark, sf):
    root = scratch_path(spark, "stream-alerts")
    feed = _ended(spark, _event_stream(spark, sf), f"{root}/marks")
    stream_new_alerts(
        feed, f"{root}/state", f"{root}/out", f"{root}/checkpoint", flat=FEED_FLAT
    ).awaitTermination()
    fresh = spark.read.parquet(f"{root}/out")
    return fresh.select(_run_name("run").alias("run"), "product_key")


@query
def stream_snapshots_ended(spark, sf):
    root = scratch_path(spark, "stream-snapshots")
    feed = _ended(spark, _event_stream(spark, sf), f"{root}/marks")
    stream_snapshots(feed, f"{root}/store", f"{root}/state", f"{root}/checkpoint").awaitTermination()
    stored = spark.read.parquet(f"{root}/store")
    return stored.select("source", _run_name("run").alias("run"), "product_key", "cash_price")


def _title_stream(spark, path: str, **options) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return title_feed_from_events(spark.readStream.schema(schema).options(**options).parquet(path))


@query
def stream_reports_query(spark, sf):
    """The run loop over raw titles, up to the last hour: numbered messages of all new alerts."""
    root = scratch_path(spark, "stream-reports")
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    feed = _ended(spark, title_feed_from_events(events), f"{root}/marks")
    stream_reports(feed, root, f"{root}/checkpoint", flat=FEED_FLAT).awaitTermination()
    sent = spark.read.parquet(f"{root}/out")
    return sent.select(_run_name("run").alias("run"), "n", "product_key", "alert_key", "message")


@query
def stream_late_rows(spark, sf):
    """Events that arrive in three parts, each over all of the time: most of the later ones are late."""
    root = scratch_path(spark, "stream-late")
    events = table(spark, sf, "events")
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{root}/events")
    feed = _title_stream(spark, f"{root}/events", maxFilesPerTrigger="1")
    stream_reports(feed, root, f"{root}/checkpoint", flat=FEED_FLAT).awaitTermination()
    late = spark.read.parquet(f"{root}/late").groupBy("batch").agg(
        F.count(F.lit(1)).alias("listed"), F.sum("ord").alias("ids")
    )
    counted = spark.read.parquet(f"{root}/counts").join(late, "batch", "left")
    return counted.select(
        "batch", "rows", "late", F.coalesce("listed", F.lit(0)).alias("listed"),
        F.coalesce("ids", F.lit(0)).alias("ids"),
    )


@query
def stream_pages(spark, sf):
    """Pages stored twice, every third one changed: how often each was read, and its last heading."""
    root = scratch_path(spark, "stream-pages")
    pages = table(spark, sf, "pages")
    url = F.concat("url", F.lit("#"), F.col("page_id").cast("string"))
    changed = F.replace("html", F.lit("<h1>"), F.lit("<h1>New "))
    second = F.when(F.col("page_id") % 3 == 0, changed).otherwise(F.col("html"))
    for k, html in enumerate((F.col("html"), second)):
        stored = pages.select("page_id", url.alias("url"), html.alias("html"), F.lit(k).alias("stored_at"))
        stored.write.mode("append").parquet(f"{root}/pages")
        schema = spark.read.parquet(f"{root}/pages").schema
        stream = spark.readStream.schema(schema).parquet(f"{root}/pages")
        stream_changed_pages(  # one batch: all files that were stored now
            stream, lambda p: detail.extract_detail(p).select("page_id", "url", "name"), root, f"{root}/checkpoint"
        ).awaitTermination()
    read = spark.read.parquet(f"{root}/out").groupBy("page_id").agg(F.count(F.lit(1)).alias("times"))
    last = current_rows(spark, root).select("page_id", "name")
    return read.join(last, "page_id")


for _name in ("stream_new_alerts", "stream_snapshots", "stream_reports"):
    QUERIES[_name] = QUERIES.pop(f"{_name}_query")
