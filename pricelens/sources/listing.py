"""Listing pages: product cards, page counts, links."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import absolute_url, strip_prefix
from ..functions.prices import parse_price_text
from ..functions.text import bind, non_empty, trim_all
from ..functions.vocabulary import OUT_OF_STOCK_TEXT
from ..schema import LISTING
from ..session import ship_package
from .catalog import page_coverage
from .html import attribute, first, inside, select, text_between, text_of, text_without, with_page


def hrefs(page: Column) -> Column:
    return F.transform(select(page["elements"], "a", attr="href"), lambda a: attribute(a, "href"))


def page_count(page: Column, mark: str = "?page=", number: str = r"page=(\d+)") -> Column:
    """Largest page number among the links that contain ``mark``, at least 1."""
    links = F.filter(hrefs(page), lambda h: h.contains(mark))
    numbers = F.transform(links, lambda h: F.regexp_extract(h, number, 1).try_cast("int"))
    return F.greatest(F.lit(1), F.coalesce(F.array_max(numbers), F.lit(1)))


def listing_page_count(pages: DataFrame, style: str = "page") -> DataFrame:
    """``page_id, page_count`` by ``?page=N`` links or by ``p=N`` parameters."""
    mark, number = ("?page=", r"page=(\d+)") if style == "page" else ("p=", r"[?&]p=(\d+)")
    read = with_page(pages.select("page_id", "html"))
    return read.select("page_id", page_count(F.col("page"), mark, number).alias("page_count"))


def has_next_page(page: Column) -> Column:
    """Whether an active "next" link exists."""
    following = select(page["elements"], "a", "action", "next")
    inactive = F.exists(following, lambda a: F.array_contains(a["classes"], "inactive"))
    return (F.size(following) > 0) & ~inactive


def listing_coverage(pages: DataFrame, mark: str = "?page=", number: str = r"page=(\d+)") -> DataFrame:
    """Whether all pages of each listing are there, from ``listing, number, html`` of the held ones.

    A listing claims the largest page that any of its pages links to, and one more than a page with
    an active "next" link. Returns ``listing, pages_claimed, pages_held, complete, missing``; a
    complete listing so ends in a page without "next".
    """
    read = with_page(pages.select("listing", "number", "html"))
    page = F.col("page")
    following = F.col("number") + has_next_page(page).cast("int")
    claimed = F.greatest(page_count(page, mark, number), following.cast("int"))
    rows = read.select("listing", "number", claimed.alias("last_page"))
    return page_coverage(rows.withColumnRenamed("number", "page"), "listing")


def extract_links(pages: DataFrame, base: str = "") -> DataFrame:
    """``page_id, pos, name, url`` for every link with a text, in page order."""
    page = F.col("page")
    links = F.transform(
        F.filter(select(page["elements"], "a", attr="href"), lambda a: a["closed"]),
        lambda a: F.struct(text_of(page, a).alias("name"), attribute(a, "href").alias("href")),
    )
    read = with_page(pages.select("page_id", "html"))
    rows = read.select("page_id", F.posexplode(links).alias("pos", "link"))
    kept = rows.select("page_id", "pos", "link.*").where((F.col("name") != "") & (F.col("href") != ""))
    return kept.select("page_id", "pos", "name", absolute_url(F.col("href"), base).alias("url"))


@dataclass(frozen=True)
class CardSpec:
    """Where a shop keeps the name and the link of a product card; no tag means any."""

    tag: str | None
    card: str
    name_tag: str | None
    name_class: str | None = None
    name_attr: str | None = None
    link_classes: tuple[str, ...] = ()
    any_link: bool = False
    container: str | None = None
    base: str = ""
    buy_word: bool = False
    in_stock_price: bool = False


# The three regular card layouts. Pass ``base`` for shops with relative links.
CARD_IMAGE_ALT = CardSpec(
    None, "product-item-info", None, "product-image-photo", "alt",
    ("product-item-photo",), buy_word=True,
)
CARD_LINK_TEXT = CardSpec(
    None, "product-item-info", None, "product-item-link",
    link_classes=("product-item-photo", "product-item-link"),
)
CARD_HEADING = CardSpec(
    None, "item-body", "h3", link_classes=("prod-item-img",), any_link=True,
    container="listitem", in_stock_price=True,
)


def regular_price(page: Column, among: Column | None = None) -> Column:
    """Price in the regular-price element inside the first price block, text of inner spans left
    out. ``among`` are the elements to look in, all of the page if it is not given."""

    def read(regular: Column) -> Column:
        return parse_price_text(text_without(page, regular, "span"))

    block = first(page["elements"] if among is None else among, None, "price")
    return bind(block, lambda b: bind(first(inside(page, b), None, "regular"), read))


def _card(spec: CardSpec, page: Column, cards: Column, card: Column, i: Column) -> Column:
    """What a card says; it ends where it is closed or where the next card begins."""
    following = F.get(cards, i + 1)
    end = F.least(card["end"], F.coalesce(following["at"], card["end"]))
    last = F.least(card["t1"], F.coalesce(following["t0"], card["t1"]))

    def read(own: Column) -> Column:
        if spec.name_attr:
            name = attribute(first(own, spec.name_tag, spec.name_class), spec.name_attr)
        else:
            classes = (spec.name_class,) if spec.name_class else ()
            named = select(own, spec.name_tag, *classes)
            # One element with the class, but all headings.
            named = F.slice(named, 1, 1) if classes else F.filter(named, lambda e: e["closed"])
            texts = F.transform(named, lambda e: text_between(page, e["t0"], F.least(e["t1"], last)))
            name = F.array_join(texts, "")
        if spec.buy_word:
            name = strip_prefix(trim_all(name))

        among = own
        if spec.container:
            # A card's link may stand before the card: in a container opened after the last card.
            since = F.coalesce(F.get(cards, i - 1)["at"], F.lit(-1))
            around = F.filter(
                F.slice(page["elements"], since + 2, card["at"] - since - 1),
                lambda e: F.array_contains(e["classes"], spec.container),
            )
            box = F.try_element_at(around, F.lit(-1))
            among = bind(
                F.when(box["end"] > card["at"], box),
                lambda b: F.slice(page["elements"], b["at"] + 1, F.least(
                    b["end"], F.coalesce(following["at"], b["end"])) - b["at"]),
            )
        links = [non_empty(attribute(first(among, "a", c), "href")) for c in spec.link_classes]
        if spec.any_link:
            links.append(non_empty(attribute(first(own, "a"), "href")))
        price = regular_price(page, own) if spec.in_stock_price else F.lit(None).cast("double")
        return F.struct(
            trim_all(name).alias("name"),
            F.coalesce(*links).alias("href"),
            price.alias("cash_price"),
            text_between(page, card["t0"], last).contains(OUT_OF_STOCK_TEXT).alias("sold"),
        )

    return bind(F.slice(page["elements"], card["at"] + 1, end - card["at"]), read)


def extract_cards(pages: DataFrame, spec: CardSpec) -> DataFrame:
    """``page_id, pos, name, url, cash_price``; a card without name or link is dropped."""
    page = F.col("page")
    found = bind(
        select(page["elements"], spec.tag, spec.card),
        lambda cards: F.transform(cards, lambda c, i: _card(spec, page, cards, c, i)),
    )
    read = with_page(pages.select("page_id", "html"))
    rows = read.select("page_id", F.posexplode(found).alias("pos", "card")).select("page_id", "pos", "card.*")
    rows = rows.where((F.col("name") != "") & F.col("href").isNotNull())
    if spec.in_stock_price:
        rows = rows.where(~F.col("sold") & F.col("cash_price").isNotNull())
    return rows.select(
        "page_id", "pos", "name", absolute_url(F.col("href"), spec.base).alias("url"),
        "cash_price",
    )


class _HeadingCards(HTMLParser):
    """Headings with the first product link of their closest div."""

    def __init__(self, marker: str) -> None:
        super().__init__()
        self.marker, self.cards, self.open_divs = marker, [], []
        self.heading: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "div":
            self.open_divs.append({"link": None, "cards": []})
        elif tag == "h3":
            self.heading = []
        elif tag == "a" and self.marker in (href := dict(attrs).get("href") or ""):
            for div in self.open_divs:
                div["link"] = div["link"] or href

    def handle_data(self, data: str) -> None:
        if self.heading is not None:
            self.heading.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "h3" and self.heading is not None:
            name, self.heading = "".join(self.heading).strip(), None
            card = {"name": name, "link": None}
            self.cards.append(card)
            if self.open_divs:
                self.open_divs[-1]["cards"].append(card)
        elif tag == "div" and self.open_divs:
            self._close(self.open_divs.pop())

    def _close(self, div: dict) -> None:
        for card in div["cards"]:
            card["link"] = div["link"]

    def finish(self) -> list[tuple[str, str]]:
        self.close()
        while self.open_divs:
            self._close(self.open_divs.pop())
        return [(c["name"], c["link"]) for c in self.cards if c["name"] and c["link"]]


def extract_headings(
    pages: DataFrame, base: str = "", marker: str = "/store/product/"
) -> DataFrame:
    """Cards whose link is looked up through the closest enclosing div.

    The closest ancestor needs a stack, so this one layout is read in Python, over batches
    of pages that can hold a card at all.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, html in zip(batch["page_id"], batch["html"], strict=True):
                parser = _HeadingCards(marker)
                parser.feed(html)
                rows += [(page_id, i, n, u) for i, (n, u) in enumerate(parser.finish())]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "name", "url"])

    ship_package(pages.sparkSession)  # workers need not have this package installed
    candidates = pages.where(F.col("html").contains(marker)).select("page_id", "html")
    found = candidates.mapInPandas(read, LISTING)
    return found.withColumn("url", absolute_url(F.col("url"), base))
