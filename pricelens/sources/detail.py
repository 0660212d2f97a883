"""Product detail pages: single prices, variant links, embedded variant tables, buttons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prices import (
    digits_price,
    float_prefix,
    float_prefix_or_zero,
    int_prefix,
    round_price,
)
from ..functions.text import S, bind, non_empty
from ..functions.vocabulary import RAM_LABELS, VARIANT_LABELS
from ..schema import ATTRIBUTES, OPTION_PRICES
from .html import attribute, first, has_attribute, inside, select, text_of, with_page
from .listing import regular_price

# Strict JSON only: what a browser would refuse to parse counts as a failure here too.
_JSON_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _first_closed(page: Column, tag: str) -> Column:
    found = F.filter(select(page["elements"], tag), lambda e: e["closed"])
    return bind(F.get(found, F.lit(0)), lambda e: non_empty(text_of(page, e)))


def heading(page: Column) -> Column:
    """Text of the first h1, null if there is none."""
    return _first_closed(page, "h1")


def page_title(page: Column) -> Column:
    return _first_closed(page, "title")


def credit_price(page: Column) -> Column:
    """Installment price on the first link of the credit calculator."""
    block = first(page["elements"], None, "credit_calc_link")
    return bind(block, lambda b: int_prefix(attribute(first(inside(page, b), "a"), "data-price")))


def extract_detail(pages: DataFrame, *extra: Column) -> DataFrame:
    """``page_id, url, name, cash_price, installment_price`` as the page itself states them.

    ``extra`` columns may use all columns of ``pages`` but ``html``, and ``page``.
    """
    page = F.col("page")
    return with_page(pages).select(
        "page_id",
        "url",
        heading(page).alias("name"),
        regular_price(page).alias("cash_price"),
        credit_price(page).alias("installment_price"),
        *extra,
    )


def links_of(page: Column, product_path: str, labels: list[str] | None = None) -> Column:
    """Distinct hrefs below ``product_path`` whose text is one of the variant labels."""
    wanted = labels or VARIANT_LABELS
    anchors = F.filter(
        select(page["elements"], "a", attr="href"),
        lambda a: a["closed"] & attribute(a, "href").contains(product_path) & text_of(page, a).isin(wanted),
    )
    return F.array_distinct(F.transform(anchors, lambda a: attribute(a, "href")))


def variant_links(
    pages: DataFrame, product_path: str, labels: list[str] | None = None
) -> DataFrame:
    """``page_id, url, pos, link`` for every variant a page links to."""
    read = with_page(pages.select("page_id", "url", "html"))
    links = links_of(F.col("page"), product_path, labels)
    return read.select("page_id", "url", F.posexplode(links).alias("pos", "link"))


def first_object(text: Column) -> Column:
    """``text`` up to the first closing brace that balances all braces before it.

    Braces are counted as characters, also inside strings. Empty if they never balance.
    """
    braces = F.split(F.regexp_replace(text, "[^{}]+", ""), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("closed"), F.lit(0).alias("end"))

    def step(acc: Column, brace: Column) -> Column:
        closes = (brace == "}").cast("int")
        depth = acc["depth"] + (brace == "{").cast("int") - closes
        closed = acc["closed"] + closes
        balanced = (acc["end"] == 0) & (brace == "}") & (depth == 0)
        return F.struct(
            depth.alias("depth"),
            closed.alias("closed"),
            F.when(balanced, closed).otherwise(acc["end"]).alias("end"),
        )

    def cut(end: Column) -> Column:
        upto = F.call_function("substring_index", text, F.lit("}"), end)
        return F.when(end > 0, F.concat(upto, F.lit("}"))).otherwise(F.lit(""))

    return bind(F.aggregate(braces, start, step)["end"], cut)


def whole_json(text: Column, schema: str) -> Column:
    """A JSON object, null unless it is all of the text.

    The parser would stop at the end of the first value; inside an array it cannot.
    """
    wrapped = F.concat(F.lit("["), text, F.lit("]"))
    return F.get(F.from_json(wrapped, f"array<{schema}>", _JSON_OPTIONS), F.lit(0))


def extract_variant_config(pages: DataFrame) -> DataFrame:
    """Add ``attributes``, ``option_prices`` and ``ok`` from the JSON embedded in a page.

    The attribute object is read from its marker to where its braces balance, the price
    object from its marker to the next one. Anything missing or malformed gives
    ``ok = false``.
    """
    html = F.col("html")
    placed = pages.withColumns(
        {
            "_a": F.locate('"attributes"', html),
            "_o": F.locate('"optionPrices"', html),
            "_p": F.locate('"priceFormat"', html),
        }
    )
    found = (F.col("_a") > 0) & (F.col("_o") > 0) & (F.col("_p") > 0)
    attribute_text = html.substr(F.col("_a"), F.greatest(F.col("_o") - F.col("_a"), F.lit(0)))
    price_text = html.substr(F.col("_o"), F.greatest(F.col("_p") - F.col("_o"), F.lit(0)))
    attribute_json = first_object(
        F.regexp_replace(attribute_text, rf'^"attributes"{S}*:{S}*', "")
    )
    price_json = F.regexp_replace(
        F.regexp_replace(price_text, rf'^"optionPrices"{S}*:{S}*', ""), rf",{S}*\z", ""
    )
    parsed = placed.withColumns(
        {
            "attributes": F.when(found, whole_json(attribute_json, ATTRIBUTES)),
            "option_prices": F.when(found, whole_json(price_json, OPTION_PRICES)),
        }
    )
    ok = F.col("attributes").isNotNull() & F.col("option_prices").isNotNull()
    return parsed.withColumn("ok", ok).drop("_a", "_o", "_p")


def disabled_products(page: Column, attributes: Column) -> Column:
    """Ids of all products that belong to an option the page marks as empty."""
    swatches = select(page["elements"], None, "swatch-option")
    empty = F.filter(swatches, lambda e: attribute(e, "data-option-empty") == "true")

    options = F.flatten(F.transform(F.map_values(attributes), lambda a: a["options"]))
    ids = F.transform(empty, lambda e: attribute(e, "data-option-id"))

    def of_empty(both: Column) -> Column:
        found = F.filter(both["options"], lambda o: F.array_contains(both["ids"], o["id"]))
        none = F.array().cast("array<string>")
        products = F.flatten(F.transform(found, lambda o: o["products"]))
        return F.when(F.size(both["ids"]) == 0, none).otherwise(F.coalesce(products, none))

    return bind(F.struct(ids.alias("ids"), options.alias("options")), of_empty)


def simple_offer(page: Column, installment: str = "button") -> Column:
    """``struct(cash_price, installment_price)`` of a page without variants.

    The installment price is an attribute of the loan button or the text of the credit
    price element, depending on the shop.
    """
    final = F.filter(page["elements"], lambda e: attribute(e, "data-price-type") == "finalPrice")
    cash = int_prefix(attribute(F.get(final, F.lit(0)), "data-price-amount"))
    if installment == "button":
        raw = attribute(first(page["elements"], "button", "loan_price"), "data-price")
        second = round_price(float_prefix_or_zero(raw))
    else:
        block = first(page["elements"], None, "credit_price")
        price = bind(block, lambda b: first(inside(page, b), None, "price"))
        second = bind(price, lambda p: digits_price(text_of(page, p)))
    return F.struct(cash.alias("cash_price"), second.alias("installment_price"))


def _buttons(page: Column, cls: str) -> Column:
    buttons = F.filter(select(page["elements"], "button", cls), lambda b: b["closed"])
    return F.transform(
        buttons,
        lambda b: F.struct(
            text_of(page, b).alias("label"),
            float_prefix(attribute(b, "data-price")).alias("price"),
            float_prefix(attribute(b, "data-loanprice")).alias("loan_price"),
            attribute(b, "data-color").alias("color"),
            has_attribute(b, "disabled").alias("disabled"),
        ),
    )


def static_ram(page: Column) -> Column:
    """Value of the first spec item that is about RAM, null if there is none."""

    def spec(items: Column, item: Column, i: Column) -> Column:
        end = F.least(item["end"], F.coalesce(F.get(items, i + 1)["at"], item["end"]))
        own = F.slice(page["elements"], item["at"] + 2, end - item["at"] - 1)

        def text(cls: str) -> Column:
            return bind(first(own, None, cls), lambda e: text_of(page, e))

        return F.struct(text("text-[#8C8C8C]").alias("label"), text("font-semibold").alias("value"))

    specs = bind(
        select(page["elements"], None, "flex", "items-center", "gap-4"),
        lambda items: F.transform(items, lambda item, i: spec(items, item, i)),
    )
    about_ram = F.filter(
        specs,
        lambda s: s["label"].contains(RAM_LABELS[0]) | s["label"].contains(RAM_LABELS[1]),
    )
    return non_empty(F.get(about_ram, F.lit(0))["value"])


def extract_buttons(rendered: DataFrame) -> DataFrame:
    """Storage and modifier buttons of rendered pages.

    ``rendered`` holds ``html, state`` and any columns to keep: one row per storage button
    that was selected when the page was stored, ``state`` being its label (null for pages
    without).
    """
    page = F.col("page")
    kept = [c for c in rendered.columns if c != "html"]
    read = with_page(rendered).select(
        *kept,
        _buttons(page, "storage-btn").alias("all_storage"),
        _buttons(page, "modifier-btn").alias("all_modifiers"),
        static_ram(page).alias("ram_spec"),
    )
    return read.select(
        *kept,
        F.filter(
            "all_storage", lambda b: ~b["disabled"] & (b["label"] != "") & b["price"].isNotNull()
        ).alias("storage"),
        F.filter(
            "all_modifiers", lambda b: ~b["disabled"] & (b["color"] == "") & (b["label"] != "")
        ).alias("modifiers"),
        F.get("all_storage", F.lit(0))["price"].alias("first_price"),
        "ram_spec",
    )
