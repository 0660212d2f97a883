"""Shop pages derived from the given tables, as input of the extraction jobs.

The tables hold no product pages, so Spark writes them from ``part``: one page per part,
with different markup by part number. They exist only inside a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import choose, dealt, table

SHOP = "https://shop.example"


def _text(*parts: str | Column) -> Column:
    return F.concat(
        *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    )


def _id(suffix: str) -> Column:
    return _text(F.col("p_partkey"), f"-{suffix}")


def _ids(*suffixes: str) -> Column:
    quoted = [_text('"', _id(s), '"') for s in suffixes]
    return F.concat(F.lit("["), F.concat_ws(",", *quoted), F.lit("]"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    return dealt(rows, "p_partkey")


def _option(id_: str, label: str, *suffixes: str) -> Column:
    return _text(f'{{"id":"{id_}","label":"{label}","products":', _ids(*suffixes), "}")


def _attribute(key: str, code: str, *options: Column) -> Column:
    inner = F.concat_ws(",", *options)
    return _text(f'"{key}":{{"code":"{code}","options":[', inner, "]}")


def _prices() -> Column:
    price = F.col("p_retailprice")
    entries = [
        _text('"', _id("2"), '":{"finalPrice":{"amount":', price,
              '},"creditPrice":{"amount":', price + 50, "}}"),
        _text('"', _id("3"), '":{"finalPrice":{"amount":', price * 2, "}}"),
        F.when(
            F.col("p_partkey") % 4 != 0,
            _text('"', _id("4"), '":{"finalPrice":{"amount":',
                  F.when(F.col("p_partkey") % 5 == 0, F.lit(0.0)).otherwise(price + 10),
                  '},"creditPrice":{"amount":', price + 20, "}}"),
        ),
    ]
    return _text("{", F.concat_ws(",", *entries), "}")


def _simple_markup(kind: str) -> Column:
    """Price markup of a page without variants; absent for every seventh part."""
    price = F.col("p_retailprice")
    if kind == "ram":
        second = _text('<button class="action loan_price" data-price="', price / 8, '">+</button>')
    else:
        second = _text(
            '<div class="credit_price"><span class="price">', F.floor(price / 4), " 000 ֏</span></div>"
        )
    tag = _text(
        '<span data-price-type="finalPrice" data-price-amount="', price, '">', price, "</span>",
        second,
    )
    return F.when(F.col("p_partkey") % 7 != 0, tag).otherwise(F.lit("<p>sold</p>"))


def config_pages(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """``page_id, url, html`` of pages with embedded options.

    By ``p_partkey % 6``: 0 all options, 1 storage only, 2 a marker is missing, 3 the price
    JSON is broken, 4 one option is empty, 5 no storage option.
    """
    case = F.col("p_partkey") % 6
    codes = {"ram": ("memory", "gb_ram"), "sim": ("drive", "ram")}[kind]
    storage = _attribute(
        "90", codes[0],
        _option("s1", "128 ԳԲ", "1", "2"), _option("s2", "256 GB", "3", "4"),
    )
    ram = _attribute(
        "100", codes[1],
        _option("r1", "8 GB", "2", "3"), _option("r2", "12 ԳԲ", "4", "9"),
    )
    sim = _attribute(
        "9", "sim_card",
        _option("m1", "eSIM", "1", "3"), _option("m2", "Nano + eSIM", "2", "4"),
        _option("m3", "e-sim", "2"), _option("m4", "2 eSIM", "4"),
    )
    color = _attribute("7", "color", _option("c1", "Red", "1", "2", "3", "4"))
    listed = [
        F.when(case != 5, storage),
        F.when(case != 1, ram),
        sim if kind == "sim" else F.lit(None).cast("string"),
        color,
    ]
    attributes = _text("{", F.concat_ws(",", *listed), "}")
    prices = F.when(case == 3, F.lit('{"x":')).otherwise(_prices())
    html = _text(
        '<html><body><script>{"product":{"attributes":', attributes,
        ',"template":"<%- data.price %>","optionPrices": ', prices,
        F.when(case == 2, ',"format":').otherwise(',"priceFormat":'),
        '{"pattern":"%s"}}}</script><div class="swatch">',
        '<div class="swatch-option text" data-option-empty="',
        F.when(case == 4, "true").otherwise("false"),
        '" data-option-id="s2">256</div></div>',
        _simple_markup(kind), "</body></html>",
    )
    return parts(spark, sf_dir).select(
        F.col("p_partkey").alias("page_id"), product_url().alias("url"), html.alias("html")
    )


def product_url(part: Column | None = None) -> Column:
    key = F.col("p_partkey") if part is None else part
    return _text(f"{SHOP}/store/product/", key)


def card_pages(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Listing pages, one per part: the part's card and, on some, one that must be dropped."""
    key, path = F.col("p_partkey"), _text("/store/product/", F.col("p_partkey"))
    link = F.when(key % 2 == 0, path).otherwise(product_url())
    if kind == "ram":
        title = _text("Գնել ", "Xiaomi ", F.col("p_name"), " &amp; case")
        card = _text(
            '<div class="product-item-info"><div class="photo"><a class="photo product-item-photo" href="',
            link, '"><img src="i.png" class="product-image-photo" alt="', title,
            '"></a></div></div>',
        )
        bad = '<div class="product-item-info"><a class="product-item-photo" href="/x"><b>no name</b></a></div>'
    elif kind == "sim":
        title = _text(F.when(key % 2 == 0, "iPhone ").otherwise("Galaxy "), F.col("p_name"))
        card = _text(
            '<div class="product-item-info"><div><strong><a class="product-item-link" href="',
            link, '"> ', title, " </a></strong></div></div>",
        )
        bad = '<div class="product-item-info"><a class="product-item-link">no link</a></div>'
    elif kind == "detail":
        price = _text(
            '<div class="price"><div class="regular"><span>was</span> ',
            F.floor(F.col("p_retailprice")), ",500 դր.</div></div>",
        )
        card = _text(
            '<div class="listitem"><a class="prod-item-img" href="', product_url(),
            '"><img></a><div class="item-body"><h3>', F.col("p_name"), "</h3>",
            F.when(key % 11 == 0, "<p>Առկա չէ</p>").otherwise(""),
            price, '<a href="/cart">buy</a></div></div>',
        )
        bad = '<div class="listitem"><div class="item-body"><h3>free</h3></div></div>'
    else:
        card = _text(
            '<div><div class="pic"><a href="/help">?</a></div><div><h3> ', F.col("p_name"),
            ' </h3><p><a href="', link, '">open</a></p></div></div>',
        )
        bad = '<div><h3>no link</h3></div>'
    html = _text(
        "<html><body>", F.when(key % 3 == 0, bad).otherwise(""), card,
        '<footer><a href="/about">about</a></footer></body></html>',
    )
    return parts(spark, sf_dir).select(key.alias("page_id"), html.alias("html"))


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product pages that link to variants; all of them link to the page of part 1."""
    key, price = F.col("p_partkey"), F.floor(F.col("p_retailprice"))
    anchors = [
        _text('<a href="', product_url(key + 1), '"> 256GB </a>'),
        _text('<a href="', product_url(F.lit(1)), '">Nano-SIM</a>'),
        _text('<a href="', product_url(key), '">512GB</a>'),
        _text('<a href="', product_url(key + 2), '">See also</a>'),
        _text('<a href="', product_url(key + 1), '">256GB</a>'),
    ]
    html = _text(
        "<html><body>",
        F.when(key % 5 != 0, _text("<h1>", F.col("p_name"), " ", key % 3, "</h1>")).otherwise(""),
        F.when(
            key % 4 != 0,
            _text('<div class="price"><div class="regular">', price, ",000 <span>old</span>դր</div></div>"),
        ).otherwise(""),
        F.when(
            key % 3 != 0,
            _text('<p class="credit_calc_link"><a href="#" data-price="', price * 1100, '">%</a></p>'),
        ).otherwise(""),
        *anchors, "</body></html>",
    )
    return parts(spark, sf_dir).select(
        key.alias("page_id"), product_url().alias("url"), html.alias("html")
    )


def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Button pages, one row per storage state.

    By ``p_partkey % 5``: 0 no modifiers, 1 RAM, 2 SIM, 3 another modifier, 4 only a disabled
    storage button, which makes it a page without variants.
    """
    key, price, case = F.col("p_partkey"), F.col("p_retailprice"), F.col("p_partkey") % 5
    states = F.when(case == 4, F.array(F.lit(None).cast("string"))).otherwise(
        F.array(F.lit("128GB"), F.lit("256GB"))
    )
    labels = [
        choose(case, ["", "8gb", "eSIM", "Global", ""]),
        choose(case, ["", "12GB", "Nano-SIM + eSIM", "Dual", ""]),
    ]
    extra = F.when(F.col("state") == "256GB", price + 100).otherwise(F.lit(0.0))
    modifiers = [
        F.when(
            label != "",
            _text('<button class="modifier-btn" data-price="', extra + i,
                  '" data-loanprice="0">', label, "</button>"),
        ).otherwise("")
        for i, label in enumerate(labels)
    ]
    spec = F.when(
        key % 2 == 0,
        _text('<div class="flex items-center gap-4"><div><span class="text-[#8C8C8C]">Օպերատիվ հիշողություն</span>'
              '<span class="font-semibold">6GB</span></div></div>'),
    ).otherwise("")
    html = _text(
        '<html><body><button class="storage-btn', F.when(case == 4, '" disabled').otherwise('"'),
        ' data-price="', price, '" data-loanprice="', price * 2, '">128GB</button>',
        F.when(
            case != 4,
            _text('<button class="storage-btn" data-price="', price + 500, '"> 256GB </button>'),
        ).otherwise(""),
        '<button class="modifier-btn" data-color="red" data-price="1">Red</button>',
        *modifiers,
        '<div class="flex items-center gap-4"><span class="text-[#8C8C8C]">Էկրան</span>'
        '<span class="font-semibold">6.1</span></div>',
        spec, "</body></html>",
    )
    rows = parts(spark, sf_dir).withColumn("state", F.explode(states))
    return rows.select(
        key.alias("page_id"), product_url().alias("url"), F.col("p_name").alias("name"),
        "state", html.alias("html"),
    )


SIM_VALUES = [
    "eSIM", "Nano-SIM", "1 SIM + eSIM", "eSIM + eSIM", "2 eSIM, sim + x", "dual esim + 1 sim",
    "", "Nano-SIM + eSIM",
]


DAMAGED = 211  # every page whose event is divisible by this is cut off in the middle


def damaged_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``brand, value``: catalog pages of many brands that say their number in their text."""
    pages = catalog_pages(spark, sf_dir)
    whole = _text('{"page":', F.col("page"), ",", F.expr("substring(value, 2)"))
    cut_off = F.substring(whole, 1, 40)
    brand = F.concat("brand", F.lit("-"), (F.col("page") % 60).cast("string"))
    value = F.when(F.col("page") % DAMAGED == 0, cut_off).otherwise(whole)
    return pages.select(brand.alias("brand"), value.alias("value"))


def catalog_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``brand, page, value`` where value is the JSON text of a catalog page, from events.

    Each event is a page with two products; ``k`` of its properties chooses the SIM text and
    the number of pages the brand claims to have.
    """
    events = dealt(table(spark, sf_dir, "events"), "event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    sim = choose(k % len(SIM_VALUES), SIM_VALUES)
    first = _text(
        '{"name":"Phone ', F.col("user_id"), F.when(k % 3 == 0, " eSIM").otherwise(""),
        '","price":"', F.col("value"), '","cash_price":"', F.col("value"),
        '","installment_price":"', F.when(k % 2 == 0, F.lit("0")).otherwise(k.cast("string")),
        '","attributes":[{"attribute_id":3,"attribute_value":"x"},{"attribute_id":19,"attribute_value":"',
        sim, '"}]}',
    )
    second = _text('{"name":"Case ', k, '","price":"n/a","cash_price":" ', k, ' "}')
    value = _text(
        '{"data":{"products":{"last_page":', k % 30 + 1, ',"data":[', first, ",", second, "]}}}"
    )
    return events.select(
        F.col("event_type").alias("brand"),
        F.col("event_id").alias("page"),
        value.alias("value"),
    )
