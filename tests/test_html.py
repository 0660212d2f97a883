"""Reading pages: tags, extents, cards, details and embedded variant tables."""

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricelens.functions.labels import attr_by_code
from pricelens.schema import ATTRIBUTES
from pricelens.sources import detail, html, listing


def pages(spark, *texts):
    return spark.createDataFrame(
        [(i, f"u{i}", t) for i, t in enumerate(texts)], "page_id bigint, url string, html string"
    )


@pytest.fixture(scope="module")
def on_pages(spark):
    """Evaluate a function of the page column on html texts."""

    def run(fn, texts):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, html string")
        rows = html.with_page(df).select("i", fn(F.col("page")).alias("r")).collect()
        return [r.r for r in sorted(rows, key=lambda r: r.i)]

    return run


def tag(name, *classes, attr=None):
    """The opening of the first element that matches, as its tag and attributes."""

    def find(page):
        found = html.first(page["elements"], name, *classes, attr=attr)
        return F.when(found.isNotNull(), F.struct(found["tag"], found["attrs"]))

    return find


def test_entities(on_pages):
    texts = ["a&amp;b", "&#x2B;&#43; &lt;", "&#8212;", "plain", "&#;x&amp;#43;", "R&amp;amp;D"]
    assert on_pages(lambda p: p["text"], texts) == ["a&b", "++ <", "—", "plain", "&#;x&#43;", "R&amp;D"]


def test_element_ends_at_own_closing_tag(on_pages):
    texts = ["<div>a<div>b</div>c</div>d</div>", "<div>open", "<div><divx></divx>e</div>f"]

    assert on_pages(lambda p: html.text_of(p, html.first(p["elements"], "div")), texts) == ["abc", "open", "e"]


def test_elements_and_what_is_inside():
    read, found = html.read('x<ul class=" a  B "><li>1<li>2</ul><p><b></p>y</b><img src=i><a href=1>p<a href=2>q</a>')
    names = [e[0] for e in found]
    assert (read, names) == ("x12ypq", ["ul", "li", "li", "p", "b", "img", "a", "a"])
    assert found[0][1] == ["a", "B"] and found[5][2] == {"src": "i"}
    spans = {(e[0], e[3]): (e[4], e[5], e[6], e[7]) for e in found}
    assert spans["ul", 0] == (3, 1, 3, True)
    assert spans["li", 1] == (8, 1, 6, False)  # never closed
    assert spans["p", 3] == (5, 3, 3, True) and spans["b", 4] == (5, 3, 4, True)
    assert spans["a", 6] == (7, 4, 5, True) and spans["a", 7] == (8, 5, 6, True)


def test_hostile_pages_take_linear_time(on_pages):
    bare = "<div data-x=" + "a" * 100_000 + " class=c>ok</div>"
    many = "<div class='d'>" + "<p class=q><b>x</b></p>" * 20_000 + "</div>"
    unclosed = ["<a b" * 50_000, "<a b='" * 50_001, "<!--" * 50_000, "<script>" * 20_000, "<" * 100_000, "</" * 50_000]
    quotes = "<a title=\"x>" * 20_001
    start = time.perf_counter()
    assert html.read(bare)[1][0][1] == ["c"]
    read, found = html.read(many)
    assert (len(read), len(found), found[0][4]) == (20_000, 40_001, 40_001)
    for page in [*unclosed, quotes]:
        html.read(page)
    nested = "<div class=e>" * 20_000
    assert len(html.read(nested)[1]) == 20_000
    assert time.perf_counter() - start < 10

    assert on_pages(lambda p: F.size(html.inside(p, html.first(p["elements"], None, "d"))), [many, bare, None]) == [40_000, 0, 0]


def test_class_and_attribute_names_match_whole(on_pages):
    texts = ['<a class="card">', '<a class="x card y">', '<a class="cards">', '<a class="my-card">',
             '<a data-class="card">', "<a class='card'>", '<abbr class="card">']
    found = on_pages(tag("a", "card"), texts)
    assert [f is not None for f in found] == [True, True, False, False, False, True, False]
    [found] = on_pages(tag("a"), ['<A data-price="1" PRICE="2" price=3>'])
    assert found.attrs == {"data-price": "1", "price": "2"}


def test_page_count(spark):
    df = pages(
        spark,
        '<a href="?page=2">2</a><a href="/x?page=12&amp;s=1">12</a>',
        "<p>none</p>",
        '<a href="/c?cat=4&amp;p=7">7</a><a href="/shop=3">x</a>',
    )
    by = {r.page_id: r.page_count for r in listing.listing_page_count(df).collect()}
    assert by == {0: 12, 1: 1, 2: 1}
    by = {r.page_id: r.page_count for r in listing.listing_page_count(df, "p").collect()}
    assert by == {0: 1, 1: 1, 2: 7}


def test_next_page(on_pages):
    texts = ['<a class="action next" href="#">', '<a class="action next inactive">', "<a>"]
    assert on_pages(listing.has_next_page, texts) == [True, False, False]


def test_heading_cards(spark):
    card = (
        '<div class="listitem"><a class="prod-item-img" href="https://s/1"></a>'
        '<div class="item-body"><h3>One</h3><div class="price"><p class="regular">'
        '<span>9</span> 1,000 դր</p></div><a href="https://s/cart"></a></div></div>'
    )
    loose = (
        '<div class="item-body"><h3>Two</h3><a href="https://s/2">x</a>'
        '<div class="price"><p class="regular">2,000 դր</p></div></div>'
    )
    sold = card.replace("One", "Sold").replace("<h3>", "<b>Առկա չէ</b><h3>")
    free = card.replace("1,000 դր", "0 դր")
    df = pages(spark, card + loose, sold + free + card, "<footer>Առկա չէ</footer>")
    rows = listing.extract_cards(df, listing.CARD_HEADING).orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.name, r.url, r.cash_price) for r in rows] == [
        (0, "One", "https://s/1", 1000.0), (0, "Two", "https://s/2", 2000.0),
        (1, "One", "https://s/1", 1000.0),
    ]


def test_closest_div_cards(spark):
    df = pages(
        spark,
        '<div><a href="/store/product/0">far</a><div><h3>A</h3></div>'
        '<div><p><a href="/store/product/1">b</a></p><h3> B </h3></div></div>',
        '<div><h3>C</h3><a href="/other">x</a><a href="/store/product/3">c</a></div>',
    )
    rows = listing.extract_headings(df, "https://s").orderBy("page_id", "pos").collect()
    assert [(r.name, r.url) for r in rows] == [
        ("B", "https://s/store/product/1"), ("C", "https://s/store/product/3"),
    ]


def test_detail_page(spark):
    df = pages(
        spark,
        '<h1> Phone <b>X</b></h1><div class="price"><div class="regular">5,500 <span>դր</span>դր'
        '</div></div><p class="credit_calc_link"><a data-price="60x">c</a></p>'
        '<a href="https://s/product/2">256GB</a><a href="https://s/product/2"> 256GB </a>'
        '<a href="https://s/product/3">Red</a><a href="https://s/other">1TB</a>',
        "<p>empty</p>",
    )
    rows = detail.extract_detail(df).orderBy("page_id").collect()
    assert [(r.name, r.cash_price, r.installment_price) for r in rows] == [
        ("Phone X", 5500.0, 60.0), (None, None, None),
    ]
    links = detail.variant_links(df, "s/product").collect()
    assert [(r.page_id, r.link) for r in links] == [(0, "https://s/product/2")]


CONFIG = (
    '{"attributes":{"20":{"code":"memory","options":[{"id":"1","label":"a {b}","products":["7",8]}]}},'
    '"x":1,"optionPrices":{"7":{"finalPrice":{"amount":5}}},"priceFormat":{}}'
)


def test_variant_config(spark):
    df = pages(
        spark, CONFIG, CONFIG.replace("priceFormat", "pf"), CONFIG.replace('{"amount":5}', "5}"),
        CONFIG.replace('"attributes":{', '"attributes":['),
        CONFIG.replace(',"priceFormat"', ',"y":{},"priceFormat"'),
        CONFIG.replace("a {b}", "a }b"), CONFIG.replace("a {b}", "a {b"),
    )
    rows = detail.extract_variant_config(df).orderBy("page_id").collect()
    # Braces in labels count like any other: unbalanced ones break the page.
    assert [r.ok for r in rows] == [True] + [False] * 6
    option = rows[0].attributes["20"].options[0]
    assert (option.label, option.products) == ("a {b}", ["7", "8"])
    assert rows[0].option_prices["7"].finalPrice.amount == 5.0
    assert rows[0].option_prices["7"].creditPrice is None


def test_attribute_lookup_counts_numbers_in_order(spark):
    text = (
        '{"b":{"code":"sim"},"100":{"code":"sim","options":[{"id":"hundred"}]},'
        '"20":{"code":"sim_card","options":[{"id":"twenty"}]}}'
    )
    df = spark.createDataFrame([(text,)], "t string")
    first = attr_by_code(F.from_json("t", ATTRIBUTES), ["sim", "sim_card"])["options"][0]["id"]
    assert df.select(first).first()[0] == "twenty"


def test_buttons_and_static_ram(spark):
    text = (
        '<button class="storage-btn" data-price="10" data-loanprice="0">128GB</button>'
        '<button class="storage-btn" disabled data-price="11">256GB</button>'
        '<button class="storage-btn" data-price="x">512GB</button>'
        '<button class="modifier-btn" data-color="red">Red</button>'
        '<button class="modifier-btn" data-price="3"> 8GB </button>'
        '<div class="flex items-center gap-4"><i class="text-[#8C8C8C]">RAM</i>'
        '<b class="font-semibold">6GB</b></div>'
    )
    df = spark.createDataFrame([("128GB", text)], "state string, html string")
    row = detail.extract_buttons(df).first()
    assert [(b.label, b.price, b.loan_price) for b in row.storage] == [("128GB", 10.0, None)]
    assert [(b.label, b.price) for b in row.modifiers] == [("8GB", 3.0)]
    assert (row.first_price, row.ram_spec) == (10.0, "6GB")


def test_characters_of_all_entities(on_pages):
    texts = ["&eacute;&euro;&ndash;", "&#00000039;", "&#9999999;", "&#xD800;&#0;", "&#99999999999999999999;",
             "&nosuch; & &amp", "&NotEqualTilde;", "&#x1F600;"]
    assert on_pages(lambda p: p["text"], texts) == [
        "é€–", "'", "�", "��", "�", "&nosuch; & &amp", "≂̸", "😀",
    ]


def test_disabled_is_an_attribute_not_a_class(on_pages):
    tags = ['<button class="storage-btn disabled active">', "<button disabled>", '<button class="a"disabled>',
            '<button title="disabled x" class=b>', "<button disabled=disabled>", "<button data-disabled>"]
    found = on_pages(lambda p: html.has_attribute(html.first(p["elements"]), "disabled"), tags)
    assert found == [False, True, True, False, True, False]


def test_quoted_ends_and_bare_values(on_pages):
    tags = ['<img alt="A > B" class="x">', "<a href=/x class=y>", "<a title='href=\"q\"' href=\"z\">", '<a data-href="1">']

    def value(name):
        return lambda p: html.attribute(html.first(p["elements"]), name)

    assert on_pages(value("alt"), tags[:1]) == ["A > B"]
    assert on_pages(value("href"), tags[1:]) == ["/x", "z", ""]
    found = on_pages(tag("a", "y"), [f"<b>{t}</b>" for t in tags])
    assert [f and f.attrs["href"] for f in found] == [None, "/x", None, None]
    assert on_pages(lambda p: p["text"], ['<b title="1>2">x</b> it\'s 3 < 4', "<!doctype html>y"]) == ["x it's 3 < 4", "y"]


def test_cards_of_any_tag(spark):
    spec = listing.CARD_IMAGE_ALT
    page = (
        '<!-- <li class="product-item-info"><img class="product-image-photo" alt="Old"><a class="product-item-photo" href="/o"></a></li> -->'
        "<li class=product-item-info><a class='product-item-photo' href=/x><img alt=\"A > B\" class=\"product-image-photo\"></a></li>"
        '<section class="product-item-info"><span class="product-image-photo" alt="C"></span><a class="product-item-photo" href="/y"></a></section>'
    )
    rows = listing.extract_cards(pages(spark, page), spec).orderBy("pos").collect()
    assert [(r.name, r.url) for r in rows] == [("A > B", "/x"), ("C", "/y")]


def test_price_must_be_inside_its_block(spark, on_pages):
    outside = '<div class="price"><b>1</b></div><p class="regular">5000 դր</p>'
    nested = '<div class="price"><div class="regular"><div>1,200 դր.</div> <span>old</span></div><i class="regular">9 դր</i></div>'
    assert on_pages(listing.regular_price, [outside, nested]) == [None, 1200.0]
    links = ['<p class="credit_calc_link">x</p><a data-price="77">', '<p class="credit_calc_link"><i><a data-price=\'88\'></a></i></p>']
    assert on_pages(detail.credit_price, links) == [None, 88.0]


def test_comments_and_scripts_are_not_content(spark):
    page = "<!-- <h1>old</h1> --><script>var a = '<h1>js</h1>';</script><h1>new</h1>"
    assert detail.extract_detail(pages(spark, page)).first().name == "new"


def test_ram_spec_in_any_element(on_pages):
    item = '<{0} class="flex items-center gap-4"><p class="text-[#8C8C8C]">RAM</p><div><b class="font-semibold">8 GB</b></div></{0}>'
    label = detail.RAM_LABELS[0]
    texts = [item.replace("RAM", label).format(t) for t in ("div", "li", "tr")]
    assert on_pages(detail.static_ram, texts) == ["8 GB"] * 3


def test_listing_is_complete_where_next_ends(spark):
    following, last = '<a class="action next" href="#">', '<a class="action next inactive">'
    rows = [("a", 1, following), ("a", 2, following), ("a", 3, last), ("b", 1, following), ("b", 3, last),
            ("c", 1, '<a href="?page=4">'), ("d", 1, following), ("e", 1, None)]
    df = spark.createDataFrame(rows, "listing string, number int, html string")
    found = {r.listing: (r.pages_claimed, r.complete, r.missing) for r in listing.listing_coverage(df).collect()}
    assert found == {"a": (3, True, ""), "b": (3, False, "2-2"), "c": (4, False, "2-4"), "d": (2, False, "2-2"), "e": (1, True, "")}


def test_a_batch_of_pages_is_read_piece_by_piece(spark):
    text = "x" * (html.PIECE // 3)
    pages = ["", None, *(f"<p>{k}{text}</p>" for k in range(8)), "<p>" + text * 9 + "</p>", "", None, "<i>z</i>"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pages))), pa.array(pages)], names=["id", "html"])
    found = list(html._read_batches(iter([batch]), ["id"]))
    assert [i for b in found for i in b.column(0).to_pylist()] == list(range(len(pages)))
    sizes = [[len(pages[i] or "") for i in b.column(0).to_pylist()] for b in found]
    assert len(found) > 4
    assert all(sum(s) <= html.PIECE or sum(n > 0 for n in s) == 1 for s in sizes)
    texts = [p["text"] for b in found for p in b.column(1).to_pylist()]
    assert texts == [html.read(p or "")[0] for p in pages]
    assert list(html._read_batches(iter([batch.slice(0, 0)]), ["id"])) == []
    rows = spark.createDataFrame(list(enumerate(pages)), "id int, html string").coalesce(1)
    assert {r.id: r.n for r in html.with_page(rows).selectExpr("id", "size(page.elements) n").collect()} == {
        i: len(html.read(p or "")[1]) for i, p in enumerate(pages)}
