"""Paged JSON catalogs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import catalog_sim_suffix, catalog_title
from ..functions.prices import num_or_null
from ..operators.offers import position
from ..schema import CATALOG_PAGE

SIM_ATTRIBUTE = 19  # fixed value: the catalog attribute that describes the SIM slots


def read_catalog_pages(
    spark: SparkSession, *paths: str, multi_line: bool = True, skip_unreadable: bool = False
) -> DataFrame:
    """``brand, page, data, damaged`` from JSON files laid out as ``brand=<b>/page=<n>/…``.

    Either may also be a field of the page itself; with ``multi_line=False`` a file holds
    one page per line. ``damaged`` is the text of a page that is no JSON, which is kept as a row.
    Files that cannot be read at all are an error, unless ``skip_unreadable`` is set.
    """
    schema = f"{CATALOG_PAGE}, brand string, page bigint, damaged string"
    pages = (
        spark.read.schema(schema)
        .option("multiLine", str(multi_line).lower())
        .option("columnNameOfCorruptRecord", "damaged")
        .option("ignoreCorruptFiles", str(skip_unreadable).lower())
        .json(list(paths))
    )
    # A damaged page still says where it belongs, in its path or at the start of its text.
    brand = F.regexp_extract("damaged", r'"brand"\s*:\s*"([^"]*)"', 1)
    page = F.regexp_extract("damaged", r'"page"\s*:\s*(\d+)', 1).try_cast("bigint")
    lost = F.col("data").isNull()
    return pages.withColumns(
        {
            "brand": F.when(lost, F.coalesce("brand", F.nullif(brand, F.lit("")))).otherwise(F.col("brand")),
            "page": F.when(lost, F.coalesce("page", page)).otherwise(F.col("page")),
        }
    )


def rejected_pages(pages: DataFrame) -> DataFrame:
    """``brand, page, reason`` of the pages that hold no list of products."""
    damaged = F.col("damaged").isNotNull() if "damaged" in pages.columns else F.lit(False)
    reason = F.when(damaged, "not json").when(
        F.col("data.products.data").isNull(), "no products"
    )
    return pages.select("brand", "page", reason.alias("reason")).where("reason is not null")


def flatten_catalog(pages: DataFrame) -> DataFrame:
    """One row per product, positioned by brand, page and place on the page.

    A brand with a rejected page is left out as a whole: half a brand would look like products
    that are no longer sold. :func:`rejected_pages` says which brands and why.
    """
    rejected = rejected_pages(pages).select("brand").distinct()
    whole = pages.join(rejected, "brand", "left_anti")
    products = whole.select("brand", "page", F.posexplode("data.products.data"))
    return products.select("brand", "page", "pos", "col.*")


def read_catalog(spark: SparkSession, *paths: str, multi_line: bool = True) -> DataFrame:
    return flatten_catalog(read_catalog_pages(spark, *paths, multi_line=multi_line))


def page_coverage(pages: DataFrame, listing: str = "brand") -> DataFrame:
    """The pages 1 to the last one that a listing claims to have, against those held.

    ``missing`` names the gaps as ranges like ``3-3,7-12``; pages beyond the claimed last one
    do not count.
    """
    seen = pages.groupBy(listing).agg(
        F.max("last_page").cast("bigint").alias("pages_claimed"),
        F.sort_array(F.collect_set(F.col("page").cast("bigint"))).alias("seen"),
    )
    held = F.filter("seen", lambda p: p.between(F.lit(1), F.col("pages_claimed")))
    edges = F.concat(
        F.array(F.lit(0).cast("bigint")), F.col("held"), F.array(F.col("pages_claimed") + 1)
    )
    steps = F.transform(
        "edges", lambda e, i: F.struct(e.alias("a"), F.get(F.col("edges"), i + 1).alias("b"))
    )
    gaps = F.transform(
        F.filter(steps, lambda s: s["b"] - s["a"] > 1),
        lambda s: F.concat_ws("-", (s["a"] + 1).cast("string"), (s["b"] - 1).cast("string")),
    )
    counted = seen.withColumn("held", held).withColumn("edges", edges)
    return counted.select(
        listing,
        "pages_claimed",
        F.size("held").cast("bigint").alias("pages_held"),
        (F.size("held") >= F.col("pages_claimed")).alias("complete"),
        F.array_join(gaps, ",").alias("missing"),
    )


def catalog_offers(
    products: DataFrame, source: str, brands: Sequence[str]
) -> DataFrame:
    """Offers from catalog rows: SIM class added to the title, prices coerced.

    ``brands`` is the order in which brands are loaded.
    """
    brand = F.array_position(F.array(*[F.lit(b) for b in brands]), F.col("brand"))
    of_sim = F.filter("attributes", lambda a: a["attribute_id"] == SIM_ATTRIBUTE)
    suffix = catalog_sim_suffix(F.get(of_sim, F.lit(0))["attribute_value"])
    return products.select(
        catalog_title(F.col("name"), suffix).alias("name"),
        num_or_null(F.col("price")).alias("price"),
        num_or_null(F.col("cash_price")).alias("cash_price"),
        num_or_null(F.col("installment_price")).alias("installment_price"),
        F.lit(source).alias("source"),
        position(brand, "page", "pos").alias("ord"),
    )
