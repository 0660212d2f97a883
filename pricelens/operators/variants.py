"""Variants of a product: options matched with each other and with their prices.

Two forms of the same rules. The relational form works on long option tables; the nested
form works on the option lists of one page inside its row, where no shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import (
    attr_by_code,
    option_sim,
    storage_label,
    title_ram_storage,
    title_storage,
    title_storage_sim,
)
from ..functions.text import drop_spaces, truthy
from ..functions.titles import is_apple

# ---- relational form -------------------------------------------------------------------


def variant_prices(variants: DataFrame, option_prices: DataFrame) -> DataFrame:
    """Attach prices by product id; a variant without id or cash price is dropped."""
    known = variants.where(F.col("product_id").isNotNull())
    priced = known.join(option_prices, "product_id")
    return priced.where(truthy(F.col("cash_price")))


def drop_disabled(products: DataFrame, disabled: DataFrame) -> DataFrame:
    return products.join(disabled, ["page", "product_id"], "left_anti")


def option_pairs(
    storage: DataFrame, ram: DataFrame, disabled: DataFrame | None = None
) -> DataFrame:
    """First storage product of every storage and RAM option pair that share one.

    Inputs are ``page, option, product_id, pos``. Matching on page and product id instead
    of pairing options keeps the output to pairs that exist.
    """
    if disabled is not None:
        storage = drop_disabled(storage, disabled)
    left = storage.groupBy("page", "product_id", F.col("option").alias("storage")).agg(
        F.min("pos").alias("pos")
    )
    right = ram.select("page", "product_id", F.col("option").alias("ram")).distinct()
    return (
        left.join(right, ["page", "product_id"])
        .groupBy("page", "storage", "ram")
        .agg(F.min_by("product_id", "pos").alias("product_id"))
    )


def first_options(options: DataFrame) -> DataFrame:
    """Product rows of the first option per page and label.

    ``options`` has ``page, option, label, option_pos, product_id, pos``. An option that
    comes after another one with the same label never counts, whether or not the earlier
    one leads to a product.
    """
    firsts = options.groupBy("page", "label").agg(
        F.min_by("option", "option_pos").alias("option")
    )
    return options.join(firsts, ["page", "label", "option"], "left_semi")


def sim_storage_pairs(sim_options: DataFrame, storage_options: DataFrame) -> DataFrame:
    """``page, storage, sim, product_id`` of the first option pair per pair of labels.

    The pair that comes first for two labels consists of the first option of each label, so
    the pairs themselves are never built.
    """
    sims = first_options(sim_options).drop("option").withColumnRenamed("label", "option")
    storages = first_options(storage_options).drop("option").withColumnRenamed("label", "option")
    return option_pairs(storages, sims).withColumnRenamed("ram", "sim")


def variants_or_simple(variants: DataFrame, simple: DataFrame, key: str = "page") -> DataFrame:
    """Variants where a page has any, its simple offer otherwise.

    Both sides meet once on the page, so neither is computed twice or written down; a page has
    as many rows there as it has options.
    """
    both = variants.withColumn("_rank", F.lit(0)).unionByName(simple.withColumn("_rank", F.lit(1)))
    best = F.min("_rank").over(Window.partitionBy(key))
    kept = both.withColumn("_best", best).where(F.col("_rank") == F.col("_best"))
    return kept.drop("_rank", "_best")


def variant_counts(variants: DataFrame, key: str = "page") -> DataFrame:
    """How many variants each page has."""
    return variants.groupBy(key).agg(F.count(F.lit(1)).alias("variants"))


# ---- nested form -----------------------------------------------------------------------


def _first_shared(a: Column, b: Column, disabled: Column) -> Column:
    shared = F.filter(
        a, lambda p: F.array_contains(b, p) & ~F.array_contains(disabled, p)
    )
    return F.get(shared, F.lit(0))


def _priced(product_id: Column, prices: Column, title: Column) -> Column:
    price = F.try_element_at(prices, F.coalesce(product_id, F.lit("")))
    return F.struct(
        title.alias("name"),
        price["finalPrice"]["amount"].alias("cash_price"),
        price["creditPrice"]["amount"].alias("installment_price"),
    )


def _sold(variants: Column) -> Column:
    kept = F.filter(variants, lambda v: truthy(v["cash_price"]))
    empty = F.array().cast(
        "array<struct<name:string,cash_price:double,installment_price:double>>"
    )
    return F.coalesce(kept, empty)


def ram_variants(
    name: Column, attributes: Column, prices: Column, disabled: Column
) -> Column:
    """Offers of a page whose options are storage and, if present, RAM."""
    storage, ram = attr_by_code(attributes, ["memory"]), attr_by_code(attributes, ["gb_ram"])

    def pairs(s: Column, r: Column) -> Column:
        return _priced(
            _first_shared(s["products"], r["products"], disabled),
            prices,
            title_ram_storage(name, drop_spaces(r["label"]), drop_spaces(s["label"])),
        )

    with_ram = F.flatten(
        F.transform(
            storage["options"],
            lambda s: F.transform(ram["options"], lambda r: pairs(s, r)),
        )
    )
    enabled = F.transform(
        storage["options"],
        lambda s: _priced(
            F.get(F.filter(s["products"], lambda p: ~F.array_contains(disabled, p)), F.lit(0)),
            prices,
            title_storage(name, drop_spaces(s["label"])),
        ),
    )
    return _sold(F.when(ram.isNotNull(), with_ram).otherwise(enabled))


def _with_labels(options: Column, label) -> Column:
    return F.transform(
        options,
        lambda o: F.struct(label(o["label"]).alias("label"), o["products"].alias("products")),
    )


def _first_of_label(options: Column) -> Column:
    labels = F.transform(options, lambda o: o["label"])
    return F.filter(options, lambda o, i: F.array_position(labels, o["label"]) == i + 1)


def sim_variants(name: Column, attributes: Column, prices: Column) -> Column:
    """Offers of a page whose options are storage and SIM (Apple) or storage and RAM."""
    none = F.array().cast("array<string>")
    storage = _with_labels(attr_by_code(attributes, ["drive"])["options"], storage_label)
    sim = attr_by_code(attributes, ["sim_card", "sim", "sim_type"])
    ram = attr_by_code(attributes, ["ram"])
    sims = _first_of_label(_with_labels(sim["options"], option_sim))
    rams = _with_labels(ram["options"], storage_label)

    with_sim = F.flatten(
        F.transform(
            sims,
            lambda m: F.transform(
                _first_of_label(storage),
                lambda s: _priced(
                    _first_shared(s["products"], m["products"], none),
                    prices,
                    title_storage_sim(name, s["label"], m["label"]),
                ),
            ),
        )
    )
    with_ram = F.flatten(
        F.transform(
            storage,
            lambda s: F.transform(
                rams,
                lambda r: _priced(
                    _first_shared(s["products"], r["products"], none),
                    prices,
                    title_ram_storage(name, r["label"], s["label"]),
                ),
            ),
        )
    )
    plain = F.transform(
        storage,
        lambda s: _priced(
            F.get(s["products"], F.lit(0)), prices, title_storage(name, s["label"])
        ),
    )
    apple = is_apple(name)
    return _sold(
        F.when(apple & sim.isNotNull(), with_sim)
        .when(~apple & ram.isNotNull(), with_ram)
        .otherwise(plain)
    )


