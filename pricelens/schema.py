"""Row shapes shared by all jobs, and the source dimension."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import types as T

OFFER = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("cash_price", T.DoubleType()),
        T.StructField("installment_price", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)

LISTING = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)

CATALOG_PAGE = (
    "data struct<products: struct<last_page: int, data: array<struct<"
    "name: string, price: string, cash_price: string, installment_price: string, "
    "attributes: array<struct<attribute_id: int, attribute_value: string>>>>>>"
)

ATTRIBUTES = (
    "map<string, struct<code: string, options: array<struct<"
    "id: string, label: string, products: array<string>>>>>"
)
OPTION_PRICES = (
    "map<string, struct<finalPrice: struct<amount: double>, creditPrice: struct<amount: double>>>"
)


@dataclass(frozen=True)
class Source:
    """One shop: its id in the data, its label in reports, its place in load and report order."""

    id: str
    label: str


# The first source is the anchor every other one is compared with. Pass your own tuple to
# any operator to compare other shops or to print other labels.
DEFAULT_SOURCES: tuple[Source, ...] = (
    Source("anchor", "Anchor"),
    Source("shop_b", "Shop B"),
    Source("shop_c", "Shop C"),
    Source("shop_d", "Shop D"),
    Source("shop_e", "Shop E"),
)


def source_ids(sources: Sequence[Source]) -> list[str]:
    return [s.id for s in sources]
