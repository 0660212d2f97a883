"""The given test tables, and the offers and price feed that stand in for shop data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.offers import with_ord
from ..schema import DEFAULT_SOURCES, Source

# Columns that order the rows of lineitem totally.
LINE_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a stand-in table that one task takes, about.
ROWS = 250_000


def parts_of(df: DataFrame) -> int:
    """Number of tasks for a given table: one for ROWS rows, and no fewer than run at once.

    Parquet files state how many rows they have, so counting reads none.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """A stand-in table dealt over as many tasks as its rows ask for, as shop data comes in many files.

    The given tables are single files; the same plan is used at every size.
    """
    return df.repartition(parts_of(df), *keys)


def choose(index: Column, values: Sequence[str]) -> Column:
    """The value at a position computed from the row, from a fixed list of texts."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def offer_title() -> Column:
    """A shop title from the columns of lineitem and part."""
    part, order, line = F.col("p_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    family = (
        F.when(part % 2 != 0, "Samsung Galaxy S")
        .when(order % 2 == 0, "Apple iPhone ")
        .otherwise("iPhone ")
    )
    tier = (
        F.when(part % 3 == 0, " Pro")
        .when((part % 3 == 1) & (order % 3 == 0), " Pro+")
        .when(part % 3 == 1, " Pro Plus")
        .otherwise("")
    )
    ram = F.when((line % 2 == 0) | (part % 2 != 0), "8GB/").otherwise("")
    storage = choose(F.col("p_size") % 3, ["128", "256", "512"])
    unit = F.when(order % 5 == 0, " ГБ").when(order % 5 == 1, " GB").otherwise("GB")
    sim = choose(
        order % 7,
        [" (eSim)", " (Nano-Sim)", " Dual eSIM", " (Nano-SIM & eSIM)", "", "", ""],
    )
    color = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"))
    number = (part % 7 + 11).cast("string")
    title = F.concat(family, number, tier, F.lit(" "), ram, storage, unit, sim, F.lit(" "), color)
    return F.coalesce(title, F.lit(""))


def offers(
    spark: SparkSession, sf_dir: str, sources: Sequence[Source] = DEFAULT_SOURCES
) -> DataFrame:
    """Offers from lineitem and part: ``source, name, cash_price, installment_price, ord``."""
    lines = dealt(table(spark, sf_dir, "lineitem").select(*LINE_ORDER), *LINE_ORDER[:2])
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    installment = F.round(F.col("l_extendedprice") * (1 + F.col("l_tax")))
    named = rows.select(
        choose(F.col("l_suppkey") % 5, [s.id for s in sources]).alias("source"),
        offer_title().alias("name"),
        F.when(F.col("l_quantity") != 13, F.col("l_extendedprice")).alias("cash_price"),
        F.when(F.col("l_discount") != 0, installment).alias("installment_price"),
        *LINE_ORDER,
    )
    return with_ord(named, LINE_ORDER, sources).drop(*LINE_ORDER)


EVENT_SOURCES = ["view", "click", "error", "purchase", "signup"]


def price_feed(
    spark: SparkSession, sf_dir: str, sources: Sequence[Source] = DEFAULT_SOURCES
) -> DataFrame:
    return feed_from_events(table(spark, sf_dir, "events"), sources)


def _event_source(sources: Sequence[Source]) -> Column:
    source = F.when(F.col("event_type") == EVENT_SOURCES[0], sources[0].id)
    for event, s in zip(EVENT_SOURCES[1:], sources[1:], strict=True):
        source = source.when(F.col("event_type") == event, s.id)
    return source


def feed_from_events(
    events: DataFrame, sources: Sequence[Source] = DEFAULT_SOURCES
) -> DataFrame:
    """``ts, source, product_key, cash_price, installment_price, ord`` from an events table."""
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        _event_source(sources).alias("source"),
        F.concat(F.lit("product "), (F.col("user_id") % 20).cast("string")).alias("product_key"),
        F.col("value").alias("cash_price"),
        F.lit(None).cast("double").alias("installment_price"),
        F.col("event_id").alias("ord"),
    )


def title_feed_from_events(
    events: DataFrame, sources: Sequence[Source] = DEFAULT_SOURCES
) -> DataFrame:
    """``ts, source, name, cash_price, installment_price, ord``: the price feed as raw shop titles.

    A product has several spellings, and two products of one display name.
    """
    number = (F.col("user_id") % 20).cast("string")
    name = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Apple iPhone "), number, F.lit(" 128 ГБ")))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("iPhone "), number, F.lit(" 128GB (Nano-SIM)")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit("iphone "), number, F.lit(" 128gb Black")))
        .otherwise(F.concat(F.lit("iPhone "), number, F.lit(" 128GB eSIM")))
    )
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        _event_source(sources).alias("source"),
        name.alias("name"),
        F.col("value").alias("cash_price"),
        F.when(F.col("event_id") % 5 == 0, F.col("value") + 3).alias("installment_price"),
        F.col("event_id").cast("bigint").alias("ord"),
    )
