"""Comparison of every competitor with the anchor shop (the first of the sources)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prices import (
    installment_flag,
    installment_reference,
    is_alert,
    price_flag,
    same_price,
)
from ..functions.report import NO_BREAK_SPACE, alert_key, anchor_pair, competitor_pair
from ..functions.titles import display_name
from ..functions.vocabulary import ABSENT_TEXT, FLAT_LIMIT, SHARE_LIMIT
from ..schema import DEFAULT_SOURCES, Source
from .resolve import source_grid


def anchored(groups: DataFrame) -> DataFrame:
    """Products the anchor sells; the others have nothing to be compared with."""
    return groups.where(F.get("entries", F.lit(0)).isNotNull()).withColumn(
        "anchor", F.get("entries", F.lit(0))
    )


def anchor_join(best: DataFrame, anchor: DataFrame) -> DataFrame:
    """Join competitor offers to the anchor's offer of the same product.

    The relational form of :func:`compare_offers`, for offers that do not come out of
    ``product_groups``. Both sides hold at most one row per product and source.
    """
    side = anchor.select(
        "base_key",
        F.col("cash_price").alias("anchor_cash"),
        F.col("installment_price").alias("anchor_installment"),
    )
    return best.join(side, "base_key")


def with_flags(
    pairs: DataFrame, flat: float = FLAT_LIMIT, share: float = SHARE_LIMIT
) -> DataFrame:
    """Add flags to rows that hold an anchor price pair and a competitor price pair."""
    ac, ai = F.col("anchor_cash"), F.col("anchor_installment")
    c, i = F.col("cash_price"), F.col("installment_price")
    return pairs.withColumns(
        {
            "cash_flag": price_flag(ac, c, flat, share),
            "installment_flag": installment_flag(ac, ai, i, flat, share),
            "same": same_price(ac, ai, c, i),
            "alert": is_alert(ac, c, flat, share)
            | is_alert(installment_reference(ac, ai), i, flat, share),
        }
    )


def compare_offers(
    groups: DataFrame,
    sources: Sequence[Source] = DEFAULT_SOURCES,
    flat: float = FLAT_LIMIT,
    share: float = SHARE_LIMIT,
) -> DataFrame:
    """One row per product and competitor that sells it, with anchor prices and flags."""
    with_anchor = anchored(groups)
    pairs = with_anchor.select(
        "base_key",
        "product_key",
        F.col("anchor.cash_price").alias("anchor_cash"),
        F.col("anchor.installment_price").alias("anchor_installment"),
        F.posexplode("entries").alias("pos", "entry"),
    ).where((F.col("pos") > 0) & F.col("entry").isNotNull())
    ids = F.array(*[F.lit(s.id) for s in sources])
    rows = pairs.select(
        "base_key",
        "product_key",
        F.element_at(ids, F.col("pos") + 1).alias("source"),
        "anchor_cash",
        "anchor_installment",
        F.col("entry.cash_price").alias("cash_price"),
        F.col("entry.installment_price").alias("installment_price"),
    )
    return with_flags(rows, flat, share)


def product_alerts(pairs: DataFrame) -> DataFrame:
    """Whether any competitor of a product raises an alert, from compared pairs.

    Pairs that come from product groups lie together by base key already, so grouping on it
    as well needs no shuffle.
    """
    grouped = pairs.groupBy("base_key", "product_key")
    return grouped.agg(F.bool_or("alert").alias("has_alert")).drop("base_key")


def _entry(i: int, field: str) -> Column:
    return F.get("entries", F.lit(i))[field]


def build_messages(
    groups: DataFrame,
    sources: Sequence[Source] = DEFAULT_SOURCES,
    flat: float = FLAT_LIMIT,
    share: float = SHARE_LIMIT,
    group_sep: str = NO_BREAK_SPACE,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``base_key, product_key, first_ord, has_alert, alert_key, message`` per anchored product,
    behind the columns ``keep`` of the groups.

    ``alert_key`` comes from the title line alone, so who needs only keys formats no message.
    """
    ac, ai = F.col("anchor.cash_price"), F.col("anchor.installment_price")
    title = display_name(F.col("anchor.name"))
    anchor_line = F.concat(
        F.lit(f"{sources[0].label} - "), anchor_pair(ac, ai, group_sep)
    )
    title_line = F.concat(F.lit("*"), title, F.lit("*"))
    lines, alerts = [title_line, anchor_line], []
    for i, s in enumerate(sources[1:], start=1):
        cash, installment = _entry(i, "cash_price"), _entry(i, "installment_price")
        pair = competitor_pair(cash, installment, ac, ai, flat, share, group_sep)
        text = F.when(F.get("entries", F.lit(i)).isNull(), F.lit(ABSENT_TEXT)).otherwise(pair)
        lines.append(F.concat(F.lit(f"{s.label} - "), text))
        alerts.append(
            is_alert(ac, cash, flat, share)
            | is_alert(installment_reference(ac, ai), installment, flat, share)
        )
    return anchored(groups).select(
        *keep,
        "base_key",
        "product_key",
        "first_ord",
        F.coalesce(reduce(or_, alerts, F.lit(False)), F.lit(False)).alias("has_alert"),
        alert_key(title_line).alias("alert_key"),
        F.concat_ws("\n", *lines).alias("message"),
    )


def alerts_only(comparisons: DataFrame) -> DataFrame:
    return comparisons.where("has_alert")


def report_grid(
    groups: DataFrame, sources: Sequence[Source] = DEFAULT_SOURCES
) -> DataFrame:
    """The compared products' grid: a row for every source, absent ones included."""
    return source_grid(anchored(groups), sources)
