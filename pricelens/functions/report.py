"""Texts of the report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .prices import installment_flag, price_flag, same_price
from .text import S, trim_all, truthy
from .vocabulary import FLAT_LIMIT, NO_PRICE, SAME_TEXT, SHARE_LIMIT

NO_BREAK_SPACE = "\u00a0"


def format_price(c: Column, group_sep: str = NO_BREAK_SPACE) -> Column:
    """At most three decimals after a point, thousands grouped; a dash for zero or null."""
    text = F.translate(
        F.call_function("format_number", F.round(c, 3), F.lit("#,##0.###")), ",", group_sep
    )
    return F.when(truthy(c), text).otherwise(F.lit(NO_PRICE))


def anchor_pair(cash: Column, installment: Column, group_sep: str = NO_BREAK_SPACE) -> Column:
    second = F.when(truthy(installment), format_price(installment, group_sep))
    return F.concat_ws(" - ", format_price(cash, group_sep), second)


def competitor_pair(
    cash: Column,
    installment: Column,
    anchor_cash: Column,
    anchor_installment: Column,
    flat: float = FLAT_LIMIT,
    share: float = SHARE_LIMIT,
    group_sep: str = NO_BREAK_SPACE,
) -> Column:
    first = F.when(
        truthy(cash),
        F.concat(price_flag(anchor_cash, cash, flat, share), format_price(cash, group_sep)),
    ).otherwise(F.lit(NO_PRICE))
    second = F.when(
        truthy(installment),
        F.concat(
            installment_flag(anchor_cash, anchor_installment, installment, flat, share),
            format_price(installment, group_sep),
        ),
    )
    same = same_price(anchor_cash, anchor_installment, cash, installment)
    return F.when(same, F.lit(SAME_TEXT)).otherwise(F.concat_ws(" - ", first, second))


def format_pair(
    cash: Column,
    installment: Column,
    anchor_cash: Column,
    anchor_installment: Column,
    is_anchor: Column,
    flat: float = FLAT_LIMIT,
    share: float = SHARE_LIMIT,
    group_sep: str = NO_BREAK_SPACE,
) -> Column:
    return F.when(is_anchor, anchor_pair(cash, installment, group_sep)).otherwise(
        competitor_pair(
            cash, installment, anchor_cash, anchor_installment, flat, share, group_sep
        )
    )


def alert_key(message: Column) -> Column:
    """What identifies an alert from run to run: its first line without the number."""
    unnumbered = F.regexp_replace(message, rf"^\d+\.{S}*", "")
    return trim_all(F.substring_index(unnumbered, "\n", 1))
