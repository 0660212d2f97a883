"""Prices: coercion of text to numbers, and the flags of the comparison.

Zero and missing are the same thing in the input, so coercions return null for both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import S, drop_spaces, truthy
from .vocabulary import ALERT_MARK, FLAT_LIMIT, OK_MARK, SHARE_LIMIT

_DECIMAL = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def _to_double(text: Column) -> Column:
    return F.nullif(text.try_cast("double"), F.lit(0.0))


def num_or_null(c: Column) -> Column:
    """Whole text as a number; text that is not a number, and zero, become null."""
    return _to_double(F.regexp_extract(c, rf"^{S}*({_DECIMAL}){S}*\z", 1))


def float_prefix(c: Column) -> Column:
    return _to_double(F.regexp_extract(c, rf"^{S}*({_DECIMAL})", 1))


def int_prefix(c: Column) -> Column:
    return _to_double(F.regexp_extract(c, rf"^{S}*([+-]?\d+)", 1))


def parse_price_text(c: Column) -> Column:
    """The amount before the currency word, thousands commas removed."""
    amount = F.regexp_extract(drop_spaces(c), r"([\d,]+)դր", 1)
    return _to_double(F.replace(amount, F.lit(","), F.lit("")))


def digits_price(c: Column) -> Column:
    return _to_double(F.regexp_replace(c, r"[^0-9]", ""))


def float_prefix_or_zero(c: Column) -> Column:
    return F.regexp_extract(c, rf"^{S}*({_DECIMAL})", 1).try_cast("double")


def round_price(c: Column) -> Column:
    return F.floor(c + F.lit(0.5)).cast("double")


def is_alert(
    anchor: Column, other: Column, flat: float = FLAT_LIMIT, share: float = SHARE_LIMIT
) -> Column:
    """Whether the anchor exceeds the other price by more than either limit."""
    diff = anchor - other
    too_dear = (diff > F.lit(flat)) | (diff > anchor * F.lit(share))
    return truthy(anchor) & truthy(other) & too_dear


def price_flag(
    anchor: Column, other: Column, flat: float = FLAT_LIMIT, share: float = SHARE_LIMIT
) -> Column:
    """The mark of a competitor's price, empty if one of the two is missing."""
    return (
        F.when(~(truthy(anchor) & truthy(other)), F.lit(""))
        .when(is_alert(anchor, other, flat, share), F.lit(ALERT_MARK))
        .otherwise(F.lit(OK_MARK))
    )


def installment_reference(anchor_cash: Column, anchor_installment: Column) -> Column:
    return F.coalesce(anchor_installment, anchor_cash)


def installment_flag(
    anchor_cash: Column,
    anchor_installment: Column,
    installment: Column,
    flat: float = FLAT_LIMIT,
    share: float = SHARE_LIMIT,
) -> Column:
    return price_flag(
        installment_reference(anchor_cash, anchor_installment), installment, flat, share
    )


def same_price(
    anchor_cash: Column, anchor_installment: Column, cash: Column, installment: Column
) -> Column:
    """Equal cash price (two missing ones are equal) and no differing installment price."""
    reference = installment_reference(anchor_cash, anchor_installment)
    return cash.eqNullSafe(anchor_cash) & (
        ~truthy(installment) | installment.eqNullSafe(reference)
    )
