"""First-wins deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: Sequence[str], ord: str = "ord") -> DataFrame:
    """The row with the smallest ``ord`` per key.

    An argmin aggregate keeps one row per key and task before the shuffle, so a key that
    holds a large share of the rows costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    firsts = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(ord)).alias("_first"))
    return firsts.select(*keys, "_first.*").select(*df.columns)


def dedup_by_url(listing: DataFrame, ord: str = "ord") -> DataFrame:
    return first_wins(listing, ["url"], ord)


def dedup_by_title(offers: DataFrame, ord: str = "ord") -> DataFrame:
    return first_wins(offers, ["source", "name"], ord)
