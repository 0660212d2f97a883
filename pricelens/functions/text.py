"""Regular-expression building blocks.

Titles come from web pages, so "space" means every Unicode space a browser knows, while
letters and digits at a word edge mean ASCII only. Java's own classes differ on both, so
the patterns are written out here once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
S = f"[{SPACES}]"
EDGE_L = r"(?<![A-Za-z0-9_])"
EDGE_R = r"(?![A-Za-z0-9_])"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    A Column that is mentioned twice is computed twice; binding it as a lambda variable
    keeps long regex chains linear in the number of rules.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(words: Iterable[str]) -> str:
    """One alternation over literal words, in the given order."""
    return "(?:" + "|".join(re.escape(w).replace(r"\ ", " ") for w in words) + ")"


def whole_words(words: Iterable[str]) -> str:
    return EDGE_L + any_of(words) + EDGE_R


def word_start(word: str) -> str:
    """``word`` at the start of an ASCII word; the text is matched before the edge is."""
    return f"{word}(?<![A-Za-z0-9_]{word})"


# Two spaces are left after ``plain_spaces``: the blank, and a tab for all the others.
GAP = r"[ \t]"


def plain_spaces(c: Column) -> Column:
    """Every space but the blank as a tab.

    Words of a phrase must be parted by a blank, all other rules take any space. Two
    characters are enough to tell, and much faster to match than the full class.
    """
    return F.regexp_replace(c, f"[{SPACES.replace(' ', '')}]", "\t")


def trim_plain(c: Column) -> Column:
    return F.trim(c, F.lit(" \t"))


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{S}+|{S}+\z", "")


def squeeze(c: Column) -> Column:
    """Runs of plain spaces as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{GAP}+", " "))


def drop_spaces(c: Column) -> Column:
    return F.regexp_replace(c, rf"{S}+", "")


def truthy(c: Column) -> Column:
    """A number other than zero; null and NaN are not."""
    return F.coalesce((c != 0) & ~F.isnan(c), F.lit(False))


def non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))
