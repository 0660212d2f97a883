"""Title canonicalization: free text to one product key.

Each rule is a Column function, and ``normalize_title`` chains them in the order that the
results depend on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import EDGE_R, GAP, bind, plain_spaces, squeeze, trim_plain, whole_words, word_start
from .vocabulary import CONNECTIVITY, DISPLAY_COLORS, KEY_COLORS, KEY_PHRASES, SIM_TOKENS

# Private-use characters that bracket a parenthesis group while it is being rewritten.
_OPEN, _CLOSE = "\ue000", "\ue001"
_SIM_IN_GROUP = {
    "esim": r"e[ \t-]?sim",
    "nanosim": r"nano[ \t-]?sim",
    "dualsim": r"dual[ \t-]?sim",
}


def lower_trim(c: Column) -> Column:
    """Lower case, no spaces at the ends. All later rules start from here."""
    return trim_plain(plain_spaces(F.lower(c)))


def unit_gb(c: Column) -> Column:
    return F.regexp_replace(c, rf"(\d+){GAP}*гб", "$1gb")


def strip_brand(c: Column) -> Column:
    return F.regexp_replace(c, rf"^apple{GAP}+", "")


def plus_forms(c: Column) -> Column:
    c = F.regexp_replace(c, rf"({word_start('pro')}|note){GAP}*\+", "$1 plus")
    return F.regexp_replace(c, rf"\+(?={GAP}|\z)", " plus")


def paren_sim(c: Column) -> Column:
    """Replace each parenthesis group by the SIM tokens found in it, or by a space."""

    def rewrite(t: Column) -> Column:
        groups = F.regexp_replace(t, r"\(([^)]*)\)", f"{_OPEN}$1{_CLOSE}")
        for token, pattern in _SIM_IN_GROUP.items():
            has_token = f"{_OPEN}(?=[^{_CLOSE}]*{pattern})"
            groups = F.regexp_replace(groups, has_token, f" {token}{_OPEN}")
        groups = F.regexp_replace(groups, f"{_OPEN}[^{_CLOSE}]*{_CLOSE}", " ")
        return F.when(t.contains("("), groups).otherwise(t)

    return bind(c, rewrite)


def bare_sim(c: Column) -> Column:
    c = F.regexp_replace(c, rf"{word_start('e')}[ \t-]?sim{EDGE_R}", "esim")
    return F.regexp_replace(c, rf"{word_start('nano')}[ \t-]?sim{EDGE_R}", "nanosim")


def ram_storage(c: Column) -> Column:
    """Drop RAM from Apple titles, keep "RAM storage" for all others."""
    digits = rf"{word_start('[0-9]')}[0-9]*"
    join = rf"{GAP}*[/+]{GAP}*"

    def rewrite(t: Column) -> Column:
        apple = F.regexp_replace(t, rf"{digits}{GAP}*gb{join}([0-9]+{GAP}*gb){EDGE_R}", "$1")
        apple = F.regexp_replace(apple, rf"{digits}{join}([0-9]+{GAP}*gb){EDGE_R}", "$1")
        both = r"$1gb $2gb"
        other = F.regexp_replace(t, rf"({digits}){GAP}*gb{join}([0-9]+){GAP}*gb{EDGE_R}", both)
        other = F.regexp_replace(other, rf"({digits}){join}([0-9]+){GAP}*gb{EDGE_R}", both)
        return F.when(t.startswith("iphone") | t.startswith("apple"), apple).otherwise(other)

    return bind(c, rewrite)


def storage_spacing(c: Column) -> Column:
    return F.regexp_replace(c, rf"([0-9]+){GAP}*gb", "$1gb")


def strip_vocab(c: Column) -> Column:
    """Remove colour and connectivity words in one pass, longer phrases first."""
    words = KEY_PHRASES + CONNECTIVITY + [w for w in KEY_COLORS if w not in KEY_PHRASES]
    return F.regexp_replace(c, whole_words(words), "")


def drop_dual(c: Column) -> Column:
    return F.regexp_replace(c, rf"{word_start('dual')}{GAP}+(?=esim)", "")


def clean_punct(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t,\-_/\\&]+", " "))


def reorder_tokens(c: Column) -> Column:
    """Other words, then storage sizes, then SIM tokens; stable inside each class."""

    def order(tokens: Column) -> Column:
        def is_size(t: Column) -> Column:
            return t.endswith("b") & t.rlike(r"^\d+[gt]b\z")

        def is_sim(t: Column) -> Column:
            return t.isin(SIM_TOKENS)

        return F.concat_ws(
            " ",
            F.filter(tokens, lambda t: ~is_size(t) & ~is_sim(t)),
            F.filter(tokens, is_size),
            F.filter(tokens, is_sim),
        )

    return bind(F.split(c, " "), order)


def normalize_title(c: Column) -> Column:
    for rule in (
        lower_trim, unit_gb, strip_brand, plus_forms, paren_sim, bare_sim, ram_storage,
        storage_spacing, strip_vocab, drop_dual, clean_punct, reorder_tokens,
    ):
        c = rule(c)
    return c


def match_key(c: Column) -> Column:
    """A normalized title without the default (physical) SIM class."""
    return F.regexp_replace(c, rf" (?:nanosim|dual){EDGE_R}", "")


def base_key(c: Column) -> Column:
    """The key offers are grouped on.

    It equals the match key: storage words would be removed only from a key that has none.
    """
    return match_key(c)


def display_name(c: Column) -> Column:
    colors = "(?i)" + whole_words(DISPLAY_COLORS)
    return squeeze(F.regexp_replace(plain_spaces(c), colors, ""))


def is_apple(c: Column) -> Column:
    return F.lower(c).contains("iphone") | F.lower(c).startswith("apple")
