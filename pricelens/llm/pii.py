"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and
identifier cues. From each anchor a local parser walks to the borders of an email, IP
address, card, phone, web address or account and validates it. A parser reads only what
belongs to its own span, so a text costs one pass plus the length of its spans.

Base kinds are the leftmost non-overlapping matches of fixed patterns; matches that fail their
check are dropped without a second try. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import over_batches

Span = tuple[int, int]
Parser = Callable[[str, int, int, int], tuple[int, int, bool] | None]

BASE = ("email", "ip", "card", "phone")
EXTRA = ("url", "account")
KINDS = BASE + EXTRA

_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | {"-"}
_PHONE = _DIGITS | frozenset(" ().-")
_NUMBER_GAP = frozenset(" -")
_CUE_GAP = frozenset(" \t:=#\"'")
_ACCOUNT = _ALNUM | frozenset("_-")
_URL_END = frozenset("<>\"'`{}|\\^")

# Fixed words that announce an address or an identifier.
SCHEMES = ("http://", "https://", "ftp://")
CUES = (
    "account", "acct", "api_key", "apikey", "iban", "login", "passport", "password", "secret",
    "ssn", "token", "user", "userid", "username",
)


def _run(text: str, at: int, allowed: frozenset[str]) -> int:
    """Where the run of allowed characters that begins at ``at`` ends."""
    end = len(text)
    while at < end and text[at] in allowed:
        at += 1
    return at


def email(text: str, anchor: int, end: int, floor: int):
    """From an at-sign: the local part to the left, labels and dots to the right."""
    start = anchor
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    stop = _run(text, anchor + 1, _LABEL)
    if start == anchor or stop == anchor + 1:
        return None
    dots = 0
    while stop < len(text) and text[stop] == ".":
        more = _run(text, stop + 1, _LABEL)
        if more == stop + 1:
            break
        stop, dots = more, dots + 1
    return (start, stop, True) if dots else None


def ip(text: str, anchor: int, end: int, floor: int):
    """From a digit: four runs of digits parted by dots, none over 255."""
    stop, parts = _run(text, anchor, _DIGITS), []
    begin = anchor
    while True:
        parts.append(text[begin:stop].lstrip("0"))
        if len(parts) == 4:
            break
        if stop >= len(text) or text[stop] != ".":
            return None
        begin, stop = stop + 1, _run(text, stop + 1, _DIGITS)
        if begin == stop:
            return None
    return anchor, stop, all(len(p) < 4 and int(p or 0) < 256 for p in parts)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        value = int(c) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def card(text: str, anchor: int, end: int, floor: int):
    """From a digit: digits with at most one blank or hyphen between two of them."""
    stop, size = anchor + 1, len(text)
    while stop < size:
        if text[stop] in _DIGITS:
            stop += 1
        elif text[stop] in _NUMBER_GAP and stop + 1 < size and text[stop + 1] in _DIGITS:
            stop += 2
        else:
            break
    if stop == anchor + 1:
        return None
    digits = [c for c in text[anchor:stop] if c in _DIGITS]
    return anchor, stop, 12 <= len(digits) <= 19 and luhn("".join(digits))


def phone(text: str, anchor: int, end: int, floor: int):
    """From a plus sign: a digit, then digits and marks up to the last digit."""
    if anchor + 1 >= len(text) or text[anchor + 1] not in _DIGITS:
        return None
    stop = _run(text, anchor + 2, _PHONE)
    while stop > anchor + 3 and text[stop - 1] not in _DIGITS:
        stop -= 1
    if stop <= anchor + 3 or text[stop - 1] not in _DIGITS:
        return None
    count = sum(c in _DIGITS for c in text[anchor:stop])
    return anchor, stop, 9 <= count <= 15


def url(text: str, anchor: int, end: int, floor: int):
    """From a scheme: up to a space or a mark that cannot stand in an address."""
    stop = end
    while stop < len(text) and not text[stop].isspace() and text[stop] not in _URL_END:
        stop += 1
    while stop > end and text[stop - 1] in ".,;:!?)]":
        stop -= 1
    return (anchor, stop, True) if stop > end else None


def account(text: str, anchor: int, end: int, floor: int):
    """From a cue: at most four separators, then an identifier of 6 to 64 characters, digits
    among them."""
    if anchor > 0 and text[anchor - 1] in _ACCOUNT:
        return None
    begin = end
    while begin < min(len(text), end + 4) and text[begin] in _CUE_GAP:
        begin += 1
    stop = _run(text, begin, _ACCOUNT)
    if begin == end or not 6 <= stop - begin <= 64 or _DIGITS.isdisjoint(text[begin:stop]):
        return None
    return begin, stop, True


PARSERS: dict[str, Parser] = {
    "email": email, "ip": ip, "card": card, "phone": phone, "url": url, "account": account,
}


def automaton() -> ahocorasick.Automaton:
    anchors: dict[str, tuple[str, ...]] = {"@": ("email",), "+": ("phone",)}
    anchors |= {d: ("ip", "card") for d in sorted(_DIGITS)}
    for kind, words in (("url", SCHEMES), ("account", CUES)):
        anchors |= dict.fromkeys(words, (kind,))
    found = ahocorasick.Automaton()
    for word, kinds in anchors.items():
        found.add_word(word, (len(word), kinds))
    found.make_automaton()
    return found


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _lowered(text: str) -> str:
    """``text`` in lower case, every character in its place."""
    lower = text.lower()
    return lower if len(lower) == len(text) else text.translate(_LOWER)  # one capital has two


def spans(text: str, anchors: ahocorasick.Automaton) -> dict[str, list[Span]]:
    """The valid spans of each kind, in order of their start."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    floor = dict.fromkeys(KINDS, 0)
    for last, (length, kinds) in anchors.iter(_lowered(text)):  # cues in any letter case
        start = last + 1 - length
        for kind in kinds:
            if start < floor[kind]:
                continue
            span = PARSERS[kind](text, start, last + 1, floor[kind])
            if span is None:
                if kind == "ip":  # the rest of this run of digits fails likewise
                    floor[kind] = _run(text, start, _DIGITS)
            else:
                floor[kind] = span[1]
                if span[2]:
                    found[kind].append(span[:2])
    return found


def joined(found: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then by kind in the given order, parted by commas."""
    rows = sorted((a, place, b) for place, k in enumerate(kinds) for a, b in found[k])
    return ",".join(f"{kinds[place]}:{a}:{b}" for a, place, b in rows)


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of each row, and what the
    method adds: ``n_url``, ``n_account``, ``n_spans`` (all kinds) and ``private``, whether there is
    a span other than an address of the web.

    A null text counts as empty and has no spans. Rows are independent of each other: repeated
    ones give repeated results, a null doc_id stays null. Extra columns are ignored.
    """

    def make():
        anchors = automaton()

        def work(batch: pa.RecordBatch) -> dict:
            counts = {k: [] for k in KINDS}
            digests, everything = [], []
            for text in batch.column(0):
                found = spans(text.as_py() or "", anchors)
                for k in KINDS:
                    counts[k].append(len(found[k]))
                digests.append(sha256(joined(found, BASE).encode()).hexdigest())
                everything.append(joined(found, KINDS))
            made = {f"n_{k}": pa.array(v, pa.int64()) for k, v in counts.items()}
            total = [sum(n) for n in zip(*counts.values(), strict=True)]
            return made | {
                "base_sha256": pa.array(digests, pa.string()),
                "spans": pa.array(everything, pa.string()),
                "n_spans": pa.array(total, pa.int64()),
                "private": pa.array([n > u for n, u in zip(total, counts["url"], strict=True)], pa.bool_()),
            }

        return work

    schema = "".join(f"n_{k} bigint, " for k in KINDS) + "base_sha256 string, spans string, n_spans bigint, private boolean"
    return over_batches(docs.select("text", "doc_id"), make, schema, ["doc_id"])


def masked(docs: DataFrame, column: str = "text", mark: str = "<{}>") -> DataFrame:
    """``docs`` with every span of ``column`` replaced by its kind; overlapping spans are merged
    under the first one's kind. Null stays null, all other columns are kept."""
    place = docs.columns.index(column)
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    source = names[place]

    def make():
        anchors = automaton()

        def work(batch: pa.RecordBatch) -> dict:
            made = []
            for value in batch.column(batch.schema.get_field_index(source)):
                text = value.as_py()
                if text is None:
                    made.append(None)
                    continue
                found = spans(text, anchors)
                rows = sorted((a, p, b) for p, k in enumerate(KINDS) for a, b in found[k])
                parts, end = [], 0
                for a, p, b in rows:
                    if a >= end:
                        parts += [text[end:a], mark.format(KINDS[p])]
                    end = max(end, b)
                made.append("".join([*parts, text[end:]]))
            return {"masked": pa.array(made, pa.string())}

        return work

    done = over_batches(plain, make, "masked string", names)
    return done.select(
        *(F.col("masked" if k == place else n).alias(c) for k, (n, c) in enumerate(zip(names, docs.columns, strict=True)))
    )
