"""Title rules: examples, known oddities, and agreement with one-word-at-a-time removal."""

import random
import re

import pytest

from pricelens.functions import titles as N
from pricelens.functions import vocabulary as V

EXAMPLES = {
    "Samsung A15 256 ГБ": "samsung a15 256gb",
    "Xiaomi 14 Pro+ 256GB": "xiaomi 14 pro plus 256gb",
    "Xiaomi 14 Pro Plus 256GB": "xiaomi 14 pro plus 256gb",
    "Xiaomi 14 Pro + 256GB": "xiaomi 14 pro plus 256gb",
    "Redmi Note 13 Note+ 8GB/256GB": "redmi note 13 note plus 8gb 256gb",
    "Apple iPhone 17 (eSim) 256GB": "iphone 17 256gb esim",
    "iPhone 17 (Nano-Sim) 256 gb": "iphone 17 256gb nanosim",
    "iPhone 17 Dual eSIM 128 gb": "iphone 17 128gb esim",
    "iphone 17 pro max esim 256gb": "iphone 17 pro max 256gb esim",
    "Galaxy A05 4GB/64GB": "galaxy a05 4gb 64gb",
    "Galaxy S24 8/256GB Black Titanium": "galaxy s24 8gb 256gb",
    "iPhone 15 8GB/256GB Natural Titanium": "iphone 15 256gb",
    "iPhone 15 8/256GB": "iphone 15 256gb",
    "Pixel 9 (Nano-SIM & eSIM) 128GB": "pixel 9 128gb esim nanosim",
    "Galaxy A16 LTE Dual-SIM 4G 128GB": "galaxy a16 128gb",
    # Text in parentheses is lost, whatever it distinguishes.
    "Nothing Phone (1) 128GB": "nothing phone 128gb",
    "Nothing Phone (2) 128GB": "nothing phone 128gb",
    # "single sim" in parentheses holds "e sim".
    "Galaxy A16 (single sim)": "galaxy a16 esim",
    "Galaxy A16 (dual sim)": "galaxy a16 dualsim",
    "Galaxy A16 dual sim": "galaxy a16",
    # RAM is not dropped where storage is in TB.
    "iPhone 17 12gb/1tb": "iphone 17 12gb 1tb",
    # The plus rule comes before the RAM rule.
    "Galaxy S24 8 + 256gb": "galaxy s24 8 plus 256gb",
    # Any space parts words of a rule, only a blank parts words of a phrase.
    "iPhone\u00a016 128\u00a0GB": "iphone 16 128gb",
    "iPhone 16 space\u00a0gray": "iphone 16 space gray",
    "iPhone 16 space gray": "iphone 16",
    # Word edges are ASCII: a Cyrillic letter next to a colour does not protect it.
    "чехолred 5": "чехол 5",
    "redmi 5": "redmi 5",
}


def test_examples(apply):
    assert apply(N.normalize_title, list(EXAMPLES)) == list(EXAMPLES.values())


@pytest.mark.parametrize(
    ("key", "expected"),
    [
        ("iphone 17 256gb nanosim", "iphone 17 256gb"),
        ("iphone 17 256gb esim nanosim", "iphone 17 256gb esim"),
        ("iphone 17 256gb esim", "iphone 17 256gb esim"),
        ("galaxy dual 256gb dualsim", "galaxy 256gb dualsim"),
        ("nanosim card", "nanosim card"),
    ],
)
def test_match_key(apply, key, expected):
    assert apply(N.match_key, [key]) == [expected]


def test_display_name_keeps_words_only_keys_drop(apply):
    names = ["Apple iPhone 15 Rose Gold  256GB", "Galaxy Bronze Violet RED", "Redmi Blueish"]
    assert apply(N.display_name, names) == [
        "Apple iPhone 15 256GB",
        "Galaxy Bronze Violet",
        "Redmi Blueish",
    ]


def _one_by_one(text: str) -> str:
    for words in (V.KEY_PHRASES, V.KEY_COLORS, V.CONNECTIVITY):
        for word in words:
            text = re.sub(rf"(?<![A-Za-z0-9_]){re.escape(word)}(?![A-Za-z0-9_])", "", text)
    return text


def test_one_pass_removal_equals_word_by_word(apply):
    rng = random.Random(7)
    words = V.KEY_PHRASES + V.KEY_COLORS + V.CONNECTIVITY
    parts = sorted({p for w in words for p in w.split()}) + ["x", "5", "goldfish", "я"]
    glue = [" ", " ", " ", "  ", "-", "_", "/", ""]
    texts = [
        "".join(rng.choice(parts) + rng.choice(glue) for _ in range(rng.randint(1, 7)))
        for _ in range(4000)
    ]
    assert apply(N.strip_vocab, texts) == [_one_by_one(t) for t in texts]


def test_keys_are_stable(apply):
    keys = apply(N.normalize_title, list(EXAMPLES))
    # Only a key that still holds a phrase a space has hidden could change.
    plain = [k for k in keys if "space gray" not in k]
    assert apply(N.normalize_title, plain) == plain
    assert apply(lambda c: N.match_key(N.match_key(c)), keys) == apply(N.match_key, keys)
