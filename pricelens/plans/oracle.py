"""DuckDB SQL for the registered queries.

Written from the rules, not from the Spark code: windows and joins where Spark aggregates,
sequential replacements where Spark uses look-arounds (DuckDB's regex engine has none).
"""

from __future__ import annotations

from itertools import permutations

from ..functions.vocabulary import (
    CONNECTIVITY,
    DISPLAY_COLORS,
    KEY_COLORS,
    KEY_PHRASES,
)
from ..sources.tables import EVENT_SOURCES, LINE_ORDER
from . import fixtures
from .queries import (
    FEED_FLAT,
    MODIFIER_TEXTS,
    NAV_WORDS,
    NUMBER_TEXTS,
    OPTION_TEXTS,
    PRICE_TEXTS,
    STAMP,
    STORAGE_TEXTS,
    STORE_URL,
)

SOURCE_IDS = ["anchor", "shop_b", "shop_c", "shop_d", "shop_e"]
LABELS = ["Anchor", "Shop B", "Shop C", "Shop D", "Shop E"]
NBSP = chr(0xA0)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(index: str, values: list[str]) -> str:
    return f"list_extract([{', '.join(lit(v) for v in values)}], cast(1 + {index} as bigint))"


def rx(expr: str, pattern: str, repl: str = "", flags: str = "g") -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(repl)}, {lit(flags)})"


# ---- offers ----------------------------------------------------------------------------

_TITLE = f"""
 (CASE WHEN p_partkey % 2 <> 0 THEN 'Samsung Galaxy S'
       WHEN l_orderkey % 2 = 0 THEN 'Apple iPhone ' ELSE 'iPhone ' END)
 || CAST(11 + p_partkey % 7 AS VARCHAR)
 || (CASE WHEN p_partkey % 3 = 0 THEN ' Pro'
          WHEN p_partkey % 3 = 1 AND l_orderkey % 3 = 0 THEN ' Pro+'
          WHEN p_partkey % 3 = 1 THEN ' Pro Plus' ELSE '' END)
 || ' ' || (CASE WHEN l_linenumber % 2 = 0 OR p_partkey % 2 <> 0 THEN '8GB/' ELSE '' END)
 || {pick('p_size % 3', ['128', '256', '512'])}
 || (CASE l_orderkey % 5 WHEN 0 THEN ' ГБ' WHEN 1 THEN ' GB' ELSE 'GB' END)
 || {pick('l_orderkey % 7', [' (eSim)', ' (Nano-Sim)', ' Dual eSIM', ' (Nano-SIM & eSIM)', '', '', ''])}
 || ' ' || upper(substr(p_name, 1, 1)) || substr(p_name, 2)"""

_OFFERS = f"""offers AS (
 SELECT {pick('l_suppkey % 5', SOURCE_IDS)} AS source, {_TITLE} AS name,
  CASE WHEN l_quantity <> 13 THEN l_extendedprice END AS cash_price,
  CASE WHEN l_discount <> 0 THEN round(l_extendedprice * (1 + l_tax)) END AS installment_price,
  l_shipdate,
  row_number() OVER (ORDER BY l_suppkey % 5, {', '.join(LINE_ORDER)}) AS ord
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""

# ---- titles ----------------------------------------------------------------------------

_SIM = {"esim": r"e[\s-]?sim", "nanosim": r"nano[\s-]?sim", "dualsim": r"dual[\s-]?sim"}


def lower_trim(e: str) -> str:
    return f"trim(lower({e}))"


def unit_gb(e: str) -> str:
    return rx(e, r"([0-9]+)\s*гб", r"\1gb")


def strip_brand(e: str) -> str:
    return rx(e, r"^apple\s+")


def plus_forms(e: str) -> str:
    e = rx(rx(e, r"\bpro\s*\+", "pro plus"), r"note\s*\+", "note plus")
    return rx(e, r"\+(\s|$)", r" plus\1")


def paren_sim(e: str) -> str:
    for size in (3, 2, 1):
        for tokens in (["esim", "nanosim", "dualsim"], ["esim", "nanosim"], ["esim", "dualsim"],
                       ["nanosim", "dualsim"], ["esim"], ["nanosim"], ["dualsim"]):
            if len(tokens) == size:
                orders = "|".join(
                    "[^)]*".join(_SIM[t] for t in p) for p in permutations(tokens)
                )
                e = rx(e, rf"\([^)]*(?:{orders})[^)]*\)", f" {' '.join(tokens)} ")
    return rx(e, r"\([^)]*\)", " ")


def bare_sim(e: str) -> str:
    return rx(rx(e, r"\be[\s-]?sim\b", "esim"), r"\bnano[\s-]?sim\b", "nanosim")


def ram_storage(e: str) -> str:
    apple = rx(e, r"\b\d+\s*gb\s*[/+]\s*(\d+\s*gb)\b", r"\1")
    apple = rx(apple, r"\b\d+\s*[/+]\s*(\d+\s*gb)\b", r"\1")
    other = rx(e, r"\b(\d+)\s*gb\s*[/+]\s*(\d+)\s*gb\b", r"\1gb \2gb")
    other = rx(other, r"\b(\d+)\s*[/+]\s*(\d+)\s*gb\b", r"\1gb \2gb")
    return f"CASE WHEN {e} LIKE 'iphone%' OR {e} LIKE 'apple%' THEN {apple} ELSE {other} END"


def spacing(e: str) -> str:
    return rx(e, r"(\d+)\s*gb", r"\1gb")


def strip_vocab(e: str) -> str:
    for words in (KEY_PHRASES, KEY_COLORS, CONNECTIVITY):
        e = rx(e, r"\b(?:" + "|".join(words) + r")\b")
    return e


def drop_dual(e: str) -> str:
    return rx(e, r"\bdual\s+esim", "esim")


def clean_punct(e: str) -> str:
    return f"trim({rx(rx(e, '[,_/' + chr(92) * 2 + '&-]+', ' '), chr(92) + 's+', ' ')})"


def reorder(e: str) -> str:
    size = r"regexp_full_match(t, '\d+(gb|tb)')"
    sim = "t IN ('esim', 'nanosim', 'dualsim')"
    tokens = f"string_split({e}, ' ')"
    return (
        f"array_to_string(list_concat(list_filter({tokens}, lambda t: NOT {size} AND NOT {sim}),"
        f" list_concat(list_filter({tokens}, lambda t: {size}),"
        f" list_filter({tokens}, lambda t: {sim}))), ' ')"
    )


_RULES = [
    lower_trim, unit_gb, strip_brand, plus_forms, paren_sim, bare_sim, ram_storage, spacing,
    strip_vocab, drop_dual, clean_punct, reorder,
]


def steps(source: str, rules, column: str = "name", prefix: str = "t") -> str:
    """One CTE per rule, from distinct names to ``(name, v)``."""
    ctes = [f"{prefix}0 AS (SELECT DISTINCT {column} AS name, {column} AS v FROM {source})"]
    for i, rule in enumerate(rules):
        ctes.append(f"{prefix}{i + 1} AS (SELECT name, {rule('v')} AS v FROM {prefix}{i})")
    return ",\n".join(ctes)


def match_key(e: str) -> str:
    gone = rx(rx(e, r"\s+nanosim\b"), r"\s+dual\b")
    return f"trim({rx(gone, chr(92) + 's+', ' ')})"


def titles(*rules) -> str:
    return f"WITH {_OFFERS}, {steps('offers', rules)} SELECT name, v AS result FROM t{len(rules)}"


def keyed(source: str = "offers", prefix: str = "t") -> str:
    return (
        steps(source, _RULES, prefix=prefix)
        + f",\n{prefix}keyed AS (SELECT o.*, k.v AS key, {match_key('k.v')} AS base_key"
        f" FROM {source} o JOIN {prefix}{len(_RULES)} k ON o.name = k.name)"
    )


def groups(source: str = "offers", prefix: str = "t") -> str:
    """Adds ``<prefix>canon`` and ``<prefix>best``."""
    return keyed(source, prefix) + f""",
{prefix}canon AS (SELECT base_key,
  coalesce(arg_min(key, ord) FILTER (WHERE key <> base_key), base_key) AS product_key,
  min(ord) AS first_ord FROM {prefix}keyed GROUP BY base_key),
{prefix}ranked AS (SELECT *, row_number() OVER (PARTITION BY base_key, source
  ORDER BY coalesce(cash_price, 'infinity'::DOUBLE), ord) AS rn FROM {prefix}keyed),
{prefix}best AS (SELECT c.product_key, c.first_ord, r.base_key, r.source, r.name,
  r.cash_price, r.installment_price
  FROM {prefix}ranked r JOIN {prefix}canon c ON r.base_key = c.base_key WHERE rn = 1)"""


_G = f"WITH {_OFFERS}, {groups()}"

# ---- comparison ------------------------------------------------------------------------


def truthy(e: str) -> str:
    return f"coalesce({e} <> 0, false)"


def alert(a: str, c: str, flat: float = 3000.0) -> str:
    return (
        f"({truthy(a)} AND {truthy(c)} AND coalesce(({a} - {c}) > {flat}e0"
        f" OR ({a} - {c}) > {a} * 0.1e0, false))"
    )


def flag(a: str, c: str) -> str:
    return (
        f"CASE WHEN NOT ({truthy(a)} AND {truthy(c)}) THEN ''"
        f" WHEN {alert(a, c)} THEN '❗' ELSE '✅' END"
    )


def same(ac: str, ai: str, c: str, i: str) -> str:
    return (
        f"(({c} IS NOT DISTINCT FROM {ac}) AND (NOT {truthy(i)}"
        f" OR {i} IS NOT DISTINCT FROM coalesce({ai}, {ac})))"
    )


def price_text(e: str, sep: str = NBSP) -> str:
    milli = f"cast(round({e} * 1000) AS BIGINT)"
    whole = f"replace(format('{{:,}}', {milli} // 1000), ',', {lit(sep)})"
    rest = f"rtrim(lpad(cast({milli} % 1000 AS VARCHAR), 3, '0'), '0')"
    return (
        f"CASE WHEN NOT {truthy(e)} THEN '—' ELSE {whole}"
        f" || CASE WHEN {milli} % 1000 = 0 THEN '' ELSE '.' || {rest} END END"
    )


def pair_text(c: str, i: str, ac: str, ai: str, anchor: str) -> str:
    ref = f"coalesce({ai}, {ac})"
    own = f"({price_text(c)}) || CASE WHEN {truthy(i)} THEN ' - ' || ({price_text(i)}) ELSE '' END"
    cash = f"CASE WHEN {truthy(c)} THEN ({flag(ac, c)}) || ({price_text(c)}) ELSE '—' END"
    inst = f"CASE WHEN {truthy(i)} THEN ' - ' || ({flag(ref, i)}) || ({price_text(i)}) ELSE '' END"
    return (
        f"CASE WHEN {anchor} THEN {own} WHEN {same(ac, ai, c, i)} THEN 'Արժեքները նույնն են'"
        f" ELSE ({cash}) || ({inst}) END"
    )


def display(e: str) -> str:
    gone = rx(e, r"\b(?:" + "|".join(DISPLAY_COLORS) + r")\b", "", "gi")
    return f"trim({rx(gone, chr(92) + 's+', ' ')})"


_ANCHORED = """anchored AS (SELECT * FROM tbest WHERE source = 'anchor')"""

_COMPARED = f"""compared AS (
 SELECT b.base_key, b.product_key, b.source, a.cash_price AS anchor_cash,
  a.installment_price AS anchor_installment, b.cash_price, b.installment_price,
  {flag('a.cash_price', 'b.cash_price')} AS cash_flag,
  {flag('coalesce(a.installment_price, a.cash_price)', 'b.installment_price')} AS installment_flag,
  {same('a.cash_price', 'a.installment_price', 'b.cash_price', 'b.installment_price')} AS same,
  ({alert('a.cash_price', 'b.cash_price')} OR
   {alert('coalesce(a.installment_price, a.cash_price)', 'b.installment_price')}) AS alert
 FROM tbest b JOIN anchored a ON a.base_key = b.base_key WHERE b.source <> 'anchor')"""

_DIM = "dim AS (SELECT * FROM (VALUES " + ", ".join(
    f"({lit(s)}, {lit(label)}, {i})"
    for i, (s, label) in enumerate(zip(SOURCE_IDS, LABELS, strict=True))
) + ") AS d(source, label, rank))"


def messages(prefix: str = "t", suffix: str = "") -> str:
    best = f"{prefix}best"
    return f"""anch{suffix} AS (SELECT * FROM {best} WHERE source = 'anchor'),
lines{suffix} AS (SELECT a.base_key, a.product_key, a.first_ord, d.rank,
  d.label || ' - ' || CASE WHEN b.source IS NULL THEN 'Առկա չէ' ELSE
   {pair_text('b.cash_price', 'b.installment_price', 'a.cash_price', 'a.installment_price',
              'd.rank = 0')} END AS line,
  d.rank > 0 AND ({alert('a.cash_price', 'b.cash_price')} OR
   {alert('coalesce(a.installment_price, a.cash_price)', 'b.installment_price')}) AS alert,
  '*' || {display('a.name')} || '*' AS head
 FROM anch{suffix} a CROSS JOIN dim d
 LEFT JOIN {best} b ON b.base_key = a.base_key AND b.source = d.source),
msgs{suffix} AS (SELECT product_key, first_ord, max(head) AS head, bool_or(coalesce(alert, false)) AS has_alert,
  max(head) || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS message
 FROM lines{suffix} GROUP BY product_key, first_ord)"""


_M = f"{_G}, {_DIM}, {messages()}"

_PAIRS = """pairs AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 CASE WHEN l_orderkey % 11 = 0 THEN 0e0 WHEN l_orderkey % 13 <> 0 THEN l_extendedprice END AS anchor_cash,
 CASE WHEN l_orderkey % 3 = 0 THEN l_extendedprice + 500 END AS anchor_installment,
 CASE WHEN l_partkey % 7 = 0 THEN l_extendedprice
      WHEN l_partkey % 17 <> 0 THEN l_extendedprice * 0.85e0 + l_partkey % 9 * 300 END AS cash_price,
 CASE WHEN l_partkey % 5 = 0 THEN 0e0 WHEN l_partkey % 4 = 0 THEN l_extendedprice + 500
      WHEN l_partkey % 3 = 0 THEN l_extendedprice * 0.8e0 END AS installment_price
 FROM lineitem)"""
_PK = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _texts(values: list[str]) -> str:
    text = pick(f"p_partkey % {len(values)}", values)
    return (
        f"texts AS (SELECT p_partkey, p_name, replace({text}, '#',"
        f" cast(cast(floor(p_retailprice) AS BIGINT) AS VARCHAR)) AS text FROM part)"
    )


def number(e: str) -> str:
    return f"nullif(try_cast(nullif({e}, '') AS DOUBLE), 0)"


def digits_after(e: str) -> str:
    return number(rx(e, "[^0-9]"))


_NUM = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def modifier(e: str, esim: str, nano: str, dual: str, other: str) -> str:
    return (
        f"CASE WHEN contains({e}, '+') OR contains(lower({e}), 'nano')"
        f" OR regexp_matches({e}, '^[0-9]') THEN '{nano}'"
        f" WHEN regexp_matches(lower({e}), 'e[\\s-]?sim') THEN '{esim}'"
        f" WHEN contains(lower({e}), 'dual') THEN '{dual}' ELSE {other} END"
    )


_OPTION_SIM = """CASE
 WHEN contains(lower(text), 'esim+esim') OR contains(lower(text), 'esim + esim')
   OR contains(lower(text), '2 esim') THEN 'eSim+eSim'
 WHEN contains(lower(text), 'nano') OR contains(lower(text), '/esim')
   OR contains(lower(text), '+ esim') THEN 'Nano-Sim'
 WHEN regexp_full_match(trim(lower(text)), 'e[\\s-]?sim') THEN 'eSim' ELSE text END"""


def catalog_sim(e: str) -> str:
    v = f"lower({e})"
    return f"""CASE
 WHEN contains({v}, 'esim') AND NOT contains({v}, 'nano') AND NOT contains({v}, 'sim +')
  AND NOT contains({v}, '+ esim') AND NOT contains({v}, '1 sim') THEN ' eSim'
 WHEN contains({v}, '1 sim + esim') OR contains({v}, 'sim + esim') OR contains({v}, 'nano')
  THEN ' Nano-Sim'
 WHEN contains({v}, '2 esim') OR contains({v}, 'dual esim') THEN ' Dual eSim' ELSE '' END"""


def plain(e: str) -> str:
    """Text of an html fragment."""
    e = rx(e, "<[^>]*>")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        e = f"replace({e}, {lit(entity)}, {lit(char)})"
    return f"trim({e})"


_LINKS = r"""links AS (SELECT page_id, url AS page_url, i - 1 AS pos, all_links[i] AS link
 FROM (SELECT page_id, url, regexp_extract_all(html, '(?s)<a [^>]*href="[^"]*"[^>]*>.*?</a>') AS all_links
  FROM pages), unnest(range(1, len(all_links) + 1)) AS r(i)),
named AS (SELECT page_id, page_url, pos, regexp_extract(link, 'href="([^"]*)"', 1) AS href, """ + plain(
    "link"
) + " AS name FROM links)"

_H1 = plain("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")
_HEAD = plain("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)")

# ---- shop pages derived from part ------------------------------------------------------

_CARD_URL = f"'{fixtures.SHOP}/store/product/' || p_partkey"
_SIMPLE = {
    "ram": "floor(p_retailprice) AS cash_price, floor(p_retailprice / 8 + 0.5) AS installment_price",
    "sim": "floor(p_retailprice) AS cash_price,"
    " cast(floor(p_retailprice / 4) AS DOUBLE) * 1000 AS installment_price",
}
# Products of a page: which storage and RAM option they belong to, and their prices.
_PRICED = """priced AS (
 SELECT p_partkey, 2 AS id, p_retailprice AS cash_price, p_retailprice + 50 AS installment_price FROM part
 UNION ALL SELECT p_partkey, 3, p_retailprice * 2, NULL FROM part
 UNION ALL SELECT p_partkey, 4, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_retailprice + 10 END,
  p_retailprice + 20 FROM part WHERE p_partkey % 4 <> 0)"""


def _config_job(kind: str) -> str:
    if kind == "ram":
        base = "'Xiaomi ' || p_name || ' & case'"
        name = {"s1": "128ԳԲ", "s2": "256GB", "r1": "8GB", "r2": "12ԳԲ"}
        rows = f"""
 SELECT p_partkey, 2 AS id, {base} || ' {name['r1']}/{name['s1']}' AS name FROM part WHERE p_partkey % 6 IN (0, 4)
 UNION ALL SELECT p_partkey, 3, {base} || ' {name['r1']}/{name['s2']}' FROM part WHERE p_partkey % 6 = 0
 UNION ALL SELECT p_partkey, 4, {base} || ' {name['r2']}/{name['s2']}' FROM part WHERE p_partkey % 6 = 0
 UNION ALL SELECT p_partkey, 3, {base} || ' {name['s2']}' FROM part WHERE p_partkey % 6 = 1"""
    else:
        base = "(CASE WHEN p_partkey % 2 = 0 THEN 'iPhone ' ELSE 'Galaxy ' END || p_name)"
        # Even parts are Apple: cases 0, 2, 4. Odd ones: 1 storage only, 3 broken, 5 no storage.
        apple = "p_partkey % 6 IN (0, 4)"
        rows = f"""
 SELECT p_partkey, 3 AS id, {base} || ' 256GB (eSim)' AS name FROM part WHERE {apple}
 UNION ALL SELECT p_partkey, 2, {base} || ' 128GB (Nano-Sim)' FROM part WHERE {apple}
 UNION ALL SELECT p_partkey, 4, {base} || ' 256GB (Nano-Sim)' FROM part WHERE {apple}
 UNION ALL SELECT p_partkey, 4, {base} || ' 256GB (eSim+eSim)' FROM part WHERE {apple}
 UNION ALL SELECT p_partkey, 3, {base} || ' 256GB' FROM part WHERE p_partkey % 6 = 1"""
    return f"""{_PRICED},
titled AS ({rows}),
variants AS (SELECT t.p_partkey AS page_id, t.name, p.cash_price, p.installment_price,
  t.id * 10 + CASE WHEN t.name LIKE '%+eSim)' THEN 5 ELSE 0 END AS place
 FROM titled t JOIN priced p ON t.p_partkey = p.p_partkey AND t.id = p.id WHERE p.cash_price <> 0),
joined AS (SELECT * FROM variants UNION ALL
 SELECT p_partkey, {base}, {_SIMPLE[kind]}, 0 FROM part
 WHERE p_partkey % 7 <> 0 AND p_partkey NOT IN (SELECT page_id FROM variants))"""


ORACLE: dict[str, str] = {}

ORACLE["norm_units"] = titles(lower_trim, unit_gb, strip_brand, spacing)
ORACLE["norm_plus"] = titles(lower_trim, plus_forms)
ORACLE["norm_sim"] = titles(lower_trim, paren_sim, bare_sim, drop_dual)
ORACLE["norm_ram"] = titles(lower_trim, unit_gb, strip_brand, ram_storage)
ORACLE["norm_reorder"] = titles(lower_trim, clean_punct, reorder)
ORACLE["normalize_titles"] = titles(*_RULES)
ORACLE["match_key"] = titles(*_RULES, match_key)
ORACLE["strip_colors"] = (
    "SELECT p_partkey, "
    + strip_vocab(
        "trim(lower(p_name || "
        + pick("p_partkey % 6", [" space gray", " dual sim lte", " natural titanium 4g",
                                 " Deep-blue", "", " goldfish"]) + "))"
    )
    + " AS result FROM part"
)
ORACLE["display_name"] = (
    "SELECT p_partkey, "
    + display(
        "(p_name || "
        + pick("p_partkey % 4", [" Rose Gold 5G", " desert  titanium", "", " Blueish"]) + ")"
    )
    + " AS result FROM part"
)

ORACLE["canonical_keys"] = f"{_G} SELECT base_key, product_key FROM tcanon"
ORACLE["best_offer"] = (
    f"{_G} SELECT base_key, product_key, source, name, cash_price, installment_price FROM tbest"
)
ORACLE["offer_pivot"] = f"{_G} SELECT base_key, product_key, " + ", ".join(
    f"max(cash_price) FILTER (WHERE source = '{s}') AS {s}" for s in SOURCE_IDS
) + " FROM tbest GROUP BY base_key, product_key"
ORACLE["anchor_compare"] = f"{_G}, {_ANCHORED}, {_COMPARED} SELECT * FROM compared"
ORACLE["anchor_join"] = (
    f"{_G}, {_ANCHORED}, {_COMPARED} SELECT * EXCLUDE (product_key) FROM compared"
)
ORACLE["source_grid"] = f"""{_G}, {_DIM}, {_ANCHORED}
SELECT a.base_key, a.product_key, d.source, b.source IS NOT NULL AS present, b.cash_price,
 b.installment_price
FROM anchored a CROSS JOIN dim d LEFT JOIN tbest b ON b.base_key = a.base_key AND b.source = d.source"""
ORACLE["product_alerts"] = f"""{_G}, {_ANCHORED}, {_COMPARED}
SELECT product_key, bool_or(alert) AS has_alert FROM compared GROUP BY product_key"""
ORACLE["report_messages"] = f"{_M} SELECT product_key, has_alert, message FROM msgs"
ORACLE["numbered_alerts"] = (
    f"{_M} SELECT row_number() OVER (ORDER BY first_ord) AS n, product_key FROM msgs WHERE has_alert"
)
ORACLE["alert_keys"] = f"{_M} SELECT product_key, head AS alert_key FROM msgs WHERE has_alert"
ORACLE["full_report"] = f"""{_M}, numbered AS (
 SELECT row_number() OVER (ORDER BY first_ord) AS n, * FROM msgs WHERE has_alert)
SELECT n, product_key, head AS alert_key, cast(n AS VARCHAR) || '. ' || message AS message FROM numbered"""

ORACLE["price_flags"] = (
    f"WITH {_PAIRS} SELECT {_PK}, {flag('anchor_cash', 'cash_price')} AS flag FROM pairs"
)
ORACLE["installment_flags"] = (
    f"WITH {_PAIRS} SELECT {_PK},"
    f" {flag('coalesce(anchor_installment, anchor_cash)', 'installment_price')} AS flag FROM pairs"
)
ORACLE["price_match"] = (
    f"WITH {_PAIRS} SELECT {_PK},"
    f" {same('anchor_cash', 'anchor_installment', 'cash_price', 'installment_price')} AS same FROM pairs"
)
ORACLE["variant_price"] = (
    f"WITH {_PAIRS} SELECT {_PK},"
    f" coalesce(nullif(installment_price, 0), nullif(anchor_cash, 0)) AS price FROM pairs"
)
ORACLE["format_price"] = f"""WITH x AS (SELECT {_PK},
 CASE WHEN l_linenumber = 7 THEN 0e0 ELSE l_extendedprice * l_quantity END AS price FROM lineitem)
SELECT {_PK}, {price_text('round(price, 2)')} AS text, {price_text('floor(price)', '.')} AS dotted FROM x"""
ORACLE["format_pair"] = f"""WITH {_PAIRS}, whole AS (SELECT {_PK}, floor(cash_price) AS c,
 floor(installment_price) AS i, floor(anchor_cash) AS ac, floor(anchor_installment) AS ai FROM pairs)
SELECT {_PK}, {pair_text('c', 'i', 'ac', 'ai', 'l_suppkey % 5 = 0')} AS text FROM whole"""

ORACLE["dedup_url"] = r"""WITH bare AS (SELECT page_id,
 regexp_extract(url, '^https?://[^./]*\.([^/]*/[^/?#]*)', 1) AS url FROM pages)
SELECT url, min(page_id) AS page_id FROM bare GROUP BY url"""
ORACLE["dedup_title"] = f"""WITH {_OFFERS}, r AS (SELECT *,
 row_number() OVER (PARTITION BY source, name ORDER BY ord) AS rn FROM offers)
SELECT source, name, cash_price, installment_price FROM r WHERE rn = 1"""
ORACLE["drop_incomplete"] = f"""SELECT page_id, url, cast(page_id % 4 AS DOUBLE) AS cash_price FROM pages
WHERE coalesce({_HEAD}, '') <> '' AND page_id % 7 <> 0 AND page_id % 5 <> 0 AND page_id % 3 <> 0
 AND page_id % 4 <> 0"""
ORACLE["invalid_sources"] = """SELECT event_type AS source, count(*) AS rows FROM events
WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY event_type"""

ORACLE["coerce_prices"] = f"""WITH {_texts(NUMBER_TEXTS)}, x AS (SELECT p_partkey,
 {number(f"regexp_extract(text, '^ *({_NUM}) *$', 1)")} AS whole,
 {number(f"regexp_extract(text, '^ *({_NUM})', 1)")} AS float_prefix,
 {number("regexp_extract(text, '^ *([+-]?[0-9]+)', 1)")} AS int_prefix FROM texts)
SELECT *, floor(float_prefix + 0.5e0) AS rounded FROM x"""
ORACLE["parse_price_text"] = f"""WITH {_texts(PRICE_TEXTS)}
SELECT p_partkey, {number(f"replace(regexp_extract({rx('text', chr(92) + 's+')}, '([0-9,]+)դր', 1), ',', '')")}
 AS price, {digits_after('text')} AS digits FROM texts"""
ORACLE["storage_label"] = f"""WITH {_texts(STORAGE_TEXTS)} SELECT p_partkey,
 {rx(rx(rx('text', chr(92) + 's*(?:ԳԲ|գբ)', 'GB'), chr(92) + 's*(?:ՏԲ|տբ)', 'TB'), chr(92) + 's+')} AS label
FROM texts"""
ORACLE["strip_prefix"] = f"""SELECT p_partkey,
 {rx(pick('p_partkey % 4', ['Գնել ', 'գնել  ', '', 'Գնել']) + ' || p_name', '^(?:Գնել|գնել) +')} AS result
FROM part"""
ORACLE["sim_class_catalog"] = f"""WITH {_texts(fixtures.SIM_VALUES)}
SELECT p_partkey, {catalog_sim('text')} AS suffix FROM texts"""
ORACLE["sim_class_modifier"] = f"""WITH {_texts(MODIFIER_TEXTS)} SELECT p_partkey,
 {modifier('text', 'esim', 'nanosim', 'dualsim', 'NULL')} AS token,
 {modifier('text', 'eSim', 'Nano-Sim', 'Dual', 'text')} AS suffix FROM texts"""
ORACLE["sim_class_option"] = f"""WITH {_texts(OPTION_TEXTS)}
SELECT p_partkey, {_OPTION_SIM} AS label FROM texts"""
ORACLE["compose_title"] = f"""WITH {_texts([*MODIFIER_TEXTS, '8gb', ' 12GB '])}, x AS (SELECT *,
 trim(text) AS t, {modifier('text', 'eSim', 'Nano-Sim', 'Dual', 'NULL')} AS sim,
 regexp_full_match(lower(trim(text)), '[0-9]+gb') AS ram FROM texts)
SELECT p_partkey,
 CASE WHEN ram THEN p_name || ' ' || t || '/256GB' WHEN sim IS NOT NULL
  THEN p_name || ' 256GB (' || sim || ')' ELSE p_name || ' 256GB ' || t END AS with_modifier,
 CASE WHEN p_partkey % 2 = 0 THEN p_name || ' 6GB/256GB' ELSE p_name || ' 256GB' END AS with_spec,
 p_name || ' ' || t || '/256GB' AS ram_storage,
 p_name || ' 256GB (' || {_OPTION_SIM} || ')' AS storage_sim FROM x"""
ORACLE["is_apple"] = f"""WITH {_OFFERS} SELECT DISTINCT name,
 lower(name) LIKE '%iphone%' OR lower(name) LIKE 'apple%' AS apple FROM offers"""

ORACLE["listing_page_count"] = r"""SELECT page_id, cast(greatest(1, coalesce(list_max(list_transform(
 list_filter(regexp_extract_all(html || '<a class="page" href="' || url || '">self</a>',
  '<a [^>]*href="([^"]*)"', 1), lambda h: contains(h, '?page=')),
 lambda h: try_cast(regexp_extract(h, 'page=([0-9]+)', 1) AS INTEGER))), 1)) AS INTEGER) AS page_count
FROM pages"""
ORACLE["extract_listing"] = f"""WITH {_LINKS} SELECT page_id, cast(pos AS INTEGER) AS pos, name,
 CASE WHEN href LIKE 'http%' THEN href ELSE '{STORE_URL}' || href END AS url
FROM named WHERE name <> '' AND href <> ''"""
ORACLE["absolute_urls"] = f"""WITH {_LINKS}, every AS (SELECT page_id, pos, href FROM named
 UNION ALL SELECT p.page_id, (SELECT count(*) FROM links l WHERE l.page_id = p.page_id), p.url FROM pages p)
SELECT page_id, cast(pos AS INTEGER) AS pos,
 CASE WHEN href LIKE 'http%' THEN href ELSE '{STORE_URL}' || href END AS url FROM every"""
ORACLE["extract_detail"] = f"""SELECT page_id, coalesce(nullif({_H1}, ''), nullif({_HEAD}, '')) AS name,
 cast(NULL AS DOUBLE) AS cash_price, cast(NULL AS DOUBLE) AS installment_price FROM pages"""
ORACLE["variant_links"] = f"""WITH {_LINKS} SELECT DISTINCT page_id, href AS link FROM named
WHERE contains(href, '/') AND name IN ({', '.join(lit(w) for w in NAV_WORDS)})"""
ORACLE["listing_detail"] = """SELECT o_orderkey, o_custkey AS url,
 coalesce(c_name, 'order ' || o_custkey) AS name,
 coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, o_totalprice) AS cash_price,
 CASE WHEN c_acctbal > 5000 THEN c_acctbal + 1 END AS installment_price
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey"""
ORACLE["variant_detail"] = f"""WITH {_LINKS}, heads AS (SELECT page_id, {_H1} AS name,
  '/' || split_part(lower({_H1}), ' ', 1) AS path FROM pages),
 own AS (SELECT page_id, name, CASE WHEN page_id = min(page_id) OVER (PARTITION BY path) THEN path
  ELSE path || '/' || page_id END AS url FROM heads WHERE path IS NOT NULL),
 outgoing AS (SELECT DISTINCT o.url, o.name AS parent, n.href AS link
  FROM own o JOIN named n ON n.page_id = o.page_id WHERE n.href <> o.url)
SELECT g.url, g.link, t.name, cast(length(t.name) AS DOUBLE) AS cash_price
FROM outgoing g JOIN own t ON t.url = g.link WHERE t.name <> g.parent AND t.name <> ''"""
ORACLE["listing_cards"] = f"""SELECT 'image' AS layout, p_partkey AS page_id,
 'Xiaomi ' || p_name || ' & case' AS name, {_CARD_URL} AS url, cast(NULL AS DOUBLE) AS cash_price FROM part
UNION ALL SELECT 'text', p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'iPhone ' ELSE 'Galaxy ' END || p_name,
 {_CARD_URL}, NULL FROM part
UNION ALL SELECT 'heading', p_partkey, p_name, {_CARD_URL}, floor(p_retailprice) * 1000 + 500
 FROM part WHERE p_partkey % 11 <> 0
UNION ALL SELECT 'div', p_partkey, p_name, {_CARD_URL}, NULL FROM part"""
ORACLE["variant_config"] = """SELECT p_partkey AS page_id, p_partkey % 6 NOT IN (2, 3) AS ok,
 cast(CASE p_partkey % 6 WHEN 2 THEN 0 WHEN 1 THEN 2 WHEN 5 THEN 2 ELSE 3 END AS INTEGER) AS attributes,
 cast(CASE WHEN p_partkey % 6 IN (2, 3) THEN 0 WHEN p_partkey % 4 = 0 THEN 2 ELSE 3 END AS INTEGER) AS prices,
 CASE WHEN p_partkey % 6 NOT IN (2, 5) THEN '128 ԳԲ|256 GB' END AS labels,
 CASE WHEN p_partkey % 6 = 4 THEN p_partkey || '-3|' || p_partkey || '-4' ELSE '' END AS disabled
FROM part"""
ORACLE["simple_offer"] = f"""SELECT 'button' AS kind, p_partkey AS page_id, {_SIMPLE['ram']}
FROM part WHERE p_partkey % 7 <> 0
UNION ALL SELECT 'text', p_partkey, {_SIMPLE['sim']} FROM part WHERE p_partkey % 7 <> 0"""
ORACLE["attr_by_code"] = """WITH k AS (SELECT p_partkey, p_partkey % 13 + 5 AS high, p_partkey % 7 + 1 AS l
 FROM part), m AS (SELECT *, CASE WHEN l = high THEN l * 100 + 99 ELSE l END AS low FROM k)
SELECT p_partkey, CASE WHEN high < low THEN 'high' ELSE 'low' END AS label, 'named' AS named FROM m"""
_BUTTONS = """shown AS (
 SELECT p_partkey, p_name, p_partkey % 5 AS c, p_retailprice AS p, s.state, s.extra, m.i
 FROM part, (VALUES ('128GB', 0), ('256GB', 1)) AS s(state, extra), (VALUES (0), (1)) AS m(i)
 WHERE p_partkey % 5 <> 4),
priced AS (SELECT *, CASE WHEN extra = 1 THEN p + 100 ELSE 0 END + i AS own,
  CASE WHEN extra = 1 THEN p + 500 ELSE p END AS base, CASE WHEN extra = 0 THEN p * 2 END AS loan FROM shown),
found AS (
 SELECT p_partkey AS page_id, extra * 10 + i AS place, p_name || ' ' || CASE
   WHEN c = 1 AND i = 0 THEN '8gb/' || state WHEN c = 1 THEN '12GB/' || state
   WHEN c = 2 AND i = 0 THEN state || ' (eSim)' WHEN c = 2 THEN state || ' (Nano-Sim)'
   WHEN i = 0 THEN state || ' Global' ELSE state || ' (Dual)' END AS name,
  CASE WHEN own = 0 THEN base ELSE own END AS cash_price, loan AS installment_price
 FROM priced WHERE c IN (1, 2, 3)
 UNION ALL SELECT p_partkey, extra * 10, p_name || ' ' || CASE WHEN p_partkey % 2 = 0 THEN '6GB/' ELSE '' END || state,
  base, loan FROM priced WHERE c = 0 AND i = 0
 UNION ALL SELECT p_partkey, 0, p_name, p_retailprice, NULL FROM part WHERE p_partkey % 5 = 4)"""
ORACLE["button_variants"] = (
    f"WITH {_BUTTONS} SELECT page_id, name, cash_price, installment_price FROM found"
)

_CATALOG = f"""ev AS (SELECT *, cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
sims AS (SELECT *, {pick(f'k % {len(fixtures.SIM_VALUES)}', fixtures.SIM_VALUES)} AS sim,
 'Phone ' || user_id || CASE WHEN k % 3 = 0 THEN ' eSIM' ELSE '' END AS raw FROM ev),
rows AS (SELECT event_type AS brand, event_id AS page, 0 AS pos,
  raw || CASE WHEN contains(lower(raw), 'esim') THEN '' ELSE {catalog_sim('sim')} END AS name, raw,
  nullif(value, 0) AS price, nullif(value, 0) AS cash_price,
  cast(CASE WHEN k % 2 = 0 OR k = 0 THEN NULL ELSE k END AS DOUBLE) AS installment_price FROM sims
 UNION ALL SELECT event_type, cast(event_id AS INTEGER), 1, 'Case ' || k, 'Case ' || k, NULL,
  cast(nullif(k, 0) AS DOUBLE), NULL FROM ev)"""
ORACLE["catalog_flatten"] = (
    f"WITH {_CATALOG} SELECT list_position([{', '.join(lit(e) for e in EVENT_SOURCES)}], brand)::BIGINT"
    " AS brand, page::BIGINT AS page, pos::BIGINT AS pos, name, price, cash_price,"
    " installment_price, 'anchor' AS source FROM rows"
)
ORACLE["catalog_read"] = f"""WITH {_CATALOG} SELECT brand, page, cast(pos AS INTEGER) AS pos, raw AS name,
 CASE WHEN pos = 0 THEN cast(value AS VARCHAR) ELSE ' ' || k || ' ' END AS cash_price
FROM rows JOIN ev ON page = event_id"""
ORACLE["catalog_rejects"] = """WITH p AS (SELECT event_type || '-' || (event_id % 60) AS brand,
 event_id AS page, event_id % 211 = 0 AS bad FROM events),
b AS (SELECT brand, count(*) AS pages, count(*) FILTER (WHERE bad) AS rejected,
 min(page) FILTER (WHERE bad) AS first_rejected FROM p GROUP BY brand)
SELECT brand, pages, rejected, first_rejected,
 CASE WHEN rejected > 0 THEN 'not json' END AS reason,
 CASE WHEN rejected > 0 THEN 0 ELSE 2 * pages END AS products FROM b"""
ORACLE["page_coverage"] = """WITH p AS (SELECT event_type || '-' || (user_id % 40) AS brand,
 cast(json_extract_string(props, '$.k') AS BIGINT) % 25 + 1 AS page, user_id % 20 + 10 AS last_page FROM events),
c AS (SELECT brand, max(last_page) AS claimed FROM p GROUP BY brand),
h AS (SELECT DISTINCT p.brand, page FROM p JOIN c ON c.brand = p.brand WHERE page BETWEEN 1 AND claimed),
e AS (SELECT brand, page FROM h UNION ALL SELECT brand, 0 FROM c UNION ALL SELECT brand, claimed + 1 FROM c),
g AS (SELECT brand, page, lead(page) OVER (PARTITION BY brand ORDER BY page) AS following FROM e),
m AS (SELECT brand, string_agg((page + 1) || '-' || (following - 1), ',' ORDER BY page) AS missing
 FROM g WHERE following - page > 1 GROUP BY brand)
SELECT c.brand, claimed AS pages_claimed, count(h.page) AS pages_held, count(h.page) >= claimed AS complete,
 coalesce(any_value(missing), '') AS missing
FROM c LEFT JOIN h ON h.brand = c.brand LEFT JOIN m ON m.brand = c.brand GROUP BY c.brand, claimed"""

_HELD = """WITH p AS (SELECT p_brand AS brand, (p_partkey % 40 + 1)::BIGINT AS page, greatest(p_size % 25 + 1,
 p_partkey % 40 + 1 + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS last_page FROM part),
c AS"""
ORACLE["listing_coverage"] = (
    "SELECT brand AS listing, * EXCLUDE (brand) FROM (" + _HELD + ORACLE["page_coverage"].split("c AS", 1)[1] + ")"
)

ORACLE["job_ram_config"] = f"""WITH {_config_job('ram')}
SELECT page_id, name, cash_price, installment_price, 'shop_b' AS source FROM joined"""
ORACLE["job_sim_config"] = f"""WITH {_config_job('sim')}, r AS (SELECT *,
 row_number() OVER (PARTITION BY name ORDER BY page_id, place) AS rn FROM joined)
SELECT page_id, name, cash_price, installment_price, 'shop_d' AS source FROM r WHERE rn = 1"""
ORACLE["job_detail_links"] = """WITH d AS (SELECT p_partkey AS k, p_name,
  CASE WHEN p_partkey % 5 <> 0 THEN p_name || ' ' || p_partkey % 3 END AS h1,
  CASE WHEN p_partkey % 4 <> 0 THEN floor(p_retailprice) * 1000 END AS cash,
  CASE WHEN p_partkey % 3 <> 0 THEN floor(p_retailprice) * 1100 END AS inst,
  floor(p_retailprice) * 1000 + 500 AS listed FROM part),
 own AS (SELECT k, coalesce(h1, p_name) AS name, coalesce(cash, listed) AS cash_price,
  inst AS installment_price FROM d WHERE k % 11 <> 0),
 links AS (SELECT DISTINCT k, target FROM (SELECT k, k + 1 AS target FROM own UNION ALL SELECT k, 1 FROM own)
  WHERE k <> target),
 every AS (SELECT k, 0 AS place, name, cash_price, installment_price FROM own
  UNION ALL SELECT l.k, CASE WHEN l.target = l.k + 1 THEN 1 ELSE 2 END, t.h1, t.cash, t.inst
  FROM links l JOIN own o ON o.k = l.k JOIN d t ON t.k = l.target
  WHERE t.h1 IS NOT NULL AND t.h1 <> o.name AND t.cash IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k, place) AS rn FROM every)
SELECT k AS page_id, name, cash_price, installment_price, 'shop_c' AS source FROM r WHERE rn = 1"""
ORACLE["job_buttons"] = f"""WITH {_BUTTONS}, r AS (SELECT *,
 row_number() OVER (PARTITION BY name ORDER BY page_id, place) AS rn FROM found)
SELECT name, cash_price, installment_price, 'shop_e' AS source FROM r WHERE rn = 1"""

_DISABLED = """disabled AS (SELECT DISTINCT l_orderkey AS page, l_partkey AS product_id FROM lineitem
 JOIN part ON l_partkey = p_partkey WHERE p_size < 5 AND l_returnflag = 'A')"""
_PRICES = """prices AS (SELECT p_partkey AS product_id,
 CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_retailprice END AS cash_price,
 CASE WHEN p_size % 2 = 0 THEN p_retailprice + 30 END AS installment_price FROM part WHERE p_size % 10 <> 0)"""


def _option_pairs(disabled: bool) -> str:
    off = (
        "WHERE NOT EXISTS (SELECT 1 FROM disabled d WHERE d.page = l_orderkey AND d.product_id = l_partkey)"
        if disabled
        else ""
    )
    return f"""s AS (SELECT l_orderkey AS page, l_returnflag AS storage, l_partkey AS product_id,
  min(cast(l_linenumber AS BIGINT) * 1000000000 + l_partkey) AS pos FROM lineitem {off} GROUP BY ALL),
 m AS (SELECT DISTINCT l_orderkey AS page, l_linestatus AS ram, l_partkey AS product_id FROM lineitem),
 opts AS (SELECT s.page, storage, ram, s.product_id, row_number() OVER (PARTITION BY s.page, storage, ram
  ORDER BY pos) AS rn FROM s JOIN m ON s.page = m.page AND s.product_id = m.product_id)"""


ORACLE["option_intersection"] = f"""WITH {_DISABLED}, {_option_pairs(True)}
SELECT page, storage, ram, product_id FROM opts WHERE rn = 1"""
ORACLE["disabled_anti"] = f"""WITH {_DISABLED}
SELECT l_orderkey AS page, l_returnflag AS option, l_partkey AS product_id FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM disabled d WHERE d.page = l_orderkey AND d.product_id = l_partkey)"""
ORACLE["variant_price_join"] = f"""WITH {_PRICES}, {_option_pairs(False)}
SELECT page, storage, ram, product_id, cash_price, installment_price
FROM opts JOIN prices USING (product_id) WHERE rn = 1 AND cash_price <> 0"""
ORACLE["sim_storage_variants"] = f"""WITH {_PRICES},
 o AS (SELECT l_orderkey AS page, l_linenumber AS opt, l_partkey AS product_id,
  {pick('l_linenumber % 4', ['eSim', 'Nano-Sim', 'eSim', 'Nano-Sim'])} AS sim,
  {pick('l_linenumber % 3', ['128GB', '256GB', '512GB'])} AS storage FROM lineitem),
 options AS (SELECT DISTINCT page, opt, sim, storage FROM o),
 crossed AS (SELECT a.page, a.opt AS sim_opt, b.opt AS storage_opt, a.sim, b.storage,
  row_number() OVER (PARTITION BY a.page, a.sim, b.storage ORDER BY a.opt, b.opt) AS rn
  FROM options a JOIN options b ON a.page = b.page),
 matched AS (SELECT c.page, c.sim, c.storage, x.product_id, row_number() OVER (
   PARTITION BY c.page, c.sim, c.storage ORDER BY x.product_id) AS rn
  FROM crossed c JOIN o x ON x.page = c.page AND x.opt = c.storage_opt
  WHERE c.rn = 1 AND EXISTS (SELECT 1 FROM o y WHERE y.page = c.page AND y.opt = c.sim_opt
   AND y.product_id = x.product_id))
SELECT page, storage, sim, product_id, cash_price, installment_price
FROM matched JOIN prices USING (product_id) WHERE rn = 1 AND cash_price <> 0"""
ORACLE["variants_or_simple"] = f"""WITH {_DISABLED}, {_PRICES}, {_option_pairs(True)},
 v AS (SELECT page, cash_price FROM opts JOIN prices USING (product_id) WHERE rn = 1 AND cash_price <> 0)
SELECT * FROM v UNION ALL SELECT o_orderkey, o_totalprice FROM orders
WHERE o_totalprice > 100000 AND o_orderkey NOT IN (SELECT page FROM v)"""

ORACLE["snapshot_roundtrip"] = (
    f"WITH {_OFFERS} SELECT source, name, cash_price, installment_price FROM offers"
)
ORACLE["snapshot_one"] = (
    f"WITH {_OFFERS} SELECT source, name, cash_price, installment_price FROM offers"
    " WHERE source = 'shop_c'"
)
ORACLE["snapshot_all"] = f"""WITH {_OFFERS}, {_DIM} SELECT source, cast(rank AS INTEGER) AS source_rank,
 count(*) AS offers, min(cash_price) AS lowest FROM offers JOIN dim USING (source) GROUP BY ALL"""
ORACLE["snapshot_keep_old"] = f"""WITH {_OFFERS} SELECT source, count(*) AS offers,
 max(cash_price) AS highest FROM offers WHERE source IN ('shop_b', 'shop_d') OR cash_price < 20000
GROUP BY source"""
ORACLE["stored_report"] = f"""{_M} SELECT 1::INTEGER AS run,
 row_number() OVER (ORDER BY first_ord) AS n, product_key, head AS alert_key FROM msgs WHERE has_alert"""
ORACLE["snapshot_clear"] = f"""WITH {_OFFERS} SELECT source, count(*) AS offers FROM offers
WHERE source NOT IN ('shop_b', 'shop_c') GROUP BY source"""

_PARTS = f"""WITH {_OFFERS}, parts AS (SELECT *, year(l_shipdate) % 4 AS part, 'shop_' || ['b', 'c', 'd', 'e'][part + 1] AS left_out
 FROM offers), kept AS (SELECT * FROM parts WHERE source <> left_out)"""
ORACLE["store_as_of"] = f"""{_PARTS},
runs AS (SELECT TIMESTAMP '2024-03-01 12:00:00' + to_hours(h) AS run, least(h // 24, 3) AS last
 FROM unnest(range(0, 108, 6)) t(h)),
latest AS (SELECT run, last, source, max(part) AS part FROM runs JOIN (SELECT DISTINCT source, part FROM kept) k
 ON k.part <= last GROUP BY ALL)
SELECT strftime(run, '%Y-%m-%d %H:%M') AS run, last + 1 AS version, source, count(*) AS offers, min(cash_price) AS lowest
FROM latest JOIN kept USING (source, part) GROUP BY ALL"""


def _job(name: str, source: str, page: str = "page_id", place: str = "place") -> str:
    """Offers of a job's SQL with their place, of which every offer has one number."""
    with_, select = ORACLE[name].rsplit("SELECT", 1)
    rows = select.split("FROM", 1)[1]
    return (
        f"(SELECT * FROM ({with_} SELECT {lit(source)} AS source, name, cash_price, installment_price,"
        f" {page}::BIGINT AS a, {place}::BIGINT AS b FROM {rows}))"
    )


_CATALOG_JOB = f"""(SELECT * FROM (WITH {_CATALOG} SELECT 'shop_c' AS source, name, cash_price, installment_price,
 page::BIGINT AS a, pos::BIGINT AS b FROM rows))"""
_PAGE_OFFERS = f"""offers AS (SELECT *, row_number() OVER (ORDER BY source, a, b) AS ord FROM (
 {_job('job_detail_links', 'anchor', 'k')} UNION ALL {_job('job_ram_config', 'shop_b')}
 UNION ALL {_CATALOG_JOB} UNION ALL {_job('job_sim_config', 'shop_d')} UNION ALL {_job('job_buttons', 'shop_e')}))"""
ORACLE["pages_to_report"] = f"""WITH {_PAGE_OFFERS}, {groups()}, {_DIM}, {messages()}, numbered AS (
 SELECT row_number() OVER (ORDER BY first_ord) AS n, * FROM msgs WHERE has_alert)
SELECT n, product_key, head AS alert_key, cast(n AS VARCHAR) || '. ' || message AS message FROM numbered"""

_FEED = f"""feed AS (SELECT ts, date_trunc('hour', ts) AS run,
 CASE event_type {' '.join(f"WHEN '{e}' THEN '{s}'" for e, s in zip(EVENT_SOURCES, SOURCE_IDS, strict=True))}
 END AS source, 'product ' || (user_id % 20) AS product_key, value AS cash_price, event_id AS ord
 FROM events)"""
_ALL_SOURCES = "known AS (SELECT unnest([" + ", ".join(
    lit(s) for s in [*SOURCE_IDS, "shop_f"]
) + "]) AS source)"
ORACLE["last_updated"] = f"""WITH {_FEED} SELECT source, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM feed
GROUP BY source"""
ORACLE["snapshot_status"] = f"""WITH {_FEED}, {_ALL_SOURCES},
 s AS (SELECT source, count(*) AS offers, max(ts) AS seen_at FROM feed GROUP BY source)
SELECT source, seen_at IS NOT NULL AS found, offers,
 cast(floor((epoch_us(TIMESTAMP '{STAMP}') - epoch_us(seen_at)) / 60e6 + 0.5) AS BIGINT) AS age_minutes
FROM known LEFT JOIN s USING (source)"""
ORACLE["stale_sources"] = f"""WITH {_FEED}, {_ALL_SOURCES},
 s AS (SELECT source, max(ts) AS seen_at FROM feed GROUP BY source)
SELECT source FROM known LEFT JOIN s USING (source)
WHERE seen_at IS NULL OR epoch_us(TIMESTAMP '{STAMP}') - epoch_us(seen_at) > 15 * 60 * 1000000"""
ORACLE["alert_sink"] = f"{_M} SELECT product_key, message FROM msgs WHERE has_alert"

ORACLE["alert_delivery"] = f"""{_M}, tries AS (SELECT a.attempt, product_key, head AS alert_key, length(message) AS size,
  length(message) % a.divisor = 0 AS bad FROM msgs, (VALUES (1, 3), (2, 6), (3, 6)) AS a(attempt, divisor) WHERE has_alert)
SELECT attempt, product_key, alert_key, CASE WHEN bad THEN 'failed' ELSE 'sent' END AS status,
 CASE WHEN bad THEN 'ValueError: ' || size || ' characters' END AS error
FROM tries WHERE attempt = 1 OR (attempt = 2 AND size % 3 = 0) OR (attempt = 3 AND size % 6 = 0)"""

_LOCAL_HOUR = "extract(hour FROM {ts} + INTERVAL 4 HOUR)"


def run_class(ts: str) -> str:
    hour = _LOCAL_HOUR.format(ts=ts)
    return (
        f"CASE WHEN {hour} = 6 THEN 'collect' WHEN {hour} = 9 THEN 'full'"
        f" WHEN {hour} BETWEEN 10 AND 23 THEN 'new_only' ELSE 'idle' END"
    )


ORACLE["run_classes"] = f"SELECT event_id, {run_class('ts')} AS run_class FROM events"

_ASOF = f"""{_FEED}, runs AS (SELECT DISTINCT run FROM feed),
taken AS (SELECT DISTINCT source, run AS snap FROM feed),
seen AS (SELECT r.run, t.source, max(t.snap) AS snapshot_run FROM runs r JOIN taken t ON t.snap <= r.run
 GROUP BY r.run, t.source)"""
_RUN_ALERTS = f"""{_ASOF},
hourly AS (SELECT run, source, product_key, min(cash_price) AS cash FROM feed GROUP BY ALL),
visible AS (SELECT s.run, s.source, h.product_key, h.cash FROM seen s
 JOIN hourly h ON h.source = s.source AND h.run = s.snapshot_run),
alerts AS (SELECT DISTINCT a.run, a.product_key FROM visible a JOIN visible c
 ON a.run = c.run AND a.product_key = c.product_key AND a.source = 'anchor' AND c.source <> 'anchor'
 WHERE {alert('a.cash', 'c.cash', FEED_FLAT)}),
numbered AS (SELECT run, lag(run) OVER (ORDER BY run) AS before FROM runs),
fresh AS (SELECT a.run, a.product_key FROM alerts a JOIN numbered n ON n.run = a.run
 WHERE NOT EXISTS (SELECT 1 FROM alerts p WHERE p.run = n.before AND p.product_key = a.product_key))"""


def minute(e: str) -> str:
    return f"strftime({e}, '%Y-%m-%d %H:%M')"


ORACLE["asof_snapshots"] = (
    f"WITH {_ASOF} SELECT {minute('run')} AS run, source, {minute('snapshot_run')} AS snapshot_run FROM seen"
)
ORACLE["new_alerts_by_run"] = (
    f"WITH {_RUN_ALERTS} SELECT {minute('run')} AS run, product_key FROM fresh"
)
ORACLE["alert_counts"] = f"""WITH {_RUN_ALERTS}, n AS (SELECT run, count(*) AS new_alerts FROM fresh GROUP BY run)
SELECT {minute('a.run')} AS run, count(*) AS alerts, coalesce(any_value(n.new_alerts), 0) AS new_alerts
FROM alerts a LEFT JOIN n ON n.run = a.run GROUP BY a.run"""
ORACLE["alerts_by_schedule"] = f"""WITH {_RUN_ALERTS},
 sched AS (SELECT run, {run_class('run')} AS run_class, cast(run + INTERVAL 4 HOUR AS DATE) AS day FROM runs),
 sends AS (SELECT *, lag(run) OVER (PARTITION BY day ORDER BY run) AS before FROM sched
  WHERE run_class IN ('full', 'new_only'))
SELECT {minute('a.run + INTERVAL 4 HOUR')} AS run, a.product_key, s.run_class
FROM alerts a JOIN sends s ON s.run = a.run
WHERE s.run_class = 'full' OR NOT EXISTS (
 SELECT 1 FROM alerts p WHERE p.run = s.before AND p.product_key = a.product_key)"""
ORACLE["asof_events"] = f"""WITH {_FEED}, asked AS (SELECT ts, ord, s.source FROM feed,
  (SELECT unnest([{', '.join(lit(x) for x in SOURCE_IDS[1:])}]) AS source) s WHERE feed.source = 'anchor'),
 taken AS (SELECT source, ts, max(ord) AS last_ord, arg_max(cash_price, ord) AS last_price FROM feed GROUP BY source, ts)
SELECT a.ord, a.source, t.last_ord, t.last_price FROM asked a
ASOF LEFT JOIN taken t ON t.source = a.source AND a.ts >= t.ts"""
_CHANGED = _OFFERS.replace("offers AS (", "every_offer AS (", 1).replace("  l_shipdate,", "  l_shipdate, l_orderkey,")
ORACLE["delta_products"] = f"""WITH {_CHANGED}, offers AS (SELECT * REPLACE (CASE WHEN source = 'shop_c'
  THEN cash_price * 0.5e0 ELSE cash_price END AS cash_price) FROM every_offer WHERE source <> 'shop_c' OR l_orderkey % 2 = 0),
 {groups()}, {_DIM}, {messages()} SELECT product_key, has_alert, message FROM msgs"""
_CLOSED = "run + INTERVAL 1 HOUR <= (SELECT max(ts) FROM feed) - INTERVAL 1 HOUR"
ORACLE["stream_new_alerts"] = (
    f"WITH {_RUN_ALERTS} SELECT {minute('run')} AS run, product_key FROM fresh WHERE {_CLOSED}"
)
ORACLE["stream_pages"] = f"""WITH second AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(html, '<h1>', '<h1>New ')
  ELSE html END AS html, CASE WHEN page_id % 3 = 0 AND contains(html, '<h1>') THEN 2 ELSE 1 END AS times FROM pages)
SELECT page_id, times::BIGINT AS times, nullif({_H1}, '') AS name FROM second"""
ORACLE["stream_new_alerts_ended"] = ORACLE["new_alerts_by_run"]
ORACLE["stream_snapshots_ended"] = f"""WITH {_FEED},
 latest AS (SELECT source, max(run) AS run FROM feed GROUP BY source)
SELECT c.source, {minute('c.run')} AS run, product_key, min(cash_price) AS cash_price
FROM feed c JOIN latest l ON c.source = l.source AND c.run = l.run GROUP BY ALL"""
# Offers as each run sees them; the run is part of the keys, so one report is made for all runs.
_TITLE_FEED = """feed AS (SELECT ts, date_trunc('hour', ts) AS run, CASE event_type {cases} END AS source,
 CASE event_id % 4 WHEN 0 THEN 'Apple iPhone ' || (user_id % 20) || ' 128 ГБ'
  WHEN 1 THEN 'iPhone ' || (user_id % 20) || ' 128GB (Nano-SIM)'
  WHEN 2 THEN 'iphone ' || (user_id % 20) || ' 128gb Black'
  ELSE 'iPhone ' || (user_id % 20) || ' 128GB eSIM' END AS name,
 value AS cash_price, CASE WHEN event_id % 5 = 0 THEN value + 3 END AS installment_price, event_id AS id FROM events)""".format(
    cases=" ".join(f"WHEN '{e}' THEN '{s}'" for e, s in zip(EVENT_SOURCES, SOURCE_IDS, strict=True))
)
_RUN_BEST = f"""runs AS (SELECT DISTINCT run FROM feed),
taken AS (SELECT DISTINCT source, run AS snap FROM feed),
seen AS (SELECT r.run, t.source, max(t.snap) AS snap FROM runs r JOIN taken t ON t.snap <= r.run GROUP BY ALL),
{steps('feed', _RULES)},
offers AS (SELECT s.run, f.source, f.name, f.cash_price, f.installment_price, d.rank * 1000000000000 + f.id AS ord,
  k.v AS key, {match_key('k.v')} AS base
 FROM seen s JOIN feed f ON f.source = s.source AND f.run = s.snap JOIN t{len(_RULES)} k ON k.name = f.name
 JOIN dim d ON d.source = f.source),
canon AS (SELECT run, base, coalesce(arg_min(key, ord) FILTER (WHERE key <> base), base) AS product,
  min(ord) AS seen_first FROM offers GROUP BY run, base),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run, base, source
  ORDER BY coalesce(cash_price, 'infinity'::DOUBLE), ord) AS rn FROM offers),
tbest AS (SELECT r.run || '|' || base AS base_key, r.run || '|' || product AS product_key, seen_first AS first_ord,
  source, name, cash_price, installment_price FROM ranked r JOIN canon USING (run, base) WHERE rn = 1)"""


def flat_limit(sql: str, flat: float) -> str:
    """The same SQL with another flat limit."""
    return sql.replace("> 3000.0e0", f"> {flat}e0")


ORACLE["stream_reports"] = f"""WITH {_DIM}, {_TITLE_FEED}, {_RUN_BEST}, {flat_limit(messages(), FEED_FLAT)},
alerting AS (SELECT split_part(product_key, '|', 1)::TIMESTAMP AS run, split_part(product_key, '|', 2) AS product_key,
  first_ord, head AS alert_key, message FROM msgs WHERE has_alert),
numbered AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY first_ord) AS n FROM alerting),
before AS (SELECT run, lag(run) OVER (ORDER BY run) AS earlier FROM runs)
SELECT {minute('m.run')} AS run, n, product_key, alert_key, cast(n AS VARCHAR) || '. ' || message AS message
FROM numbered m JOIN before b ON b.run = m.run
WHERE NOT EXISTS (SELECT 1 FROM numbered p WHERE p.run = b.earlier AND p.alert_key = m.alert_key)"""
ORACLE["stream_late_rows"] = """WITH arrived AS (SELECT event_id % 3 AS batch, event_id, ts FROM events),
 newest AS (SELECT batch, max(ts) AS newest FROM arrived GROUP BY batch),
 until AS (SELECT a.batch, max(b.newest) - INTERVAL 1 HOUR AS until FROM newest a
  LEFT JOIN newest b ON b.batch < a.batch GROUP BY a.batch),
 marked AS (SELECT *, coalesce(date_trunc('hour', ts) + INTERVAL 1 HOUR <= until, false) AS late
  FROM arrived JOIN until USING (batch))
SELECT batch::INTEGER AS batch, count(*) AS rows, count(*) FILTER (WHERE late) AS late,
 count(*) FILTER (WHERE late) AS listed, coalesce(sum(event_id) FILTER (WHERE late), 0)::BIGINT AS ids
FROM marked GROUP BY batch"""
ORACLE["stream_snapshots"] = f"""WITH {_FEED},
 closed AS (SELECT * FROM feed WHERE {_CLOSED}),
 latest AS (SELECT source, max(run) AS run FROM closed GROUP BY source)
SELECT c.source, {minute('c.run')} AS run, product_key, min(cash_price) AS cash_price
FROM closed c JOIN latest l ON c.source = l.source AND c.run = l.run GROUP BY ALL"""

ORACLE["new_alerts"] = f"""WITH {_OFFERS},
 earlier AS (SELECT * FROM offers WHERE l_shipdate < TIMESTAMP '2000-01-01 00:00:00'),
 {groups('offers', 't')}, {groups('earlier', 'e')}, {_DIM}, {messages('t')}, {messages('e', '_e')}
SELECT product_key, head AS alert_key FROM msgs WHERE has_alert
 AND head NOT IN (SELECT head FROM msgs_e WHERE has_alert)"""

ORACLE["variant_counts"] = f"SELECT page, count(*) AS variants FROM ({ORACLE['option_intersection']}) GROUP BY page"
ORACLE["next_page"] = "SELECT p_partkey AS page_id, p_partkey % 5 IN (0, 4) AS has_next FROM part"
