"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import collocations, contamination, media, mixing, pii, quality, repeats, sharding, similarity, token_counts, toxicity, tries, urls
from .tables import bucket, table

#: The rules of the URL query: verdict, host, beginning of the path.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def _folded(scored: DataFrame, folds: int, held: int) -> DataFrame:
    return scored.select(
        "doc_id",
        F.coalesce(bucket("doc_id", folds) == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(bucket("doc_id", 3) != 1)
    return _folded(quality.score(docs, quality.train(docs, labels)), 3, 1)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents, with the totals that they reach and should reach.

    ``residual`` is the sum of all differences as a share of the targets."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    labels = mixing.domain(table(spark, sf_dir, "labels"))
    rates, reached, goal = mixing.mixed(docs, labels)
    shares = [F.round(F.get("posteriors", F.lit(k)), 6).alias(f"p_{d}") for k, d in enumerate(reached)]
    sums = [F.lit(float(v[d])).alias(f"{n}_{d}") for n, v in (("total", reached), ("target", goal)) for d in v]
    off = sum(abs(reached[d] - goal[d]) for d in goal) / max(sum(goal.values()), 1.0)
    sums.append(F.lit(off).alias("residual"))
    return rates.select("doc_id", "tokens", *shares, F.round("rate", 6).alias("rate"), *sums)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(bucket("doc_id", 5) != 0)
    return _folded(toxicity.score(docs, toxicity.train(docs, labels)), 5, 0)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return similarity.jaccard_classes(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return media.media_report(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return contamination.report(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after a clean-up of their first and last lines."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    edited = docs.withColumn("edits", token_counts.line_edits())
    return token_counts.counted(edited).drop("sums")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return tries.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return repeats.report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_mixing": op2_mixing,
    "op3_pii": op3_pii,
    "op4_sharding": op4_sharding,
    "op5_toxicity": op5_toxicity,
    "op6_url_filter": op6_url_filter,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_media": op8_media,
    "op9_decontamination": op9_decontamination,
    "op10_token_counts": op10_token_counts,
    "op11_collocations": op11_collocations,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_suffix_dedup": op13_suffix_dedup,
}

_HOST_PATH = """
    SELECT page_id,
           CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
    FROM pages
"""

# The remainders of the crc32 polynomial for four bits: fixed values.
_CRC_NIBBLES = """[0::BIGINT, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
    3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"""

# Bytes of ASCII text as nibbles, low ones first; each takes one step of the remainder.
_CRC32 = f"""(4294967295 - list_reduce(
    [4294967295::BIGINT] || flatten([[ascii(c)::BIGINT & 15, ascii(c)::BIGINT >> 4] FOR c IN string_split(conv_id::VARCHAR, '')]),
    lambda crc, n: xor(({_CRC_NIBBLES})[(xor(crc, n) & 15) + 1], crc >> 4)))"""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Links between different documents that share at least one shingle, then everything reachable.
_JACCARD = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * common >= 80 * (x.n + y.n - common)
),
reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
),
"""

# Windows of ten words of the benchmark (whole items that have fewer), and their places in documents.
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WINDOWS = f"""
WITH words AS (
    SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents
),
item_words AS (
    SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark
),
windows AS (
    SELECT DISTINCT item_id, w[i:i + 9] AS w
    FROM item_words, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0
),
places AS (
    SELECT doc_id, i, size, w[i:i + size - 1] AS w
    FROM words, (SELECT DISTINCT len(w) AS size FROM windows) z, unnest(range(1, len(w) - size + 2)) t(i)
),
hits AS (SELECT DISTINCT p.doc_id, p.i, p.size, x.item_id FROM places p JOIN windows x ON x.w = p.w),
covered AS (
    SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + size)) t(j) GROUP BY doc_id
),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
    FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
),
"""

# The three rarest words of each window, and documents where they stand within ten words of the rarest.
_NEAR = """
spots AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS at FROM words),
frequency AS (SELECT term, count(*) AS n FROM spots GROUP BY term),
distinct_windows AS (SELECT w, row_number() OVER () AS id FROM (SELECT DISTINCT w FROM windows)),
asked AS (SELECT id, unnest(w) AS term, generate_subscripts(w, 1) AS k FROM distinct_windows),
rarest AS (
    SELECT id, a.term, row_number() OVER (PARTITION BY id ORDER BY coalesce(n, 0), k) AS rank
    FROM asked a LEFT JOIN frequency f ON f.term = a.term
    QUALIFY rank <= 3
),
wanted AS (SELECT id, count(*) AS terms FROM rarest GROUP BY id),
met AS (
    SELECT x.doc_id, r.id, x.at
    FROM rarest r JOIN spots x ON x.term = r.term AND r.rank = 1
    JOIN rarest o ON o.id = r.id JOIN spots y ON y.doc_id = x.doc_id AND y.term = o.term AND abs(y.at - x.at) <= 10
    JOIN wanted t ON t.id = r.id
    GROUP BY x.doc_id, r.id, x.at, t.terms HAVING count(DISTINCT o.rank) = t.terms
),
near AS (SELECT doc_id, count(DISTINCT id) AS n_near FROM met GROUP BY doc_id)
"""

ORACLE: dict[str, str] = {
    "op7_ngram_jaccard": f"""{_JACCARD}
components AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN components c ON c.doc_id = d.doc_id
LEFT JOIN counted l ON l.doc_id = d.doc_id
""",
    "op9_decontamination": f"""{_WINDOWS}{_NEAR}
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near, 0)::BIGINT AS n_near
FROM words w LEFT JOIN covered c ON c.doc_id = w.doc_id LEFT JOIN items i ON i.doc_id = w.doc_id
LEFT JOIN near n ON n.doc_id = w.doc_id
""",
    "op11_collocations": f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents
),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
counted AS (
    SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f
    FROM words, unnest(range(1, 5)) s(size), unnest(range(1, len(w) - size + 2)) p(i)
    GROUP BY ALL
),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE f >= 30),
cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r,
           (2000000::HUGEINT * c.f) // (x.f + y.f) AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM often WHERE size > 1) c
    JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
    JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
covered AS (
    SELECT lang, array_to_string(w[i:i + part - 1], ' ') AS phrase, max(f) AS most
    FROM often, unnest(range(2, size)) s(part), unnest(range(1, size - part + 2)) p(i)
    WHERE size > 2 GROUP BY ALL
),
ranked AS (
    SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
    FROM scored s LEFT JOIN covered c ON c.lang = s.lang AND c.phrase = s.phrase
    WHERE most IS NULL OR 100 * most < 80 * a
)
SELECT r.lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
""",
    "op12_prefix_trie": f"""
WITH own AS (
    SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
                         ORDER BY turn NULLS FIRST, role, text) AS turns, {_CRC32} % 4 AS h
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
rebuilt AS (
    SELECT c.conv_id, coalesce(b.turns, [])[1:c.h] || c.turns[c.h + 1:] AS turns
    FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
),
prefixes AS (
    SELECT conv_id, len(turns) AS total, d, turns[1:d] AS prefix
    FROM rebuilt, unnest(range(len(turns) + 1)) t(d)
),
nodes AS (
    SELECT d AS depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
           (count(*) - 1) * coalesce(len(regexp_extract_all(prefix[d]['text'], '[^\\x20\\x09-\\x0D]+')), 0) AS saved,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (total = d), '')) AS ends_sha256
    FROM prefixes GROUP BY d, prefix
),
children AS (
    SELECT depth - 1 AS depth, prefix[1:depth - 1] AS prefix, count(*) AS n_children
    FROM nodes WHERE depth > 0 GROUP BY 1, 2
),
full_nodes AS (
    SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (depth, prefix)
),
subtrees AS (
    SELECT a AS depth, prefix[1:a] AS prefix, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens
    FROM full_nodes, unnest(range(depth + 1)) t(a) GROUP BY 1, 2
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       n.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens,
       n.ends_sha256
FROM full_nodes n JOIN subtrees s USING (depth, prefix)
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
""",
    "op6_url_filter": f"""
WITH cut AS ({_HOST_PATH}),
parts AS (
    SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^?#]*') AS body FROM cut
),
urls AS (
    SELECT page_id,
           translate(regexp_extract(body, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz') AS host,
           substr(body, length(regexp_extract(body, '^[^/]*')) + 1) AS path
    FROM parts
)
SELECT page_id, host, path,
       CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org'))
                 AND starts_with(path, '/es/') THEN 'example.org/es/'
            WHEN (host = 'example.org' OR ends_with(host, '.example.org'))
                 AND starts_with(path, '/en/1') THEN 'example.org/en/1'
            WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
            WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
            WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
       END AS rule,
       CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org'))
                 AND (starts_with(path, '/es/') OR starts_with(path, '/en/1')) THEN 'block'
            WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'block'
            ELSE 'allow' END AS verdict
FROM urls
""",
}
