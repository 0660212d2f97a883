"""Personal data, token counts, media, url rules: each against a plain form of the same rule."""

import hashlib
import io
import pickle
import random
import re
import time
import wave
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.llm import media, pii, token_counts, urls
from pricelens.llm.queries import URL_RULES

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_luhn(digits):
    doubled = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def plain_spans(text):
    found = {}
    for kind, pattern in PATTERNS.items():
        found[kind] = []
        for m in pattern.finditer(text):
            digits = [c for c in m.group() if c in "0123456789"]
            good = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda d=digits: 12 <= len(d) <= 19 and plain_luhn(d),
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]()
            if good:
                found[kind].append(m.span())
    return found


def test_base_kinds_like_the_patterns():
    rng, anchors = random.Random(1), pii.automaton()
    for _ in range(6000):
        text = "".join(rng.choice("0123456789 .-+@ab()%é1.1@") for _ in range(rng.randrange(60)))
        found = pii.spans(text, anchors)
        assert {k: found[k] for k in pii.BASE} == plain_spans(text), text


def test_personal_data_rows(docs, clashing):
    text = 'a.b@c.de 10.0.0.255, 4111 1111-1111 1111, +1 (555) 123-4567 "Token": ab12cd34 see https://x.y/z?q=1.'
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, "é" * 1000 + " x@y.z"), (5, "1" * 100_000 + "@" * 1000)]
    found = {}
    for r in pii.personal_data(clashing(docs(rows))).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert len(found[1]) == 2 and found[1][0] == found[1][1]
    first = found[1][0]
    assert (first.n_email, first.n_ip, first.n_card, first.n_phone) == (1, 1, 1, 1)
    spans = [s.split(":") for s in first.spans.split(",")]
    assert {(k, text[int(a) : int(b)]) for k, a, b in spans} >= {
        ("account", "ab12cd34"), ("url", "https://x.y/z?q=1"), ("phone", "+1 (555) 123-4567"),
    }
    base = ",".join(":".join(s) for s in spans if s[0] in pii.BASE)
    assert first.base_sha256 == sha256(base.encode()).hexdigest()
    assert found[2][0].spans == found[3][0].spans == "" and found[2][0].base_sha256 == sha256(b"").hexdigest()
    assert found[None][0].spans == "email:1001:1006"
    assert pii.personal_data(docs([])).collect() == []


def test_masked_text(docs):
    found = pii.masked(docs([(1, "to a@b.co, now"), (2, None), (3, "")])).collect()
    assert {r.doc_id: r.text for r in found} == {1: "to <email>, now", 2: None, 3: ""}
    assert [r.lang for r in found] == ["en"] * 3


PIECES = ["Hello", "wörld", "it's", "123", "foo!!", "   ", "\n", "\n\n", " ", "\t", "a", "###", "don't", "\x85", "　"]


def test_counts_follow_edits():
    rng, count = random.Random(2), token_counts.counter()
    for _ in range(300):
        text = "".join(rng.choice(PIECES) + rng.choice([" ", "", "\n"]) for _ in range(rng.randrange(150)))
        at = token_counts.cuts(text, rng.choice([3, 20, 80]))
        parts = [text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        tree = token_counts.Tree.of([len(p) for p in parts], count(parts))
        assert tree.tokens == count([text])[0]
        for _ in range(3):
            start = rng.randrange(len(text) + 2) - 1
            put = rng.choice(["", " ", "\n", "xyz", " new words ", "'s"])
            text, encoded = token_counts.edit(tree, text, (start, start + rng.choice([0, 1, 5, 60]), put), count)
            assert (tree.tokens, tree.length) == (count([text])[0], len(text))
            leaves = tree.sums[:, tree.leaves :]
            assert leaves.sum(axis=1).tolist() == tree.sums[:, 1].tolist()


def test_only_touched_regions_are_encoded():
    seen = []

    def count(texts):
        seen.extend(texts)
        return [len(t.split()) for t in texts]

    text = "word " * 20_000
    tree = token_counts.build(text, count)
    seen.clear()
    token_counts.edit(tree, text, (50_000, 50_004, "other"), count)
    assert sum(map(len, seen)) < 4 * token_counts.SEGMENT


def test_token_count_rows(docs):
    count = token_counts.counter()
    texts = ["head line\nbody of it\nlast line here", "one line only", None, "", "x" * 50_000, "a\nb"]
    frame = docs(list(enumerate(texts))).withColumn("edits", token_counts.line_edits())
    for row, edited in zip(
        sorted(token_counts.counted(frame).collect()), sorted(frame.select("doc_id", "text", "edits").collect()), strict=True
    ):
        text = edited.text or ""
        after, limit = text, len(text)
        for e in sorted(edited.edits, reverse=True):  # an earlier edit ends where a later one begins
            after = after[: e.start] + e.put + after[max(e.start, min(e.end, limit)) :]
            limit = e.start
        assert (row.n_tokens, row.n_tokens_edited) == tuple(count([text, after]))
        assert row.n_chars_edited == len(after)
    none = frame.withColumn("edits", F.lit(None).cast("array<struct<start:int,end:int,put:string>>"))
    assert all(r.n_edits == 0 and r.n_tokens == r.n_tokens_edited for r in token_counts.counted(none).collect())
    assert token_counts.counted(frame.where("doc_id < 0")).collect() == []


def test_media_round_trip(docs, clashing):
    rows = [(1, "été " * 100), (2, None), (3, ""), (4, "été " * 100), (5, "x" * 192), (6, "y" * 1_000_000)]
    found = {r.doc_id: r for r in media.media_report(clashing(docs(rows))).collect()}
    for i, text in rows:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = found[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        file = io.BytesIO(media.to_wav(payload))
        with wave.open(file) as w:
            assert w.readframes(w.getnframes()) == payload
        assert (r.media_bytes, r.media_sha256) == (len(file.getvalue()), sha256(file.getvalue()).hexdigest())
    assert found[1].feature == found[4].feature != found[5].feature
    assert media.media_report(docs([])).collect() == []


def test_peaks_of_two_tones():
    time = np.arange(media.BLOCK * 20)
    for low, high in ((8, 30), (12, 50)):
        wave_ = 128 + 50 * np.sin(2 * np.pi * low * time / media.BLOCK) + 40 * np.sin(2 * np.pi * high * time / media.BLOCK)
        _, tones = media.peaks(np.rint(wave_).astype(np.uint8))
        assert set(tones.tolist()) == {low, high}
        codes = media.fingerprints(np.rint(wave_).astype(np.uint8))
        assert {(c >> 9 & 127, c >> 2 & 127) for c in codes.tolist()} <= {(a, b) for a in (low, high) for b in (low, high)}


def test_long_sound_in_stretches(monkeypatch):
    samples = np.random.default_rng(1).integers(0, 256, 96 * 500).astype(np.uint8)
    whole = media.fingerprints(samples)
    monkeypatch.setattr(media, "STRETCH", 7)
    assert media.fingerprints(samples).tolist() == whole.tolist()


def plain_verdict(host, path):
    fits = [
        (h.count("."), len(p), h + p, v) for v, h, p in URL_RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[2:] if fits else (None, "allow")


def test_urls(spark):
    rng = random.Random(3)
    hosts = ["org", "example.org", "A.Example.ORG", "xexample.org", "com", "q.com", "example.com.", "a..com", "net", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/x", "/fr/1", "/de/", "//de/", "/en/1?x", "#/de/", "?a=/de/"]
    rows = [(k, f"http://{rng.choice(hosts)}{rng.choice(paths)}") for k in range(300)]
    rows += [(900, None), (901, "no scheme/de/"), (902, ""), (902, ""), (None, "x://y://com/de/"), (903, "http://" + "a" * 99_999)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("rule", F.lit(1)).withColumn("host", F.lit(2))
    given = sorted(((i or -1), u or "") for i, u in rows)
    found = sorted(((r.page_id or -1), r.host, r.path, r.rule, r.verdict) for r in urls.judge(frame, URL_RULES).collect())
    expected = []
    for i, u in given:
        rest = u.split("://", 1)[1] if "://" in u else ""
        rest = re.split("[?#]", rest)[0]
        host = rest.split("/")[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        path = rest[len(host) :]
        expected.append((i, host, path, *plain_verdict(host, path)))
    assert found == sorted(expected, key=lambda r: tuple(map(str, r))) or sorted(map(str, found)) == sorted(map(str, expected))
    assert urls.judge(frame.limit(0), URL_RULES).collect() == []


def test_trie_longest_match():
    trie = urls.Trie([("block", "a.b", "/x/y"), ("allow", "a.b", "/x/"), ("block", "b", "/"), ("allow", "b", "/x/yy")])
    assert trie.longest("q.a.b", "/x/yz") == ("a.b/x/y", "block")
    assert trie.longest("a.b", "/x/z") == ("a.b/x/", "allow")
    assert trie.longest("c.b", "/x/yyy") == ("b/x/yy", "allow")
    assert trie.longest("c.b", "") is None


def test_url_query_like_its_sql(spark):
    from pricelens.llm.queries import ORACLE, QUERIES
    from tests.oracle_check import compare, connect

    sf = "/root/testdata/sf0.001"
    assert compare(connect(sf), spark, sf, QUERIES["op6_url_filter"], ORACLE["op6_url_filter"]) == ""


def test_trees_are_kept_and_edited_again(spark, docs):
    """Stored trees give the counts of a fresh encoding after two rounds of edits."""
    count, rng = token_counts.counter(), random.Random(4)
    texts = [None, "", "a", "one line only " * 40, "é \n\n x" * 100, "word\n" * 300]
    texts += ["".join(rng.choice("ab .\n") for _ in range(2000)) for _ in range(4)]
    kept = token_counts.trees(docs(list(enumerate(texts))).withColumn("sums", F.lit("x")).withColumn("n_tokens", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "n_tokens", "n_segments", "sums"]
    for _ in range(2):
        size = F.coalesce(F.length("text"), F.lit(0))
        some = F.array(
            F.struct((size / 3).cast("int").alias("start"), (size / 3 + 2).cast("int").alias("end"), F.lit(" new\nput ").alias("put")),
            F.lit(None).cast("struct<start:int,end:int,put:string>"),
        )
        before = {r.doc_id: r for r in kept.collect()}
        found = token_counts.edited(kept.withColumn("edits", F.when(F.col("doc_id") != 0, some)))
        kept = found.select("doc_id", "text", "n_tokens", "n_segments", "sums")
        for r in found.collect():
            old = before[r.doc_id]
            own = old.text or ""
            new = own if r.doc_id == 0 else own[: len(own) // 3] + " new\nput " + own[int(len(own) / 3 + 2) :]
            assert (r.text or "") == new and (r.text is None) == (r.doc_id == 0)
            assert r.n_tokens == count([new])[0] and r.n_chars == len(new) and r.n_tokens_before == old.n_tokens
            assert r.n_chars_encoded <= 4 * token_counts.SEGMENT or len(own) < 8 * token_counts.SEGMENT or "\n" not in own
            assert r.sums[len(r.sums) // 2 + 1] == r.n_tokens


def test_one_long_line_is_cut_in_linear_time():
    text = "word " * 1_300_000
    start = time.perf_counter()
    at = token_counts.cuts(text)
    assert len(at) > 20_000 and time.perf_counter() - start < 3


def test_a_million_rules_on_one_host():
    rules = [("block", "a.example", f"/p{k}") for k in range(500_000)] + [("allow", "a.example", f"/x/{k}/") for k in range(500_000)]
    start = time.perf_counter()
    trie = urls.Trie(rules)
    assert trie.longest("b.a.example", "/p499999/more") == ("a.example/p499999", "block")
    assert trie.longest("a.example", "/x/77/y") == ("a.example/x/77/", "allow")
    assert time.perf_counter() - start < 30
    with pytest.raises(ValueError, match="more than"):
        urls.Trie([*rules, ("block", "c", "/")])
    copy = pickle.loads(pickle.dumps(urls.Trie([("block", "h", "/" + "s/" * 3000)])))  # deep, and sent to tasks
    assert copy.longest("h", "/" + "s/" * 3001)[1] == "block"


def test_fingerprint_arrays_of_the_query(docs):
    """The array of each row is that of its own samples, read back from the stored file."""
    texts = ["", None, "abc " * 100, "x" * 5000, "abc " * 100]
    for r in media.media_report(docs(list(enumerate(texts)))).collect():
        payload = media.padded((texts[r.doc_id] or "").encode())
        wanted = media.fingerprints(np.frombuffer(payload, np.uint8)).tolist()
        assert r.fingerprint == wanted
        assert r.feature == f"{len(wanted)}:" + hashlib.sha256(",".join(map(str, wanted)).encode()).hexdigest()


def test_cues_in_any_case_and_counts(docs):
    assert pii.spans("İİ TOKEN: ab12cd34", pii.automaton())["account"] == [(10, 18)]
    texts = ["ApiKey: ab12cd34", "Api_Key=ab12cd34", "my TOKEN = \"11acdfb36bb72224148e6160f674b4be45601bff\"", "see https://a.b/c", "plain", None]
    rows = {r.doc_id: r for r in pii.personal_data(docs(list(enumerate(texts)))).collect()}
    assert [rows[k].n_account for k in range(6)] == [1, 1, 1, 0, 0, 0] and rows[3].n_url == 1
    assert [rows[k].private for k in range(6)] == [True, True, True, False, False, False]
    assert [rows[k].n_spans for k in range(6)] == [len(rows[k].spans.split(",")) if rows[k].spans else 0 for k in range(6)]


def test_recall_of_planted_rows(docs):
    """Personal data written into prose: every kind is found in all of its usual spellings."""
    rng = random.Random(3)
    kinds = {
        "email": ["jane.doe+x@mail.example.org", "A_B%c@h-x.co"],
        "ip": ["192.168.0.17", "8.8.8.8"],
        "card": ["4111 1111 1111 1111", "5500-0055-5555-5559", "4012888888881881"],
        "phone": ["+1 (415) 555-0132", "+374 10 123456"],
        "account": ['token = "11acdfb36bb72224148e6160f674b4be45601bff"', "ApiKey: ab12cd34", "password=hunter22x", "IBAN DE89370400440532013000"],
        "url": ["https://example.org/a?b=1", "ftp://x.example/file"],
    }
    rows, truth = [], {}
    for k in range(300):
        kind = rng.choice(list(kinds))
        words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(30)]
        words.insert(rng.randrange(30), rng.choice(kinds[kind]))
        rows.append((k, " ".join(words)))
        truth[k] = kind
    found = pii.personal_data(docs(rows)).collect()
    assert all(r[f"n_{truth[r.doc_id]}"] >= 1 for r in found)
    clean = pii.personal_data(docs([(1, "plain words only, 12 of them. The year 1999; 3.5 kg")])).first()
    assert clean.n_spans == 0 and not clean.private
