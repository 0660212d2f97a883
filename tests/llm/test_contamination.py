import random
import re
from collections import Counter
from hashlib import sha256

from pricelens.llm import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows, items):
    windows = {}
    for i, t in items:
        own = words(t)
        for k in range(max(1, len(own) - 9)) if own and i is not None else ():
            windows.setdefault(tuple(own[k : k + 10]), set()).add(i)
    out = []
    for d, t in rows:
        own, hit, met = words(t), set(), set()
        for k in range(len(own)):
            for size in {len(w) for w in windows}:
                w = tuple(own[k : k + size])
                if w in windows:
                    hit.update(range(k, k + len(w)))
                    met |= windows[w]
        digest = sha256(",".join(sorted(map(str, met))).encode()).hexdigest()
        out.append((d, len(own), len(hit), len(met), digest, bool(hit)))
    return sorted(out)


def data():
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "of", "a"]) if rng.random() < 0.5 else "w%d" % rng.randrange(60)
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 9, 10, 11, 30])))) for k in range(20)]
    items += [(20, None), (21, ""), (22, items[3][1]), (22, items[3][1]), (23, "of"), (24, "été Über x1")]
    rows = []
    for d in range(60):
        own = [word() for _ in range(rng.randrange(80))]
        if d % 3 == 0:
            passage = (items[d % len(items)][1] or "").split()
            cut = rng.randrange(len(own) + 1)
            own = own[:cut] + [w.upper() for w in passage] + own[cut:]
        rows.append((d, ", ".join(own)))
    return [*rows, (60, None), (61, ""), (62, "ÉTÉ Über-X1 été Über X1"), (63, "w1 " * 5000)], items


def test_every_hit(spark, docs, clashing):
    rows, items = data()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = contamination.report(clashing(docs(rows)), clashing(bench))
    assert sorted(tuple(r)[:6] for r in found.collect()) == brute(rows, items)


def brute_near(rows, items, distance):
    """Windows of each doc_id whose three rarest terms stand near one another, by plain loops."""
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    counts = Counter(w for _, t in rows for w in words(t))
    windows = set()
    for item, text in items:
        own = words(text)
        if item is not None and own:
            windows |= {tuple(own[k : k + 10]) for k in range(max(len(own) - 9, 1))}
    met = {d: set() for d, _ in rows if d is not None}
    for doc, text in rows:
        own = words(text)
        for w in windows if doc is not None else ():
            terms = [w[k] for k in sorted(range(len(w)), key=lambda k: (counts[w[k]], k))[:3]]
            places = [[i for i, x in enumerate(own) if x == t] for t in terms]
            if any(all(any(abs(i - f) <= distance for i in p) for p in places) for f in places[0]):
                met[doc].add(w)
    return {d: len(m) for d, m in met.items()}


def test_blocks_of_the_benchmark_add_up(spark, docs):
    rows, items = data()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = contamination.report(docs(rows), bench, block=40).collect()
    assert sorted(tuple(r)[:6] for r in found) == brute(rows, items)
    near = brute_near(rows, items, 10)
    assert {r.doc_id: r.n_near for r in found if r.doc_id is not None} == near and max(near.values()) > 1
    none = contamination.report(docs(rows), bench, distance=None).collect()
    assert sorted(tuple(r)[:6] for r in none) == brute(rows, items) and all(r.n_near == 0 for r in none)


def test_empty_tables_and_odd_ids(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [tuple(r)[1:4] for r in contamination.report(docs([(1, "a b")]), none).collect()] == [(2, 0, 0)]
    bench = spark.createDataFrame([(1, "a b c"), (None, "x y z")], "item_id bigint, text string")
    assert contamination.report(docs([]), bench).collect() == []
    rows = [(1, "q a b c"), (1, "q a b c"), (1, "nothing"), (None, "a b c"), (2, "x y z")]
    found = contamination.report(docs(rows), bench).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in found) == [(0, 3, 0), (1, 1, 0), (1, 4, 3), (1, 4, 3), (2, 3, 0)]


def test_proximity(spark, docs):
    index = contamination.postings(docs([(1, "red far far blue"), (2, "blue red"), (3, "red")]), _terms())
    red, blue = (int(h) for h in _hash("red", "blue"))
    found = contamination.near_matches(index, [7], [[(red, 0), (blue, 1)]], 2)
    assert [tuple(r) for r in found.collect()] == [(2, 7, 1)]


def _hash(*texts):
    import numpy as np
    import pyarrow as pa

    hashes = [h for _, h, _ in contamination.term_hashes(pa.array(texts))]
    return np.concatenate(hashes).view(np.int64)


def _terms():
    import numpy as np

    return np.sort(_hash("red", "blue"))
