import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from barloom.llm import search
from barloom.session import checkpoint_dir, ship

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
LAST = 2**63 - 1


@pytest.fixture(scope="module")
def session(spark):
    ship(spark)
    checkpoint_dir(spark)
    return spark


def terms(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, top=10):
    vectors = [(i, Counter(w), len(w)) for i, w in ((i, terms(t)) for i, t in docs) if w]
    n_docs, n_terms = len(vectors), sum(n for _, _, n in vectors)
    df = Counter(t for _, c, _ in vectors for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for i, ts in asked.items():
        found = []
        for d, c, n in vectors:
            m = 100 - 90 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if score > 0:
                found.append((-score, LAST if d is None else d))
        out += [(i, k + 1, None if d == LAST else d, -s) for k, (s, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def corpus(seed, n=400):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Über", "naïve", "x1", "Ä", "日本"]
    weight = [1 / (k + 1) for k in range(len(vocabulary))]
    text = lambda k: r.choice([" ", ", ", "\n"]).join(r.choice([str.upper, str])(w) for w in r.choices(vocabulary, weight, k=k))
    docs = [(i, text(r.choice([1, 3, 10, 40]))) for i in range(n)]
    docs += [(r.randint(0, n), docs[r.randrange(n)][1]) for _ in range(60)]
    docs += [(None, docs[3][1]), (None, docs[4][1]), (n + 1, None), (n + 2, ""), (n + 3, "?! -"), (n + 4, "w1 " * 50000)]
    items = [(i, text(r.randint(1, 25))) for i in range(30)] + [(5, "w50 w51"), (None, "w3 w40"), (31, None), (32, ""), (33, "unknownword"), (34, "w0"), (35, " ".join(f"w{k} v{k}" for k in range(60)))]
    return docs, items


@pytest.mark.parametrize(("seed", "group", "block"), [(1, 1 << 14, 1 << 22), (2, 64, 600)])
def test_matches_brute_force(session, monkeypatch, seed, group, block):
    monkeypatch.setattr(search, "GROUP", group)
    docs, items = corpus(seed)
    got = search.ranked(session.createDataFrame(docs, DOCS).repartition(3), session.createDataFrame(items, ITEMS), block_bytes=block)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_search_leaves_subtrees_out(monkeypatch):
    """The bound spares most leaves, and what is found is the same as by scoring all."""
    r = np.random.default_rng(3)
    tf = np.minimum(r.geometric(0.5, (4000, 12)) * (r.random((4000, 12)) < np.linspace(0.8, 0.01, 12)), 9).astype(np.int32)
    tf = tf[tf.any(1)]
    m, doc, w = r.integers(10, 400, len(tf)), r.permutation(len(tf)), np.linspace(100, 6000, 12).astype(np.int64)
    tree, seen = search.Tree(tf, m, doc, w), []
    all_ = search.gains(tf, m, w)
    monkeypatch.setattr(search, "gains", lambda t, *a, f=search.gains: seen.append(len(t)) or f(t, *a))
    best = tree.best([], 10)
    assert best == sorted(zip((-all_).tolist(), doc.tolist()))[:10]
    assert sum(seen) < len(tf) / 4


def test_empty_tables_and_other_columns(session):
    docs, items = corpus(4, 50)
    none, some = session.createDataFrame([], DOCS), session.createDataFrame(items, ITEMS)
    assert search.ranked(none, some).count() == 0
    assert search.ranked(session.createDataFrame(docs, DOCS), session.createDataFrame([], ITEMS)).count() == 0
    wide = session.createDataFrame([(*d, 1, "x", 2) for d in docs], DOCS + ", doc long, score string, item_id long")
    asked = session.createDataFrame([(*i, 7, "y") for i in items], ITEMS + ", doc_id long, term string")
    assert sorted(map(tuple, search.ranked(wide, asked).collect()), key=str) == brute(docs, items)
