import hashlib
import random
import re

import numpy as np
import pytest

from barloom.llm import fmindex
from barloom.session import checkpoint_dir, ship

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


@pytest.fixture(scope="module")
def session(spark):
    ship(spark)
    checkpoint_dir(spark)
    return spark


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    phrases = {}
    for i, t in items:
        w = split(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            phrases.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in phrases:
                    hit.update(range(k, k + n))
                    found |= phrases[tuple(w[k : k + n])]
        names = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((d, len(w), len(hit), len(found - {None}), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["The", "the", "of", "é", "zu", "x1", "b", "Ö", "q"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(r.randint(1, 14))) for i in range(12)] + [(3, text(9)), (None, text(8)), (50, ""), (51, None), (52, "!!"), (53, "of"), (54, "the of the of the of")]
    docs = [(None, text(20)), (1, None), (2, ""), (2, items[0][1]), (2, items[0][1]), (4, "of the " * 500)]
    for i in range(10, 60):
        docs.append((i, "".join(r.choice(items)[1] or "" if r.random() < 0.3 else text(r.randint(0, 12)) + " other" + str(i) + " " for _ in range(5))))
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_matches_brute_force(session, block_bytes):
    docs, items = corpus(5)
    d, i = session.createDataFrame(docs, DOCS).repartition(3), session.createDataFrame(items, ITEMS)
    for window in (4, 10):
        got = fmindex.digest(d, i, window=window, block_bytes=block_bytes)
        assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, window)


def test_empty_tables_and_clashing_columns(session):
    docs, items = corpus(6)
    none = session.createDataFrame([], ITEMS)
    assert fmindex.digest(session.createDataFrame([], DOCS), none).count() == 0
    d = session.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, items int, spans int")
    assert sorted(map(tuple, fmindex.digest(d, none).collect()), key=str) == brute(docs, [], 10)
    clean = fmindex.decontaminated(d, session.createDataFrame(items, ITEMS), window=6)
    assert clean.columns == d.columns
    left = {r.doc_id: split(r.text) for r in clean.collect() if r.doc_id and r.doc_id > 2}
    for i, n, hit, *_ in brute(docs, items, 6):
        if i and i > 2:
            assert len(left[i]) == n - hit


def test_index_counts_and_locates():
    g = np.random.default_rng(1)
    for top in (1, 3, 40):
        text = np.concatenate([np.append(g.integers(1, top + 1, g.integers(1, 60)), 0) for _ in range(30)])
        index = fmindex.FMIndex(text, top)
        for n in (1, 2, 5):
            phrases = g.integers(1, top + 1, (50, n))
            lo, hi = index.ranges(phrases)
            for p, a, b in zip(phrases, lo, hi):
                want = [k for k in range(len(text) - n + 1) if (text[k : k + n] == p).all()]
                assert sorted(index.locate(np.arange(a, b))) == want


def test_texts_are_cut_by_the_pass_that_finds_the_spans(session):
    """Two passes in Python in one task hold two workers; every executor kept twice as many from there on."""
    docs, items = corpus(7)
    d, i = session.createDataFrame(docs, DOCS), session.createDataFrame(items, ITEMS)
    out = fmindex.decontaminated(d, i, window=6)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    cut = {(r.doc_id, r.text) for r in out.collect()}
    assert cut == {(r.doc_id, r.text) for r in fmindex.decontaminated(d, i, window=6, block_bytes=60).collect()} != {tuple(x) for x in docs}
