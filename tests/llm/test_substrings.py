import hashlib
import random
import re

import pyarrow as pa
import pytest

from barloom.llm import substrings, words
from barloom.session import checkpoint_dir, ship

ROWS = "doc_id long, text string"


@pytest.fixture(scope="module")
def session(spark):
    ship(spark)
    checkpoint_dir(spark)
    return spark


def brute(rows, window):
    texts = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    first = {}
    last = 2**63 - 1
    ids = [last if i is None else i for i, _ in rows]
    for i, w in zip(ids, texts):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, last + 1), i)
    out = []
    for i, w in zip(ids, texts):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((None if i == last else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=120):
    r = random.Random(seed)
    vocabulary = ["a", "the", "é", "zu　x", "b.c", "D"]
    passage = [" ".join(r.choice(vocabulary) for _ in range(r.randint(5, 40))) for _ in range(6)]
    rows = [(None, passage[0]), (None, passage[0]), (3, None), (4, ""), (5, " \t\n "), (6, "the " * 300), (7, "the\n" * 400), (7, passage[1]), (7, passage[1])]
    for i in range(10, n):
        parts = [r.choice(passage) if r.random() < 0.4 else " ".join(r.choice(vocabulary) + str(r.randint(0, 50)) for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 5))]
        rows.append((i, r.choice([" ", "\n", "  "]).join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(session, seed):
    rows = corpus(seed)
    for window in (3, 20):
        got = substrings.digest(session.createDataFrame(rows, ROWS).repartition(3), window)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, window)


def test_empty_table_and_clashing_columns(session):
    assert substrings.digest(session.createDataFrame([], ROWS)).count() == 0
    rows = [(i, t, i, "x") for i, t in corpus(3)]
    df = session.createDataFrame(rows, "doc_id long, text string, spans long, row string")
    out = substrings.without_repeats(df, window=10)
    assert out.columns == df.columns and out.count() == len(rows)
    kept = {r.doc_id: r for r in out.collect()}
    for i, n_words, n_removed, sha in brute([x[:2] for x in rows], 10):
        if i is not None and i != 7:
            text = kept[i].text or ""
            assert hashlib.sha256(" ".join(w for w in re.split(r"[\x20\x09-\x0D]+", text) if w).encode()).hexdigest() == sha
            assert kept[i].spans == i


def test_words_cut_pieces_between_words(monkeypatch):
    texts = ["alpha beta", "", None, "x" * 50, "a " * 40, "été"]
    whole = words.hashes(*substrings.text_buffer(pa.array(texts)), words.PLAIN)
    monkeypatch.setattr(words, "PIECE", 7)
    small = words.hashes(*substrings.text_buffer(pa.array(texts)), words.PLAIN)
    for a, b in zip(whole, small):
        assert (a == b).all()


def test_hot_bucket_is_split(session):
    """All documents share 45 words, which no window of 50 removes; the windows over them are dealt out."""
    r = random.Random(8)
    shared = " ".join(f"licence{k}" for k in range(45))
    rows = [(i, " ".join(f"w{r.random()}" for _ in range(20)) + " " + shared + " " + " ".join(f"w{r.random()}" for _ in range(20))) for i in range(600)]
    rows += [(1000 + i, rows[i][1]) for i in range(0, 600, 50)]
    df = session.createDataFrame(rows, ROWS).repartition(4)
    src = df.select(substrings.F.col("doc_id").alias("doc"), substrings.F.xxhash64("text").alias("fp"), "text")
    hot = substrings.hot_buckets(src, 50, 64)
    assert hot and max(hot.values()) > 5
    sent = src.mapInArrow(substrings._deal(50, 64, hot), substrings._SENT)
    load = [x.n for x in sent.groupBy("bucket").agg((substrings.F.sum(substrings.F.length("hash")) / 8).alias("n")).collect()]
    assert max(load) < 5 * sum(load) / 64
    assert sorted(map(tuple, substrings.digest(df).collect()), key=str) == brute(rows, 50)


def test_very_long_text(session):
    long = " ".join(f"w{k % 70_000}" for k in range(150_000))
    rows = [(1, "start " + long), (2, long), (3, "w5 w6")]
    assert sorted(map(tuple, substrings.digest(session.createDataFrame(rows, ROWS)).collect()), key=str) == brute(rows, 50)
