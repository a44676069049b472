import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import minhash, queries
from barloom.llm.common import components
from barloom.session import checkpoint_dir, ship

ROWS = "doc_id long, text string"


@pytest.fixture(scope="module")
def session(spark):
    ship(spark)
    checkpoint_dir(spark)
    return spark


def shingles(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute(rows, threshold=0.8):
    """Components of all pairs; document frequencies by shingle."""
    sets = [shingles(t) for _, t in rows]
    df, n = Counter(), sum(bool(s) for s in sets)
    for s in sets:
        df.update(set(s))
    weigh = [{k: v * (1 + np.log(n / df[k])) for k, v in s.items()} for s in sets]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = weigh[i], weigh[j]
            if a and b and a.keys() & b.keys():
                low = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
                if low / (sum(a.values()) + sum(b.values()) - low) >= threshold:
                    group[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(rows))]


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = []
    for base in range(12):
        text = [word() for _ in range(r.randint(60, 200))]
        for copy in range(r.choice([1, 1, 2, 5, 12])):
            t = list(text)
            for _ in range(r.randint(0, 2) if copy else 0):
                t[r.randrange(len(t))] = word()
            rows.append(" ".join(t))
    r.shuffle(rows)
    return list(enumerate([*rows, "one two", "One, two!", "one", "", "", None], 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(session, seed):
    rows = corpus(seed)
    got = {r.doc_id: r for r in minhash.digest(session.createDataFrame(rows, ROWS).repartition(4)).collect()}
    top = brute(rows)
    assert [got[i].component_id for i, _ in rows] == [rows[t][0] for t in top]
    assert sum(r.kept for r in got.values()) == len(set(top))


def test_edge_cases(session):
    assert minhash.digest(session.createDataFrame([], ROWS)).count() == 0
    text = "a b c d e f g h i j k l"
    rows = [(None, text, 1, "q"), (5, text, 2, None), (5, text, 3, "q"), (5, "other words " * 9, 4, "q"), (None, None, 5, "q"), (8, "", 6, "q"), (9, "A, b c d e f g h i j k l.", 7, "q")]
    df = session.createDataFrame(rows, "doc_id long, text string, node long, row string")
    out = minhash.one_of_each(df)
    assert out.columns == df.columns
    assert sorted(r.node for r in out.collect()) in ([2, 4, 5, 6], [3, 4, 5, 6])
    signs = minhash.shingles(pa.array(["!? *", " !?  *\n", "!?", " ", None]))
    assert signs[0].tolist() == [0, 1, 2] and signs[1][0] == signs[1][1] != signs[1][2]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.digest(df).collect()), key=str)
    assert got == sorted([(5, 5, True)] * 3 + [(None, 5, False), (9, 5, False), (8, 8, True), (None, None, True)], key=str)


def test_bucket_with_two_groups_keeps_every_link(session):
    """Nodes that the smallest of a bucket does not link are compared with all others of the bucket."""
    base = [f"w{i}" for i in range(100)]
    rows = [" ".join(base)]
    for k in range(12):  # a chain: each follows from the one before by a small change
        base[k * 8] = f"x{k}"
        rows.append(" ".join(base))
    got = minhash.digest(session.createDataFrame(list(enumerate(rows)), ROWS), bands=1, rows=1).collect()
    top = brute(list(enumerate(rows)))
    assert len({r.component_id for r in got}) >= len(set(top))
    got = minhash.digest(session.createDataFrame(list(enumerate(rows)), ROWS)).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(top))


def test_sampling_estimates_weighted_jaccard():
    g = np.random.default_rng(0)
    h = np.sort(g.integers(0, 1 << 44, 400)).astype(np.uint64)
    a, b = g.gamma(2, size=400), g.gamma(2, size=400)
    one, two = (minhash.samples(np.zeros(400, np.int64), h, w, 1500)[:, 0] for w in (a, b))
    assert abs((one == two).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_components_of_a_chain_and_a_star(session):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r.id: r.component for r in components(session.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}


def test_document_frequencies_are_true_counts(session):
    """More distinct shingles than any fixed table would hold, in several slices and groups of buckets."""
    n, unique = 9000, 120
    shared = " ".join(f"s{i}" for i in range(6))  # two shingles of every document
    text = F.concat(F.lit(shared), *[F.concat(F.lit(f" w{i}x"), F.when(F.col("id") % 9 == 0, F.col("id") % 900).otherwise(F.col("id"))) for i in range(unique)])
    docs = session.range(0, n, 1, 6).select(F.col("id").alias("doc"), F.xxhash64(text).alias("fp"), text.alias("text"))
    seen = set()
    for r in minhash.signatures(docs).select("doc", "idf").toLocalIterator():
        got = np.sort(np.frombuffer(r.idf, np.float32))
        assert len(got) == 2 + unique
        seen.add(r.doc)
        df = 10 if r.doc % 9 == 0 else 1
        assert np.allclose(got, np.sort([1.0] * 2 + [1 + np.log(n / df)] * unique), rtol=1e-6)
    assert len(seen) == n


def test_exchange_of_texts_is_shared_and_copies_of_a_row_are_spread(session):
    docs = session.range(0, 4000, 1, 8).select(F.lit(1).cast("long").alias("doc"), F.lit(2).cast("long").alias("fp"), F.lit("same words in every single row " * 200).alias("text"))
    out = minhash.signatures(docs)
    rows = out.collect()
    assert len(rows) == 4000 and len({r.node for r in rows}) == 1
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_very_long_text(session):
    long = " ".join(f"v{i * 7919 % 100_003}" for i in range(400_000))
    rows = [(1, long), (2, long + " tail"), (3, "other words of a short text"), (4, long[: len(long) // 3])]
    got = {r.doc_id: r.component_id for r in minhash.digest(session.createDataFrame(rows, ROWS)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def large_group():
    """81 near copies of a text among 800 others."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(200)]
    texts = [base]
    for _ in range(80):
        t = list(base)
        for at in (20, 90, 160):
            t[at + r.randrange(20)] = word()
        texts.append(t)
    return [(i, " ".join(t)) for i, t in enumerate(texts + [[word() for _ in range(40)] for _ in range(800)])]


def test_near_copies_of_a_large_group_stay_together(session, tmp_path):
    """An edit weighs more by idf than what a large group shares; the group must not fall apart for its size."""
    rows = large_group()
    docs = session.createDataFrame(rows, ROWS).repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x.component_id for x in queries.minhash_near_dedup(session, str(tmp_path)).collect()}
    assert got == {i: 0 if i <= 80 else i for i, _ in rows}
    left = corpus_pipeline.near_dedup(session, docs, str(tmp_path)).collect()
    assert sorted(x.doc_id for x in left) == [0, *range(81, len(rows))]


@pytest.mark.parametrize("seed", [1, 2])
def test_plain_links_match_brute_force(session, seed):
    """Links by counts alone come on top of those by weight."""
    rows = corpus(seed)
    sets = [shingles(t) for _, t in rows]
    top = brute(rows)
    for i in range(len(rows)):
        for j in range(i):
            low = sum((sets[i] & sets[j]).values())
            if low and low / sum((sets[i] | sets[j]).values()) >= 0.8 and top[i] != top[j]:
                hi, lo = max(top[i], top[j]), min(top[i], top[j])
                top = [lo if t == hi else t for t in top]
    got = {r.doc_id: r.component_id for r in minhash.digest(session.createDataFrame(rows, ROWS).repartition(4), plain=True).collect()}
    assert got == {i: rows[t][0] for (i, _), t in zip(rows, top, strict=True)}
