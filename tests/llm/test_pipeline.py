import random
import re

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

import corpus_pipeline
from barloom.session import checkpoint_dir, ship
from test_minhash import brute as near_groups
from test_toxicity import INSULTS


@pytest.fixture(scope="module")
def session(spark):
    ship(spark)
    checkpoint_dir(spark)
    return spark


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())


def without_repeats(rows, window=50):
    """Plain words of texts without windows that a smaller id holds."""
    texts = {i: [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w] for i, t in rows}
    first = {}
    for i, w in sorted(texts.items()):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, w in texts.items():
        gone = {p for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for p in range(k, k + window)}
        out[i] = [x for p, x in enumerate(w) if p not in gone]
    return out


def without_items(w, items, window=10):
    phrases = {tuple(x[k : k + window]) for x in items for k in range(len(x) - window + 1)}
    gone = {p for k in range(len(w) - window + 1) if tuple(w[k : k + window]) in phrases for p in range(k, k + window)}
    return [x for p, x in enumerate(w) if p not in gone]


def tables(session, folder):
    r = random.Random(4)
    word = lambda: "".join(r.choice("bcdfglmnprs") + r.choice("aeiou") for _ in range(r.randint(1, 3)))
    item = " ".join(word() for _ in range(20))
    passage = " ".join(word() for _ in range(70))
    docs, labels = [], []
    for i in range(260):
        w = [word() for _ in range(r.randint(60, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(INSULTS)
        text = " ".join(w)
        if i % 10 == 1:
            text += "\n" + passage
        if i % 10 == 3:
            text = item + " . " + text
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    for k, i in enumerate((5, 5, 6, 7)):  # copies, the last one near
        text = docs[i][1] + (" another end" if i == 7 else "")
        docs.append((300 + k, text, None, None, None))
    docs.append((400, None, None, None, None))
    docs.append((401, "", "en", "s0", 0))
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    session.createDataFrame(docs, kind).write.parquet(f"{folder}/documents.parquet")
    session.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    session.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, {i for i, _, t in labels if t}, item


def test_stages_against_brute_force(session, tmp_path):
    docs, toxic, item = tables(session, tmp_path)
    frames, columns = {}, None
    at = session.read.parquet(f"{tmp_path}/documents.parquet")
    columns = at.columns
    for name, stage in corpus_pipeline.STAGES:
        out = f"{tmp_path}/{name}"
        stage(session, at, str(tmp_path)).write.parquet(out)
        at = session.read.parquet(out)
        frames[name] = at
        assert name == "tokenize" or at.columns == columns
    kept = {r.doc_id: r.text for r in frames["toxicity"].collect()}
    assert kept.keys() == {d[0] for d in docs} - toxic
    rows = sorted(kept.items())
    top = near_groups(rows)
    one = {r.doc_id: r.text for r in frames["near_dedup"].collect()}
    assert one.keys() == {rows[t][0] for t in top} and {300, 301, 302, 303}.isdisjoint(one)
    plain = without_repeats([(i, t or "") for i, t in one.items()])
    cut = {r.doc_id: r for r in frames["substring_dedup"].collect()}
    assert {i: (r.text or "").split() for i, r in cut.items()} == plain
    clean = {r.doc_id: r for r in frames["decontaminate"].collect()}
    assert {i: words(r.text or "") for i, r in clean.items()} == {i: without_items(words(r.text or ""), [words(item)]) for i, r in cut.items()}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in clean.values())
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    for r in frames["tokenize"].collect():
        assert list(r.ids) == library.encode(clean[r.doc_id].text or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    whole = corpus_pipeline.run(session, str(tmp_path))
    assert sorted((r.doc_id, r.ids_sha256) for r in whole.collect()) == sorted((r.doc_id, r.ids_sha256) for r in frames["tokenize"].collect())
    assert np.all([r.n_tokens >= 0 for r in whole.collect()])
