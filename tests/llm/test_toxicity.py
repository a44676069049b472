import random
import tracemalloc

import numpy as np
import pytest

from barloom.llm import toxicity
from barloom.session import checkpoint_dir, ship

ROWS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"
INSULTS = ["idiot", "moron", "scumbag", "loser"]


@pytest.fixture(scope="module")
def session(spark):
    ship(spark)
    checkpoint_dir(spark)
    return spark


def corpus(seed, n=900):
    r = random.Random(seed)
    plain = ["".join(r.choice(["th", "en", "or", "at", "ish", "ble", "ou"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = [r.choice(plain) for _ in range(r.randint(5, 80))]
        for _ in range(r.randint(1, 3) if toxic else 0):
            w[r.randrange(len(w))] = r.choice(INSULTS) + r.choice(["", "s", ".", "!"])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def brute_kernel(a, b):
    def triples(w):
        out = {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    if w[i].isalpha() and w[j].isalpha() and w[k].isalpha():
                        out.setdefault((w[i], w[j], w[k]), []).append(toxicity.DECAY ** (k - i + 1))
        return out

    x, y = triples(a), triples(b)
    size = lambda t: sum(v * v for vs in t.values() for v in vs) ** 0.5
    return sum(sum(x[t]) * sum(y[t]) for t in x.keys() & y.keys()) / size(x) / size(y)


def test_kernel_matches_brute_force():
    marks = toxicity.Landmarks(INSULTS)
    for word in ["idiot", "id.iot", "idxiot", "scummbag", "the", "losers", "anana", "i-d-i-o-t"]:
        want = max(toxicity.FLOOR, *[brute_kernel(word, m) for m in INSULTS])
        got = marks.features(["some of " + word])[0].max() ** (1 / toxicity.POWER)
        assert abs(min(want, 1) - got) < 1e-4
    assert marks.features(["such an i d i o t"]).max() > 0.4


def test_held_out_accuracy_and_gapped_insults(session):
    docs, labels = corpus(1)
    d, lab = session.createDataFrame(docs, ROWS), session.createDataFrame(labels, LABELS)
    got = toxicity.digest(d, lab).collect()
    truth = {i: t for i, _, t in labels}
    assert all(r.held_out == toxicity.held_out(r.doc_id) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    more = [(1, "you id.iot then"), (2, "you i-diot then"), (3, "mor*on ish"), (4, "then or at ish"), (5, ""), (6, None)]
    model = toxicity.train(d, lab)
    scores = model.scores([t for _, t in more])
    assert (scores[:3] >= 0.5).all() and (scores[3:] < 0.5).all()


def test_edge_cases(session):
    docs, labels = corpus(2, 300)
    docs += [(None, "idiot"), (None, None), (7, ""), (7, docs[7][1]), (7, docs[7][1]), (8, "word " * 50000)]
    labels += [(None, 1, 1), (3, None, None), (4, 1, 0), (4, 1, 0)]
    df = session.createDataFrame([(*x, 1, "x") for x in docs], "doc_id long, text string, row int, score string")
    lab = session.createDataFrame(labels, LABELS)
    out = toxicity.digest(df, lab).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    kept = toxicity.accepted(df, lab)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted == 0 for r in out)
    assert toxicity.digest(df.limit(0), lab).count() == 0
    assert {r.score for r in toxicity.digest(df, lab.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.digest(df, lab.where("toxic = 1")).collect()} == {1.0}


def test_two_inserted_letters_and_two_signs_leave_a_signal():
    marks = toxicity.Landmarks(INSULTS)
    none = marks.features(["the"])[0].max()
    for word, insult in [("scxumxbag", "scumbag"), ("losxxer", "loser")]:
        got = marks.features(["some " + word])[0, INSULTS.index(insult)]
        assert abs(got - brute_kernel(word, insult) ** toxicity.POWER) < 1e-4 and got > 1.5 * none
    for word in ["i--d--i--o--t", "i-.d*!i--o--t", "i---d---i---o---t"]:
        got = marks.features([word])[0, 0]
        assert abs(got - brute_kernel("i-d-i-o-t", "idiot") ** toxicity.POWER) < 1e-4 and got > 0.2


def test_words_of_earlier_slices_change_nothing(monkeypatch):
    docs, _ = corpus(3, 200)
    texts = [t for _, t in docs]
    for table in (0, 150, 1 << 16):
        monkeypatch.setattr(toxicity, "TABLE", table)
        marks = toxicity.Landmarks(INSULTS)
        got = np.concatenate([marks.features(texts[i : i + 7]) for i in range(0, len(texts), 7)])
        assert len(marks.seen) <= table
        assert (got == toxicity.Landmarks(INSULTS).features(texts)).all()


@pytest.mark.parametrize(("toxic", "clean"), [(1, 1), (2, 2), (3, 20), (2, 9), (9, 1)])
def test_few_labels_do_not_turn_the_scores_round(session, toxic, clean):
    texts = [(k, f"you are such an idiot number{k} indeed") for k in range(1, 90) if not toxicity.held_out(k)][:toxic]
    texts += [(k, f"a quiet walk along river number{k} today") for k in range(100, 190) if not toxicity.held_out(k)][:clean]
    docs = session.createDataFrame(texts, "doc_id long, text string")
    labels = session.createDataFrame([(i, 1, int(i < 100)) for i, _ in texts], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.digest(docs, labels).collect()}
    assert min(s for i, s in got.items() if i < 100) >= max(s for i, s in got.items() if i >= 100)
    kept = {r.doc_id for r in toxicity.accepted(docs, labels).collect()}
    assert (9, 1) == (toxic, clean) or {i for i, _ in texts if i >= 100} <= kept


def test_choice_of_landmarks_is_bounded_on_the_driver(monkeypatch):
    rng = random.Random(1)
    ranked = list(dict.fromkeys("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 12))) for _ in range(1400)))
    ranked += [w[:-1] + "q" + w[-1] for w in ranked[:600]]
    tracemalloc.start()
    got = toxicity.pick(ranked, 1500)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6  # one table of all candidates took 400 MB
    monkeypatch.setattr(toxicity, "_BLOCK", 1 << 12)
    assert toxicity.pick(ranked, 1500) == got and len(got) == 1500


def test_a_triple_costs_only_the_landmarks_that_have_it():
    rng = random.Random(5)
    others = list(dict.fromkeys("".join(rng.choice("nopqrstuvwxyz") for _ in range(9)) for _ in range(300)))
    texts = ["abcdefghij" * 3 + "".join(rng.choice("klm") for _ in range(12)) for _ in range(3000)]
    codes, word, n, *_ = toxicity._words(texts)
    alone, want = toxicity.Landmarks(["abcdefghij"]).kernel(codes, word, n)
    marks = toxicity.Landmarks(["abcdefghij", *others])
    tracemalloc.start()
    alive, got = marks.kernel(codes, word, n)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6  # a row of all landmarks for each triple of each word took 100 MB
    assert (alive == alone).all() and (got[:, :1] == want).all() and not got[:, 1:].any()
