import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from barloom.llm import bpe
from barloom.session import ship

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = [
    "a", "e", "s", "t", "'", "'s", "́", "é", "É", "İ", "Σ", "ſ", "K", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "1", "½", "ß", "中", "ก", "ᄀ", "ᅡ", "ᆨ", "가", "　",
    "\x85", "\x1c", "​", "😀", "!", "th", "ing", "'RE", "'ll", "᠎", "ͅ", "ǅ", "ﬁ", "ে", "া", "\x00", "_",
]


@pytest.fixture(scope="module")
def model():
    return bpe.Model(bpe.load(PATH))


def check(model, text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    encoder = bpe.Encoder(model)
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want, text
    cut = random.Random(len(text)).randint(0, len(want))
    decoder = bpe.Decoder(model, joined=True)
    assert decoder.feed(want[:cut]) + decoder.feed(want[cut:]) + decoder.close() == LIBRARY.decode(want, skip_special_tokens=False)


def test_short_texts(model):
    r = random.Random(1)
    for _ in range(1500):
        check(model, "".join(r.choice([*PARTS, " ", "\n"]) for _ in range(r.randint(0, 30))))


def test_streamed_texts(model, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 100)
    r = random.Random(2)
    for spaces in ([" ", "\n"], []):
        for _ in range(80):
            check(model, "".join(r.choice(PARTS + spaces) for _ in range(r.randint(100, 900))))


def test_long_words_need_bounded_lookahead(model):
    r = random.Random(3)
    parts = ["a", "b", "th", "e", "in", "g", "é", "o", "on", "aa"]
    for _ in range(40):
        check(model, "".join(r.choice(parts) for _ in range(r.randint(100, 4000))))
    for c in ("a", "ha", "!", "?!", "😀", "na", "=", "oh"):
        for n in (10, 500, 3001):
            check(model, c * n)


def test_ids_leave_before_the_end(model):
    word = bpe.LongWord(model)
    out = sum(len(word.feed(b"anthology" * 20)) for _ in range(50))
    assert out > 0 and len(word.held) <= 2 * model.lookahead + 64


def test_bytes_to_text_state_machine(model):
    ids = np.frombuffer(bpe.Encoder(model).encode("Zoë 中文 <|endoftext|> 😀!"), "<u4").tolist()
    decoder = bpe.Decoder(model)
    text = "".join(decoder.feed([i]) for i in ids) + decoder.close()
    assert text == "zoë 中文 <|endoftext|>😀! "


def test_query_form(spark):
    ship(spark)
    rows = [(None, "Hello world"), (1, None), (2, ""), (2, "x"), (2, "x"), (3, "word " * 30000), (4, "y" * 70000)]
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], "doc_id long, text string, row string, ids int")
    got = bpe.encoded(df, PATH, ["doc_id"])
    want = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert bpe.encoded(df.limit(0), PATH, ["doc_id", "ids"]).count() == 0
    assert [len(r.ids) for r in bpe.encoded(df.select("doc_id", "text"), PATH, ["doc_id"], with_ids=True).collect()] == [w[1] for w in want]


def test_words_of_a_slice_are_merged_together(model):
    r = random.Random(4)
    inner = [s.removesuffix("</w>") for s in model.vocab]
    words = [bytes(model.bytes[c] for c in "".join(r.choices(inner, k=r.randint(1, 5)))) for _ in range(3000)]
    words = [w for w in [*words, *(bytes([b]) for b in range(256)), b"a" * 90, b"ha" * 31] if w]
    want = [model.merge([model.first[b] for b in w[:-1]] + [model.last[w[-1]]]) for w in words]
    assert [np.frombuffer(i, "<u4").tolist() for i in model.merge_words(words)] == want


def test_a_slice_needs_no_merging_word_by_word(monkeypatch):
    r = random.Random(5)
    texts = [" ".join("".join(r.choices(["th", "e", "in", "é", "ou", "ß", "中"], k=r.randint(1, 7))) for _ in range(60)) for _ in range(50)]
    texts += [None, "", " ", "<|endoftext|>", "x" * 300, "word " * 20000, "I'LL  do\t1234 Σ é!?"]
    alone = []
    merge = bpe.Model.merge
    monkeypatch.setattr(bpe.Model, "merge", lambda self, ids: alone.append(len(ids)) or merge(self, ids))
    spec = bpe.zlib.compress(open(PATH, "rb").read())
    shared = type("Shared", (), {"value": ("words of a slice", spec)})
    batch = bpe.pa.RecordBatch.from_pydict({"row": bpe.pa.array(range(len(texts))), "text": bpe.pa.array(texts, bpe.pa.string())})
    got = [tuple(r.values()) for b in bpe._digests(shared, False)(iter([batch])) for r in b.to_pylist()]
    want = []
    for k, t in enumerate(texts):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == want
    assert len(alone) < 10


def test_words_met_again_stay_in_the_table(model, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 20)
    asked = []
    short = bpe.Words.short
    monkeypatch.setattr(bpe.Words, "short", lambda self, raw: asked.append(raw) or short(self, raw))
    encoder = bpe.Encoder(model)
    for k in range(300):
        encoder.encode(f"again rare{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvw'[k // 100]}")
    assert asked.count(b"again") == 1
    assert len(encoder.words) <= 20 and len(encoder.words.older) <= 20
