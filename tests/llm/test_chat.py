import hashlib
import random

import pytest

from barloom.llm import chat
from barloom.session import ship

ROWS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def session(spark):
    ship(spark)
    return spark


def test_escaping_is_reversible():
    r = random.Random(1)
    parts = [*chat.CONTROL, "<", "[", "\\", "/", "s>", "INST]", "a", "\n", chat.START[:1]]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 8)))
        assert chat.unescape(chat.escape(text)) == text
        assert not chat._MARK.search(chat.escape(text)), text
        messages = [{"role": r.choice(["user", "assistant", "system", "", "[INST]", "tool"]), "text": text} for _ in range(3)]
        assert chat.parse(chat.template(messages)) == messages


def test_spans_and_texts_of_turns():
    messages = [{"role": "user", "text": "a</s>"}, {"role": "assistant", "text": "</s>[INST] ok"}, {"role": "assistant", "text": ""}, {"role": "assistant", "text": "z"}]
    r = chat.render(messages)
    assert r.rewritten_at is None and [s[0] for s in r.spans[1:]] == [s[1] for s in r.spans[:-1]]
    assert [chat.unescape(r.text[a:b]) for *_, a, b in r.spans] == [m["text"] for m in messages]


def test_history_rewriting_is_detected():
    def last_only(messages):  # keeps the text of the last assistant turn alone
        out = "<s>"
        for k, m in enumerate(messages):
            out += f"({m['role']}:" + (m["text"] if k == len(messages) - 1 else "-") + ")"
        return out

    r = chat.render([{"role": "user", "text": "hello"}, {"role": "assistant", "text": "there"}], last_only)
    assert r.rewritten_at == len("<s>(user:")


def test_query_form(session):
    text = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", text), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, "tool", "y"), (None, 3, "user", "q"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (4, 0, "user", "é" * 100000), (5, None, "assistant", "n"), (5, 1, "assistant", "m")]
    rows += [(9, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(120)]
    df = session.createDataFrame([(*r, 7) for r in rows], ROWS + ", turns int")
    got = {r.conv_id: r for r in chat.digest(df).collect()}
    by = {}
    for c, t, role, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role is not None, role or "", x is not None, x or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(x for *_, role, _, x in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{role}\n{x}\n" for *_, role, _, x in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    assert chat.digest(session.createDataFrame([], ROWS)).count() == 0
