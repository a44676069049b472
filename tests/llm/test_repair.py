import functools
import hashlib
import itertools
import random
import re
import sys
import zlib

import numpy as np
import pytest

from barloom.llm import repair
from barloom.session import checkpoint_dir, ship

ROWS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def session(spark):
    ship(spark)
    checkpoint_dir(spark)
    return spark


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        pick = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if pick == 1:
            text = ""
        if pick == 2:
            text = re.sub("[.!?]", "", text)
        if pick == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if pick == 0 else 2 if pick == 3 else 1)
    return out


def tie(r):
    h = hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    return (r[1] is not None, r[1] or 0, r[2].encode(), h)


def cheapest(rows, fault):
    """(cost, audit, repaired) by a plain recursion over (row, state, inserts so far)."""
    sys.setrecursionlimit(100000)
    after = {"s": 1, "u": 2, "a": 3}
    word = {2: "user", 3: "assistant"}

    @functools.cache
    def best(i, q, inserts):
        found = []
        if i == len(rows) and q in (0, 3):
            found.append((0, "", ()))
        if inserts < 3:
            to = 3 if q == 2 else 2
            c, a, out = best(i, to, inserts + 1)
            found.append((c + 2, "I" + a, (f"{word[to]}:", *out)))
        if i < len(rows):
            c, a, out = best(i + 1, q, 0)
            found.append((c + 3, "D" + a, out))
            if fault[i] not in ("blank", "duplicate"):
                more = fault[i] == "truncated"
                to = after.get(rows[i][2][:1])
                if (q, to) in {(0, 1), (0, 2), (1, 2), (3, 2), (2, 3)}:
                    c, a, out = best(i + 1, to, 0)
                    found.append((c + more, "K" + a, (f"{rows[i][2]}:{rows[i][3]}", *out)))
                to = 3 if q == 2 else 2
                c, a, out = best(i + 1, to, 0)
                found.append((c + 2 + more, "R" + a, (f"{word[to]}:{rows[i][3]}", *out)))
        return min(found, key=lambda x: x[:2]) if found else (10**9, "", ())

    return best(0, 0, 0)


def brute(rows):
    out = []
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in after if r[0] == conv), key=tie)
        seen, fault = set(), []
        for r in mine:
            ends = re.findall(r"[^\x20\x09-\x0D]", r[3])
            fault.append("blank" if not ends else "duplicate" if r[2:] in seen else "truncated" if ends[-1] not in ".!?" else "")
            seen.add(r[2:])
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, repaired = cheapest(mine, fault)
        sha = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        out.append((conv, gaps, *(fault.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=str)


def corpus(seed, n=150, longest=12):
    r = random.Random(seed)
    texts = ["Hello.", "Yes!", "no end", "", " \t\n", "What? ", "tail…", None, "ok.\x0b", "über"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "sys"]
    rows = []
    for c in range(n):
        turn = 0
        for _ in range(r.randint(1, longest)):
            turn += r.choice([0, 1, 1, 1, 2])
            rows.append((None if c == 3 else c, None if r.random() < 0.05 else turn, r.choice(roles), r.choice(texts)))
    return rows + rows[:20]


def got(session, rows, parts=4):
    return sorted(map(tuple, repair.digest(session.createDataFrame(rows, ROWS).repartition(parts)).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(session, seed):
    rows = corpus(seed)
    assert got(session, rows) == brute(rows)


def test_long_conversation_over_many_blocks(session, monkeypatch):
    """One conversation of 700 rows is cut at every range and batch; its blocks give one path."""
    r = random.Random(5)
    rows = corpus(3, 30)
    for t in range(700):
        rows.append((77, t, r.choice(["user", "assistant", "user", "assistant", "system"]), f"{r.randint(0, 400)} {r.choice(['.', '!', ''])}"))
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 23)
    try:
        assert got(session, rows, 9) == brute(rows)
    finally:
        session.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_blocks_compose_to_the_costs_of_the_whole():
    r = np.random.default_rng(1)
    n = 40
    initial, fault, k = r.integers(0, 4, n), r.integers(0, 4, n), r.integers(1, 3, n)
    whole = repair.Rows(np.array([0, n]), initial, fault, k).matrices()[0]
    parts = repair.Rows(np.array([0, 7, 8, 25, n]), initial, fault, k).matrices()
    product = functools.reduce(lambda a, b: np.reshape(repair._times(a, b), (4, 4)), parts)
    assert (whole == product).all()


def test_ranked_nodes_follow_the_least_letters():
    # 0 -D-> 1 -K-> 3, 0 -I-> 2 -D-> 3
    taken, doubled = repair.ranked(4, np.array([0, 0, 1, 2]), np.array([2, 1, 3, 1]), np.array([2, 1, 3, 3]), 3)
    node, length, end = repair.paths(taken, doubled, np.array([0, 3]))
    assert node.tolist() == [0, 1] and length.tolist() == [2, 0] and end.tolist() == [3, 3]


def test_empty_table_and_other_columns(session):
    assert repair.digest(session.createDataFrame([], ROWS)).count() == 0
    rows = corpus(6, 20)
    df = session.createDataFrame([(*r, "x", 1, 2) for r in rows], ROWS + ", h string, k long, conv long")
    assert sorted(map(tuple, repair.digest(df).collect()), key=str) == brute(rows)


def test_very_long_text_and_many_equal_rows(session):
    rows = [(1, 0, "user", "word " * 200000 + "."), (1, 1, "assistant", "x" * 100000)] + [(2, 5, "user", "again.")] * 500
    assert got(session, rows) == brute(rows)
