import hashlib
import random

import pytest

from barloom.llm import lines
from barloom.session import checkpoint_dir, ship

ROWS = "doc_id long, text string"
LAST = 2**63 - 1


@pytest.fixture(scope="module")
def session(spark):
    ship(spark)
    checkpoint_dir(spark)
    return spark


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def kept(rows, least=3):
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(LAST if i is None else i)
    out = []
    for i, t in rows:
        stay = []
        for x in (t or "").split("\n"):
            h = holders[key(x)]
            if len(key(x)) < 20 or len(h) < least or (LAST if i is None else i) == max(h):
                stay.append(x)
        out.append((i, t, stay))
    return out


def brute(rows):
    return sorted(((i, len((t or "").split("\n")), len((t or "").split("\n")) - len(s), hashlib.sha256("\n".join(s).encode()).hexdigest()) for i, t, s in kept(rows)), key=str)


def corpus(seed, n=90):
    r = random.Random(seed)
    pool = ["Home | About | CONTACT us", "\t home | about | contact us \r", "ÄÖÜ ä line of some length É", "short", "nineteen characters", "twenty characters!!!", "", " \x0b\x0c "]
    pool += [f"a line that {k} documents hold" for k in range(6)]
    rows = [(None, "home | about | contact us\nx"), (None, None), (3, None), (4, ""), (5, "\n\n"), (6, pool[0] + "\n" + pool[0]), (6, pool[0]), (6, pool[0])]
    for i in range(10, n):
        own = [f"line {r.random()} of its own" for _ in range(r.randint(0, 4))]
        mine = own + [r.choice(pool) for _ in range(r.randint(0, 5))]
        r.shuffle(mine)
        rows.append((r.choice([i, -i]), "\n".join(mine)))
    return rows


@pytest.mark.parametrize(("seed", "batches", "fanout"), [(1, 4, 2), (2, 1, 2), (3, 5, 3)])
def test_matches_brute_force(session, seed, batches, fanout):
    rows = corpus(seed)
    got = lines.digest(session.createDataFrame(rows, ROWS).repartition(3), batches=batches, fanout=fanout)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_runs_in_any_order_and_levels(session):
    pairs = [[(d, h) for d in range(10 * b, 10 * b + 10) for h in (b"all", b"own%d" % d, b"few%d" % (d % 7))] for b in (2, 0, 4, 1, 3)]
    runs = lines.LineRuns(session, least=3, fanout=2)
    for b in pairs:
        runs.add(session.createDataFrame(b, "doc long, h binary"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    want = {}
    for b in pairs:
        for d, h in b:
            want.setdefault(h, set()).add(d)
    got = {bytes(r.h): (r.n, r["last"]) for r in runs.entries().collect()}
    assert got.keys() == want.keys()
    for h, d in want.items():
        n, last = got[h]
        assert last == max(d) and (n == len(d) if len(d) < 3 else 3 <= n <= len(d))


def test_runs_are_merged_without_exchange(session):
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        runs = lines.LineRuns(session, fanout=9)
        for b in range(2):
            runs.add(session.createDataFrame([(b, b"x"), (b, b"y%d" % b)], "doc long, h binary"))
        a, b = runs.runs()
        plan = a.join(b.select("h"), "h", "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        session.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_table_clashing_columns_and_long_text(session):
    assert lines.digest(session.createDataFrame([], ROWS)).count() == 0
    long = "\n".join(f"line {k % 9000} of a very long document" for k in range(20000))
    rows = [*corpus(4), (500, long), (501, long), (502, long)]
    df = session.createDataFrame([(i, t, k, "x", 1) for k, (i, t) in enumerate(rows)], "doc_id long, text string, h long, gone string, batch int")
    out = lines.without_repeats(df)
    assert out.columns == df.columns
    got = {r.h: r for r in out.collect()}
    assert len(got) == len(rows)
    for k, (i, t, stay) in enumerate(kept(rows)):
        assert (got[k].text or "") == "\n".join(stay) and got[k].gone == "x" and got[k].doc_id == i


def test_only_texts_that_lose_lines_go_to_python(session):
    """Others are counted and digested by Spark; keys beyond ASCII fold A-Z alone."""
    kept = ["\u212aELVIN scale of the line \u0130 \u00c9", "\u00c9LAN VITAL IS A LONG ENOUGH LINE", "PLAIN ascii LINE of enough letters"]
    same = [kept[0].replace("ELVIN", "elvin"), "\u00c9lan vital is a long enough line", "plain ASCII line OF enough letters"]
    other = [x.lower() for x in kept[:2]]  # Kelvin sign, dotted I and E acute are other letters in lower case
    rows = [(1, "\n".join(kept)), (2, "\n".join(same)), (3, "\n".join([*kept, ""])), (4, "\n".join(other)), (5, None), (6, "a\n\n")]
    out = lines.digest(session.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in out.collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {1: (3, 3, sha("")), 2: (3, 3, sha("")), 3: (4, 0, sha(rows[2][1])), 4: (2, 0, sha(rows[3][1])), 5: (1, 0, sha("")), 6: (3, 0, sha("a\n\n"))}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN isnotnull(gone" in plan and "sha2(" in plan
