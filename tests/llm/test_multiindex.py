import numpy as np
import pytest

from barloom.llm import multiindex
from barloom.session import checkpoint_dir, ship

ROWS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def session(spark):
    ship(spark)
    checkpoint_dir(spark)
    return spark


def corpus(seed, n=260, dim=16):
    g = np.random.default_rng(seed)
    rows, centres = [], g.normal(size=(8, dim))
    for i in range(n):
        x = centres[i % 3] + g.normal(size=dim) * 0.05 * (i % 4) if i % 2 else g.normal(size=dim)
        rows.append((i + 10, [float(v) for v in x.astype(np.float32)], int(i % 5 == 0)))
    rows += [(1, rows[1][1], 0), (2, rows[1][1], 0), (2, rows[1][1], 0), (3, [2 * v for v in rows[1][1]], 0), (None, rows[1][1], 0)]
    nan, inf = float("nan"), float("inf")
    rows += [(4, None, 0), (5, [0.0] * dim, 0), (6, [nan] * dim, 0), (7, [inf] + [1.0] * (dim - 1), 0), (8, [None] + [1.0] * (dim - 1), 0), (9, rows[1][1], None), (0, [1.0, 2.0], 0), (500, [], 0)]
    return rows


def brute(rows, threshold=0.98):
    def unit(e, label):
        if label is None or not e or any(v is None or not np.isfinite(v) for v in e) or not any(e):
            return None
        x = np.array(e, float)
        return x / np.linalg.norm(x)

    units = [unit(e, lab) for _, e, lab in rows]
    links = [[] for _ in rows]
    for i, x in enumerate(units):
        for j in range(i):
            y = units[j]
            if x is not None and y is not None and rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y >= threshold:
                links[i].append(j)
                links[j].append(i)
    out, last = [], 2**63 - 1
    ids = [last if r[0] is None else r[0] for r in rows]
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min(ids[j] for j in seen)
        out.append((rows[i][0], len(links[i]), None if low == last else low, low == ids[i]))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1024, 9])
def test_matches_brute_force(session, block):
    rows = corpus(1)
    df = session.createDataFrame([(*r, 1, 2) for r in rows], ROWS + ", node int, links int").repartition(3)
    got = multiindex.linked(df, block=block, codes=6)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty_table(session):
    assert multiindex.linked(session.createDataFrame([], ROWS)).count() == 0


def test_traversal_yields_cells_by_distance():
    g = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 5), (7, 4)):
        a, b = g.random(n).round(1), g.random(m).round(1)
        cells = list(multiindex.traverse(a, b, 1.1))
        cost = [a[i] + b[j] for i, j in cells]
        assert cost == sorted(cost) and len(set(cells)) == len(cells)
        assert len(cells) == sum(x + y <= 1.1 for x in a for y in b)


def test_bounds_hold():
    g = np.random.default_rng(3)
    x = g.normal(size=(400, 8))
    c = multiindex.kmeans(x, 9)
    low, code = multiindex.bounds(x, c), multiindex.distances(x, c).argmin(1)
    for i in range(9):
        for p, b in zip(x, low[:, i]):
            if (code == i).any():
                assert b <= ((x[code == i] - p) ** 2).sum(1).min() + 1e-9


def test_pieces_meet_every_pair_once_and_members_are_dealt_once(session):
    """The table of row sizes is broadcast: the only exchange of members is the one to their pieces."""
    members = [(1, 2, 7, k, 1, k < 5, 0, b"", b"") for k in range(45)]  # five stored in blocks of two, and forty visitors
    work = multiindex._pieces(session.createDataFrame(members, multiindex._MEMBER), 2)
    plan = work._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    sides = {}
    for r in work.collect():
        sides.setdefault((r.piece, r.l, r.r), ([], []))[r.side].append(r.node)
    met = []
    for (_, at, to), (left, right) in sides.items():
        met += [(a, b) for a in left for b in (left if at == to else right) if at != to or a < b]
    assert all(a < 5 for a, _ in met)
    assert len({frozenset(p) for p in met}) == len(met) == 10 + 5 * 40
    assert len(sides) <= 6 + 3 * 5  # forty visitors are five blocks of eight
