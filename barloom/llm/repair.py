"""Conversation structure repair: the cheapest edits that make roles read ``(s?(ua)+)?``.

Rows are kept (K), given another role (R), deleted (D), or rows without text are inserted (I).
The state of a repaired prefix is one of four: nothing yet, after ``s``, after ``u``, after ``a``;
it fixes which role may follow, so every letter leads to one state at most.

1. Faults. Equal rows of one turn are counted, not repeated; a row is a duplicate unless its turn
   is the first that holds its role and text, which is a grouped minimum joined back.
2. Blocks. A range exchange deals the rows out in order of conversation and turn, so that a long
   conversation is spread over tasks, and every stretch of at most ``BLOCK`` rows of one
   conversation becomes a block with the cheapest costs from each state before it to each after it.
3. The costs of blocks are composed as products of 4 x 4 matrices (minimum of sums), which gives
   what is still to be paid behind every block; the cost DP then runs inside the blocks.
4. Ranking. The nodes of a block are its (row, state) pairs with their optimal arcs. They are
   ranked by the audit letters of the next 1, 2, 4, ... steps: the rank of twice the length is
   that of the pair (rank here, rank where the pointer leads), and the pointers double with it.
   The arc of the least (letter, rank of its end) is taken; doubled pointers then give the length
   of the path and every node on it without a walk. Where a path leaves a block is again composed
   over the blocks of a conversation, as maps of four states.
5. Edits and texts are dealt out by conversation and streamed in order. The digest of a
   conversation is one SHA-256 over all its turns, which only one task can compute; it holds one
   row at a time and the audit string.

Defined cases: null roles and texts are one space, and so is a null id or turn in the string that
picks the damage; null turns come first; rows of one turn come by role, then by the hash of role
and text; rows with a null conversation id form one conversation; other columns are not looked at;
an empty table has no conversations; long texts are only hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import NO_ID, own_exchange, staged
from barloom.operators.ordered import carried

BLANKS = " \t\n\x0b\x0c\r"
BLOCK = 2048
FIRST = -(2**63)  # a null turn
RETURNED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

# States: nothing yet 0, after s 1, after u 2, after a 3.
_INSERTED = np.array([2, 2, 3, 2])  # the state after the role that may be inserted
_INITIALS = {"s": 1, "u": 2, "a": 3}
_KEPT = np.full((4, 4), -1)  # (initial, state) -> state
_KEPT[1, 0] = 1
_KEPT[2, [0, 1, 3]] = 2
_KEPT[3, 2] = 3
_TAIL = np.array([0.0, 4.0, 2.0, 0.0])  # inserts that end a repaired conversation
_LETTERS = b"\0DIKR"
_DELETE, _INSERT, _KEEP, _REROLE = 1, 2, 3, 4


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv, turn, role, text)`` with the faults that ``crc32(conv_id:turn) % 20`` picks."""
    space = F.lit(" ")
    number = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), space)
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(FIRST)).alias("turn"),
        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(F.concat(number("conv_id"), F.lit(":"), number("turn")).cast("binary")) % 20).alias("pick"),
    )
    pick = F.col("pick")
    text = F.when(pick == 1, "").when(pick == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(pick == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(pick != 0).select("conv", "turn", F.when(pick == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _hash() -> F.Column:
    """128 bits of role and text."""
    return F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))).alias("h")


def faults(rows: DataFrame) -> DataFrame:
    """Equal rows counted: ``(conv, turn, role, h, k, fault)``; fault 1 blank, 2 duplicate, 3 truncated, else 0.

    Of ``k`` equal rows that are not blank, all but the first are duplicates anyway.
    """
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    kind = F.when(end == "", 1).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    slim = rows.select("conv", "turn", "role", _hash(), kind.cast("byte").alias("kind"))
    slim = slim.groupBy("conv", "turn", "role", "h", "kind").agg(F.count("*").alias("k"))
    first = slim.groupBy("conv", "h").agg(F.min("turn").alias("t0")).select(F.struct("conv", "h", F.col("t0").alias("turn")).alias("f"))
    met = slim.join(first, F.struct("conv", "h", "turn") == F.col("f"), "left")
    fault = F.when(F.col("kind") == 1, 1).when(F.col("f").isNull(), 2).otherwise(F.col("kind")).cast("byte")
    return met.select("conv", "turn", "role", "h", "k", fault.alias("fault"))


# --- cost DP -----------------------------------------------------------------------------


class Rows:
    """Rows of several blocks, one after the other; ``at[b]:at[b + 1]`` are those of block b."""

    def __init__(self, at: np.ndarray, initial: np.ndarray, fault: np.ndarray, k: np.ndarray):
        self.at, self.initial, self.k = at, initial, k.astype(np.float64)
        self.size = np.diff(at)
        self.must = (fault == 1) | (fault == 2)
        self.extra = 3.0 * (self.k - 1) + (fault == 3)  # with K or R: the other equal rows go
        # positions: one more than rows in every block
        self.first = at[:-1] + np.arange(len(self.size))
        self.of_row = np.arange(at[-1]) + np.repeat(np.arange(len(self.size)), self.size)

    def arcs(self, ahead: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cost of D, K and R from each state of rows ``r``, given the costs behind the rows."""
        extra = np.where(self.must[r], np.inf, self.extra[r])
        extra = extra.reshape(-1, *[1] * (ahead.ndim - 1))
        gone = 3 * self.k[r].reshape(extra.shape) + ahead
        to = _KEPT[self.initial[r]]
        kept = np.where((to >= 0).reshape(*to.shape, *[1] * (ahead.ndim - 2)), np.take_along_axis(ahead, np.maximum(to, 0).reshape(*to.shape, *[1] * (ahead.ndim - 2)), 1), np.inf) + extra
        other = 2 + ahead[:, _INSERTED] + extra
        return gone, kept, other

    def costs(self, behind: np.ndarray) -> np.ndarray:
        """Least cost from every (position, state); ``behind`` is what is due behind each block."""
        out = np.empty((int(self.at[-1]) + len(self.size), *behind.shape[1:]))
        out[self.first + self.size] = behind
        for s in range(1, int(self.size.max(initial=0)) + 1):
            b = np.flatnonzero(self.size >= s)
            p = (self.first + self.size)[b] - s
            row = np.minimum(np.minimum(*(x := self.arcs(out[p + 1], p - b))[:2]), x[2])
            after_u, after_a = np.minimum(row[:, 2], 2 + row[:, 3]), np.minimum(row[:, 3], 2 + row[:, 2])
            out[p, 0], out[p, 1] = np.minimum(row[:, 0], 2 + after_u), np.minimum(row[:, 1], 2 + after_u)
            out[p, 2], out[p, 3] = after_u, after_a
        return out

    def matrices(self) -> np.ndarray:
        """Least cost through each block, from each state before it to each behind it."""
        unit = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
        return self.costs(np.repeat(unit[None], len(self.size), 0))[self.first]

    def optimal(self, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Optimal arcs as (node, letter, node it leads to), and the cost of every (position, state)."""
        cost = self.costs(behind)
        p = self.of_row
        gone, kept, other = self.arcs(cost[p + 1], np.arange(len(p)))
        here = cost[p]
        state = np.arange(4)
        found = []
        for letter, value, to, ahead in (
            (_DELETE, gone, np.broadcast_to(state, here.shape), 1), (_INSERT, 2 + here[:, _INSERTED], np.broadcast_to(_INSERTED, here.shape), 0),
            (_KEEP, kept, np.maximum(_KEPT[self.initial], 0), 1), (_REROLE, other, np.broadcast_to(_INSERTED, here.shape), 1),
        ):
            i, q = np.nonzero(np.isfinite(value) & (value == here))
            found.append(np.stack([4 * p[i] + q, np.full(len(i), letter), 4 * (p[i] + ahead) + to[i, q]]))
        return *np.concatenate(found, axis=1), cost


def ranked(nodes: int, source: np.ndarray, letter: np.ndarray, target: np.ndarray, steps: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The letter to take at every node (0 where no arc leaves) and pointers doubled up to ``steps``.

    No two arcs of a node have the same letter, so a node's least letters lead to one node.
    """
    order = np.lexsort((letter, source))
    head = order[np.append(True, source[order][1:] != source[order][:-1])] if len(order) else order
    rank, pointer = np.zeros(nodes, np.int64), np.arange(nodes)
    rank[source[head]], pointer[source[head]] = letter[head], target[head]
    length = 1
    while length < steps:
        pair = rank * (int(rank.max(initial=0)) + 1) + rank[pointer]
        rank = np.unique(pair, return_inverse=True)[1]
        pointer = pointer[pointer]
        length *= 2
    order = np.lexsort((rank[target], letter, source))
    head = order[np.append(True, source[order][1:] != source[order][:-1])] if len(order) else order
    taken, pointer = np.zeros(nodes, np.int64), np.arange(nodes)
    taken[source[head]], pointer[source[head]] = letter[head], target[head]
    doubled = [pointer]
    while 2 ** len(doubled) < steps:
        doubled.append(doubled[-1][doubled[-1]])
    return taken, doubled


def paths(taken: np.ndarray, doubled: list[np.ndarray], start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of the paths from ``start``, one path after the other, their lengths, and where they end."""
    v, length = start.copy(), np.where(taken[start] > 0, 1, 0)
    for k in range(len(doubled) - 1, -1, -1):
        to = doubled[k][v]
        go = taken[to] > 0
        v, length = np.where(go, to, v), np.where(go, length + 2**k, length)
    end = doubled[0][v]
    node = np.repeat(start, length)
    step = np.arange(len(node)) - np.repeat(np.cumsum(length) - length, length)
    for k, to in enumerate(doubled):
        node = np.where(step >> k & 1, to[node], node)
    return node, length, end


# --- blocks ------------------------------------------------------------------------------

_BLOCK = "conv long, part int, seq long, through array<double>, turn array<long>, role array<string>, h array<binary>, k array<long>, fault array<tinyint>"


def _initials(role: pa.Array) -> np.ndarray:
    first = pc.utf8_slice_codeunits(role, 0, 1)
    known = pc.index_in(first, pa.array(list(_INITIALS)))
    return pc.add(pc.fill_null(known, -1), 1).to_numpy(zero_copy_only=False)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column("conv").to_numpy()
        head = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
        place = np.arange(n) - np.repeat(head, np.diff(np.append(head, n)))
        at = np.append(np.flatnonzero(place % BLOCK == 0), n)
        nb = len(at) - 1
        rows = Rows(at, _initials(batch.column("role")), batch.column("fault").to_numpy(), batch.column("k").to_numpy())
        lists = [pa.ListArray.from_arrays(at.astype(np.int32), batch.column(c)) for c in ("turn", "role", "h", "k", "fault")]
        through = pa.ListArray.from_arrays(np.arange(0, 16 * nb + 1, 16, dtype=np.int32), pa.array(rows.matrices().ravel()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(conv[at[:-1]]), pa.array(np.full(nb, part, np.int32)), pa.array(np.arange(seq, seq + nb)), through, *lists],
            names=["conv", "part", "seq", "through", "turn", "role", "h", "k", "fault"],
        )
        seq += nb


def _times(a, b) -> list[float]:
    a, b = np.reshape(a, (4, 4)), np.reshape(b, (4, 4))
    return (a[:, :, None] + b[None]).min(1).ravel().tolist()


def _earlier(b, a) -> list[float]:
    """Blocks are composed from the last one; ``a`` stands before ``b``."""
    return _times(a, b)


def _then(a, b) -> list[float]:
    return [b[int(q)] for q in a]


def _opened(batch: pa.RecordBatch) -> tuple[Rows, np.ndarray]:
    turn = batch.column("turn")
    at = np.append(0, np.cumsum(pc.list_value_length(turn).to_numpy())).astype(np.int64)
    role, k, fault = (batch.column(c).flatten() for c in ("role", "k", "fault"))
    behind = np.full((batch.num_rows, 4), np.inf)
    after = batch.column("after")
    behind[:] = _TAIL
    some = np.flatnonzero(pc.is_valid(after).to_numpy(zero_copy_only=False))
    if len(some):
        m = after.take(pa.array(some)).flatten().to_numpy().reshape(-1, 4, 4)
        behind[some] = (m + _TAIL).min(2)
    return Rows(at, _initials(role), fault.to_numpy(), k.to_numpy()), behind


def _solved(rows: Rows, behind: np.ndarray):
    source, letter, target, cost = rows.optimal(behind)
    steps = 3 * int(rows.size.max(initial=0)) + 1  # at most two inserts before a row
    return (*ranked(4 * len(cost), source, letter, target, steps), cost)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        rows, behind = _opened(batch)
        taken, doubled, _ = _solved(rows, behind)
        start = (4 * rows.first[:, None] + np.arange(4)).ravel()
        leads = paths(taken, doubled, start)[2] % 4
        lists = pa.ListArray.from_arrays(np.arange(0, 4 * batch.num_rows + 1, 4, dtype=np.int32), pa.array(leads.astype(np.float64)))
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("idx"), lists], names=["conv", "idx", "leads"])


_EDIT = "conv long, turn long, role string, h binary, k long, fault tinyint, letter tinyint, state tinyint, inserts tinyint, cost long, tail tinyint"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each row of a block: the letter, the state before it, and inserts before that.

    ``cost`` stands in the first row of a conversation, ``tail`` (inserts at the end) in its last.
    """
    for batch in batches:
        nb = batch.num_rows
        if not nb:
            continue
        rows, behind = _opened(batch)
        taken, doubled, cost = _solved(rows, behind)
        entry = pc.fill_null(pc.list_element(batch.column("before"), 0), 0.0).to_numpy(zero_copy_only=False).astype(np.int64)
        node, _, end = paths(taken, doubled, 4 * rows.first + entry)
        on_row = np.flatnonzero(taken[node] != _INSERT)  # one for each row, in order
        inserts = np.diff(on_row, prepend=-1) - 1
        first, last = rows.at[:-1], rows.at[1:] - 1
        due, tail = np.full(len(on_row), -1, np.int64), np.zeros(len(on_row), np.int8)
        opens = pc.is_null(batch.column("before")).to_numpy(zero_copy_only=False)
        closes = pc.is_null(batch.column("after")).to_numpy(zero_copy_only=False)
        due[first[opens]] = cost[rows.first[opens], 0]
        tail[last[closes]] = _TAIL[end[closes] % 4] / 2
        conv = batch.column("conv").take(pa.array(np.repeat(np.arange(nb), rows.size)))
        flat = [batch.column(c).flatten() for c in ("turn", "role", "h", "k", "fault")]
        yield pa.RecordBatch.from_arrays(
            [
                conv, *flat, pa.array(taken[node[on_row]].astype(np.int8)), pa.array((node[on_row] % 4).astype(np.int8)),
                pa.array(inserts.astype(np.int8)), pa.array(due, mask=due < 0), pa.array(tail),
            ],
            names=["conv", "turn", "role", "h", "k", "fault", "letter", "state", "inserts", "cost", "tail"],
        )


def edits(faulty: DataFrame) -> DataFrame:
    """The cheapest edits of the rows that :func:`faults` returns."""
    ordered = faulty.repartitionByRange("conv", "turn", "role", "h").sortWithinPartitions("conv", "turn", "role", "h")
    blocks = staged(ordered.mapInArrow(_cut, _BLOCK), "blocks")
    top = blocks.agg(F.max("seq"), F.max("part")).first()
    per_part, parts = (top[0] or 0) + 1, (top[1] or 0) + 1
    blocks = blocks.withColumn("idx", F.col("part") * F.lit(per_part) + F.col("seq"))
    several = blocks.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select(own_exchange("conv").alias("c"))
    long = staged(blocks.join(several, own_exchange("conv") == F.col("c")).drop("c", "part", "seq"), "long")
    back = long.select("conv", (F.lit(per_part * parts) - F.col("idx")).alias("idx"), "through")
    after = carried(back, ["conv"], "idx", "through", _earlier)
    after = after.select(F.struct("conv", (F.lit(per_part * parts) - F.col("idx")).alias("idx")).alias("a"), F.col("before").alias("after"))
    long = staged(long.join(after, F.struct("conv", "idx") == F.col("a"), "left").drop("a", "through"), "long")
    leads = staged(long.mapInArrow(_exits, "conv long, idx long, leads array<double>"), "leads")
    before = carried(leads, ["conv"], "idx", "leads", _then).select(F.struct("conv", "idx").alias("a"), "before")
    long = long.join(before, F.struct("conv", "idx") == F.col("a"), "left").drop("a")
    empty = F.lit(None).cast("array<double>")
    short = blocks.join(several, own_exchange("conv") == F.col("c"), "left_anti").withColumns({"after": empty, "before": empty})
    wanted = ["conv", "turn", "role", "h", "k", "fault", "after", "before"]
    return short.select(*wanted).union(long.select(*wanted)).mapInArrow(_edits, _EDIT)


# --- whole conversations -----------------------------------------------------------------

_LEGAL = {(1, 2), (2, 3), (3, 2)}


class _Conversation:
    def __init__(self, conv: int):
        self.conv, self.audit, self.sha, self.any = conv, [], hashlib.sha256(), False
        self.counts = [0, 0, 0]  # blank, duplicate, truncated
        self.low = self.high = self.last = None
        self.turns = self.illegal = self.cost = self.closing = 0
        self.act = None

    def line(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def inserted(self, n: int, state: int) -> None:
        """``n`` rows without text, the last of which leads to ``state``."""
        for j in range(n):
            self.line("user" if (state == 2) == ((n - 1 - j) % 2 == 0) else "assistant", "")

    def edit(self, r: dict) -> None:
        k, fault, initial = r["k"], r["fault"], _INITIALS.get(r["role"][:1], 0)
        if fault == 1:
            self.counts[0] += k
        else:
            self.counts[1] += k if fault == 2 else k - 1
            self.counts[2] += fault == 3
        if r["turn"] != FIRST:
            if self.low is None or r["turn"] != self.high:
                self.turns += 1
            self.low = r["turn"] if self.low is None else self.low
            self.high = r["turn"]
        self.illegal += k - 1 + (self.last is not None and (self.last, initial) not in _LEGAL)
        self.last = initial
        self.cost = self.cost if r["cost"] is None else r["cost"]
        letter, state, n = r["letter"], r["state"], r["inserts"]
        self.inserted(n, state)
        self.audit.append(b"I" * n + _LETTERS[letter : letter + 1] + b"D" * (k - 1))
        self.act = None if letter == _DELETE else (r["turn"], r["h"], r["role"] if letter == _KEEP else "assistant" if state == 2 else "user")
        self.closing = r["tail"]
        self.audit.append(b"I" * r["tail"])

    def text(self, r: dict) -> None:
        if self.act and self.act[:2] == (r["turn"], r["h"]):
            self.line(self.act[2], r["text"])
            self.act = None  # equal rows follow

    def row(self) -> tuple:
        self.inserted(self.closing, 3)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        conv = None if self.conv == NO_ID else self.conv
        return conv, gaps, *self.counts, self.illegal, self.cost, b"".join(self.audit).decode(), self.sha.hexdigest()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    names = [c.split()[0] for c in RETURNED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if now is None or r["conv"] != now.conv:
                if now is not None:
                    rows.append(now.row())
                now = _Conversation(r["conv"])
            if r["letter"] is None:
                now.text(r)
            else:
                now.edit(r)
        if len(rows) >= 4096:
            yield _batch(rows)
            rows = []
    if now is not None:
        rows.append(now.row())
    if rows:
        yield _batch(rows)


def repaired(rows: DataFrame) -> DataFrame:
    """Faults, costs, audit and digest of the conversations in ``rows(conv, turn, role, text)``."""
    found = edits(faults(rows)).withColumn("text", F.lit(None).cast("string"))
    names = found.columns
    texts = rows.select("conv", "turn", "role", _hash(), "text")
    texts = texts.select(*[c if c in texts.columns else F.lit(None).cast(found.schema[c].dataType).alias(c) for c in names])
    dealt = found.union(texts).repartition("conv").sortWithinPartitions("conv", "turn", "role", "h", F.col("letter").isNull())
    return dealt.mapInArrow(_streamed, RETURNED)


def digest(conversations: DataFrame) -> DataFrame:
    """One row for each id of ``conversations``, after its rows were damaged and repaired."""
    out = repaired(damaged(conversations))
    ids = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("c")).distinct()
    out = ids.join(out, F.col("c") == F.coalesce("conv_id", F.lit(NO_ID)), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return out.select(F.when(F.col("c") != NO_ID, F.col("c")).alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
