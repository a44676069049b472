"""Chat formatting by incremental black-box rendering.

A template is any function from a list of messages to a string. For every turn the prefix up to
it is rendered and compared with the prefix before: if the earlier output is a prefix of the
later one, the rest is the turn's span; if not, the template rewrites history, and the place
where the outputs part is recorded. The text inside a span is found by rendering the turn once
more with a probe in place of its text, which shows what the template puts around it.

Conversations are dealt out by their id and sorted by turn within a partition; a worker holds
one conversation at a time. Its cost grows with the square of the number of turns, as every
prefix is rendered. Rows of equal turn are ordered by role and text; null texts and roles count
as empty; rows without an id form one conversation.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Message = dict[str, str]
PROBE = "\ue000\ue001\ue000"

# The control strings of the built-in template.
START = "<s>"
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE]", "[TEXT]", "[/TEXT]")
CONTROL = sorted({START, *OTHER, *(m for pair in MARKS.values() for m in pair)}, key=len, reverse=True)

_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = re.compile(rf"([\[<])(\\*)(?={_TAILS})")
_UNESCAPE = re.compile(rf"([\[<])\\(\\*)(?={_TAILS})")
_MARK = re.compile("|".join(map(re.escape, CONTROL)))


@functools.lru_cache(1024)
def escape(text: str) -> str:
    """Put a backslash after the first character of each control string; of escaped ones, one more."""
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def template(messages: list[Message]) -> str:
    """The built-in template: every turn between marks of its role, texts escaped."""
    out = [START]
    for m in messages:
        if m["role"] in MARKS:
            a, z = MARKS[m["role"]]
            out += [a, escape(m["text"]), z]
        else:
            out += [OTHER[0], escape(m["role"]), OTHER[1], escape(m["text"]), OTHER[2]]
    return "".join(out)


def parse(formatted: str) -> list[Message]:
    """The messages that :func:`template` formatted."""
    opened = {a: (role, z) for role, (a, z) in MARKS.items()}
    out, marks = [], list(_MARK.finditer(formatted))
    i = 1  # after the start
    while i < len(marks):
        m = marks[i]
        if m[0] in opened:
            out.append({"role": opened[m[0]][0], "text": unescape(formatted[m.end() : marks[i + 1].start()])})
            i += 2
        else:
            out.append({"role": unescape(formatted[m.end() : marks[i + 1].start()]), "text": unescape(formatted[marks[i + 1].end() : marks[i + 2].start()])})
            i += 3
    return out


@dataclass
class Rendered:
    """What the prefixes of a conversation show: turns as (start, end, text start, text end)."""

    text: str
    spans: list[tuple[int, int, int, int]] = field(default_factory=list)
    rewritten_at: int | None = None  # the first place that a later turn changed


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def render(messages: list[Message], format_: Callable[[list[Message]], str] = template) -> Rendered:
    before = format_([])
    out = Rendered(before)
    for k, m in enumerate(messages):
        now = format_(messages[: k + 1])
        start = len(before)
        if not now.startswith(before):
            start = _common(before, now)
            out.rewritten_at = start if out.rewritten_at is None else min(out.rewritten_at, start)
        probe = format_([*messages[:k], {**m, "text": PROBE}])
        at = probe.find(PROBE, start)
        tail = len(probe) - at - len(PROBE)
        text = (at, max(at, len(now) - tail)) if at >= 0 else (start, start)  # no text if the template drops it
        out.spans.append((start, len(now), *text))
        before = now
    out.text = before
    return out


_KIND = (
    "conv_id long, formatted string, rewritten_at int, "
    "turns array<struct<role:string,start:int,end:int,text_start:int,text_end:int>>"
)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Message]]]:
    """Conversations of a sorted stream of rows."""
    key, turns = None, []
    for batch in batches:
        cols = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
        for conv, role, text in zip(*cols, strict=True):
            if turns and conv != key:
                yield key, turns
                turns = []
            key = conv
            turns.append({"role": role or "", "text": text or ""})
    if turns:
        yield key, turns


def _format(format_):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for conv, messages in _conversations(batches):
            r = render(messages, format_)
            turns = [dict(zip(("start", "end", "text_start", "text_end"), s, strict=True), role=m["role"]) for m, s in zip(messages, r.spans, strict=True)]
            rows.append({"conv_id": conv, "formatted": r.text, "rewritten_at": r.rewritten_at, "turns": turns})
            size += len(r.text)
            if size > 1 << 22:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    return run


_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()), ("formatted", pa.string()), ("rewritten_at", pa.int32()),
        ("turns", pa.list_(pa.struct([("role", pa.string()), *((c, pa.int32()) for c in ("start", "end", "text_start", "text_end"))]))),
    ]
)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def formatted(conversations: DataFrame, format_: Callable[[list[Message]], str] = template) -> DataFrame:
    """``(conv_id, formatted, rewritten_at, turns)``: one row for each conversation.

    ``turns`` holds each turn's span and that of its text, in code points of ``formatted``.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_format(format_), _KIND)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_turns, turns_sha, chars, loss_sha, size = [], [], [], [], []
        for text, turns in zip(batch.column("formatted").to_pylist(), batch.column("turns").to_pylist(), strict=True):
            messages = parse(text)
            n_turns.append(len(messages))
            turns_sha.append(hashlib.sha256("".join(f"{m['role']}\n{m['text']}\n" for m in messages).encode()).hexdigest())
            loss = "".join(unescape(text[t["text_start"] : t["text_end"]]) for t in turns if t["role"] == "assistant")
            chars.append(len(loss))
            loss_sha.append(hashlib.sha256(loss.encode()).hexdigest())
            size.append(len(text))
        cols = (batch.column("conv_id"), pa.array(n_turns, pa.int64()), pa.array(turns_sha), pa.array(chars, pa.int64()), pa.array(loss_sha), pa.array(size, pa.int64()))
        yield pa.RecordBatch.from_arrays(list(cols), names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digest(conversations: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations and their loss masks hold."""
    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted(conversations).mapInArrow(_read_back, kind)
