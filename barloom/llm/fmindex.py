"""Benchmark decontamination: FM-indexes of document shards, searched for test phrases.

A shard is a slice of documents. Its text is the sequence of word symbols, the alphabet being
the words of the phrases: a stretch of words that are all in the alphabet is a string, any
other word only parts strings, and strings shorter than the shortest window cannot hold one and
are left out. The index holds the Burrows-Wheeler transform of the strings in a wavelet matrix,
symbol counts, and suffix positions sampled at every ``SAMPLE``-th word and at string starts.
Windows of all items are searched backward at once; their rows are walked to the next sampled
position; hit words become maximal removal spans, and windows name the items they stand in.

The phrases are searched in blocks of about ``BLOCK_BYTES`` of text (or one item), so what is
broadcast does not grow with the benchmark; every block passes over all documents in place,
without a shuffle.

Defined cases: null and empty texts have no words; items without words are never found; an item
with a null id marks hits but is not named; an id that occurs in several rows is one item whose
windows are those of all its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import words
from barloom.llm.common import text_buffer, text_slices

WINDOW = 10
SAMPLE = 8
SLICE_BYTES = 3 << 20
BLOCK_BYTES = 4 << 20
_FOUND = "n_words long, spans array<struct<lo:int,hi:int>>, items array<long>"


class WaveletMatrix:
    """Ranks and symbols of a sequence; one packed bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.n = len(symbols)
        self.levels = []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            packed = np.zeros(self.n // 64 * 8 + 8, np.uint8)
            raw = np.packbits(ones, bitorder="little")
            packed[: len(raw)] = raw
            packed = packed.view(np.uint64)
            before = np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64))[:-1]
            self.levels.append((bit, packed, before, self.n - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    @staticmethod
    def _ones(packed, before, i):
        part = packed[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return before[i >> 6] + np.bitwise_count(part)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands in the first ``i`` places."""
        first = np.zeros_like(i)
        for bit, packed, before, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            a, b = self._ones(packed, before, first), self._ones(packed, before, i)
            first = np.where(one, zeros + a, first - a)
            i = np.where(one, zeros + b, i - b)
        return i - first

    def symbol(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for bit, packed, before, zeros in self.levels:
            a = self._ones(packed, before, i)
            one = (packed[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            out |= one.astype(out.dtype) << bit
            i = np.where(one, zeros + a, i - a)
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; every 0 ends a string and differs from all other zeros."""
    n = len(text)
    rank = np.where(text == 0, np.cumsum(text == 0) - 1, text + int((text == 0).sum()))
    step = 1
    order = np.argsort(rank, kind="stable")
    rank = np.append(0, np.cumsum(rank[order][1:] != rank[order][:-1]))[np.argsort(order)] if n else rank
    while n and rank.max() < n - 1:
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.append(0, np.cumsum(s[1:] != s[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
    return order


class FMIndex:
    """Index of strings of symbols 1..top, each ended by a 0."""

    def __init__(self, text: np.ndarray, top: int):
        self.order = order = suffix_order(text)
        before = np.where(order > 0, text[order - 1], 0)
        self.bwt = WaveletMatrix(before, top)
        ends = int((text == 0).sum())
        self.start = ends + np.append(0, np.cumsum(np.bincount(text[text > 0], minlength=top + 1)))
        keep = (order % SAMPLE == 0) | (before == 0)
        self.sampled = np.full(len(text), -1, np.int64)
        self.sampled[keep] = order[keep]
        del self.order

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose suffixes begin with each phrase; phrases of one length, a row each."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.bwt.n, np.int64)
        for c in phrases.T[::-1]:
            lo, hi = self.start[c] + self.bwt.rank(c, lo), self.start[c] + self.bwt.rank(c, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk to the next sampled one."""
        out = np.empty(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows, 0
        while len(todo):
            pos = self.sampled[at]
            done = pos >= 0
            out[todo[done]] = pos[done] + steps
            todo, at = todo[~done], at[~done]
            c = self.bwt.symbol(at)
            at = self.start[c] + self.bwt.rank(c, at)
            steps += 1
        return out


class Phrases:
    """Windows of a block of items over the alphabet of their words."""

    def __init__(self, ids: list[int | None], texts: list[str | None], window: int):
        h, _, _, wb = words.hashes(*text_buffer(pa.array(texts, pa.string())), words.FOLDED)
        self.alphabet = np.unique(h)
        symbol = np.searchsorted(self.alphabet, h) + 1
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.alphabet & np.uint64(0xFFFF)).astype(np.int64)] = True
        by_length: dict[int, dict[bytes, set]] = {}
        for i, (a, b) in enumerate(zip(wb[:-1], wb[1:], strict=True)):
            size = min(window, b - a)
            for k in range(a, b - size + 1) if size else ():
                by_length.setdefault(int(size), {}).setdefault(symbol[k : k + size].tobytes(), set()).add(ids[i])
        self.windows = [
            (np.array([np.frombuffer(w, symbol.dtype) for w in found]), [sorted(x for x in s if x is not None) for s in found.values()])
            for found in by_length.values()
        ]
        self.shortest = min(by_length, default=0)

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """Symbols of hashed words, 0 for words that no phrase has."""
        out = np.zeros(len(h), np.int64)
        at = np.flatnonzero(self.seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.searchsorted(self.alphabet, h[at])
        place[place == len(self.alphabet)] = 0
        same = self.alphabet[place] == h[at]
        out[at[same]] = place[same] + 1
        return out


def search(column: pa.Array, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word bounds of the texts, hit words, and ``(text, item)`` pairs of the windows that occur."""
    h, _, _, wb = words.hashes(*text_buffer(column), words.FOLDED)
    symbol = phrases.symbols(h)
    inside = symbol > 0
    change = np.zeros(len(h) + 1, bool)
    change[wb] = True
    first, size = words.runs(inside, change[:-1])
    first, size = first[size >= phrases.shortest], size[size >= phrases.shortest]
    cover = np.zeros(len(h) + 1, np.int32)
    pairs = []
    if len(first):
        head = np.append(0, np.cumsum(size + 1))  # each string is followed by its end
        word = np.arange(head[-1]) - np.repeat(head[:-1], size + 1) + np.repeat(first, size + 1)
        text = np.where(np.isin(np.arange(head[-1]), head[1:] - 1), 0, symbol[np.minimum(word, len(symbol) - 1)])
        index = FMIndex(text, len(phrases.alphabet))
        for windows, items in phrases.windows:
            lo, hi = index.ranges(windows)
            which = np.repeat(np.arange(len(lo)), np.maximum(hi - lo, 0))
            if not len(which):
                continue
            rows = np.arange(len(which)) - np.repeat(np.append(0, np.cumsum(np.maximum(hi - lo, 0)))[:-1], np.maximum(hi - lo, 0)) + lo[which]
            at = word[index.locate(rows)]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + windows.shape[1], -1)
            doc = np.searchsorted(wb, at, side="right") - 1
            d, w = np.divmod(np.unique(doc * len(windows) + which), len(windows))
            count = np.array([len(x) for x in items])
            flat = np.concatenate([np.array(x, np.int64) for x in items])
            skip = np.append(0, np.cumsum(count))[:-1]
            n = count[w]
            take = np.arange(n.sum()) - np.repeat(np.append(0, np.cumsum(n))[:-1], n) + np.repeat(skip[w], n)
            pairs.append(np.stack([np.repeat(d, n), flat[take]]))
    named = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.int64)
    return wb, np.cumsum(cover)[:-1] > 0, named[0], named[1]


def _lists(row: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(np.searchsorted(row, np.arange(n + 1)).astype(np.int32), values)


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    pairs = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
    return pa.array([words.cut(t, [(s["lo"], s["hi"]) for s in own], words.FOLDED) if own else t for t, own in pairs], pa.string())


def _pass(phrases, again: bool, keep_text: bool, cut_text: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ph = phrases.value
        for part in text_slices(batches, "text", SLICE_BYTES):
            n = part.num_rows
            wb, hit, doc, item = search(part.column("text"), ph)
            if again:  # what earlier blocks found
                spans, named = part.column("spans"), part.column("items")
                r, s = pc.list_parent_indices(spans).to_numpy(), spans.flatten()
                cover = np.zeros(len(hit) + 1, np.int32)
                np.add.at(cover, wb[r] + s.field("lo").to_numpy(), 1)
                np.add.at(cover, wb[r] + s.field("hi").to_numpy(), -1)
                hit |= np.cumsum(cover)[:-1] > 0
                doc = np.append(doc, pc.list_parent_indices(named).to_numpy())
                item = np.append(item, named.flatten().to_numpy())
                doc, item = np.unique(np.stack([doc, item]), axis=1)
            edge = np.zeros(len(hit) + 1, bool)
            edge[wb] = True
            lo, size = words.runs(hit, edge[:-1])
            row = np.searchsorted(wb, lo, side="right") - 1
            lo = (lo - wb[row]).astype(np.int32)
            pair = pa.StructArray.from_arrays([pa.array(lo), pa.array((lo + size).astype(np.int32))], ["lo", "hi"])
            spans, out = _lists(row, pair, n), {"row": part.column("row")}
            if cut_text:
                yield pa.RecordBatch.from_pydict(out | {"text": _cut(part.column("text"), spans)})
                continue
            if keep_text:
                out["text"] = part.column("text")
            yield pa.RecordBatch.from_pydict(out | {"n_words": pa.array(np.diff(wb).astype(np.int64)), "spans": spans, "items": _lists(doc, pa.array(item.astype(np.int64)), n)})

    return run


def contaminated_spans(docs: DataFrame, items: DataFrame, keep: list[str], item_id: str = "item_id", window: int = WINDOW, text_col: str = "text", keep_text: bool = False, block_bytes: int = BLOCK_BYTES, cut_text: bool = False) -> DataFrame:
    """``(row, [text,] n_words, spans, items)``: merged word spans to remove, and the items found.

    ``row`` is a struct of the columns ``keep``. With ``cut_text`` it is ``(row, text)``, the spans
    removed by the pass that finds the last of them: another pass in Python behind it would
    keep a second worker in every task.
    """
    spark = docs.sparkSession
    src = items.select(F.col(item_id).cast("long").alias("id"), F.col("text"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    out = docs.select(F.struct(*[f"`{c}`" for c in keep]).alias("row"), F.col(text_col).alias("text"))
    kind = out.schema["row"].dataType.simpleString()
    for b in range(blocks):
        mine = src.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect() if blocks > 1 else src.collect()
        phrases = spark.sparkContext.broadcast(Phrases([r.id for r in mine], [r.text for r in mine], window))
        if cut_text and b + 1 == blocks:
            return out.mapInArrow(_pass(phrases, b > 0, False, True), f"row {kind}, text string")
        text = keep_text or b + 1 < blocks
        out = out.mapInArrow(_pass(phrases, b > 0, text), f"row {kind}, {'text string, ' if text else ''}{_FOUND}")
    return out


def digest(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: words, hit words, and the items whose windows occur."""
    found = contaminated_spans(docs, items, ["doc_id"], **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the words that windows of ``items`` cover; rows and columns stay."""
    out = contaminated_spans(docs, items, [c for c in docs.columns if c != text_col], text_col=text_col, cut_text=True, **options)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
