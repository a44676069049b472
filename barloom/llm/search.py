"""Ranked lexical search: the ``top`` best documents of every item, by integer scores.

1. Vectors. Every text is cut to terms; of each document its length and the frequencies of the
   terms that items use are written to the shared folder, a row for each slice of texts. The
   counts of the corpus (documents, terms, documents that hold a term) are sums over these rows.
2. Trees. For a group of documents and an item, the documents' vectors are restricted to the
   item's terms and ordered by frequency in the corpus, the most frequent first. Documents that
   share a prefix of present and absent terms share a path of the tree; at its end hang those of
   one set of terms. A node knows the largest tf of each term and the smallest m below it, and so
   bounds every score below it, as a score grows with tf and falls with m.
3. Branch and bound. A depth-first search takes the child of the larger bound first, scores whole
   leaves, and passes over nodes whose bound is below the item's ``top``-th score so far (equal
   bounds are visited: ids decide ties). What a task has found carries over to its next group.
4. Each task gives at most ``top`` rows an item; a ranking over all tasks follows.

Items are taken in blocks of about ``BLOCK_BYTES`` of terms; only such a block is broadcast, and
another block means another pass over the texts.

Defined cases: null and empty texts have no terms and are not counted; rows with equal ids are
ranked separately, a document without an id comes after the others of its score; rows of one
item id are one item; items without terms, or whose terms no document holds, have no rows; terms
are compared by 64-bit hashes and lengths; a very long text is a slice of its own.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm import words
from barloom.llm.common import NO_ID, blobs, ids_or_last, staged, text_buffer, text_slices

TOP = 10
SLICE_BYTES = 4 << 20
GROUP = 1 << 14  # documents of a tree
BLOCK_BYTES = 4 << 20
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SLICE = "doc binary, n binary, cuts binary, term binary, tf binary, documents long, terms long"


class Items:
    """The terms of a block of items; terms are numbered in the order of their hashes."""

    def __init__(self, rows: list[tuple[int | None, list[str]]]):
        names = sorted({t for _, ts in rows for t in ts})
        data, bounds = text_buffer(pa.array(names, pa.string()))
        h, starts, ends, _ = words.hashes(data, bounds, words.FOLDED)
        order = np.argsort(h)
        self.hash, self.size = h[order], (ends - starts)[order]
        number = {names[k]: i for i, k in enumerate(order)}
        self.ids = [i for i, _ in rows]
        self.terms = [np.array(sorted(number[t] for t in ts), np.int64) for _, ts in rows]

    def __len__(self) -> int:
        return len(self.hash)


def item_terms(items: DataFrame, item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct ``(item, term)``."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"({_TERM})"), 1)
    term = F.translate("term", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("term")
    return items.select(F.col(item_id).cast("long").alias("item"), F.explode(found).alias("term")).select("item", term).distinct()


def _vectors(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = items.value
        for part in text_slices(batches, "text", SLICE_BYTES):
            data, bounds = text_buffer(part.column("text"))
            h, starts, ends, wb = words.hashes(data, bounds, words.FOLDED)
            n = np.diff(wb)
            at = np.minimum(np.searchsorted(known.hash, h), len(known) - 1)
            hit = np.flatnonzero((known.hash[at] == h) & (known.size[at] == ends - starts))
            row = np.repeat(np.arange(len(n)), n)[hit]
            key, tf = np.unique(row * len(known) + at[hit], return_counts=True)
            row, term = key // len(known), key % len(known)
            own = np.unique(row)
            one = np.array([0, 1])
            cols = [ids_or_last(part.column("doc"))[own], n[own], np.searchsorted(row, np.append(own, len(n))), term.astype(np.int32), tf.astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [*(blobs(c, one * len(c)) for c in cols), pa.array([int((n > 0).sum())]), pa.array([len(h)])],
                names=["doc", "n", "cuts", "term", "tf", "documents", "terms"],
            )

    return run


def _df(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column("term").to_pylist():
                total += np.bincount(np.frombuffer(x, np.int32), minlength=size)
        held = np.flatnonzero(total)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "df"])

    return run


def lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The m of documents with ``n`` terms; in Python's integers where 64 bits are too few."""
    if 90 * int(n.max(initial=0)) * documents < 2**63:
        return 10 + 90 * n * documents // terms
    return np.array([10 + 90 * int(x) * documents // terms for x in n], np.int64)


def gains(tf: np.ndarray, m: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Scores of rows of term frequencies; m has one value for each row."""
    tf = tf.astype(np.int64)
    return (w * (1_000_000_000 * tf // (1000 * tf + 8 * m[:, None]))).sum(1)


class Tree:
    """The documents of one item in a group, along shared prefixes of their term sets."""

    def __init__(self, tf: np.ndarray, m: np.ndarray, doc: np.ndarray, w: np.ndarray):
        self.w = w
        has = tf > 0
        word = np.packbits(has, axis=1)
        order = np.lexsort([*(word[:, k] for k in range(word.shape[1] - 1, -1, -1))])
        self.tf, self.m, self.doc = tf[order], m[order], doc[order]
        has = has[order]
        parted = np.any(has[1:] != has[:-1], axis=1)
        self.leaf = np.append(np.flatnonzero(np.append(True, parted)), len(m))
        paths = has[self.leaf[:-1]]
        self.depth = paths.shape[1]
        most, least = np.maximum.reduceat(self.tf, self.leaf[:-1]), np.minimum.reduceat(self.m, self.leaf[:-1])
        # first leaf of every node of a level; a node holds the leaves of one prefix
        differs = np.full(len(paths), -1)
        differs[1:] = np.argmax(paths[1:] != paths[:-1], axis=1)
        self.first: list[np.ndarray] = []
        self.bound: list[list[int]] = []
        for d in range(self.depth + 1):
            first = np.flatnonzero(differs < d)
            if d and len(first) == len(self.first[-1]):  # no node of the level above has two children
                self.first.append(self.first[-1])
                self.bound.append(self.bound[-1])
                continue
            self.first.append(first)
            self.bound.append(gains(np.maximum.reduceat(most, first), np.minimum.reduceat(least, first), w).tolist())
        # children of every node, as numbers of the next level
        self.child = [np.searchsorted(b, a).tolist() for a, b in zip(self.first[:-1], self.first[1:], strict=True)]

    def best(self, found: list[tuple[int, int]], top: int) -> list[tuple[int, int]]:
        """``found`` ((-score, doc), ascending, at most ``top``) with the documents of this tree."""
        stack = [(0, 0)]
        while stack:
            d, i = stack.pop()
            if len(found) == top and self.bound[d][i] < -found[-1][0]:
                continue
            while d < self.depth and self.first[d] is self.first[d + 1]:
                d += 1
            if d == self.depth:
                at = slice(self.leaf[i], self.leaf[i + 1])
                score = gains(self.tf[at], self.m[at], self.w)
                if len(found) == top:
                    good = np.flatnonzero(score >= -found[-1][0])
                else:
                    good = np.flatnonzero(score > 0)
                pick = good[np.lexsort((self.doc[at][good], -score[good]))[:top]]
                found = sorted([*found, *zip((-score[pick]).tolist(), self.doc[at][pick].tolist(), strict=True)])[:top]
                continue
            child = self.child[d]
            to = child[i + 1] if i + 1 < len(child) else len(self.first[d + 1])
            stack.extend(sorted(((d + 1, c) for c in range(child[i], to)), key=lambda x: self.bound[x[0]][x[1]]))
        return found


def _search(items, w: np.ndarray, df: np.ndarray, documents: int, terms: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = items.value
        frequent = [t[np.lexsort((t, -df[t]))] for t in (x[df[x] > 0] for x in known.terms)]
        found: list[list[tuple[int, int]]] = [[] for _ in known.ids]
        for group in _groups(batches):
            doc, n, term, row, tf = group
            m = lengths(n, documents, terms)
            order = np.argsort(term, kind="stable")
            row, tf = row[order], tf[order]
            cut = np.searchsorted(term[order], np.arange(len(known) + 1))
            for k, mine in enumerate(frequent):
                mine = mine[cut[mine + 1] > cut[mine]]
                if not len(mine):
                    continue
                held = np.zeros(len(doc), bool)
                for t in mine:
                    held[row[cut[t] : cut[t + 1]]] = True
                place = np.cumsum(held) - 1
                matrix = np.zeros((int(held.sum()), len(mine)), np.int32)
                for j, t in enumerate(mine):
                    at = slice(cut[t], cut[t + 1])
                    matrix[place[row[at]], j] = tf[at]
                found[k] = Tree(matrix, m[held], doc[held], w[mine]).best(found[k], top)
        rows = [(i, d, -s) for i, best in zip(known.ids, found, strict=True) for s, d in best]
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["item_id", "doc", "score"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]):
    """Vectors of about ``GROUP`` documents: ids, lengths, and term, document and tf of their entries."""
    held, size = [], 0
    for b in batches:
        for x in zip(*(b.column(c).to_pylist() for c in ("doc", "n", "cuts", "term", "tf")), strict=True):
            parts = [np.frombuffer(y, k) for y, k in zip(x, (np.int64, np.int64, np.int64, np.int32, np.int32), strict=True)]
            held.append(parts)
            size += len(parts[0])
            if size >= GROUP:
                yield _joined(held)
                held, size = [], 0
    if size:
        yield _joined(held)


def _joined(held):
    doc, n, cuts, term, tf = zip(*held, strict=True)
    count = np.concatenate([np.diff(c) for c in cuts])
    return np.concatenate(doc), np.concatenate(n), np.concatenate(term), np.repeat(np.arange(len(count)), count), np.concatenate(tf)


def ranked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each item its ``top`` documents of score above 0."""
    spark = docs.sparkSession
    wanted = staged(item_terms(items, item_id), "terms")
    size = wanted.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    src = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    parts = []
    for b in range(blocks):
        mine: dict[int | None, list[str]] = {}
        for r in wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect():  # about block_bytes
            mine.setdefault(r.item, []).append(r.term)
        if not mine:
            continue
        block = Items(list(mine.items()))
        sent = spark.sparkContext.broadcast(block)
        vectors = staged(src.mapInArrow(_vectors(sent), _SLICE), "vectors")
        counts = vectors.agg(F.sum("documents"), F.sum("terms")).first()
        documents, terms = (int(x or 0) for x in counts)
        if not terms:
            continue
        df = np.zeros(len(block), np.int64)
        for r in vectors.select("term").mapInArrow(_df(len(block)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r.term] = r.df
        w = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        parts.append(vectors.mapInArrow(_search(sent, w, df, documents, terms, top), "item_id long, doc long, score long"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc")
    out = functools.reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return out.select("item_id", "rank", F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "score")
