"""Substring dedup: remove passages that a document with a smaller id holds already.

Every window of ``window`` consecutive words gets a Rabin-Karp hash. Windows are dealt to
buckets by the smallest hash of the shorter windows inside them, so that neighbouring windows
travel together (8 bytes for each, and a head for some twenty) and equal windows meet. In a
bucket, windows that occur under a smaller id are marked; marked neighbours leave as one
interval, and the intervals of a document are merged where its text is cut.

Hot buckets: many windows share an inner window if a passage shorter than the window stands in
many documents. The load of every bucket is counted first; one of more than twice the mean is
split by the hash of the window itself, where equal windows still meet.

Copies: before the shuffle each slice of texts keeps, of equal windows, only those of its
smallest id; the rest are marked on the spot. What is sent of a group of copies is bounded by
the slices that hold it, not by its size.

Defined cases: null and empty texts have no words; a null id counts as larger than all others;
rows with the same id never remove each other's words; texts shorter than the window stay whole; a
very long text is a slice of its own, in memory of a few times its size. Windows are compared by
64-bit hashes: two different ones are taken for equal by chance about once in 10^19 pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import words
from barloom.llm.common import NO_ID, blobs, ids_or_last, shuffle_partitions, text_buffer, text_slices, unblob

WINDOW = 50
ANCHOR = 16  # words of the shorter windows that pick the bucket
SLICE_BYTES = 4 << 20
BUCKET_BYTES = 12 << 20  # text per bucket
_MARK = np.dtype([("doc", "<i8"), ("fp", "<i8"), ("lo", "<i4"), ("hi", "<i4")])
_SENT = "bucket long, doc binary, fp binary, start binary, n binary, hash binary, mark binary"
_SPAN = "doc long, fp long, lo int, hi int"


def _first_docs(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For every window, the smallest document among the windows with its hash."""
    order = np.argsort(h)
    s = h[order]
    head = np.append(True, s[1:] != s[:-1]) if len(s) else np.zeros(0, bool)
    low = np.minimum.reduceat(doc[order], np.flatnonzero(head)) if len(s) else doc
    out = np.empty_like(doc)
    out[order] = low[np.cumsum(head) - 1]
    return out


def _buckets(h: np.ndarray, window: int, buckets: int) -> np.ndarray:
    """The bucket of every window: that of the smallest hash of the shorter windows in it."""
    anchor = min(ANCHOR, window)
    least = words.sliding_min(words.rolling(h, anchor), window - anchor + 1)
    return (words.mix(least) % np.uint64(buckets)).astype(np.int64)


def _load(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in text_slices(batches, "text", SLICE_BYTES):
            h, _, _, wb = words.hashes(*text_buffer(part.column("text")), words.PLAIN)
            n = len(h) - window + 1
            if n > 0:
                total += np.bincount(_buckets(h, window, buckets)[words.whole_windows(wb, window, n)], minlength=buckets)
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    return run


def hot_buckets(src: DataFrame, window: int, buckets: int) -> dict[int, int]:
    """Buckets of more than twice the mean load, and into how many parts of about the mean they fall."""
    load = src.select("text").mapInArrow(_load(window, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    load = load.persist()
    try:
        mean = (load.agg(F.sum("n")).first()[0] or 0) / buckets
        return {r.bucket: math.ceil(r.n / mean) for r in load.where(F.col("n") > 2 * mean).collect()}  # less than half the buckets
    finally:
        load.unpersist()


def _deal(window: int, buckets: int, hot: dict[int, int]):
    parts = np.ones(buckets, np.int64)
    for b, n in hot.items():
        parts[b] = n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, part in enumerate(text_slices(batches, "text", SLICE_BYTES)):
            data, bounds = text_buffer(part.column("text"))
            h, _, _, wb = words.hashes(data, bounds, words.PLAIN)
            n = len(h) - window + 1
            if n <= 0:
                continue
            ok = words.whole_windows(wb, window, n)
            doc_of = np.repeat(np.arange(len(wb) - 1), np.diff(wb))[:n]
            doc, fp = ids_or_last(part.column("doc")), part.column("fp").to_numpy()
            full = words.rolling(h, window)
            goes = _buckets(h, window, buckets)
            if hot:
                goes += buckets * (words.mix(full) % parts[goes].astype(np.uint64)).astype(np.int64)
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            mine = doc[doc_of[at]]
            known = np.zeros(n, bool)
            known[at] = mine > _first_docs(full[at], mine)
            lo, size = words.runs(known)
            marks = np.empty(len(lo), _MARK)
            d = doc_of[lo]
            marks["doc"], marks["fp"], marks["lo"], marks["hi"] = doc[d], fp[d], lo - wb[d], lo - wb[d] + size + window - 1
            # the others, bucket by bucket
            open_ = ok & ~known
            start, size = words.runs(open_, np.append(True, goes[1:n] != goes[: n - 1]))
            bucket = goes[start]
            at = np.flatnonzero(open_)
            by_window = np.argsort(np.repeat(bucket, size), kind="stable")
            by_run = np.argsort(bucket, kind="stable")
            start, size, bucket = start[by_run], size[by_run], bucket[by_run]
            d = doc_of[start]
            used, first = np.unique(bucket, return_index=True)
            cuts = np.append(first, len(bucket))
            total = np.append(0, np.cumsum(size))
            none = np.zeros(max(0, 1 - len(used)), np.int64)  # marks alone need a row too
            rows = len(used) + len(none)
            cuts, wcuts = (np.append(x, x[-1:]) if len(none) else x for x in (cuts, total[cuts]))
            give = np.full(rows + 1, len(marks))
            give[: 1 + (turn + len(lo)) % rows] = 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(used, none).astype(np.int64)),
                    blobs(doc[d], cuts), blobs(fp[d], cuts), blobs((start - wb[d]).astype(np.int32), cuts),
                    blobs(size.astype(np.int32), cuts), blobs(full[at][by_window], wcuts), blobs(marks.view(np.uint8), give * _MARK.itemsize),
                ],
                names=["bucket", "doc", "fp", "start", "n", "hash", "mark"],
            )

    return run


def _judge(window: int):
    def run(t: pa.Table) -> pa.Table:
        doc, fp = unblob(t.column("doc"), "<i8"), unblob(t.column("fp"), "<i8")
        start, size = unblob(t.column("start"), "<i4"), unblob(t.column("n"), "<i4")
        h = unblob(t.column("hash"), "<u8")
        mine = np.repeat(doc, size)
        later = mine > _first_docs(h, mine)
        lo, n = words.runs(later, _heads(size, len(h)))
        r = np.repeat(np.arange(len(size)), size)[lo]
        first = start[r] + lo - np.append(0, np.cumsum(size))[r]
        m = unblob(t.column("mark"), _MARK)
        cols = [np.concatenate(x) for x in ((doc[r], m["doc"]), (fp[r], m["fp"]), (first, m["lo"]), (first + n + window - 1, m["hi"]))]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.table([pa.array(np.ascontiguousarray(c), k, safe=False) for c, k in zip(cols, kinds, strict=True)], names=["doc", "fp", "lo", "hi"])

    return run


def _heads(size: np.ndarray, n: int) -> np.ndarray:
    head = np.zeros(n + 1, bool)
    head[np.append(0, np.cumsum(size))] = True
    return head[:n]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``(doc, fp, spans)``: word intervals ``[lo, hi)`` to remove, for documents that have any.

    ``doc`` is the id (``NO_ID`` for null) and ``fp`` the hash of the text, which keep apart
    rows that share an id. ``spans`` may touch or overlap; :func:`merged` joins them.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(2 * shuffle_partitions(spark), math.ceil(size / BUCKET_BYTES))
    src = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("fp"), F.col(text_col).alias("text"))
    sent = src.mapInArrow(_deal(window, buckets, hot_buckets(src, window, buckets)), _SENT)
    marks = sent.groupBy("bucket").applyInArrow(_judge(window), _SPAN)
    return marks.groupBy("doc", "fp").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal intervals that cover the same words."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _with_spans(docs: DataFrame, id_col: str, text_col: str, window: int, keep: list) -> DataFrame:
    spans = repeated_spans(docs, id_col, text_col, window)
    mine = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text_col).alias("fp"), *keep
    )
    return mine.join(spans, ["doc", "fp"], "left").drop("doc", "fp")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, "text", SLICE_BYTES):
        n_words, n_removed, sha = [], [], []
        for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
            w = text.encode().split() if text else []
            n_words.append(len(w))
            gone = 0
            for lo, hi in reversed(merged(spans)):
                gone += hi - lo
                del w[lo:hi]
            n_removed.append(gone)
            sha.append(hashlib.sha256(b" ".join(w)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of ``docs(doc_id, text)``, one row per row."""
    rows = _with_spans(docs, "doc_id", "text", window, ["doc_id", "text"])
    return rows.mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, "text", SLICE_BYTES):
        pairs = zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True)
        texts = [words.cut(t, merged(s), words.PLAIN) if t and s else t for t, s in pairs]
        yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], names=["row", "text"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages cut out of the texts; rows, columns and their order stay."""
    rows = _with_spans(docs, id_col, text_col, window, [F.struct(*[f"`{c}`" for c in docs.columns if c != text_col]).alias("row"), F.col(text_col).alias("text")])
    kind = rows.select("row").schema[0].dataType.simpleString()
    out = rows.mapInArrow(_cut, f"row {kind}, text string")
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
