"""Near-dedup by improved consistent weighted sampling (ICWS) over TF-IDF word shingles.

1. Document frequencies. Every shingle's documents are counted over all rows. Texts are dealt
   out to slices of about ``SLICE_BYTES``; a slice counts its own shingles first and sends each
   distinct one once, as 4 bytes, to the bucket of its leading bits. A bucket adds the counts of
   all slices and answers each with the weights of the shingles it sent. Slices and buckets grow
   in number with the corpus, not in size; nothing is broadcast or seen by the driver.
2. Samples. A document is the set of its shingles with weight ``tf * idf``. For each of
   ``BANDS * ROWS`` functions, ICWS draws one (shingle, level); two documents draw the same one
   with the probability of their weighted Jaccard similarity. The random variates of a shingle
   come from a fixed pool by its hash. With ``plain`` as many are drawn by weight ``tf`` as well:
   what a group of copies shares is frequent, so by ``idf`` an edit parts its members the sooner
   the more there are.
3. Candidates. Documents of equal weighted sets form one class (a node). Nodes that share a
   band meet in a bucket, and all are compared with its centre, the node of the least mean
   weight: edits are rare shingles, so the original of a group has the fewest of them. Links
   are joined to components. The nodes of buckets that still hold several components then meet
   by an exact prefix filter: each lists its shingles, rarest first, as long as what remains
   could still make ``threshold`` of its weight; a pair whose first common shingle leaves enough
   weight on both sides to be similar is verified, if its components differ. Every pair of a
   bucket is so verified, ruled out by weight, or already connected; the pairs of a group are
   not emitted.
4. Links are pairs of weighted Jaccard similarity >= ``threshold``, computed from whole texts; with
   ``plain``, by ``tf * idf`` or by ``tf``.

Defined cases: null, empty and blank texts link with nothing; texts of fewer words than a
shingle are one shingle, and so are texts of signs only; a very long text is a slice of its own;
rows without an id come last when the representative is chosen; rows with equal ids are separate
rows, and copies of a row are dealt to slices by the partition they are read from as well. An
input that gives other rows when read again raises an error; write such a one to a table first.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import words
from barloom.llm.common import NO_ID, blobs, components, own_exchange, staged, text_buffer, text_slices, unblob

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 3
POOL = 1 << 16
SLICE_BYTES = 2 << 20
SLICE_ROWS = 1 << 15
#: Bytes of text whose shingles one group of buckets counts.
GROUP_BYTES = 8 << 20
LEAST_BITS = 12
_WIDTH = 44
_BITS, _LOW = np.uint64(_WIDTH), np.uint64((1 << _WIDTH) - 1)


def _not_blank() -> F.Column:
    """Texts with a shingle: any character but white space."""
    return F.coalesce(F.col("text").rlike(r"[^\x09-\x0D\x20]"), F.lit(False))


def shingles(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: row numbers, 44-bit hashes in ascending order, counts."""
    data, bounds = text_buffer(column)
    h, _, _, wb = words.hashes(data, bounds, words.FOLDED)
    row = np.repeat(np.arange(len(wb) - 1, dtype=np.uint64), np.diff(wb))
    n = max(0, len(h) - k + 1)
    ok = words.whole_windows(wb, k, n)
    keys = [row[:n][ok] << _BITS | words.rolling(h, k)[ok] & _LOW]
    size = np.diff(wb)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        place = (np.arange(len(h)) - wb[row.astype(np.int64)]).astype(np.uint64)
        mark = words.mix(h + words.mix(place + np.uint64(7)))
        total = np.append(np.uint64(0), np.cumsum(mark))
        keys.append(short.astype(np.uint64) << _BITS | words.mix(total[wb[short + 1]] - total[wb[short]]) & _LOW)
    for i in np.flatnonzero((size == 0) & (np.diff(bounds) > 0)):  # characters, but none of a word
        signs = b" ".join(data[bounds[i] : bounds[i + 1]].tobytes().split())
        if signs:
            digest = np.frombuffer(hashlib.blake2b(signs, digest_size=8).digest(), np.uint64)
            keys.append(np.uint64(i) << _BITS | digest & _LOW)
    key, tf = np.unique(np.concatenate(keys), return_counts=True)
    return (key >> _BITS).astype(np.int64), key & _LOW, tf


def _postings(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``shingles`` of all texts of a table, whatever their number."""
    parts, base = [], 0
    for part in text_slices(iter(table.to_batches()), "text", SLICE_BYTES):
        row, h, tf = shingles(part.column("text"), k)
        parts.append((row + base, h, tf))
        base += part.num_rows
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _sent(k: int, bits: int):
    """A slice's distinct shingles and in how many of its documents each is, by bucket of leading bits."""
    low = _WIDTH - bits

    def run(key: tuple, table: pa.Table) -> pa.Table:
        h, df = np.unique(_postings(table, k)[1], return_counts=True)
        bucket = (h >> np.uint64(low)).astype(np.int64)
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        cuts = np.append(first, len(h))
        tail = (h & np.uint64((1 << low) - 1)).astype(np.uint32)
        return pa.table([pa.array(np.full(len(first), key[0].as_py())), pa.array(bucket[first].astype(np.int32)), blobs(tail, cuts), blobs(df.astype(np.int32), cuts)], names=["slice", "bucket", "tails", "counts"])

    return run


def _answered(documents: int):
    """``1 + ln(documents / documents with the shingle)`` for all that the slices sent to a group of buckets."""

    def run(table: pa.Table) -> pa.Table:
        tails = table.column("tails")
        size = pc.binary_length(tails).to_numpy() // 4
        key = np.repeat(table.column("bucket").to_numpy().astype(np.uint64) << np.uint64(32), size) | unblob(tails, np.uint32)
        _, which = np.unique(key, return_inverse=True)
        df = np.bincount(which, unblob(table.column("counts"), np.int32))
        idf = (1 + np.log(documents / df))[which].astype(np.float32)
        return pa.table([table.column("slice"), table.column("bucket"), blobs(idf, np.append(0, np.cumsum(size)))], names=["slice", "bucket", "idf"])

    return run


@functools.cache
def _pool(functions: int) -> list[tuple[np.ndarray, ...]]:
    out = []
    for j in range(functions):
        g = np.random.Generator(np.random.PCG64([20110, j]))
        r, c, b = g.gamma(2, size=POOL), g.gamma(2, size=POOL), g.random(POOL)
        out.append(tuple(x.astype(np.float32) for x in (r, 1 / r, np.log(c), b)))
    return out


def samples(row: np.ndarray, h: np.ndarray, weight: np.ndarray, functions: int) -> np.ndarray:
    """ICWS draws: one 64-bit id for each function and text; ``row`` ascending, none missing inside."""
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    size = np.diff(np.append(first, len(row)))
    number = np.repeat(np.arange(len(first)), size)
    slot = (h >> np.uint64(20) & np.uint64(POOL - 1)).astype(np.int64)
    lw = np.log(weight).astype(np.float32)
    out = np.empty((functions, len(first)), np.uint64)
    for j, (r, ir, lc, b) in enumerate(_pool(functions)):
        beta = b[slot]
        t = np.floor(lw * ir[slot] + beta)
        a = lc[slot] - r[slot] * (t - beta + np.float32(1))
        at = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, first), size))
        d = number[at]
        at = at[np.append(True, d[1:] != d[:-1])]  # ties: the smallest hash
        out[j] = words.mix(h[at] + words.mix(t[at].astype(np.int64).astype(np.uint64) + np.uint64(j << 40)))
    return out


def _weights(tf: np.ndarray, idf: np.ndarray, plain: bool) -> list[np.ndarray]:
    """The weights of shingles by which documents are similar."""
    return [tf * idf.astype(np.float64)] + [tf.astype(np.float64)] * plain


def _sign(k: int, bands: int, rows: int, plain: bool):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        row, h, tf = _postings(table, k)
        own, first = np.unique(row, return_index=True)
        distinct, which = np.unique(h, return_inverse=True)
        idf = unblob(answers.sort_by("bucket").column("idf"), np.float32)
        if len(idf) != len(distinct) or len(own) != table.num_rows:
            raise ValueError("the documents changed between two reads; write them to a table first")
        rarity = idf[which]
        weights = _weights(tf, rarity, plain)
        mean = np.add.reduceat(weights[0], first) / np.add.reduceat(tf, first)
        keys = np.zeros((len(own), len(weights) * bands), np.int64)
        with np.errstate(over="ignore"):
            drawn = np.concatenate([samples(row, h, w, bands * rows) for w in weights])
            node = words.mix(np.add.reduceat(words.mix(h + words.mix(tf.astype(np.uint64))), first)).view(np.int64)
            for b in range(keys.shape[1]):
                key = np.full(len(own), b, np.uint64)
                for x in drawn[b * rows : (b + 1) * rows]:
                    key = words.mix(key * np.uint64(words.BASE) + x)
                keys[:, b] = key.view(np.int64)
        lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel()))
        return pa.table(
            [table.column("doc"), table.column("fp"), pa.array(node), lists, pa.array(mean), blobs(rarity, np.append(first, len(row)))],
            names=["doc", "fp", "node", "bands", "mean", "idf"],
        )

    return run


def signatures(src: DataFrame, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, plain: bool = False) -> DataFrame:
    """``(doc, fp, node, bands, mean, idf)`` for the rows of ``(doc, fp, text)`` whose text is not blank.

    ``bands`` has the keys by ``tf * idf``, and with ``plain`` those by ``tf`` after them;
    ``idf`` holds the weight of each of the text's distinct shingles, in the order of ``shingles``.
    The exchange of the texts serves both the counts and the signatures.
    """
    src = src.where(_not_blank())
    size = src.agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    total = size.bytes or 1
    slices = max(1, -(-total // SLICE_BYTES), -(-size.n // SLICE_ROWS))
    group = max(5, (total // GROUP_BYTES).bit_length())
    bits = max(LEAST_BITS, group)
    dealt = src.withColumn("part", F.spark_partition_id()).withColumn("slice", F.expr(f"pmod(xxhash64(doc, fp, part), {slices}L)")).drop("part")
    by_slice = dealt.groupBy("slice")
    sent = by_slice.applyInArrow(_sent(k, bits), "slice long, bucket int, tails binary, counts binary")
    answers = sent.groupBy(F.expr(f"shiftright(bucket, {bits - group})").alias("g")).applyInArrow(_answered(size.n), "slice long, bucket int, idf binary")
    return by_slice.cogroup(answers.groupBy("slice")).applyInArrow(
        _sign(k, bands, rows, plain), "doc long, fp long, node long, bands array<long>, mean double, idf binary"
    )


def _verify(k: int, threshold: float, plain: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for wide in text_slices(batches, "ta", SLICE_BYTES):
            for part in text_slices([wide], "tb", SLICE_BYTES):
                sides = []
                for c in "ab":
                    row, h, tf = shingles(part.column("t" + c), k)
                    sides.append((row.astype(np.uint64) << _BITS | h, row, _weights(tf, unblob(part.column("i" + c), np.float32), plain)))
                (ka, ra, weights_a), (kb, rb, weights_b) = sides
                _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                n = part.num_rows
                good = np.zeros(n, bool)
                for wa, wb in zip(weights_a, weights_b, strict=True):
                    both = np.bincount(ra[ia], np.minimum(wa[ia], wb[ib]), n)
                    all_ = np.bincount(ra, wa, n) + np.bincount(rb, wb, n) - both
                    good |= (all_ > 0) & (both >= threshold * all_ - 1e-9)
                yield part.select(["a", "b"]).take(pa.array(np.flatnonzero(good)))

    return run


def _prefix(k: int, threshold: float, plain: bool):
    """A text's shingles, rarest first, while what remains weighs at least ``threshold`` of all, by any of its weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            row, h, tf = shingles(part.column("text"), k)
            rarity = unblob(part.column("idf"), np.float32)
            order = np.lexsort((h, -rarity, row))  # the same order of shingles in every text
            row, h, tf, rarity = row[order], h[order], tf[order], rarity[order]
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            size = np.diff(np.append(first, len(row)))
            keep, sums = np.zeros(len(row), bool), []
            for w in _weights(tf, rarity, plain):
                total = np.repeat(np.add.reduceat(w, first), size)
                before = np.cumsum(w) - w
                rest = total - (before - np.repeat(before[first], size))
                keep |= rest >= threshold * total - 1e-6
                sums += [total, rest]
            take = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays(
                [part.column("node").take(take), part.column("component").take(take), pa.array(h[keep].astype(np.int64)), *[pa.array(x[keep]) for x in sums]],
                names=["node", "component", "token", *_sums(plain)],
            )

    return run


def _sums(plain: bool) -> list[str]:
    """Columns of a listed shingle: for each weight that of its text, and what is left of it from the shingle on."""
    return ["total", "rest"] + ["plain_total", "plain_rest"] * plain


def _links(pairs: DataFrame, texts: DataFrame, k: int, threshold: float, plain: bool) -> DataFrame:
    a, b = (texts.select(F.col("node").alias(c), F.col("text").alias("t" + c), F.col("idf").alias("i" + c)) for c in "ab")
    wide = pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "ia", "tb", "ib")
    return wide.mapInArrow(_verify(k, threshold, plain), "a long, b long")


def _of(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Add each node's component; a node without links is its own."""
    return members.join(comps.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, plain: bool = False
) -> DataFrame:
    """``(doc, fp, node, class_doc, group_doc, group_fp)``, one row per row of ``docs``.

    ``doc`` is the id (``NO_ID`` for null), ``fp`` the hash of the text; ``class_doc`` is the
    smallest id of equal weighted sets, ``group_doc`` with ``group_fp`` the representative of
    all that links connect. Texts without words have a null ``node`` and stand for themselves.
    ``plain``: pairs that are similar without ``idf`` are links, too.
    """
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text_col).alias("fp"), F.col(text_col).alias("text"))
    signed = staged(signatures(src, k, bands, rows, plain), "signed")
    nodes = signed.groupBy("node").agg(F.min(F.struct("doc", "fp")).alias("first"), F.first("bands").alias("bands"), F.first("mean").alias("mean"), F.first("idf").alias("idf"))
    nodes = staged(nodes, "nodes")
    slots = nodes.select("node", "mean", F.explode("bands").alias("slot"))
    centre = slots.groupBy("slot").agg(F.min(F.struct("mean", "node")).alias("c"), F.count("*").alias("n")).where("n > 1")
    centre = centre.select(own_exchange("slot").alias("k"), F.col("c.node").alias("a"))
    members = staged(slots.join(centre, own_exchange("slot") == F.col("k")).select("slot", "a", "node"), "members")
    pairs = members.where("a <> node").select("a", F.col("node").alias("b")).distinct()

    needed = members.select("node").distinct().join(nodes, "node").select("node", "first.doc", "first.fp", "idf")
    texts = staged(src.join(needed, ["doc", "fp"]).groupBy("node").agg(F.first("text").alias("text"), F.first("idf").alias("idf")), "texts")
    links = staged(_links(pairs, texts, k, threshold, plain), "links")
    comps = components(links)

    # nodes of buckets with several components meet by their rare shingles
    open_ = _of(members, comps)
    mixed = open_.groupBy("slot").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    open_ = open_.join(mixed.select(own_exchange("slot").alias("k")), own_exchange("slot") == F.col("k")).select("node", "component").distinct()
    listed = open_.join(texts, "node").mapInArrow(_prefix(k, threshold, plain), ", ".join(["node long, component long, token long", *[f"{c} double" for c in _sums(plain)]]))
    listed = staged(listed, "prefixes")
    several = listed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select(own_exchange("token").alias("k"))
    listed = staged(listed.join(several, own_exchange("token") == F.col("k")).drop("k"), "prefixes")
    one, two = (listed.select(F.col("token").alias("token"), *[F.col(c).alias(s + c) for c in ("node", "component", *_sums(plain))]) for s in "xy")
    left = lambda total, rest: F.least(f"x{rest}", f"y{rest}") >= F.lit(threshold / (1 + threshold)) * (F.col(f"x{total}") + F.col(f"y{total}")) - 1e-6
    enough = left("total", "rest")
    if plain:
        enough = enough | left("plain_total", "plain_rest")
    met = one.join(two, (one["token"] == two["token"]) & (F.col("xnode") < F.col("ynode")) & (F.col("xcomponent") != F.col("ycomponent")) & enough)
    more = met.select(F.col("xnode").alias("a"), F.col("ynode").alias("b")).distinct()
    links2 = staged(_links(more, texts, k, threshold, plain), "links")
    comps = staged(components(links.union(links2)), "components")

    groups = _of(nodes.select("node", "first"), comps)
    heads = groups.groupBy("component").agg(F.min("first").alias("head"))
    named = staged(
        groups.join(heads.select(own_exchange("component").alias("c"), "head"), own_exchange("component") == F.col("c")).select("node", F.col("first.doc").alias("class_doc"), F.col("head.doc").alias("group_doc"), F.col("head.fp").alias("group_fp")),
        "named",
    )
    with_words = signed.select("doc", "fp", "node").join(named, "node").select("doc", "fp", "node", "class_doc", "group_doc", "group_fp")
    without = src.where(~_not_blank()).select("doc", "fp", F.lit(None).cast("long").alias("node"), F.col("doc").alias("class_doc"), F.col("doc").alias("group_doc"), F.col("fp").alias("group_fp"))
    return with_words.union(without)


def _id(c: str) -> F.Column:
    return F.when(F.col(c) != NO_ID, F.col(c))


def digest(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, class_id, component_id, kept)``: copies, what links connect, and the one to keep."""
    found = near_duplicates(docs, **options)
    return found.select(
        _id("doc").alias("doc_id"), _id("class_doc").alias("class_id"), _id("group_doc").alias("component_id"),
        ((F.col("doc") == F.col("group_doc")) & (F.col("fp") == F.col("group_fp"))).alias("kept"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that represent their group; a row that repeats id and text counts once."""
    found = near_duplicates(docs, id_col, text_col, **options)
    keep = found.where("doc = group_doc and fp = group_fp").select("doc", "fp").distinct()
    mine = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text_col).alias("fp"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    kept = mine.join(keep, ["doc", "fp"], "left_semi").groupBy("doc", "fp").agg(F.first("row").alias("row"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
