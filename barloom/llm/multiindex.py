"""Embedding near-dedup with an inverted multi-index.

Vectors of equal label (and dimension) are compared by cosine. Each is scaled to unit length and
cut into two halves; a codebook for either half, fitted by k-means on at most ``SAMPLE``
vectors, forms a product grid of cells, and every vector is filed under its cell. A vector
visits cells in the order of a multi-sequence traversal: a heap over the two sorted lists of
half distances yields the cells by their smallest possible distance. It stops when that exceeds
the distance of the threshold, so that the target recall is 1. What a visited cell holds is
verified in double precision.

Work is dealt by grid rows (label, code of the first half), cut into blocks of at most about
``BLOCK`` vectors, and of ``VISITORS`` times as many for those that only visit, as each of them is
copied to fewer pieces than a stored one; a pair of blocks is one piece of work, whatever a row holds. A vector visits
only rows after its own, and its own row once, so each pair is met once. A piece returns each
vector's number of links and a spanning forest of its links, not the links.

Equal vectors of a label are one node with a multiplicity.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows
without a label, link with nothing; a null id is the largest; a repeated row is another vector.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import NO_ID, components, own_exchange, staged

THRESHOLD = 0.98
SAMPLE = 16384
BLOCK = 1024
VISITORS = 4
LEAST_CODES, MOST_CODES = 16, 512


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Codewords of ``x``: k-means++ starts from a fixed seed, then Lloyd's rounds."""
    g = np.random.Generator(np.random.PCG64(7))
    centres = [x[g.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < min(k, len(x)) and near.sum() > 0:
        centres.append(x[np.searchsorted(np.cumsum(near), g.random() * near.sum(), side="right").clip(0, len(x) - 1)])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        code = distances(x, c).argmin(1)
        total = np.zeros_like(c)
        np.add.at(total, code, x)
        n = np.bincount(code, minlength=len(c))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to codewords."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def bounds(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance from each row to the region nearest each codeword, at least.

    A point of the region lies beyond the plane half-way between its codeword and any other.
    """
    d = distances(x, c)
    out = np.zeros_like(d)
    gap = np.sqrt(distances(c, c))
    for a in range(len(c)):
        with np.errstate(divide="ignore", invalid="ignore"):
            beyond = (d - d[:, a : a + 1]) / (2 * gap[a])
        out = np.maximum(out, np.where(gap[a] > 0, beyond, 0))
    return np.maximum(out - 1e-9, 0) ** 2


def traverse(first: np.ndarray, second: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) in the order of ``first[i] + second[j]`` up to ``limit``; neither is negative."""
    a, b = np.flatnonzero(first <= limit), np.flatnonzero(second <= limit)
    a, b = a[np.argsort(first[a], kind="stable")], b[np.argsort(second[b], kind="stable")]
    x, y = first[a].tolist(), second[b].tolist()
    if not x or not y:
        return
    a, b = a.tolist(), b.tolist()
    heap, done = [(x[0] + y[0], 0, 0)], [0] * (len(x) + 1)
    while heap:
        cost, i, j = heapq.heappop(heap)
        if cost > limit:
            return
        yield a[i], b[j]
        done[i] = j + 1
        if i + 1 < len(x) and done[i + 1] == j:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
        if j + 1 < len(y) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _file(shared, limit: float):
    """Members of grid rows: each vector in its own, and as a visitor in later ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims):
                    part = batch.filter(pa.array(dims == dim))
                    raw = part.column("embedding").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)
                    raw = raw / np.abs(raw).max(1)[:, None]
                    x = raw / np.sqrt((raw * raw).sum(1))[:, None]
                    one, two = books.get(int(dim), (None, None))
                    if one is None:  # no vector of this dimension was in the sample
                        one, two = x[:1, : dim // 2] * 0, x[:1, dim // 2 :] * 0
                    h1, h2 = x[:, : dim // 2], x[:, dim // 2 :]
                    own, cell = distances(h1, one).argmin(1), distances(h2, two).argmin(1)
                    b1, b2 = bounds(h1, one), bounds(h2, two)
                    rows, row, visits = [], [], []
                    for k in range(len(x)):
                        at = int(own[k])
                        seen: dict[int, list[int]] = {at: []}
                        for i, j in traverse(b1[k, at:], b2[k], limit):  # rows before its own visit it
                            seen.setdefault(at + i, []).append(j)
                        for i, js in seen.items():
                            rows.append(k)
                            row.append(i)
                            visits.append(np.array(sorted(js), np.int16).tobytes())
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("label").take(take), part.column("dim").take(take), pa.array(row, pa.int32()), part.column("node").take(take), part.column("n").take(take),
                            pa.array(own[rows] == np.array(row)), pa.array(cell[rows].astype(np.int32)), pa.array(visits, pa.binary()), pa.array([x[k].tobytes() for k in rows], pa.binary()),
                        ],
                        names=["label", "dim", "row", "node", "n", "stored", "cell", "visits", "vector"],
                    )

    return run


_MEMBER = "label long, dim int, row int, node long, n long, stored boolean, cell int, visits binary, vector binary"


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each vertex of a symmetric adjacency, the smallest vertex its links connect it to."""
    top = np.arange(len(linked))
    while True:
        new = np.minimum(top, np.where(linked, top[None, :], len(top)).min(1, initial=len(top)))
        new = new[new]
        if (new == top).all():
            return top
        top = new


def _verify(threshold: float):
    """A pair of blocks: cells of the first block's vectors against the visitors from the second."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        left = t.filter(pc.equal(t.column("side"), 0))
        same = len(t) > 0 and t.column("l")[0].as_py() == t.column("r")[0].as_py()
        right = left if same else t.filter(pc.equal(t.column("side"), 1))
        if not len(left) or not len(right):
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "top": pa.array([], pa.int64())})
        x, y = _matrix(left.column("vector").combine_chunks()), _matrix(right.column("vector").combine_chunks())
        cell = left.column("cell").to_numpy()
        linked = np.zeros((len(x), len(y)), bool)
        visits = right.column("visits")
        going = np.frombuffer(b"".join(visits.to_pylist()), np.int16)
        by_cell = np.argsort(going, kind="stable")
        visitor = np.repeat(np.arange(len(y)), pc.binary_length(visits).to_numpy() // 2)[by_cell]
        going = going[by_cell]
        order = np.argsort(cell, kind="stable")
        used, first = np.unique(cell[order], return_index=True)
        for j, at in zip(used.tolist(), np.split(order, first[1:]), strict=True):
            come = visitor[np.searchsorted(going, j) : np.searchsorted(going, j, side="right")]
            if len(come):
                linked[np.ix_(at, come)] = x[at] @ y[come].T >= threshold
        node_x, node_y = left.column("node").to_numpy(), right.column("node").to_numpy()
        n_x, n_y = left.column("n").to_numpy(), right.column("n").to_numpy()
        if same:
            linked |= linked.T
            np.fill_diagonal(linked, False)
        # only what has links goes on
        own, come = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        linked = linked[np.ix_(own, come)]
        node_x, node_y, n_x, n_y = node_x[own], node_y[come], n_x[own], n_y[come]
        if same:
            node, count = node_x, linked @ n_y
            top = _forest(linked)
        else:
            node = np.append(node_x, node_y)
            count = np.append(linked @ n_y, linked.T @ n_x)
            whole = np.zeros((len(node), len(node)), bool)
            whole[: len(own), len(own) :] = linked
            whole[len(own) :, : len(own)] = linked.T
            top = _forest(whole)
        return pa.table({"node": node, "links": count.astype(np.int64), "top": node[top]})

    return run


def _pieces(members: DataFrame, block: int) -> DataFrame:
    """Members once for each piece of work, which is a pair of blocks of a grid row."""
    key = ["label", "dim", "row"]
    sizes = members.groupBy(*key).agg(F.count_if("stored").alias("own"), F.count_if(~F.col("stored")).alias("come")).where("own > 0")
    sizes = sizes.select(F.struct(*key).alias("k"), F.greatest(F.lit(1), F.ceil(F.col("own") / block)).cast("int").alias("s"), F.ceil(F.col("come") / (VISITORS * block)).cast("int").alias("v"))
    sizes = staged(sizes, "sizes")  # written first, its size is known: few rows are broadcast, and the members stay where they are
    dealt = members.join(sizes, F.struct(*key) == F.col("k")).drop("k")
    slot = F.pmod(F.xxhash64("node", F.lit(3)), F.when(F.col("stored"), F.col("s")).otherwise(F.greatest(F.col("v"), F.lit(1)))).cast("int")
    dealt = dealt.withColumn("b", F.when(F.col("stored"), slot).otherwise(F.col("s") + slot))
    # block pairs (l, r) with l stored and l <= r; a vector is on the left, on the right, or (l = r) both
    as_left = F.transform(F.sequence(F.col("b"), F.col("s") + F.col("v") - 1), lambda r: F.struct(F.col("b").alias("l"), r.alias("r"), F.lit(0).alias("side")))
    as_right = F.transform(F.sequence(F.lit(0), F.least(F.col("b"), F.col("s")) - 1), lambda q: F.struct(q.alias("l"), F.col("b").alias("r"), F.lit(1).alias("side")))
    places = F.when(F.col("stored"), F.concat(as_left, F.when(F.col("b") > 0, as_right).otherwise(F.array().cast("array<struct<l:int,r:int,side:int>>")))).otherwise(as_right)
    work = dealt.select(*key, "node", "n", "cell", "visits", "vector", F.explode(places).alias("w")).select(*key, "w.*", "node", "n", "cell", "visits", "vector")
    work = work.repartition(F.xxhash64(*key, "l", "r"))
    return work.withColumn("piece", F.xxhash64(*key, "l", "r")).select("piece", "l", "r", "side", "node", "n", "cell", "visits", "vector")


def _sample(nodes: DataFrame, n: int, sample: int) -> dict[int, np.ndarray]:
    """Unit vectors of about ``sample`` nodes, picked by their hash, by dimension."""
    share = min(1.0, sample / max(1, n))
    picked = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))).orderBy("node").select("dim", "embedding").limit(2 * sample)
    by: dict[int, list] = {}
    for r in picked.toArrow().to_pylist():  # at most 2 * sample vectors
        by.setdefault(r["dim"], []).append(r["embedding"])
    out = {}
    for dim, rows in by.items():
        x = np.array(rows, np.float64)
        x /= np.abs(x).max(1)[:, None]
        out[dim] = x / np.sqrt((x * x).sum(1))[:, None]
    return out


def linked(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, block: int = BLOCK, codes: int | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``(vec_id, embedding, label)``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = rows.select("vec_id", "label", "embedding", F.when(usable, F.xxhash64("label", "embedding")).alias("node"))
    good = rows.where("node is not null")
    nodes = good.groupBy("node").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("n"), F.min(F.coalesce("vec_id", F.lit(NO_ID))).alias("first"))
    nodes = staged(nodes.withColumn("dim", F.size("embedding")), "vectors")
    n = nodes.count()
    k = codes or int(np.clip(np.sqrt(n) / 16, LEAST_CODES, MOST_CODES))
    books = {d: (kmeans(x[:, : d // 2], k), kmeans(x[:, d // 2 :], k)) for d, x in _sample(nodes, n, sample).items()}
    shared = spark.sparkContext.broadcast(books)  # two codebooks of k vectors for each dimension
    limit = 2 - 2 * threshold + 1e-9
    members = staged(nodes.select("label", "dim", "node", "n", "embedding").repartition("node").mapInArrow(_file(shared, limit), _MEMBER), "members")
    found = staged(_pieces(members, block).groupBy("piece").applyInArrow(_verify(threshold), "node long, links long, top long"), "found")

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("node").alias("a"), F.col("top").alias("b"))).withColumnRenamed("id", "node")
    each = nodes.select("node", "n", "first").join(counts, "node", "left").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    each = staged(each.select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "first", "component"), "linked")
    heads = each.groupBy("component").agg(F.min("first").alias("head"))
    named = staged(each.join(heads.select(own_exchange("component").alias("c"), "head"), own_exchange("component") == F.col("c")).select("node", "n_links", "head"), "named")
    yes = good.select("vec_id", "node").join(named, "node").select("vec_id", "n_links", F.when(F.col("head") != NO_ID, F.col("head")).alias("component_id"))
    no = rows.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return yes.union(no).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
