"""Toxicity: a support vector machine on a subsequence string kernel with Nyström landmarks.

Kernel. Two words are alike by the triples of letters that both hold in order, gaps allowed: a
triple that spans ``s`` characters counts ``DECAY ** s``, up to ``SPAN`` characters, and sums
are scaled by the size of each word. So ``id.i-ot`` and ``idiiot`` stay near ``idiot``, and an
insult near its inflected forms. Words end at white space; single letters with white space
between form one word; whatever is no letter only widens a gap, by one place for a run of any
length, so ``i--d--i--o--t`` is ``i-d-i-o-t``.

Landmarks. The words that tell the labels of the training sample apart best, no two of them too
alike. A text's similarity to a landmark is that of its nearest word (at least ``FLOOR``), to
the power ``POWER``. Similarities are whitened by the landmarks' own kernel matrix (Nyström),
and a linear machine with squared hinge loss is fitted on the result, then scaled to a
probability on decisions of models that had not seen the text.

Training uses at most ``SAMPLE`` labelled documents, picked by a hash of the id from rows whose
crc32 of the id mod 5 is not 0. Word counts of the sample are grouped in Spark; the driver sees
the best candidates and one row of ``LANDMARKS`` numbers for each text of the sample. Scoring
is one pass over all texts, whole, without a shuffle. A worker keeps the similarities of up to
``TABLE`` words of earlier slices; they are those that it would compute again.

Defined cases: null and empty texts are scored like texts without a similar word; a label row
without id or label is left out, of several labels of an id the largest counts; without both
labels in the training rows every score is their share of toxic ones (0 if there are none).
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import words
from barloom.llm.common import spread, staged, text_slices

SAMPLE = 8000
LANDMARKS = 96
CANDIDATES = 2000
SPAN, DECAY = 6, 0.7
FLOOR, POWER = 0.3, 4
NEAR = 0.85
SLICE_BYTES = 1 << 19
TABLE = 1 << 16
_PART = 1 << 13  # words compared at a time
_BLOCK = 1 << 8  # candidates compared at a time
_GAP = 63  # inside a word, but no letter
_SHAPES = [(a, b) for a, b in itertools.combinations(range(1, SPAN), 2)]


@functools.cache
def _codes() -> np.ndarray:
    """Code of each character up to U+FFFF: 0 white space, 1-26 a-z, 27-62 other letters, 63 the rest."""
    out = np.full(0x10000, _GAP, np.uint8)
    for i in range(0x10000):
        c = chr(i).lower()[0]
        if c.isspace():
            out[i] = 0
        elif "a" <= c <= "z":
            out[i] = ord(c) - 96
        elif c.isalpha():
            out[i] = 27 + ord(c) * 40503 % 36
    return out


@functools.cache
def _table() -> np.ndarray:
    return words.byte_table(lambda i: i != 0)


def _tokens(texts: list[str | None]):
    """Code of each character of the joined texts, and the distinct words: hash, start, end.

    Then text and word of each token, and the joined text.
    """
    whole = "\n".join(t or "" for t in texts)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = _codes()[np.minimum(points, 0xFFFF)]
    bounds = np.append(0, np.cumsum([len(t or "") + 1 for t in texts]))
    bounds[-1] = len(code)
    h, start, end, wb = words.hashes(code, bounds, _table())
    text = np.repeat(np.arange(len(texts)), np.diff(wb))
    letter = (code > 0) & (code < _GAP)
    count = np.append(0, np.cumsum(letter))
    single = count[end] - count[start] == 1
    joined = np.zeros(len(h), bool)
    joined[1:] = single[1:] & single[:-1] & (text[1:] == text[:-1])
    head = np.flatnonzero(~joined)
    if len(head) < len(h):
        place = (np.arange(len(h)) - np.repeat(head, np.diff(np.append(head, len(h))))).astype(np.uint64)
        h = np.add.reduceat(words.mix(h + place), head)
        end = end[np.append(head[1:], len(end)) - 1]
        start, text = start[head], text[head]
    h, first, number = np.unique(h, return_index=True, return_inverse=True)
    return code, h, start[first], end[first], text, number, whole


def _padded(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of words in one array, zeros after each, and the word number of each place."""
    size = end - start
    pad = SPAN - 1
    at = np.append(0, np.cumsum(size + pad))
    places = np.arange(at[-1]) - np.repeat(at[:-1], size + pad)
    source = np.repeat(start, size + pad) + places
    inside = places < np.repeat(size, size + pad)
    codes = np.where(inside, code[np.minimum(source, len(code) - 1)], 0).astype(np.uint8) if len(code) else np.zeros(0, np.uint8)
    codes[codes == _GAP] = 0
    gap = inside & (codes == 0)
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])  # a run of signs is one place
    return np.append(codes[keep], np.zeros(pad, np.uint8)), np.repeat(np.arange(len(size)), size + pad)[keep]


def _words(texts: list[str | None]):
    """Distinct words of texts as codes in one padded array, and which words each text has.

    Returns padded codes, word number of each place, count of words; text and word of each token;
    and for each word a place in the joined text.
    """
    code, h, start, end, text, number, whole = _tokens(texts)
    return *_padded(code, start, end), len(h), text, number, whole, start, end


def _triples(codes: np.ndarray):
    """For each shape of a triple: places where it has three letters, its code, its weight."""
    n = max(0, len(codes) - SPAN + 1)
    wide = codes.astype(np.int32)
    for a, b in _SHAPES:
        x, y, z = wide[:n], wide[a : a + n], wide[b : b + n]
        at = np.flatnonzero((x > 0) & (y > 0) & (z > 0))
        yield at, x[at] << 12 | y[at] << 6 | z[at], DECAY ** (b + 1)


class Landmarks:
    """Words to compare with: for each of their triples the words that have it, and what it counts there."""

    def __init__(self, chosen: list[str]):
        codes, word, n, _, number, *_ = _words(chosen)
        self.words = chosen
        found: dict[int, np.ndarray] = {}
        norm = np.zeros(n)
        for at, triple, weight in _triples(codes):
            norm += np.bincount(word[at], minlength=n) * weight**2
            for t, w in zip(triple.tolist(), word[at].tolist(), strict=True):
                found.setdefault(t, np.zeros(n, np.float32))[w] += weight
        norm = np.sqrt(np.maximum(norm, 1e-12)).astype(np.float32)
        rows = (np.stack([np.zeros(n, np.float32), *found.values()]) / norm)[:, number]  # each of ``chosen`` is one word
        self.most = rows.max(axis=1) if n else np.zeros(1)
        row, self.column = np.nonzero(rows)
        self.value, self.first = rows[row, self.column], np.searchsorted(row, np.arange(len(rows) + 1))
        self.index = np.zeros(1 << 18, np.int32)
        self.index[list(found)] = np.arange(1, len(found) + 1)
        self._empty()

    def _empty(self):
        """The table of words seen: hashes in order, place of each in ``near`` (-1 if none is over the floor)."""
        self.seen, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.near = np.zeros((0, len(self.words)), np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("seen", "place", "near")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._empty()

    def kernel(self, codes: np.ndarray, word: np.ndarray, n: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Words, of ``n``, that may be over ``least`` for a landmark, and their similarity to every one.

        A word's triples, each at the most any landmark gives for it, bound its similarities.
        """
        hits, norm, bound = [], np.zeros(n), np.zeros(n)
        for at, triple, weight in _triples(codes):
            w = word[at]
            norm += np.bincount(w, minlength=n) * weight**2
            row = self.index[triple]
            hit = row > 0
            w, row = w[hit], row[hit]
            bound += np.bincount(w, self.most[row], n) * weight
            hits.append((w, row, np.float32(weight)))
        norm = np.sqrt(np.maximum(norm, 1e-12))
        alive = np.flatnonzero(bound / norm >= least)
        place = np.full(n, -1)
        place[alive] = np.arange(len(alive))
        out = np.zeros(len(alive) * len(self.words))
        for w, row, weight in hits:
            w = place[w]
            w, row = w[w >= 0], row[w >= 0]
            if len(w):  # few landmarks have a triple, so only these are added
                size = self.first[row + 1] - self.first[row]
                at = np.arange(size.sum()) + np.repeat(self.first[row] - (np.cumsum(size) - size), size)
                out += np.bincount(np.repeat(w * len(self.words), size) + self.column[at], self.value[at] * weight, len(out))
        return alive, (out.reshape(len(alive), len(self.words)) / norm[alive][:, None]).astype(np.float32)

    def _nearest(self, code: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word in a table of similarities, -1 if all are under ``FLOOR``; and that table."""
        at = np.searchsorted(self.seen, h)
        known = np.zeros(len(h), bool)
        inside = at < len(self.seen)
        known[inside] = self.seen[at[inside]] == h[inside]
        place, rows, have = np.full(len(h), -1), [self.near], len(self.near)
        place[known] = self.place[at[known]]
        new = np.flatnonzero(~known)
        for part in np.array_split(new, max(1, -(-len(new) // _PART))):
            alive, k = self.kernel(*_padded(code, start[part], end[part]), len(part), FLOOR)
            over = np.flatnonzero((k >= FLOOR).any(axis=1))
            place[part[alive[over]]] = have + np.arange(len(over))
            have += len(over)
            rows.append(k[over])
        near = np.concatenate(rows) if have > len(self.near) else self.near
        if len(self.seen) + len(new) <= TABLE:
            to = at[new]
            self.seen, self.place, self.near = np.insert(self.seen, to, h[new]), np.insert(self.place, to, place[new]), near
        elif len(h) <= TABLE:  # the table starts anew with the words of this slice
            has = place >= 0
            self.seen, self.near, self.place = h, near[place[has]], np.where(has, np.cumsum(has) - 1, -1)
        return place, near

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Similarity of each text's nearest word to every landmark."""
        code, h, start, end, text, number, _ = _tokens(texts)
        out = np.full((len(texts), len(self.words)), FLOOR, np.float32)
        if len(h):
            place, near = self._nearest(code, h, start, end)
            use = np.flatnonzero(place[number] >= 0)
            # in parts: a token has a row of similarities
            for part in np.array_split(use, max(1, -(-len(use) // 50_000))):
                if len(part):
                    t = text[part]
                    head = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
                    out[t[head]] = np.maximum(out[t[head]], np.maximum.reduceat(near[place[number[part]]], head))
        return np.minimum(out, 1) ** POWER


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, classes weighted alike, by Newton steps on its active rows."""
    s = np.where(y > 0, 1.0, -1.0)
    x1 = np.hstack([x, np.ones((len(x), 1))])
    weight = c * np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * len(y)
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x1.shape[1])
    for _ in range(50):
        active = s * (x1 @ w) < 1
        xa = x1[active] * weight[active, None]
        new = np.linalg.solve(ridge + xa.T @ x1[active], xa.T @ s[active])
        if np.abs(new - w).max() < 1e-9:
            break
        w = w + (new - w)
    return w[:-1], float(w[-1])


def fit_scale(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from decisions to probabilities."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([d, np.ones_like(d)], axis=1)
    v = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        grad = x.T @ (p - target) + 1e-6 * v
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5 / max(1e-12, np.abs(step).max()))
        v -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(v[0]), float(v[1])


class Model:
    """Landmarks with the weight of each; or one score for all when there was nothing to learn."""

    def __init__(self, marks: Landmarks | None, beta=None, bias: float = 0.0, constant: float = 0.0):
        self.marks, self.beta, self.bias, self.constant = marks, beta, bias, constant

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.marks is None:
            return np.full(len(texts), self.constant)
        return self.squash(self.marks.features(texts))

    def squash(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.beta + self.bias, -500, 500)))


FOLDS = 3


def fit(marks: Landmarks, features: np.ndarray, y: np.ndarray) -> Model:
    codes, word, n, _, number, *_ = _words(marks.words)
    own = marks.kernel(codes, word, n)[1][number].astype(float)
    own = np.minimum((own + own.T) / 2, 1).clip(0) ** POWER
    value, vector = np.linalg.eigh(own)
    white = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T
    x = features @ white
    w, b = fit_svm(x, y)
    held = x @ w + b
    toxic = y > 0
    if min(toxic.sum(), (~toxic).sum()) >= FOLDS:  # with fewer, a fold would be fitted to one class
        fold = np.where(toxic, np.cumsum(toxic), np.cumsum(~toxic)) % FOLDS
        for f in range(FOLDS):
            wf, bf = fit_svm(x[fold != f], y[fold != f])
            held[fold == f] = x[fold == f] @ wf + bf
    slope, offset = fit_scale(held, y)
    if slope <= 0:  # the machine did not carry over: everyone gets the share of the class
        slope, offset = 0.0, float(np.log(toxic.sum() / (~toxic).sum()))
    return Model(marks, white @ w * slope, b * slope + offset)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(word, toxic)`` for each distinct word of each text."""
    for part in text_slices(batches, "text", SLICE_BYTES):
        texts, toxic = part.column("text").to_pylist(), part.column("toxic").to_numpy(zero_copy_only=False)
        _, _, n, text, number, whole, start, end = _words(texts)
        if n:
            pairs = np.unique(text * n + number)
            names = ["".join(filter(str.isalpha, whole[a:b].lower())) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            word = pairs % n
            yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(word)), pa.array(toxic[pairs // n], pa.int32())], names=["word", "toxic"])


def _features(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            x = shared.value.features(part.column("text").to_pylist())
            raw = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("key"), raw, part.column("toxic")], names=["key", "x", "toxic"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """Fit on at most about ``sample`` labelled rows of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    given = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    given = given.where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0).groupBy("id").agg(F.max("toxic").alias("toxic"))
    n, ones = given.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0))).first()
    if ones == 0 or ones == n:
        return Model(None, constant=ones / n if n else 0.0)
    share = min(1.0, sample / n)
    picked = given.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))  # about ``sample`` rows
    mine = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    rows = mine.join(F.broadcast(picked), "id").select(F.xxhash64("id").alias("key"), "text", "toxic")
    rows = rows.groupBy(F.xxhash64("text").alias("t"), "text").agg(F.min("key").alias("key"), F.max("toxic").alias("toxic")).drop("t")  # copies teach nothing new
    rows = staged(spread(rows), "sample")
    pos, total = rows.agg(F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0)), F.count("*")).first()
    if pos == 0 or pos == total:
        return Model(None, constant=pos / total if total else 0.0)
    seen = rows.mapInArrow(_candidates, "word string, toxic int").groupBy("word").agg(
        F.sum((F.col("toxic") > 0).cast("long")).alias("a"), F.sum((F.col("toxic") <= 0).cast("long")).alias("b")
    ).where(F.length("word") >= 3)
    odds = F.log((F.col("a") + 0.5) / (pos + 1)) - F.log((F.col("b") + 0.5) / (total - pos + 1))
    best = seen.withColumn("gain", F.abs(odds) * F.sqrt(F.col("a") + 0.1 * F.col("b"))).where(odds > 0).orderBy(F.desc("gain"), "word").limit(CANDIDATES).collect()
    chosen = pick([r.word for r in best], landmarks)
    if not chosen:
        return Model(None, constant=pos / total)
    marks = Landmarks(chosen)
    shared = spark.sparkContext.broadcast(marks)  # LANDMARKS words
    got = rows.mapInArrow(_features(shared), "key long, x binary, toxic int").orderBy("key", "x", "toxic").collect()
    x = np.stack([np.frombuffer(r.x, np.float32) for r in got]).astype(float)
    return fit(marks, x, np.array([r.toxic for r in got]))


def pick(ranked: list[str], most: int) -> list[str]:
    """The first words of a ranking, without those too near to one before."""
    out: list[str] = []
    alike = np.zeros((len(ranked), len(ranked)), np.float32)
    # block by block: a table has a row for each triple and a column for each of its words
    blocks = [slice(i, i + _BLOCK) for i in range(0, len(ranked), _BLOCK)]
    for columns in blocks:
        marks = Landmarks(ranked[columns])
        for rows in blocks:
            codes, word, n, _, number, *_ = _words(ranked[rows])
            alike[rows, columns] = marks.kernel(codes, word, n)[1][number]
    kept: list[int] = []
    for i in range(len(ranked)):
        if len(kept) < most and alike[i, i] > 0 and not (alike[i, kept] > NEAR).any():
            kept.append(i)
            out.append(ranked[i])
    return out


def _score(shared, keep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            s = shared.value.scores(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(keep), pa.array(s)], names=[keep, "score"])

    return run


def scored(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``(row, score)``; ``row`` is a struct of the columns ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.struct(*[f"`{c}`" for c in keep]).alias("row"), F.col(text_col).alias("text"))
    return src.mapInArrow(_score(shared, "row"), f"row {src.schema['row'].dataType.simpleString()}, score double")


def digest(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs(doc_id, text)``."""
    found = scored(docs, train(docs, labels, **options), ["doc_id"])
    left = F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 5 == 0
    return found.select(F.col("row.doc_id").alias("doc_id"), F.coalesce(left, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _pass(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            s = shared.value.scores(part.column("text").to_pylist())
            yield part.filter(pa.array(s < 0.5))

    return run


def accepted(docs: DataFrame, labels: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, all columns."""
    model = train(docs.select("doc_id", F.col(text_col).alias("text")), labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.struct(*[f"`{c}`" for c in docs.columns if c != text_col]).alias("row"), F.col(text_col).alias("text"))
    kept = src.mapInArrow(_pass(shared), f"row {src.schema['row'].dataType.simpleString()}, text string")
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
