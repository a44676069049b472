"""BPE encoding as a bounded-lookahead streaming transducer, and incremental decoding.

Text is fed in pieces and ids leave as soon as no later text can change them:

* Special strings, normalisation and word splitting look at a bounded stretch: a piece is cut
  before white space, or, where a long stretch has none, between two characters that neither
  compose nor begin a special string or a contraction; the word open at the cut goes on.
* Inside a word, a token is final once ``Model.lookahead`` bytes follow it. Merges are applied
  in the order of the list, so what follows can only reach back along a chain of merges of
  rising rank: a merge ``(x, y)`` can come or go if an earlier merge ``(y, z)`` takes ``y`` or
  if ``y`` itself comes or goes. The longest such chain, in bytes, is found in one pass over the
  list. A boundary that is final splits the word into parts that are encoded alone.

Words of up to that length are encoded whole and kept in a bounded table, which drops those that
were not met for long. The words of a slice of texts that it lacks are merged together, by column: a
round applies to each of them its next merge. Memory depends on the merge list alone, not on the
text.

Tokenizer files of this layout are read: BPE with or without an end-of-word suffix, NFC,
white-space and lower-case normalisers, one splitting pattern whose matches are the words, and
byte-level symbols. Null texts count as empty.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import text_slices

PIECE = 1 << 16  # characters held while looking for a cut
WORDS_KEPT = 120_000
WORD_BYTES = 64  # from here on, words are neither kept nor merged by column
MERGED_ROWS = 1 << 14
NO_MERGE = 1 << 40
SLICE_BYTES = 2 << 20
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Model:
    """A vocabulary with its merge list, and what both imply."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout"):
            raise ValueError("plain BPE models only")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.nfc = self.lower = self.squeeze = False
        for step in (spec.get("normalizer") or {}).get("normalizers", []):
            kind = step["type"]
            if kind == "NFC":
                self.nfc = True
            elif kind == "Lowercase":
                self.lower = True
            elif kind == "Replace" and step["pattern"] == {"Regex": "\\s+"} and step["content"] == " ":
                self.squeeze = True
            else:
                raise ValueError(f"normalizer {kind}")
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if (split["type"], split["behavior"], split["invert"], level["type"]) != ("Split", "Removed", True, "ByteLevel"):
            raise ValueError("a splitting pattern and byte-level symbols only")
        white = _SPACE.pattern[1:-2]
        self.pattern = split["pattern"]["Regex"].replace("[^\\s", f"[^{white}")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        v = self.vocab
        self.merges = {(v[a], v[b]): (rank, v[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.lookahead = self._lookahead(pairs)
        symbols = byte_symbols()
        self.bytes = {c: b for b, c in enumerate(symbols)}
        self.first = [v[s] for s in symbols]
        self.last = [v[s + self.suffix] for s in symbols]
        self.strings = {i: s for s, i in v.items()} | {i: s for s, i in self.special.items()}
        self.blank = max(self.strings) + 1  # stands beside the first and the last symbol of a word
        self.first_ids, self.last_ids = np.array(self.first), np.array(self.last)
        self.spaced = pa.array([" " + self.strings.get(i, "") for i in range(self.blank)])
        keys = sorted((a * (self.blank + 1) + b, *made) for (a, b), made in self.merges.items())
        self.pair_keys, self.pair_ranks, _ = np.array(keys or [(-1, 0, 0)], np.int64).T.copy()
        self.made = np.zeros(len(pairs), np.int64)
        for rank, i in self.merges.values():
            self.made[rank] = i

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int:
        """Bytes after which no continuation reaches back: the longest chain of dependent merges."""
        size = lambda t: len(t.removesuffix(self.suffix) if self.suffix else t)
        taken: dict[str, int] = {}  # longest chain ending in a merge whose left part is the token
        made: dict[str, int] = {}  # longest chain ending in the merge that makes the token
        most = 1
        for a, b in pairs:
            reach = size(a) + max(size(b), taken.get(b, 0), made.get(b, 0))
            taken[a] = max(taken.get(a, 0), reach)
            made[a + b] = max(made.get(a + b, 0), reach)
            most = max(most, reach)
        return most

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges in the order of the list, the leftmost first."""
        get = self.merges.get
        none = (1 << 60, 0)
        ranks = [get(p, none) for p in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            best = min(ranks)
            if best is none:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], best[1]), none)
            if i < len(ranks):
                ranks[i] = get((best[1], ids[i + 1]), none)
        return ids


    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of tokens, or ``NO_MERGE``."""
        key = left * (self.blank + 1) + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_MERGE)

    def merge_words(self, words: Sequence[bytes]) -> list[bytes]:
        """Little-endian ids of words, none of them empty: what ``merge`` makes of each."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        wide = int(size.max()) + 2
        column = np.arange(wide)
        used = (column > 0) & (column <= size[:, None])
        ids = np.full(used.shape, self.blank)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids[used] = self.first_ids[raw]
        ids[np.arange(len(words)), size] = self.last_ids[raw[np.cumsum(size) - 1]]
        ranks = np.full(used.shape, NO_MERGE)
        paired = used[:, :-1] & used[:, 1:]
        ranks[:, :-1][paired] = self._ranks(ids[:, :-1][paired], ids[:, 1:][paired])
        after, before = np.tile(column + 1, len(words)), np.tile(column - 1, len(words))
        table, ids, ranks, alive = ranks, ids.ravel(), ranks.ravel(), used.ravel()
        rows = np.arange(len(words))
        while len(rows):
            here = table[rows].argmin(1)  # the leftmost of equal ones
            base = rows * wide
            best = ranks[base + here]
            going = best != NO_MERGE
            rows, base, best, at = rows[going], base[going], best[going], (base + here)[going]
            new = self.made[best]
            gone = base + after[at]
            then = after[gone]
            left, right = base + before[at], base + then
            ids[at] = new
            alive[gone] = False
            after[at] = then
            before[right] = at - base
            ranks[gone] = NO_MERGE
            ranks[at] = self._ranks(new, ids[right])
            ranks[left] = self._ranks(ids[left], new)
        out = ids[alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(used.sum(1))).tolist()
        return [out[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905


class Words(dict):
    """Little-endian ids of words met before. When there are too many, those not met since the last time go."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.older = model, {}

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            raw = word.encode()
            stream = LongWord(self.model)
            out = stream.feed(raw) + stream.close() if len(raw) > 2 * self.model.lookahead else self.short(raw)
            if len(raw) >= WORD_BYTES:
                return out
        self._keep(word, out)
        return out

    def _keep(self, word: str, ids: bytes) -> None:
        if len(self) >= WORDS_KEPT:
            self.older = dict(self)
            self.clear()
        self[word] = ids

    def learn(self, words: set[str]) -> None:
        """Take in the words that are new, those of about one length together."""
        fresh = sorted(words.difference(self).difference(self.older), key=len)
        for k in range(0, len(fresh), MERGED_ROWS):
            part = [(w, r) for w in fresh[k : k + MERGED_ROWS] if len(r := w.encode()) < WORD_BYTES]
            if part:
                names, raw = zip(*part)  # noqa: B905
                for word, ids in zip(names, self.model.merge_words(raw)):  # noqa: B905
                    self._keep(word, ids)

    def short(self, raw: bytes) -> bytes:
        first = self.model.first
        ids = self.model.merge([first[b] for b in raw[:-1]] + [self.model.last[raw[-1]]])
        return b"".join(i.to_bytes(4, "little") for i in ids)


class LongWord:
    """Encoder of one word of any length; holds back the bytes that later ones could change."""

    def __init__(self, model: Model):
        self.model, self.held = model, b""

    def feed(self, raw: bytes) -> bytes:
        m, out = self.model, []
        window = 2 * m.lookahead + 64
        raw = self.held + raw
        at = 0
        while len(raw) - at > window:
            part = raw[at : at + window]
            done = 0
            for i in m.merge([m.first[b] for b in part]):
                n = len(m.strings[i])
                if done + n > window - m.lookahead:
                    break
                out.append(i)
                done += n
            at += done
        self.held = raw[at:]
        return np.array(out, "<u4").tobytes()

    def close(self) -> bytes:
        m, raw = self.model, self.held
        self.held = b""
        return np.array(m.merge([m.first[b] for b in raw[:-1]] + [m.last[raw[-1]]]), "<u4").tobytes() if raw else b""


class Encoder:
    """Streaming encoder: ``feed`` pieces of a text, then ``close``; both return ids as bytes."""

    def __init__(self, model: Model):
        self.model, self.words = model, Words(model)
        self.split = regex.compile(model.pattern)
        # letters and digits up to U+024F spelled out: the same matches, in less time
        self.latin = re.compile(model.pattern.replace(r"\p{L}", "a-zA-Zªµºß-öø-ÿÀ-ÖØ-ÞĀ-ɏ").replace(r"\p{N}", "0-9²³¹¼½¾"))
        self.beyond = re.compile("[^\x00-ɏ]")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, model.special)) + ")") if model.special else None
        self.longest = max(map(len, model.special), default=1)
        self.run = {k: regex.compile(p) for k, p in (("L", r"\p{L}+"), ("S", rf"[^{_SPACE.pattern[1:-2]}\p{{L}}\p{{N}}]+"))}
        self.text, self.open = "", None

    def feed(self, piece: str) -> bytes:
        self.text += piece
        if len(self.text) <= PIECE:
            return b""
        cut = max(self.text.rfind(" "), self.text.rfind("\n"))
        if cut > 0:
            out, self.text = self._whole(self.text[:cut]), self.text[cut:]
            return out
        cut = self._between(self.text)
        if not cut:
            return b""  # nothing but marks that compose: wait for more
        out, self.text = self._whole(self.text[:cut], more=True), self.text[cut:]
        return out

    def close(self) -> bytes:
        out, self.text = self._whole(self.text), ""
        return out

    def _between(self, t: str) -> int:
        """A place where neither characters compose nor a special string or a contraction begins."""
        plain = lambda c: unicodedata.category(c)[0] != "M" and not "ᄀ" <= c <= "ᇿ"
        heads = {s[0] for s in self.model.special}
        for p in range(len(t) - self.longest, self.longest, -1):
            if plain(t[p - 1]) and plain(t[p]) and "'" not in t[p - 3 : p] and not heads & set(t[p - self.longest : p]):
                return p
        return 0

    def _normal(self, t: str) -> str:
        m = self.model
        if m.nfc and not t.isascii():
            t = unicodedata.normalize("NFC", t)
        if m.lower:
            t = t.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        return t

    def _found(self, t: str) -> list[str]:
        return (self.split if not t.isascii() and self.beyond.search(t) else self.latin).findall(t)

    def _whole(self, t: str, more: bool = False) -> bytes:
        """Ids of a stretch; with ``more`` its last word stays open."""
        out = []
        parts = self.marks.split(t) if self.marks and any(s in t for s in self.model.special) else [t]
        for k, part in enumerate(parts):
            if part in self.model.special:
                out += [self._shut(), self.model.special[part].to_bytes(4, "little")]
                continue
            part = self._normal(part)
            if self.open and part:
                head = self.run[self.open[0]].match(part)
                if head:
                    out.append(self.open[1].feed(head[0].encode()))
                    part = part[head.end() :]
                if part:
                    out.append(self._shut())
            found = self._found(part)
            if more and found and k == len(parts) - 1 and part.endswith(found[-1]):
                kind = next((k for k, p in self.run.items() if p.fullmatch(found[-1])), None)
                if kind:
                    self.open = (kind, LongWord(self.model))
                    tail = self.open[1].feed(found.pop().encode())
                    out += [b"".join(map(self.words.__getitem__, found)), tail]
                    continue
            out.append(b"".join(map(self.words.__getitem__, found)))
        if not more:
            out.append(self._shut())
        return b"".join(out)

    def _shut(self) -> bytes:
        out = self.open[1].close() if self.open else b""
        self.open = None
        return out

    def encode(self, text: str) -> bytes:
        if len(text) <= PIECE:
            return self._whole(text)
        return b"".join([self.feed(text[k : k + PIECE]) for k in range(0, len(text), PIECE)] + [self.close()])

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """``encode`` of each; the words of all short ones are looked up first."""
        found = [None if len(t) > PIECE or any(s in t for s in self.model.special) else self._found(self._normal(t)) for t in texts]
        self.words.learn(set().union(*filter(None, found)))
        for text, words in zip(texts, found):  # noqa: B905
            yield self.encode(text) if words is None else b"".join(map(self.words.__getitem__, words))


class Decoder:
    """Streaming decoder. ``joined`` gives token strings with a blank between, as a tokenizer
    without a decoder does; otherwise bytes pass an incremental UTF-8 state machine."""

    def __init__(self, model: Model, joined: bool = False):
        self.strings, self.suffix, self.special = model.strings, model.suffix, model.special
        self.joined, self.begun = joined, False
        self.bytes, self.spaced = model.bytes, model.spaced
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed_joined(self, ids: np.ndarray) -> memoryview:
        """The joined strings of ids as UTF-8."""
        found = self.spaced.take(pa.array(ids))
        _, ends, text = found.buffers()
        if not len(ids) or text is None:
            return memoryview(b"")
        skip = 0 if self.begun else 1  # the blank before the first
        self.begun = True
        return memoryview(text)[skip : np.frombuffer(ends, np.int32)[len(ids)]]

    def feed(self, ids: list[int]) -> str:
        if self.joined:
            return str(self.feed_joined(np.array(ids, np.uint32)), "utf-8")
        found = map(self.strings.__getitem__, ids)
        raw = bytearray()
        out = []
        for s in found:
            if s in self.special:
                out += [self.utf8.decode(bytes(raw), False), s]
                raw.clear()
                continue
            end = self.suffix and s.endswith(self.suffix)
            raw += bytes(self.bytes[c] for c in (s[: -len(self.suffix)] if end else s))
            if end:
                raw += b" "
        out.append(self.utf8.decode(bytes(raw), False))
        return "".join(out)

    def close(self) -> str:
        return self.utf8.decode(b"", True)


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


_READY: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    """The worker's encoder of this tokenizer; its word table lasts from task to task."""
    key, packed = shared.value
    if key not in _READY:
        _READY.clear()
        _READY[key] = Encoder(Model(json.loads(zlib.decompress(packed))))
    return _READY[key]


def _digests(shared, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for part in text_slices(batches, "text", SLICE_BYTES):
            n, all_ids, sha, back = [], [], [], []
            for raw in encoder.encode_all([t or "" for t in part.column("text").to_pylist()]):
                ids = np.frombuffer(raw, "<u4")
                digest, decoder = hashlib.sha256(), Decoder(encoder.model, joined=True)
                for k in range(0, len(ids), PIECE):
                    digest.update(decoder.feed_joined(ids[k : k + PIECE]))
                n.append(len(ids))
                sha.append(hashlib.sha256(raw).hexdigest())
                back.append(digest.hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
            cols = {"row": part.column("row"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(sha), "decoded_sha256": pa.array(back)}
            if with_ids:
                ends = np.append(0, np.cumsum(n)).astype(np.int32)
                cols["ids"] = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(all_ids)))
            yield pa.RecordBatch.from_pydict(cols)

    return run


def encoded(docs: DataFrame, path: str, keep: list[str], text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``keep`` columns with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``ids``."""
    spec = json.dumps(load(path), sort_keys=True).encode()
    shared = docs.sparkSession.sparkContext.broadcast((hashlib.sha256(spec).hexdigest(), zlib.compress(spec)))  # a tokenizer file, of its own fixed size
    src = docs.select(F.struct(*[f"`{c}`" for c in keep]).alias("row"), F.col(text_col).alias("text"))
    kind = f"row {src.schema['row'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return src.mapInArrow(_digests(shared, with_ids), kind).select(*[F.col(f"row.`{c}`").alias(c) for c in keep], "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids)
