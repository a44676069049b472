"""Line dedup: lines that at least ``least`` documents hold stay in one document only.

A line's key is the line without white space at both ends, A-Z in lower case; keys of fewer than
``min_chars`` code points never leave. Keys travel as 128-bit hashes.

The index of keys is a set of sorted runs, as in a log-structured merge tree. A run is a table
bucketed and sorted by hash, one row ``(h, n, last)`` for each key: documents that hold it and the
largest id among them. Documents come in batches; a batch is reduced to its own keys, these are
merge-anti-joined with every run (keys that a run has settled, being held by ``least`` documents
and by a larger id, can change nothing), and what is left becomes a run of level 0. As soon as a
level has ``fanout`` runs, they are merged to one of the next level. Runs are bucketed alike, so
neither the anti-joins nor the merges exchange a run. Batches are taken from the largest ids
down, which lets a frequent key settle in the first of them.

At the end the hashes of all lines are joined with the keys to drop. That join has its own
exchange on either side, so adaptive execution splits a line that a third of the documents hold;
a document gets back only the hashes that leave it.

Defined cases: a null or empty text is one empty line; rows that share an id are one document for
the counts and all keep their lines if that id is the largest; null ids count as one document that
is larger than all others; very long texts are cut line by line in one task, in memory of a few
times their size; two different keys share a hash by chance about once in 10^38 pairs.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import NO_ID, fresh_path, own_exchange, shuffle_partitions, text_slices

MIN_CHARS, LEAST = 20, 3
BATCHES, FANOUT = 4, 2
SLICE_BYTES = 4 << 20
BLANKS = " \t\n\x0b\x0c\r"


def key_hash(line: str, min_chars: int) -> bytes | None:
    """Hash of a line's key, if that is long enough."""
    key = line.strip(BLANKS)
    return hashlib.md5(key.encode().lower()).digest() if len(key) >= min_chars else None  # bytes.lower() changes A-Z alone


def _ids(column: str) -> F.Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def hashed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``(doc, h)`` for the different keys of every text that are long enough.

    Python hashes lines faster than ``translate``, which looks up every character of the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            ids, hashes = [], []
            for doc, text in zip(part.column("doc").to_pylist(), part.column("text").to_pylist(), strict=True):
                own = {key_hash(line, min_chars) for line in (text or "").split("\n")} - {None}
                ids += [doc] * len(own)
                hashes += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], names=["doc", "h"])

    return docs.select(_ids(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, "doc long, h binary")


class LineRuns:
    """Levels of sorted runs of line hashes; :meth:`add` takes a batch of ``(doc, h)``.

    No document may be spread over several batches. ``n`` is exact for keys below ``least`` and
    at least ``least`` for the others.
    """

    def __init__(self, spark: SparkSession, least: int = LEAST, fanout: int = FANOUT):
        self.spark, self.least, self.fanout = spark, least, fanout
        self.buckets = shuffle_partitions(spark)  # what a grouped batch is dealt to already
        self.levels: list[list[DataFrame]] = []

    def add(self, lines: DataFrame) -> None:
        own = lines.groupBy("h").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("last"))
        for run in self.runs():
            settled = run.where(F.col("n") >= self.least).select(F.col("h").alias("k"), F.col("last").alias("top"))
            own = own.join(settled, (F.col("h") == F.col("k")) & (F.col("top") >= F.col("last")), "left_anti")
        self._put(0, self._written(own))

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def entries(self) -> DataFrame:
        """One row for each key over all runs."""
        return _merged(self.runs())

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._written(_merged(full)))

    def _written(self, entries: DataFrame) -> DataFrame:
        """A run in the shared folder; the catalog knows it only while it is opened."""
        name = f"line_run_{uuid.uuid4().hex}"
        sink = entries.write.bucketBy(self.buckets, "h").sortBy("h").option("path", fresh_path(self.spark, "run"))
        sink.format("parquet").saveAsTable(name)
        run = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return run


def _merged(runs: list[DataFrame]) -> DataFrame:
    both = runs[0]
    for run in runs[1:]:
        both = both.union(run)
    return both.groupBy("h").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def dropped(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """``(doc, gone)``: hashes of the keys whose lines leave a document, where there are any."""
    spark = docs.sparkSession
    cuts = docs.select(_ids(id_col).alias("doc")).approxQuantile("doc", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    lines = hashed_lines(docs, id_col, text_col, min_chars)
    number = sum((F.when(F.col("doc") <= F.lit(int(c)), 1).otherwise(0) for c in set(cuts)), F.lit(0))
    path = fresh_path(spark, "lines")
    lines.withColumn("batch", number).write.partitionBy("batch").parquet(path)
    kept = spark.read.schema("doc long, h binary, batch int").parquet(path)
    runs = LineRuns(spark, least, fanout)
    for b in range(len(set(cuts)) + 1):
        runs.add(kept.where(F.col("batch") == b).select("doc", "h"))
    leaving = runs.entries().where(F.col("n") >= least).select(own_exchange("h").alias("k"), "last")
    marks = kept.join(leaving, (own_exchange("h") == F.col("k")) & (F.col("doc") < F.col("last")))
    return marks.groupBy("doc").agg(F.collect_set("h").alias("gone"))


def _with_gone(docs: DataFrame, id_col: str, text_col: str, keep: list, options: dict) -> DataFrame:
    gone = dropped(docs, id_col, text_col, **options).select(own_exchange("doc").alias("k"), "gone")
    mine = docs.select(_ids(id_col).alias("doc"), *keep)
    return mine.join(gone, own_exchange("doc") == F.col("k"), "left").drop("doc", "k")


def _stays(lines: list[str], gone: list[bytes], min_chars: int) -> list[str]:
    gone = set(gone)
    return [x for x in lines if key_hash(x, min_chars) not in gone]


def _digest(min_chars: int):
    """Count and digest anew what has a text, which is what loses lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            n_dropped, sha = [0] * part.num_rows, part.column("kept_sha256").to_pylist()
            for k, (text, gone) in enumerate(zip(part.column("text").to_pylist(), part.column("gone").to_pylist(), strict=True)):
                if text is not None:
                    lines = text.split("\n")
                    left = _stays(lines, gone, min_chars)
                    n_dropped[k] = len(lines) - len(left)
                    sha[k] = hashlib.sha256("\n".join(left).encode()).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("n_lines"), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return run


def digest(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)``, one row per row of ``docs(doc_id, text)``."""
    rows = _with_gone(docs, "doc_id", "text", [F.col("doc_id").cast("long").alias("doc_id"), "text"], options)
    text = F.coalesce("text", F.lit(""))
    whole = [F.size(F.split(text, "\n")).cast("long").alias("n_lines"), F.sha2(text, 256).alias("kept_sha256")]
    rows = rows.select("doc_id", F.when(F.col("gone").isNotNull(), F.col("text")).alias("text"), "gone", *whole)
    return rows.mapInArrow(_digest(options.get("min_chars", MIN_CHARS)), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def _cut(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            pairs = zip(part.column("text").to_pylist(), part.column("gone").to_pylist(), strict=True)
            texts = ["\n".join(_stays(t.split("\n"), g, min_chars)) if t and g else t for t, g in pairs]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with repeated lines taken out of the texts; rows, columns and their order stay."""
    row = F.struct(*[f"`{c}`" for c in docs.columns if c != text_col]).alias("row")
    rows = _with_gone(docs, id_col, text_col, [row, F.col(text_col).alias("text")], options)
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(_cut(options.get("min_chars", MIN_CHARS)), f"row {kind}, text string")
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
