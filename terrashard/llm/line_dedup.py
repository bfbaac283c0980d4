"""Lines that many documents share: found by one range partitioning, told as a bitmap for each document.

A line's key is the line without the six ASCII spaces at both ends, A-Z in lower case. Keys of LEAST_CHARS code points that LEAST_DOCS
documents hold lose their lines everywhere but in the largest doc_id that holds them; there all of them stay.

Keys travel as 128-bit hashes, never as text. Rows (hash, doc_id, tag, position) are range-partitioned by hash with a secondary
sort by document (largest first) and position, and each task streams its range: the first document of a run of equal hashes
is the one that keeps its lines; later ones are told to drop once the run has LEAST_DOCS documents, and until then at most
LEAST_DOCS - 1 documents' lines wait. A very common line fills many ranges, so runs that touch the ends of a range are left
open: each task gives one summary for its first and one for its last run (documents, first, last), which are merged over ranges, two
rows for each at most, and the open rows join them. No key meets in one task, however common.

What comes out is a compressed bitmap (bit i: line i stays) for each document that loses a line; texts are read again, and
joined with it, only to apply it. A document is named by doc_id and a hash of its text, so nothing is numbered or copied.

Defined results: a document is what one doc_id names: rows that repeat an id count once, and all of them keep a line if theirs is the largest id;
rows without an id are together one document, smaller than the others; null text is one empty line; equal rows get equal bitmaps;
an empty table gives an empty one. Only doc_id and text are read, so further columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACES, settle

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Most bytes of bitmaps that a join may broadcast.
BROADCAST_BYTES = 16 << 20
LINES = "h1 long, h2 long, doc_id long, tag long, pos int"
#: What a task says: a line to drop, a line of an open run, the summary of an open run.
DROP, OPEN, SUMMARY = 0, 1, 2
STREAMED = "kind int, h1 long, h2 long, doc_id long, tag long, pos int, n_docs long, last_doc long, part int"
STRIPPED = SPACES.encode()


def tag(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_keys(least_chars: int = LEAST_CHARS):
    """Hash and position of every line whose key is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # one text at a time: memory follows the longest
                text = batch.column("text")[row].as_py()
                places, digests = [], []
                for i, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
                    key = line.strip(STRIPPED)
                    if len(key) >= least_chars and (len(key) >= 4 * least_chars or len(key.decode("utf-8", "surrogatepass")) >= least_chars):
                        places.append(i)
                        digests.append(xxhash.xxh3_128_digest(key.lower()))
                if places:
                    h = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                    same = lambda c: pa.array([batch.column(c)[row].as_py()] * len(places), pa.int64())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), same("doc_id"), same("tag"), pa.array(places, pa.int32())], ["h1", "h2", "doc_id", "tag", "pos"])

    return run


class Lines:
    """Columns of some lines, as numpy arrays; a null doc_id is 0, and told by a column of its own."""

    NAMES = ("h1", "h2", "doc", "none", "tag", "pos")

    def __init__(self, columns: list[np.ndarray]) -> None:
        self.columns = columns

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> Lines:
        number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        doc = batch.column("doc_id")
        return cls([number("h1"), number("h2"), doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_null().to_numpy(zero_copy_only=False), number("tag"), number("pos")])

    def __getattr__(self, name: str) -> np.ndarray:
        return self.columns[self.NAMES.index(name)]

    def __len__(self) -> int:
        return len(self.columns[0])

    def take(self, what) -> Lines:
        return Lines([c[what] for c in self.columns])

    def document(self, i: int) -> tuple[int, bool]:
        return int(self.doc[i]), bool(self.none[i])

    def other_than(self, document: tuple[int, bool]) -> np.ndarray:
        return (self.doc != document[0]) | (self.none != document[1])

    def changes(self, of_hash: bool) -> np.ndarray:
        """Whether each line but the first differs from the one before it in its hash (or else in its document)."""
        a, b = (("h1", "h2") if of_hash else ("doc", "none"))
        x, y = getattr(self, a), getattr(self, b)
        return (x[1:] != x[:-1]) | (y[1:] != y[:-1])


class Run:
    """A run of equal hashes that isn't over yet."""

    def __init__(self, lines: Lines, is_first: bool) -> None:
        self.hash, self.first, self.last, self.n_docs = (int(lines.h1[0]), int(lines.h2[0])), lines.document(0), None, 0
        self.is_first, self.waiting = is_first, []

    def feed(self, lines: Lines, least_docs: int) -> Iterator[tuple[int, Lines]]:
        """Takes lines of the run in order. Gives (kind, lines) that needn't wait."""
        self.n_docs += int(lines.changes(False).sum()) + (self.last is None or lines.document(0) != self.last)
        self.last = lines.document(len(lines) - 1)
        if self.is_first:
            yield OPEN, lines
            return
        self.waiting.append(lines)
        if self.n_docs >= least_docs:
            for some in self.waiting:
                yield DROP, some.take(some.other_than(self.first))
            self.waiting = []

    def end(self) -> Iterator[tuple[int, Lines]]:
        """Of the last run of a range: what still waits is open."""
        yield from ((OPEN, some) for some in self.waiting)


def told(part: int, kind: int, lines: Lines) -> pa.RecordBatch:
    n = len(lines)
    doc = pa.array(lines.doc, pa.int64(), mask=lines.none)
    none = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(lines.h1), pa.array(lines.h2), doc, pa.array(lines.tag), pa.array(lines.pos.astype(np.int32)), none, none, pa.array(np.full(n, part, np.int32))],
        [c.split()[0] for c in STREAMED.split(", ")],
    )


def summary(part: int, run: Run) -> pa.RecordBatch:
    one = lambda v, t=pa.int64(): pa.array([v], t)
    of = lambda d: one(None if d[1] else d[0])
    return pa.RecordBatch.from_arrays(
        [one(SUMMARY, pa.int32()), one(run.hash[0]), one(run.hash[1]), of(run.first), one(None), one(None, pa.int32()), one(run.n_docs), of(run.last), one(part, pa.int32())],
        [c.split()[0] for c in STREAMED.split(", ")],
    )


def stream(least_docs: int = LEAST_DOCS):
    """Of one range of sorted lines: lines to drop, open lines, and the summaries of its first and last run (see STREAMED)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, now = TaskContext.get().partitionId(), None
        for batch in batches:
            lines = Lines.read(batch)
            if not len(lines):
                continue
            starts = np.concatenate([[0], np.flatnonzero(lines.changes(True)) + 1, [len(lines)]])
            lead = 0  # runs of this batch that are dealt with already
            if now is not None and now.hash == (int(lines.h1[0]), int(lines.h2[0])):
                for kind, some in now.feed(lines.take(slice(0, starts[1])), least_docs):
                    yield told(part, kind, some)
                lead = 1
            if lead == len(starts) - 1:
                continue
            if now is not None and now.is_first:
                yield summary(part, now)
            first, last = starts[lead], starts[-2]
            if now is None:  # the range begins
                last_of_first = starts[1]
                now = Run(lines, True)
                for kind, some in now.feed(lines.take(slice(0, last_of_first)), least_docs):
                    yield told(part, kind, some)
                if len(starts) == 2:
                    continue
                yield summary(part, now)
                first, lead = last_of_first, 1
            if last > first:  # runs that lie within the batch
                whole = lines.take(slice(first, last))
                begin = starts[lead:-2] - first
                new = np.concatenate([[True], whole.changes(False)])
                new[begin] = True
                docs = np.add.reduceat(new.astype(np.int64), begin)
                size = np.diff(np.append(begin, len(whole)))
                many = np.repeat(docs >= least_docs, size)
                if many.any():
                    head = np.repeat(begin, size)
                    later = (whole.doc != whole.doc[head]) | (whole.none != whole.none[head])
                    yield told(part, DROP, whole.take(many & later))
            rest = lines.take(slice(last, len(lines)))
            now = Run(rest, False)
            for kind, some in now.feed(rest, least_docs):
                yield told(part, kind, some)
        if now is not None:
            for kind, some in now.end():
                yield told(part, kind, some)
            yield summary(part, now)

    return run


def decided(streamed: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """h1, h2, keeper, n_docs of the open runs that are common: their summaries put together, in the order of ranges. Two rows for each range at most."""
    line = Window.partitionBy("h1", "h2").orderBy("part")
    parts = streamed.where(F.col("kind") == SUMMARY).select("h1", "h2", "part", "n_docs", F.col("doc_id").alias("first"), "last_doc")
    again = F.when(F.col("before").isNotNull() & F.col("before.last_doc").eqNullSafe(F.col("first")), 1).otherwise(0)  # a document that two ranges share
    parts = parts.withColumn("before", F.lag(F.struct("last_doc")).over(line))
    runs = parts.groupBy("h1", "h2").agg(F.min_by(F.struct("first"), "part").alias("f"), F.sum(F.col("n_docs") - again).alias("n_docs"))
    return runs.where(F.col("n_docs") >= least_docs).select("h1", "h2", F.col("f.first").alias("keeper"), "n_docs")


def packed(n_lines: Column, dropped: Column) -> Column:
    """Compressed bitmap of lines that stay; dropped: positions of the others."""

    def one(n: int, places: np.ndarray) -> bytes:
        bits = np.ones(n, np.uint8)
        bits[np.asarray(places, np.int64)] = 0
        return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6)

    def all_(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
        return pd.Series([one(n, p) for n, p in zip(n_lines, dropped, strict=True)])

    return F.pandas_udf(all_, "binary")(n_lines, dropped)


def unpacked(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines, bitorder="little").astype(bool)


def bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, tag (a hash of the text), n_dropped, keep (compressed bitmap over n_bits lines; later lines stay). Only documents that lose a line."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tag", tag(F.col("text")))
    lines = settle(given.mapInArrow(line_keys(least_chars), LINES), "lines")
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last(), F.col("tag"), F.col("pos")]
    streamed = settle(lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(stream(least_docs), STREAMED), "streamed")
    common = F.broadcast(decided(streamed, least_docs))  # two rows for each range at most
    opened = streamed.where(F.col("kind") == OPEN).join(common, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    dropped = streamed.where(F.col("kind") == DROP).select("doc_id", "tag", "pos").union(opened.select("doc_id", "tag", "pos"))
    # Positions of a document are as many as its lines; rows that repeat id and text give each twice.
    found = dropped.groupBy("doc_id", "tag").agg(F.collect_set("pos").alias("dropped"))
    n_bits = F.array_max("dropped") + 1
    made = settle(found.select("doc_id", "tag", F.size("dropped").cast("long").alias("n_dropped"), n_bits.alias("n_bits"), packed(n_bits, F.col("dropped")).alias("keep")), "bitmaps")
    return made


def applied(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, text: what stays of each row's text, by its bitmap."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tag", tag(F.col("text")))
    rows, size = found.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("keep") + 40), F.lit(0))).first()
    side = F.broadcast(found) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else found.hint("merge")
    side = side.withColumnsRenamed({"doc_id": "named", "tag": "tagged"})
    met = given.join(side, (F.col("tag") == F.col("tagged")) & F.col("doc_id").eqNullSafe(F.col("named")), "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), "n_bits", "keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, kept = [], []
            for text, n, keep in zip(batch.column("text"), batch.column("n_bits"), batch.column("keep"), strict=True):
                text, keep = text.as_py(), keep.as_py()
                n_lines.append(text.count("\n") + 1)
                if keep is not None:
                    lines, stays = text.split("\n"), unpacked(keep, n.as_py())
                    text = "\n".join([x for x, k in zip(lines, stays, strict=False) if k] + lines[len(stays) :])
                kept.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_lines, pa.int64()), batch.column("n_dropped"), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])

    return met.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, text string")
