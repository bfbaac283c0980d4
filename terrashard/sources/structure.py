"""Documents of any size: a structural index over chunks, from which tiles are cut as rows.

A document is cut into chunks that end at a closing brace (files are read with the brace as line separator, so Spark splits one file
over many tasks). For each chunk an index entry is made, small whatever the chunk holds: what it closes of that which was open
before, what it leaves open, and how many objects it counts in each, for both cases, that it begins inside a string or outside.
Entries are folded in order, a document a group, into the state in which each chunk begins: in a string or not, and the containers that are
open. With it, every chunk is cut by itself: text belongs to the innermost tile around it, and where a tile is cut out, its
parent keeps `{}`. The pieces of each tile are joined by one grouping. What comes out is a JSON text for each tile, with its own members
only, and one for the document with an empty root; these are as small as tiles are, and go on as VARIANT.

Documents of one chunk are cut at once, without index and fold (at_once()).
A task holds a chunk (CHUNK bytes and up to the next brace) and what it cuts from it; the fold holds an entry for each chunk of a document.
Braces, brackets and quotes are told by one regular expression; it runs in Python, as what a quote means depends on all that was before it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import settle

CHUNK = 1 << 20
TOKEN = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*("?)|[{}\[\]]', re.S)
REST = re.compile(rb'[^"\\]*(?:\\.[^"\\]*)*("?)', re.S)
#: Containers: an object without a key, the object under `root`, the array under `children`, any other.
OBJECT, ROOT, CHILDREN, OTHER = "{", "r", "c", "."
ENTRY = "struct<inside:boolean,pops:int,base:int,codes:string,counts:array<int>>"
CHUNKS = f"of string, start long, seq int, size long, data binary, outer {ENTRY}, inner {ENTRY}"
STATES = "of string, start long, seq int, inside boolean, codes string, counts array<int>, trim boolean"
SPACE = b" \t\r\n"


def named(key: bytes, name: bytes) -> bool:
    if b"\\" in key:
        try:
            return json.loads(key) == name.decode()
        except ValueError:
            return False
    return key[1:-1] == name


def code(data: bytes, at: int, key: tuple[int, int] | None) -> str:
    """What kind of container begins at a place; key: where the last string lies, if it began in this chunk."""
    before = data[key[1] : at].strip(SPACE) if key else data[max(0, at - 64) : at].rstrip(SPACE)[-1:]
    if before != b":":
        return OBJECT if data[at] == 0x7B else OTHER
    if not key:
        return OTHER
    return ROOT if data[at] == 0x7B and named(data[slice(*key)], b"root") else CHILDREN if data[at] == 0x5B and named(data[slice(*key)], b"children") else OTHER


def tokens(data: bytes, inside: bool) -> Iterator[tuple[int, str]]:
    """(place, code) of what opens, (place, "") of what closes; last (length, "s" or "e"): whether the end lies in a string."""
    at, key = 0, None
    if inside:
        m = REST.match(data)
        if not m[1]:
            yield len(data), "s"
            return
        at = m.end()
    for m in TOKEN.finditer(data, at):
        first = data[m.start()]
        if first == 0x22:
            if not m[1]:
                yield len(data), "s"
                return
            key = m.span()
        elif first in b"{[":
            yield m.start(), code(data, m.start(), key)
        else:
            yield m.start(), ""
    yield len(data), "e"


def entry(data: bytes, inside: bool) -> dict:
    """What a chunk does to the containers that are open: how many it closes, objects counted in the one that is then on top, and those it leaves open, with their counts."""
    pops, base, codes, counts = 0, 0, [], []
    for _, what in tokens(data, inside):
        if what in ("s", "e"):
            inside = what == "s"
        elif what:
            if what == OBJECT and counts:
                counts[-1] += 1
            elif what == OBJECT:
                base += 1
            codes.append(what)
            counts.append(0)
        elif codes:
            codes.pop()
            counts.pop()
        else:
            pops, base = pops + 1, 0
    return {"inside": inside, "pops": pops, "base": base, "codes": "".join(codes), "counts": counts}


def indexed(of: str, start: int, seq: int, size: int, data: bytes) -> dict:
    return {"of": of, "start": start, "seq": seq, "size": size, "data": data, "outer": entry(data, False), "inner": entry(data, True)}


def batches_of(rows: Iterator[dict], schema: pa.Schema, held: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches that end once they hold `most` bytes."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row[held]) + 100
        if size >= most:
            yield pa.RecordBatch.from_pylist(some, schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_pylist(some, schema)


ENTRY_TYPE = pa.struct([("inside", pa.bool_()), ("pops", pa.int32()), ("base", pa.int32()), ("codes", pa.string()), ("counts", pa.list_(pa.int32()))])
CHUNK_TYPE = pa.schema([("of", pa.string()), ("start", pa.int64()), ("seq", pa.int32()), ("size", pa.int64()), ("data", pa.binary()), ("outer", ENTRY_TYPE), ("inner", ENTRY_TYPE)])


def read(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """Indexed chunks of files (not compressed ones). of: the file's path. The table is stored."""
    meta = lambda c: F.col(f"_metadata.{c}").alias(c)
    records = spark.read.option("lineSep", "}").text(path).select(meta("file_path"), meta("file_block_start"), meta("file_size"), F.col("value").cast("binary").alias("value"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        place, seq, parts, held = None, 0, [], 0
        for batch in batches:
            for path_, start, size, value in zip(*(batch.column(i) for i in range(4)), strict=True):
                here = (path_.as_py(), start.as_py(), size.as_py())
                if place is not None and (here != place or held >= chunk):
                    yield indexed(*place[:2], seq, place[2], b"".join(parts))
                    seq, parts, held = (seq + 1 if here == place else 0), [], 0
                place = here
                parts += (value.as_py(), b"}")
                held += len(parts[-2]) + 1
        if place is not None:
            yield indexed(*place[:2], seq, place[2], b"".join(parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(found(batches), CHUNK_TYPE, "data")

    return settle(records.mapInArrow(run, CHUNKS), "chunks")


def chunks(documents: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Indexed chunks of texts (of, json). The table is stored."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for of, text in zip(batch.column("of"), batch.column("json"), strict=True):
                data = text.as_py() or b""
                at = seq = 0
                while at < len(data) or not seq:
                    end = data.find(b"}", at + chunk - 1) + 1 or len(data)
                    yield indexed(of.as_py(), 0, seq, len(data), data[at:end])
                    at, seq = max(end, 1), seq + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(found(batches), CHUNK_TYPE, "data")

    return settle(documents.select("of", F.col("json").cast("binary").alias("json")).mapInArrow(run, CHUNKS), "chunks")


def fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state in which each chunk of a document begins. trim: whether the last one's last brace isn't there (a file needn't end with a separator)."""
    pdf = pdf.sort_values(["start", "seq"])
    inside, codes, counts, out = False, "", [], []
    for outer, inner in zip(pdf["outer"], pdf["inner"], strict=True):
        out.append((inside, codes, list(counts)))
        e = inner if inside else outer
        left = max(0, len(codes) - e["pops"])
        codes, counts, inside = codes[:left] + e["codes"], counts[:left], bool(e["inside"])
        if counts:
            counts[-1] += e["base"]
        counts += list(e["counts"])
    more = [False] * (len(pdf) - 1) + [int(pdf["bytes"].sum()) > int(pdf["size"].iloc[0])]
    return pdf[["of", "start", "seq"]].assign(inside=[x[0] for x in out], codes=[x[1] for x in out], counts=[x[2] for x in out], trim=more)


def on_spine(i: int, what: str) -> bool:
    """Whether a container at a place of the stack can be one of those that tiles lie in: document, root, children, tile, children, ..."""
    return what == (OBJECT if i == 0 else ROOT if i == 1 else CHILDREN if i % 2 == 0 else OBJECT)


def cut(data: bytes, inside: bool, codes: str, counts: list[int]) -> dict[tuple | None, list[bytes]]:
    """The text of a chunk by the tile that it belongs to (its path; None: the document), in order."""
    stack, counts, spine = list(codes), list(counts), 0
    while spine < len(stack) and on_spine(spine, stack[spine]):
        spine += 1
    out, at = {}, 0

    def owner() -> tuple | None:
        return None if spine < 2 else tuple(counts[i] - 1 for i in range(2, spine // 2 * 2, 2))

    def keep(end: int) -> None:
        nonlocal at
        if end > at:
            out.setdefault(owner(), []).append(data[at:end])
        at = end

    for place, what in tokens(data, inside):
        if what in ("s", "e"):
            break
        if what:
            if what == OBJECT and counts:
                counts[-1] += 1
            if len(stack) == spine and on_spine(spine, what):
                if spine % 2:  # a tile begins
                    keep(place)
                    out.setdefault(owner(), []).append(b"{}")
                spine += 1
            stack.append(what)
            counts.append(0)
        elif stack:
            if len(stack) == spine:
                if spine % 2 == 0:  # a tile ends
                    keep(place + 1)
                spine -= 1
            stack.pop()
            counts.pop()
    keep(len(data))
    return out


PIECE_TYPE = pa.schema([("of", pa.string()), ("path", pa.list_(pa.int32())), ("start", pa.int64()), ("seq", pa.int32()), ("text", pa.binary())])


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found() -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                of, start, seq, data, inside, codes, counts, trim = (batch.column(c)[i].as_py() for c in ("of", "start", "seq", "data", "inside", "codes", "counts", "trim"))
                for path, text in cut(data[:-1] if trim else data, inside, codes, counts).items():
                    yield {"of": of, "path": None if path is None else list(path), "start": start, "seq": seq, "text": b"".join(text)}

    return batches_of(found(), PIECE_TYPE, "text")


WHOLE_TYPE = pa.schema([("of", pa.string()), ("path", pa.list_(pa.int32())), ("text", pa.binary())])


def at_once(documents: DataFrame) -> DataFrame:
    """texts() of documents (of, json) of one chunk each: nothing is open before it, so there is nothing to index or to fold, and its pieces of a tile are all there are."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for of, text in zip(batch.column("of").to_pylist(), batch.column("json").to_pylist(), strict=True):
                for path, parts in cut(text or b"", False, "", []).items():
                    yield {"of": of, "path": None if path is None else list(path), "text": b"".join(parts)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(found(batches), WHOLE_TYPE, "text")

    pieces_ = documents.select("of", F.col("json").cast("binary").alias("json")).mapInArrow(run, "of string, path array<int>, text binary")
    return pieces_.select("of", "path", F.try_validate_utf8(F.col("text").cast("string")).alias("text"))


def texts(indexed_chunks: DataFrame) -> DataFrame:
    """of, path (of a tile; null for the document), text. indexed_chunks: as read() and chunks() store them."""
    index = indexed_chunks.select("of", "start", "seq", "size", F.octet_length("data").alias("bytes"), "outer", "inner")
    states = settle(index.groupBy("of").applyInPandas(fold, STATES), "states")
    cut_ = indexed_chunks.select("of", "start", "seq", "data").join(states, ["of", "start", "seq"]).mapInArrow(pieces, "of string, path array<int>, start long, seq int, text binary")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq", "text"))), lambda p: p["text"].cast("string")), "")
    return cut_.groupBy("of", "path").agg(whole.alias("text")).select("of", "path", F.try_validate_utf8("text").alias("text"))
