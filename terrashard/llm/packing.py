"""Cost-balanced packing of documents into training sequences.

Documents are tokenised (byte-level BPE, then an end id), and cut into pieces of at most one sequence. A full piece
fills a sequence. The rest are dealt by hash into shards of a bounded number of tokens; each shard has as many
sequences as its tokens need, and takes its pieces in descending order of cost, which is LINEAR * n + QUADRATIC * n^2
for n tokens. A piece goes to the sequence of least cost with room for it; where none has room, it is cut to fill the
roomiest and what is left waits its turn. So a shard's padding is less than one sequence, and costs stay even.

The number of shards follows the tokens, estimated from the bytes of text and the rows; a document's pieces go to
different shards, so a long document, or a source with a third of all rows, makes no shard large. Rows that repeat an id
are dealt by their ids' content too, and copies of one document by their number within a task.

Ids are those of the `tokenizers` library for a tokenizer file (a parameter), its added tokens included. For byte-level
files they are found for each distinct word between single spaces, and remembered in a bounded cache.

Defined results: null text is one piece, the end id; rows that repeat a doc_id are packed as documents of their own
(equal pieces; each has its own place); an empty table gives an empty one. Only doc_id and text are read.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache

SEQUENCE = 2048
END_ID = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Bytes of text (and ROW_BYTES for each row's end id) whose short pieces share a shard, about 300,000 tokens.
SHARD_BYTES, ROW_BYTES = 2_000_000, 7
#: Most sequences of a shard that ids leave room for.
STRIDE = 1 << 32
CACHE = 600_000
#: Copies of one document, in one task, that are dealt alike.
COPIES = 64
#: Text whose characters every version of Unicode sorts alike (ASCII, and Latin letters), and how byte-level BPE splits it: contractions, letters, digits, other characters, spaces.
PLAIN = re.compile(r"[\n -~À-ÖØ-öø-ɏ]*")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space that has another white space beside it, and one that has none.
CROWDED, CLEAN = re.compile(r"\s | \s"), re.compile(r"(?<=\S) (?=\S)")

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, salt long"
PACKED = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"


def byte_symbols() -> dict[str, int]:
    """Byte-level BPE writes bytes as characters: printable Latin-1 as itself, the others from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = itertools.count(256)
    return {chr(b) if b in shown else chr(next(hidden)): b for b in range(256)}


def ranks(content: dict) -> dict[bytes, int] | None:
    """Byte-pair ranks of a tokenizer file; None unless it is byte-level, without a step before, and numbers its merges in their order."""
    before, model, symbols = content.get("pre_tokenizer") or {}, content["model"], byte_symbols()
    plain = not content.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not plain or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if len(merged) + 256 != len(model["vocab"]) or any(model["vocab"].get(m) != 256 + i for i, m in enumerate(merged)):
        return None
    return {bytes(symbols[c] for c in token): i for token, i in model["vocab"].items()}


class Words(dict):
    """A word between spaces to the ids of the space and it, as little-endian 32-bit bytes; forgotten when full.

    Byte-level BPE joins a space to what follows, and apart from that splits no differently for what stands before a
    space. So where no space touches other white space, a text's ids are those of its words, each with its space. New
    words of PLAIN are merged by `tiktoken` from the ranks of the same file, which takes a fifth of the time; other words
    are encoded by `tokenizers`, as is the whole of a text with an added token of the file in it.
    """

    def __init__(self, tokenizer: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        content = json.loads(tokenizer)
        self.encode, found = Tokenizer.from_buffer(tokenizer).encode, ranks(content)
        self.merge = found and tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=found, special_tokens={}).encode_ordinary
        added = [x["content"] for x in content.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def plain(self, text: str) -> bytes:
        return array("I", self.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self[word] = array("I", self.merge(" " + word)).tobytes() if PLAIN.fullmatch(word) else self.plain(" " + word)
        return ids

    def ids(self, text: str) -> bytes:
        if not self.merge or self.added and self.added.search(text):
            return self.plain(text)
        first, *rest = CLEAN.split(text) if CROWDED.search(text) else text.split(" ")
        return self.plain(first) + b"".join(map(self.__getitem__, rest))


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """Every document's ids, with the end id, in pieces of one sequence and a last, shorter one."""
    with open(tokenizer, "rb") as f:  # a few MB; travels with the job
        content = f.read()
    vocabulary, name = docs.sparkSession.sparkContext.broadcast(content), zlib.crc32(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, width = worker_cache(("words", name), lambda: Words(vocabulary.value)), np.array([END_ID], "<u4").tobytes(), 4 * sequence
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        seen = Counter()
        for batch in batches:
            out, size = [[] for _ in COLUMNS], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = words.ids(text.as_py() or "") + end
                copy = seen[key := hash((doc, ids))]
                seen[key] = copy + 1
                # The first copies in a task have no number, so that where a table is cut changes nothing for documents without copies.
                salt = 0 if copy < COPIES else (task + 1) << 32 | copy // COPIES
                for at in range(0, len(ids), width):
                    part = ids[at : at + width]
                    for to, x in zip(out, (doc, at // 4, len(part) // 4, len(ids) // 4, part, salt), strict=True):
                        to.append(x)
                size += len(ids)
                if size > 8_000_000:
                    yield as_batch(out)
                    out, size = [[] for _ in COLUMNS], 0
            yield as_batch(out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


COLUMNS = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "doc_tokens": pa.int64(), "ids": pa.binary(), "salt": pa.int64()}


def as_batch(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, COLUMNS.values(), strict=True)], list(COLUMNS))


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


class Room:
    """Sequences by tokens used: the cheapest with room for a piece, and the roomiest, each in a few steps."""

    def __init__(self, n: int, sequence: int):
        self.sequence, self.leaves = sequence, 1 << sequence.bit_length()
        self.heaps = [[] for _ in range(sequence + 1)]  # (cost, sequence) of those that use so many tokens
        self.heaps[0] = [(0.0, k) for k in range(n)]
        self.best = [NONE] * (2 * self.leaves)  # a tree of minima over the heaps' tops
        self.settle(0)

    def settle(self, used: int) -> None:
        k, heap = self.leaves + used, self.heaps[used]
        self.best[k] = heap[0] if heap else NONE
        while k > 1:
            k //= 2
            self.best[k] = min(self.best[2 * k], self.best[2 * k + 1])

    def cheapest(self, most: int) -> int | None:
        """Tokens used by the cheapest sequence among those that use no more than `most`."""
        low, high, nodes = self.leaves, self.leaves + most + 1, []
        while low < high:
            if low & 1:
                nodes.append(low)
                low += 1
            if high & 1:
                high -= 1
                nodes.append(high)
            low, high = low // 2, high // 2
        k = min(nodes, key=self.best.__getitem__)
        if self.best[k] == NONE:
            return None
        while k < self.leaves:
            k = 2 * k if self.best[2 * k] == self.best[k] else 2 * k + 1
        return k - self.leaves

    def roomiest(self) -> int:
        k = 1
        while k < self.leaves:
            k = 2 * k if self.best[2 * k] != NONE else 2 * k + 1
        return k - self.leaves

    def put(self, size: int) -> tuple[int, int, int]:
        """(sequence, offset, length) of as much of a piece as is put down at once."""
        used = self.cheapest(self.sequence - size)
        if used is None:
            used = self.roomiest()
            size = self.sequence - used
        total, to = heapq.heappop(self.heaps[used])
        heapq.heappush(self.heaps[used + size], (total + cost(size), to))
        self.settle(used)
        self.settle(used + size)
        return to, used, size


NONE = (float("inf"), -1)


def assign(lengths: list[int], sequence: int) -> list[tuple[int, int, int, int, int]]:
    """(piece, from, length, sequence, offset) of every part, for pieces of given lengths."""
    room = Room(-(-sum(lengths) // sequence), sequence)
    wait, out = [(-x, i, 0) for i, x in enumerate(lengths)], []
    heapq.heapify(wait)
    while wait:
        size, i, start = heapq.heappop(wait)
        to, offset, put = room.put(-size)
        out.append((i, start, put, to, offset))
        if put < -size:
            heapq.heappush(wait, (size + put, i, start + put))
    return out


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset."""
    volume = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + ROW_BYTES), F.lit(0)).alias("b")).first().b
    shards = int(max(1, -(-volume // SHARD_BYTES)))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        # Ties and arrival order don't count: the same pieces are always packed alike.
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids", "ascending")])
        lengths = rows["length"].to_pylist()
        if shard < 0:  # full pieces fill a sequence each
            parts = [(i, 0, n, i, 0) for i, n in enumerate(lengths)]
        else:
            parts = assign(lengths, sequence)
        at = np.array([p[0] for p in parts], np.int64)
        cut, length, to, offset = (np.array([p[k] for p in parts], np.int64) for k in (1, 2, 3, 4))
        took = rows.take(pa.array(at))
        ids = [x.as_py()[4 * a : 4 * (a + n)] for x, a, n in zip(took["ids"], cut.tolist(), length.tolist(), strict=True)]
        place = shard if shard >= 0 else shards - 1 - shard
        return pa.table({
            "doc_id": took["doc_id"], "start": pa.array(took["start"].to_numpy() + cut), "length": pa.array(length), "doc_tokens": took["doc_tokens"],
            "ids": pa.array(ids, pa.binary()), "sequence_id": pa.array(place * STRIDE + to), "offset": pa.array(offset),
        }).cast(pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())]))

    # A full piece goes to a shard of its own kind, numbered -1 and below.
    h = F.pmod(F.xxhash64("doc_id", "start", "ids", "salt"), F.lit(shards)).cast("long")
    shard = F.when(F.col("length") == sequence, -1 - h).otherwise(h)
    return pieces(docs, tokenizer, sequence).withColumn("shard", shard).drop("salt").groupBy("shard").applyInArrow(run, PACKED)


def crc32(packed: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 in place of ids."""
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def padding(packed: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """One row: sequences, tokens, padded (tokens of padding; a sequence as long as a power of two isn't padded)."""
    n = F.col("n")
    sizes = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    return sizes.agg(F.count("*").alias("sequences"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(sequence - n)), F.lit(0)).alias("padded"))
