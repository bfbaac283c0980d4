"""Quality by the perplexity of an interpolated modified Kneser-Ney bigram model of trusted text.

The vocabulary is the VOCABULARY words at most that trusted text holds most often, twice or more (words of equal count
are in or out together). Any other word is UNKNOWN to the bigrams, and is spelled in addition, by a table of byte pairs made from the
vocabulary. Each document is a sequence of words between two bounds. A bigram is one number, first word and second.

The model grows with the trusted text: its bigrams, with their counts, are a table of shards, whose number follows the
corpus. With discounts D, P(w | h) = (c(hw) - D) / c(h) + gamma(h) P1(w), P1 being the discounted share of w among
continuations. So log P = log gamma(h) + log P1(w) + v(hw), where v = log(1 + (c - D) / (c(h) gamma(h) P1(w))) for a bigram
that was seen and 0 for others. A document's score is a sum over its words, from a table of bounded size that may be
broadcast, and over its bigrams, from the join with the shards of counts. Both sides of that join travel as sorted or
narrow numbers in binary columns, by shard; a task holds one shard, of bounded text on average.

Frequent bigrams make no hot shard: the HEAVY most frequent of trusted text and the HOT most frequent of those that
stand in a fiftieth of some task's documents, trusted or not, are looked up in a bounded table on the spot.

One trusted document in FOLDS, by a hash of its id, is held back from the counts. A language's threshold is a
quantile of the scores of its trusted documents that were held back, so a threshold isn't set by memorised text.

Defined results: null text and text without a word has null perplexity and isn't kept; a language without documents held
back (a null one too) gets the quantile over all that were, or else over all trusted; without any trusted text the
thresholds are null and nothing is kept; rows that repeat a doc_id count and score each; an empty table gives an empty
one. Only doc_id, text and lang are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, settle
from .minhash import folded

UNKNOWN, BOUND = 0, 1
#: Most words with a number, including the two above; a bigram of numbers has 32 bits.
VOCABULARY = 1 << 16
HEAVY, HOT = 1 << 18, 1 << 16
#: A bigram is a candidate for HOT if it stands in this many documents of a block, and in a fiftieth of them.
HOT_DOCS = 50
#: Bytes of text for each shard of counts, and bigrams that a task gathers before it hands them on.
SHARD_BYTES, BLOCK = 32_000_000, 1_500_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 1_000_000
#: Bins of counts to the octave, for finding the frequent ones.
BINS = 32
FOLDS = 10
QUANTILE = 0.995

SHARDS = "shard long, codes binary, counts binary"
QUERIES = "shard long, block long, keys binary, words binary, loss binary, sizes binary, codes binary"
ANSWERS = "block long, keys binary, rows binary, words binary, loss binary"
PARTS = "key long, rows long, words long, loss double"


def packed(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers as planes of bytes, the lowest first: what is alike lies together, and compresses."""
    return np.ascontiguousarray(numbers, kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes()


def unpacked(planes: bytes, kind: str = "<u4") -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).ravel()


def rising(codes: np.ndarray) -> bytes:
    """Sorted codes, as their steps."""
    return packed(np.diff(codes.astype(np.int64), prepend=0))


def risen(planes: bytes) -> np.ndarray:
    return np.cumsum(unpacked(planes), dtype=np.int64)


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    mixed = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return ((mixed * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def bin_of(c: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(c) * BINS).astype(np.int64)


def lowest_bin(bins: list[tuple[int, int]], most: int) -> int:
    """The lowest bin such that it and those above hold no more than `most`; bins are (bin, how many)."""
    low, held = 1 << 30, 0
    for b, n in sorted(bins, reverse=True):
        held += n
        if held > most:
            break
        low = b
    return low


class Numbers(dict):
    """Word to number."""

    def __missing__(self, word: bytes) -> int:
        return UNKNOWN


def grams(words: list[bytes], numbers: dict) -> np.ndarray:
    """One number for each bigram of a document, bounds included; none if it has no word."""
    if not words:
        return np.empty(0, np.int64)
    w = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    return np.concatenate([[BOUND], w]) << 16 | np.concatenate([w, [BOUND]])


def vocabulary(trusted: DataFrame, most: int = VOCABULARY - 2) -> list[bytes]:
    """The most frequent words, in descending order; `most` at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])
        for batch in batches:
            for text in batch.column("text"):
                seen.update(folded(text.as_py()))
                if len(seen) > COUNTED:
                    yield out()
                    seen.clear()
        yield out()

    counts = trusted.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    counts = settle(counts.where("c > 1").withColumn("bin", F.floor(F.log2("c") * BINS).cast("long")), "words")
    low = lowest_bin([(r.bin, r.n) for r in counts.groupBy("bin").agg(F.count("*").alias("n")).collect()], most)
    return [bytes(r.word) for r in sorted(counts.where(F.col("bin") >= low).collect(), key=lambda r: (-r.c, bytes(r.word)))]


def blocks(batches: Iterator[pa.RecordBatch], take) -> Iterator[list]:
    """Lists of take(row)[0], the codes, and its other values, with about BLOCK codes to a list."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            held.append(take(*(x.as_py() for x in row)))
            size += len(held[-1][0]) + 1
            if size > BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def grouped(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value that occurs, and its places in order."""
    order = np.argsort(shard, kind="stable")
    some, first = np.unique(shard[order], return_index=True)
    return zip(some.tolist(), np.split(order, first[1:]) if len(some) else (), strict=True)


def parted(codes: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shards that have codes and, in order, the places of these: no more than there are codes, however many the shards."""
    return grouped(shard_of(codes, shards))


def counted(docs: DataFrame, words: list[bytes], shards: int) -> DataFrame:
    """Counts of the bigrams of rows with `counts`, by shard; in shards -1 and below, documents with a candidate for HOT.

    docs: text, counts (boolean).
    """
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def rows(codes: np.ndarray, counts: np.ndarray, sign: int) -> Iterator[tuple]:
        for s, at in parted(codes, shards):
            yield s if sign > 0 else -1 - s, rising(codes[at]), packed(counts[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers((w, i) for i, w in enumerate(sent.value, 2))
        for held in blocks(batches, lambda text, counts: (grams(folded(text), numbers), counts)):
            mine = [c for c, counts in held if counts]
            out = list(rows(*np.unique(np.concatenate(mine), return_counts=True), 1)) if mine else []
            owner = np.repeat(np.arange(len(held)), [len(c) for c, _ in held])
            once = np.unique(np.concatenate([c for c, _ in held]) << 32 | owner) >> 32
            code, n = np.unique(once, return_counts=True)
            hot = n >= max(HOT_DOCS, len(held) / 50)
            out += rows(code[hot], n[hot], -1)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ((),) * 3, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "codes", "counts"])

    def merge(key: tuple, part: pa.Table) -> pa.Table:
        codes, place = np.unique(np.concatenate([risen(x.as_py()) for x in part["codes"]]), return_inverse=True)
        counts = np.zeros(len(codes), np.int64)
        np.add.at(counts, place, np.concatenate([unpacked(x.as_py()) for x in part["counts"]]))
        return pa.table({"shard": [key[0].as_py()], "codes": pa.array([rising(codes)], pa.binary()), "counts": pa.array([packed(counts, "<u8")], pa.binary())})

    return docs.select("text", "counts").mapInArrow(run, SHARDS).groupBy("shard").applyInArrow(merge, SHARDS)


def sums(counts: DataFrame) -> dict[int, np.ndarray]:
    """Of each word, by number: c(h), bigrams from h seen 1, 2, 3 and 4 times, all bigrams from h, all bigrams to it. Bounded by VOCABULARY.

    Numbers below 0 are bins: -1 - b has how many bigrams are in bin b.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bins = np.zeros((VOCABULARY, 7), np.int64), Counter()
        for batch in batches:
            for x, y in zip(batch.column("codes"), batch.column("counts"), strict=True):
                codes, c = risen(x.as_py()), unpacked(y.as_py(), "<u8").astype(np.int64)
                h, w = codes >> 16, codes & 0xFFFF
                total[:, 0] += np.bincount(h, c, VOCABULARY).astype(np.int64)
                for k in (1, 2, 3, 4):
                    total[:, k] += np.bincount(h[c == k], minlength=VOCABULARY)
                total[:, 5] += np.bincount(h, minlength=VOCABULARY)
                total[:, 6] += np.bincount(w, minlength=VOCABULARY)
                bins.update(dict(zip(*(a.tolist() for a in np.unique(bin_of(c), return_counts=True)), strict=True)))
        seen = np.flatnonzero(total.any(1))
        rows = np.concatenate([total[seen], np.array([[n, 0, 0, 0, 0, 0, 0] for n in bins.values()], np.int64).reshape(-1, 7)])
        yield pa.RecordBatch.from_arrays([pa.array([*seen.tolist(), *(-1 - b for b in bins)], pa.int64()), *(pa.array(rows[:, k]) for k in range(7))], ["id", *(f"s{k}" for k in range(7))])

    added = counts.select("codes", "counts").mapInArrow(run, "id long, " + ", ".join(f"s{k} long" for k in range(7))).groupBy("id").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(7)))
    got = added.toArrow().to_pydict()
    return dict(zip(got["id"], np.array([got[f"s{k}"] for k in range(7)]).T.reshape(-1, 7), strict=True))


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts of what is seen once, twice and more often, from counts of counts 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 for k in (1, 2, 3)]
    return np.array([min(max(d, 0.05), float(k)) for k, d in enumerate(raw, 1)])


@dataclass
class Model:
    """What a task needs besides the shards; its size is bounded by VOCABULARY, HEAVY and HOT."""

    words: list[bytes]
    log_gamma: np.ndarray
    p1: np.ndarray
    spare: np.ndarray  # c(h) gamma(h)
    off: np.ndarray
    spelling: np.ndarray
    known: np.ndarray  # codes of frequent bigrams, and their values
    values: np.ndarray

    def value(self, codes: np.ndarray, c: np.ndarray) -> np.ndarray:
        """v of bigrams seen c times."""
        return np.log1p((c - self.off[np.minimum(c, 3) - 1]) / (self.spare[codes >> 16] * self.p1[codes & 0xFFFF]))


def spelling(words: list[bytes]) -> np.ndarray:
    """Negative log probability of a byte after another in a word (0 stands at both ends), each word once, add-one smoothed."""
    n = np.ones((256, 256))
    if words:
        raw = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
        np.add.at(n, (raw[:-1], raw[1:]), 1)
    return -np.log(n / n.sum(1, keepdims=True))


def picked(counts: DataFrame, low: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams, in order, that are in bin low or above or among codes, and their counts."""
    wanted = counts.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("codes"), batch.column("counts"), strict=True):
                code, c = risen(x.as_py()), unpacked(y.as_py(), "<u8").astype(np.int64)
                some = (bin_of(c) >= low) | np.isin(code, wanted.value)
                yield pa.RecordBatch.from_arrays([pa.array(code[some]), pa.array(c[some])], ["code", "c"])

    got = counts.select("codes", "counts").mapInArrow(run, "code long, c long").toArrow().sort_by("code")
    return got["code"].to_numpy(), got["c"].to_numpy()


def built(counts: DataFrame, words: list[bytes], heavy: int = HEAVY, hot: int = HOT) -> Model:
    """The bounded part of the model, from stored counts."""
    seen, asked = counts.where("shard >= 0"), counts.where("shard < 0")
    found = sums(seen)
    total = np.zeros((VOCABULARY, 7), np.int64)
    for i, row in found.items():
        if i >= 0:
            total[i] = row
    off, size = discounts(total[:, 1:5].sum(0).tolist()), len(words) + 2
    spare = total[:, 1] * off[0] + total[:, 2] * off[1] + (total[:, 5] - total[:, 1] - total[:, 2]) * off[2]
    gamma = np.where(total[:, 0] > 0, spare / np.maximum(total[:, 0], 1), 1.0)
    to = total[:, 6]
    off1 = discounts([int((to == k).sum()) for k in (1, 2, 3, 4)])
    cut = np.where(to > 0, off1[np.clip(to, 1, 3) - 1], 0.0)
    p1 = (to - cut + cut.sum() / size) / to.sum() if to.any() else np.full(VOCABULARY, 1.0 / size)
    bins = lambda rows: [(-1 - b, int(n[0])) for b, n in rows.items() if b < 0]
    common = picked(asked, lowest_bin(bins(sums(asked)), hot), np.empty(0, np.int64))[0]
    code, c = picked(seen, lowest_bin(bins(found), heavy), common)
    model = Model(words, np.log(gamma), p1, spare, off, spelling(words), np.union1d(code, common), np.empty(0))
    model.values = np.zeros(len(model.known))
    model.values[np.searchsorted(model.known, code)] = model.value(code, c)
    return model


def scored(docs: DataFrame, model: Model, counts: DataFrame, shards: int) -> DataFrame:
    """key, rows, words, loss (sum of negative log probabilities) of the texts of docs: key, text. Rows with one key are added up."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        numbers = Numbers((w, i) for i, w in enumerate(m.words, 2))
        log_p1 = np.log(m.p1)

        def take(key: int, text: str | None) -> tuple:
            words = folded(text)
            codes = grams(words, numbers)
            strange = [w for w, c in zip(words, (codes & 0xFFFF).tolist(), strict=False) if c == UNKNOWN]
            if not strange:
                return codes, key, 0.0
            raw = np.frombuffer(b"\0" + b"\0".join(strange) + b"\0", np.uint8)
            return codes, key, float(m.spelling[raw[:-1], raw[1:]].sum())

        for held in blocks(batches, take):
            codes, keys = np.concatenate([x[0] for x in held]), np.array([x[1] for x in held], np.int64)
            length = np.array([len(x[0]) for x in held])
            owner = np.repeat(np.arange(len(held)), length)
            gain = m.log_gamma[codes >> 16] + log_p1[codes & 0xFFFF]
            left = np.ones(len(codes), bool)
            if len(m.known):
                at = np.minimum(np.searchsorted(m.known, codes), len(m.known) - 1)
                left = m.known[at] != codes
                gain += np.where(left, 0, m.values[at])
            loss = np.array([x[2] for x in held]) - np.bincount(owner, gain, len(held))
            home = (keys.view(np.uint64) >> np.uint64(32)).astype(np.int64) * shards >> 32
            codes, owner, out = codes[left], owner[left], []
            asks, none = dict(parted(codes, shards)), np.empty(0, np.int64)
            homes = dict(grouped(home))
            for s in sorted(asks.keys() | homes.keys()):
                mine = asks.get(s, none)
                of = owner[mine]
                here = np.union1d(of, homes.get(s, none))
                is_home = home[here] == s
                sizes = np.bincount(np.searchsorted(here, of), minlength=len(here))
                out.append((s, int(keys[0]), keys[here].tobytes(), packed(np.where(is_home, np.maximum(length[here], 1), 0)), loss[here][is_home].tobytes(), packed(sizes), packed(codes[mine])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), *[pa.binary()] * 5), strict=True)], ["shard", "block", "keys", "words", "loss", "sizes", "codes"])

    def answer(asked: pa.Table, shard: pa.Table) -> pa.Table:
        m, out = sent.value, []
        code, value = np.empty(0, np.int64), np.empty(0)
        for x, y in zip(shard["codes"], shard["counts"], strict=True):  # one row at most
            code = risen(x.as_py())
            value = m.value(code, unpacked(y.as_py(), "<u8").astype(np.int64))
        for row in asked.to_pylist():
            keys, words, sizes, codes = np.frombuffer(row["keys"], np.int64), unpacked(row["words"]), unpacked(row["sizes"]), unpacked(row["codes"]).astype(np.int64)
            loss = np.zeros(len(keys))
            loss[words > 0] = np.frombuffer(row["loss"])
            if len(code):
                at = np.minimum(np.searchsorted(code, codes), len(code) - 1)
                loss -= np.bincount(np.repeat(np.arange(len(keys)), sizes), np.where(code[at] == codes, value[at], 0.0), len(keys))
            some = (words > 0) | (loss != 0)
            out.append((row["block"], keys[some].tobytes(), packed((words > 0)[some]), packed(np.maximum(words[some].astype(np.int64) - 1, 0)), loss[some].tobytes()))
        kinds = (pa.int64(), *[pa.binary()] * 4)
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ((),) * 5, kinds, strict=True)], ["block", "keys", "rows", "words", "loss"])

    def add(answers: pa.Table) -> pa.Table:
        """The answers to a block of documents, from all shards, added up."""
        whole = lambda name, kind=None: np.concatenate([np.frombuffer(x.as_py(), kind) if kind else unpacked(x.as_py()) for x in answers[name]])
        keys, at = np.unique(whole("keys", np.int64), return_inverse=True)
        added = lambda x: np.bincount(at, x, len(keys))
        return pa.table({"key": keys, "rows": added(whole("rows")).astype(np.int64), "words": added(whole("words")).astype(np.int64), "loss": added(whole("loss", np.float64))})

    asked = docs.select("key", "text").mapInArrow(ask, QUERIES)
    parts = asked.groupBy("shard").cogroup(counts.where("shard >= 0").groupBy("shard")).applyInArrow(answer, ANSWERS)
    parts = parts.groupBy("block").applyInArrow(add, PARTS)
    return parts.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("rows", "words", "loss")))


def marked(docs: DataFrame, trusted_ids: DataFrame, folds: int) -> DataFrame:
    """doc_id, lang, text, key, trusted, counts; one row for each row of docs. Broadcast only ids whose number was counted."""
    ids = settle(trusted_ids.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null").distinct(), "trusted")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids.hint("merge")
    slim = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    slim = slim.join(side, slim.doc_id == side["_id"], "left").withColumn("trusted", F.col("_id").isNotNull()).drop("_id")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    return slim.withColumn("counts", F.col("trusted") & (fold > 0)).withColumn("key", F.xxhash64("doc_id", "text"))


def judge(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, folds: int = FOLDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold, kept; trusted_ids is a table of doc_id."""
    given = marked(docs, trusted_ids, folds)
    volume = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("b")).first().b
    shards = int(volume // shard_bytes + 1)
    words = vocabulary(given.where("counts"))
    counts = settle(counted(given, words, shards), "bigrams")
    per_key = scored(given, built(counts, words), counts, shards).withColumnRenamed("words", "n")
    scores = settle(
        given.select("doc_id", "lang", "trusted", "counts", "key").join(per_key, "key", "left")
        .select("doc_id", "lang", "trusted", "counts", (F.col("n") / F.col("rows")).cast("long").alias("n_words"), F.when(F.col("n") > 0, F.col("loss") / (F.col("n") + F.col("rows"))).alias("mean")), "scores",
    )
    return thresholds(scores, quantile)


def thresholds(scores: DataFrame, quantile: float) -> DataFrame:
    known = scores.where("mean is not null and trusted")
    cut: Column = F.percentile_approx("mean", F.lit(quantile), F.lit(10_000)).alias("cut")
    by_lang = settle(known.where("not counts and lang is not null").groupBy("lang").agg(cut), "by_lang")
    side = F.broadcast(by_lang) if by_lang.count() <= BROADCAST_ROWS else by_lang
    held, every = known.agg(F.percentile_approx(F.when(~F.col("counts"), F.col("mean")), F.lit(quantile), F.lit(10_000)), cut).first()
    limit = F.coalesce("cut", F.lit(held).cast("double"), F.lit(every).cast("double"))
    return scores.join(side, "lang", "left").select(
        "doc_id", "lang", "n_words", F.exp("mean").alias("perplexity"), F.exp(limit).alias("threshold"), F.coalesce(F.col("mean") <= limit, F.lit(False)).alias("kept")
    )
