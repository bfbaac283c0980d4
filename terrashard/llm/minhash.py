"""Near-duplicate classes by a signature-coordinate inverted join.

Every document becomes a signature of K min-hash coordinates over its distinct five-word shingles. Documents are
posted under coordinate-value pairs. Two sets of Jaccard similarity 0.75 agree on Binomial(K, 0.75) coordinates, so a
pair that agrees on fewer than M is no candidate (with K = 64, M = 32 a pair exactly at the threshold is missed with
probability under 1e-5; more similar pairs far more rarely). Two signatures with M common pairs share one among the
K - M + 1 rarest pairs of each, so only that prefix is posted, rarest first; pairs that occur once are skipped
altogether. Of each pair that the postings bring together, the collisions of the whole signatures are counted; those with
M at least are confirmed on the full shingle sets. Texts are fetched for these alone.

No group is expanded into all pairs:

* equal shingle sets collapse into one class first, by a 128-bit set fingerprint (map-side combined);
* each posting list is first compared with one member, its hub, only, which is linear: the one whose coordinate values are the most
  common in all, as that is nearest to most others. What is confirmed merges.
  A hub with many members is copied to slots of SLOT members on average, so no task gets all of them;
* lists that still hold several components go on, joined by their hub. There the members outside its
  component are queries against all members, in blocks of bounded size dealt over tasks. A task first counts the
  collisions of its two blocks' signatures, and names the members (not the pairs) that have a candidate; the texts of
  these are fetched, and a task confirms in descending order, on hashed sets and, where that makes a link, on the full sets, with one link
  for two components. A list of n strays among m members that stay apart does cost n * m comparisons of signatures, in blocks.

Defined results: null or wordless text has no shingles and links with nothing; a text of one to four words is one
shingle; rows that repeat a doc_id with the same text share its class, and each is kept if the id is the class's
smallest; texts that share a doc_id are compared each by itself, and each has its own component; rows with a null doc_id
get a null component of their own class unless another row names it, and aren't kept; an empty table gives an empty one.
Only doc_id and text are read, so further columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep_ids, settle

SHINGLE = 5
K = 64
M = 32
PERCENT = 75
#: Most documents and shingles (but for a single document) that a block holds on average.
BLOCK_DOCS, BLOCK_SHINGLES = 128, 100_000
#: Members of a posting list that share one copy of their hub.
SLOT = 64
#: Rounds in which any graph that fits a cluster has converged; each shortens paths by a factor.
ROUNDS = 200
#: Words whose hash a Python worker remembers.
CACHE = 400_000
ODD = np.uint64(0x9E3779B97F4A7C15)

SIG_SCHEMA = "doc_id long, n_shingles long, fp1 long, fp2 long, sig array<long>"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x reaches every bit of the result."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Hashes(dict):
    """Word to 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def folded(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case. bytes.split() splits at exactly the six ASCII spaces."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], hashes: dict) -> np.ndarray:
    """Distinct shingles of one document, as sorted 64-bit hashes."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(words))
    s = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        s *= ODD
        s += h[j : len(h) - n + 1 + j]
    return np.unique(mix(s + np.uint64(n)))


def permutations(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, (k, 1), dtype=np.uint64), rng.integers(0, 2**63, (k, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, flip: np.ndarray, times: np.ndarray) -> np.ndarray:
    """One token for each coordinate: a hash of the coordinate and its minimum."""
    least = np.full((len(flip), 1), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):  # bounded memory for very long documents
        least = np.minimum(least, ((shingles[None, at : at + 4096] ^ flip) * times).min(1, keepdims=True))
    return mix(least[:, 0] + np.arange(1, len(flip) + 1, dtype=np.uint64) * ODD)


def signatures(docs: DataFrame, k: int = K, seed: int = 11) -> DataFrame:
    flip, times = permutations(k, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            n, one, two, sig = [], [], [], []
            for text in batch.column("text"):
                s = shingle_hashes(folded(text.as_py()), hashes)
                n.append(len(s))
                if len(s):
                    one.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                    two.append(int(np.bitwise_xor.reduce(mix(s ^ ODD)).view(np.int64)))
                    sig.append(signature(s, flip, times).view(np.int64))
                else:
                    one.append(None), two.append(None), sig.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sig, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "fp1", "fp2", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SIG_SCHEMA)


def shingle_set(text: str | None) -> set:
    w = folded(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < SHINGLE else set(zip(*(w[j:] for j in range(SHINGLE)), strict=False))


def linked(a: str | None, b: str | None, percent: int) -> bool:
    """Whether the full shingle sets of two texts are alike enough."""
    x, y = shingle_set(a), shingle_set(b)
    common = len(x & y)
    return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)


SETS = "a long, b long, common long, total long"


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, ta, tb: sizes of the intersection and union of two texts' full shingle sets."""
    last, kept = None, set()
    for batch in batches:
        a, b, ta, tb = (batch.column(c) for c in ("a", "b", "ta", "tb"))
        common, union = [], []
        for i in range(len(a)):
            one = (a[i].as_py(), ta[i].as_py())
            if last != one:
                last, kept = one, shingle_set(one[1])
            other = shingle_set(tb[i].as_py())
            common.append(len(kept & other))
            union.append(len(kept) + len(other) - common[-1])
        yield pa.RecordBatch.from_arrays([a, b, pa.array(common, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "common", "total"])


def with_hub(members: DataFrame, of: DataFrame) -> DataFrame:
    """members (hub, slots, slot, ...) with the columns of `of` (hub, ..., one row each). A hub is copied once for each slot, so a hot one meets its members in many tasks."""
    copies = members.select("hub", "slots").distinct().join(of, "hub").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    return members.join(copies, ["hub", "slots", "slot"])


def components(links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """node, component (the smallest node reachable) of an edge table a, b, by alternating large and small stars.

    Each round is joins and map-side combined minima over the edges; a hub's edges are never collected. Rounds go on
    until nothing changes; RuntimeError if that takes more than `rounds`.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges, before = settle(edges, "edges"), None
    for _ in range(rounds):
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        before = mark
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, settle(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(old)
    raise RuntimeError(f"components haven't converged in {rounds} rounds")


def prefixes(classes: DataFrame, k: int, m: int) -> DataFrame:
    """token, doc_id, weight: the postings of the k - m + 1 rarest coordinate values, without those that occur once. weight: how often all values of the document occur."""
    post = classes.select("doc_id", F.explode("sig").alias("token"))
    often = post.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    shared = post.join(often.hint("merge"), "token").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("c"), F.sum("n").alias("weight"))
    take = F.size("c") - F.lit(m - 1)  # the other k - size(c) come first in the prefix and collide with nothing
    return shared.where(take > 0).select("doc_id", "weight", F.explode(F.slice("c", F.lit(1), take)).alias("c")).select("c.token", "doc_id", "weight")


def links(docs: DataFrame, classes: DataFrame, k: int = K, m: int = M, percent: int = PERCENT) -> DataFrame:
    """a, b: links between class representatives, enough to connect all that are connected."""
    post = settle(prefixes(classes, k, m), "postings")
    # The hub is the member whose values are the most common of all: of copies changed here and there, that which is nearest to what they share.
    hubs = post.groupBy("token").agg(F.max_by("doc_id", F.struct("weight", -F.col("doc_id"))).alias("hub"), F.count("*").alias("n")).where("n > 1")
    slots = F.ceil(F.col("n") / SLOT).cast("int")
    slot = F.struct(slots.alias("slots"), F.pmod(F.xxhash64("doc_id"), slots).cast("int").alias("slot"))
    # Each member of a hub's lists once, in the slots of the shortest list that holds it; so a slot has SLOT members of a list on average, of at most k - m + 1 lists.
    listed = post.join(hubs.hint("merge"), "token").groupBy("hub", "doc_id").agg(F.min(slot).alias("s")).select("hub", "doc_id", "s.slots", "s.slot")
    listed = settle(listed, "listed")
    ids = settle(listed.select("doc_id").distinct(), "ids")
    signed = settle(keep_ids(classes.select("doc_id", "sig"), ids, "doc_id"), "listed_signatures")
    agree = F.size(F.array_intersect("sig_a", "sig_b")) >= m  # a value belongs to its coordinate
    star = with_hub(listed.where("doc_id <> hub").join(signed.withColumnRenamed("sig", "sig_b"), "doc_id"), signed.withColumnsRenamed({"doc_id": "hub", "sig": "sig_a"}))
    star = settle(star.where(agree).select("hub", "slots", "slot", "doc_id"), "star")
    wanted = settle(star.select("doc_id").union(star.select("hub")).distinct(), "wanted")
    texts = settle(keep_ids(docs.select(F.col("doc_id").cast("long"), "text"), wanted, "doc_id"), "texts")
    pairs = with_hub(star.join(texts.withColumnRenamed("text", "tb"), "doc_id"), texts.withColumnsRenamed({"doc_id": "hub", "text": "ta"}))
    sizes = pairs.select(F.col("hub").alias("a"), F.col("doc_id").alias("b"), "ta", "tb").mapInArrow(compare, SETS)
    found = settle(sizes.where(100 * F.col("common") >= percent * F.col("total")).select("a", "b"), "found")
    discard(post, ids, star, wanted, texts)

    joined = settle(components(found), "joined")
    own = listed.join(joined.withColumnsRenamed({"node": "doc_id", "component": "own"}), "doc_id", "left").withColumn("own", F.coalesce("own", "doc_id"))
    of_hub = listed.select("hub").distinct().join(joined.withColumnsRenamed({"node": "hub", "component": "of_hub"}), "hub", "left").select("hub", F.coalesce("of_hub", "hub").alias("of_hub"))
    member = settle(with_hub(own.join(classes.select("doc_id", F.col("n_shingles").alias("n")), "doc_id"), of_hub), "members")
    blocks = lambda n, total: F.ceil(F.greatest(n / BLOCK_DOCS, total / BLOCK_SHINGLES)).cast("int")
    stray = F.col("own") != F.col("of_hub")
    spread = (
        member.groupBy("hub").agg(F.count_if(stray).alias("s"), F.sum(F.when(stray, F.col("n"))).alias("sn"), F.count("*").alias("m"), F.sum("n").alias("mn"))
        .where("s > 0").select("hub", blocks(F.col("s"), F.col("sn")).alias("down"), blocks(F.col("m"), F.col("mn")).alias("across"))
    )
    rows = with_hub(member, spread).join(signed, "doc_id")
    cell = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = rows.withColumns({"i": every("down"), "j": cell("across"), "asks": F.lit(False)}).union(rows.where(stray).withColumn("i", cell("down")).withColumn("j", every("across")).withColumn("asks", F.lit(True)))
    given = "hub long, i long, j long, asks boolean, doc_id long, own long, of_hub long, sig array<long>"
    dealt = dealt.select("hub", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "asks", "doc_id", "own", "of_hub", "sig")
    likely = settle(dealt.groupBy("hub", "i", "j").applyInArrow(candidates(m), given), "likely")
    asked = settle(likely.select("doc_id").distinct(), "asked")
    texts = settle(keep_ids(docs.select(F.col("doc_id").cast("long"), "text"), asked, "doc_id"), "texts")
    crossed = likely.join(texts, "doc_id").select("hub", "i", "j", "asks", "doc_id", "own", "of_hub", "sig", "text").groupBy("hub", "i", "j").applyInArrow(crossing(m, percent), "a long, b long")
    out = settle(found.union(crossed).distinct(), "links")
    discard(listed, signed, found, joined, member, likely, asked, texts)
    return out


def collisions(rows: pa.Table, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of strays and members of one pair of blocks that may be linked and aren't yet in one component, and their collisions, m at least."""
    asks = rows["asks"].to_numpy()
    ids, own, of_hub = (rows[c].to_numpy() for c in ("doc_id", "own", "of_hub"))
    sig = rows["sig"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
    hits = np.zeros((len(x), len(y)), np.uint8 if sig.shape[1] < 256 else np.uint16)
    for k in range(sig.shape[1]):
        hits += sig[x, k][:, None] == sig[y, k][None, :]
    open_ = (own[x][:, None] != own[y][None, :]) & ((own == of_hub)[y][None, :] | (ids[x][:, None] < ids[y][None, :]))
    p, q = np.nonzero((hits >= m) & open_)
    return x[p], y[q], hits[p, q].astype(int)


def candidates(m: int):
    """Of one block of strays against one block of members: the rows that have a candidate."""

    def run(rows: pa.Table) -> pa.Table:
        x, y, _ = collisions(rows, m)
        return rows.take(pa.array(np.union1d(x, y)))

    return run


def crossing(m: int, percent: int):
    """For one block of strays against one block of members: confirmed links between components, one for each pair of components."""

    def run(rows: pa.Table) -> pa.Table:
        x, y, hits = collisions(rows, m)
        ids, own = rows["doc_id"].to_pylist(), rows["own"].to_pylist()
        texts, hashes, sets, out, done = rows["text"], Hashes(), {}, ([], []), set()

        def full(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_hashes(folded(texts[i].as_py()), hashes)
            return sets[i]

        for t in np.argsort(-hits, kind="stable"):
            i, j = int(x[t]), int(y[t])
            pair = (min(own[i], own[j]), max(own[i], own[j]))
            if pair in done:
                continue
            common = len(np.intersect1d(full(i), full(j), assume_unique=True))
            if 100 * common >= percent * (len(full(i)) + len(full(j)) - common) and linked(texts[i].as_py(), texts[j].as_py(), percent):
                done.add(pair)
                out[0].append(min(ids[i], ids[j])), out[1].append(max(ids[i], ids[j]))
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def near_rows(docs: DataFrame, *, k: int = K, m: int = M, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id; one row for each row of docs, a stored table whose doc_id is unique and not null."""
    signed = settle(signatures(docs, k), "signed")
    key = ["fp1", "fp2", "n_shingles"]
    classes = settle(signed.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("doc_id"), F.min_by("sig", "doc_id").alias("sig")), "classes")
    linked = links(docs, classes, k, m, percent)
    found = components(linked)
    named = classes.drop("sig").join(found, F.col("doc_id") == F.col("node"), "left").select(*key, F.coalesce("component", "doc_id").alias("component"))
    out = settle(signed.drop("sig").join(named.hint("merge"), key, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")), "near_rows")
    discard(signed, classes, linked)
    return out


def near_duplicates(docs: DataFrame, *, k: int = K, m: int = M, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row for each row of docs. Rows are numbered and stored, as ids may be null or repeated."""
    rows = settle(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string")), "rows")
    near = near_rows(rows.select(F.col("row").alias("doc_id"), "text"), k=k, m=m, percent=percent).select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("of"))
    near = settle(near.join(rows.select("row", "doc_id"), "row"), "near")
    # Stored, so that the join is of two shuffles and a large component's rows can be dealt over tasks.
    least = settle(near.groupBy("of").agg(F.min("doc_id").alias("component_id")), "least")
    return near.join(least, "of").select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
