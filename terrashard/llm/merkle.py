"""Merkle manifest of a dataset: a leaf for each row, a tree for each source, one over the sources' roots, and a proof for each row.

Leaves of a source ascend by doc_id. While several nodes remain, every FANOUT consecutive ones (the last run may be shorter,
even a single one) become the hash of their joined digests. What remains is the source's subroot; subroots, in the order
of sources, likewise give the root.

Superblock reduction: nodes are numbered within their tree, and a bucket holds the FANOUT ** K nodes under one node K levels up.
One applyInPandas a round collapses each bucket to its root, K levels at once; the buckets' roots are the next round's nodes,
until each tree has one. So a task holds FANOUT ** K digests, whatever a source's share of the rows is, and the rounds are
log(rows) / (K log FANOUT). Proofs come back down the same rounds: a bucket's own proof (the upper part) is grouped with
its nodes, which get the lower part, K levels, in front of it. Digests of a round are stored; proofs aren't, until the last.

Numbers within a tree come from one range partitioning by (tree, doc_id, leaf): a row's place in its partition, less the
place where its tree begins there, plus the rows of its tree in the partitions before. A range splits a source, and rows that are alike
too, so no task gets a whole source.

A proof is a list of levels, each the joined digests left and right of the node in its run: hashing left + node + right, level by
level, gives the root. Digests are lowercase hex text.

Defined results: null members are hashed as `-`; a null doc_id comes first in its source, equal ids go by leaf; rows alike in all
members are leaves of their own, with equal digests and one proof each; a null source is a source of its own, before the others; a
single row is its own root, with an empty proof; an empty table gives an empty one. Only the five members are read, so
further columns can't clash.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, settle

FANOUT = 16
#: Levels that one round collapses.
K = 3
MEMBERS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PROOF = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    """`-` for null, or else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**members: Column) -> Column:
    return F.sha2(F.concat(*(encoded(members[c]) for c in MEMBERS)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf, claim: claim is the leaf of a row as it is found again. Here every row is found as it was written."""
    return claims(docs, F.lit(False))


def claims(docs: DataFrame, tampered: Column) -> DataFrame:
    """leaves(), where the rows that meet a condition are found again with text in lower case (A-Z only)."""
    own = {c: F.col(c) for c in MEMBERS}
    changed = own | {"text": F.translate(F.col("text").cast("string"), CAPITALS, SMALL)}
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-"))  # "-" sorts before "s"
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(**own).alias("digest"), F.when(tampered, leaf(**changed)).alias("other"))


def numbered(nodes: DataFrame, *order: str) -> DataFrame:
    """nodes (tree, ...) with index, from 0 within each tree in the given order, and n, the tree's nodes. Stored."""
    by = [F.col("tree"), *(F.col(c).asc_nulls_first() for c in order)]
    # The last key splits ranges of rows that are alike.
    placed = nodes.withColumn("tie", F.monotonically_increasing_id())
    placed = settle(placed.repartitionByRange(*by, F.col("tie")).sortWithinPartitions(*by, F.col("tie")).withColumn("at", F.monotonically_increasing_id()).drop("tie"), "placed")
    part = F.shiftright("at", 33)
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("c"))
    trees = parts.groupBy("tree").agg(F.sum("c").alias("n"))
    starts = parts.select("tree", "part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift")).join(trees, "tree")
    starts = settle(starts, "starts")
    side = F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts.hint("merge")
    out = placed.withColumn("part", part).join(side, ["tree", "part"]).select(*nodes.columns, (F.col("at") + F.col("shift")).alias("index"), "n")
    out = settle(out, "numbered")
    discard(placed, starts)
    return out


def height(n: int, fanout: int = FANOUT) -> int:
    """Levels above n nodes."""
    h = 0
    while n > 1:
        n, h = -(-n // fanout), h + 1
    return h


def levels_of(digests: list[str], n_levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The nodes of each level, from the given ones up, after n_levels of hashing runs."""
    out = [digests]
    for _ in range(n_levels):
        last = out[-1]
        out.append([sha256("".join(last[i : i + fanout]).encode()).hexdigest() for i in range(0, len(last), fanout)])
    return out


def bucket(fanout: int = FANOUT, k: int = K) -> Column:
    return F.call_function("div", F.col("index"), F.lit(fanout**k)).cast("long")


def collapse(nodes: DataFrame, fanout: int = FANOUT, k: int = K) -> DataFrame:
    """tree, index, n, digest of the nodes k levels up (or at the top of their tree). nodes: tree, index, n, digest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("index")
        n = int(pdf["n"].iloc[0])
        top = levels_of(pdf["digest"].tolist(), min(k, height(n, fanout)), fanout)[-1]
        return pd.DataFrame({"tree": pdf["tree"].iloc[:1], "index": [int(pdf["index"].iloc[0]) // fanout**k], "n": [-(-n // fanout**k)], "digest": top})

    return nodes.select("tree", "index", "n", "digest", bucket(fanout, k).alias("bucket")).groupBy("tree", "bucket").applyInPandas(run, "tree string, index long, n long, digest string")


def rounds(nodes: DataFrame, fanout: int = FANOUT, k: int = K) -> tuple[list[DataFrame], DataFrame]:
    """The stored nodes of each round, those of the trees that have several; and tree, digest of every tree's root."""
    done, tops, most = [], [], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        tops.append(nodes.where("n = 1").select("tree", "digest"))
        if most <= 1:
            break
        done.append(nodes.where("n > 1"))
        nodes, most = settle(collapse(done[-1], fanout, k), "nodes"), -(-most // fanout**k)
    roots = tops[0]
    for other in tops[1:]:
        roots = roots.union(other)
    return done, roots


def descend(nodes: DataFrame, above: DataFrame, kept: list[tuple[str, str]], fanout: int = FANOUT, k: int = K) -> DataFrame:
    """Proofs of nodes (tree, index, n, digest, the kept columns): tree, index, digest, kept, lefts, rights (a text for each level), top.

    above: tree, index (of the bucket), lefts, rights, top. Each bucket meets its one row of above in one task.
    """
    names = [c for c, _ in kept]

    def run(own: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("index")
        n = int(own["n"].iloc[0])
        steps = levels_of(own["digest"].tolist(), min(k, height(n, fanout)), fanout)[:-1]
        high_left, high_right, width = list(up["lefts"].iloc[0]), list(up["rights"].iloc[0]), 64
        runs = [["".join(level[i : i + fanout]) for i in range(0, len(level), fanout)] for level in steps]
        lefts, rights = [], []
        for i in range(len(own)):
            left, right = [], []
            for joined in runs:
                text, at = joined[i // fanout], i % fanout * width
                left.append(text[:at])
                right.append(text[at + width :])
                i //= fanout
            lefts.append(left + high_left)
            rights.append(right + high_right)
        return own[["tree", "index", "digest", *names]].assign(lefts=lefts, rights=rights, top=up["top"].iloc[0])

    schema = ", ".join(f"`{c}` {t}" for c, t in [("tree", "string"), ("index", "long"), ("digest", "string"), *kept, ("lefts", "array<string>"), ("rights", "array<string>"), ("top", "string")])
    held = nodes.select("tree", "index", "n", "digest", *names, bucket(fanout, k).alias("bucket"))
    over = above.select(F.col("tree").alias("up_tree"), F.col("index").alias("up_index"), "lefts", "rights", "top")
    return held.groupBy("tree", "bucket").cogroup(over.groupBy("up_tree", "up_index")).applyInPandas(run, schema)


def prove(done: list[DataFrame], tops: DataFrame, kept: list[tuple[str, str]], fanout: int = FANOUT, k: int = K) -> DataFrame:
    """Proofs of the first round's nodes. tops: tree, lefts, rights, top: the proof of each tree's root in what lies above it."""
    last = tops.withColumn("index", F.lit(0).cast("long"))
    for level in range(len(done) - 1, 0, -1):
        low = done[level]
        # Trees that ended in an earlier round come from tops; the others from the round above.
        here = descend(low, last.join(low.select("tree").distinct(), "tree", "left_semi"), [], fanout, k)
        ended = tops.join(low.select("tree").distinct(), "tree", "left_anti").withColumn("index", F.lit(0).cast("long"))
        last = settle(here.select("tree", "index", "lefts", "rights", "top").unionByName(ended.select("tree", "index", "lefts", "rights", "top")), "proofs")
    return descend(done[0], last.join(done[0].select("tree").distinct(), "tree", "left_semi"), kept, fanout, k)


def manifest(rows: DataFrame, fanout: int = FANOUT, k: int = K) -> DataFrame:
    """doc_id, leaf, other, subroot, root, proof (PROOF), one row for each of rows (tree, doc_id, digest, other: see claims())."""
    placed = numbered(settle(rows, "leaves"), "doc_id", "digest")
    done, subroots = rounds(placed, fanout, k)
    subroots = settle(subroots, "subroots")
    sources = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "name")
    upper, tops = rounds(sources, fanout, k)
    empty = F.array().cast("array<string>")
    above = tops.select("tree", empty.alias("lefts"), empty.alias("rights"), F.col("digest").alias("top"))
    proved = prove(upper, above, [("name", "string")], fanout, k) if upper else sources.join(above, "tree")
    proved = settle(proved.select("name", F.col("digest").alias("subroot"), "lefts", "rights", F.col("top").alias("root")), "source_proofs")
    names = F.to_json(F.struct("subroot", "root"))  # two values travel as one
    held = proved.select(F.col("name").alias("tree"), "lefts", "rights", names.alias("top"))
    kept = [("doc_id", "long"), ("other", "string")]
    below = prove(done, held, kept, fanout, k) if done else None
    single = placed.where("n = 1").join(held, "tree").select("tree", "index", "digest", "doc_id", "other", "lefts", "rights", "top")
    out = single if below is None else below.select(*single.columns).union(single)
    proof = F.arrays_zip(F.col("lefts").alias("left"), F.col("rights").alias("right")).cast(PROOF)
    at = F.from_json("top", "subroot string, root string")
    return out.select("doc_id", F.col("digest").alias("leaf"), "other", at.alias("at"), proof.alias("proof")).select("doc_id", "leaf", "other", "at.subroot", "at.root", "proof")


def folded(node: Column, proof: Column) -> Column:
    """The root that a node and its proof give."""
    return F.aggregate(proof, node, lambda x, step: F.sha2(F.concat(step["left"], x, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof, level by level, left to right, as one text."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")
