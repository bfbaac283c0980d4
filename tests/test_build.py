"""Bit ranges, rank directories, Z-order ranges, and subtrees from tiles, against plain definitions."""

import itertools
import random

from pyspark.sql import functions as F

from terrashard.functions import bits, tileid
from terrashard.operators import availability, build, tracker


def bit(data, i):
    return i < 8 * len(data) and data[i // 8] >> i % 8 & 1


def test_ranks_and_ranges_of_bits(spark):
    rng = random.Random(2)
    data = [b"", b"\x01", b"\xff" * 70, bytes(rng.randrange(256) for _ in range(64)), bytes(rng.randrange(256) for _ in range(8200)), b"\0" * 300 + b"\x80" + b"\0" * 300]
    asks = [(i, b) for i, d in enumerate(data) for b in {0, 1, 7, 8, 63, 64, 65, 511, 512, 513, 8 * len(d), 8 * len(d) + 9, *(rng.randrange(8 * len(d) + 1) for _ in range(20))}]
    given = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "i int, d binary").select("i", "d", bits.directory(F.col("d")).alias("dir"))
    asked = spark.createDataFrame([(i, b, b + rng.randrange(600)) for i, b in asks], "i int, bit long, end long")
    rows = asked.join(given, "i").select("i", "bit", "end", bits.rank(F.col("d"), F.col("dir"), F.col("bit")).alias("r"), bits.rank_before(F.col("d"), F.col("bit")).alias("s"), bits.any_set(F.col("d"), F.col("bit"), F.col("end")).alias("any"), F.size("dir").alias("n")).collect()
    assert len(rows) == len(asks)
    for r in rows:
        d = data[r.i]
        want = sum(bit(d, k) for k in range(r.bit))
        assert (r.r, r.s, r.any, r.n) == (want, want, any(bit(d, k) for k in range(r.bit, r.end)), -(-len(d) // 64) + 1), r
    children = given.where("i = 3").select(tracker.child_index(bits.bitstream(F.col("d")), F.col("dir"), F.lit(77)).alias("a"), tracker.child_index(bits.constant(True), F.lit(None).cast("array<int>"), F.lit(5)).alias("b"), tracker.child_index(bits.constant(False), F.lit(None).cast("array<int>"), F.lit(5)).alias("c")).first()
    assert (children.a, children.b, children.c) == (sum(bit(data[3], k) for k in range(77)) if bit(data[3], 77) else None, 5, None)


def morton(*c):
    return sum((x >> i & 1) << (i * len(c) + k) for k, x in enumerate(c) for i in range(16))


def test_z_ranges_cover_a_rectangle_and_nothing_else(spark):
    rng = random.Random(1)
    asks = [(level, *(rng.randrange(2**level) for _ in range(4))) for level in (0, 1, 2, 5) for _ in range(12)] + [(30, 5, 5, 5, 5), (4, 0, 0, 15, 15), (4, 3, 3, 2, 9)]
    columns = [F.col(c) for c in ("level", "a", "b", "c", "d")]
    for r in spark.createDataFrame(asks, "level long, a long, b long, c long, d long").select(*columns, tileid.z_ranges(*columns).alias("z")).collect():
        got = sorted(k for s in r.z for k in range(s.start, s.end))
        assert got == sorted(morton(x, y) for x in range(r.a, r.c + 1) for y in range(r.b, r.d + 1))
        assert r.level != 4 or r.a or len(r.z) == 1


def test_a_wide_rectangle_takes_few_ranges(spark):
    import time

    began = time.perf_counter()
    n = spark.range(50).select(F.size(tileid.z_ranges(F.lit(10), F.lit(3), F.lit(5), F.lit(1002), F.lit(1004))).alias("n"), "id").agg(F.max("n")).first()[0]
    assert n < 7000 and time.perf_counter() - began < 30


def subtrees_of(tiles, depth, n):
    """Bits by definition: forest, root to (tiles, contents, children) as sets of bits."""
    out = {}
    root = lambda level, c: (level - level % depth, *(x >> level % depth for x in c))
    for forest, level, *c, content in tiles:
        if level is None or None in c:
            continue
        c = [x & (1 << level) - 1 for x in c]
        r = root(level, c)
        at = out.setdefault((forest, *r), (set(), set(), set()))
        b = (2 ** (n * (level - r[0])) - 1) // (2**n - 1) + morton(*(x - (y << level - r[0]) for x, y in zip(c, r[1:], strict=True)))
        at[0].add(b)
        if content:
            at[1].add(b)
        while r[0]:
            up = (r[0] - depth, *(x >> depth for x in r[1:]))
            out.setdefault((forest, *up), (set(), set(), set()))[2].add(morton(*(x & (1 << depth) - 1 for x in r[1:])))
            r = up
    return out


def test_subtrees_from_tiles(spark):
    rng = random.Random(6)
    for n, depth, most in ((2, 1, 4), (2, 2, 5), (3, 2, 3), (2, 9, 9)):
        axes = "xyz"[:n]
        tiles = [(rng.choice([None, 1, 2]), (level := rng.randrange(most)), *(rng.randrange(-3, 2**level + 5) for _ in axes), rng.choice([True, False, None])) for _ in range(150)]
        tiles += tiles[:20] + [(1, None, *(0 for _ in axes), True), (1, 1, *(None for _ in axes), True), *((5, 0, *(0 for _ in axes), True) for _ in range(50))]
        given = spark.createDataFrame(tiles, f"forest long, level long, {', '.join(f'{a} long' for a in axes)}, content boolean")
        want = subtrees_of([(f, v, *c, k) for f, v, *c, k in tiles], depth, n)
        total, below = (2 ** (n * depth) - 1) // (2**n - 1), 2 ** (n * depth)
        rows = build.subtrees(given, depth, n).collect()
        assert len(rows) == len(want)
        for r in rows:
            got = want[(r.forest, r.level, *(r[a] for a in axes))]
            for view, set_, size in zip((r.tile, r.content_layers[0], r.child), got, (total, total, below), strict=True):
                if view.constant is not None:
                    assert set_ == (set(range(size)) if view.constant else set())
                else:
                    assert len(view.bits) == -(-size // 8) and {k for k in range(8 * len(view.bits)) if bit(view.bits, k)} == set_ and 0 < len(set_) < size


def test_tiles_of_built_subtrees_are_reachable(spark):
    tiles = spark.createDataFrame([(1, 5, 17, 9, True), (1, 0, 0, 0, False), (2, 3, 1, 7, True)], "forest long, level long, x long, y long, content boolean")
    made = build.subtrees(tiles, 2)
    loads = tracker.accept(made.withColumn("ordinal", F.col("level")), 2)
    assert loads.count() == made.count() == 5
    asked = tiles.withColumn("tile_key", F.monotonically_increasing_id())
    got = tracker.flags(asked, loads, 2, 9).collect()
    assert all(r.flags & 16 and r.flags & 1 for r in got) and {bool(r.flags & 2) for r in got if r.content} == {True}
    assert availability.tiles(made, 2).count() == 3


def test_ranks_meet_blocks_not_bitstreams(spark):
    rng = random.Random(5)
    data = [bytes(rng.randrange(256) for _ in range(n)) for n in (1, 63, 64, 65, 1000)] + [b""]
    given = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)] + [(9, None)], "k int, b binary")
    stored = availability.blocks(given, "k", "b")
    assert stored.agg(F.max(F.octet_length("bytes"))).first()[0] == bits.BLOCK and stored.count() == 1 + 1 + 1 + 2 + 16 + 1
    got = availability.ranks(spark.range(9000).select(F.explode(F.array(*map(F.lit, range(11)))).alias("k"), F.col("id").alias("bit")), stored, "k").collect()
    assert len(got) == 9000 * len(data)
    texts = ["".join(str(x >> i & 1) for x in d for i in range(8)) for d in data]
    upto = [[0, *itertools.accumulate(map(int, t))] for t in texts]
    for r in got:
        assert (r["rank"], r.is_set) == (upto[r.k][min(r.bit, len(texts[r.k]))], r.bit < len(texts[r.k]) and texts[r.k][r.bit] == "1"), r


def test_bits_are_counted_in_views(spark):
    views = F.array(bits.constant(True), bits.constant(False), bits.bitstream(F.unhex(F.lit("FF00F0"))), bits.bitstream(F.lit(None).cast("binary")), F.lit(None).cast(bits.VIEW))
    got = spark.range(1).select(F.explode(views).alias("v")).select(bits.count(F.col("v"), 0, 21).alias("a"), bits.count(F.col("v"), 5, 21).alias("b")).collect()
    assert [tuple(r) for r in got] == [(21, 16), (0, 0), (9, 4), (0, 0), (0, 0)]
