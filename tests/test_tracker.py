"""The set-based tracker against a model that walks the tree one subtree at a time."""

import os
import random

import pytest
from pyspark.sql import functions as F

from terrashard.functions import bits, classify
from terrashard.operators import tracker
from terrashard.streaming import loads as arriving

VIEW = "struct<constant:boolean,bits:binary>"


def schema(n, *front):
    return ", ".join([*front, "level long", *(f"{a} long" for a in "xyz"[:n])])


def code(coordinates):
    n = len(coordinates)
    return sum((c >> i & 1) << (i * n + k) for k, c in enumerate(coordinates) for i in range(16))


def bit(view, i):
    if view[0] is not None:
        return view[0]
    return i // 8 < len(view[1]) and bool(view[1][i // 8] >> i % 8 & 1)


class Walk:
    """Loaded subtrees by the path of child steps that leads to them."""

    def __init__(self, depth, most, n):
        self.depth, self.most, self.n, self.held = depth, most, n, {}

    def steps(self, level, at, count):
        at, out = [c & ((1 << level) - 1) for c in at], []
        for k in range(count):
            low = level - (k + 1) * self.depth
            out.append(code([c >> low & ((1 << self.depth) - 1) for c in at]))
        return tuple(out)

    def add(self, level, at, tile, child, content):
        if level % self.depth:
            return False
        path = self.steps(level, at, level // self.depth)
        if path in self.held:
            return False
        for k in range(len(path)):
            if path[:k] not in self.held or not bit(self.held[path[:k]][1], path[k]):
                return False
        self.held[path] = (tile, child, content)
        return True

    def flags(self, level, at):
        if () not in self.held:
            return 5 if level == 0 else 0
        if level > self.most:
            return 0
        path = self.steps(level, at, level // self.depth)
        for k in range(len(path) + 1):
            if path[:k] not in self.held:
                return 5 if level == k * self.depth else 0
            tile, child, content = self.held[path[:k]]
            low = level - k * self.depth
            if low < self.depth:
                i = ((1 << self.n * low) - 1) // ((1 << self.n) - 1) + code([c & ((1 << low) - 1) for c in at])
                return 16 + bit(tile, i) + 2 * bool(content and bit(content[0], i)) + (12 if low == 0 else 0)
            if not bit(child, path[k]):
                return 16
        raise AssertionError


@pytest.mark.parametrize(("n", "depth", "seed"), [(2, 1, 1), (2, 2, 2), (2, 3, 3), (3, 1, 4), (3, 2, 5)])
def test_equals_the_walk(spark, n, depth, seed):
    rng = random.Random(seed)
    view = lambda: (rng.random() < 0.6, None) if rng.random() < 0.3 else (None, bytearray(rng.randrange(256) | rng.randrange(256) for _ in range(rng.choice((1, 2, 1 << max(0, n * depth - 3))))))
    most, loads, tiles, walks = 3 * depth, [], [], {}
    for forest in range(6):
        walks[forest] = Walk(depth, most, n)
        for _ in range(60 if forest else 0):
            level = rng.choice((0, depth, depth, 2 * depth, 3 * depth, 1))
            loads.append((forest, len(loads), level, *(rng.randrange(1 << (level + 1)) for _ in range(n)), view(), view(), [view() for _ in range(rng.choice((0, 1, 2)))]))
    wanted = {x[1] for x in loads if walks[x[0]].add(x[2], x[3 : 3 + n], *x[3 + n :])}
    for key in range(3000):
        level = rng.randrange(most + 3)
        tiles.append((key, rng.randrange(7), level, *(rng.randrange(1 << (level + 1)) for _ in range(n))))
    df = spark.createDataFrame(loads, schema(n, "forest long", "ordinal long") + f", tile {VIEW}, child {VIEW}, content_layers array<{VIEW}>")
    accepted = tracker.accept(df, depth, n)
    assert {r.ordinal for r in accepted.collect()} == wanted
    got = tracker.flags(spark.createDataFrame(tiles, schema(n, "tile_key long", "forest long")), accepted, depth, most, n).collect()
    walks[6] = Walk(depth, most, n)
    assert {r.tile_key: r.flags for r in got} == {t[0]: walks[t[1]].flags(t[2], t[3:]) for t in tiles}
    assert len({r.flags for r in got}) >= 6


def test_by_hand(spark):
    no, yes = bits.constant(False), bits.constant(True)
    root = spark.range(1).select(F.lit(0).alias("forest"), *(F.lit(0).cast("long").alias(c) for c in ("ordinal", "level", "x", "y")), yes.alias("tile"), no.alias("child"), F.array(no).alias("content_layers"))
    tiles = spark.createDataFrame([(0, 0, 0, 0, 0), (1, 0, 1, 0, 0), (2, 0, 1, 1, 1), (3, 0, 2, 0, 0), (4, 0, 3, 0, 0), (5, 1, 0, 9, 9), (6, 1, 1, 0, 0)], schema(2, "tile_key long", "forest long"))
    flags = lambda held, most: {r.tile_key: r.flags for r in tracker.flags(tiles, held, 2, most).collect()}
    assert flags(root, 2) == {0: 16 + 1 + 4 + 8, 1: 17, 2: 17, 3: 16, 4: 0, 5: 5, 6: 0}
    open_ = root.withColumn("child", yes)
    assert flags(open_, 6)[3] == classify.TILE | classify.SUBTREE and flags(open_, 6)[4] == 0
    assert tracker.accept(open_.union(open_.withColumn("ordinal", F.lit(1).cast("long"))), 2).count() == 1


def test_a_stream_accepts_what_one_table_does(spark, tmp_path):
    """Loads arrive in files cut anywhere; a child before its root isn't accepted, and comes again later. Flags are brought up to date after each file."""
    rng, depth = random.Random(8), 2
    columns = schema(2, "forest long", "ordinal long") + f", tile {VIEW}, child {VIEW}, content_layers array<{VIEW}>"
    view = lambda: (None, bytearray(rng.randrange(256) | rng.randrange(256) for _ in range(2)))
    rows = [(i % 3, i, 0 if i in (17, 18, 40) else rng.choice((2, 2, 4, 3)), rng.randrange(16), rng.randrange(16), view(), view(), [view()]) for i in range(240)]
    walks = [Walk(depth, 6, 2) for _ in range(3)]
    wanted = {x[1] for x in rows if walks[x[0]].add(*[x[2], x[3:5]], *x[5:])}
    assert any(x[1] < 17 and x[2] == 2 for x in rows) and any(x[2] == 4 for x in rows if x[1] in wanted)
    tiles = spark.createDataFrame([(k, k % 3, rng.randrange(7), rng.randrange(64), rng.randrange(64)) for k in range(400)], schema(2, "tile_key long", "forest long"))
    source, folder = tmp_path / "in", str(tmp_path / "accepted")
    source.mkdir()
    for k, (low, high) in enumerate([(0, 10), (10, 60), (60, 61), (61, 240)]):
        spark.createDataFrame(rows[low:high], columns).coalesce(1).write.parquet(str(tmp_path / f"cut{k}"))
        file = next((tmp_path / f"cut{k}").glob("*.parquet")).rename(source / f"{k}.parquet")
        os.utime(file, (1_000_000 + k, 1_000_000 + k))
    run = arriving.follow(folder, depth)
    asked = []

    def step(batch, number):
        run(batch, number)
        run(batch, number)  # as after a failure
        asked.append(number)

    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None and asked == [0, 1, 2, 3]
    got = arriving.accepted(spark, folder, columns)
    assert {r.ordinal for r in got.collect()} == wanted
    known = tracker.flags(tiles, got.where("batch = 0"), depth, 6)
    for number in range(1, 4):
        new = got.where(F.col("batch") == number)
        loaded = got.where(F.col("batch") <= number)
        if number == 2:
            assert tracker.touched(tiles, new, depth).count() < 200
        known = tracker.refresh(known, new, loaded, depth, 6)
        assert sorted(known.collect()) == sorted(tracker.flags(tiles, loaded, depth, 6).collect())
    assert {r.tile_key: r.flags for r in known.collect()} == {t.tile_key: walks[t.forest].flags(t.level, (t.x, t.y)) for t in tiles.collect()}
