"""Tile algebra, bit views, classification, extensions."""

import random

import pytest
from pyspark.sql import functions as F

from terrashard.functions import bits, classify, extensions, tileid
from terrashard.operators import availability


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def tile(*v):
    return tileid.tile(*map(F.lit, v))


def interleave(*v):
    return sum((x >> i & 1) << (i * len(v) + k) for k, x in enumerate(v) for i in range({2: 16, 3: 10}[len(v)]))


def test_morton(spark):
    rng = random.Random(0)
    data = [tuple(rng.randrange(1 << 20) for _ in range(3)) for _ in range(500)] + [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1)]
    df = spark.createDataFrame(data, "x long, y long, z long")
    for r in df.select("x", "y", "z", tileid.morton(F.col("x"), F.col("y")).alias("m"), tileid.morton(F.col("x"), F.col("y"), F.col("z")).alias("o")).collect():
        assert (r.m, r.o) == (interleave(r.x, r.y), interleave(r.x, r.y, r.z))


def test_sql_functions_agree(spark):
    tileid.register(spark)
    df = spark.range(1000).selectExpr("id * 37 % 65536 x", "id * 91 % 65536 y", "id % 1024 z", "id % 11 l", "id % 4 s")
    t = tileid.tile(F.col("l"), F.col("x"), F.col("y"))
    both = df.select(
        F.expr("morton2(x, y)") == tileid.morton(F.col("x"), F.col("y")), F.expr("morton3(x, y, z)") == tileid.morton(*map(F.col, "xyz")),
        F.expr("subtree_level(l, s)") == tileid.subtree_root(t, F.col("s"))["level"], F.expr("subtree_coordinate(l, x, s)") == tileid.subtree_root(t, F.col("s"))["x"],
        F.expr("tile_prefix(2, l)") == tileid.prefix_for_level(F.lit("quadtree"), F.col("l")),
    )
    assert all(all(r) for r in both.collect())


def test_tile_ids(spark):
    r = one(
        spark, tileid.expand_url(F.lit("subtrees/{level}/{x}/{y}.subtree"), tile(3, 5, 2)), tileid.expand_url(F.lit("subtrees/{level}/{x}/{y}/{z}.subtree"), tile(2, 1, 3, 0), 3),
        tileid.subtree_root(tile(4, 3, 2), 0), tileid.subtree_root(tile(5, 21, 10), 2), tileid.relative_to(tile(3, 1, 2), tile(1, 1, 0)), tileid.children(tile(0, 0, 0)),
        tileid.relative_position(tile(1, 1, 0), tile(0, 0, 0)),
    )
    assert r.c0 == "subtrees/3/5/2.subtree" and r.c1 == "subtrees/2/1/3/0.subtree"
    assert tuple(r.c2) == (4, 3, 2) and tuple(r.c3) == (4, 10, 5)
    assert tuple(r.c4) == (2, (1 - 4) & tileid.MASK, 2)
    assert [tuple(t) for t in r.c5] == [(1, 0, 0), (1, 1, 0), (1, 0, 1), (1, 1, 1)] and tuple(r.c6) == (1, 1)


def test_levels(spark):
    q, o = F.lit("quadtree"), F.lit("octree")
    r = one(spark, *(tileid.prefix_for_level(q, F.lit(k)) for k in (0, 1, 2)), tileid.prefix_for_level(o, F.lit(2)), tileid.tiles_at_level(q, F.lit(31)), tileid.tiles_at_level(q, F.lit(32)), tileid.tiles_at_level(q, F.lit(2**32 - 1)))
    assert tuple(r) == (0, 1, 5, 9, 1 << 62, None, None)


def test_bounding_volumes(spark):
    volume = lambda box, region: F.struct(box.cast("array<double>").alias("box"), region.cast("array<double>").alias("region"), F.array(F.lit(1.0)).alias("sphere"))
    none = F.lit(None)
    region = F.array(*map(F.lit, (0.0, 0.0, 4.0, 8.0, 10.0, 20.0)))
    box = F.array(*map(F.lit, (0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 8.0)))
    r = one(spark, tileid.subdivide_bounding_volume(volume(box, region), tile(1, 1, 0)), tileid.subdivide_bounding_volume(volume(none, region), tile(1, 0, 1, 1), 3), tileid.subdivide_bounding_volume(volume(box, none), tile(1, 1, 0)), tileid.subdivide_bounding_volume(volume(box, none), tile(1, 1, 0, 1), 3), tileid.subdivide_bounding_volume(volume(none, none), tile(1, 0, 0)))
    assert r.c0.region == [2, 0, 4, 4, 10, 20] and r.c0.box is None
    assert r.c1.region == [0, 4, 2, 8, 15, 20]
    assert r.c2.box == [1, -2, 0, 1, 0, 0, 0, 2, 0, 0, 0, 8]
    assert r.c3.box == [1, -2, 4, 1, 0, 0, 0, 2, 0, 0, 0, 4]
    assert tuple(r.c4) == (None, None, None)


def test_bits(spark):
    data = bytes([0b10110101, 0b00000001, 0b11111111])
    want = [data[i // 8] >> i % 8 & 1 if i < 24 else 0 for i in range(30)]
    got = spark.range(30).select("id", bits.is_set(bits.bitstream(F.lit(data)), F.col("id")).alias("b"), bits.rank_before(F.lit(data), F.col("id")).alias("r")).orderBy("id").collect()
    assert [r.b for r in got] == [bool(b) for b in want] and [r.r for r in got] == [sum(want[:i]) for i in range(30)]
    r = one(
        spark, bits.set_bit(bits.bitstream(F.lit(data)), F.lit(9), F.lit(True)), bits.set_bit(bits.bitstream(F.lit(data)), F.lit(0), F.lit(False)), bits.set_bit(bits.bitstream(F.lit(data)), F.lit(24), F.lit(True)),
        bits.set_bit(bits.constant(False), F.lit(0), F.lit(True)), bits.expand_constant(bits.constant(True), F.lit(9)), bits.little_endian(F.lit(b"\x00\xff\xff\xff\xff\xff\xff\xff\xff"), 1, 8), bits.to_little_endian(F.lit(258), 4),
    )
    assert bytes(r.c0.bits) == bytes([data[0], 3, 255]) and bytes(r.c1.bits)[0] == data[0] - 1 and bytes(r.c2.bits) == data
    assert r.c3.constant is False and bytes(r.c4.bits) == b"\xff\xff" and int(r.c5) == 2**64 - 1 and bytes(r.c6) == b"\x02\x01\x00\x00"


def test_availability_of_one_subtree(spark):
    q, o = F.lit("quadtree"), F.lit("octree")
    ask = lambda v, s, level, m: availability.is_available(v, s, F.lit(level), F.lit(m))
    yes, no = bits.constant(True), bits.constant(False)
    two = availability.set_available(availability.set_available(no, q, F.lit(2), F.lit(0), F.lit(0), F.lit(True)), q, F.lit(2), F.lit(1), F.lit(2), F.lit(True))
    child = availability.set_child_available(no, q, F.lit(1), F.lit(3), F.lit(True))
    r = one(
        spark, *(ask(yes, q, k, m) for k, m in ((0, 0), (1, 0), (1, 3))), ask(yes, q, 1, 4), ask(yes, o, 1, 7), ask(no, q, 2**32 - 1, 0), ask(two, q, 0, 0), ask(two, q, 1, 2), ask(two, q, 1, 1),
        availability.is_child_available(child, F.lit(3)), availability.is_child_available(child, F.lit(0)), availability.is_content_available(F.array(yes), F.lit(0), q, F.lit(0), F.lit(0)), availability.is_content_available(F.array(yes), F.lit(1), q, F.lit(0), F.lit(0)),
    )
    assert tuple(r) == (True, True, True, False, True, False, True, True, False, True, False, True, False)


def test_available_tiles_as_rows(spark):
    df = spark.range(1).select(bits.bitstream(F.lit(bytes([0b10011]))).alias("tile"))
    assert sorted((r.rel_level, r.rel_morton) for r in availability.tiles(df, 2).collect()) == [(0, 0), (1, 0), (1, 3)]


@pytest.mark.parametrize(("url", "external"), [
    ("http://h/World.Json", 1), ("x.json#a?b", 1), ("deep/er/.json", 1), ("q.TileSet.GLTF?v=2", 1), ("q.tileset.glb#t", 1), ("json", 0), ("x.json/", 0), ("q.tileset.glb.bin", 0), ("tileset.gltf2", 0), ("q.glb#.json", 0), ("q.pnts?.json", 0), ("", 0),
])
def test_external_tilesets(spark, url, external):
    assert one(spark, classify.is_external_tileset(F.lit(url))).c0 == bool(external)


def test_formats(spark):
    r = one(spark, *(classify.tile_format(F.lit(u), F.lit(d)) for u, d in (("a.b3dm", b"glTF"), ("a.PNTS?x.glb", b"xy"), ("a.json", None), ("a.gltf", b""), ("glb", None), ("a.glb#x", None))), classify.tile_format(F.lit("x/y.cmpt")))
    assert tuple(r) == ("glb", "pnts", "json", "unknown", "glb", "unknown", "cmpt")


def test_flags(spark):
    f = F.lit(classify.TILE | classify.REACHABLE)
    r = one(spark, classify.has_flags(f, classify.TILE), classify.has_flags(f, classify.TILE | classify.LOADED), classify.flag_names(f))
    assert tuple(r) == (True, False, ["tile", "reachable"])


def test_extension_payloads(spark):
    m = F.create_map(F.lit("TEST"), F.parse_json(F.lit('{"n": 11, "more": [1]}')), F.lit("BAD"), F.parse_json(F.lit('{"n": "eleven"}')))
    ddl = "struct<n:bigint>"
    r = one(
        spark, extensions.payload(m, "TEST", ddl, ("n",))["n"], extensions.payload(m, "BAD", ddl, ("n",)), extensions.payload(m, "NONE", ddl), extensions.has(m, "BAD"), extensions.has(extensions.remove(m, "BAD"), "BAD"),
        extensions.payload(extensions.put(m, "TEST", F.parse_json(F.lit('{"n": 7}'))), "TEST", ddl)["n"], F.size(extensions.put(m, "TEST", F.parse_json(F.lit("1")))),
    )
    assert tuple(r) == (11, None, None, True, False, 7, 2)
    with pytest.raises(Exception, match="extension BAD"):
        one(spark, extensions.payload(m, "BAD", ddl, ("n",), strict=True)["n"])


def test_used_and_required(spark):
    none = F.array().cast("array<string>")
    used, required = extensions.mark_required(none, none, "X_clouds")
    r = one(spark, used, required, extensions.unmark_required(required, "X_clouds"), extensions.unmark_used(used, required, "X_clouds")[0], extensions.mark_used(extensions.mark_used(none, "X_rain"), "X_rain"))
    assert tuple(r) == (["X_clouds"], ["X_clouds"], [], [], ["X_rain"])


def test_first_of_equal_keys_stays(spark):
    e = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("b", 1), ("a", 2), ("b", 3), ("", 4), ("a", 5), ("b", 0))))
    assert list(one(spark, extensions.sorted_map(e)).c0.items()) == [("", 4), ("a", 2), ("b", 1)]
    assert one(spark, extensions.sorted_map(F.array().cast("array<struct<key:string,value:int>>"))).c0 == {}


def test_ranges_wider_than_their_level(spark):
    data = [(1, 1, 0, 0, 2**32 - 1, 2**32 - 1), (2, 30, 0, 0, 2**32 - 1, 2**32 - 1), (3, 1, 5, 0, 9, 9), (4, 0, -4, -4, 7, 7), (5, 1, 1, 1, 1, 1), (6, 1, 0, 1, 0, 1)]
    ranges = spark.createDataFrame([(i, 0, *r) for i, *r in data], "range_id long, id int, level long, min_x long, min_y long, max_x long, max_y long")
    stream = spark.range(1).select(F.lit(0).alias("id"), bits.bitstream(F.lit(bytes([0b01001]))).alias("tile"))
    got = {r.range_id: r.any_available for r in availability.any_in_range(stream, ranges).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True}
    every = spark.range(1).select(F.lit(0).alias("id"), bits.constant(True).alias("tile"))
    assert {r.range_id: r.any_available for r in availability.any_in_range(every, ranges).collect()} == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True}


def test_whole_coordinates_and_levels(spark):
    most = 2**32 - 1
    rows = [(0, 0, 0), (1, 2, 4), (most, most, most), (2**31, 2**10, 2**16), (2**20 + 5, 2**21 - 1, 12345)]
    code = lambda c: sum((v >> i & 1) << (i * len(c) + k) for k, v in enumerate(c) for i in range(32))
    got = spark.createDataFrame(rows, "x long, y long, z long").select("x", "y", "z", tileid.morton_wide(F.col("x"), F.col("y")).alias("two"), tileid.morton_wide(F.col("x"), F.col("y"), F.col("z")).alias("three")).collect()
    assert {tuple(r)[:3]: (int(r.two), int(r.three)) for r in got} == {r: (code(r[:2]), code(r)) for r in rows}
    levels = spark.createDataFrame([("octree", 21), ("octree", 22), ("quadtree", 31), ("quadtree", 32), ("quadtree", 0)], "s string, level long")
    got = levels.select(tileid.tiles_at_level_wide(F.col("s"), F.col("level")), tileid.prefix_for_level_wide(F.col("s"), F.col("level"))).collect()
    assert [tuple(r) for r in got] == [(2**63, (2**63 - 1) // 7), (None, None), (2**62, (2**62 - 1) // 3), (None, None), (1, 0)]


def test_rectangles_by_sums_equal_those_by_ranges(spark, monkeypatch):
    rng = random.Random(11)
    views = [(i, None, bytearray(bytes(rng.randrange(256) if rng.random() < share else 0 for _ in range(n)))) for i, (n, share) in enumerate(((1, 0.5), (11, 0.2), (171, 0.05), (700, 0.01), (60, 0.1), (0, 0)))] + [(6, True, None), (7, False, None), (8, None, None), (3, None, bytearray(b"\x01"))]
    subtrees = spark.createDataFrame(views, "id int, c boolean, b binary").select("id", F.struct(F.col("c").alias("constant"), F.col("b").alias("bits")).alias("tile"))
    place = lambda: rng.choice((None, -3, 40, rng.randrange(34), rng.randrange(8)))
    asked = spark.createDataFrame([(i, rng.choice((None, *range(10))), rng.choice((None, -1, 0, 1, 2, 3, 4, 5, 5, 6, 13)), place(), place(), place(), place()) for i in range(1500)], "range_id long, id int, level long, min_x long, min_y long, max_x long, max_y long")
    monkeypatch.setattr(availability, "ASKED", 40)
    want = sorted(map(tuple, availability.any_by_ranges(subtrees, asked).collect()))
    assert len({w[1] for w in want}) == 2 and sorted(map(tuple, availability.any_in_range(subtrees, asked).collect())) == want

    monkeypatch.setattr(availability.tileid, "z_ranges", lambda level, *_: F.when(level <= 12, F.raise_error(F.lit("range by range")).cast("array<struct<start:bigint,end:bigint>>")))
    assert availability.any_in_range(subtrees, asked.where("level <= 12")).collect()


def test_wide_codes_need_no_term_for_each_bit(spark):
    made = spark.range(1).select(tileid.morton_wide(*(F.col("id") + k for k in range(3))).alias("m"))
    assert made._jdf.queryExecution().analyzed().toString().count("shiftright") <= 12
