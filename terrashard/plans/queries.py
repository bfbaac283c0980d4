"""Queries over the driver's tables, which hold no tiles: tiles, subtrees and documents are derived from their columns."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, classify, extensions, tileid
from ..operators import availability, build, errors, registry, tracker, validate
from ..sources import metadata, subtrees, tilesets
from ..storage import settle, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: A subtree of three levels: 21 bits, least significant first.
STREAM = bytes([0xB7, 0x5D, 0x1A])
STREAM_BITS = "".join(str(b >> i & 1) for b in STREAM for i in range(8))
BOX = [1.0, 2.0, 3.0, 4.0, 0.5, 0.25, -0.5, 5.0, 0.125, 0.0, 0.75, 6.0]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as tiles: level 8, x and y below 256, z below 8."""
    li = read(spark, sf_dir, "lineitem")
    xyz = (F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_linenumber").cast("bigint"))
    return li.select("l_orderkey", "l_linenumber", tileid.tile(F.lit(8), *xyz).alias("t"))


def sql_morton(axes: list[str], n_bits: int) -> str:
    n = len(axes)
    return "(" + " + ".join(f"((({c}) >> {i}) & 1) * {1 << (i * n + k)}" for k, c in enumerate(axes) for i in range(n_bits)) + ")::BIGINT"


def sql_stream(bit: str) -> str:
    return f"(substr('{STREAM_BITS}', ({bit})::INTEGER + 1, 1) = '1')"


def sql_hex_bit(h: str, bit: str) -> str:
    """A bit of bytes written in hex, in lower case."""
    return f"(((instr('0123456789abcdef', substr({h}, (2 * (({bit}) // 8) + CASE WHEN ({bit}) % 8 < 4 THEN 2 ELSE 1 END)::INTEGER, 1)) - 1) >> (({bit}) % 4)::INTEGER) & 1)"


LINE = "SELECT l_orderkey, l_linenumber, l_partkey % 256 AS x, l_suppkey % 256 AS y, l_linenumber AS z FROM lineitem"


@query(f"""
WITH t AS ({LINE}), r AS (SELECT x >> 2 AS root_x, y >> 2 AS root_y, {sql_morton(["x & 3", "y & 3"], 2)} AS m FROM t)
SELECT root_x, root_y, count(*)::BIGINT AS tiles, sum(CASE WHEN {sql_stream("5 + m")} THEN 1 ELSE 0 END)::BIGINT AS available FROM r GROUP BY ALL""")
def subtree_census(spark, sf_dir):
    t = line_tiles(spark, sf_dir).select("t", tileid.subtree_root(F.col("t"), 3).alias("root"))
    at = tileid.relative_position(F.col("t"), F.col("root"))
    hit = availability.is_available(bits.bitstream(F.lit(STREAM)), F.lit("quadtree"), at["level"], at["morton"])
    return t.groupBy(F.col("root.x").alias("root_x"), F.col("root.y").alias("root_y")).agg(F.count("*").alias("tiles"), F.count_if(hit).alias("available"))


@query(f"SELECT l_orderkey, l_linenumber, {sql_morton(['x', 'y'], 8)} AS morton FROM ({LINE})")
def morton_2d(spark, sf_dir):
    return line_tiles(spark, sf_dir).select("l_orderkey", "l_linenumber", tileid.morton(F.col("t.x"), F.col("t.y")).alias("morton"))


@query(f"SELECT l_orderkey, l_linenumber, {sql_morton(['x', 'y', 'z'], 8)} AS morton FROM ({LINE})")
def morton_3d(spark, sf_dir):
    return line_tiles(spark, sf_dir).select("l_orderkey", "l_linenumber", tileid.morton(*(F.col(f"t.{a}") for a in "xyz")).alias("morton"))


SCRAMBLED = "SELECT l_orderkey, l_linenumber, (l_orderkey * 2654435761) & 4294967295 AS x, (l_partkey * 2654435769) & 4294967295 AS y, (l_suppkey * 2246822519 + l_linenumber) & 4294967295 AS z FROM lineitem"


def sql_morton_wide(axes: str) -> str:
    return "(" + " + ".join(f"(({c} >> {i}) & 1)::HUGEINT * {1 << (i * len(axes) + k)}::HUGEINT" for k, c in enumerate(axes) for i in range(32)) + ")::VARCHAR"


@query(f"SELECT l_orderkey, l_linenumber, {sql_morton_wide('xy')} AS morton_2d, {sql_morton_wide('xyz')} AS morton_3d FROM ({SCRAMBLED})")
def morton_whole(spark, sf_dir):
    """Morton codes of all 32 bits of coordinates, as text."""
    key = lambda c: F.col(c).cast("bigint")
    x, y, z = (c.bitwiseAND(F.lit(tileid.MASK)) for c in (key("l_orderkey") * 2654435761, key("l_partkey") * 2654435769, key("l_suppkey") * 2246822519 + key("l_linenumber")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tileid.morton_wide(x, y).cast("string").alias("morton_2d"), tileid.morton_wide(x, y, z).cast("string").alias("morton_3d"))


@query("""
SELECT event_id, (level // 3) * 3 AS root_level, user_id >> (level % 3)::INTEGER AS root_x, (event_id % 512) >> (level % 3)::INTEGER AS root_y
FROM (SELECT event_id, user_id, event_id % 12 AS level FROM events)""")
def subtree_root(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    root = tileid.subtree_root(tileid.tile(F.col("event_id") % 12, F.col("user_id"), F.col("event_id") % 512), 3)
    return e.select("event_id", root.alias("r")).select("event_id", F.col("r.level").alias("root_level"), F.col("r.x").alias("root_x"), F.col("r.y").alias("root_y"))


@query(f"""
SELECT event_id, level % 3 AS rel_level, {sql_morton(["user_id & ((1 << (level % 3)::INTEGER) - 1)", "(event_id % 512) & ((1 << (level % 3)::INTEGER) - 1)"], 3)} AS rel_morton
FROM (SELECT event_id, user_id, event_id % 12 AS level FROM events)""")
def relative_position(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", tileid.tile(F.col("event_id") % 12, F.col("user_id"), F.col("event_id") % 512).alias("t"))
    at = tileid.relative_position(F.col("t"), tileid.subtree_root(F.col("t"), 3))
    return e.select("event_id", at.alias("p")).select("event_id", F.col("p.level").alias("rel_level"), F.col("p.morton").alias("rel_morton"))


@query("""
SELECT c_custkey, i AS child, 6 AS level, 2 * x + (i & 1) AS x, 2 * y + ((i >> 1) & 1) AS y, 2 * z + ((i >> 2) & 1) AS z
FROM (SELECT c_custkey, c_custkey % 32 AS x, c_nationkey::BIGINT AS y, (c_custkey * 7) % 32 AS z FROM customer), (SELECT unnest(range(8)) AS i)""")
def children_octree(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    t = tileid.tile(F.lit(5), F.col("c_custkey") % 32, F.col("c_nationkey"), F.col("c_custkey") * 7 % 32)
    return c.select("c_custkey", F.posexplode(tileid.children(t, 3)).alias("child", "t")).select("c_custkey", F.col("child").cast("bigint").alias("child"), F.col("t.level").cast("int").alias("level"), "t.x", "t.y", "t.z")


@query("""
SELECT n_nationkey, i AS child, 4 AS level, 2 * x + (i & 1) AS x, 2 * y + ((i >> 1) & 1) AS y
FROM (SELECT n_nationkey, n_nationkey::BIGINT % 8 AS x, n_regionkey::BIGINT AS y FROM nation), (SELECT unnest(range(4)) AS i)""")
def children_quadtree(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    kids = tileid.children(tileid.tile(F.lit(3), F.col("n_nationkey") % 8, F.col("n_regionkey")))
    return n.select("n_nationkey", F.posexplode(kids).alias("child", "t")).select("n_nationkey", F.col("child").cast("bigint").alias("child"), F.col("t.level").cast("int").alias("level"), "t.x", "t.y")


@query("""
SELECT s, level, CASE WHEN p * level < 63 THEN (1::BIGINT << (p * level)::INTEGER) END AS tiles,
  CASE WHEN p * level < 63 THEN ((1::BIGINT << (p * level)::INTEGER) - 1) // (n - 1) END AS prefix
FROM (VALUES ('quadtree', 4, 2), ('octree', 8, 3), ('s2', 4, 2)) v(s, n, p), (SELECT DISTINCT p_size::BIGINT - 1 AS level FROM part)""")
def level_arithmetic(spark, sf_dir):
    levels = read(spark, sf_dir, "part").select((F.col("p_size").cast("bigint") - 1).alias("level")).distinct()
    rows = levels.select(F.explode(F.array(*map(F.lit, ("quadtree", "octree", "s2")))).alias("s"), "level")
    return rows.select("s", "level", tileid.tiles_at_level(F.col("s"), F.col("level")).alias("tiles"), tileid.prefix_for_level(F.col("s"), F.col("level")).alias("prefix"))


@query("""
SELECT s, level, tiles::VARCHAR AS tiles, ((tiles - 1) // (n - 1))::BIGINT AS prefix FROM (
  SELECT s, n, level, CASE WHEN p * level < 63 THEN (1::BIGINT << (p * level)::INTEGER)::HUGEINT WHEN p * level = 63 THEN 9223372036854775808::HUGEINT END AS tiles
  FROM (VALUES ('quadtree', 4, 2), ('octree', 8, 3), ('s2', 4, 2)) v(s, n, p), (SELECT DISTINCT p_size::BIGINT - 1 AS level FROM part))""")
def level_arithmetic_wide(spark, sf_dir):
    levels = read(spark, sf_dir, "part").select((F.col("p_size").cast("bigint") - 1).alias("level")).distinct()
    rows = levels.select(F.explode(F.array(*map(F.lit, ("quadtree", "octree", "s2")))).alias("s"), "level")
    return rows.select("s", "level", tileid.tiles_at_level_wide(F.col("s"), F.col("level")).cast("string").alias("tiles"), tileid.prefix_for_level_wide(F.col("s"), F.col("level")).alias("prefix"))


@query(f"""
SELECT l_orderkey, l_linenumber, -1.5::DOUBLE + ((0.75 - -1.5)::DOUBLE / 256.0) * x::DOUBLE AS west, -0.5::DOUBLE + ((0.25 - -0.5)::DOUBLE / 256.0) * y::DOUBLE AS south,
  -1.5::DOUBLE + ((0.75 - -1.5)::DOUBLE / 256.0) * (x::DOUBLE + 1.0::DOUBLE) AS east, -0.5::DOUBLE + ((0.25 - -0.5)::DOUBLE / 256.0) * (y::DOUBLE + 1.0::DOUBLE) AS north,
  10.0::DOUBLE + ((90.0 - 10.0)::DOUBLE / 256.0) * z::DOUBLE AS low, 10.0::DOUBLE + ((90.0 - 10.0)::DOUBLE / 256.0) * (z::DOUBLE + 1.0::DOUBLE) AS high
FROM ({LINE})""")
def subdivide_region(spark, sf_dir):
    region = F.array(*map(F.lit, (-1.5, -0.5, 0.75, 0.25, 10.0, 90.0)))
    made = line_tiles(spark, sf_dir).select("l_orderkey", "l_linenumber", tileid.subdivide_region(region, F.col("t"), 3).alias("r"))
    return made.select("l_orderkey", "l_linenumber", *(F.col("r")[i].alias(a) for i, a in enumerate(("west", "south", "east", "north", "low", "high"))))


@query("""
SELECT event_id, 2.0 * x / 64 AS west, -1.0 + 2.0 * y / 64 AS south, 2.0 * (x + 1) / 64 AS east, -1.0 + 2.0 * (y + 1) / 64 AS north, 5.0::DOUBLE AS low, 6.5::DOUBLE AS high, true AS no_box
FROM (SELECT event_id, (user_id % 64)::DOUBLE AS x, (event_id % 64)::DOUBLE AS y FROM events)""")
def subdivide_region_quadtree(spark, sf_dir):
    """A region wins over a box, and a quadtree leaves its heights alone."""
    e = read(spark, sf_dir, "events").select("event_id", tileid.tile(F.lit(6), F.col("user_id") % 64, F.col("event_id") % 64).alias("t"))
    volume = F.struct(F.array(*map(F.lit, BOX)).alias("box"), F.array(*map(F.lit, (0.0, -1.0, 2.0, 1.0, 5.0, 6.5))).alias("region"), F.lit(None).cast("array<double>").alias("sphere"))
    made = e.select("event_id", tileid.subdivide_bounding_volume(volume, F.col("t")).alias("v"))
    return made.select("event_id", *(F.col("v.region")[i].alias(a) for i, a in enumerate(("west", "south", "east", "north", "low", "high"))), F.col("v.box").isNull().alias("no_box"))


def sql_box(n: int) -> str:
    b = [f"{x!r}::DOUBLE" for x in BOX]
    centre, out = [f"{b[i]} - {b[3 + i]} - {b[6 + i]} - {b[9 + i]}" for i in range(3)], []
    for k, a in enumerate("xyz"):
        for i in range(3):
            h = b[3 * (k + 1) + i]
            centre[i] += f" + ({h} * (2.0::DOUBLE / 256.0)) * ({a}::DOUBLE + 0.5)" if k < n else f" + {h}"
            out.append(f"({h} * (2.0::DOUBLE / 256.0)) * 0.5" if k < n else h)
    columns = [*(f"{c} AS c{i}" for i, c in enumerate(centre)), *(f"{h} AS h{i}" for i, h in enumerate(out))]
    return f"SELECT l_orderkey, l_linenumber, {', '.join(columns)} FROM ({LINE})"


def boxes(spark, sf_dir, n):
    made = line_tiles(spark, sf_dir).select("l_orderkey", "l_linenumber", tileid.subdivide_box(F.array(*map(F.lit, BOX)), F.col("t"), n).alias("b"))
    return made.select("l_orderkey", "l_linenumber", *(F.col("b")[i].alias(f"c{i}" if i < 3 else f"h{i - 3}") for i in range(12)))


@query(sql_box(2))
def subdivide_box_quadtree(spark, sf_dir):
    return boxes(spark, sf_dir, 2)


@query(sql_box(3))
def subdivide_box_octree(spark, sf_dir):
    return boxes(spark, sf_dir, 3)


@query("""
SELECT event_id, 'sub/' || (event_id % 12) || '/' || user_id || '/' || (event_id % 512) || '.{z}' AS quad,
  (event_id % 12) || '-' || user_id || '-' || (event_id % 512) || '-' || (event_id % 5) AS oct FROM events""")
def expand_url(spark, sf_dir):
    t = tileid.tile(F.col("event_id") % 12, F.col("user_id"), F.col("event_id") % 512, F.col("event_id") % 5)
    e = read(spark, sf_dir, "events").select("event_id", t.alias("t"))
    return e.select("event_id", tileid.expand_url(F.lit("sub/{level}/{x}/{y}.{z}"), F.col("t")).alias("quad"), tileid.expand_url(F.lit("{level}-{x}-{y}-{z}"), F.col("t"), 3).alias("oct"))


#: Endings of made-up addresses, dealt by order and line number.
ENDINGS = (".glb", ".B3DM?v=1.json", ".json#f", ".tileset.gltf", "/TILESET.JSON?x#y", ".pnts", ".i3dm", ".cmpt", ".gltf", "", ".tileset.glb?q=1", ".bin?name=.json")
SQL_URLS = f"SELECT l_orderkey, l_linenumber, 'http://e.org/a.b/' || l_orderkey || [{', '.join(repr(e) for e in ENDINGS)}][1 + (l_orderkey + l_linenumber) % {len(ENDINGS)}] AS url, (l_orderkey % 9)::INTEGER AS k FROM lineitem"


def line_urls(spark, sf_dir):
    ending = F.get(F.array(*map(F.lit, ENDINGS)), ((F.col("l_orderkey") + F.col("l_linenumber")) % len(ENDINGS)).cast("int"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("http://e.org/a.b/"), F.col("l_orderkey").cast("string"), ending).alias("url"), (F.col("l_orderkey") % 9).alias("k"))


@query(f"""
SELECT l_orderkey, l_linenumber, url, CASE k WHEN 0 THEN 'glb' WHEN 1 THEN 'b3dm' WHEN 2 THEN 'i3dm' WHEN 3 THEN 'cmpt' WHEN 4 THEN 'pnts'
  ELSE CASE WHEN lower(string_split(string_split(url, '?')[1], '.')[-1]) IN ('glb', 'b3dm', 'i3dm', 'cmpt', 'pnts', 'json') THEN lower(string_split(string_split(url, '?')[1], '.')[-1]) ELSE 'unknown' END END AS format
FROM ({SQL_URLS})""")
def tile_format(spark, sf_dir):
    heads = [F.unhex(F.lit(h + "0100")) for h in classify.MAGIC]
    data = F.when(F.col("k") < 5, F.get(F.array(*heads), F.col("k").cast("int"))).when(F.col("k") == 5, F.unhex(F.lit("676C"))).when(F.col("k") == 6, F.unhex(F.lit("7B7D7B7D")))
    return line_urls(spark, sf_dir).select("l_orderkey", "l_linenumber", "url", classify.tile_format(F.col("url"), data).alias("format"))


@query(f"""
SELECT url, regexp_matches(lower(regexp_extract(url, '^[^?#]*')), '(\\.json|\\.tileset\\.gltf|\\.tileset\\.glb)$') AS external FROM ({SQL_URLS})
UNION ALL SELECT url, regexp_matches(lower(regexp_extract(url, '^[^?#]*')), '(\\.json|\\.tileset\\.gltf|\\.tileset\\.glb)$') FROM pages""")
def external_uri(spark, sf_dir):
    urls = line_urls(spark, sf_dir).select("url").union(read(spark, sf_dir, "pages").select("url"))
    return urls.select("url", classify.is_external_tileset(F.col("url")).alias("external"))


@query(f"""
SELECT event_id, {sql_morton(["user_id % 8", "event_id % 8"], 3)} AS morton, event_id % 5 AS level,
  CASE WHEN {sql_morton(["user_id % 8", "event_id % 8"], 3)} >= (1 << (2 * (event_id % 5))::INTEGER) THEN false
    ELSE {sql_stream(f"(((1 << (2 * (event_id % 5))::INTEGER) - 1) // 3) + {sql_morton(['user_id % 8', 'event_id % 8'], 3)}")} END AS available,
  {sql_morton(["user_id % 8", "event_id % 8"], 3)} < (1 << (2 * (event_id % 5))::INTEGER) AS constant_available FROM events""")
def availability_probe(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", tileid.morton(F.col("user_id") % 8, F.col("event_id") % 8).alias("morton"), (F.col("event_id") % 5).alias("level"))
    ask = lambda view: availability.is_available(view, F.lit("s2"), F.col("level"), F.col("morton"))
    return e.select("event_id", "morton", "level", ask(bits.bitstream(F.lit(STREAM))).alias("available"), ask(bits.constant(True)).alias("constant_available"))


@query(f"""
WITH c AS (SELECT c_custkey, c_custkey % 45 AS bit, substr(md5(c_custkey::VARCHAR), 1, 10) AS h FROM customer)
SELECT c_custkey, bit, (SELECT coalesce(sum({sql_hex_bit("h", "k")}), 0) FROM unnest(range(40)) AS u(k) WHERE k < bit)::BIGINT AS rank FROM c""")
def bit_rank(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    data = F.unhex(F.substr(F.md5(F.col("c_custkey").cast("string")), F.lit(1), F.lit(10)))
    bit = F.col("c_custkey") % 45
    return c.select("c_custkey", bit.alias("bit"), bits.rank_before(data, bit).cast("bigint").alias("rank"))


SQL_EDIT = """
WITH e AS (SELECT event_id, event_id % 3 AS level, user_id % (1 << (2 * (event_id % 3))::INTEGER) AS m, event_id % 2 = 0 AS full_, event_id % 5 < 3 AS put, user_id % 16 AS c, event_id % 7 = 0 AS bare FROM events),
i AS (SELECT *, ((1 << (2 * level)::INTEGER) - 1) // 3 + m AS bit FROM e)
"""


@query(f"""{SQL_EDIT}
SELECT event_id, put AS here, CASE WHEN bit = 20 THEN put ELSE full_ END AS last,
  (CASE WHEN put THEN (CASE WHEN full_ THEN 255 ELSE 0 END) | (1 << (bit % 8)::INTEGER) ELSE (CASE WHEN full_ THEN 255 ELSE 0 END) & (255 - (1 << (bit % 8)::INTEGER)) END)::BIGINT AS byte,
  3::BIGINT AS n_bytes, true AS child, c = 15 AS last_child, 2::BIGINT AS child_bytes, NOT bare AS made, CASE WHEN bare THEN NULL ELSE full_ END AS made_available FROM i""")
def availability_edit(spark, sf_dir):
    """Uniform subtrees of three levels in which one tile and one child subtree are changed, and new subtrees, some without a content layer."""
    q, e = F.lit("quadtree"), read(spark, sf_dir, "events")
    level, put = F.col("event_id") % 3, F.col("event_id") % 5 < 3
    morton = F.col("user_id") % tileid.tiles_at_level(q, level)
    yes, no = availability.uniform(True), availability.uniform(False)
    tile = F.when(F.col("event_id") % 2 == 0, yes[0]).otherwise(no[0])
    base = e.select("event_id", "user_id", tile.alias("tile"), yes[1], F.when(F.col("event_id") % 7 == 0, F.array().cast(f"array<{bits.VIEW}>")).otherwise(yes[2]).alias("layers"))
    base = base.select("*", availability.set_available(F.col("tile"), q, F.lit(3), level, morton, put).alias("t"), availability.set_child_available(F.col("child"), q, F.lit(2), F.col("user_id") % 16, F.lit(True)).alias("c"), availability.new(F.col("tile"), F.col("child"), F.col("layers")).alias("n"))
    ask = lambda v, at, m: availability.is_available(v, q, at, m)
    at = F.call_function("div", tileid.prefix_for_level(q, level) + morton, F.lit(8))
    return base.select(
        "event_id", ask(F.col("t"), level, morton).alias("here"), ask(F.col("t"), F.lit(2), F.lit(15)).alias("last"), bits.byte_at(F.col("t.bits"), at).cast("bigint").alias("byte"), F.octet_length("t.bits").cast("bigint").alias("n_bytes"),
        availability.is_child_available(F.col("c"), F.col("user_id") % 16).alias("child"), availability.is_child_available(F.col("c"), F.lit(15)).alias("last_child"), F.octet_length("c.bits").cast("bigint").alias("child_bytes"),
        F.col("n").isNotNull().alias("made"), F.when(F.col("n").isNotNull(), ask(F.col("n.tile"), F.lit(0), F.lit(0))).alias("made_available"),
    )


@query(f"""
WITH r AS (SELECT p_partkey, 2 AS level, p_partkey % 4 AS x0, p_size % 4 AS y0, p_partkey % 4 + p_partkey % 3 - 1 AS x1, p_size % 4 + p_size % 2 AS y1 FROM part),
c AS (SELECT p_partkey, x, y FROM r, unnest(range(x0, x1 + 1)) AS u(x), unnest(range(y0, y1 + 1)) AS v(y)),
h AS (SELECT p_partkey, bool_or(x < 4 AND y < 4 AND {sql_stream("5 + " + sql_morton(["x", "y"], 2))}) AS hit FROM c GROUP BY p_partkey)
SELECT r.p_partkey AS range_id, coalesce(hit, false) AS any_available FROM r LEFT JOIN h USING (p_partkey)""")
def range_any(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("range_id"), F.lit(1).alias("id"), F.lit(2).cast("bigint").alias("level"), (F.col("p_partkey") % 4).alias("min_x"), (F.col("p_size") % 4).cast("bigint").alias("min_y"),
        (F.col("p_partkey") % 4 + F.col("p_partkey") % 3 - 1).alias("max_x"), (F.col("p_size") % 4 + F.col("p_size") % 2).cast("bigint").alias("max_y"),
    )
    one = spark.range(1).select(F.lit(1).alias("id"), bits.bitstream(F.lit(STREAM)).alias("tile"))
    return availability.any_in_range(one, p)


@query(f"""
SELECT p_partkey, bit, list_reduce(list_transform(range(8), lambda i: CASE WHEN i = bit % 8 THEN (p_partkey % 2) << i WHEN {sql_stream("8 * (bit // 8) + i")} THEN 1 << i ELSE 0 END), lambda a, b: a + b)::BIGINT AS new_byte,
  (CASE WHEN bit // 8 = 1 THEN 255 - (1 << (bit % 8)::INTEGER) * (1 - p_partkey % 2) ELSE 255 END)::BIGINT AS expanded_byte
FROM (SELECT p_partkey, (p_partkey * 5) % 24 AS bit FROM part)""")
def set_bits(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 5 % 24).alias("bit"), (F.col("p_partkey") % 2 == 1).alias("on"))
    made = p.select("p_partkey", "bit", bits.set_bit(bits.bitstream(F.lit(STREAM)), F.col("bit"), F.col("on")).alias("v"), bits.set_bit(bits.expand_constant(bits.constant(True), F.lit(21)), F.col("bit"), F.col("on")).alias("w"))
    at = F.call_function("div", F.col("bit"), F.lit(8))
    return made.select("p_partkey", "bit", bits.byte_at(F.col("v.bits"), at).cast("bigint").alias("new_byte"), bits.byte_at(F.col("w.bits"), F.lit(1)).cast("bigint").alias("expanded_byte"))


def world(spark, sf_dir):
    """A document a region: its nations are children of the root, with content, and each nation has two children of its own."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sphere = lambda r: F.struct(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), r).alias("sphere"))
    leaf = lambda i: F.struct(sphere(F.lit(1.0)).alias("boundingVolume"), F.struct(F.concat("n_name", F.lit(f"-{i}.glb")).alias("uri")).alias("content"), F.lit(float(i)).alias("geometricError"))
    nation = F.struct(
        sphere(F.col("n_nationkey") + 0.5).alias("boundingVolume"), F.array(leaf(0), leaf(1)).alias("children"), F.array(*(F.struct(F.concat("n_name", F.lit(x)).alias("uri")) for x in (".b3dm", ".pnts"))).alias("contents"),
        F.col("n_nationkey").cast("double").alias("geometricError"),
    )
    kids = n.groupBy("r_regionkey", "r_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", nation.alias("t")))), lambda c: c["t"]).alias("kids"))
    root = F.struct(sphere(F.lit(1000.0)).alias("boundingVolume"), F.col("kids").alias("children"), F.struct(F.concat("r_name", F.lit(".json")).alias("uri")).alias("content"), F.lit(64.0).alias("geometricError"), F.lit("ADD").alias("refine"), sphere(F.lit(2000.0)).alias("viewerRequestVolume"), F.struct(F.col("r_name").alias("name")).alias("extras"))
    classes = F.struct(F.lit("world").alias("id"), F.struct(F.struct(F.struct(F.struct(F.lit("STRING").alias("type")).alias("name")).alias("properties")).alias("region")).alias("classes"))
    doc = F.struct(
        F.struct(F.lit("1.1").alias("version")).alias("asset"), F.lit(500.0).alias("geometricError"), F.array(F.struct(F.lit("region").alias("class"))).alias("groups"), root.alias("root"), classes.alias("schema"), F.struct(F.lit(1).alias("kept")).alias("extras"),
    )
    return kids.select(F.col("r_regionkey").alias("tileset_id"), F.to_json(doc).alias("json"))


SQL_WORLD = """
n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS ord FROM nation),
t AS (
  SELECT r_regionkey AS tileset_id, '' AS path, 0 AS depth, 64.0::DOUBLE AS geometric_error, 'ADD' AS refine, 1000.0::DOUBLE AS radius, [r_name || '.json'] AS uris FROM region
  UNION ALL SELECT n_regionkey, ord::VARCHAR, 1, n_nationkey::DOUBLE, NULL, n_nationkey + 0.5, [n_name || '.b3dm', n_name || '.pnts'] FROM n
  UNION ALL SELECT n_regionkey, ord || '.' || i, 2, i::DOUBLE, NULL, 1.0, [n_name || '-' || i || '.glb'] FROM n, (SELECT unnest([0, 1]) AS i))"""


def path_text():
    return F.array_join(F.transform("path", lambda i: i.cast("string")), ".")


@query(f"WITH {SQL_WORLD} SELECT tileset_id, path, depth, geometric_error, refine, radius, true AS identity FROM t")
def flatten_tiles(spark, sf_dir):
    _, tiles = tilesets.load(world(spark, sf_dir))
    return tiles.select("tileset_id", path_text().alias("path"), "depth", "geometric_error", "refine", F.col("bounding_volume.sphere")[3].alias("radius"), (F.col("transform") == F.array(*map(F.lit, tilesets.IDENTITY))).alias("identity"))


@query(f"WITH {SQL_WORLD} SELECT tileset_id, path, (i - 1)::INTEGER AS content_ord, uris[i] AS uri FROM t, unnest(range(1, len(uris) + 1)) AS u(i)")
def tile_contents(spark, sf_dir):
    found = tilesets.contents(tilesets.load(world(spark, sf_dir))[1])
    return found.select("tileset_id", path_text().alias("path"), "content_ord", "uri")


@query(f"WITH {SQL_WORLD} SELECT tileset_id, path, 2 * geometric_error AS geometric_error, uris[1] AS uri FROM t")
def update_and_write(spark, sf_dir):
    """Doubles every tile's error, writes the documents, and reads them back."""
    parsed, tiles = tilesets.load(world(spark, sf_dir))
    tiles = tiles.withColumn("geometric_error", F.col("geometric_error") * 2)
    _, again = tilesets.load(tilesets.write(parsed, tiles))
    first = tilesets.field(F.get("contents", F.lit(0)), "uri", "string")
    return again.select("tileset_id", path_text().alias("path"), "geometric_error", first.alias("uri"))


@query("""
WITH c AS (SELECT c_custkey AS id, round(c_acctbal)::DOUBLE AS e, (c_custkey % 5 - 2)::DOUBLE AS r, c_custkey % 3 AS k FROM customer WHERE c_custkey % 11 <> 0)
SELECT id AS tileset_id, 'tileset.negative_geometric_error' AS code, 'geometricError' AS path, 'geometricError is negative (' || e::BIGINT || '); expected >= 0' AS message FROM c WHERE e < 0
UNION ALL SELECT id, 'tile.negative_geometric_error', 'root.geometricError', 'root.geometricError is negative (' || r::BIGINT || '); expected >= 0' FROM c WHERE r < 0
UNION ALL SELECT id, 'tileset.required_extension_not_used', 'extensionsRequired[' || i || ']', 'extensionsRequired contains ''EXT_' || ['a', 'b'][i + 1] || ''' which is not listed in extensionsUsed'
FROM c, (SELECT unnest([0, 1]) AS i) WHERE k = 0 OR (k = 1 AND i = 0)""")
def diagnostics(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    used = F.get(F.array(F.lit("[]"), F.lit('["EXT_b"]'), F.lit('["EXT_a","EXT_b"]')), (F.col("c_custkey") % 3).cast("int"))
    version = F.when(F.col("c_custkey") % 11 == 0, "").otherwise("1.1")
    text = F.concat(
        F.lit('{"asset":{"version":"'), version, F.lit('"},"geometricError":'), F.round("c_acctbal").cast("bigint").cast("string"), F.lit(',"extensionsRequired":["EXT_a","EXT_b"],"extensionsUsed":'), used,
        F.lit(',"root":{"boundingVolume":{"sphere":[0,0,0,1]},"geometricError":'), (F.col("c_custkey") % 5 - 2).cast("string"), F.lit("}}"),
    )
    return validate.diagnostics(tilesets.parse(c.select(F.col("c_custkey").alias("tileset_id"), text.alias("json")))).drop("row", "ord")


#: Documents, the member that is wrong in each (an empty text: none; no JSON where it is None), and the text that stands where the error lies.
WRONG = (
    ("not json", None, "not"), ('{"asset":{"version":""},TAIL', "", None), ('{"asset":{},TAIL', "asset.version", "{},"), ('{"asset":{"version":"1.0"},"extensionsUsed":null,TAIL', "", None), ('{"asset":{"version":"1.0"},"geometricError":"12","root":ROOT}', "geometricError", '"12"'),
    ('{"asset":{"version":1.1},TAIL', "asset.version", "1.1"), ('{"asset":{"version":"1.0"},"extensionsUsed":"abc",TAIL', "extensionsUsed", '"abc"'),
    ('{"asset":{"version":"1.0"},"geometricError":1,"root":{"boundingVolume":{},"geometricError":2,"children":[ROOT,{"boundingVolume":{},"geometricError":1,"children":[{"geometricError":1}]}]}}', "root.children.1.children.0.boundingVolume", '{"geometricError":1}]'),
    ('{"asset":{"version":"1.0"},"geometricError":1,"root":{"boundingVolume":{},"geometricError":1,"refine":"BOGUS"}}', "root.refine", '"BOGUS"'), ('{"asset":{"version":"1.0"},"geometricError":1,"root":{"boundingVolume":{"box":[0]},"geometricError":1}}', "root.boundingVolume.box", "[0]"),
    ('{"asset":{"version":"1.0"},"geometricError":1,"root":{"boundingVolume":{},"geometricError":1,"contents":[{"uri":"a"},{"uri":"b","group":1.0}]}}', "root.contents.1.group", "1.0}]"),
    ('{"asset":{"version":"1.0"},"schema":{"id":"s","classes":{"c":{"properties":{"p":{"required":"yes"}}}}},TAIL', "schema.classes.c.properties.p.required", '"yes"'), ('{"asset":{"version":"1.0"},"extensions":null,TAIL', "extensions", "null"),
    ('{"asset":{"version":"1.0"},TAIL}', None, "}END"), ('{"asset":{"version":"1.0"},TAIL,', None, ",END"), ('{"asset":{"version":"1.0"},"geometricError":01,"root":ROOT}', None, "01"), ('{"asset":{"version":"1.0"},"geometricError":1,"root":[ROOT}', None, '}END'),
    ('{"asset":{"version":"1.0"},"geometricError":1,"root":ROOT', None, "END"),
)


def placed(text: str, path: str | None, needle: str | None) -> tuple:
    """A document over two lines, and where its error lies."""
    whole = text.replace("TAIL", '"geometricError":1,"root":ROOT}').replace("ROOT", '{"boundingVolume":{"sphere":[0,0,0,1]},"geometricError":1}').replace('"version":"1.0"},', '"version":"1.0"},\n') + "END"
    at = None if needle is None else whole.index(needle)
    return whole[:-3], path, at and whole[:at].count("\n") + 1, at and at - whole.rfind("\n", 0, at)


WRONG = tuple(placed(*w) for w in WRONG)
WRONG = tuple((t, p, 1, 1) if t == "not json" else (t, p, line, column) for t, p, line, column in WRONG)


@query(f"""
SELECT id AS tileset_id, CASE WHEN path IS NULL OR path <> '' THEN 'json' WHEN k = 1 THEN 'parse' END AS error_code,
  CASE WHEN path IS NULL THEN 'failed to parse ' || id || ': no JSON' WHEN path <> '' THEN 'failed to parse ' || id || ': missing or of a wrong type: ' || path
    WHEN k = 1 THEN 'failed to parse <tileset>: asset.version is required and must not be empty' END AS error_detail,
  CASE k WHEN 1 THEN '' WHEN 3 THEN '1.0' END AS version, [{", ".join(str(w[2] or "NULL") for w in WRONG)}][1 + k] AS error_line, [{", ".join(str(w[3] or "NULL") for w in WRONG)}][1 + k] AS error_column
FROM (SELECT c_custkey AS id, c_custkey % {len(WRONG)} AS k, [{", ".join("NULL" if w[1] is None else f"'{w[1]}'" for w in WRONG)}][1 + c_custkey % {len(WRONG)}] AS path FROM customer)""")
def parse_errors(spark, sf_dir):
    """What is wrong in documents, and in which line and column."""
    text = F.get(F.array(*(F.lit(w[0]) for w in WRONG)), (F.col("c_custkey") % len(WRONG)).cast("int"))
    given = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tileset_id"), text.alias("json"))
    return tilesets.parse(given, positions=True).select("tileset_id", "error_code", "error_detail", "version", "error_line", "error_column")


#: A document that repeats keys; K is a number of the row. Sorted maps keep the first, other maps and free values the last.
TWICE = (
    '{"asset":{"version":"1.1"},"extensions":{"E":1,"E":K},"extras":{"x":1,"y":[{"z":0,"z":K}],"x":2},"geometricError":K,"metadata":{"class":"c","properties":{"p":K,"q":1,"p":0}},'
    '"properties":{"h":{"maximum":K,"minimum":0},"h":{"maximum":0,"minimum":0},"g":{"maximum":1,"minimum":1}},"root":{"boundingVolume":{"sphere":[0,0,0,1]},"geometricError":1},"schema":{"id":"s","classes":{"c":{"name":"K"},"c":{}}}}'
)


@query("""
SELECT s_suppkey AS tileset_id, CASE WHEN s_suppkey % 3 = 0 THEN 'failed to parse ' || s_suppkey || ': repeated: root.geometricError' END AS error_detail, CASE WHEN s_suppkey % 3 = 0 THEN 2 END AS error_line, CASE WHEN s_suppkey % 3 = 0 THEN 3 END AS error_column,
  CASE WHEN s_suppkey % 3 <> 0 THEN '{"E":' || s_suppkey || '}' END AS extensions, CASE WHEN s_suppkey % 3 <> 0 THEN '{"x":2,"y":[{"z":' || s_suppkey || '}]}' END AS extras,
  CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey END AS p, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey END AS maximum, CASE WHEN s_suppkey % 3 <> 0 THEN 2::BIGINT END AS n_properties, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey::VARCHAR END AS class_name FROM supplier""")
def repeated_keys(spark, sf_dir):
    """Maps that repeat a key are read, named members that are repeated are errors."""
    k = F.col("s_suppkey").cast("string")
    text = F.replace(F.lit(TWICE), F.lit("K"), k)
    text = F.when(F.col("s_suppkey") % 3 == 0, F.replace(text, F.lit('"geometricError":1}'), F.lit('"geometricError":1,\n  "geometricError":1}'))).otherwise(text)
    parsed = tilesets.parse(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tileset_id"), text.alias("json")), positions=True)
    of = lambda path, ddl: tilesets.field(F.col("doc"), path, ddl)
    return parsed.select(
        "tileset_id", "error_detail", "error_line", "error_column", F.to_json(of("extensions", "variant")).alias("extensions"), F.to_json(of("extras", "variant")).alias("extras"), of("metadata.properties.p", "bigint").alias("p"),
        of("properties.h.maximum", "bigint").alias("maximum"), F.when(F.col("doc").isNotNull(), F.size(metadata.entries(F.col("doc"), "properties"))).cast("bigint").alias("n_properties"), of("schema.classes.c.name", "string").alias("class_name"),
    )


def order_documents(spark, sf_dir):
    """A document for each order, its lines being tiles below the root. Ids are repeated or null, and every seventh document has a wrong line."""
    # A line of few bytes becomes a tile of many, so tasks follow the number of lines.
    li = spread(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", share=1 << 18)
    wrong = F.when((F.col("l_orderkey") % 7 == 3) & (F.col("l_linenumber") == 1), F.lit("NEVER")).otherwise("ADD")
    volume = F.struct(F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0))).alias("sphere"))
    # Lines of an order are told by number and quantity; what their tiles hold besides needn't be sorted.
    line = lambda x: F.struct(volume.alias("boundingVolume"), F.struct(F.concat_ws("-", "l_orderkey", x["n"]).alias("uri")).alias("content"), x["q"].alias("geometricError"), x["refine"].alias("refine"))
    of = F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("double").alias("q"), wrong.alias("refine"))
    lines = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(of)).alias("lines")).select("l_orderkey", F.transform("lines", line).alias("children"))
    made = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    root = F.struct(volume.alias("boundingVolume"), F.col("children"), F.struct(F.concat("o_orderkey", F.lit("")).alias("uri")).alias("content"), F.lit(9.0).alias("geometricError"))
    doc = F.struct(F.struct(F.col("o_orderkey").cast("string").alias("version")).alias("asset"), F.lit(10.0).alias("geometricError"), root.alias("root"))
    return made.select(F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey") % 50).alias("tileset_id"), F.to_json(doc).alias("json"))


SQL_ORDERS = """
o AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey % 50 END AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity::DOUBLE AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS i, bool_or(l_linenumber = 1 AND l_orderkey % 7 = 3) OVER (PARTITION BY l_orderkey) AS wrong FROM lineitem),
w AS (SELECT k, bool_or(wrong) AS wrong FROM l GROUP BY k)"""


@query(f"""
WITH {SQL_ORDERS}
SELECT id AS tileset_id, CASE WHEN wrong THEN 'failed to parse ' || coalesce(id::VARCHAR, '') || ': missing or of a wrong type: root.children.0.refine' END AS error_detail, CASE WHEN NOT wrong THEN k::VARCHAR END AS version FROM o JOIN w USING (k)""")
def order_verdicts(spark, sf_dir):
    """Each document has its own verdict, though ids are shared and null."""
    return tilesets.parse(order_documents(spark, sf_dir)).select("tileset_id", "error_detail", "version")


@query(f"""
WITH {SQL_ORDERS}
SELECT id AS tileset_id, k::VARCHAR AS uri, '' AS path, 9.0::DOUBLE AS geometric_error FROM o JOIN w USING (k) WHERE NOT wrong
UNION ALL SELECT id, k || '-' || n, i::VARCHAR, q FROM o JOIN w USING (k) JOIN l USING (k) WHERE NOT w.wrong""")
def order_tiles_flat(spark, sf_dir):
    _, tiles = tilesets.load(order_documents(spark, sf_dir))
    return tiles.select("tileset_id", tilesets.field(F.get("contents", F.lit(0)), "uri", "string").alias("uri"), path_text().alias("path"), "geometric_error")


@query(f"""
WITH {SQL_ORDERS}
SELECT id AS tileset_id, k::VARCHAR AS version, count(*)::BIGINT AS lines, sum(q + 1) AS errors, max(k || '-' || n) AS last_uri FROM o JOIN w USING (k) JOIN l USING (k) WHERE NOT w.wrong GROUP BY id, k""")
def order_documents_again(spark, sf_dir):
    """Every tile's error is raised by one, the documents are written, and read back: a row for each, with its own lines."""
    parsed, tiles = tilesets.load(order_documents(spark, sf_dir))
    again = tilesets.write(parsed, tiles.withColumn("geometric_error", F.col("geometric_error") + 1)).select("tileset_id", F.parse_json("json").alias("doc"))
    lines = tilesets.field(F.col("doc"), "root.children", "array<struct<geometricError:double,content:struct<uri:string>>>")
    again = again.select("tileset_id", tilesets.field(F.col("doc"), "asset.version", "string").alias("version"), lines.alias("lines"))
    total = F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["geometricError"])
    return again.select("tileset_id", "version", F.size("lines").cast("bigint").alias("lines"), total.alias("errors"), F.array_max(F.col("lines.content.uri")).alias("last_uri"))


@query(f"""
WITH {SQL_ORDERS}
SELECT id AS tileset_id, k::VARCHAR AS uri, '' AS path, 9.0::DOUBLE AS geometric_error FROM o JOIN w USING (k) WHERE NOT wrong
UNION ALL SELECT id, k || '-' || n, i::VARCHAR, q FROM o JOIN w USING (k) JOIN l USING (k) WHERE NOT w.wrong""")
def order_tiles_cut(spark, sf_dir):
    """The same tiles; those of the longer documents are cut from chunks by their structure, as large documents are."""
    _, tiles = tilesets.load(order_documents(spark, sf_dir), large=1000)
    return tiles.select("tileset_id", tilesets.field(F.get("contents", F.lit(0)), "uri", "string").alias("uri"), path_text().alias("path"), "geometric_error")


#: A document with every member, in the order of their names; K is a number of the row.
FULL = (
    '{"asset":{"extras":K,"tilesetVersion":"vK","version":"1.1"},"extensions":{"D":{"k":K}},"extensionsRequired":["T"],"extensionsUsed":["I","T"],"extras":{"x":[K]},"geometricError":K.5,"groups":[{"extras":"gK"}],"metadata":{"class":"c","properties":{"p":K}},'
    '"properties":{"h":{"maximum":K,"minimum":-1}},"root":{"boundingVolume":{"extensions":{"V":K},"extras":1,"sphere":[0,0,0,K]},"children":[{"boundingVolume":{"region":[0,0,1,1,0,K]},"contents":[{"uri":"only-K.glb"}],"geometricError":K,ONES},'
    '{"boundingVolume":{"box":[0,0,0,1,0,0,0,1,0,0,0,1]},"content":{"boundingVolume":{"sphere":[1,2,3,K]},"extensions":{"C":K},"extras":"e","group":0,"metadata":{"class":"c"},"uri":"first-K.glb"},"contents":[{"uri":"second-K.glb"}],"extensions":{"T":{}},"geometricError":0,'
    '"implicitTiling":{"availableLevels":K,"extensions":{"I":1},"extras":[1],"subdivisionScheme":"Quadtree","subtreeLevels":2,"subtrees":{"extensions":{"S":2},"extras":3,"uri":"{level}-K.subtree"}},ONES}],'
    '"content":{"uri":"K.json"},"extras":{"name":"K"},"geometricError":K,"metadata":{"class":"c"},"refine":"REPLACE","transform":[1,0,0,0,0,1,0,0,0,0,1,0,K,0,0,1],"viewerRequestVolume":{"box":[0,0,0,K,0,0,0,1,0,0,0,1],"extras":null}},'
    '"schema":{"classes":{"c":{"properties":{"p":{"type":"SCALAR"}}}},"id":"sK"},"statistics":{"classes":{"c":{"count":K}}}}'
)


@query(f"""
SELECT s_suppkey AS tileset_id, replace(replace('{FULL}', 'ONES', '"transform":[1,0,0,0,0,1,0,0,0,0,1,0,0,0,0,1]'), 'K', s_suppkey::VARCHAR) AS written, 3::BIGINT AS tiles FROM supplier""")
def tileset_round_trip(spark, sf_dir):
    """Writes documents with every member, and compares the whole of each (keys in the order of their names)."""
    text = F.replace(F.replace(F.lit(FULL), F.lit(",ONES"), F.lit("")), F.lit("K"), F.col("s_suppkey").cast("string"))
    parsed, tiles = tilesets.load(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tileset_id"), text.alias("json")))
    n = tiles.groupBy("tileset_id").agg(F.count("*").alias("tiles"))
    return tilesets.write(parsed, tiles).join(n, "tileset_id").select("tileset_id", F.to_json(F.parse_json("json")).alias("written"), "tiles")


@query("""
SELECT p_partkey, '{' || chr(10) || '  "name": "' || p_name || '",' || chr(10) || '  "sizes": [' || chr(10) || '    ' || p_size || ',' || chr(10) || '    null' || chr(10) || '  ],' || chr(10) || '  "a": {},' || chr(10)
  || '  "b": [' || chr(10) || '    1e400,' || chr(10) || '    1E5,' || chr(10) || '    -0.0,' || chr(10) || '    1.50' || chr(10) || '  ],' || chr(10) || '  "c": [' || chr(10) || '    []' || chr(10) || '  ],' || chr(10)
  || '  "a": "x, {\\"y\\": [1]}"' || chr(10) || '}' AS pretty FROM part""")
def pretty_json(spark, sf_dir):
    text = F.concat(F.lit('{"name":"'), "p_name", F.lit('","sizes":['), F.col("p_size").cast("string"), F.lit(',null],"a":{ },"b":[1e400, 1E5,-0.0,1.50],"c":[[]], "a":"x, {\\"y\\": [1]}"}'))
    return tilesets.pretty(read(spark, sf_dir, "part").select("p_partkey", text.alias("pretty")), "pretty")


@query("""
SELECT event_id, true AS had, false AS has_after, (props::JSON->>'k')::BIGINT AS k, CASE WHEN event_id % 2 = 0 THEN (props::JSON->>'k')::BIGINT END AS needed, 1::BIGINT AS n_after FROM events""")
def extension_payload(spark, sf_dir):
    v = F.parse_json("props")
    other = F.parse_json(F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.lit('{"other": [1]}')))
    e = read(spark, sf_dir, "events").select("event_id", extensions.put(F.create_map(F.lit("B"), other), "A", v).alias("m"))
    read_k = lambda name: extensions.payload(F.col("m"), name, "struct<k:bigint>", ("k",))["k"]
    gone = extensions.remove(F.col("m"), "A")
    return e.select("event_id", extensions.has(F.col("m"), "A").alias("had"), extensions.has(gone, "A").alias("has_after"), read_k("A").alias("k"), read_k("B").alias("needed"), F.size(gone).cast("bigint").alias("n_after"))


@query("""
WITH p AS (SELECT p_partkey, 'X' || p_size % 3 AS a FROM part)
SELECT p_partkey, CASE WHEN a = 'X1' THEN 'X1,Y' ELSE a || ',Y,X1' END AS used, 'X1' AS required, CASE WHEN a = 'X1' THEN 'Y' ELSE a || ',Y' END AS used_after, '' AS required_after, true AS is_used, '' AS required_gone FROM p""")
def extension_bookkeeping(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.array(F.concat(F.lit("X"), (F.col("p_size") % 3).cast("string")), F.lit("Y")).alias("used"), F.array().cast("array<string>").alias("required"))
    p = p.withColumns(dict(zip(("used", "required"), extensions.mark_required(F.col("used"), F.col("required"), "X1"), strict=True)))
    after = extensions.unmark_used(F.col("used"), F.col("required"), "X1")
    text = lambda a: F.array_join(a, ",")
    return p.select("p_partkey", text("used").alias("used"), text("required").alias("required"), text(after[0]).alias("used_after"), text(after[1]).alias("required_after"), F.array_contains("used", "X1").alias("is_used"), text(extensions.unmark_required(F.col("required"), "X1")).alias("required_gone"))


@query("""
SELECT o_orderkey, string_agg(k || '=' || v, ',' ORDER BY k) AS entries FROM (
  SELECT l_orderkey AS o_orderkey, l_returnflag || l_linestatus AS k, l_linenumber AS v FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag || l_linestatus ORDER BY l_linenumber) = 1) GROUP BY o_orderkey""")
def sorted_map(spark, sf_dir):
    entry = F.struct(F.col("l_linenumber").alias("n"), F.concat("l_returnflag", "l_linestatus").alias("key"), F.col("l_linenumber").alias("value"))
    li = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    m = extensions.sorted_map(F.transform("e", lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    return li.select("o_orderkey", F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("entries"))


#: Kinds of values that events are made into, in turn.
KINDS = 7


@query(f"""
WITH e AS (SELECT event_id, event_id % {KINDS} AS k FROM events)
SELECT event_id, ['reference', 'boolean', 'integer', 'number', 'array', NULL, NULL][1 + k] AS feature, ['offset', NULL, 'number', 'number', NULL, NULL, NULL][1 + k] AS global_number,
  [NULL, 'boolean', NULL, NULL, NULL, 'expression', NULL][1 + k] AS show_expression, ['conditions', 'expression', NULL, NULL, NULL, 'expression', 'conditions'][1 + k] AS style FROM e""")
def tagged_unions(spark, sf_dir):
    """Values of events, written as references, booleans, integers, numbers, arrays, expressions and conditions."""
    e = read(spark, sf_dir, "events")
    user, half = F.col("user_id").cast("string"), F.concat(F.col("user_id").cast("string"), F.lit(".25"))
    texts = (
        F.concat(F.lit('{"byteOffset": '), user, F.lit(', "componentType": "FLOAT", "type": "VEC3"}')), F.when(F.col("user_id") % 2 == 0, "true").otherwise("false"), user, half, F.concat(F.lit("["), user, F.lit(","), half, F.lit("]")),
        F.concat(F.lit('"${'), "event_type", F.lit('} > 1"')), F.concat(F.lit('{"conditions": [["'), "event_type", F.lit('", "true"]]}')),
    )
    v = F.parse_json(F.get(F.array(*texts), (F.col("event_id") % KINDS).cast("int")))
    kind = lambda name, a: extensions.union_kind(F.col("v"), a).alias(name)
    return e.select("event_id", v.alias("v")).select(
        "event_id", kind("feature", extensions.FEATURE_PROPERTY), kind("global_number", extensions.GLOBAL_NUMBER), kind("show_expression", extensions.BOOLEAN_EXPRESSION), kind("style", extensions.STYLE)
    )


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN 'unsupported_implicit_subdivision' END AS error_code, CASE WHEN p_size % 4 = 3 THEN 'unsupported implicit subdivision scheme: ' || p_name END AS error_detail,
  CASE WHEN p_size % 4 <> 1 THEN 'unsupported_implicit_subdivision' END AS octree_only FROM part""")
def scheme_errors(spark, sf_dir):
    """Tiling schemes that a loader lacks: all three, and one that has octrees only."""
    scheme = F.when(F.col("p_size") % 4 == 3, F.col("p_name")).otherwise(F.get(F.array(*map(F.lit, ("Quadtree", "Octree", "S2"))), (F.col("p_size") % 4).cast("int")))
    p = read(spark, sf_dir, "part").select("p_partkey", scheme.alias("s"))
    whole, some = errors.scheme_error(F.col("s")), errors.scheme_error(F.col("s"), ("octree",))
    return p.select("p_partkey", whole["error_code"].alias("error_code"), whole["error_detail"].alias("error_detail"), some["error_code"].alias("octree_only"))


@query("""
SELECT s_suppkey, s_suppkey % 3 <> 2 AS fits, CASE WHEN s_suppkey % 3 <> 2 THEN s_suppkey END AS feature_count, CASE WHEN s_suppkey % 3 = 0 THEN 'L' END AS label FROM supplier""")
def mesh_features(spark, sf_dir):
    k, n = F.col("s_suppkey") % 3, F.col("s_suppkey").cast("string")
    text = F.when(k == 0, F.concat(F.lit('{"featureIds":[{"label":"L","featureCount":'), n, F.lit("}]}"))).when(k == 1, F.concat(F.lit('{"featureIds":[{"featureCount":'), n, F.lit("}]}"))).otherwise('{"featureIds":[{"label":"L"}]}')
    m = read(spark, sf_dir, "supplier").select("s_suppkey", extensions.mesh_features(F.parse_json(text)).alias("m"))
    first = F.get("m.featureIds", F.lit(0))
    return m.select("s_suppkey", F.col("m").isNotNull().alias("fits"), first["featureCount"].alias("feature_count"), first["label"].alias("label"))


@query("""
SELECT l_orderkey, bit_or(f)::INTEGER AS flags, bool_and(f & 16 = 16) AS all_reachable FROM (
  SELECT l_orderkey, 16 + CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN l_returnflag = 'A' THEN 2 ELSE 0 END + CASE WHEN l_linestatus = 'F' THEN 12 ELSE 0 END AS f FROM lineitem) GROUP BY l_orderkey""")
def flags_union(spark, sf_dir):
    f = F.lit(classify.REACHABLE)
    for when, m in ((F.col("l_linenumber") % 2 == 0, classify.TILE), (F.col("l_returnflag") == "A", classify.CONTENT), (F.col("l_linestatus") == "F", classify.SUBTREE | classify.LOADED)):
        f = f.bitwiseOR(F.when(when, m).otherwise(0))
    li = read(spark, sf_dir, "lineitem").withColumn("f", f)
    return li.groupBy("l_orderkey").agg(F.bit_or("f").alias("flags"), F.bool_and(classify.has_flags(F.col("f"), classify.REACHABLE)).alias("all_reachable"))


def part_subtrees(spark, sf_dir):
    """Loads of subtrees two levels deep, in four forests; their bits are bytes of a digest of the part's key."""
    p, h = read(spark, sf_dir, "part"), F.md5(F.col("p_partkey").cast("string"))
    level = F.when(F.col("p_partkey") < 20, 0).when(F.col("p_partkey") % 5 < 2, 2).otherwise(4).cast("bigint")
    take = lambda at, n: bits.bitstream(F.unhex(F.substr(h, F.lit(at), F.lit(n))))
    return p.select(
        (F.col("p_partkey") % 4).alias("forest"), F.col("p_partkey").alias("ordinal"), level.alias("level"), (F.col("p_partkey") * 7 % 16).alias("x"), F.call_function("div", F.col("p_partkey"), F.lit(4)).alias("y"), (F.col("p_partkey") % 3).alias("z"),
        take(1, 2).alias("tile"), take(3, 16).alias("child"), F.array(take(19, 2)).alias("content_layers"),
    )


def sql_tracker(n: int) -> str:
    """Accepted loads (acc0, acc2, acc4) of the same subtrees."""
    a = "xyz"[:n]
    mask = lambda c, level: f"({c} & ((1 << ({level})::INTEGER) - 1))"
    low = sql_morton([f"(m{c} & 3)" for c in a], 2)
    step = lambda up, level: f"""
b{level} AS (
  SELECT l.* FROM l JOIN acc{up} u ON u.forest = l.forest AND {" AND ".join(f"u.m{c} = (l.m{c} >> 2)" for c in a)} AND u.ordinal < l.ordinal
  WHERE l.level = {level} AND {sql_hex_bit("substr(u.h, 3, 16)", low.replace("(m", "(l.m"))} = 1),
acc{level} AS (SELECT * FROM b{level} QUALIFY row_number() OVER (PARTITION BY forest, {", ".join(f"m{c}" for c in a)} ORDER BY ordinal) = 1)"""  # noqa: E731
    return f"""p AS (
  SELECT p_partkey % 4 AS forest, p_partkey AS ordinal, CASE WHEN p_partkey < 20 THEN 0 WHEN p_partkey % 5 < 2 THEN 2 ELSE 4 END AS level, (p_partkey * 7) % 16 AS x, p_partkey // 4 AS y, p_partkey % 3 AS z, md5(p_partkey::VARCHAR) AS h FROM part),
l AS (SELECT *, {", ".join(f"{mask(c, 'level')} AS m{c}" for c in a)} FROM p),
acc0 AS (SELECT * FROM l WHERE level = 0 QUALIFY row_number() OVER (PARTITION BY forest ORDER BY ordinal) = 1),{step(0, 2)},{step(2, 4)}"""


def sql_flags(n: int) -> str:
    a, size = "xyz"[:n], 2**n
    at = lambda shift, bits_: sql_morton([f"((t.m{c} >> ({shift})::INTEGER) & {2**bits_ - 1})" for c in a], bits_)
    bit = lambda node, frm, width, k: f"coalesce({sql_hex_bit(f'substr({node}.h, {frm}, {width})', k)}, 0)"

    def inside(node: str, low: int) -> str:
        k = at("0", low) if low else "0"
        k = f"({k} + {0 if low == 0 else 1})"
        beyond = f"({k} >= 8)"  # a byte has eight bits
        return f"16 + CASE WHEN {beyond} THEN 0 ELSE {bit(node, 1, 2, f'({k} % 8)')} + 2 * {bit(node, 19, 2, f'({k} % 8)')} END" + (" + 12" if low == 0 else "")

    def go(k: int) -> str:
        node = f"n{k}"
        none = f"CASE WHEN t.level = {2 * k} THEN 5 ELSE 0 END"
        if k == 2:
            return f"CASE WHEN {node}.h IS NULL THEN {none} WHEN t.level = 4 THEN {inside(node, 0)} WHEN t.level = 5 THEN {inside(node, 1)} WHEN {bit(node, 3, 16, at(f't.level - 6', 2))} = 0 THEN 16 ELSE CASE WHEN t.level = 6 THEN 5 ELSE 0 END END"
        return f"CASE WHEN {node}.h IS NULL THEN {none} {'WHEN t.level > 6 THEN 0' if k == 0 else ''} WHEN t.level = {2 * k} THEN {inside(node, 0)} WHEN t.level = {2 * k + 1} THEN {inside(node, 1)} WHEN {bit(node, 3, 16, at(f't.level - {2 * k + 2}', 2))} = 0 THEN 16 ELSE {go(k + 1)} END"

    on = lambda k: " AND ".join(f"n{k}.m{c} = (t.m{c} >> greatest(t.level - {2 * k}, 0)::INTEGER)" for c in a)
    return f"""WITH {sql_tracker(n)},
t AS (SELECT *, {", ".join(f"({c} & ((1 << level::INTEGER) - 1)) AS m{c}" for c in a)} FROM (
  SELECT o_orderkey AS tile_key, o_orderkey % 5 AS forest, o_custkey % 8 AS level, (o_orderkey * 3) % 128 AS x, o_custkey % 128 AS y, o_orderkey % 64 AS z FROM orders))
SELECT tile_key, ({go(0)})::INTEGER AS flags FROM t
LEFT JOIN acc0 n0 ON n0.forest = t.forest LEFT JOIN acc2 n1 ON n1.forest = t.forest AND t.level >= 2 AND {on(1)} LEFT JOIN acc4 n2 ON n2.forest = t.forest AND t.level >= 4 AND {on(2)}"""


def order_places(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("tile_key"), (F.col("o_orderkey") % 5).alias("forest"), (F.col("o_custkey") % 8).alias("level"), (F.col("o_orderkey") * 3 % 128).alias("x"), (F.col("o_custkey") % 128).alias("y"), (F.col("o_orderkey") % 64).alias("z"))


def tracked(spark, sf_dir, n):
    return tracker.flags(order_places(spark, sf_dir), tracker.accept(part_subtrees(spark, sf_dir), 2, n), 2, 6, n).select("tile_key", "flags")


@query(sql_flags(2))
def tracker_flags_quadtree(spark, sf_dir):
    return tracked(spark, sf_dir, 2)


@query(sql_flags(3))
def tracker_flags_octree(spark, sf_dir):
    return tracked(spark, sf_dir, 3)


@query(f"WITH {sql_tracker(2)} SELECT forest, ordinal, level::BIGINT AS level FROM (SELECT * FROM acc0 UNION ALL SELECT * FROM acc2 UNION ALL SELECT * FROM acc4)")
def tracker_accept_quadtree(spark, sf_dir):
    return tracker.accept(part_subtrees(spark, sf_dir), 2).select("forest", "ordinal", "level")


@query(f"WITH {sql_tracker(3)} SELECT forest, ordinal, level::BIGINT AS level FROM (SELECT * FROM acc0 UNION ALL SELECT * FROM acc2 UNION ALL SELECT * FROM acc4)")
def tracker_accept_octree(spark, sf_dir):
    return tracker.accept(part_subtrees(spark, sf_dir), 2, 3).select("forest", "ordinal", "level")


def in_batches(spark, sf_dir):
    """The same loads as three batches in their order, and what is held after each."""
    loads = settle(part_subtrees(spark, sf_dir), "loads")
    most = loads.agg(F.max("ordinal")).first()[0] or 0
    ends = [0, most // 10, most // 2, most + 1]
    held, out = None, []
    for low, high in itertools.pairwise(ends):
        part = loads.where((F.col("ordinal") >= low) & (F.col("ordinal") < high))
        new = tracker.accept(part, 2, held=held)
        held = new if held is None else held.union(new)
        out.append((new, held))
    return out


@query(ORACLE["tracker_accept_quadtree"])
def tracker_accept_batches(spark, sf_dir):
    return in_batches(spark, sf_dir)[-1][1].select("forest", "ordinal", "level")


@query(sql_flags(2))
def tracker_flags_refreshed(spark, sf_dir):
    """Flags after the first batch of loads, brought up to date after each of the others."""
    (_, held), *later = in_batches(spark, sf_dir)
    known = settle(tracker.flags(order_places(spark, sf_dir), held, 2, 6), "flags")
    for new, held in later:
        known = settle(tracker.refresh(known, new, held, 2, 6), "flags")
    return known.select("tile_key", "flags")


#: Subtrees with a member of a wrong type, and its path.
MISTYPED = tuple((f'{{"tileAvailability":{t},"childSubtreeAvailability":{{"constant":0}}{more}}}', path) for t, more, path in (
    ('{"constant":"1"}', "", "tileAvailability.constant"), ('{"constant":1.0}', "", "tileAvailability.constant"), ('{"constant":true}', "", "tileAvailability.constant"), ('{"constant":-1}', "", "tileAvailability.constant"),
    ('{"bitstream":"0"}', "", "tileAvailability.bitstream"), ('{"constant":1}', ',"buffers":[{"byteLength":"1"}]', "buffers.0.byteLength"), ('{"constant":1}', ',"extensions":3', "extensions"), ('{"constant":1}', ',"subtreeMetadata":5', "subtreeMetadata"),
))


def line_payloads(spark, sf_dir, damage: bool):
    """Envelopes of three-level subtrees whose tile bits are bytes of a digest; some are damaged."""
    c, h = spread(read(spark, sf_dir, "customer").select("c_custkey")), F.md5(F.col("c_custkey").cast("string"))
    tile = F.when(F.col("c_custkey") % 6 == 0, bits.constant(True)).otherwise(bits.bitstream(F.unhex(F.substr(h, F.lit(1), F.lit(6)))))
    layers = F.when(F.col("c_custkey") % 4 == 0, F.array().cast(f"array<{bits.VIEW}>")).otherwise(F.array(bits.bitstream(F.unhex(F.substr(h, F.lit(7), F.lit(6)))), bits.constant(True)))
    text, blob = subtrees.json(F.col("tile"), bits.constant(False), F.col("layers"))
    made = c.select(F.col("c_custkey").alias("id"), tile.alias("tile"), layers.alias("layers")).select("id", subtrees.binary(text, blob).alias("content"), text.alias("text"))
    if not damage:
        return made.select("id", "content")
    k = F.col("id") % (10 + len(MISTYPED))
    put = lambda at, h: F.concat(F.substr("content", F.lit(1), F.lit(at)), F.unhex(F.lit(h)), F.substr("content", F.lit(at + len(h) // 2 + 1), F.octet_length("content")))
    broken = (
        F.when(k == 1, F.substr("content", F.lit(1), F.lit(10))).when(k == 2, put(4, "02000000")).when(k == 3, put(8, "FF" * 8)).when(k == 4, put(16, "FFFF000000000000"))
        .when(k == 5, F.encode(F.lit("no json"), "UTF-8")).when(k == 6, F.encode(F.lit('{"tileAvailability":{"bitstream":3},"childSubtreeAvailability":{"constant":0}}'), "UTF-8"))
        .when(k == 7, F.encode(F.lit('{"bufferViews":[{"buffer":2,"byteOffset":0,"byteLength":1}],"buffers":[{"byteLength":1}],"tileAvailability":{"bitstream":0},"childSubtreeAvailability":{"constant":0}}'), "UTF-8"))
        .when(k == 8, F.encode(F.lit('{"bufferViews":[{"buffer":0,"byteOffset":1,"byteLength":2}],"buffers":[{"byteLength":9,"uri":"b.bin"}],"tileAvailability":{"bitstream":0},"childSubtreeAvailability":{"constant":0}}'), "UTF-8"))
        .when(k == 9, F.encode(F.lit('{"bufferViews":[{"buffer":0,"byteOffset":1,"byteLength":9}],"buffers":[{"byteLength":9,"uri":"a.bin"}],"tileAvailability":{"bitstream":0},"childSubtreeAvailability":{"constant":0}}'), "UTF-8"))
    )
    for i, (text_, _) in enumerate(MISTYPED):
        broken = broken.when(k == 10 + i, F.encode(F.lit(text_), "UTF-8"))
    return made.select("id", broken.otherwise(F.col("content")).alias("content"))


@query(f"""
SELECT CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 40 END AS id, [NULL, 'truncated', 'unsupported_version', 'invalid_length', 'truncated', 'json', 'invalid_buffer_view', 'invalid_buffer_index', 'missing_external_buffer', 'buffer_out_of_range', {", ".join(["'json'"] * len(MISTYPED))}][1 + c_custkey % {10 + len(MISTYPED)}] AS error_code,
  [NULL, NULL, '2', NULL, NULL, NULL, '3', '2', 'b.bin', NULL, {", ".join(f"'{path}'" for _, path in MISTYPED)}][1 + c_custkey % {10 + len(MISTYPED)}] AS error_detail FROM customer""")
def subtree_errors(spark, sf_dir):
    """Payloads with null and repeated ids; one URI is given twice."""
    external = spark.range(2).select(F.lit("a.bin").alias("uri"), F.unhex(F.concat(F.lit("010"), F.col("id").cast("string"))).alias("bytes"))
    given = settle(line_payloads(spark, sf_dir, True).select(F.when(F.col("id") % 3 != 0, F.col("id") % 40).alias("id"), "content"), "payloads")
    return subtrees.decode(given, external).select("id", "error_code", "error_detail")


@query(f"""
WITH c AS (SELECT c_custkey AS id, md5(c_custkey::VARCHAR) AS h FROM customer),
b AS (SELECT id, k, CASE WHEN id % 6 = 0 THEN 1 ELSE {sql_hex_bit("substr(h, 1, 6)", "k")} END AS t, CASE WHEN id % 4 = 0 THEN 0 ELSE {sql_hex_bit("substr(h, 7, 6)", "k")} END AS c FROM c, unnest(range(21)) AS u(k))
SELECT id, sum(t)::BIGINT AS tiles, sum(c)::BIGINT AS contents, sum(CASE WHEN k >= 5 THEN t ELSE 0 END)::BIGINT AS leaves, (CASE WHEN any_value(id) % 4 = 0 THEN 0 ELSE 2 END)::BIGINT AS layers FROM b GROUP BY id""")
def subtree_round_trip(spark, sf_dir):
    """Writes subtrees, reads them back, and counts what is available in each."""
    read_ = settle(subtrees.decode(line_payloads(spark, sf_dir, False)).select("id", "tile", "content_layers"), "decoded")  # decoded once, not for each count
    first = F.get("content_layers", F.lit(0))
    counts = read_.select("id", bits.count(F.col("tile"), 0, 21).alias("tiles"), bits.count(first, 0, 21).alias("contents"), bits.count(F.col("tile"), 5, 21).alias("leaves"), F.size("content_layers").cast("bigint").alias("layers"))
    return counts.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("tiles", "contents", "leaves")), F.max("layers").alias("layers"))


def part_schemas(spark, sf_dir):
    """A metadata schema a brand: its types are classes, with a property and an enum each."""
    p = read(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    of = F.concat(F.lit('"'), "p_type", F.lit('":{"name":"'), "p_type", F.lit('","properties":{"size":{"type":"SCALAR","componentType":"UINT8","required":true,"max":50},"kind":{"type":"ENUM","enumType":"'), "p_type", F.lit('"}}}'))
    enum = F.concat(F.lit('"'), "p_type", F.lit('":{"values":[{"name":"a","value":0},{"name":"b","value":'), F.length("p_type").cast("string"), F.lit("}]}"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    made = p.groupBy("p_brand").agg(joined(of).alias("c"), joined(enum).alias("e"))
    return made.select(F.col("p_brand").alias("id"), F.parse_json(F.concat(F.lit('{"id":"'), "p_brand", F.lit('","classes":{'), "c", F.lit('},"enums":{'), "e", F.lit("}}"))).alias("doc"))


SQL_SCHEMAS = "SELECT DISTINCT p_brand AS id, p_type AS class_id FROM part"


@query(f"""
SELECT id, class_id, 'size' AS property_id, 'SCALAR' AS type, 'UINT8' AS component_type, NULL AS enum_type, '50' AS max, false AS "array", true AS required FROM ({SQL_SCHEMAS})
UNION ALL SELECT id, class_id, 'kind', 'ENUM', NULL, class_id, NULL, false, false FROM ({SQL_SCHEMAS})""")
def schema_properties(spark, sf_dir):
    rows = metadata.class_properties(part_schemas(spark, sf_dir))
    return rows.select("id", "class_id", "property_id", "type", "component_type", "enum_type", F.to_json("max").alias("max"), "array", "required")


@query(f"SELECT id, class_id AS enum_id, 'UINT16' AS value_type, o AS ord, ['a', 'b'][o + 1] AS name, CASE o WHEN 0 THEN 0 ELSE length(class_id) END::BIGINT AS value FROM ({SQL_SCHEMAS}), (SELECT unnest([0, 1]) AS o)")
def schema_enums(spark, sf_dir):
    return metadata.enums(part_schemas(spark, sf_dir)).select("id", "enum_id", "value_type", "ord", "name", "value")


@query(f"""
SELECT id, '{{"classes":{{' || string_agg('"' || class_id || '":{{"name":"' || class_id || '","properties":{{"kind":{{"type":"ENUM","enumType":"' || class_id || '","array":false,"normalized":false,"required":false}},"size":{{"type":"SCALAR","componentType":"UINT8","max":50,"array":false,"normalized":false,"required":true}}}}}}', ',' ORDER BY class_id)
  || '}},"enums":{{' || string_agg('"' || class_id || '":{{"valueType":"UINT16","values":[{{"name":"a","value":0}},{{"name":"b","value":' || length(class_id) || '}}]}}', ',' ORDER BY class_id) || '}},"id":"' || id || '"}}' AS json FROM ({SQL_SCHEMAS}) GROUP BY id""")
def schema_write(spark, sf_dir):
    """Schemas written anew, as whole texts."""
    return metadata.write_schema(part_schemas(spark, sf_dir))


@query("""
SELECT s_suppkey AS id, s_suppkey AS length, k AS property, CASE k WHEN 'RTC_CENTER' THEN 'array' WHEN 'POSITION' THEN 'reference' WHEN 'SCALE' THEN 'number' ELSE 'boolean' END AS kind
FROM supplier, (SELECT unnest(['RTC_CENTER', 'POSITION', 'SCALE', 'EAST_NORTH_UP']) AS k)""")
def feature_tables(spark, sf_dir):
    text = F.concat(F.lit('{"POINTS_LENGTH":'), F.col("s_suppkey").cast("string"), F.lit(',"RTC_CENTER":[1,2,3],"POSITION":{"byteOffset":0},"SCALE":1.5,"EAST_NORTH_UP":true}'))
    return metadata.feature_table(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.parse_json(text).alias("doc"))).drop("value")


@query("""
SELECT s_suppkey AS id, CASE s_suppkey % 2 WHEN 0 THEN '"color(''#FFFFFF'')"' END AS color, CASE s_suppkey % 2 WHEN 0 THEN 'expression' ELSE 'conditions' END AS color_kind, '"true"' AS show, 'expression' AS show_kind,
  (CASE s_suppkey % 2 WHEN 0 THEN 0 ELSE 2 END)::BIGINT AS n_conditions FROM supplier""")
def style_parts(spark, sf_dir):
    text = F.when(F.col("s_suppkey") % 2 == 0, "{}").otherwise('{"color":{"conditions":[["${a} > 1","color(\'red\')"],["true","color(\'blue\')"]]}}')
    docs = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.parse_json(text).alias("doc"))
    n = metadata.conditions(docs).groupBy("id").agg(F.count("*").alias("n"))
    made = metadata.styles(docs).join(n, "id", "left")
    return made.select("id", F.when(F.col("color_kind") == "expression", F.col("color")).alias("color"), "color_kind", "show", "show_kind", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_conditions"))


@query("""
SELECT s_suppkey AS id, k AS property, CASE k WHEN 'height' THEN 'array' WHEN 'colour' THEN 'reference' END AS kind, CASE k WHEN 'height' THEN '[' || s_suppkey || ',2]' WHEN 'colour' THEN '{"byteOffset":' || s_suppkey || ',"componentType":"BYTE","type":"VEC3"}' ELSE '7' END AS value
FROM supplier, (SELECT unnest(['height', 'colour', 'odd']) AS k)""")
def batch_tables(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit('{"height":['), k, F.lit(',2],"colour":{"byteOffset":'), k, F.lit(',"componentType":"BYTE","type":"VEC3"},"odd":7,"extras":{"x":1},"extensions":{"E":{}}}'))
    rows = metadata.batch_table(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.parse_json(text).alias("doc")))
    return rows.select("id", "property", "kind", F.to_json("value").alias("value"))


@query("""
SELECT s_suppkey AS id, 0 AS table_ord, 'c' || s_suppkey % 3 AS class, s_suppkey AS count, p AS property_id, CASE p WHEN 'a' THEN 1 ELSE 2 END::BIGINT AS values, CASE p WHEN 'a' THEN s_suppkey END AS array_offsets,
  CASE p WHEN 'a' THEN 'UINT8' ELSE 'UINT32' END AS array_offset_type, CASE p WHEN 'b' THEN 4 END::BIGINT AS string_offsets, 'UINT32' AS string_offset_type FROM supplier, (SELECT unnest(['a', 'b']) AS p)
UNION ALL SELECT s_suppkey, 1, 'none', 0, NULL, NULL, NULL, 'UINT32', NULL, 'UINT32' FROM supplier""")
def property_tables(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit('{"propertyTables":[{"class":"c'), (F.col("s_suppkey") % 3).cast("string"), F.lit('","count":'), k, F.lit(',"properties":{"a":{"values":1,"arrayOffsetType":"UINT8","arrayOffsets":'), k, F.lit('},"b":{"values":2,"stringOffsets":4}}},{"class":"none","count":0}]}'))
    return metadata.property_tables(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.parse_json(text).alias("doc")))


@query("""
SELECT s_suppkey AS id, 'c' AS class_id, s_suppkey AS count, 'h' AS property_id, s_suppkey::VARCHAR AS min, '[1,2.5]' AS max, '0.5' AS mean, NULL AS median, '2' AS standard_deviation, '4' AS variance, NULL AS sum, 'x=' || s_suppkey || ',y=0' AS occurrences FROM supplier""")
def property_statistics(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit('{"classes":{"c":{"count":'), k, F.lit(',"properties":{"h":{"min":'), k, F.lit(',"max":[1,2.5],"mean":0.5,"standardDeviation":2,"variance":4,"occurrences":{"y":0,"x":'), k, F.lit("}}}}}}"))
    rows = metadata.statistics(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.parse_json(text).alias("doc")))
    found = F.array_join(F.transform(F.array_sort(F.map_entries("occurrences")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return rows.select("id", "class_id", "count", "property_id", *(F.to_json(c).alias(c) for c in ("min", "max", "mean", "median", "standard_deviation", "variance", "sum")), found.alias("occurrences"))


@query("""
SELECT s_suppkey AS id, k AS key, CASE k WHEN 'a' THEN s_suppkey::VARCHAR ELSE '"' || s_name || '"' END AS value, '"x"' AS meta FROM supplier, (SELECT unnest(['a', 'b']) AS k)""")
def free_members(spark, sf_dir):
    """The free members of an open object, and of one inside it."""
    text = F.concat(F.lit('{"a":'), F.col("s_suppkey").cast("string"), F.lit(',"b":"'), "s_name", F.lit('","extras":1,"extensions":{"E":{}}}'))
    docs = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.parse_json(text).alias("doc"))
    style = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.parse_json(F.lit('{"meta":{"description":"x","extras":2}}')).alias("doc"))
    inner = metadata.open_map(style, "meta").select("id", F.to_json("value").alias("meta"))
    return metadata.open_map(docs).select("id", "key", F.to_json("value").alias("value")).join(inner, "id")


@query(f"""
SELECT c_custkey AS id, sum({sql_hex_bit("h", "8 + k")})::BIGINT AS tiles FROM (SELECT c_custkey, md5((c_custkey % 50)::VARCHAR) AS h FROM customer), unnest(range(21)) AS u(k) GROUP BY c_custkey""")
def external_buffers(spark, sf_dir):
    """Subtrees whose bits lie in buffers of their own, given as a table by address; fifty of them are shared by all."""
    c, name = read(spark, sf_dir, "customer").select("c_custkey"), F.concat(F.lit("buffers/"), (F.col("c_custkey") % 50).cast("string"), F.lit(".bin"))
    text = F.concat(F.lit('{"bufferViews":[{"buffer":0,"byteOffset":1,"byteLength":3}],"buffers":[{"byteLength":16,"uri":"'), name, F.lit('"}],"tileAvailability":{"bitstream":0},"childSubtreeAvailability":{"constant":0}}'))
    external = c.select((F.col("c_custkey") % 50).cast("string").alias("k")).distinct().select(F.concat(F.lit("buffers/"), "k", F.lit(".bin")).alias("uri"), F.unhex(F.md5("k")).alias("bytes"))
    loaded = subtrees.decode(spread(c).select(F.col("c_custkey").alias("id"), F.encode(text, "UTF-8").alias("content")), external)
    return loaded.select("id", bits.rank_before(F.col("tile.bits"), F.lit(21)).cast("bigint").alias("tiles"))


SQL_RANK = "(SELECT md5(n_nationkey::VARCHAR) AS h, n_nationkey FROM nation)"


@query(f"""
WITH e AS (SELECT event_id, user_id % 25 AS k, (event_id * 7919) % 1048576 AS bit FROM events),
b AS (SELECT n_nationkey AS k, i, {sql_hex_bit("h", "i")} AS b, sum({sql_hex_bit("h", "i")}) OVER (PARTITION BY n_nationkey ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto, sum({sql_hex_bit("h", "i")}) OVER (PARTITION BY n_nationkey) AS whole FROM {SQL_RANK}, unnest(range(128)) AS u(i))
SELECT event_id, e.bit, (bit // 128 * whole + upto - b)::BIGINT AS rank, CASE WHEN b = 1 THEN (bit // 128 * whole + upto - b)::BIGINT END AS child_index FROM e JOIN b ON b.k = e.k AND b.i = e.bit % 128""")
def child_rank(spark, sf_dir):
    """Ranks in bitstreams of 2 ** 20 bits, one for each nation, by blocks that are stored with the bits before them."""
    bits_ = F.unhex(F.repeat(F.md5(F.col("n_nationkey").cast("string")), F.lit(8192)))
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), bits_.alias("b"))
    children = settle(availability.blocks(nations, "k", "b"), "blocks")
    e = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 25).alias("k"), (F.col("event_id") * 7919 % 2**20).alias("bit"))
    rank = F.col("rank").cast("bigint")
    return availability.ranks(e, children, "k").select("event_id", "bit", rank.alias("rank"), F.when(F.col("is_set"), rank).alias("child_index"))


SQL_TILES = "SELECT o_custkey % 5 AS forest, o_orderkey % 6 AS level, (o_orderkey * 3) % (1 << (o_orderkey % 6)::INTEGER) AS x, o_custkey % (1 << (o_orderkey % 6)::INTEGER) AS y, bool_or(o_orderstatus = 'F') AS content FROM orders GROUP BY ALL"


def order_tiles(spark, sf_dir):
    """Orders as tiles of five forests, levels 0 to 5, many of them repeated."""
    o, level = read(spark, sf_dir, "orders"), F.col("o_orderkey") % 6
    return o.select((F.col("o_custkey") % 5).alias("forest"), level.alias("level"), (F.col("o_orderkey") * 3).alias("x"), F.col("o_custkey").alias("y"), (F.col("o_orderstatus") == "F").alias("content"))


@query(SQL_TILES)
def subtrees_from_tiles(spark, sf_dir):
    """Tiles to subtrees of two levels, written as payloads, decoded, and back to tiles."""
    made = build.subtrees(order_tiles(spark, sf_dir), 2)
    text, blob = subtrees.json(F.col("tile"), F.col("child"), F.col("content_layers"))
    files = made.select("forest", "level", "x", "y", subtrees.binary(text, blob).alias("content"))
    loaded = settle(subtrees.decode(files), "loaded")
    q, cell = F.lit("quadtree"), availability.tiles(loaded, 2)
    content = availability.is_content_available(F.col("content_layers"), F.lit(0), q, F.col("rel_level"), F.col("rel_morton"))
    bit = lambda k: F.shiftright("rel_morton", k).bitwiseAND(F.lit(1))
    here = lambda a, k: (tileid.shift_left(F.col(a), F.col("rel_level")) + bit(k)).alias(a)
    return cell.select("forest", (F.col("level") + F.col("rel_level")).alias("level"), here("x", 0), here("y", 1), content.alias("content"))


@query("""
SELECT p_partkey AS range_id, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = p_partkey % 25 AND c_custkey * 37 % 1024 BETWEEN p_partkey * 13 % 1024 AND p_partkey * 13 % 1024 + 20 * p_size AND c_custkey * 101 % 1024 BETWEEN p_size AND 11 * p_size) AS any_available FROM part""")
def range_any_wide(spark, sf_dir):
    """Rectangles up to 1001 by 501 cells, in subtrees of eleven levels that customers make, one for each nation."""
    c = read(spark, sf_dir, "customer")
    tiles = c.select(F.col("c_nationkey").cast("bigint").alias("forest"), F.lit(10).cast("bigint").alias("level"), (F.col("c_custkey") * 37).alias("x"), (F.col("c_custkey") * 101).alias("y"), F.lit(False).alias("content"))
    made = settle(build.subtrees(tiles, 11).select(F.col("forest").alias("id"), "tile"), "subtrees")
    x, size = F.col("p_partkey") * 13 % 1024, F.col("p_size").cast("bigint")
    ranges = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("range_id"), (F.col("p_partkey") % 25).alias("id"), F.lit(10).cast("bigint").alias("level"), x.alias("min_x"), size.alias("min_y"), (x + 20 * size).alias("max_x"), (11 * size).alias("max_y"))
    # Every rectangle is asked, of a subtree or of none.
    asked = ranges.select("range_id").join(availability.any_in_range(made, ranges), "range_id", "left")
    return asked.select("range_id", F.coalesce("any_available", F.lit(False)).alias("any_available"))


#: Extensions of FULL: S isn't in the catalogue, and C is written otherwise.
CATALOGUE = {"D": "struct<k:bigint>", "V": "bigint", "C": "string", "T": "struct<k:bigint>", "I": "double"}


@query("""
SELECT s_suppkey AS tileset_id, path, name, verdict, CASE name WHEN 'D' THEN '{"k":' || s_suppkey || '}' WHEN 'T' THEN '{}' WHEN 'I' THEN '1' WHEN 'S' THEN '2' ELSE s_suppkey::VARCHAR END AS payload FROM supplier, (VALUES
  ('', 'D', 'fits'), ('root.boundingVolume', 'V', 'fits'), ('root.children.1.content', 'C', 'misfit'), ('root.children.1', 'T', 'fits'), ('root.children.1.implicitTiling', 'I', 'fits'), ('root.children.1.implicitTiling.subtrees', 'S', 'unknown')) v(path, name, verdict)""")
def extension_sites(spark, sf_dir):
    """Every place where a document is extended, at any depth, held against a catalogue."""
    text = F.replace(F.replace(F.lit(FULL), F.lit(",ONES"), F.lit("")), F.lit("K"), F.col("s_suppkey").cast("string"))
    docs = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tileset_id"), F.parse_json(text).alias("doc"))
    found = registry.sites(docs, CATALOGUE)
    return found.select("tileset_id", F.array_join("path", ".").alias("path"), "name", "verdict", F.to_json("payload").alias("payload"))
