"""Subtrees from a table of tiles, by bitmap aggregation: no bit is set by copying a bitstream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits, tileid
from .tracker import masked

#: Bits of one bitmap aggregate.
BITMAP = 32768


def view(stream: Column, n_bits: int) -> Column:
    """A view of n_bits: a constant where all bits agree (a null stream has none), else the bitstream cut to whole bytes."""
    cut = lambda s: F.when(F.bitmap_count(s) == n_bits, bits.constant(True)).otherwise(bits.bitstream(F.substr(s, F.lit(1), F.lit(-(-n_bits // 8)))))
    return bits.let(stream, lambda s: F.when(s.isNull() | (F.bitmap_count(s) == 0), bits.constant(False)).otherwise(cut(s)))


def streams(rows: DataFrame, keys: list[str], n_bits: int, **named: Column) -> DataFrame:
    """keys, and for each name a BINARY in which the bits that its column gives are set; null bits set nothing.

    Rows are combined map-side into bitmaps of BITMAP bits, which are then put side by side: a group gets as many as its bits need, however
    many rows set them.
    """
    n = -(-n_bits // BITMAP)
    made = rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(name).alias("name"), c.cast("bigint").alias("bit")) for name, c in named.items()))).alias("b")).where("b.bit is not null")
    parts = made.groupBy(*keys, F.col("b.name").alias("name"), F.call_function("div", F.col("b.bit"), F.lit(BITMAP)).alias("k")).agg(F.bitmap_construct_agg(F.col("b.bit") % BITMAP).alias("m"))
    if n == 1:
        return parts.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, F.col("m"))).alias(name) for name in named))
    blank = F.repeat(F.lit("00"), F.lit(BITMAP // 8))
    found = lambda name: F.map_from_entries(F.collect_list(F.when(F.col("name") == name, F.struct("k", "m"))))
    side = lambda m: F.unhex(F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")), lambda k: F.coalesce(F.hex(F.try_element_at(m, k)), blank)), ""))
    return parts.groupBy(*keys).agg(*(found(name).alias(name) for name in named)).select(*keys, *(F.when(F.size(name) > 0, side(F.col(name))).alias(name) for name in named))


def subtrees(tiles: DataFrame, depth: int, n: int = 2) -> DataFrame:
    """forest, level, x, y[, z], tile, child, content_layers: the subtrees, depth levels deep, in which tiles lie, and those above them up to their forest's root.

    tiles: forest, level, x, y[, z], content (boolean; null is false). A tile that is there several times has content if one of its rows
    has. Coordinates wrap at their level; a null level or coordinate is no tile.
    """
    axes, scheme = tileid.AXES[:n], F.lit("octree" if n == 3 else "quadtree")
    total, below = ((1 << n * depth) - 1) // ((1 << n) - 1), 1 << n * depth
    given = tiles.where(" and ".join(f"{c} is not null" for c in ("level", *axes)))
    t = tileid.tile(F.col("level"), *(masked(F.col(a), F.col("level")) for a in axes))
    placed = given.select("forest", t.alias("t"), F.coalesce("content", F.lit(False)).alias("content")).select("*", tileid.subtree_root(F.col("t"), depth, n).alias("r"))
    rel = tileid.relative_to(F.col("t"), F.col("r"), n)
    morton = tileid.morton(*(F.col(f"p.{a}") for a in axes), n_bits=depth)
    bit = tileid.prefix_for_level(scheme, F.col("p.level")) + morton
    placed = placed.select("forest", "r", "content", rel.alias("p")).select("forest", "r.*", bit.alias("bit"), "content")
    keys = ["forest", "level", *axes]
    own = streams(placed, keys, total, tile=F.col("bit"), content=F.when(F.col("content"), F.col("bit")))
    up = F.explode(F.sequence(F.lit(0).cast("bigint"), F.call_function("div", F.col("level"), F.lit(depth)))).alias("k")
    shift = F.col("k") * depth
    roots = placed.select(*keys).distinct().select("forest", "level", *axes, up)
    roots = roots.select("forest", (F.col("level") - shift).alias("level"), *(tileid.shift_right(F.col(a), shift).alias(a) for a in axes)).distinct()
    parent = roots.where("level > 0").select("forest", (F.col("level") - depth).alias("level"), *(tileid.shift_right(F.col(a), F.lit(depth)).alias(a) for a in axes), tileid.morton(*(F.col(a).bitwiseAND(F.lit((1 << depth) - 1)) for a in axes), n_bits=depth).alias("bit"))
    children = streams(parent, keys, below, child=F.col("bit"))
    null_safe = lambda a, b: (a.forest.eqNullSafe(b.forest)) & (a.level == b.level) & tileid.reduce(lambda x, y: x & y, (a[c] == b[c] for c in axes))
    met = roots.join(own, null_safe(roots, own), "left").select(*(roots[c] for c in keys), own.tile, own.content)
    met = met.join(children, null_safe(met, children), "left").select(*(met[c] for c in keys), "tile", "content", children.child)
    return met.select(*keys, view(F.col("tile"), total).alias("tile"), view(F.col("child"), below).alias("child"), F.array(view(F.col("content"), total)).alias("content_layers"))
