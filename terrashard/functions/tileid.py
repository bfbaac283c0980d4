"""Algebra of implicit tiles (level, x, y[, z]) as column expressions, all BIGINT and inlined by Catalyst.

Coordinates are unsigned 32-bit numbers; where the tiling wraps, so do these (MASK). A quadtree scheme is `quadtree` or
`s2`, an octree `octree`.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
#: Bits of a coordinate that a Morton code holds, by number of coordinates.
MORTON_BITS = {2: 16, 3: 10}
AXES = ("x", "y", "z")
#: Holds any unsigned number of 96 bits.
WIDE = "decimal(38,0)"


def morton(*coordinates: Column, n_bits: int | None = None) -> Column:
    """Morton code: bit i of coordinate k goes to bit i * n + k. Bits from n_bits on (as a rule, MORTON_BITS) are dropped."""
    n = len(coordinates)
    n_bits = min(n_bits or MORTON_BITS[n], MORTON_BITS[n])
    bits = [
        F.shiftleft(F.shiftright(c, i).bitwiseAND(F.lit(1)), i * n + k) if i * n + k else c.bitwiseAND(F.lit(1))
        for k, c in enumerate(coordinates)
        for i in range(n_bits)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


#: Each byte with n - 1 zeros between its bits, by number of coordinates.
SPREAD = {n: [sum((b >> i & 1) << i * n for i in range(8)) for b in range(256)] for n in (2, 3)}
#: Holds half a code, and what the upper half is multiplied by: at most 2 ** 48.
HALF = "decimal(15,0)"


def morton_wide(*coordinates: Column) -> Column:
    """Morton code of whole 32-bit coordinates, as WIDE: 64 bits of two, 96 of three.

    Bytes are spread by a table, and the codes of the lower and upper 16 bits fit a BIGINT each: a term for each bit would make methods that
    are too long for the JVM to compile.
    """
    n = len(coordinates)
    byte = lambda c, low: F.get(F.lit(SPREAD[n]), F.shiftright(c, low).bitwiseAND(F.lit(255)).cast("int")).cast("bigint")
    placed = lambda v, by: F.shiftleft(v, by) if by else v
    half = lambda low: reduce(lambda a, b: a.bitwiseOR(b), (placed(byte(c, low + i), i * n + k) for k, c in enumerate(coordinates) for i in (0, 8)))
    return (half(16).cast(HALF) * F.lit(Decimal(2 ** (16 * n))).cast(HALF) + half(0).cast(HALF)).cast(WIDE)


def shift_left(value: Column, by: Column) -> Column:
    """value << by, for a column of shifts from 0 to 62."""
    return F.call_function("shiftleft", value.cast("bigint"), by.cast("int"))


def shift_right(value: Column, by: Column) -> Column:
    return F.call_function("shiftright", value.cast("bigint"), by.cast("int"))


def tile(level: Column, *coordinates: Column) -> Column:
    return F.struct(level.cast("bigint").alias("level"), *(c.cast("bigint").alias(a) for c, a in zip(coordinates, AXES, strict=False)))


def axes(t: Column, n: int) -> list[Column]:
    return [t[a] for a in AXES[:n]]


def relative_to(t: Column, root: Column, n: int = 2) -> Column:
    """Tile t counted from the subtree root tile: level difference, and coordinates less the root's shifted down."""
    diff = t["level"] - root["level"]
    return tile(diff, *((a - shift_left(b, diff)).bitwiseAND(F.lit(MASK)) for a, b in zip(axes(t, n), axes(root, n), strict=True)))


def relative_position(t: Column, root: Column, n: int = 2) -> Column:
    """Relative level and Morton code of t under root."""
    rel = relative_to(t, root, n)
    return F.struct(rel["level"].alias("level"), morton(*axes(rel, n)).alias("morton"))


def children(t: Column, n: int = 2) -> Column:
    """Array of the 2 ** n tiles below t, in Morton order."""
    bit = lambda i, k: i // 2**k % 2
    return F.array(*(tile(t["level"] + 1, *((2 * a + bit(i, k)).bitwiseAND(F.lit(MASK)) for k, a in enumerate(axes(t, n)))) for i in range(2**n)))


def subtree_root(t: Column, subtree_levels: Column | int, n: int = 2) -> Column:
    """The root tile of the subtree of fixed depth that holds t; t itself for depth 0."""
    s = F.lit(subtree_levels) if isinstance(subtree_levels, int) else subtree_levels
    down = F.when(s == 0, F.lit(0)).otherwise(t["level"] % s)
    return tile(t["level"] - down, *(shift_right(a, down) for a in axes(t, n)))


def z_ranges(level: Column, low_x: Column, low_y: Column, high_x: Column, high_y: Column) -> Column:
    """array<struct<start, end>>: the Morton ranges (end excluded) of a rectangle of a quadtree's level, corners included; empty if it has no cell.

    The level's square is quartered; quarters that lie inside are a range each, those on the edge are quartered again. So the work is in
    proportion to the rectangle's edge, not to its area. Levels to 30.
    """
    node, range_ = "array<struct<x:bigint,y:bigint,m:bigint>>", "array<struct<start:bigint,end:bigint>>"
    one = lambda x, y, m: F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), m.cast("bigint").alias("m"))
    zero = F.lit(0)
    begin = F.struct(F.array(one(zero, zero, zero)).cast(node).alias("todo"), F.array().cast(range_).alias("done"))

    def step(acc: Column, k: Column) -> Column:
        size = shift_left(F.lit(1), level - k)
        meets = lambda c: (c["x"] * size <= high_x) & ((c["x"] + 1) * size > low_x) & (c["y"] * size <= high_y) & ((c["y"] + 1) * size > low_y)
        inside = lambda c: (c["x"] * size >= low_x) & ((c["x"] + 1) * size - 1 <= high_x) & (c["y"] * size >= low_y) & ((c["y"] + 1) * size - 1 <= high_y)
        cells = lambda m: m * size * size
        met = F.filter(acc["todo"], meets)
        whole = F.transform(F.filter(met, inside), lambda c: F.struct(cells(c["m"]).alias("start"), cells(c["m"] + 1).alias("end")))
        quarters = lambda c: F.array(*(one(2 * c["x"] + i % 2, 2 * c["y"] + i // 2, 4 * c["m"] + i) for i in range(4)))
        return F.struct(F.flatten(F.transform(F.filter(met, lambda c: ~inside(c)), quarters)).alias("todo"), F.concat(acc["done"], whole).alias("done"))

    return F.aggregate(F.sequence(zero.cast("bigint"), level.cast("bigint")), begin, step)["done"]


def child_count(scheme: Column) -> Column:
    return F.when(F.lower(scheme) == "octree", 8).otherwise(4).cast("bigint")


def power(scheme: Column) -> Column:
    return F.when(F.lower(scheme) == "octree", 3).otherwise(2).cast("bigint")


def tiles_at_level(scheme: Column, level: Column) -> Column:
    """1 << (power * level); null where that needs more than 63 bits. (2 ** 63 itself is null too, as a BIGINT can't hold it.)"""
    shift = power(scheme) * level
    return F.when(shift < 63, shift_left(F.lit(1), shift))


def prefix_for_level(scheme: Column, level: Column) -> Column:
    """Tiles above a level: where the level's bits begin in a bitstream."""
    return F.call_function("div", tiles_at_level(scheme, level) - 1, child_count(scheme) - 1)


def tiles_at_level_wide(scheme: Column, level: Column) -> Column:
    """1 << (power * level) as WIDE, 2 ** 63 included; null where that needs more than 64 bits."""
    shift = power(scheme) * level
    return F.when(shift < 64, (shift_left(F.lit(1), F.least(shift, F.lit(62))).cast(WIDE) * F.when(shift == 63, 2).otherwise(1)).cast(WIDE))


def prefix_for_level_wide(scheme: Column, level: Column) -> Column:
    """Tiles above a level, known for every level whose tiles are; it fits a BIGINT."""
    return F.call_function("div", tiles_at_level_wide(scheme, level) - 1, (child_count(scheme) - 1).cast(WIDE))


def expand_url(template: Column, t: Column, n: int = 2) -> Column:
    """The template with {level}, {x}, {y} and, in octrees, {z} filled in."""
    out = F.replace(template, F.lit("{level}"), t["level"].cast("string"))
    for a in AXES[:n]:
        out = F.replace(out, F.lit(f"{{{a}}}"), t[a].cast("string"))
    return out


def subdivide_region(region: Column, t: Column, n: int = 2) -> Column:
    """West, south, east, north, lowest, highest of a tile in a region; a quadtree leaves heights alone."""
    d = F.pow(F.lit(2.0), t["level"].cast("double"))
    low, high = [region[0], region[1], region[4]], [region[2], region[3], region[5]]
    begin, end = list(low), list(high)
    for k, a in enumerate(axes(t, n)):
        step, at = (high[k] - low[k]) / d, a.cast("double")
        begin[k], end[k] = low[k] + step * at, low[k] + step * (at + 1.0)
    return F.array(begin[0], begin[1], end[0], end[1], begin[2], end[2])


def subdivide_box(box: Column, t: Column, n: int = 2) -> Column:
    """Centre and half axes (12 numbers) of a tile in an oriented box; a quadtree leaves the third axis alone."""
    half = [[box[3 * (k + 1) + i] for i in range(3)] for k in range(3)]
    factor = F.lit(2.0) / F.pow(F.lit(2.0), t["level"].cast("double"))
    # Added up in this order everywhere, so that results are equal to the last bit.
    centre = [box[i] - half[0][i] - half[1][i] - half[2][i] for i in range(3)]
    for k in range(3):
        if k < n:
            full = [h * factor for h in half[k]]
            centre = [c + f * (t[AXES[k]].cast("double") + 0.5) for c, f in zip(centre, full, strict=True)]
            half[k] = [f * 0.5 for f in full]
        else:
            centre = [c + h for c, h in zip(centre, half[k], strict=True)]
    return F.array(*centre, *(h for axis in half for h in axis))


def subdivide_bounding_volume(volume: Column, t: Column, n: int = 2) -> Column:
    """struct<box, region, sphere> of a tile: a region wins over a box, and a sphere alone leaves all empty."""
    none = F.lit(None).cast("array<double>")
    region, box = volume["region"], volume["box"]
    return F.struct(
        F.when(region.isNull() & box.isNotNull(), subdivide_box(box, t, n)).otherwise(none).alias("box"),
        F.when(region.isNotNull(), subdivide_region(region, t, n)).otherwise(none).alias("region"),
        none.alias("sphere"),
    )


def register(spark: SparkSession) -> None:
    """The algebra as SQL functions of the session: morton2, morton3, subtree_level, subtree_coordinate, tile_prefix."""
    bits = lambda names, n: " | ".join(f"shiftleft(shiftright({c}, {i}) & 1, {i * n + k})" for k, c in enumerate(names) for i in range(MORTON_BITS[n]))
    for name, signature, body in (
        ("morton2", "x BIGINT, y BIGINT", bits("xy", 2)),
        ("morton3", "x BIGINT, y BIGINT, z BIGINT", bits("xyz", 3)),
        ("subtree_level", "level BIGINT, s BIGINT", "if(s = 0, level, (level div s) * s)"),
        ("subtree_coordinate", "level BIGINT, c BIGINT, s BIGINT", "if(s = 0, c, shiftright(c, CAST(level % s AS INT)))"),
        ("tile_prefix", "n BIGINT, level BIGINT", "if(n * level < 63, (shiftleft(1L, CAST(n * level AS INT)) - 1) div (shiftleft(1L, CAST(n AS INT)) - 1), NULL)"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({signature}) RETURNS BIGINT RETURN {body}")
