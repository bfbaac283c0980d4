"""Availability of tiles, contents and child subtrees within one subtree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits, tileid

#: The deepest level whose sums are held in a task (4 ** SUMMED numbers of 4 bytes), and rectangles of one subtree and level that are answered by it.
SUMMED, ASKED = 12, 1 << 16


def is_available(view: Column, scheme: Column, level: Column, morton: Column) -> Column:
    """Whether the tile at a relative level and Morton code is set. Levels below the subtree's depth aren't refused: a constant answers for them."""
    size = tileid.tiles_at_level(scheme, level)
    return F.coalesce(size.isNotNull() & (morton >= 0) & (morton < size) & bits.is_set(view, tileid.prefix_for_level(scheme, level) + morton), F.lit(False))


def is_content_available(layers: Column, layer: Column, scheme: Column, level: Column, morton: Column) -> Column:
    """As is_available(), in a content layer; a missing layer has nothing."""
    view = F.when((layer >= 0) & (layer < F.size(layers)), F.get(layers, layer.cast("int")))
    return F.coalesce(view.isNotNull() & is_available(view, scheme, level, morton), F.lit(False))


def is_child_available(child: Column, morton: Column) -> Column:
    """Child subtrees are a flat bitstream by Morton code."""
    return F.coalesce(bits.is_set(child, morton), F.lit(False))


def set_available(view: Column, scheme: Column, levels: Column, level: Column, morton: Column, value: Column) -> Column:
    """The view with a tile set or cleared; a constant is first written out for the whole subtree. The Morton code isn't held to its level."""
    total, prefix = tileid.prefix_for_level(scheme, levels), tileid.prefix_for_level(scheme, level)
    return F.when(total.isNull() | prefix.isNull(), view).otherwise(bits.set_bit(bits.expand_constant(view, total), prefix + morton, value))


def set_child_available(child: Column, scheme: Column, levels: Column, morton: Column, value: Column) -> Column:
    total = tileid.tiles_at_level(scheme, levels)
    return F.when(total.isNull(), child).otherwise(bits.set_bit(bits.expand_constant(child, total), morton, value))


def uniform(available: bool) -> list[Column]:
    """tile, child, content_layers of a subtree whose tiles all exist, or don't; it has no child subtrees and no content."""
    none = bits.constant(False)
    return [bits.constant(available).alias("tile"), none.alias("child"), F.array(none).alias("content_layers")]


def new(tile: Column, child: Column, content_layers: Column) -> Column:
    """struct<tile, child, content_layers> of a subtree from its views; null if it has no content layer."""
    return F.when(F.size(content_layers) > 0, F.struct(tile.alias("tile"), child.alias("child"), content_layers.alias("content_layers")))


def tiles(subtrees: DataFrame, levels: int, n: int = 2) -> DataFrame:
    """A row for each available tile of each subtree: the columns of subtrees, rel_level, rel_morton."""
    scheme = F.lit("octree" if n == 3 else "quadtree")
    levels_ = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("rel_level")
    grown = subtrees.select("*", levels_)
    grown = grown.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), tileid.tiles_at_level(scheme, F.col("rel_level")) - 1)).alias("rel_morton"))
    return grown.where(is_available(F.col("tile"), scheme, F.col("rel_level"), F.col("rel_morton")))


def blocks(streams: DataFrame, key: str, stream: str) -> DataFrame:
    """key, block, before (set bits before it), inside, bytes: bitstreams (one for each key) in blocks of bits.BLOCK bytes."""
    n = F.greatest(F.ceil(F.octet_length(stream) / bits.BLOCK).cast("int"), F.lit(1))
    part = lambda i: F.struct(i.alias("block"), F.substr(F.col(stream), i * bits.BLOCK + 1, F.lit(bits.BLOCK)).alias("bytes"))
    cut = streams.where(F.col(stream).isNotNull()).select(key, F.inline(F.transform(F.sequence(F.lit(0), n - 1), part)))
    counted = cut.withColumn("inside", bits.rank_before(F.col("bytes"), F.lit(8 * bits.BLOCK)))
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("before", F.coalesce(F.sum("inside").over(before), F.lit(0)))


def ranks(asked: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The columns of asked (key, bit, ...), rank (set bits before the bit) and is_set. stored: blocks() of bitstreams, one for each key.

    A row meets the one block that it asks about, not the whole bitstream; beyond the end nothing is set, and the rank is of all.
    """
    whole = stored.groupBy(F.col(key).alias("_key")).agg(F.sum("inside").alias("_all"))
    each = stored.select(F.col(key).alias("_of"), F.col("block").alias("_block"), F.col("before").alias("_before"), F.col("bytes").alias("_bytes"))
    at = F.call_function("div", F.col("bit"), F.lit(8 * bits.BLOCK))
    met = asked.join(whole, F.col(key) == F.col("_key")).join(each, (F.col(key) == F.col("_of")) & (at == F.col("_block")), "left")
    inner = F.col("bit") % (8 * bits.BLOCK)
    rank = F.coalesce(F.col("_before") + bits.rank_before(F.col("_bytes"), inner), F.col("_all"))
    return met.select(*(F.col(f"`{c}`") for c in asked.columns), rank.alias("rank"), F.coalesce(bits.is_set(bits.bitstream(F.col("_bytes")), inner), F.lit(False)).alias("is_set"))


def sums(cells: bytes, skip: int, level: int) -> np.ndarray:
    """Available cells of a level with smaller x and y, by y and x; cells: the level's bits by Morton code, after skip others."""
    side = 1 << level
    flat = np.zeros(side * side, np.uint8)
    found = np.unpackbits(np.frombuffer(cells or b"", np.uint8), bitorder="little")[skip : skip + side * side]
    flat[: len(found)] = found
    # The bits of a Morton code, from the highest: y, x, y, x, ...
    axes = [*range(0, 2 * level, 2), *range(1, 2 * level, 2)]
    out = np.zeros((side + 1, side + 1), np.int32)
    grid = flat.reshape([2] * (2 * level)).transpose(axes).reshape(side, side)
    np.cumsum(np.cumsum(grid, axis=0, dtype=np.int32), axis=1, out=out[1:, 1:])
    return out


def answered(asked: pa.Table, subtrees: pa.Table, schema: pa.Schema) -> pa.Table:
    """Rectangles (a, b, c, d: least x and y, greatest x and y) against the subtrees of one id, at one level."""
    a, b, c, d = (asked.column(k).to_numpy() for k in "abcd")
    out = []
    for row in subtrees.to_pylist() if asked.num_rows else ():
        fine = (a <= c) & (b <= d)
        if row["constant"] is None:
            level = row["level"]
            table, last = sums(row["cells"], row["skip"], level), 1 << level
            x, y, right, top = (np.clip(v, 0, last) for v in (a, b, c + 1, d + 1))
            hit = fine & (table[top, right] - table[y, right] - table[top, x] + table[y, x] > 0)
        else:
            hit = fine & row["constant"]
        out.append(pa.Table.from_arrays([asked.column("range_id"), pa.array(hit)], schema=schema))
    return pa.concat_tables(out) if out else schema.empty_table()


def any_in_range(subtrees: DataFrame, ranges: DataFrame) -> DataFrame:
    """range_id, any_available. ranges: range_id, id (of a subtree), level, min_x, min_y, max_x, max_y (inclusive).

    Down to level SUMMED, rectangles meet their subtree in groups of about ASKED, for which the level's cells are summed once; a rectangle
    is four of these sums. Deeper levels are asked by Morton ranges (any_by_ranges()).
    """
    shallow = F.coalesce(F.col("level").between(0, SUMMED), F.lit(False))
    asked = ranges.where(shallow & F.col("id").isNotNull())
    last = tileid.shift_left(F.lit(1).cast("bigint"), F.col("level")) - 1
    low, high = (lambda c: F.greatest(F.col(c), F.lit(0)).cast("bigint")), (lambda c: F.least(F.col(c), last).cast("bigint"))
    asked = asked.select("range_id", "id", F.col("level").cast("int").alias("level"), low("min_x").alias("a"), low("min_y").alias("b"), high("max_x").alias("c"), high("max_y").alias("d"))
    groups = asked.groupBy("id", "level").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("n"))
    spread = asked.join(groups, ["id", "level"]).withColumn("part", F.pmod(F.xxhash64("range_id", "a", "b", "c", "d"), F.col("n")).cast("int")).drop("n")
    first, size = tileid.prefix_for_level(F.lit("quadtree"), F.col("level")), tileid.tiles_at_level(F.lit("quadtree"), F.col("level"))
    cells = F.substr("tile.bits", (F.call_function("div", first, F.lit(8)) + 1).cast("int"), (F.call_function("div", size, F.lit(8)) + 2).cast("int"))
    given = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).join(subtrees.select("id", "tile"), "id")
    given = given.select(F.col("id").alias("id"), F.col("level").alias("level"), "part", F.col("tile.constant").alias("constant"), cells.alias("cells"), (first % 8).cast("int").alias("skip"))
    ddl = f"range_id {ranges.schema['range_id'].dataType.simpleString()}, any_available boolean"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return answered(left, right, pa.schema([("range_id", left.schema.field("range_id").type), ("any_available", pa.bool_())]))

    keys = ("id", "level", "part")
    return spread.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInArrow(run, ddl).unionByName(any_by_ranges(subtrees, ranges.where(~shallow)))


def any_by_ranges(subtrees: DataFrame, ranges: DataFrame) -> DataFrame:
    """any_in_range() at any level, without sums.

    A rectangle becomes Morton ranges (tileid.z_ranges()), each answered by one look at its bits; no cell is asked by itself. Only
    levels that the bitstream reaches are looked at; nothing is joined but the subtree, by id.
    """
    scheme, level = F.lit("quadtree"), F.col("level")
    last = F.when(level.between(0, 31), tileid.shift_left(F.lit(1).cast("bigint"), level) - 1).otherwise(F.lit(2**32 - 1))
    low_x, low_y = (F.greatest(F.col(c), F.lit(0)).cast("bigint") for c in ("min_x", "min_y"))
    high_x, high_y = (F.least(F.col(c), last).cast("bigint") for c in ("max_x", "max_y"))
    corners = F.struct(low_x.alias("a"), low_y.alias("b"), high_x.alias("c"), high_y.alias("d"))
    prefix = tileid.prefix_for_level(scheme, level)
    met = ranges.join(subtrees, "id").select("range_id", "tile", "level", corners.alias("r"), prefix.alias("prefix"))
    reached = F.coalesce((F.col("level") >= 0) & (F.col("prefix") < 8 * F.octet_length(F.col("tile.bits"))), F.lit(False))
    spans = tileid.z_ranges(level, *(F.col(f"r.{c}") for c in "abcd"))
    hit = F.exists(spans, lambda s: bits.any_set(F.col("tile.bits"), F.col("prefix") + s["start"], F.col("prefix") + s["end"]))
    empty = (F.col("r.a") > F.col("r.c")) | (F.col("r.b") > F.col("r.d"))
    constant = is_available(F.col("tile"), scheme, level, F.lit(0))
    return met.select("range_id", F.when(empty, F.lit(False)).when(F.col("tile.constant").isNotNull(), constant).when(reached, hit).otherwise(F.lit(False)).alias("any_available"))
