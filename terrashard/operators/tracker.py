"""Reachability of tiles across a forest of subtrees, as joins and aggregates.

Every subtree root above a tile is plain arithmetic, so no tree is walked: a tile is exploded into its chain of subtree
roots (level / depth + 1 rows), each looked up by equality, and the first link of the chain that is missing decides.
The number of loaded subtrees may be as large as the tiles: the lookup is a shuffled or, if small, broadcast equi-join,
and the aggregation is combined map-side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits, classify, tileid
from ..storage import settle
from .availability import is_available, is_child_available, is_content_available


def masked(c: Column, level: Column) -> Column:
    """The low bits of a coordinate that a level has; level 0 has none."""
    return c.bitwiseAND(tileid.shift_left(F.lit(1), F.least(level, F.lit(32))) - 1)


def chain(tiles: DataFrame, depth: int, n: int) -> DataFrame:
    """A row for each subtree root at or above a tile: k, and the root's masked coordinates r_x, r_y[, r_z]; c_morton and local, the Morton codes below it of the next root and of the tile."""
    axes = tileid.AXES[:n]
    out = tiles.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.call_function("div", F.col("level"), F.lit(depth)))).alias("k"))
    out = out.withColumn("low", F.col("level") - F.col("k") * depth).withColumn("step", F.greatest(F.col("low") - depth, F.lit(0)))
    out = out.withColumns({f"r_{a}": tileid.shift_right(masked(F.col(a), F.col("level")), F.col("low")) for a in axes})
    # Steps to the next root, and to the tile itself where it lies inside: depth bits each.
    out = out.withColumn("c_morton", tileid.morton(*(tileid.shift_right(masked(F.col(a), F.col("level")), F.col("step")) for a in axes), n_bits=depth))
    return out.withColumn("local", F.when(F.col("low") < depth, tileid.morton(*(masked(F.col(a), F.col("low")) for a in axes), n_bits=depth)))


def child_index(child: Column, directory: Column, morton: Column) -> Column:
    """The place of a child subtree among those that exist: its Morton code where all do, else the set bits before it (by the bitstream's directory, see bits.rank()); null if it doesn't exist."""
    return F.when(is_child_available(child, morton), F.when(child["constant"].isNotNull(), morton).otherwise(bits.rank(child["bits"], directory, morton)))


def flags(tiles: DataFrame, loaded: DataFrame, depth: int, maximum_level: int, n: int = 2) -> DataFrame:
    """The columns of tiles (tile_key, forest, level, x, y[, z]) and flags.

    loaded: forest, level, x, y[, z], tile, child, content_layers, one row for each accepted subtree. tile_key names a
    tile's row. Level 0 ignores coordinates, and coordinates wrap at their level.
    """
    axes, scheme = tileid.AXES[:n], F.lit("octree" if n == 3 else "quadtree")
    links = chain(tiles.select("tile_key", "forest", "level", *axes), depth, n).withColumn("r_level", F.col("k") * depth)
    nodes = loaded.select("forest", F.col("level").alias("r_level"), *(masked(F.col(a), F.col("level")).alias(f"r_{a}") for a in axes), "tile", "child", "content_layers", F.lit(True).alias("here"))
    joined = links.join(nodes, ["forest", "r_level", *(f"r_{a}" for a in axes)], "left").withColumn("here", F.coalesce("here", F.lit(False)))
    inside = F.col("low") < depth
    local = F.col("local")
    has = lambda view: is_available(view, scheme, F.col("low"), local)
    content = is_content_available(F.col("content_layers"), F.lit(0), scheme, F.col("low"), local)
    found = F.lit(classify.REACHABLE) + F.when(has(F.col("tile")), classify.TILE).otherwise(0) + F.when(content, classify.CONTENT).otherwise(0) + F.when(F.col("low") == 0, classify.SUBTREE | classify.LOADED).otherwise(0)
    # What a link says if the chain stops at it: a missing subtree, a tile inside, or a child that isn't there.
    missing = F.when(F.col("low") == 0, classify.TILE | classify.SUBTREE).otherwise(0)
    stops = F.when(~F.col("here"), missing).when(inside, found).when(~is_child_available(F.col("child"), F.col("c_morton")), classify.REACHABLE)
    first = joined.withColumn("stop", stops.cast("int")).where("stop is not null").groupBy("tile_key").agg(F.min(F.struct("k", "stop", "here")).alias("s"))
    out = tiles.join(first, "tile_key", "left")
    beyond = (F.col("level") > maximum_level) & ~((F.col("s.k") == 0) & ~F.col("s.here"))
    return out.withColumn("flags", F.when(beyond, 0).otherwise(F.coalesce("s.stop", F.lit(0))).cast("int")).drop("s")


def refresh(known: DataFrame, new: DataFrame, loaded: DataFrame, depth: int, maximum_level: int, n: int = 2) -> DataFrame:
    """known (tile_key, forest, level, x, y[, z], flags) brought up to date when loads were accepted.

    new: the subtrees that were accepted since; loaded: all, those included (as in flags()). A tile's flags depend on the
    roots of its chain only, so tiles whose chain meets none of the new roots are passed on as they are, and the others are asked again.
    """
    asked = touched(known, new, depth, n)
    again = flags(known.join(asked, "tile_key", "left_semi").drop("flags"), loaded, depth, maximum_level, n)
    return known.join(asked, "tile_key", "left_anti").union(again.select(*known.columns))


def touched(tiles: DataFrame, new: DataFrame, depth: int, n: int = 2) -> DataFrame:
    """tile_key of the tiles whose chain holds the root of one of the new subtrees."""
    axes = tileid.AXES[:n]
    links = chain(tiles.select("tile_key", "forest", "level", *axes), depth, n).withColumn("r_level", F.col("k") * depth)
    roots = new.select("forest", F.col("level").alias("r_level"), *(masked(F.col(a), F.col("level")).alias(f"r_{a}") for a in axes))
    return links.join(roots, ["forest", "r_level", *(f"r_{a}" for a in axes)], "left_semi").select("tile_key").distinct()


def accepted_levels(loads: DataFrame, depth: int, n: int = 2, held: DataFrame | None = None) -> list[DataFrame]:
    """What accept() takes, as one stored table for each level; never an empty list."""
    axes = tileid.AXES[:n]
    placed = lambda df: df.where(F.col("level") % depth == 0).withColumns({f"r_{a}": masked(F.col(a), F.col("level")) for a in axes})
    keyed, old = placed(loads), None if held is None else placed(held)
    key = ["forest", *(f"r_{a}" for a in axes)]
    at = lambda level: old.where(F.col("level") == level)
    free = lambda df, level: df if old is None else df.join(at(level).select(*key), key, "left_anti")
    place = Window.partitionBy(*key).orderBy("ordinal")
    first = lambda df: df.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")
    parent = lambda df: df.select("forest", F.col("ordinal").alias("up_ordinal"), F.col("child").alias("up_child"), *(F.col(f"r_{a}").alias(f"u_{a}") for a in axes))
    level, done = 0, []
    last = loads.agg(F.max("level")).first()[0]
    taken = settle(first(free(keyed.where("level = 0"), 0)), "accepted")
    while True:
        done.append(taken)
        # Without subtrees held from before, a level that takes none ends it.
        if last is None or level + depth > last or (old is None and taken.isEmpty()):
            return done
        up = parent(taken) if old is None else parent(taken).union(parent(at(level)))
        level += depth
        below = free(keyed.where(F.col("level") == level), level).withColumns({f"u_{a}": tileid.shift_right(F.col(f"r_{a}"), F.lit(depth)) for a in axes})
        bit = is_child_available(F.col("up_child"), tileid.morton(*(F.col(f"r_{a}") for a in axes), n_bits=depth))
        fit = below.join(up, ["forest", *(f"u_{a}" for a in axes)]).where(F.col("up_ordinal") < F.col("ordinal")).where(bit)
        taken = settle(first(fit.select(*keyed.columns)), "accepted")


def accept(loads: DataFrame, depth: int, n: int = 2, held: DataFrame | None = None) -> DataFrame:
    """The loads that a tracker accepts, in order of ordinal: loads has forest, ordinal, level, x, y[, z], tile, child, content_layers.

    A root is accepted if it is its forest's first; another subtree if it stands on a multiple of depth, its parent was
    accepted earlier and has its child bit set, and it is the first such load for its place. Levels are taken from the
    root down, each one join and one window; a load that came too early doesn't keep a later one out.

    held: what was accepted before, with the columns of loads. So loads may come in batches, cut anywhere, if those of a later batch
    have larger ordinals; all together accept what one table of them would. ordinal may be of any type that has an order; forest isn't null.
    """
    return reduce(DataFrame.union, (t.select(*loads.columns) for t in accepted_levels(loads, depth, n, held)))
