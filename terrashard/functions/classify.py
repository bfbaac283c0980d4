"""What a resource is, by its first bytes or its address; and tile flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Magic bytes (in hex) and formats, extensions and formats, endings of tileset addresses, flag bits.
MAGIC = {"676C5446": "glb", "6233646D": "b3dm", "6933646D": "i3dm", "636D7074": "cmpt", "706E7473": "pnts"}
EXTENSIONS = ("glb", "b3dm", "i3dm", "cmpt", "pnts", "json")
TILESET_ENDINGS = (".json", ".tileset.gltf", ".tileset.glb")
TILE, CONTENT, SUBTREE, LOADED, REACHABLE = 1, 2, 4, 8, 16
FLAGS = {"tile": TILE, "content": CONTENT, "subtree": SUBTREE, "loaded": LOADED, "reachable": REACHABLE}


def tile_format(url: Column, data: Column | None = None) -> Column:
    """Format by magic bytes if they are known, else by the extension before any `?`; else `unknown`."""
    name = F.lower(F.substring_index(F.substring_index(url, "?", 1), ".", -1))
    by_name = F.when(name.isin(*EXTENSIONS), name).otherwise("unknown")
    if data is None:
        return F.coalesce(by_name, F.lit("unknown"))
    head = F.hex(F.substr(data, F.lit(1), F.lit(4)))
    by_magic = F.element_at(F.create_map(*(F.lit(x) for pair in MAGIC.items() for x in pair)), head)
    return F.coalesce(by_magic, by_name, F.lit("unknown"))


def is_external_tileset(url: Column) -> Column:
    """Whether the address, without query and fragment, ends like a tileset's."""
    plain = F.lower(F.regexp_extract(url, r"^[^?#]*", 0))
    found = F.lit(False)
    for ending in TILESET_ENDINGS:
        found = found | F.endswith(plain, F.lit(ending))
    return found


def has_flags(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) == mask


def flag_names(flags: Column) -> Column:
    return F.array_compact(F.array(*(F.when(has_flags(flags, m), n) for n, m in FLAGS.items())))
