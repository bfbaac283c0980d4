"""Diagnostics of tile-tree documents, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tilesets import field


def plain(number: Column) -> Column:
    """A double without a fraction of zero: -1, not -1.0."""
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.cast("bigint").cast("string")).otherwise(number.cast("string"))


def diagnostics(parsed: DataFrame) -> DataFrame:
    """row, tileset_id, ord, code, path, message: negative errors of the document and of its root, then unmet requirements by position."""
    root = field(F.col("doc"), "root.geometricError", "double")

    def negative(value: Column, code: str, path: str) -> Column:
        made = F.struct(F.lit(code).alias("code"), F.lit(path).alias("path"), F.concat(F.lit(f"{path} is negative ("), plain(value), F.lit("); expected >= 0")).alias("message"))
        return F.when(value < 0, F.array(made)).otherwise(F.array().cast("array<struct<code:string,path:string,message:string>>"))

    def unmet(name: Column, i: Column) -> Column:
        path = F.concat(F.lit("extensionsRequired["), i.cast("string"), F.lit("]"))
        made = F.struct(F.lit("tileset.required_extension_not_used").alias("code"), path.alias("path"), F.concat(F.lit("extensionsRequired contains '"), name, F.lit("' which is not listed in extensionsUsed")).alias("message"))
        return F.when(~F.array_contains(F.col("extensions_used"), name), made)

    all_ = F.concat(
        negative(F.col("geometric_error"), "tileset.negative_geometric_error", "geometricError"), negative(root, "tile.negative_geometric_error", "root.geometricError"),
        F.array_compact(F.transform("extensions_required", unmet)),
    )
    rows = parsed.where("error_code is null").select("row", "tileset_id", F.posexplode(all_).alias("ord", "d"))
    return rows.select("row", "tileset_id", "ord", "d.code", "d.path", "d.message")
