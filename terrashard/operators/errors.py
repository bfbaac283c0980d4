"""Errors are columns (error_code, error_detail); strict() makes them errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What can be wrong with a document (serialize: none here, as what JSON can't hold is written as null), a subtree, or a tiling scheme.
DOCUMENT = ("json", "parse", "serialize")
SUBTREE = ("truncated", "unsupported_version", "invalid_length", "json", "invalid_buffer_view", "invalid_buffer_index", "missing_external_buffer", "buffer_out_of_range")
SCHEMES, TILING = ("quadtree", "octree", "s2"), ("unsupported_implicit_subdivision",)


def scheme_error(scheme: Column, implemented: tuple[str, ...] = SCHEMES) -> Column:
    """struct<error_code, error_detail> where a loader doesn't implement a subdivision scheme (names in any case); null where it does."""
    known = F.lower(scheme).isin(*implemented)
    said = F.concat(F.lit("unsupported implicit subdivision scheme: "), F.coalesce(scheme, F.lit("none")))
    return F.when(~F.coalesce(known, F.lit(False)), F.struct(F.lit(TILING[0]).alias("error_code"), said.alias("error_detail")))


def strict(df: DataFrame) -> DataFrame:
    """df, without its error columns; evaluating a row in error raises, naming the code and the detail."""
    message = F.concat_ws(": ", "error_code", "error_detail")
    fine = F.when(F.col("error_code").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return df.where(fine).drop("error_code", "error_detail")
