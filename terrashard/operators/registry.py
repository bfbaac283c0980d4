"""A catalogue of extensions: every place in a document where one stands, and whether its payload is as the catalogue has it.

A catalogue maps names to types (DDL). sites() goes through whole documents, STRIDE levels in one pass over all of them, and keeps what lies in
members called `extensions`, wherever they are (also within payloads, but not within `extras`, which are free). decoded() gives the payloads of one name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import extensions
from ..storage import settle

STRIDE = 4
#: Levels that any document has at most; VARIANT itself nests no deeper.
MOST_LEVELS = 1000
SITE, FREE = "extensions", "extras"


def members(value: Column) -> Column:
    """The members of an object, or the items of an array, as an array of struct<key, value>; null for anything else."""
    of_object = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    of_array = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value")))
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), of_object).when(F.startswith(F.schema_of_variant(value), F.lit("ARRAY")), of_array)


def sites(documents: DataFrame, catalogue: dict[str, str], *, doc: str = "doc") -> DataFrame:
    """The columns of documents but doc, and path (of the object that is extended, an array of keys and places), name, verdict (fits, misfit or unknown) and payload (VARIANT).

    Documents are rows, each looked at by itself; a null document has no sites. Columns may have any name: they travel as one.
    """
    given = F.struct(*(F.col(f"`{c}`") for c in documents.columns if c != doc), F.lit(1).alias("_one"))
    open_ = documents.where(F.col(f"`{doc}`").isNotNull()).select(given.alias("given"), F.array().cast("array<string>").alias("path"), F.col(f"`{doc}`").alias("value"))

    def opened(level: DataFrame) -> DataFrame:
        one = lambda path, value, todo: F.struct(path.alias("path"), value.alias("value"), F.lit(todo).alias("todo"))
        below = F.transform(F.filter(members(F.col("value")), lambda m: (m["key"] != FREE) & F.rlike(F.schema_of_variant(m["value"]), F.lit("^(OBJECT|ARRAY)"))), lambda m: one(F.array_append("path", m["key"]), m["value"], True))
        site = F.try_element_at("path", F.lit(-1)) == SITE
        kept = F.when(F.coalesce(site, F.lit(False)), F.array(one(F.col("path"), F.col("value"), False))).otherwise(F.array().cast("array<struct<path:array<string>,value:variant,todo:boolean>>"))
        here = F.array(one(F.col("path"), F.col("value"), False))
        return level.select("given", F.inline(F.when(F.col("todo"), F.concat(kept, F.coalesce(below, F.array().cast("array<struct<path:array<string>,value:variant,todo:boolean>>")))).otherwise(here)))

    found = []
    for _ in range(0, MOST_LEVELS, STRIDE):
        level = open_.withColumn("todo", F.lit(True))
        for _ in range(STRIDE):
            level = opened(level)
        done = settle(level, "sites")
        found.append(done.where("not todo").drop("todo"))
        open_ = done.where("todo").drop("todo")
        if open_.isEmpty():
            break
    entry = F.explode(F.map_entries(F.try_variant_get("value", "$", "map<string,variant>"))).alias("e")
    each = reduce(DataFrame.union, found).select("given", F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), entry)
    verdict = F.lit("unknown")
    for name, ddl in catalogue.items():
        fits = F.coalesce(~F.is_variant_null("e.value") & extensions.fits(F.col("e.value"), T.DataType.fromDDL(ddl)), F.lit(False))
        verdict = F.when(F.col("e.key") == name, F.when(fits, "fits").otherwise("misfit")).otherwise(verdict)
    return each.select("given.*", "path", F.col("e.key").alias("name"), verdict.alias("verdict"), F.col("e.value").alias("payload")).drop("_one")


def decoded(found: DataFrame, catalogue: dict[str, str], name: str) -> DataFrame:
    """sites() of one name that fit, with payload as the catalogue's type."""
    fine = found.where((F.col("name") == name) & (F.col("verdict") == "fits"))
    return fine.withColumn("payload", F.try_variant_get("payload", "$", catalogue[name]))
