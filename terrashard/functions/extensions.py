"""Extension payloads in maps of VARIANT, bookkeeping of used and required extensions, sorted maps, tagged unions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bits import let


def has(extensions: Column, name: str) -> Column:
    return F.coalesce(F.map_contains_key(extensions, F.lit(name)), F.lit(False))


def fits(value: Column, kind: T.DataType) -> Column:
    """Whether a VARIANT, that isn't null, is written as a type: no text as a number, no 1.0 as an integer. Members of structs may be absent or null; other members are ignored."""
    schema, get = F.schema_of_variant(value), lambda ddl: F.try_variant_get(value, "$", ddl)
    if isinstance(kind, T.VariantType):
        return F.lit(True)
    if isinstance(kind, T.ArrayType):
        return let(get("array<variant>"), lambda a: F.coalesce(F.forall(a, lambda x: F.is_variant_null(x) | fits(x, kind.elementType)), F.lit(False)))
    if isinstance(kind, T.MapType):
        return let(get("map<string,variant>"), lambda m: F.coalesce(F.forall(F.map_values(m), lambda x: F.is_variant_null(x) | fits(x, kind.valueType)), F.lit(False)))
    if isinstance(kind, T.StructType):
        of = lambda m, f: let(F.try_element_at(m, F.lit(f.name)), lambda x: x.isNull() | F.coalesce(F.is_variant_null(x), F.lit(False)) | fits(x, f.dataType))
        both = lambda m: F.forall(F.array(F.lit(True), *(of(m, f) for f in kind.fields)), lambda ok: F.coalesce(ok, F.lit(False)))
        return let(get("map<string,variant>"), lambda m: F.when(m.isNull(), F.lit(False)).otherwise(both(m)))
    written = {"string": "^STRING$", "boolean": "^BOOLEAN$", "bigint": "^BIGINT$", "int": "^BIGINT$", "double": NUMBER, "float": NUMBER}
    found = F.rlike(schema, F.lit(written[kind.simpleString()]))
    return F.coalesce(found & get(kind.simpleString()).isNotNull(), F.lit(False))


def payload(extensions: Column, name: str, ddl: str, required: tuple[str, ...] = (), *, strict: bool = False) -> Column:
    """The payload of an extension as a struct of the given DDL; null if absent.

    A payload that lacks a required field or isn't written as the DDL has it (see fits()) is null too, or an error if strict.
    """

    def read(raw: Column) -> Column:
        got = F.try_variant_get(raw, "$", ddl)
        ok = fits(raw, T.DataType.fromDDL(ddl))
        for field in required:
            ok = ok & got[field].isNotNull()
        bad = F.raise_error(F.lit(f"<extension {name}>: payload doesn't fit")).cast(ddl) if strict else F.lit(None).cast(ddl)
        return F.when(raw.isNull(), F.lit(None).cast(ddl)).when(F.coalesce(ok, F.lit(False)), got).otherwise(bad)

    return let(F.try_element_at(extensions, F.lit(name)), read)


def put(extensions: Column, name: str, value: Column) -> Column:
    """The map with an entry added or replaced."""
    return F.map_concat(remove(extensions, name), F.create_map(F.lit(name), value))


def remove(extensions: Column, name: str) -> Column:
    return F.map_filter(F.coalesce(extensions, F.create_map().cast("map<string,variant>")), lambda k, v: k != name)


def mark_used(used: Column, name: str) -> Column:
    return F.when(F.array_contains(used, name), used).otherwise(F.array_append(used, F.lit(name)))


def mark_required(used: Column, required: Column, name: str) -> tuple[Column, Column]:
    """Used and required with name in both."""
    return mark_used(used, name), mark_used(required, name)


def unmark_used(used: Column, required: Column, name: str) -> tuple[Column, Column]:
    """Used and required with name in neither."""
    return F.array_remove(used, name), F.array_remove(required, name)


def unmark_required(required: Column, name: str) -> Column:
    """Required without name; used keeps it."""
    return F.array_remove(required, name)


def sorted_map(entries: Column) -> Column:
    """A map in key order of an array of struct<key, value>; of equal keys the first entry stays. One sort; then neighbours are compared."""
    places = F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["value"].alias("value")))
    before = lambda a, b: F.when((a["key"] < b["key"]) | ((a["key"] == b["key"]) & (a["i"] < b["i"])), -1).when((a["key"] == b["key"]) & (a["i"] == b["i"]), 0).otherwise(1)
    ordered = F.array_sort(places, before)
    first = let(ordered, lambda es: F.filter(es, lambda e, i: F.coalesce(F.get(es, i - 1)["key"] != e["key"], F.lit(True))))
    return F.map_from_entries(F.transform(first, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))


def union_kind(value: Column, alternatives: dict[str, str]) -> Column:
    """The first alternative that a VARIANT fits. Each is a name and what it takes: a regular expression for schema_of_variant."""
    schema = F.schema_of_variant(value)
    out = F.lit(None).cast("string")
    for name, pattern in reversed(alternatives.items()):
        out = F.when(F.rlike(schema, F.lit(pattern)), F.lit(name)).otherwise(out)
    return out


NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"
FEATURE_PROPERTY = {"reference": r"^OBJECT<.*byteOffset: ", "boolean": "^BOOLEAN$", "integer": "^BIGINT$", "number": NUMBER, "array": "^ARRAY<"}
GLOBAL_NUMBER = {"offset": r"^OBJECT<.*byteOffset: BIGINT", "number": NUMBER}
BOOLEAN_EXPRESSION = {"boolean": "^BOOLEAN$", "expression": "^STRING$"}
NUMBER_EXPRESSION = {"number": NUMBER, "expression": "^STRING$"}
STYLE = {"expression": "^(STRING|BOOLEAN)$", "conditions": "^OBJECT<"}
#: Payload of the mesh-feature extension; a feature id must have a count.
MESH_FEATURES = "struct<featureIds:array<struct<featureCount:bigint,attribute:bigint,propertyTable:bigint,label:string>>>"


def mesh_features(value: Column) -> Column:
    """A VARIANT as mesh features; null unless every feature id has its count, and all numbers are unsigned ones of 32 bits."""
    got = F.try_variant_get(value, "$", MESH_FEATURES)
    numbers = lambda f: F.array(f["featureCount"], f["attribute"], f["propertyTable"])
    unsigned = lambda f: f["featureCount"].isNotNull() & F.forall(numbers(f), lambda n: F.coalesce(n.between(0, 2**32 - 1), F.lit(True)))
    return F.when(fits(value, T.DataType.fromDDL(MESH_FEATURES)) & got["featureIds"].isNotNull() & F.forall(got["featureIds"], unsigned), got)
