"""Metadata schemas, property tables, statistics, feature and batch tables, and styles: JSON descriptors as rows.

Each function takes rows (id, doc VARIANT) and explodes one dictionary of the document, in key order, with the format's
defaults filled in. What a descriptor doesn't name stays in `extensions` or in the VARIANT it came from. Nothing here
decodes property columns, computes statistics or evaluates style expressions; the documents only describe them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extensions
from .tilesets import field, member_of

# Defaults of the format.
ENUM_VALUE_TYPE, OFFSET_TYPE, POINT_SIZE, COLOR, SHOW = "UINT16", "UINT32", "1.0", "color('#FFFFFF')", "true"
#: Keys of feature tables that are counts or offsets of a whole; all other keys are properties.
FEATURE_COUNTS = ("BATCH_LENGTH", "INSTANCES_LENGTH", "POINTS_LENGTH")
#: A class property: column, key, type. VARIANT keeps numbers, arrays and strings apart.
PROPERTY = (
    ("name", "name", "string"), ("description", "description", "string"), ("type", "type", "string"), ("component_type", "componentType", "string"), ("enum_type", "enumType", "string"), ("count", "count", "bigint"),
    ("semantic", "semantic", "string"), ("min", "min", "variant"), ("max", "max", "variant"), ("offset", "offset", "variant"), ("scale", "scale", "variant"), ("no_data", "noData", "variant"), ("default", "default", "variant"),
)
FLAGS = ("array", "normalized", "required")


def entries(v: Column, path: str) -> Column:
    """A dictionary of a VARIANT as an array of struct<key, value>, in key order; empty if absent or null."""
    found = field(v, path, "map<string,variant>") if path else F.try_variant_get(v, "$", "map<string,variant>")
    return F.coalesce(F.map_entries(found), F.array().cast("array<struct<key:string,value:variant>>"))


def listed(v: Column, path: str) -> Column:
    return F.coalesce(field(v, path, "array<variant>"), F.array().cast("array<variant>"))


def open_members(v: Column) -> list[Column]:
    """extensions and extras (VARIANT) of an object; null where absent or empty."""
    found = field(v, "extensions", "variant")
    return [F.when(F.size(field(v, "extensions", "map<string,variant>")) > 0, found).alias("extensions"), member_of(v, "extras").alias("extras")]


def classes(docs: DataFrame) -> DataFrame:
    """id, class_id, name, description, n_properties, extensions, extras."""
    rows = docs.select("id", F.explode(entries(F.col("doc"), "classes")).alias("c"))
    return rows.select("id", F.col("c.key").alias("class_id"), field(F.col("c.value"), "name", "string").alias("name"), field(F.col("c.value"), "description", "string").alias("description"), F.size(entries(F.col("c.value"), "properties")).alias("n_properties"), *open_members(F.col("c.value")))


def class_properties(docs: DataFrame) -> DataFrame:
    """id, class_id, property_id, the columns of PROPERTY, FLAGS (false unless given), extensions, extras."""
    rows = docs.select("id", F.explode(entries(F.col("doc"), "classes")).alias("c")).select("id", F.col("c.key").alias("class_id"), F.explode(entries(F.col("c.value"), "properties")).alias("p"))
    v = F.col("p.value")
    return rows.select("id", "class_id", F.col("p.key").alias("property_id"), *(field(v, k, ddl).alias(c) for c, k, ddl in PROPERTY), *(F.coalesce(field(v, k, "boolean"), F.lit(False)).alias(k) for k in FLAGS), *open_members(v))


def enum_heads(docs: DataFrame) -> DataFrame:
    """id, enum_id, name, description, value_type, extensions, extras."""
    rows = docs.select("id", F.explode(entries(F.col("doc"), "enums")).alias("e"))
    v = F.col("e.value")
    kind = F.coalesce(field(v, "valueType", "string"), F.lit(ENUM_VALUE_TYPE))
    return rows.select("id", F.col("e.key").alias("enum_id"), *(field(v, k, "string").alias(k) for k in ("name", "description")), kind.alias("value_type"), *open_members(v))


def enums(docs: DataFrame) -> DataFrame:
    """id, enum_id, value_type, ord, name, value, description, extensions, extras: a row for each value of an enum."""
    rows = docs.select("id", F.explode(entries(F.col("doc"), "enums")).alias("e"))
    kind = F.coalesce(field(F.col("e.value"), "valueType", "string"), F.lit(ENUM_VALUE_TYPE))
    rows = rows.select("id", F.col("e.key").alias("enum_id"), kind.alias("value_type"), F.posexplode(listed(F.col("e.value"), "values")).alias("ord", "v"))
    return rows.select("id", "enum_id", "value_type", "ord", field(F.col("v"), "name", "string").alias("name"), field(F.col("v"), "value", "bigint").alias("value"), field(F.col("v"), "description", "string").alias("description"), *open_members(F.col("v")))


def entity(v: Column) -> Column:
    """struct<class, properties> of a metadata entity."""
    return F.struct(field(v, "class", "string").alias("class"), field(v, "properties", "map<string,variant>").alias("properties"))


def property_tables(docs: DataFrame) -> DataFrame:
    """id, table_ord, class, count, property_id, values, array_offsets, array_offset_type, string_offsets, string_offset_type."""
    t = docs.select("id", F.posexplode(listed(F.col("doc"), "propertyTables")).alias("table_ord", "t"))
    p = t.select("id", "table_ord", field(F.col("t"), "class", "string").alias("class"), field(F.col("t"), "count", "bigint").alias("count"), F.explode_outer(entries(F.col("t"), "properties")).alias("p"))
    v = F.col("p.value")
    kind = lambda k: F.coalesce(field(v, k, "string"), F.lit(OFFSET_TYPE))
    number = lambda k: field(v, k, "bigint")
    return p.select(
        "id", "table_ord", "class", "count", F.col("p.key").alias("property_id"), number("values").alias("values"), number("arrayOffsets").alias("array_offsets"), kind("arrayOffsetType").alias("array_offset_type"),
        number("stringOffsets").alias("string_offsets"), kind("stringOffsetType").alias("string_offset_type"),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """id, class_id, count, property_id, and what is stored of it: min, max, mean, median, standard_deviation, variance, sum (VARIANT), occurrences."""
    c = docs.select("id", F.explode(entries(F.col("doc"), "classes")).alias("c")).select("id", F.col("c.key").alias("class_id"), field(F.col("c.value"), "count", "bigint").alias("count"), F.explode_outer(entries(F.col("c.value"), "properties")).alias("p"))
    v, names = F.col("p.value"), {"min": "min", "max": "max", "mean": "mean", "median": "median", "standard_deviation": "standardDeviation", "variance": "variance", "sum": "sum"}
    return c.select("id", "class_id", "count", F.col("p.key").alias("property_id"), *(field(v, k, "variant").alias(n) for n, k in names.items()), field(v, "occurrences", "map<string,bigint>").alias("occurrences"))


def feature_table(docs: DataFrame) -> DataFrame:
    """id, length (of instances, points or batches), property, kind, value of each further key of a feature table."""
    length = F.coalesce(*(field(F.col("doc"), k, "bigint") for k in FEATURE_COUNTS))
    rows = docs.select("id", length.alias("length"), F.explode(F.filter(entries(F.col("doc"), ""), lambda e: ~e["key"].isin(*FEATURE_COUNTS, "extensions", "extras"))).alias("e"))
    return rows.select("id", "length", F.col("e.key").alias("property"), extensions.union_kind(F.col("e.value"), extensions.FEATURE_PROPERTY).alias("kind"), F.col("e.value").alias("value"))


def batch_table(docs: DataFrame) -> DataFrame:
    """id, property, kind (reference or array), value of each key of a batch table."""
    kinds = {k: extensions.FEATURE_PROPERTY[k] for k in ("reference", "array")}
    rows = docs.select("id", F.explode(F.filter(entries(F.col("doc"), ""), lambda e: ~e["key"].isin("extensions", "extras"))).alias("e"))
    return rows.select("id", F.col("e.key").alias("property"), extensions.union_kind(F.col("e.value"), kinds).alias("kind"), F.col("e.value").alias("value"))


def styles(docs: DataFrame) -> DataFrame:
    """id, color, color_kind, show, show_kind, point_size, defines, meta: a style's JSON parts, with its defaults."""
    given = lambda k, default: F.coalesce(field(F.col("doc"), k, "variant"), F.parse_json(F.lit(default)))
    parts = docs.select("id", given("color", f'"{COLOR}"').alias("c"), given("show", f'"{SHOW}"').alias("s"), given("pointSize", POINT_SIZE).alias("p"), "doc")
    kind = lambda c: extensions.union_kind(F.col(c), extensions.STYLE)
    return parts.select(
        "id", F.to_json("c").alias("color"), kind("c").alias("color_kind"), F.to_json("s").alias("show"), kind("s").alias("show_kind"), F.to_json("p").alias("point_size"),
        field(F.col("doc"), "defines", "map<string,string>").alias("defines"), field(F.col("doc"), "meta", "map<string,string>").alias("meta"),
    )


def open_map(docs: DataFrame, path: str = "") -> DataFrame:
    """id, key, value (VARIANT): the free members of an open object, as an extension or a style's meta is one, but for its extensions and extras."""
    rows = docs.select("id", F.explode(F.filter(entries(F.col("doc"), path), lambda e: ~e["key"].isin("extensions", "extras"))).alias("e"))
    return rows.select("id", F.col("e.key").alias("key"), F.col("e.value").alias("value"))


def conditions(docs: DataFrame, key: str = "color") -> DataFrame:
    """id, ord, condition, result of a style's conditional colour or visibility."""
    rows = docs.select("id", F.posexplode(F.coalesce(field(F.col("doc"), f"{key}.conditions", "array<array<string>>"), F.array().cast("array<array<string>>"))).alias("ord", "c"))
    return rows.select("id", "ord", F.get("c", F.lit(0)).alias("condition"), F.get("c", F.lit(1)).alias("result"))


def member(name: str, text: Column) -> Column:
    return F.when(text.isNotNull(), F.concat(F.lit(f'"{name}":'), text))


def quoted(text: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def dictionary(rows: DataFrame, keys: list[str], name: str, text: Column, to: str) -> DataFrame:
    """JSON objects of rows grouped by keys, each member named by a column, in order of its name."""
    made = F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), text.alias("t"))))
    return rows.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(F.transform(made, lambda e: F.concat(quoted(e["n"]), F.lit(":"), e["t"])), ","), F.lit("}")).alias(to))


def write_schema(docs: DataFrame) -> DataFrame:
    """id, json: schemas written anew, with defaults (and a property's type, even if null) written out and what is empty left out."""
    object_ = lambda *members: F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*members)), ","), F.lit("}"))
    said = lambda *names: [member(k, F.when(F.col(k).isNotNull(), quoted(F.col(k)))) for k in names]
    more = [member(k, F.to_json(k)) for k in ("extensions", "extras")]
    p = class_properties(docs)
    value = lambda c, ddl: F.to_json(c) if ddl == "variant" else quoted(F.col(c)) if ddl == "string" else F.col(c).cast("string")
    given = [member(k, F.coalesce(F.when(F.col(c).isNotNull(), value(c, ddl)), F.lit("null") if k == "type" else F.lit(None).cast("string"))) for c, k, ddl in PROPERTY]
    properties = dictionary(p, ["id", "class_id"], "property_id", object_(*given, *(member(k, F.col(k).cast("string")) for k in FLAGS), *more), "properties")
    c = classes(docs).join(properties, ["id", "class_id"], "left")
    c = dictionary(c, ["id"], "class_id", object_(*said("description", "name"), member("properties", F.col("properties")), *more), "classes")
    one = object_(*said("description", "name"), member("value", F.col("value").cast("string")), *more)
    values = enums(docs).groupBy("id", "enum_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("t")))), lambda v: v["t"]), ",").alias("values"))
    e = enum_heads(docs).join(values, ["id", "enum_id"], "left")
    text = object_(*said("description", "name"), member("valueType", quoted(F.col("value_type"))), member("values", F.concat(F.lit("["), F.coalesce("values", F.lit("")), F.lit("]"))), *more)
    e = dictionary(e, ["id"], "enum_id", text, "enums")
    head = docs.select("id", *(field(F.col("doc"), k, "string").alias(k) for k in ("name", "description", "version")), field(F.col("doc"), "id", "string").alias("schema_id"), *open_members(F.col("doc")))
    whole = object_(member("classes", F.col("classes")), *said("description"), member("enums", F.col("enums")), member("id", quoted(F.col("schema_id"))), *said("name", "version"), *more)
    return head.join(c, "id", "left").join(e, "id", "left").select("id", whole.alias("json"))
