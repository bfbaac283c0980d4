"""Types of the members of tile-tree documents, as SQL expressions over VARIANT.

A type is a function of the SQL text of a VARIANT; it gives SQL that is null where the value fits, and else the path of the
member that doesn't, from the value on (an empty string for the value itself). So a document is checked by one expression,
without a UDF; as text, it is built in no time. Numbers written with a fraction (1.0) are no integers; a wrong member is
wrong however deep it lies; members that a type doesn't name are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Type = Callable[[str], str]
NOTHING = "CAST(NULL AS STRING)"
names = itertools.count()


def read_json(text: Column) -> Column:
    """The VARIANT of a JSON text, null if it is none. Spark's parser stops behind the first value, so the text is read as the first of two members of an array, the other being its hash; whatever follows it breaks that."""
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def read(t: Column, mark: Column) -> Column:
        both = F.try_parse_json(F.concat(F.lit("["), t, F.lit(","), mark.cast("string"), F.lit("]")))
        return once(both, lambda v: F.when((get(v, "$[1]", "bigint") == mark) & get(v, "$[2]", "variant").isNull(), get(v, "$[0]", "variant")))

    return once(text, lambda t: once(F.xxhash64(t), lambda m: read(t, m)))


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, use: Callable[[str], str]) -> str:
    """use(name), with value evaluated once under that name."""
    name = f"v{next(names)}"
    return f"get(transform(array({value}), {name} -> {use(name)}), 0)"


def member(v: str, name: str, ddl: str = "variant") -> str:
    return f"try_variant_get({v}, '$.{name}', '{ddl}')"


def leaf(fits: Callable[[str], str]) -> Type:
    return lambda v: f"IF(coalesce({fits(v)}, false), {NOTHING}, '')"


def written(pattern: str) -> Type:
    """A value that is written as one of some kinds."""
    return leaf(lambda v: f"rlike(schema_of_variant({v}), {quoted(pattern)})")


def anything(v: str) -> str:
    return NOTHING


def whole(v: str) -> str:
    """Whether a VARIANT is an unsigned integer of 64 bits."""
    value = f"try_variant_get({v}, '$', 'decimal(38,0)')"
    return f"(schema_of_variant({v}) IN ('BIGINT', 'DECIMAL(19,0)', 'DECIMAL(20,0)') AND {value} >= 0 AND {value} < {2**64})"


def plainly(pattern: str, of: Type) -> Type:
    """A type that a value surely fits if its JSON text is of a pattern, which is many times cheaper to tell; if it isn't, all of it is checked."""
    return lambda v: f"IF(coalesce(rlike(to_json({v}), {quoted(f'^{pattern}$')}), false), {NOTHING}, {of(v)})"


def list_of(n: int) -> str:
    """The text of an array of n numbers."""
    one = "[-+0-9.eE]++"
    return rf"\[{one}(?:,{one}){{{n - 1}}}\]"


#: The text of a string without escapes.
PLAIN = r'"[^"\\]*+"'


def floats(n: int) -> Type:
    """An array of n numbers."""
    each = lambda v: let(f"try_variant_get({v}, '$', 'array<variant>')", lambda a: f"size({a}) = {n} AND forall({a}, x -> {number('x')} IS NULL)")
    return plainly(list_of(n), leaf(each))


def one_of(*values: str) -> Type:
    return leaf(lambda v: f"schema_of_variant({v}) = 'STRING' AND try_variant_get({v}, '$', 'string') IN ({', '.join(map(quoted, values))})")


def first(found: str) -> str:
    return f"get(filter({found}, x -> x IS NOT NULL), 0)"


def within(name: str, fault: str) -> str:
    """A fault of a member (name: SQL), as one of its owner."""
    return let(fault, lambda x: f"IF({x} = '', {name}, concat({name}, '.', {x}))")


def listed(of: Type) -> Type:
    def check(v: str) -> str:
        x, i = f"v{next(names)}", f"v{next(names)}"
        return let(f"try_variant_get({v}, '$', 'array<variant>')", lambda a: f"IF({a} IS NULL, '', {first(f'transform({a}, ({x}, {i}) -> {within(f"string({i})", of(x))})')})")

    return check


def dictionary(of: Type) -> Type:
    def check(v: str) -> str:
        e = f"v{next(names)}"
        return let(f"try_variant_get({v}, '$', 'map<string,variant>')", lambda m: f"IF({m} IS NULL, '', {first(f'transform(map_entries({m}), {e} -> {within(f"{e}.key", of(f"{e}.value"))})')})")

    return check


def need(of: Type) -> tuple:
    return of, False, False


def maybe(of: Type) -> tuple:
    """May be absent or null."""
    return of, True, True


def given(of: Type) -> tuple:
    """May be absent, but isn't null."""
    return of, True, False


# Texts of documents that have only the commonest members, in the order of their names, without white space: where one matches, nothing can be wrong.
# Unlike list_of(), these are for texts that may be no JSON. Longer numbers, and -0.0, which VARIANT reads as 0.0, don't match; possessive, so that no text is too long for the matcher.
JSON_NUMBER = r"(?!-0(?:\.0++)?+(?![0-9.]))-?(?:0|[1-9][0-9]{0,17}+)(?:\.[0-9]{1,17}+)?+(?:[eE][-+]?[0-9]{1,2}+)?+"
JSON_STRING = r'"[^"\\\x00-\x1F]*+"'
EMPTY = r"\{\}"
#: Levels below the root that a matching document has at most, and its bytes.
PLAIN_LEVELS, PLAIN_BYTES = 3, 1 << 20
PLAIN_TILE = "boundingVolume:struct<box:array<double>,region:array<double>,sphere:array<double>>,content:struct<uri:string>,contents:array<struct<uri:string>>,geometricError:double,refine:string,transform:array<double>"


def json_list(item: str, n: int | None = None) -> str:
    """The text of an array of n items, or of any number of them."""
    return rf"\[{item}(?:,{item}){{{n - 1}}}\]" if n else rf"\[(?:{item}(?:,(?!\])|(?=\])))*+\]"


def plain_volume() -> str:
    return rf'\{{(?:"box":{json_list(JSON_NUMBER, 12)}|"region":{json_list(JSON_NUMBER, 6)}|"sphere":{json_list(JSON_NUMBER, 4)})?+\}}'


def plain_tile(children: str) -> str:
    """The pattern of a tile with children of a pattern."""
    content = rf'\{{"uri":{JSON_STRING}\}}'
    return (
        rf'\{{"boundingVolume":{plain_volume()}(?:,"children":{json_list(children)})?+(?:,"content":{content})?+(?:,"contents":{json_list(content)})?+'
        rf',"geometricError":{JSON_NUMBER}(?:,"refine":"(?:ADD|REPLACE)")?+(?:,"transform":{json_list(JSON_NUMBER, 16)})?+\}}'
    )


def plain_document(levels: int) -> str:
    """The pattern of a document with some levels below its root at most."""
    tile = r"(?!)"
    for _ in range(levels + 1):
        tile = plain_tile(tile)
    names_ = json_list(JSON_STRING)
    return rf'\A\{{"asset":\{{"version":{JSON_STRING}\}}(?:,"extensionsRequired":{names_})?+(?:,"extensionsUsed":{names_})?+,"geometricError":{JSON_NUMBER},"root":{tile}\}}\z'


def plain_levels(text: Column) -> Column:
    """How many levels a text of the commonest members has below its root; null for any other text."""
    told = F.when(F.octet_length(text) > PLAIN_BYTES, F.lit(None).cast("int"))
    for n in range(PLAIN_LEVELS + 1):
        told = told.when(F.rlike(text, F.lit(plain_document(n))), n)
    return told


def plain_shell(text: Column) -> Column:
    """Whether a tile's text, in which its children are `{}`, is one of the commonest members."""
    return F.rlike(text, F.lit(rf"\A{plain_tile(EMPTY)}\z"))


def plain_kind(levels: int) -> str:
    """The type of a tile of such a text."""
    return f"struct<{PLAIN_TILE},children:array<{plain_kind(levels - 1)}>>" if levels else f"struct<{PLAIN_TILE}>"


#: Members that may hold a whole tree. As VARIANT they'd be copied, so they are read as what costs no copy first: an object or an array, of which nothing is kept.
TREES = {"root": "struct<>", "children": "array<struct<>>"}


def faults(members: dict[str, tuple], get: Callable[..., str]) -> str:
    """The first wrong member of an object, whose members get() gives by name, and by the type that they are read as; null for one that is absent."""

    def fault(of: Type, absent: bool, null: bool) -> Callable[[str], str]:
        said = lambda ok: NOTHING if ok else "''"
        return lambda m: f"CASE WHEN {m} IS NULL THEN {said(absent)} WHEN is_variant_null({m}) THEN {said(null)} ELSE {of(m)} END"

    def judged(name: str, how: tuple) -> str:
        full = let(get(name), fault(*how))
        return f"IF({get(name, TREES[name])} IS NOT NULL, {NOTHING}, {full})" if name in TREES else full

    return f"coalesce({', '.join(within(quoted(name), judged(name, how)) for name, how in members.items())}, {NOTHING})"


def is_object(v: str) -> str:
    return f"(try_variant_get({v}, '$', 'struct<>') IS NOT NULL)"


def is_array(v: str) -> str:
    return f"(try_variant_get({v}, '$', 'array<struct<>>') IS NOT NULL)"


def record(**members: tuple) -> Type:
    """An object whose named members have types."""
    return lambda v: f"IF(NOT {is_object(v)}, '', {faults(members, lambda name, ddl='variant': member(v, name, ddl))})"


text, number, boolean, integer = written("^STRING$"), written("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), written("^BOOLEAN$"), written("^BIGINT$")
unsigned, object_, array = leaf(whole), leaf(is_object), leaf(is_array)

# The members of the format's objects.
OPEN = {"extensions": given(object_), "extras": maybe(anything)}
NAMED = {"name": maybe(text), "description": maybe(text)}
ASSET = plainly(rf'\{{"version":{PLAIN}\}}', record(version=need(text), tilesetVersion=maybe(text), **OPEN))
VOLUME = plainly(rf'\{{(?:"box":{list_of(12)}|"region":{list_of(6)}|"sphere":{list_of(4)})?\}}', record(box=maybe(floats(12)), region=maybe(floats(6)), sphere=maybe(floats(4)), **OPEN))
ENTITY = record(**{"class": need(text)}, properties=maybe(object_), **OPEN)
CONTENT = plainly(rf'\{{"uri":{PLAIN}\}}', record(uri=need(text), boundingVolume=maybe(VOLUME), group=maybe(unsigned), metadata=maybe(ENTITY), **OPEN))
SUBTREES = record(uri=need(text), **OPEN)
#: The names that the format's text uses, and those in capitals that its documents have.
SCHEMES = ("Quadtree", "Octree", "S2", "QUADTREE", "OCTREE")
IMPLICIT = record(availableLevels=need(unsigned), subdivisionScheme=need(one_of(*SCHEMES)), subtreeLevels=need(unsigned), subtrees=need(SUBTREES), **OPEN)
#: A tile by itself; its children, maybe(array), are tiles of their own.
CHILDREN, TILE = maybe(array), dict(
    boundingVolume=need(VOLUME), content=maybe(CONTENT), contents=maybe(listed(CONTENT)), geometricError=need(number), implicitTiling=maybe(IMPLICIT), metadata=maybe(ENTITY),
    refine=maybe(one_of("ADD", "REPLACE")), transform=given(floats(16)), viewerRequestVolume=maybe(VOLUME), **OPEN,
)
FLAG = given(boolean)
PROPERTY = record(**NAMED, array=FLAG, normalized=FLAG, required=FLAG, count=maybe(unsigned), enumType=maybe(text), semantic=maybe(text), **OPEN)
CLASS = record(**NAMED, properties=maybe(dictionary(PROPERTY)), **OPEN)
ENUM = record(**NAMED, values=need(listed(record(name=need(text), description=maybe(text), value=need(integer), **OPEN))), **OPEN)
SCHEMA = record(id=need(text), **NAMED, version=maybe(text), classes=maybe(dictionary(CLASS)), enums=maybe(dictionary(ENUM)), **OPEN)
STATISTICS = record(classes=maybe(dictionary(record(count=maybe(unsigned), properties=maybe(dictionary(record(occurrences=maybe(object_), **OPEN))), **OPEN))), **OPEN)
#: A document without its root.
TILESET_MEMBERS = dict(
    asset=need(ASSET), extensionsRequired=maybe(listed(text)), extensionsUsed=maybe(listed(text)), geometricError=need(number), groups=maybe(listed(record(**OPEN))), metadata=maybe(ENTITY),
    properties=maybe(dictionary(record(maximum=need(number), minimum=need(number), **OPEN))), root=need(anything), schema=maybe(SCHEMA), schemaUri=maybe(text), statistics=maybe(STATISTICS), **OPEN,
)
TILESET = record(**TILESET_MEMBERS)
#: Of the root only whether it is an object.
HEAD_MORE = ",root:struct<>"

COLUMN = record(
    arrayOffsetType=maybe(anything), arrayOffsets=maybe(unsigned), max=maybe(anything), min=maybe(anything), offset=maybe(anything), scale=maybe(anything), stringOffsetType=maybe(anything), stringOffsets=maybe(unsigned),
    values=need(unsigned), **OPEN,
)
PROPERTY_TABLE = record(**{"class": need(text)}, count=need(unsigned), name=maybe(text), properties=maybe(dictionary(COLUMN)), **OPEN)
AVAILABILITY = record(availableCount=maybe(unsigned), bitstream=maybe(unsigned), constant=maybe(unsigned), **OPEN)
BUFFER = record(byteLength=need(unsigned), name=maybe(text), uri=maybe(text), **OPEN)
BUFFER_VIEW = record(buffer=need(unsigned), byteLength=need(unsigned), byteOffset=need(unsigned), name=maybe(text), **OPEN)
SUBTREE = record(
    bufferViews=maybe(listed(BUFFER_VIEW)), buffers=maybe(listed(BUFFER)), childSubtreeAvailability=need(AVAILABILITY), contentAvailability=maybe(listed(AVAILABILITY)), contentMetadata=maybe(listed(unsigned)),
    propertyTables=maybe(listed(PROPERTY_TABLE)), subtreeMetadata=maybe(ENTITY), tileAvailability=need(AVAILABILITY), tileMetadata=maybe(unsigned), **OPEN,
)


def subtree_fault(subtree: str) -> Column:
    return F.expr(SUBTREE(subtree))


#: The commonest members of a document and of a tile, and the JSON text of them by which nothing can be wrong with them.
COMMON_HEAD = ("asset", "extensionsRequired", "extensionsUsed", "geometricError")
COMMON_TILE = ("boundingVolume", "content", "geometricError", "refine", "transform", "viewerRequestVolume")
HEAD_TEXT = rf'\A\{{"asset":\{{"version":{JSON_STRING}\}}(?:,"extensionsRequired":{json_list(JSON_STRING)})?+(?:,"extensionsUsed":{json_list(JSON_STRING)})?+,"geometricError":{JSON_NUMBER}\}}\z'
TILE_TEXT = (
    rf'\A\{{"boundingVolume":{plain_volume()}(?:,"content":\{{"uri":{JSON_STRING}\}})?+,"geometricError":{JSON_NUMBER}(?:,"refine":"(?:ADD|REPLACE)")?+(?:,"transform":{json_list(JSON_NUMBER, 16)})?+'
    rf'(?:,"viewerRequestVolume":{plain_volume()})?+\}}\z'
)


def own_members(v: Column, named: dict[str, tuple], more: str = "") -> Column:
    """The members of an object, all read at once, as a struct of VARIANT."""
    return F.try_variant_get(v, "$", f"struct<{','.join(f'`{k}`:variant' for k in named if k not in TREES)}{more}>")


def only(common: tuple[str, ...], named: dict[str, tuple], text: str, get: Callable[[str], Column]) -> Column:
    """Whether no members but the commonest are there, and these by their text as they should be. A short way for most; what isn't told here is checked member by member."""
    absent = [get(k).isNull() for k in named if k not in common and k not in TREES]
    return F.coalesce(reduce(Column.__and__, absent) & F.rlike(F.to_json(F.struct(*(get(k).alias(k) for k in common))), F.lit(text)), F.lit(False))


def tileset_fault(doc: str, head: str | None = None) -> Column:
    """What is wrong in a document. head: a column of own_members(TILESET_MEMBERS, HEAD_MORE) of it, if there is one."""
    full = F.expr(TILESET(doc))
    if not head:
        return full
    return F.when(~(only(COMMON_HEAD, TILESET_MEMBERS, HEAD_TEXT, lambda k: F.col(f"{head}.{k}")) & F.col(f"{head}.root").isNotNull()), full)


def tile_fault(name: str) -> Column:
    """Of columns named as a tile's members, and odd, what is wrong with the tile as a whole."""
    full = F.expr(within(name, f"coalesce(odd, {faults(TILE, lambda k, _='variant': f'`{k}`')})"))
    return F.when(F.col("odd").isNotNull() | ~only(COMMON_TILE, TILE, TILE_TEXT, F.col), full)


def root_fault(doc: str) -> str:
    """What is wrong with a document's root tile itself, by paths from the document, so that the tree isn't copied."""
    one = lambda m: faults(m, lambda name, ddl="variant": member(doc, f"root.{name}", ddl))
    return within("'root'", f"IF({member(doc, 'root', 'struct<>')} IS NULL, '', coalesce({one({'children': CHILDREN})}, {one(TILE)}))")


def odd_fault(tile: str) -> Column:
    """What is wrong with a tile as a whole, or with its list of children."""
    children = lambda ddl: F.expr(member(tile, "children", ddl))
    fine = F.expr(is_object(tile)) & (children(TREES["children"]).isNotNull() | children("variant").isNull())
    return F.when(~fine, F.expr(f"IF(NOT {is_object(tile)}, '', {faults({'children': CHILDREN}, lambda name, ddl='variant': member(tile, name, ddl))})"))
