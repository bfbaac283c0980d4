"""Tile-tree documents: parse, flatten to one row a tile or content, and nest again.

A document is a row (tileset_id, json), and stays one: rows are numbered, and every later table carries the number (row), so ids may be null
or repeated. parse() checks every member of the document and of all its tiles against the format's types, and keeps the
raw tree as VARIANT beside the header columns; load() does the same and gives the tiles too, from one walk; flatten() walks again.

The walk opens STRIDE levels of all documents in one pass: tiles that it passes are stored with their own members, and what lies
below the last level with them, for the next pass. Work is spread over the tiles. Paths, arrays of child positions, sort in
pre-order. Documents over LARGE bytes, which a VARIANT might not hold, are cut into tiles by their structure (structure.py), and then
treated alike. Documents that can't be read stay as rows with error_code.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from ..storage import discard, fresh, settle, stored_by
from . import members, structure, tokens

IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
VOLUME = "struct<box:array<double>,region:array<double>,sphere:array<double>>"
TILING = "struct<availableLevels:bigint,subdivisionScheme:string,subtreeLevels:bigint,subtrees:struct<uri:string>>"
STRIDE = 4
#: Bytes from which a document is cut by its structure.
LARGE = 16 << 20
# What errors call a document that has no address, and what is said of an empty version.
SLICE, READER, VALIDATED = "<slice>", "<reader>", "<tileset>"
NO_VERSION = "asset.version is required and must not be empty"
#: Tiles deeper than this make their document unreadable: with a volume, they'd lie in more than 127 objects and arrays, the most that the format's reader opens.
MOST_LEVELS = 62
#: Members of tiles that no other column holds; single: whether the first content was the `content`, not one of the `contents`.
REST = "struct<single:boolean,viewerRequestVolume:variant,metadata:variant,extras:variant,boundingVolume:struct<extensions:variant,extras:variant>,implicitTiling:struct<extensions:variant,extras:variant,subtrees:struct<extensions:variant,extras:variant>>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents in files: the file's path is tileset_id, and label in errors."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("tileset_id"), F.col("value").alias("json"))


def field(v: Column, path: str, ddl: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", ddl)


def member_of(v: Column, path: str) -> Column:
    """A member as VARIANT; JSON's null is an absent one."""
    found = field(v, path, "variant")
    return F.when(~F.is_variant_null(found), found)


def more_of(v: Column, path: str = "") -> list[Column]:
    return [member_of(v, f"{path}{k}").alias(k) for k in ("extensions", "extras")]


def header(read_: DataFrame) -> DataFrame:
    """read_ (row, tileset_id, doc, ...) with the columns that stand beside a document, and fault."""
    doc = F.col("doc")
    names = lambda k: F.coalesce(field(doc, k, "array<string>"), F.array().cast("array<string>"))
    return read_.select(
        "*", field(doc, "asset.version", "string").alias("version"), field(doc, "geometricError", "double").alias("geometric_error"),
        names("extensionsUsed").alias("extensions_used"), names("extensionsRequired").alias("extensions_required"),
    )


def judged(first: DataFrame, wrong: DataFrame, label: str | None) -> DataFrame:
    """Documents with their verdicts, fault, no_json, line and column. wrong: row, no_json, fault: what is wrong in their tiles."""
    return verdicts(first.withColumnRenamed("fault", "own").join(wrong, "row", "left"), label)


def verdicts(joined: DataFrame, label: str | None) -> DataFrame:
    """joined: documents with own, what is wrong in them, and no_json and fault as judged() has them."""
    no_json = (F.col("no_doc") & (F.coalesce("own", F.lit("")) == "")) | F.coalesce("no_json", F.lit(False))
    joined = joined.withColumn("no_json", no_json).withColumn("fault", F.when(F.col("no_json"), F.lit("")).otherwise(F.coalesce("own", "fault")))
    code = F.when(F.col("fault").isNotNull(), "json").when(F.col("version") == "", "parse")
    name = F.coalesce(F.lit(label), F.col("tileset_id").cast("string"), F.lit(""))
    twice = F.col("no_doc") & (F.col("own") != "")
    said = F.when(F.col("no_json"), "no JSON").when(twice, F.concat(F.lit("repeated: "), F.col("fault"))).otherwise(F.concat(F.lit("missing or of a wrong type: "), F.col("fault")))
    detail = F.when(code == "json", F.concat(F.lit("failed to parse "), name, F.lit(": "), said)).when(code == "parse", F.concat(F.lit(f"failed to parse {VALIDATED}: {NO_VERSION}")))
    fine = lambda c: F.when(F.col("fault").isNull(), F.col(c)).alias(c)
    return joined.select("row", "tileset_id", "doc", fine("version"), fine("geometric_error"), "extensions_used", "extensions_required", code.alias("error_code"), detail.alias("error_detail"), "fault", "no_json", "line", "column")


def faulty(tiles: DataFrame) -> DataFrame:
    """row, no_json, fault (the first by path) of wrong tiles."""
    wrong = tiles.where("fault is not null")
    return wrong.groupBy("row").agg(F.bool_or("unread").alias("no_json"), F.min_by("fault", F.struct("path", "fault")).alias("fault"))


def examined(read_: DataFrame) -> DataFrame:
    """read_ (row, tileset_id, doc, json, large, levels, line, column) with header columns, fault (of the document, and of its root by itself), deep (whether the root has children that are to be walked) and no_doc, so that verdicts needn't carry doc. Stored."""
    root, plain = F.expr(members.root_fault("doc")), F.col("levels").isNotNull()
    # A root with children is walked, and judged then.
    fault = F.when(~plain, F.when(F.col("doc").isNull(), F.lit("")).otherwise(F.coalesce(members.tileset_fault("doc", "own"), F.when(~F.col("deep"), root))))
    deep = F.when(plain, F.lit(False)).otherwise(F.coalesce(F.size(field(F.col("doc"), "root.children", "array<struct<>>")) > 0, F.lit(False)))
    # No string of a plain text has a quotation mark, so what stands before its root is found as text.
    before = F.concat(F.substring_index("json", ',"root":', 1), F.lit("}"))
    head = F.from_json(F.when(plain, before), "asset struct<version:string>,geometricError double,extensionsUsed array<string>,extensionsRequired array<string>")
    read_ = header(read_).withColumns({"head": head, "own": F.when(~plain, members.own_members(F.col("doc"), members.TILESET_MEMBERS, members.HEAD_MORE)), "deep": deep})
    none = F.array().cast("array<string>")
    told = {"version": F.col("head.asset.version"), "geometric_error": F.col("head.geometricError"), "extensions_used": F.coalesce("head.extensionsUsed", none), "extensions_required": F.coalesce("head.extensionsRequired", none)}
    read_ = read_.withColumns({k: F.when(plain, c).otherwise(F.col(k)) for k, c in told.items()}).drop("head")
    read_ = read_.withColumn("fault", fault).drop("own")
    return settle(read_.withColumn("deep", F.col("deep") & F.col("fault").isNull()).withColumn("no_doc", F.col("doc").isNull() & ~plain), "documents")


class Found(NamedTuple):
    """Whether there are documents that are to be walked, and large ones; the most levels of a plain one below its root (null if there is none); whether there are others."""

    deep: bool
    large: bool
    levels: int | None
    others: bool


def first_of(documents: DataFrame, large: int, texts: bool) -> tuple[DataFrame, Found]:
    """Numbered documents as examined() has them, json only of large, of plain and of unread ones (or, with texts, of all); and what there is among them.

    Plain ones (levels isn't null) have a text that shows that nothing is wrong (members.plain_levels()), as it stands or as VARIANT writes it; they
    are neither checked nor walked as VARIANT, and of the former no VARIANT is made before it is asked for (plain_doc()).

    Where reading a text fails, its tokens are listed: line and column tell the first that is wrong, and objects that repeat
    a key are put right or refused (tokens.without_repeats()).
    """
    big, none = F.coalesce(F.octet_length("json") > large, F.lit(False)), F.lit(None).cast("int")
    told = documents.select(F.monotonically_increasing_id().alias("row"), "tileset_id", "json", big.alias("large"), F.when(~big, members.plain_levels(F.col("json"))).alias("here"))
    read_ = told.select("row", "tileset_id", F.when(~F.col("large") & F.col("here").isNull(), members.read_json(F.col("json"))).alias("doc"), "json", "large", "here")
    read_ = read_.withColumn("text", F.when(F.col("doc").isNotNull(), F.to_json("doc")))
    read_ = read_.withColumn("there", F.when(F.col("text").isNotNull(), members.plain_levels(F.col("text"))))
    held = F.when(F.col("there").isNotNull(), F.col("text")).when(F.col("doc").isNull() | F.lit(texts), F.col("json"))
    first = examined(read_.select("row", "tileset_id", "doc", held.alias("json"), "large", F.coalesce("here", "there").alias("levels"), none.alias("line"), none.alias("column")))
    unread = F.bool_or(F.col("no_doc") & ~F.col("large") & F.col("json").isNotNull())
    count = lambda df: df.agg(F.bool_or("deep"), F.bool_or("large"), F.max("levels"), F.bool_or(F.col("levels").isNull() & ~F.col("large")), unread).first()
    found = count(first)
    if found[4]:
        first = mended(first)
        found = count(first)
    return first, Found(bool(found[0]), bool(found[1]), found[2], bool(found[3]))


def plain_doc() -> Column:
    return F.coalesce("doc", F.try_parse_json("json"))


def plain_verdicts(first: DataFrame, label: str | None) -> DataFrame:
    """judged() of plain documents."""
    said = first.where("levels is not null").withColumn("doc", plain_doc()).withColumnRenamed("fault", "own").withColumns({"fault": F.lit(None).cast("string"), "no_json": F.lit(False)})
    return verdicts(said.drop(*ASIDE), label)


def plain_tiles(first: DataFrame, deepest: int) -> DataFrame:
    """typed() of plain documents without an error, cut from their texts by one reading of each. Nothing is stored."""
    documents = first.where("levels is not null and version <> ''")
    kind = lambda n: members.plain_kind(deepest - n)
    names = ("boundingVolume", "content", "contents", "geometricError", "refine", "transform")
    own = lambda tile: F.struct(*(tile[k].alias(k) for k in names))
    level = documents.select("row", "tileset_id", F.array().cast("array<int>").alias("path"), F.lit(0).alias("ord"), F.from_json("json", f"root {kind(0)}")["root"].alias("tile"))
    level = level.select("row", "tileset_id", "path", "ord", own(F.col("tile")).alias("own"), *([F.col("tile.children").alias("below")] if deepest else []))
    for n in range(1, deepest + 1):
        # Place 0 is the tile itself, the others its children.
        both = F.concat(F.array(F.lit(None).cast(kind(n))), F.coalesce("below", F.array().cast(f"array<{kind(n)}>")))
        each = level.select("row", "tileset_id", "path", "ord", "own", F.posexplode(both).alias("at", "tile"))
        self, i = F.col("at") == 0, F.col("at") - 1
        now = [F.when(self, F.col("path")).otherwise(F.array_append("path", i)).alias("path"), F.when(self, F.col("ord")).otherwise(i).alias("ord"), F.when(self, F.col("own")).otherwise(own(F.col("tile"))).alias("own")]
        level = each.select("row", "tileset_id", *now, *([F.col("tile.children").alias("below")] if n < deepest else []))
    return plain_typed(level)


def plain_typed(level: DataFrame) -> DataFrame:
    """The columns of tiles (row, tileset_id, path, ord, own: members.PLAIN_TILE), as flatten() has them."""
    nothing = F.lit(None).cast("variant")
    variant, empty_ = lambda c: F.to_variant_object(F.struct(c["uri"].alias("uri"))), F.array().cast("array<variant>")
    one = F.when(F.col("own.content").isNotNull(), F.array(variant(F.col("own.content")))).otherwise(empty_)
    blank = [nothing.alias(k) for k in ("extensions", "extras")]
    rest = F.struct(
        F.col("own.content").isNotNull().alias("single"), *(nothing.alias(k) for k in ("viewerRequestVolume", "metadata", "extras")), F.struct(*blank).alias("boundingVolume"),
        F.struct(*blank, F.struct(*blank).alias("subtrees")).alias("implicitTiling"),
    )
    return level.select(
        "row", "tileset_id", "path", F.size("path").alias("depth"), "ord", F.col("own.boundingVolume").alias("bounding_volume"), F.col("own.geometricError").alias("geometric_error"), F.col("own.refine").alias("refine"),
        F.coalesce("own.transform", F.array(*map(F.lit, IDENTITY))).alias("transform"), F.when(F.col("own.contents").isNull(), one).otherwise(F.concat(one, F.transform("own.contents", variant))).alias("contents"),
        F.lit(None).cast(TILING).alias("implicit_tiling"), F.lit(None).cast("map<string,variant>").alias("extensions"), rest.alias("rest"),
    )


def mended(first: DataFrame) -> DataFrame:
    """first, in which texts that only repeat keys are read after all, or have a repeated named member as their fault, and others the place of what is wrong."""
    broken = first.where("no_doc and not large")
    odd = settle(tokens.first_odd(tokens.nodes(tokens.tokens(tokens.spread(broken.select("row", "json"))))), "odd")
    texts = settle(broken.select("row", "json").join(odd.select("row"), "row", "left_anti"), "sound")
    sound = tokens.without_repeats(settle(tokens.nodes(tokens.tokens(tokens.spread(texts))), "tokens"), tokens.tasks(texts))
    sound = settle(sound.withColumnsRenamed({"json": "again", "fault": "twice", "line": "twice_line", "column": "twice_column"}), "sound")
    place = odd.withColumnsRenamed({"line": "odd_line", "column": "odd_column"})
    joined = broken.select("row", "tileset_id", "json", "large").join(sound, "row", "left").join(place, "row", "left")
    read_ = joined.select("row", "tileset_id", members.read_json(F.col("again")).alias("doc"), "json", "large", F.lit(None).cast("int").alias("levels"), F.coalesce("odd_line", "twice_line").cast("int").alias("line"), F.coalesce("odd_column", "twice_column").cast("int").alias("column"), "twice")
    again = examined(read_.drop("twice")).join(read_.select("row", "twice"), "row").withColumn("fault", F.coalesce("twice", "fault")).drop("twice")
    return settle(first.where("not no_doc or large").unionByName(again), "documents")


ASIDE = ("deep", "json", "large", "levels")


def parse(documents: DataFrame, label: str | None = None, *, positions: bool = False, large: int = LARGE) -> DataFrame:
    """row, tileset_id, doc (VARIANT), version, geometric_error, extensions_used, extensions_required, error_code, error_detail; with positions, error_line and error_column.

    error_code is `json` for text that is no JSON, or in which a member of the document or of any of its tiles is missing, repeated or of a
    wrong type (error_detail names the first), and `parse` for an empty version. Errors call a document by label (SLICE
    for text in memory, READER for a stream), or else by its tileset_id. doc of a document over `large` bytes has an empty root.

    Positions count from 1, in code points: of the first token that is no JSON there, of a repeated key, of a value of a wrong type, or of the
    object that lacks a member. They cost a copy of the texts, and tokens of those in error; large documents have none.
    """
    first, found = first_of(documents, large, positions)
    others = first.where("levels is null and not large")
    wrong = faulty(walk(others.where("deep"), keep=False)) if found.deep else first.sparkSession.createDataFrame([], "row long, no_json boolean, fault string")
    out = judged(others.drop(*ASIDE), wrong, label)
    if found.large:
        out = out.unionByName(finish(*cut_up(first), label)[0])
    out = out.unionByName(plain_verdicts(first, label))
    return with_positions(out, first) if positions else out.drop("fault", "no_json", "line", "column")


def with_positions(verdicts: DataFrame, first: DataFrame) -> DataFrame:
    verdicts = settle(verdicts, "verdicts")
    at = verdicts.where("error_code = 'json' and not no_json and line is null").select("row", F.split("fault", r"\.").alias("path"))
    at = at.withColumn("path", F.when(F.try_element_at("path", F.lit(1)) == "nested too deep", F.array(F.lit("root"))).otherwise(F.col("path")))
    texts = settle(first.where("not large").select("row", "json").join(at.select("row"), "row", "left_semi"), "texts")
    placed = tokens.located(tokens.nodes(tokens.tokens(tokens.spread(texts))), at).select("row", F.col("line").alias("at_line"), F.col("column").alias("at_column"))
    out = verdicts.join(placed, "row", "left").withColumn("error_line", F.coalesce("line", "at_line").cast("int")).withColumn("error_column", F.coalesce("column", "at_column").cast("int"))
    return out.drop("fault", "no_json", "line", "column", "at_line", "at_column")


def load(documents: DataFrame, label: str | None = None, *, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """parse(documents), and flatten() of it, from one walk."""
    first, found = first_of(documents, large, False)
    others = first.where("levels is null and not large")
    headers, tiles = others.drop(*ASIDE), walk(others.where("fault is null")) if found.others else None
    if found.large:
        more, own = cut_up(first)
        headers, tiles = headers.unionByName(more), tiles.unionByName(own) if tiles else own
    plain = plain_verdicts(first, label)
    if tiles is None:
        parsed, tiles = plain, plain_tiles(first, found.levels or 0)
    else:
        parsed, tiles = finish(headers, tiles, label)
        if found.levels is not None:
            parsed, tiles = parsed.unionByName(plain), tiles.unionByName(plain_tiles(first, found.levels))
    return parsed.drop("fault", "no_json", "line", "column"), tiles


def cut_up(first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers and tiles of large documents."""
    of = F.col("row").cast("string").alias("of")
    large = first.where("large").select(of, "json", (F.octet_length("json") <= structure.CHUNK).alias("one"))
    cut = settle(structure.at_once(large.where("one")), "cut")
    longer = large.where("not one")
    if not longer.isEmpty():
        cut = cut.unionByName(settle(structure.texts(structure.chunks(longer.select("of", "json"))), "cut"))
    return typed_cut(cut.join(first.where("large").select("row", "tileset_id", of), "of"))


def typed_cut(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers and tiles from row, tileset_id, path, text (see structure.texts())."""
    none = F.lit(None).cast("int")
    read_ = cut.where("path is null").select("row", "tileset_id", members.read_json(F.col("text")).alias("doc"), none.alias("line"), none.alias("column"))
    headers = settle(header(read_).withColumn("fault", F.when(F.col("doc").isNull(), F.lit("")).otherwise(members.tileset_fault("doc"))).withColumn("no_doc", F.col("doc").isNull()), "documents")
    ord_ = F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit(0)).alias("ord")
    plain = F.coalesce((F.size("path") <= MOST_LEVELS) & members.plain_shell(F.col("text")), F.lit(False))
    cut = cut.where("path is not null").select("row", "tileset_id", "path", ord_, "text", plain.alias("plain"))
    own = cut.where("not plain").select("row", "tileset_id", "path", "ord", members.read_json(F.col("text")).alias("tile"))
    own = own.select("*", F.col("tile").isNull().alias("unread"))
    # Members of `children` that are no objects weren't cut out, and are tiles by their place.
    odd = own.select("row", "tileset_id", "path", F.posexplode(field(F.col("tile"), "children", "array<variant>")).alias("ord", "tile")).where(~F.startswith(F.schema_of_variant("tile"), F.lit("OBJECT")))
    odd = odd.select("row", "tileset_id", F.array_append("path", F.col("ord")).alias("path"), "ord", "tile", F.lit(False).alias("unread"))
    tiles = settle(own_members(own.union(odd).select("row", "tileset_id", "path", "ord", "tile", "unread")).drop("tile").withColumn("fault", tile_verdict()), "tiles")
    shells = plain_typed(cut.where("plain").select("row", "tileset_id", "path", "ord", F.from_json("text", members.plain_kind(0)).alias("own")))
    return headers, typed(tiles).unionByName(shells.withColumns({"unread": F.lit(False), "fault": F.lit(None).cast("string")}))


def finish(headers: DataFrame, tiles: DataFrame, label: str | None) -> tuple[DataFrame, DataFrame]:
    # The verdicts are stored, the documents aren't once more: a plan that needs no doc reads none.
    parsed = judged(headers, settle(faulty(tiles), "faulty"), label)
    return parsed, tiles.drop("fault", "unread").join(parsed.where("error_code is null").select("row"), "row", "left_semi")


def load_files(spark: SparkSession, path: str, label: str | None = None, chunk: int = structure.CHUNK) -> tuple[DataFrame, DataFrame]:
    """load() of files of any size, which Spark splits over tasks; tileset_id is the file's path, and doc has an empty root."""
    cut = settle(structure.texts(structure.read(spark, path, chunk)), "cut")
    names = settle(cut.select("of").distinct().select("of", F.monotonically_increasing_id().alias("row")), "names")
    # A text without any brace of its own still has a header.
    headers, tiles = typed_cut(cut.join(names, "of").select("row", F.col("of").alias("tileset_id"), "path", "text"))
    parsed, tiles = finish(headers, tiles, label)
    return parsed.drop("fault", "no_json", "line", "column"), tiles


def tile_columns() -> list[Column]:
    """Columns of a tile from its members (VARIANT columns). An absent transform is the identity."""
    read_ = lambda k, ddl: F.try_variant_get(F.col(k), "$", ddl)
    plain = lambda k: F.when(~F.is_variant_null(F.col(k)), F.col(k))
    volume = F.struct(*(field(F.col("boundingVolume"), k, "array<double>").alias(k) for k in ("box", "region", "sphere")))
    one, more = plain("content"), F.coalesce(read_("contents", "array<variant>"), F.array().cast("array<variant>"))
    tiling = F.col("implicitTiling")
    return [
        volume.alias("bounding_volume"), read_("geometricError", "double").alias("geometric_error"), read_("refine", "string").alias("refine"),
        F.coalesce(read_("transform", "array<double>"), F.array(*map(F.lit, IDENTITY))).alias("transform"),
        F.concat(F.array_compact(F.array(one)), more).alias("contents"),
        read_("implicitTiling", TILING).alias("implicit_tiling"),
        read_("extensions", "map<string,variant>").alias("extensions"),
        F.struct(
            one.isNotNull().alias("single"), *(plain(k).alias(k) for k in ("viewerRequestVolume", "metadata", "extras")), F.struct(*more_of(F.col("boundingVolume"))).alias("boundingVolume"),
            F.struct(*more_of(tiling), F.struct(*more_of(tiling, "subtrees.")).alias("subtrees")).alias("implicitTiling"),
        ).alias("rest"),
    ]


def own_members(level: DataFrame) -> DataFrame:
    """level with the own members of its column tile, as they are written, and odd: what is wrong with the tile as a whole."""
    both = level.select("*", members.own_members(F.col("tile"), members.TILE).alias("own"), members.odd_fault("tile").alias("odd"))
    return both.select(*level.columns, *(F.col(f"own.{k}").alias(k) for k in members.TILE), "odd")


def tile_verdict() -> Column:
    """What is wrong with a tile, from its members' columns; null if nothing is."""
    too_deep = F.when(F.size("path") > MOST_LEVELS, F.lit("nested too deep"))
    return F.coalesce(F.when(F.col("unread"), F.lit("")), too_deep, members.tile_fault("array_join(concat(array('root'), transform(path, i -> concat('children.', i))), '.')"))


def typed(tiles: DataFrame) -> DataFrame:
    """row, tileset_id, path, depth, ord, the tile's columns, unread, fault: which member isn't as the format has it, if any. tiles: their members, unread and fault (tile_verdict()), stored."""
    return tiles.select("row", "tileset_id", "path", F.size("path").alias("depth"), "ord", *tile_columns(), "unread", "fault")


def walk(documents: DataFrame, *, keep: bool = True, strides: int = (MOST_LEVELS + 2 + STRIDE - 1) // STRIDE) -> DataFrame:
    """Tiles of documents (row, tileset_id, doc), as typed() has them; without keep only row, path, unread and fault of those with a fault."""
    base = documents.select("row", "tileset_id", F.array().cast("array<int>").alias("path"), F.lit(0).alias("ord"), field(F.col("doc"), "root", "variant").alias("tile"))

    def opened(level: DataFrame) -> DataFrame:
        """Each tile that is to be opened by itself, and its children, to be opened in turn; others as they are."""
        one = lambda path, ord_, tile, todo: F.struct(path.alias("path"), ord_.alias("ord"), tile.alias("tile"), F.lit(todo).alias("todo"))
        children = F.transform(field(F.col("tile"), "children", "array<variant>"), lambda c, i: one(F.array_append("path", i), i, c, True))
        self = F.array(one(F.col("path"), F.col("ord"), F.col("tile"), False))
        both = bits.let(children, lambda c: F.when(c.isNotNull(), F.concat(self, c)).otherwise(self))
        return level.select("row", "tileset_id", F.inline(F.when(F.col("todo"), both).otherwise(self)))

    found = []
    for _ in range(strides):
        level = base.withColumn("todo", F.lit(True))
        for _ in range(STRIDE):
            level = opened(level)
        own = level.select("row", "tileset_id", "path", "ord", "todo", F.when(F.col("todo"), F.col("tile")).alias("whole"), F.when(~F.col("todo"), F.col("tile")).alias("tile"), F.lit(False).alias("unread"))
        own = own_members(own).drop("tile").withColumnRenamed("whole", "tile").withColumn("fault", F.when(~F.col("todo"), tile_verdict()))
        if not keep:
            own = own.select("row", "tileset_id", "path", "ord", "todo", "tile", "unread", "fault").where("todo or fault is not null")
        done = settle(own, "tiles")
        found.append(done.where("not todo").drop("todo", "tile"))
        base = done.where("todo").select("row", "tileset_id", "path", "ord", "tile")
        if base.isEmpty():
            break
    all_ = reduce(DataFrame.union, found)
    return typed(all_) if keep else all_.select("row", "path", "unread", "fault")


def flatten(parsed: DataFrame) -> DataFrame:
    """One row a tile of the documents without an error: row, tileset_id, path, depth, ord (position among its siblings), and the tile's columns. Documents over LARGE bytes have lost their tiles: load() gives them."""
    return walk(parsed.where("error_code is null").select("row", "tileset_id", "doc")).drop("fault", "unread")


def contents(tiles: DataFrame) -> DataFrame:
    """One row a content: row, tileset_id, path, content_ord, uri, group. A tile's `content` comes before its `contents`."""
    each = tiles.select("row", "tileset_id", "path", F.posexplode("contents").alias("content_ord", "c"))
    return each.select("row", "tileset_id", "path", "content_ord", field(F.col("c"), "uri", "string").alias("uri"), field(F.col("c"), "group", "bigint").alias("group"))


def tile_texts() -> tuple[Column, Column]:
    """The JSON texts of a tile's members before and behind its children, from its columns, in the order of the format; null if there are none. What is empty is left out."""
    volume = F.struct(*(F.col(f"bounding_volume.{k}").alias(k) for k in ("box", "region", "sphere")), *(F.col(f"rest.boundingVolume.{k}").alias(k) for k in ("extensions", "extras")))
    given = lambda path: [F.col(f"rest.implicitTiling.{path}{k}").alias(k) for k in ("extensions", "extras")]
    # A struct without fields that aren't null is written as {}.
    subtrees = F.struct(F.col("implicit_tiling.subtrees.uri").alias("uri"), *given("subtrees."))
    implicit = F.struct(*(F.col(f"implicit_tiling.{k}").alias(k) for k in ("availableLevels", "subdivisionScheme", "subtreeLevels")), subtrees.alias("subtrees"), *given(""))
    member = lambda name, text: F.when(text.isNotNull(), F.concat(F.lit(f'"{name}":'), text))
    single = F.coalesce(F.col("rest.single"), F.size("contents") == 1) & (F.size("contents") > 0)
    more = F.when(single, F.slice("contents", F.lit(2), F.greatest(F.size("contents") - 1, F.lit(0)))).otherwise(F.col("contents"))
    identity = F.col("transform") == F.array(*map(F.lit, IDENTITY))
    behind = F.concat_ws(
        ",",
        member("content", F.when(single, F.to_json(F.get("contents", F.lit(0))))), member("contents", F.when(F.size(more) > 0, F.to_json(F.filter(more, lambda c: c.isNotNull())))),
        member("geometricError", F.col("geometric_error").cast("string")),
        member("implicitTiling", F.when(F.col("implicit_tiling").isNotNull(), F.to_json(implicit))), member("metadata", F.to_json("rest.metadata")),
        member("refine", F.when(F.col("refine").isNotNull(), F.concat(F.lit('"'), "refine", F.lit('"')))),
        member("transform", F.when(identity, F.lit(f"[{','.join(map(str, IDENTITY))}]")).otherwise(F.to_json("transform"))), member("viewerRequestVolume", F.to_json("rest.viewerRequestVolume")),
        member("extensions", F.when(F.size("extensions") > 0, F.to_json("extensions"))), member("extras", F.to_json("rest.extras")),
    )
    return member("boundingVolume", F.to_json(volume)), F.nullif(behind, F.lit(""))


def nest(tiles: DataFrame) -> DataFrame:
    """row, root: the JSON text of each tree, built from the deepest level up. Children keep their order. Tiles are stored by depth, so each level reads its own, and as the texts of their own members."""
    tiles = tiles if "rest" in tiles.columns else tiles.withColumn("rest", F.lit(None).cast(REST))
    before, behind = tile_texts()
    path = stored_by(tiles.select("row", "path", "ord", before.alias("before"), behind.alias("behind"), F.col("depth").alias("level")), "level", "tiles")
    deepest = path.agg(F.max("level")).first()[0]
    empty_ = F.array().cast("array<string>")
    listed = F.when(F.size("children") > 0, F.concat(F.lit('"children":['), F.array_join("children", ","), F.lit("]")))
    json = F.concat(F.lit("{"), F.concat_ws(",", "before", listed, "behind"), F.lit("}"))
    below = None
    for depth in range(deepest or 0, -1, -1):
        level = path.where(F.col("level") == depth)
        if below is None:
            level = level.withColumn("children", empty_)
        else:
            group = below.groupBy(F.col("row").alias("of"), "up").agg(F.sort_array(F.collect_list(F.struct("ord", "json")))["json"].alias("children"))
            level = level.join(group, (F.col("row") == F.col("of")) & (F.col("path") == F.col("up")), "left").drop("of", "up").withColumn("children", F.coalesce("children", empty_))
        old, below = below, settle(level.select("row", F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))).alias("up"), "ord", json.alias("json")), "nested")
        if old is not None:
            discard(old)
    return below.select("row", F.col("json").alias("root"))


def write(parsed: DataFrame, tiles: DataFrame) -> DataFrame:
    """row, tileset_id, json: documents with the trees that tiles (row, ...) hold now."""
    names = lambda key, c: F.when(F.size(c) > 0, F.concat(F.lit(f'"{key}":'), F.to_json(c), F.lit(",")))
    blank = lambda c: F.coalesce(c, F.lit(""))

    def others(*keys: str) -> list[Column]:
        """Members that are written as they were read, each with a comma before it; empty ones are left out."""
        texts = [(k, F.to_json(member_of(F.col("doc"), k))) for k in keys]
        return [blank(F.when(~t.isin("[]", "{}") | F.lit(k == "extras"), F.concat(F.lit(f',"{k}":'), t))) for k, t in texts]

    asset = F.to_json(field(F.col("doc"), "asset", "variant"))
    # What stands before and behind the root is written before documents meet their trees, so that they needn't travel.
    before = F.concat(
        F.lit('{"asset":'), asset, F.lit(","), blank(names("extensionsRequired", "extensions_required")), blank(names("extensionsUsed", "extensions_used")),
        F.lit('"geometricError":'), F.col("geometric_error").cast("string"), *others("groups", "metadata", "properties"), F.lit(',"root":'),
    )
    behind = F.concat(*others("schema", "schemaUri", "statistics", "extensions", "extras"), F.lit("}"))
    written = parsed.where("error_code is null").select("row", "tileset_id", bits.held(before).alias("before"), bits.held(behind).alias("behind"))
    return written.join(nest(tiles), "row").select("row", "tileset_id", F.concat("before", "root", "behind").alias("json"))


def pretty(documents: DataFrame, column: str) -> DataFrame:
    """documents with a column of JSON texts indented, over several lines (tokens.pretty()). Rows are numbered and stored. A null text stays null."""
    row = fresh(documents, "row")
    rows = settle(documents.withColumn(row, F.monotonically_increasing_id()), "rows")
    done = tokens.pretty(rows.select(F.col(row).alias("row"), F.col(f"`{column}`").alias("json"))).withColumnsRenamed({"row": "of", "json": "pretty_text"})
    whole = F.when(F.col(f"rows.`{column}`").isNotNull(), F.coalesce(F.col("done.pretty_text"), F.lit("")))
    met = rows.alias("rows").join(done.alias("done"), F.col(f"rows.`{row}`") == F.col("done.of"), "left")
    return met.select(*(whole.alias(c) if c == column else F.col(f"rows.`{c}`") for c in documents.columns))
