"""Subtree payloads: decode to availability columns, and encode.

A payload is JSON, or an envelope: magic, version, two lengths, JSON, binary. decode() turns rows (id, content BINARY)
into views (functions.bits.VIEW) without leaving the JVM; buffers named by a URI are joined from a table
(uri, bytes). What can't be decoded becomes a row with error_code, in the order in which checks are made. Every member of the JSON
must have the format's type (members.SUBTREE), whether decoding needs it or not; error_detail names the first that hasn't.

Rows are decoded each by itself: an id may be null or repeated, and other columns may have any name. Of several rows of `external` with
one URI, that with the least bytes counts; a null URI names nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from ..storage import settle
from . import members

MAGIC, VERSION, HEADER = "subt", 1, 24
#: Unsigned numbers of 64 bits don't fit a BIGINT.
UNSIGNED = "decimal(20,0)"
AVAILABILITY = f"struct<constant:{UNSIGNED},bitstream:{UNSIGNED}>"
VIEW_SPEC, BUFFER_SPEC = f"struct<buffer:{UNSIGNED},byteOffset:{UNSIGNED},byteLength:{UNSIGNED}>", f"struct<byteLength:{UNSIGNED},uri:string>"
SUBTREE = f"struct<bufferViews:array<{VIEW_SPEC}>,buffers:array<{BUFFER_SPEC}>,tileAvailability:{AVAILABILITY},contentAvailability:array<{AVAILABILITY}>,childSubtreeAvailability:{AVAILABILITY}>"


def envelope(payloads: DataFrame) -> DataFrame:
    """The columns of payloads, and text (JSON), blob (BINARY), error_code, error_detail."""
    c, size = F.col("content"), F.octet_length("content")
    packed = F.coalesce((size >= 4) & (F.hex(F.substr(c, F.lit(1), F.lit(4))) == F.hex(F.lit(MAGIC))), F.lit(False))
    number = lambda at, n: F.when(F.col("packed") & (size >= HEADER), bits.little_endian(c, at, n)).cast("decimal(22,0)")
    opened = payloads.withColumn("packed", packed).withColumn("head", F.struct(number(4, 4).alias("version"), number(8, 8).alias("text"), number(16, 8).alias("blob")))

    def check(h: Column) -> Column:
        end = h["text"] + h["blob"] + HEADER
        return (
            F.when(c.isNull(), "truncated").when(~F.col("packed"), F.lit(None)).when(size < HEADER, "truncated").when(h["version"] != VERSION, "unsupported_version")
            .when(end >= F.lit(str(2**64)).cast("decimal(22,0)"), "invalid_length").when(size < end, "truncated")
        )

    opened = opened.withColumn("error_code", bits.let(F.col("head"), check))
    fine, text_size, blob_size = F.col("error_code").isNull(), F.col("head.text").cast("int"), F.col("head.blob").cast("int")
    text = F.when(fine & F.col("packed"), F.substr(c, F.lit(HEADER + 1), text_size)).when(fine, c)
    blob = F.when(fine & F.col("packed"), F.substr(c, text_size + HEADER + 1, blob_size)).when(fine, F.lit(b""))
    detail = F.when(F.col("error_code") == "unsupported_version", F.col("head.version").cast("string"))
    return opened.select(*payloads.columns, "error_code", detail.alias("error_detail"), F.try_validate_utf8(text.cast("string")).alias("text"), blob.alias("blob"))


def fetched(opened: DataFrame, external: DataFrame) -> DataFrame:
    """opened (with wanted: the URIs that a row names), and fetched: a map of the buffers' bytes by URI, null where a row names none.

    Rows that name the same buffers share one map, so rows need no name of their own; only buffers that some row names are read.
    """
    named = opened.withColumn("wanted", F.when(F.size("wanted") > 0, F.array_sort(F.array_distinct("wanted"))))
    lists = named.select(F.col("wanted").alias("list")).where("list is not null").distinct()
    each = lists.select("list", F.explode("list").alias("uri"))
    bytes_ = external.join(each.select("uri").distinct(), "uri", "left_semi").groupBy("uri").agg(F.min("bytes").alias("bytes"))
    maps = each.join(bytes_, "uri").groupBy("list").agg(F.map_from_entries(F.collect_list(F.struct("uri", "bytes"))).alias("fetched"))
    return named.join(maps, F.col("wanted") == F.col("list"), "left").drop("wanted", "list")


def decode(payloads: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """The columns of payloads (content, and any others) but content, and tile, child (views), content_layers (array of views), error_code, error_detail.

    external: uri, bytes. Only buffers that some payload names are joined, by equality; neither table is gathered.
    """
    given = payloads.select("content", F.struct(*(F.col(f"`{c}`") for c in payloads.columns if c != "content")).alias("given"))
    opened = envelope(given).withColumn("v", bits.held(members.read_json(F.col("text"))))
    opened = opened.withColumn("wanted", F.array_compact(F.try_variant_get("v", "$.buffers", "array<struct<uri:string>>")["uri"]))
    opened = opened.withColumn("fault", bits.held(F.when(F.col("error_code").isNull(), F.when(F.col("v").isNull(), F.lit("")).otherwise(members.subtree_fault("v")))))
    opened = opened.select(
        "given", "blob", F.coalesce("error_code", F.when(F.col("fault").isNotNull(), "json")).alias("error_code"), F.coalesce("error_detail", F.nullif("fault", F.lit(""))).alias("error_detail"),
        F.when(F.col("fault").isNull(), F.try_variant_get("v", "$", SUBTREE)).alias("s"), "wanted",
    )
    # Stored before it is joined: what is read twice is decoded once, and the optimiser meets columns in place of all their expressions.
    opened = opened.withColumn("fetched", F.lit(None).cast("map<string,binary>")) if external is None else fetched(settle(opened, "opened"), external)
    opened = opened.select(
        "given", "error_code", "error_detail", "blob", F.coalesce("s.bufferViews", F.array().cast(f"array<{VIEW_SPEC}>")).alias("views"), F.coalesce("s.buffers", F.array().cast(f"array<{BUFFER_SPEC}>")).alias("buffers"),
        F.concat(F.array("s.tileAvailability", "s.childSubtreeAvailability"), F.coalesce("s.contentAvailability", F.array().cast(f"array<{AVAILABILITY}>"))).alias("specs"), "fetched",
    )
    nth = lambda a, i: F.when((i >= 0) & (i < F.size(a)), F.get(a, i.cast("int")))

    def resolve(a: Column) -> Column:
        """struct<view, code, detail> of one availability object."""
        streamed = a["constant"].isNull() & a["bitstream"].isNotNull()
        inline = F.size("buffers") == 0

        def with_data(v: Column, b: Column, data: Column) -> Column:
            end = v["byteOffset"] + v["byteLength"]
            code = (
                F.when(~streamed, F.lit(None)).when(v.isNull(), "invalid_buffer_view").when(~inline & b.isNull(), "invalid_buffer_index")
                .when(data.isNull(), "missing_external_buffer").when(end > F.octet_length(data), "buffer_out_of_range")
            )
            detail = lambda c: F.when(c == "invalid_buffer_view", a["bitstream"].cast("string")).when(c == "invalid_buffer_index", v["buffer"].cast("string")).when(c == "missing_external_buffer", b["uri"])
            stream = lambda c: F.when(streamed & c.isNull(), F.substr(data, (v["byteOffset"] + 1).cast("int"), v["byteLength"].cast("int")))
            const = F.when(~streamed, F.coalesce(a["constant"] != 0, F.lit(False)))
            return bits.let(code, lambda c: F.struct(F.struct(const.alias("constant"), stream(c).alias("bits")).alias("view"), c.alias("code"), detail(c).alias("detail")))

        def with_buffer(v: Column, b: Column) -> Column:
            data = F.when(inline | b["uri"].isNull(), F.col("blob")).otherwise(F.try_element_at("fetched", b["uri"]))
            return bits.let(data, lambda d: with_data(v, b, d))

        return bits.let(nth(F.col("views"), a["bitstream"]), lambda v: bits.let(nth(F.col("buffers"), v["buffer"]), lambda b: with_buffer(v, b)))

    done = opened.withColumn("got", bits.held(F.when(F.col("error_code").isNull(), F.transform("specs", resolve))))
    done = done.withColumn("bad", F.get(F.filter("got", lambda r: r["code"].isNotNull()), F.lit(0)))
    done = done.select("given", "got", F.coalesce("error_code", "bad.code").alias("error_code"), F.coalesce("error_detail", "bad.detail").alias("error_detail"))
    view = lambda i: F.get("got", F.lit(i))["view"]
    fine = F.col("error_code").isNull()
    return done.select(
        "given.*", F.when(fine, view(0)).alias("tile"), F.when(fine, view(1)).alias("child"),
        F.when(fine, F.transform(F.slice("got", F.lit(3), F.greatest(F.size("got") - 2, F.lit(0))), lambda r: r["view"])).alias("content_layers"), "error_code", "error_detail",
    )


def json(tile: Column, child: Column, layers: Column) -> tuple[Column, Column]:
    """JSON text and blob of views: constants as such, bitstreams one after another in one inline buffer."""
    streams = lambda views: F.filter(views, lambda v: v["constant"].isNull())
    size = lambda v: F.octet_length(v["bits"]).cast("bigint")

    def text(views: Column) -> Column:
        before = lambda i: F.slice(views, F.lit(1), i)
        place = lambda some: F.aggregate(streams(some), F.lit(0).cast("bigint"), lambda a, v: a + size(v))
        spec = lambda v, i: F.struct(F.when(v["constant"].isNull(), F.size(streams(before(i)))).cast("bigint").alias("bitstream"), v["constant"].cast("bigint").alias("constant"))
        ranges = F.filter(F.transform(views, lambda v, i: F.struct(F.when(v["constant"].isNull(), F.lit(0)).cast("bigint").alias("buffer"), size(v).alias("byteLength"), place(before(i)).alias("byteOffset"))), lambda r: r["buffer"].isNotNull())
        some = lambda a: F.when(F.size(a) > 0, a)
        made = lambda r, s: F.to_json(F.struct(
            some(r).alias("bufferViews"), F.when(F.size(r) > 0, F.array(F.struct(place(views).alias("byteLength")))).alias("buffers"), F.get(s, F.lit(1)).alias("childSubtreeAvailability"),
            some(F.slice(s, F.lit(3), F.size(s))).alias("contentAvailability"), F.get(s, F.lit(0)).alias("tileAvailability"),
        ))
        return bits.let(ranges, lambda r: bits.let(F.transform(views, spec), lambda s: made(r, s)))

    all_ = F.concat(F.array(tile, child), layers)
    blob = F.unhex(F.array_join(F.transform(streams(all_), lambda v: F.hex(v["bits"])), ""))
    return bits.let(all_, text), blob


def binary(text: Column, blob: Column) -> Column:
    """The envelope: JSON is padded with spaces to eight bytes, and its length counts the padding; the blob isn't padded."""
    number = bits.to_little_endian
    packed = lambda t, b: F.concat(F.encode(F.lit(MAGIC), "UTF-8"), number(F.lit(VERSION), 4), number(F.octet_length(t), 8), number(F.octet_length(b), 8), F.encode(t, "UTF-8"), b)
    padded = F.concat(text, F.repeat(F.lit(" "), F.pmod(-F.octet_length(text), F.lit(8))))
    return bits.let(padded, lambda t: bits.let(blob, lambda b: packed(t, b)))
