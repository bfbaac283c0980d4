"""Tile-tree documents and subtree payloads."""

import json
import struct

from pyspark.sql import functions as F

from terrashard.functions import bits
from terrashard.operators import validate
from terrashard.sources import subtrees, tilesets
from terrashard.streaming import loads

VOLUME = {"sphere": [0, 0, 0, 1000]}


def parsed(spark, *docs):
    rows = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    return tilesets.parse(spark.createDataFrame(rows, "tileset_id long, json string"))


def doc(**more):
    return {"asset": {"version": "1.1"}, "geometricError": 100.0, "root": {"boundingVolume": VOLUME, "geometricError": 1, "refine": "ADD", **more.pop("root", {})}, **more}


def test_parse(spark):
    got = parsed(spark, doc(), "not json", doc(asset={"version": ""}), doc(extensionsUsed=None), {"asset": {"version": "1"}}).orderBy("tileset_id").collect()
    assert [r.error_code for r in got] == [None, "json", "parse", None, "json"]
    assert (got[0].version, got[0].geometric_error) == ("1.1", 100.0) and got[3].extensions_used == []


def test_diagnostics(spark):
    p = parsed(spark, doc(geometricError=-1.0, root={"geometricError": -2.5}, extensionsRequired=["EXT_a", "EXT_b"], extensionsUsed=["EXT_b"]), doc())
    got = [(r.ord, r.code, r.path) for r in validate.diagnostics(p).orderBy("ord").collect()]
    assert got == [(0, "tileset.negative_geometric_error", "geometricError"), (1, "tile.negative_geometric_error", "root.geometricError"), (2, "tileset.required_extension_not_used", "extensionsRequired[0]")]
    assert [r.message for r in validate.diagnostics(p).orderBy("ord").collect()][:2] == ["geometricError is negative (-1); expected >= 0", "root.geometricError is negative (-2.5); expected >= 0"]


def test_wrongly_typed_members_anywhere(spark):
    deep = lambda bad: doc(root={"children": [leaf("a"), leaf("b", children=[leaf("c", **bad)])]})
    cases = [
        (deep({}), None), (deep({"refine": "add"}), "root.children.1.children.0.refine"), (deep({"transform": None}), "root.children.1.children.0.transform"), (deep({"geometricError": None}), "root.children.1.children.0.geometricError"),
        (deep({"content": {"uri": 5}}), "root.children.1.children.0.content.uri"), (deep({"content": None}), None), (deep({"children": None, "contents": None, "metadata": None}), None), (deep({"children": {}}), "root.children.1.children.0.children"),
        (deep({"children": [3]}), "root.children.1.children.0.children.0"), (deep({"implicitTiling": {"availableLevels": -1, "subdivisionScheme": "Octree", "subtreeLevels": 1, "subtrees": {"uri": "u"}}}), "root.children.1.children.0.implicitTiling.availableLevels"),
        (deep({"boundingVolume": {"sphere": [0, 0, 0, "1"]}}), "root.children.1.children.0.boundingVolume.sphere"), (deep({"boundingVolume": {"region": None}}), None), (deep({"unknown": "is ignored"}), None),
        (doc(groups=[{"class": 1}, 2]), "groups.1"), (doc(properties={"h": {"maximum": 1}}), "properties.h.minimum"), (doc(schema={"id": "s", "enums": {"E": {"values": [{"name": "n", "value": 1.5}]}}}), "schema.enums.E.values.0.value"),
        (doc(statistics={"classes": {"c": {"count": -1}}}), "statistics.classes.c.count"), (doc(metadata={"properties": {}}), "metadata.class"), (doc(extensionsRequired=["a", 1]), "extensionsRequired.1"), ([], ""), (doc(extras=None), None),
    ]
    got = parsed(spark, *(d for d, _ in cases)).orderBy("tileset_id").collect()
    for r, (_, path) in zip(got, cases, strict=True):
        assert r.error_code == (None if path is None else "json"), (r, path)
        assert path is None or r.error_detail == f"failed to parse {r.tileset_id}: missing or of a wrong type: {path}"
    tiles = tilesets.flatten(parsed(spark, *(d for d, _ in cases)))
    assert {r.tileset_id for r in tiles.select("tileset_id").collect()} == {i for i, (_, path) in enumerate(cases) if path is None}


def test_errors_name_their_source(spark):
    rows = spark.createDataFrame([(1, "no"), (2, json.dumps(doc(asset={"version": ""})))], "tileset_id long, json string")
    for label in (tilesets.SLICE, tilesets.READER):
        got = tilesets.parse(rows, label).orderBy("tileset_id").collect()
        assert got[0].error_detail == f"failed to parse {label}: no JSON" and got[1].error_detail.startswith("failed to parse <tileset>: ")


def test_deep_documents_are_rows_with_an_error(spark):
    def nested(n):
        tile = leaf("x")
        for _ in range(n):
            tile = leaf("x", children=[tile])
        return {**doc(), "root": tile}

    p = parsed(spark, nested(5), nested(tilesets.MOST_LEVELS), nested(tilesets.MOST_LEVELS + 1), nested(300), doc())
    assert [r.error_code for r in p.orderBy("tileset_id").collect()] == [None, None, "json", "json", None]
    counts = {r.tileset_id: r["count"] for r in tilesets.flatten(p).groupBy("tileset_id").count().collect()}
    assert counts == {0: 6, 1: tilesets.MOST_LEVELS + 1, 4: 1}


def test_schemes_that_a_loader_lacks(spark):
    from terrashard.operators.errors import scheme_error

    got = spark.createDataFrame([("Quadtree",), ("S2",), ("kd",), (None,)], "s string").select(scheme_error(F.col("s")).alias("e"), scheme_error(F.col("s"), ("octree",)).alias("o")).collect()
    assert [r.e and r.e.error_code for r in got] == [None, None, "unsupported_implicit_subdivision", "unsupported_implicit_subdivision"] and all(r.o for r in got)
    assert got[2].e.error_detail == "unsupported implicit subdivision scheme: kd"


def leaf(uri, **more):
    return {"boundingVolume": VOLUME, "geometricError": 0, "content": {"uri": uri}, **more}


TREE = doc(root={"content": {"uri": "top.glb"}, "children": [leaf("left.b3dm", children=[leaf("deep.glb")]), leaf("right.pnts", contents=[{"uri": "more.glb", "group": 3}])]})


def test_traversal_is_in_pre_order(spark):
    tiles = tilesets.flatten(parsed(spark, TREE, "broken"))
    assert tiles.count() == 4 and tiles.where(F.size("transform") == 16).count() == 4
    found = tilesets.contents(tiles).orderBy("tileset_id", "path", "content_ord").collect()
    assert [r.uri for r in found] == ["top.glb", "left.b3dm", "deep.glb", "right.pnts", "more.glb"] and found[-1].group == 3
    assert tilesets.flatten(parsed(spark, "broken")).count() == 0


def test_write_reads_back_the_same(spark):
    p = parsed(spark, TREE, doc(extensionsUsed=["E"], root={"extensions": {"E": {"a": [1, None]}}, "boundingVolume": {"region": [0, 0, 1, 1, 0, 9.5]}}))
    tiles = tilesets.flatten(p)
    again = tilesets.parse(tilesets.write(p, tiles))
    assert again.where("error_code is not null").count() == 0
    plain = lambda df: sorted(map(str, df.drop("row").withColumns({"contents": F.to_json("contents"), "extensions": F.to_json("extensions")}).collect()))
    assert plain(tilesets.flatten(again)) == plain(tiles)
    written = json.loads(tilesets.write(p, tiles).where("tileset_id = 0").first().json)
    assert [c["content"]["uri"] if "content" in c else c["contents"][0]["uri"] for c in written["root"]["children"]] == ["left.b3dm", "right.pnts"]
    assert "children" not in written["root"]["children"][1] and "refine" not in written["root"]["children"][1]


def payloads(spark, *contents):
    return spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "id long, content binary")


def packed(text, blob=b"", version=1, text_size=None, blob_size=None):
    return b"subt" + struct.pack("<IQQ", version, len(text) if text_size is None else text_size, len(blob) if blob_size is None else blob_size) + text + blob


CONSTANT = b'{"tileAvailability":{"constant":1},"contentAvailability":[{"constant":1}],"childSubtreeAvailability":{"constant":0}}'
STREAM = b'{"bufferViews":[{"buffer":0,"byteOffset":0,"byteLength":3}],"buffers":[{"byteLength":3}],"tileAvailability":{"bitstream":0},"childSubtreeAvailability":{"constant":2}}'


def test_decode(spark):
    got = subtrees.decode(payloads(spark, CONSTANT, packed(CONSTANT), packed(STREAM, b"\x01\x00\x00"), packed(CONSTANT) + b"trailing")).orderBy("id").collect()
    assert all(r.error_code is None for r in got)
    assert got[0].tile.constant is True and got[0].child.constant is False and len(got[0].content_layers) == 1 and got[1].tile == got[0].tile == got[3].tile
    assert bytes(got[2].tile.bits) == b"\x01\x00\x00" and got[2].child.constant is True and got[2].content_layers == []


def test_decode_errors_in_order(spark):
    far = STREAM.replace(b'"byteLength":3}],"buffers"', b'"byteLength":4}],"buffers"')
    cases = [
        (packed(CONSTANT)[:10], "truncated"), (packed(CONSTANT, version=2), "unsupported_version"), (packed(CONSTANT, text_size=2**64 - 1), "invalid_length"), (packed(CONSTANT, blob_size=1), "truncated"),
        (b"{", "json"), (CONSTANT + b"}", "json"), (CONSTANT + b",0]", "json"), (b"\xff\xfe", "json"), (b"", "json"), (packed(STREAM.replace(b'"bitstream":0', b'"bitstream":1'), b"abc"), "invalid_buffer_view"), (packed(STREAM.replace(b'"buffer":0', b'"buffer":9'), b"abc"), "invalid_buffer_index"),
        (packed(far, b"abc"), "buffer_out_of_range"), (STREAM.replace(b'{"byteLength":3}', b'{"byteLength":3,"uri":"x.bin"}'), "missing_external_buffer"),
        (STREAM.replace(b'"buffers":[{"byteLength":3}],', b"").replace(b'"buffer":0', b'"buffer":9'), "buffer_out_of_range"),
    ]
    got = subtrees.decode(payloads(spark, *(c for c, _ in cases))).orderBy("id").collect()
    assert [r.error_code for r in got] == [e for _, e in cases]
    assert got[1].error_detail == "2" and got[12].error_detail == "x.bin" and all(r.tile is None for r in got)


def test_external_buffers(spark):
    named = STREAM.replace(b'{"byteLength":3}', b'{"byteLength":3,"uri":"x.bin"}')
    external = spark.createDataFrame([("x.bin", bytearray(b"\x07\x08\x09z")), ("y.bin", bytearray(b""))], "uri string, bytes binary")
    got = subtrees.decode(payloads(spark, named, CONSTANT), external).orderBy("id").collect()
    assert bytes(got[0].tile.bits) == b"\x07\x08\x09" and got[1].error_code is None


def test_members_of_subtrees_have_types(spark):
    """Whatever a member is for, and whether decoding needs it or not."""
    put = lambda old, new: CONSTANT.replace(old, new)
    one, more = b'"tileAvailability":{"constant":1}', lambda text: CONSTANT[:-1] + b"," + text + b"}"
    cases = [
        (CONSTANT, None), *((put(one, b'"tileAvailability":{"constant":%s}' % c), "tileAvailability.constant") for c in (b'"1"', b"1.0", b"true", b"-1", b"18446744073709551616")), (STREAM.replace(b'"bitstream":0', b'"bitstream":"0"'), "tileAvailability.bitstream"),
        (STREAM.replace(b'"byteLength":3}],"tile', b'"byteLength":"3"}],"tile'), "buffers.0.byteLength"), (STREAM.replace(b'"byteOffset":0,', b""), "bufferViews.0.byteOffset"), (more(b'"extensions":3'), "extensions"), (more(b'"extensions":null'), "extensions"),
        (more(b'"subtreeMetadata":5'), "subtreeMetadata"), (more(b'"subtreeMetadata":null,"extras":null,"contentMetadata":null,"unknown":[]'), None), (more(b'"contentMetadata":[1,-2]'), "contentMetadata.1"), (more(b'"tileMetadata":1.5'), "tileMetadata"),
        (more(b'"propertyTables":[{"class":"c","count":1,"properties":{"p":{"values":"0"}}}]'), "propertyTables.0.properties.p.values"), (more(b'"propertyTables":[{"class":"c","count":1,"properties":{"p":{"values":0,"min":[[1],[2.5]],"max":3}}}]'), None),
        (more(b'"propertyTables":[{"class":"c","count":1,"properties":{"p":{"values":0,"stringOffsets":-1}}}]'), "propertyTables.0.properties.p.stringOffsets"), (put(b'"contentAvailability":[{"constant":1}]', b'"contentAvailability":{}'), "contentAvailability"),
        (put(b',"childSubtreeAvailability":{"constant":0}', b""), "childSubtreeAvailability"), (put(one, b'"tileAvailability":null'), "tileAvailability"), (more(b'"buffers":[{"byteLength":1,"uri":7}]'), "buffers.0.uri"), (b"[]", None), (b"{", None),
    ]
    got = subtrees.decode(payloads(spark, *(c for c, _ in cases))).orderBy("id").collect()
    for r, (content, path) in zip(got[:-2], cases, strict=False):
        assert (r.error_code, r.error_detail) == (None if path is None else "json", path), content
    assert [(r.error_code, r.error_detail) for r in got[-2:]] == [("json", None)] * 2
    huge = subtrees.decode(payloads(spark, STREAM.replace(b'"bitstream":0', b'"bitstream":18446744073709551615'), put(one, b'"tileAvailability":{"constant":18446744073709551615}'))).orderBy("id").collect()
    assert (huge[0].error_code, huge[0].error_detail, huge[1].tile.constant) == ("invalid_buffer_view", "18446744073709551615", True)


def test_payloads_are_rows_whatever_their_ids(spark):
    named = lambda uri: STREAM.replace(b'{"byteLength":3}', b'{"byteLength":3,"uri":"%s"}' % uri)
    rows = [(None, bytearray(named(b"x.bin")), "a"), (None, bytearray(named(b"y.bin")), "b"), (1, bytearray(named(b"y.bin")), "c"), (1, bytearray(named(b"no.bin")), "d"), (1, bytearray(named(b"x.bin")), "e"), (None, bytearray(CONSTANT), "f")]
    given = spark.createDataFrame(rows, "id long, content binary, blob string").withColumns({c: F.lit("mine") for c in ("s", "text", "specs", "views", "fetched", "got")})
    external = spark.createDataFrame([("x.bin", bytearray(b"\x09\x09\x09")), ("x.bin", bytearray(b"\x01\x02\x03")), ("y.bin", bytearray(b"\x04\x05\x06")), (None, bytearray(b""))], "uri string, bytes binary")
    got = {r.blob: r for r in subtrees.decode(given, external).collect()}
    assert {k: bytes(r.tile.bits) for k, r in got.items() if k in "abce"} == {"a": b"\x01\x02\x03", "b": b"\x04\x05\x06", "c": b"\x04\x05\x06", "e": b"\x01\x02\x03"}
    assert (got["d"].error_code, got["d"].error_detail, got["f"].error_code, got["f"].s, got["d"].id, got["a"].id) == ("missing_external_buffer", "no.bin", None, "mine", 1, None)


def test_extension_payloads_are_as_written(spark):
    from terrashard.functions import extensions

    texts = ['{"k":5}', '{"k":"5"}', '{"k":5.0}', '{"k":true}', '{"k":null}', "{}", "7", '{"k":1,"more":[]}', '{"k":1,"a":[1,"2"]}', '{"k":1,"a":[1,2],"s":{"t":"u"}}', '{"k":1,"s":{"t":3}}', '{"k":1,"m":{"x":1.5,"y":2}}', '{"k":1,"m":{"x":"1.5"}}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.create_map(F.lit("E"), F.parse_json("t")).alias("m"))
    got = df.select("i", extensions.payload(F.col("m"), "E", "struct<k:bigint,a:array<bigint>,s:struct<t:string>,m:map<string,double>>", ("k",)).alias("p")).orderBy("i").collect()
    assert [r.i for r in got if r.p is not None] == [0, 7, 9, 11] and got[9].p.a == [1, 2] and got[11].p.m == {"x": 1.5, "y": 2.0}
    mesh = ['{"featureIds":[{"featureCount":1}]}', '{"featureIds":[{"featureCount":"1"}]}', '{"featureIds":[{"featureCount":-1}]}', '{"featureIds":[{"featureCount":1,"attribute":4294967296}]}', '{"featureIds":[{"featureCount":1,"label":2}]}', "[]"]
    found = spark.createDataFrame(list(enumerate(mesh)), "i int, t string").select(extensions.mesh_features(F.parse_json("t")).isNotNull().alias("ok")).collect()
    assert [r.ok for r in found] == [True, False, False, False, False, False]


def test_writer(spark):
    text, blob = subtrees.json(bits.bitstream(F.lit(b"\xaa\xbb")), bits.constant(False), F.array(bits.constant(True), bits.bitstream(F.lit(b"\xcc"))))
    r = spark.range(1).select("id", subtrees.binary(text, blob).alias("content"), text.alias("text")).first()
    raw = bytes(r.content)
    magic, version, n, m = struct.unpack_from("<4sIQQ", raw)
    assert (magic, version, n % 8, m) == (b"subt", 1, 0, 3) and raw[24 : 24 + n].decode() == r.text.ljust(n) and raw[24 + n :] == b"\xaa\xbb\xcc"
    assert json.loads(r.text)["bufferViews"] == [{"buffer": 0, "byteLength": 2, "byteOffset": 0}, {"buffer": 0, "byteLength": 1, "byteOffset": 2}]
    back = subtrees.decode(payloads(spark, raw)).first()
    assert bytes(back.tile.bits) == b"\xaa\xbb" and back.content_layers[0].constant is True and bytes(back.content_layers[1].bits) == b"\xcc"


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0-0-0.subtree").write_bytes(packed(STREAM, b"\x01\x00\x00"))
    (tmp_path / "in" / "1-1-0.subtree").write_bytes(b"no")
    (tmp_path / "t.json").write_text(json.dumps(TREE))
    assert tilesets.flatten(tilesets.parse(tilesets.read(spark, str(tmp_path / "t.json")))).count() == 4
    query = loads.stream(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.id.rsplit("/", 1)[1]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["0-0-0.subtree"].error_code is None and got["1-1-0.subtree"].error_code == "json" and (got["1-1-0.subtree"].level, got["1-1-0.subtree"].x) == (1, 1)


def test_strict_raises_what_is_wrong(spark):
    import pytest

    from terrashard.operators.errors import strict

    good = subtrees.decode(payloads(spark, CONSTANT))
    assert strict(good).columns == ["id", "tile", "child", "content_layers"] and strict(good).count() == 1
    with pytest.raises(Exception, match="unsupported_version: 2"):
        strict(subtrees.decode(payloads(spark, packed(CONSTANT, version=2)))).collect()
    with pytest.raises(Exception, match="must not be empty"):
        strict(parsed(spark, doc(asset={"version": ""}))).collect()


def test_pretty(spark):
    texts = ['{"b":[1,{"c":null}],"a":"x"}', "[]", '{ "a" : { } , "b":[ ] }', '[1e400,1E5,-0.0, 1.50,123456789012345678901234567890]', '{"a":1,"a":2,"s":"q\\"[{,:}]\\\\"}', '"one"', " 7 ", '"' + "x" * 200_000 + '"', None, "", "é[😀]"]
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "row long, text string, json string")
    got = tilesets.pretty(df, "text").orderBy("row").collect()
    assert [json.dumps(json.loads(t), indent=2, ensure_ascii=False) for t in texts[:3]] == [r.text for r in got[:3]] and {r.json for r in got} == {"mine"}
    assert got[3].text == "[\n  1e400,\n  1E5,\n  -0.0,\n  1.50,\n  123456789012345678901234567890\n]" and got[4].text == '{\n  "a": 1,\n  "a": 2,\n  "s": "q\\"[{,:}]\\\\"\n}'
    assert [r.text for r in got[5:]] == ['"one"', "7", texts[7], None, "", "é[\n  😀\n]"]


def test_schema_write_reads_back_the_same(spark):
    from terrashard.sources import metadata

    given = {"id": "s", "extras": [1], "classes": {"B": {"name": 'B "q"', "extensions": {"X": {"a": 1}}, "properties": {"h": {"type": "SCALAR", "componentType": "FLOAT32", "min": [1, 2.5], "noData": "x", "required": True, "extras": {"k": None}}, "t": {}}}, "A": {}}, "enums": {"E": {"description": "d", "values": [{"name": "n", "value": -3, "description": "minus three", "extras": 5}]}, "F": {"values": [], "extensions": {"Y": 2}}}}
    df = spark.createDataFrame([(1, json.dumps(given))], "id long, j string").select("id", F.parse_json("j").alias("doc"))
    written = json.loads(metadata.write_schema(df).first().json)
    p = written["classes"]["B"]["properties"]["h"]
    assert (p["array"], p["normalized"], p["required"], p["min"], p["noData"]) == (False, False, True, [1, 2.5], "x")
    assert written["classes"]["B"]["name"] == 'B "q"' and "properties" not in written["classes"]["A"]
    assert p["extras"] == {"k": None} and written["classes"]["B"]["properties"]["t"] == {"type": None, "array": False, "normalized": False, "required": False}
    assert written["classes"]["B"]["extensions"] == {"X": {"a": 1}} and written["extras"] == [1] and written["id"] == "s"
    assert written["enums"] == {"E": {"description": "d", "valueType": "UINT16", "values": [{"name": "n", "value": -3, "description": "minus three", "extras": 5}]}, "F": {"valueType": "UINT16", "values": [], "extensions": {"Y": 2}}}


def test_verdicts_carry_no_document(spark):
    given = spark.createDataFrame([(1, '{"asset":{"version":"1"},"geometricError":1,"root":{"boundingVolume":{},"geometricError":1,"children":[{"boundingVolume":{"sphere":[0,0,0,"1"]},"geometricError":1}]}}')], "tileset_id long, json string")
    for parsed in (tilesets.parse(given), tilesets.load(given)[0]):
        verdict = parsed.select("error_detail")
        passed = [line.replace("no_doc#", "") for line in verdict._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Project [" in line]
        assert passed and not any("doc#" in line for line in passed)
        assert verdict.first()[0] == "failed to parse 1: missing or of a wrong type: root.children.0.boundingVolume.sphere"
