"""Documents that their text shows to be right: told by a pattern, and treated as all others are."""

import json
import os

import pytest
from pyspark.sql import functions as F

from terrashard import storage
from terrashard.sources import members, structure, tilesets

SPHERE, TURN = {"sphere": [0, 0.5, -1.25, 1e3]}, [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 7.5, 0, 0, 1]


def tile(*children, **more):
    whole = {"boundingVolume": SPHERE, **({"children": list(children)} if children else {}), "geometricError": 1, **more}
    return dict(sorted(whole.items()))


def doc(root, **more):
    return dict(sorted({"asset": {"version": "1.1"}, "geometricError": 2.5, "root": root, **more}.items()))


def deep(n):
    return tile(*([deep(n - 1)] if n else []))


def text(d):
    return json.dumps(d, separators=(",", ":"), ensure_ascii=False, sort_keys=True)


TREES = [
    tile(), tile(tile(refine="ADD"), tile(content={"uri": "a"}, transform=TURN), content={"uri": "é/b"}), tile(tile(tile(contents=[{"uri": "x"}, {"uri": "y"}])), content={"uri": "z"}, contents=[{"uri": "u"}]),
    deep(3), deep(6), {**tile(), "boundingVolume": {}}, {**tile(), "children": [], "contents": []}, tile(boundingVolume={"box": [1] * 12}), tile(boundingVolume={"region": [-0.5] * 6}), {**tile(), "geometricError": 10**17},
]


def test_levels(spark):
    plain = text(doc(tile(tile())))
    wrong = ['"geometricError":01', '"geometricError":-0.0', '"geometricError":1e400', '"geometricError":1,"geometricError":1', '"geometricError":"1"', '"geometricError":null', '"geometricError":1,"refine":"NEVER"', '"geometricError":1,"extras":null', '"geometricError" :1']
    cases = [(plain, 1), (text(doc(tile())), 0), (text(doc(deep(3))), 3), (text(doc(deep(4))), None), (plain + "{}", None), (plain + "\n", None), (plain[:-1], None), (plain.replace("[0,", "[0,,"), None), (plain.replace("[0,", "["), None)]
    cases += [(plain.replace('"geometricError":1', w, 1), None) for w in wrong] + [(plain.replace("1.1", c), None) for c in ('\\"', "\x01", "\n")] + [(None, None), ("", None)]
    cases += [(text(doc(tile(), extensionsRequired=["a"], extensionsUsed=["a", "b"])), 0), (text(doc(tile(*[tile()] * 5000))), 1), (text(doc(tile(content={"uri": "u" * members.PLAIN_BYTES}))), None)]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", members.plain_levels(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [n for _, n in cases]


def rows(spark, docs, **how):
    given = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "tileset_id long, json string")
    parsed, tiles = tilesets.load(given, **how)
    shown = tiles.drop("row", "contents", "rest", "extensions").columns
    tiles_ = tiles.select(*shown, F.transform("contents", lambda c: F.to_json(c)).alias("contents"), F.to_json("rest").alias("rest"), F.to_json("extensions").alias("extensions")).orderBy("tileset_id", "path").collect()
    head = parsed.drop("row").withColumn("doc", F.to_json("doc")).orderBy("tileset_id").collect()
    written = {r.tileset_id: r.json for r in tilesets.write(parsed, tiles).collect()} if not how else {}
    return head, tiles_, written, parsed


def test_plain_documents_are_as_others(spark):
    docs = [doc(t) for t in TREES] + [doc(tile(), asset={"version": ""}), doc(tile(), extensionsRequired=["a"], extensionsUsed=["a", "b"]), doc(tile(tile(refine="NEVER"))), doc(tile(tile(), {"boundingVolume": {}}))]
    plain = rows(spark, [text(d) for d in docs])
    spaced = rows(spark, [json.dumps(dict(reversed(d.items()))) for d in docs])  # told by what VARIANT writes
    other = rows(spark, [text({**d, "extras": None}) for d in docs])  # checked member by member
    blank = lambda head: [r.asDict() | {"doc": r.doc.replace('"extras":null,', "")} for r in head]
    assert blank(plain[0]) == blank(spaced[0]) == blank(other[0]) and plain[1] == spaced[1] == other[1] and plain[2] == spaced[2] == other[2]
    assert [r.error_code for r in plain[0]][-4:] == ["parse", None, "json", "json"]
    assert [r.error_detail for r in plain[0]][-2:] == ["failed to parse 12: missing or of a wrong type: root.children.0.refine", "failed to parse 13: missing or of a wrong type: root.children.1.geometricError"]
    given = spark.createDataFrame([(i, text(d)) for i, d in enumerate(docs)], "tileset_id long, json string")
    assert tilesets.parse(given).drop("row").withColumn("doc", F.to_json("doc")).orderBy("tileset_id").collect() == plain[0]
    cut = rows(spark, [text(d) for d in docs], large=10)
    assert [r.asDict() | {"doc": ""} for r in cut[0]] == [r.asDict() | {"doc": ""} for r in plain[0]] and cut[1] == plain[1]


def stored(before, name):
    return [p for p in storage.live if p not in before and f"/{name}-" in p]


def test_plain_documents_are_not_walked(spark):
    """Neither a VARIANT nor a table of tiles is stored of them (F3)."""
    before = set(storage.live)
    head, tiles, _, parsed = rows(spark, [text(doc(t)) for t in TREES if t != deep(6)], label="x")
    assert len(tiles) == 16 and not stored(before, "tiles")
    (documents,) = stored(before, "documents")
    assert spark.read.parquet(documents).where("doc is not null").count() == 0 and all(r.doc for r in head)


def test_documents_of_one_chunk_are_not_folded(spark, monkeypatch):
    """A fold of a document each took 9 ms (F1)."""
    docs = [text(doc(t)) for t in TREES]
    before = set(storage.live)
    once = rows(spark, docs, large=10)
    assert not stored(before, "states") and not stored(before, "chunks")
    monkeypatch.setattr(structure, "CHUNK", 400)
    given = tilesets.load(spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "tileset_id long, json string"), large=10)
    assert stored(before, "states")
    key = lambda r: (r.tileset_id, r.path)
    assert sorted(map(key, given[1].select("tileset_id", "path").collect())) == sorted(map(key, once[1]))


def test_trees_are_nested_from_texts(spark):
    """Trees are stored as the texts of tiles' own members, not as all their columns (F2)."""
    parsed, tiles = tilesets.load(spark.createDataFrame([(0, text(doc(TREES[2])))], "tileset_id long, json string"))
    before = set(storage.live)
    got = json.loads(tilesets.write(parsed, tiles).first().json)
    (path,) = stored(before, "tiles")
    assert set(spark.read.parquet(path).columns) == {"row", "path", "ord", "before", "behind", "level"} and len([f for f in os.listdir(path) if f.startswith("level=")]) == 3
    assert got["root"]["children"][0]["children"][0]["contents"] == [{"uri": "x"}, {"uri": "y"}] and got["root"]["content"] == {"uri": "z"}


@pytest.mark.parametrize("given", [None, "true"])
def test_settings_are_given_back(spark, given):
    if given:
        spark.conf.set(storage.SHRED, given)
    before = spark.conf.get(storage.SHRED, None), spark.conf.get(storage.WRITERS, None)
    storage.settle(spark.range(1), "one")
    assert (spark.conf.get(storage.SHRED, None), spark.conf.get(storage.WRITERS, None)) == before
    spark.conf.unset(storage.SHRED)
