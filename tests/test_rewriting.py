"""Documents that are written again keep every member."""

import json

from pyspark.sql import functions as F

from terrashard.plans import queries
from terrashard.sources import tilesets

VOLUME = {"sphere": [0.0, 0.0, 0.0, 9.0], "extensions": {"V": {"a": 1}}, "extras": {"v": 1}}
TILE = {
    "boundingVolume": VOLUME, "content": {"uri": "{level}.glb"}, "geometricError": 1.0,
    "implicitTiling": {"availableLevels": 4, "subdivisionScheme": "QUADTREE", "subtreeLevels": 2, "subtrees": {"uri": "{level}.subtree", "extras": 3}, "extensions": {"I": 1}, "extras": [1]},
    "metadata": {"class": "c", "properties": {"p": 1}}, "refine": "ADD", "transform": tilesets.IDENTITY, "viewerRequestVolume": {"box": [0] * 12}, "extensions": {"T": {}}, "extras": {},
}
DOC = {
    "asset": {"version": "1.1"}, "extensionsRequired": ["T"], "extensionsUsed": ["I", "T", "V"], "geometricError": 5.0, "groups": [{"class": "c"}], "metadata": {"class": "c"}, "properties": {"h": {"maximum": 2, "minimum": 1}},
    "root": {**{k: v for k, v in TILE.items() if k != "implicitTiling"}, "children": [TILE]}, "schema": {"id": "s", "classes": {"c": {}}}, "statistics": {"classes": {"c": {"count": 1}}}, "extensions": {"D": 1}, "extras": {"x": None},
}


def test_every_member_comes_back(spark):
    other = {"asset": {"version": "1.1"}, "geometricError": 5.0, "root": {"boundingVolume": {"sphere": [0.0] * 4}, "geometricError": 1.0, "transform": tilesets.IDENTITY}, "schemaUri": "s.json"}
    given = [DOC, other, {**other, "groups": [], "metadata": None}]
    parsed = tilesets.parse(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(given)], "tileset_id long, json string"))
    got = [json.loads(r.json) for r in tilesets.write(parsed, tilesets.flatten(parsed)).orderBy("tileset_id").collect()]
    assert got == [DOC, other, other]
    assert list(got[0]) == list(DOC) and list(got[0]["root"]["children"][0]) == list(TILE)
    plain = tilesets.flatten(parsed).drop("rest").where("tileset_id > 0")
    assert [json.loads(r.json) for r in tilesets.write(parsed, plain).collect()] == [other, other]


def test_documents_of_the_query_come_back(spark):
    given = queries.world(spark, "/root/testdata/sf0.001")
    parsed = tilesets.parse(given)
    want = {r.tileset_id: json.loads(r.json) for r in given.collect()}
    for r in tilesets.write(parsed, tilesets.flatten(parsed)).withColumn("json", F.col("json")).collect():
        got = json.loads(r.json)
        assert got["groups"] == [{"class": "region"}] and got["schema"] == want[r.tileset_id]["schema"] and got["extras"] == {"kept": 1}
        assert got["root"]["extras"] == want[r.tileset_id]["root"]["extras"] and got["root"]["viewerRequestVolume"] == {"sphere": [0.0, 0.0, 0.0, 2000.0]}
