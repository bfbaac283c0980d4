"""Documents of any size: chunks, their index, and the tiles cut from them equal those of the short way."""

import json
import random

import pytest
from pyspark.sql import functions as F

from terrashard.sources import structure, tilesets

VOLUME = {"sphere": [0, 0, 0, 1]}
TEXTS = ['a}b{"]["', "\\", 'q"\\', "é😀", "children", "", "}" * 30]


def tile(rng, depth=0):
    """A tile with braces, quotes and keys such as `children` and `root` where they mean nothing."""
    made = {"boundingVolume": VOLUME, "geometricError": rng.random()}
    if rng.random() < 0.6:
        made["extras"] = {"children": [{"root": rng.choice(TEXTS)}, []], rng.choice(TEXTS) + "x": {"children": [{"geometricError": 1}]}, "t": rng.choice(TEXTS)}
    if rng.random() < 0.5:
        made["content"] = {"uri": rng.choice(TEXTS), "extensions": {"E": {"root": {"children": [{}]}}}}
    if depth < 5 and rng.random() < 0.7:
        made["children"] = [tile(rng, depth + 1) for _ in range(rng.randrange(4))]
    return dict(sorted(made.items(), key=lambda _: rng.random()))


def document(rng):
    doc = {"asset": {"version": "1.1", "extras": {"root": {"children": []}}}, "geometricError": 5, "root": tile(rng), "extras": {"children": [{"x": "}"}]}}
    return json.dumps(dict(sorted(doc.items(), key=lambda _: rng.random())), indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)


def rows(parsed, tiles):
    docs = sorted(((r.tileset_id, r.version, r.geometric_error, r.error_code, r.error_detail) for r in parsed.collect()), key=str)
    columns = [c for c in tiles.columns if c not in ("row", "contents", "extensions", "rest")]
    each = tiles.select(*columns, F.to_json("contents").alias("c"), F.to_json("extensions").alias("e"), F.to_json("rest").alias("r")).collect()
    return docs, sorted((str(r) for r in each))


def test_tiles_are_cut_alike_whatever_the_chunks(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    texts = [document(rng) for _ in range(25)]
    broken = [texts[0][:-1], texts[1] + "}", texts[2].replace('"asset"', '"asset', 1), "", "[]", "no", texts[3].replace('"geometricError": 5', '"geometricError": "5"'), '{"asset":{"version":""},"geometricError":1,"root":{"boundingVolume":{},"geometricError":1,"children":[{"geometricError":1},3]}}']
    given = spark.createDataFrame([(None if i % 5 == 0 else i % 7, t) for i, t in enumerate(texts + broken)], "tileset_id long, json string")
    want = rows(*tilesets.load(given))
    assert len(want[1]) > 100 and sum(d[3] is not None for d in want[0]) >= 7
    assert rows(*tilesets.load(given, large=0)) == want
    cut = structure.chunks
    monkeypatch.setattr(structure, "chunks", lambda docs: cut(docs, 40))
    assert rows(*tilesets.load(given, large=0)) == want


@pytest.mark.parametrize("chunk", [64])
def test_files_are_split_over_tasks(spark, tmp_path, chunk):
    rng = random.Random(3)
    texts = {f"{i}.json": document(rng) + "\n" * (i % 3) for i in range(4)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    whole = spark.createDataFrame([(n, t) for n, t in texts.items()], "tileset_id string, json string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        parsed, tiles = tilesets.load_files(spark, str(tmp_path), chunk=chunk)
        name = F.substring_index("tileset_id", "/", -1).alias("tileset_id")
        again = lambda df: df.withColumn("tileset_id", name)
        assert rows(again(parsed), again(tiles)) == rows(*tilesets.load(whole))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_document_of_300_megabytes(spark, tmp_path):
    """More than a VARIANT holds, in tasks that hold a chunk each."""
    n, wide = 10_000, "x" * 30_000
    with open(tmp_path / "big.json", "w") as f:
        f.write('{"asset":{"version":"1.1"},"geometricError":5,"root":{"boundingVolume":{"sphere":[0,0,0,1]},"geometricError":1,"children":[')
        for i in range(n):
            f.write(("," if i else "") + '{"boundingVolume":{"sphere":[0,0,0,%d]},"geometricError":%d,"extras":{"w":"%s"},"children":[%s]}' % (i, i, wide, '{"boundingVolume":{},"geometricError":0}' if i % 10 == 0 else ""))
        f.write("]}}")
    assert (tmp_path / "big.json").stat().st_size > 300_000_000
    parsed, tiles = tilesets.load_files(spark, str(tmp_path / "big.json"))
    assert [(r.version, r.error_code) for r in parsed.select("version", "error_code").collect()] == [("1.1", None)]
    got = tiles.groupBy("depth").agg(F.count("*").alias("n"), F.sum("geometric_error").alias("s"), F.max("ord").alias("ord"), F.sum(F.length(F.try_variant_get("rest.extras", "$.w", "string"))).alias("w")).orderBy("depth").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1.0, 0, None), (1, n, n * (n - 1) / 2, n - 1, 30_000 * n), (2, n // 10, 0.0, 0, None)]
    assert tiles.where("depth = 1 and ord <> geometric_error").count() == 0


def test_index_entries_are_small():
    data = ('{"a":[{"k":"' + "y" * 100_000 + '"},{"children":[{},{').encode()
    e = structure.entry(data, False)
    assert e == {"inside": False, "pops": 0, "base": 1, "codes": "{.{c{", "counts": [0, 2, 0, 2, 0]} and structure.entry(b'x"}}],{', True) == {"inside": False, "pops": 3, "base": 1, "codes": "{", "counts": [0]}
    assert structure.entry(b'{"x":"\\"}', False)["inside"] and structure.named(b'"\\u0063hildren"', b"children") and not structure.named(b'"\\"', b"root")
