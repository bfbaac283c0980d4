"""Tokens of JSON texts: places of errors and repeated keys, against Python's parser."""

import json
import random

from pyspark.sql import functions as F

from terrashard.sources import tilesets, tokens

VALID = ['{"a":[1,{"b":"x\\"y"}],"c":{}}', "[]", "[[],[{}],-0.5e+3]", ' {"a" : true , "b":null}\n', '"text"', "0", '{"k":"\\u00e9😀"}']
VOLUME = '{"boundingVolume":{"sphere":[0,0,0,1]},"geometricError":1}'


def damaged():
    rng = random.Random(4)
    for text in VALID * 12:
        at = rng.randrange(len(text) + 1)
        yield rng.choice([text[:at] + text[at + 1 :], text[:at] + rng.choice('{}[],:"x01 \n') + text[at:], text[:at]])


def test_the_first_wrong_token(spark):
    """A text has a wrong token exactly if Python's parser refuses it, and the parser stops there or at the token's end."""
    texts = VALID + list(damaged())
    given = spark.createDataFrame(list(enumerate(texts)), "row long, json string")
    got = {r.row: (r.line, r.column) for r in tokens.first_odd(tokens.nodes(tokens.tokens(given))).collect()}
    for i, text in enumerate(texts):
        try:
            json.loads(text, parse_constant=lambda c: 1 / 0)
            wrong = None
        except (ValueError, ZeroDivisionError) as e:
            wrong = e
        if wrong is None:
            assert i not in got, text
        elif text.strip():  # a text without a token has none that is wrong
            assert i in got, text
            line, column = got[i]
            at = sum(len(x) + 1 for x in text.split("\n")[: line - 1]) + column - 1
            pos = getattr(wrong, "pos", at)
            assert at <= len(text) and (at <= pos + 1 or text[pos:at].strip() in ("", ",", ":") or '"' in text[at - 1 : at + 1] or text[pos:at].isalnum()), (text, at, pos)


def test_members_are_found_by_path(spark):
    text = '{"a":{"b":[10,\n {"c":1,"d":[true,\n"x"]}]},"e":{"c":2},"é":\t3}'
    paths = {"a": '{"b"', "a.b": "[10", "a.b.0": "10", "a.b.1.c": '1,"d"', "a.b.1.d.1": '"x"', "a.b.1.missing": '{"c":1', "e.c": "2}", "nothing": '{"a"', "é": "3}"}
    given = spark.createDataFrame([(i, text) for i in range(len(paths))], "row long, json string")
    wanted = spark.createDataFrame([(i, p.split(".")) for i, p in enumerate(paths)], "row long, path array<string>")
    got = {r.row: (r.line, r.column) for r in tokens.located(tokens.nodes(tokens.tokens(given)), wanted).collect()}
    for i, start in enumerate(paths.values()):
        at = text.index(start)
        assert got[i] == (text[:at].count("\n") + 1, at - text.rfind("\n", 0, at)), start


def test_repeated_keys(spark):
    head = '{"asset":{"version":"1"},"geometricError":1,"root":%s' % VOLUME
    cases = [
        (head + ',"extras":{"x":1,"x":2,"y":{"x":3}}}', None, '{"x":2,"y":{"x":3}}'), (head + ',"extras":{"a":{"x":1,"x":{"q":[1,2],"q":[3]}},"a":{"x":[0],"x":{"q":[1],"q":[4]}}}}', None, '{"a":{"x":{"q":[4]}}}'),
        (head + ',"extensions":{"x":1,"x":2},"extras":[{"k":1,"k":2},{"k":1}]}', None, '[{"k":2},{"k":1}]'), (head + ',"extras":1,"extras":2}', "extras", None), (head[:-1] + ',"refine":"ADD","refine":"ADD"},"extras":1}', "root.refine", None),
        (head + ',"schema":{"id":"s","classes":{"c":{"name":"1","name":"2"}}},"extras":0}', "schema.classes.c.name", None), (head + ',"metadata":{"class":"c","properties":{"p":1,"p":[2,{"p":3}],"q":1}},"extras":7}', None, "7"),
        (head[:-1] + ',"extras":{"\\u0061":1,"a":2}},"extras":8}', None, "8"), (head + ',"unknown":1}', None, None),
    ]
    parsed = tilesets.parse(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "tileset_id long, json string"))
    for r in parsed.withColumn("extras", F.to_json(tilesets.field(F.col("doc"), "extras", "variant"))).withColumn("p", tilesets.field(F.col("doc"), "metadata.properties.p", "long")).collect():
        _, twice, extras = cases[r.tileset_id]
        assert r.error_detail == (twice and f"failed to parse {r.tileset_id}: repeated: {twice}") and r.extras == extras
        assert r.tileset_id != 6 or r.p == 1


def test_tasks_of_tokens_follow_the_texts(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SHARE", 200)
    texts = spark.range(100).select(F.col("id").alias("row"), F.concat(F.lit('{"a":[1,{"b":"'), F.col("id").cast("string"), F.lit('"}]}')).alias("json"))
    n = tokens.tasks(texts)
    assert n >= 100 * 18 // 200
    listed = tokens.nodes(tokens.tokens(tokens.spread(texts)))
    assert listed.rdd.getNumPartitions() == n and listed.count() == 100 * 13
