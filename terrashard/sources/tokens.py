"""JSON texts as tables of tokens: for indenting, for telling where an error lies, and for objects that repeat a key.

tokens() tells each token's offset, line and column (from 1, in code points) and how many containers are open before it, by running
sums in its row; nodes() adds the innermost container, the name that a value has in it, and whether the token may stand where it
stands. All is SQL: one regular expression, windows within a row, no UDF. A row's tokens meet in one task, so these are for
texts that fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settle

#: Strings (the last may lack its end), marks, white space, and runs of anything else. Possessive: no string is too long for the matcher.
TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"?|[{}\[\],:]|[ \t\r\n]++|[^ \t\r\n"{}\[\],:]++'
STRING = r'(?s)^"(?:[^"\\\x00-\x1F]++|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*+"$'
SCALAR = r"^(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)$"
INDENT = "  "
# The objects of a document that have named members, and those that are maps in which the first of equal keys counts.
# In all others (extensions, extras, free values) the last one does.
ANY = r"[^\x1F]+"
TILE = rf"root(?:\x1Fchildren\x1F{ANY})*"
ENTITIES = rf"metadata|groups\x1F{ANY}|{TILE}\x1F(?:metadata|content\x1Fmetadata|contents\x1F{ANY}\x1Fmetadata)"
CONTENT = rf"{TILE}\x1Fcontents?(?:\x1F[0-9]+)?"
RECORDS = "|".join((
    "", "asset", rf"properties\x1F{ANY}", ENTITIES, TILE, CONTENT, rf"(?:{TILE}|{CONTENT})\x1F(?:boundingVolume|viewerRequestVolume)", rf"{TILE}\x1FimplicitTiling(?:\x1Fsubtrees)?",
    rf"schema(?:\x1Fclasses\x1F{ANY}(?:\x1Fproperties\x1F{ANY})?|\x1Fenums\x1F{ANY}(?:\x1Fvalues\x1F{ANY})?)?", rf"statistics(?:\x1Fclasses\x1F{ANY}(?:\x1Fproperties\x1F{ANY})?)?",
))
MAPS = "|".join(("properties", rf"(?:{ENTITIES})\x1Fproperties", rf"schema\x1F(?:classes|enums)(?:\x1F{ANY}\x1Fproperties)?", rf"statistics\x1Fclasses(?:\x1F{ANY}\x1Fproperties)?"))
SEPARATOR = "\x1f"


#: Bytes of texts whose tokens one task lists and sorts.
SHARE = 2 << 20


def tasks(texts: DataFrame) -> int:
    """How many tasks texts (row, json) go to, so that each lists about SHARE bytes of them."""
    size = texts.agg(F.sum(F.octet_length("json").cast("bigint"))).first()[0] or 0
    return max(-(-size // SHARE), texts.sparkSession.sparkContext.defaultParallelism)


def spread(texts: DataFrame) -> DataFrame:
    """texts (row, json) by row over tasks(); their tokens stay there, as all that is done with them is done by row."""
    return texts.repartition(tasks(texts), "row")


def tokens(texts: DataFrame) -> DataFrame:
    """row, pos, t, at (offset, from 0), line, column, depth: the tokens of texts (row, json) but white space."""
    line = Window.partitionBy("row").orderBy("pos")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    each = texts.select("row", F.posexplode(F.regexp_extract_all("json", F.lit(TOKEN), F.lit(0))).alias("pos", "t"))
    step = F.when(F.col("t").isin("{", "["), 1).when(F.col("t").isin("}", "]"), -1).otherwise(0)
    breaks = F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit("")))
    sums = each.select("*", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for n, c in (("at", F.length("t")), ("depth", step), ("breaks", breaks))))
    ends = F.when(breaks > 0, F.col("at") + F.length("t") - F.length(F.substring_index("t", "\n", -1)))
    start = F.coalesce(F.max(ends).over(before), F.lit(0))
    placed = sums.select("row", "pos", "t", "at", (F.col("breaks") + 1).alias("line"), (F.col("at") - start + 1).alias("column"), "depth")
    return placed.where(~F.rlike("t", F.lit(r"^[ \t\r\n]")))


def nodes(listed: DataFrame) -> DataFrame:
    """tokens() with container (pos of what opened the innermost one; null outside), kind (`{` or `[`), prev and key (the two tokens before), n (commas before it in its container), name, role (key, value, mark), ok.

    name: the key of a member, unescaped, or the place in an array. ok: whether the token is well formed and may stand here.
    """
    order = Window.partitionBy("row").orderBy("pos")
    near = listed.select("*", F.lag("t").over(order).alias("prev"), F.lag("t", 2).over(order).alias("key"))
    level = Window.partitionBy("row", "depth").orderBy("pos", "inner").rowsBetween(Window.unboundedPreceding, 0)
    # Each token, and once more, one level down, what opens a container.
    both = near.withColumn("inner", F.explode(F.when(F.col("t").isin("{", "["), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True))))).withColumn("depth", F.col("depth") + F.when(F.col("inner"), 0).otherwise(1))
    held = both.withColumn("c", F.max(F.when(~F.col("inner"), F.struct("pos", "t"))).over(level)).where("inner").drop("inner")
    inside = Window.partitionBy("row", "container").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    top = F.col("depth") == 0
    held = held.select("*", F.when(~top, F.col("c.pos")).alias("container"), F.when(~top, F.col("c.t")).alias("kind")).drop("c")
    held = held.withColumn("n", F.coalesce(F.sum(F.when(F.col("t") == ",", 1).otherwise(0)).over(inside), F.lit(0)))
    t, prev, kind = F.col("t"), F.col("prev"), F.coalesce("kind", F.lit(""))
    text = F.startswith(t, F.lit('"'))
    fine = F.when(text, F.rlike(t, F.lit(STRING))).when(F.length(t) > 1, F.rlike(t, F.lit(SCALAR))).otherwise(t.isin("{", "}", "[", "]", ",", ":") | F.rlike(t, F.lit(SCALAR)))
    begins = ~t.isin("}", "]", ",", ":")
    key = (kind == "{") & text & prev.isin("{", ",")
    after_key = F.startswith(prev, F.lit('"')) & F.col("key").isin("{", ",")
    here = (
        F.when(kind == "", begins & prev.isNull())
        .when(kind == "{", F.when(prev == "{", key | (t == "}")).when(prev == ",", key).when(prev == ":", begins).when(after_key, t == ":").otherwise(t.isin(",", "}")))
        .otherwise(F.when(prev == "[", begins | (t == "]")).when(prev == ",", begins).otherwise(t.isin(",", "]")))
    )
    plain = lambda c: F.when(F.contains(c, F.lit("\\")), F.get(F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>"), F.lit(0))).otherwise(F.substr(c, F.lit(2), F.length(c) - 2))
    named = F.when(key, plain(t)).when((kind == "{") & (prev == ":"), plain(F.col("key"))).when(kind == "[", F.col("n").cast("string"))
    role = F.when(key, "key").when(begins, "value").otherwise("mark")
    return held.select("*", F.when(role != "mark", named).alias("name"), role.alias("role"), F.coalesce(fine & here, F.lit(False)).alias("ok"))


def pretty(texts: DataFrame) -> DataFrame:
    """row, json: each JSON text over several lines, members in their order, every number and string spelled as it was. Text that is no JSON comes out with its tokens indented as they come."""
    order = Window.partitionBy("row").orderBy("pos")
    near = tokens(texts).select("row", "pos", "t", "depth", F.lag("t").over(order).alias("prev"), F.lead("t").over(order).alias("next"))
    t, new = F.col("t"), lambda depth: F.concat(F.lit("\n"), F.repeat(F.lit(INDENT), F.greatest(depth, F.lit(0)).cast("int")))
    opens, closes = t.isin("{", "["), t.isin("}", "]")
    empty = (opens & F.col("next").isin("}", "]")) | (closes & F.col("prev").isin("{", "["))
    said = F.when(empty, t).when(opens, F.concat(t, new(F.col("depth") + 1))).when(closes, F.concat(new(F.col("depth") - 1), t)).when(t == ",", F.concat(t, new(F.col("depth")))).when(t == ":", F.lit(": ")).otherwise(t)
    return near.select("row", "pos", said.alias("said")).groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda s: s["said"]), "").alias("json"))


def first_odd(found: DataFrame) -> DataFrame:
    """row, line, column of the first token that may not stand where it stands, or of the end of a text that ends too early. found: nodes()."""
    place = lambda column: F.struct("pos", "line", column.alias("column"))
    open_ = F.sum(F.when(F.col("t").isin("{", "["), 1).when(F.col("t").isin("}", "]"), -1).otherwise(0))
    rows = found.groupBy("row").agg(F.min(F.when(~F.col("ok"), place(F.col("column")))).alias("odd"), F.max(place(F.col("column") + F.length("t"))).alias("end"), open_.alias("open"))
    return rows.select("row", F.coalesce("odd", F.when(F.col("open") != 0, F.col("end"))).alias("p")).where("p is not null").select("row", "p.line", "p.column")


def located(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """row, line, column of the member at a path (wanted: row, path, an array of names), or of the nearest object above it that is there. found: nodes()."""
    value = F.struct("pos", "container", "name", "line", "column")
    values = found.where("role = 'value'").groupBy("row").agg(F.array_sort(F.collect_list(value)).alias("values"))
    child = lambda vs, at, name: F.get(F.filter(vs, lambda v: (v["container"] == at["pos"]) & (v["name"] == name)), F.lit(0))
    met = wanted.join(values, "row").select("row", F.aggregate("path", F.get("values", F.lit(0)), lambda at, name: F.coalesce(child(F.col("values"), at, name), at)).alias("at"))
    return met.select("row", "at.line", "at.column")


def repeated(found: DataFrame) -> DataFrame:
    """row, pos, container, name, nth, of, path (names from the top, joined by SEPARATOR) of every key that its object repeats. found: stored nodes()."""
    same = Window.partitionBy("row", "container", "name")
    keys = found.where("role = 'key'").select("row", "pos", "container", "name", F.row_number().over(same.orderBy("pos")).alias("nth"), F.count("*").over(same).alias("of")).where("of > 1")
    keys = settle(keys, "repeated")
    opens = found.where("role = 'value' and t in ('{', '[')").select("row", F.col("pos").alias("at"), F.col("container").alias("up"), F.col("name").alias("of_it"))
    # From each object up to the top, a level a round; there are as many rounds as the deepest of these objects has containers above it.
    climb, done = keys.select("row", "container", F.col("container").alias("at"), F.array().cast("array<string>").alias("names")).distinct(), None
    while True:
        climb = settle(climb.join(opens, ["row", "at"], "left").select("row", "container", F.col("up").alias("at"), F.when(F.col("of_it").isNull(), F.col("names")).otherwise(F.concat(F.array("of_it"), F.col("names"))).alias("names")), "climb")
        top = climb.where("at is null").select("row", "container", F.array_join("names", SEPARATOR).alias("path"))
        done, climb = top if done is None else done.union(top), climb.where("at is not null")
        if climb.isEmpty():
            return keys.join(done, ["row", "container"])


def without_repeats(found: DataFrame, n: int | None = None) -> DataFrame:
    """row, json, fault, line, column: texts in which maps have each key once (the first in sorted maps, the last elsewhere); fault: the path of a named member that is repeated, and where it is, and then json is null. found: stored nodes() of well-formed texts; n: over how many tasks they go, see tasks()."""
    found = found if n is None else found.repartition(n, "row")
    keys = settle(repeated(found), "repeated")
    is_ = lambda pattern: F.rlike("path", F.lit(f"^(?:{pattern})$"))
    whole = F.concat_ws(".", F.nullif(F.replace("path", F.lit(SEPARATOR), F.lit(".")), F.lit("")), F.col("name"))
    faults = keys.where(is_(RECORDS) & (F.col("nth") == 2)).groupBy("row").agg(F.min(F.struct("pos", whole.alias("fault"))).alias("f")).select("row", "f.pos", "f.fault").join(found.select("row", "pos", "line", "column"), ["row", "pos"]).drop("pos")
    after = Window.partitionBy("row", "container").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    ends = found.select("row", "pos", F.min(F.when(F.col("t").isin(",", "}", "]"), F.col("pos"))).over(after).alias("end"))
    first_stays = is_(MAPS)
    gone = keys.where(F.when(first_stays, F.col("nth") > 1).otherwise(F.col("nth") < F.col("of"))).join(ends, ["row", "pos"])
    # With the comma before an entry that isn't the first, or the comma after one that isn't the last.
    spans = gone.select("row", F.explode(F.array(F.struct((F.col("pos") - 0.5).alias("pos"), F.lit(1).alias("step")), F.struct(F.when(first_stays, F.col("end") - 0.5).otherwise(F.col("end") + 0.5).alias("pos"), F.lit(-1).alias("step")))).alias("s")).select("row", "s.pos", "s.step")
    marks = spans.select("row", F.col("pos").cast("double").alias("pos"), F.lit(None).cast("string").alias("t"), "step")
    texts = found.select("row", F.col("pos").cast("double").alias("pos"), "t", F.lit(0).alias("step"), F.lead("pos").over(Window.partitionBy("row").orderBy("pos")).alias("after_pos"))
    # The comma before a dropped entry of a sorted map goes with it.
    with_key = gone.where(first_stays).select("row", F.col("pos").cast("long").alias("after_pos"), F.lit(True).alias("leads"))
    texts = texts.join(with_key, ["row", "after_pos"], "left").where(~F.coalesce(F.col("leads"), F.lit(False))).select("row", "pos", "t", "step")
    covered = F.sum("step").over(Window.partitionBy("row").orderBy("pos", "step").rowsBetween(Window.unboundedPreceding, 0))
    kept = texts.union(marks).withColumn("covered", covered).where("covered = 0 and t is not null")
    json = kept.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "").alias("json"))
    return json.join(faults, "row", "left").select("row", F.when(F.col("fault").isNull(), F.col("json")).alias("json"), "fault", "line", "column")
