"""Mixing sources to target weights by weighted fair queueing.

Sources in code-point order, null last, weigh WEIGHTS in turn and share the budget, all words of the corpus; no target
exceeds EPOCHS times its source's size, and the excess is shared anew by weight until none does (water filling, in
closed form over the table of sources). Each source's documents are shuffled by a seeded hash and repeated up to EPOCHS
times. A copy's virtual finish time is its source's cumulative words, divided by the target. Ordered by finish time,
copies are taken until the next would pass the budget.

A source may hold most rows, so its running sums have two levels: sums of hash-range buckets, whose number follows the
source's row count, then windows inside a bucket. The hash is of id, text, source and seed; rows that are alike in all of
these are numbered (in two levels, too), and the number joins the hash, so that a third of all rows being copies of one
makes no bucket large. The cut in the global order is found by sums of coarse finish-time bins, then of fine bins inside the
bin where the budget runs out, then row by row inside one fine bin. Sources are ranked and summed in ranges of SOURCES rows.
Everything is built-in operators.

Defined results: null text has size 0 and takes 0; a source without words has target 0; rows that repeat a doc_id are
documents of their own (rows alike in doc_id, text and source are interchangeable); a null source is a source; an empty table
gives an empty one. Only doc_id, text and source are read, so further columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, fresh, keep_ids, n_words, settle

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 17
#: Rows of one source in a bucket of the shuffle, on average.
BUCKET_ROWS = 2000
#: Sources that one task ranks.
SOURCES = 100_000
#: Bins of the virtual finish time, in each of two levels.
BINS = 4096


def running(df: DataFrame, n_rows: int, order: list[Column], **added: Column) -> DataFrame:
    """df with running sums in a total order, over the rows up to and with each: within ranges of SOURCES rows, and over the sums of ranges."""
    ranged = settle(df.repartitionByRange(n_rows // SOURCES + 1, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy("_range").agg(*(F.sum(c).alias(f"_{k}") for k, c in added.items())).select("_range", *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in added))
    here = ranged.select("*", *(F.sum(c).over(inside).alias(k) for k, c in added.items()))
    return here.join(ends, "_range").select(*df.columns, *((F.col(k) + F.col(f"_{k}")).alias(k) for k in added))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sid (rank), source, source_size, rows, target of a table source, source_size, rows that has one row for each source."""
    n = sources.count()
    name = F.col("source").asc_nulls_last()
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("sid") - 1, F.lit(len(weights))).cast("int")).cast("long")
    weighed = running(sources, n, [name], sid=F.lit(1)).withColumn("weight", weight).withColumn("room", F.col("source_size") / F.col("weight"))
    # Capped sources are those with the least room for their weight. With the first j capped, a unit of weight gets
    # (budget - room of those) / (weight of the rest); the level that holds is the first that the next one's room covers.
    budget, units = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    filled = running(weighed, n, [F.col("room").asc(), name], upto=F.col("source_size"), units=F.col("weight"))
    level = (F.lit(budget) - epochs * (F.col("upto") - F.col("source_size"))) / (F.lit(units) - (F.col("units") - F.col("weight")))
    fits = epochs * F.col("source_size") >= level * F.col("weight")  # true from the level that holds on; later ones are no higher
    filled = settle(filled, "filled")
    unit = filled.agg(F.max(F.when(fits, level))).first()[0]
    return filled.select("sid", "source", "source_size", "rows", F.least(F.lit(unit).cast("double") * F.col("weight"), (epochs * F.col("source_size")).cast("double")).alias("target"))


def keyed(sized: DataFrame) -> DataFrame:
    """sized, a stored table, in which copies of one key have keys of their own: the key and their number, hashed."""
    often = settle(sized.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "often")
    n_often = often.count()
    part = F.shiftright("row", 33)  # of the partition that numbered the row
    some = keep_ids(sized, often, "key", n_ids=n_often).withColumn("part", part)
    inside = Window.partitionBy("key", "part").orderBy("row")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = some.groupBy("key", "part").agg(F.count("*").alias("n")).select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.col("start") + F.col("nth") - 1
    copies = some.withColumn("nth", F.row_number().over(inside)).join(starts, ["key", "part"])
    key = F.when(number == 0, F.col("key")).otherwise(F.md5(F.concat("key", F.lit(":"), number.cast("string"))))
    rest = keep_ids(sized, often, "key", anti=True, n_ids=n_often).select("row", "doc_id", "source", "size", "key")
    return rest.union(copies.select("row", "doc_id", "source", "size", key.alias("key")))


def finish(copy: int) -> Column:
    """Virtual finish time of a document's copy."""
    return F.when(F.col("target") > 0, (copy * F.col("source_size") + F.col("run")) / F.col("target")).otherwise(F.lit(0.0))


def bins(at: Column) -> tuple[Column, Column]:
    """Coarse and fine bin of a finish time. Past 2 every source has passed its target, so one bin is left for it."""
    coarse = F.least(F.floor(at * (BINS / 2)), F.lit(BINS)).cast("long")
    return coarse, F.least(F.floor((at * (BINS / 2) - coarse) * BINS), F.lit(BINS - 1)).cast("long")


def cut(sums: DataFrame, left: int) -> tuple[int, int]:
    """The first bin, of a table bin, s of at most BINS + 1 rows, that doesn't fit into what is left, and what is left on entering it."""
    line = Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    row = sums.withColumn("upto", F.sum("s").over(line)).where(F.col("upto") > left).agg(F.min(F.struct("bin", (left - (F.col("upto") - F.col("s"))).alias("left"))).alias("c")).first()
    return (row.c.bin, row.c.left) if row.c else (BINS + 1, left)


def shares(rows: DataFrame, weights: tuple = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """row, doc_id, source, size, source_size, target, copies; one row for each of rows: row (as monotonically_increasing_id() numbers them), doc_id, text, source. rows is read once."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-"))
    key = F.md5(F.concat_ws(":", blank(F.col("doc_id").cast("string")), F.lit(str(seed)), F.md5(blank(F.col("text").cast("string"))), source))
    sized = settle(rows.select("row", "doc_id", F.col("source").cast("string"), n_words(F.col("text").cast("string")).alias("size"), key.alias("key")), "sized")
    sources = settle(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), weights, epochs), "sources")
    n_sources, budget = sources.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    side = F.broadcast(sources) if n_sources <= SOURCES else sources.hint("merge")
    # The first 8 hex digits are a number below 2^32; its range buckets keep the order of the keys.
    bucket = F.conv(F.substr("key", F.lit(1), F.lit(8)), 16, 10).cast("long") * F.ceil(F.col("rows") / BUCKET_ROWS)
    bucketed = settle(keyed(sized).join(side.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("named").withColumn("bucket", F.shiftright(bucket, 32)), "bucketed")
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = bucketed.groupBy("sid", "bucket").agg(F.sum("size").alias("s")).select("sid", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    queued = settle(
        bucketed.withColumn("own", F.sum("size").over(inside)).join(base, ["sid", "bucket"])
        .select("row", "doc_id", "source", "key", "size", "source_size", "target", (F.col("base") + F.col("own")).alias("run")), "queued",
    )
    discard(sized, bucketed)

    copies = queued.where("size > 0").select("key", "size", F.inline(F.array(*(F.struct(F.lit(c).alias("copy"), finish(c).alias("finish")) for c in range(epochs)))))
    coarse, fine = bins(F.col("finish"))
    binned = copies.select("*", coarse.alias("coarse"), fine.alias("fine"))
    first, left = cut(binned.groupBy(F.col("coarse").alias("bin")).agg(F.sum("size").alias("s")), budget)
    inner = binned.where(F.col("coarse") == first)
    second, left = cut(inner.groupBy(F.col("fine").alias("bin")).agg(F.sum("size").alias("s")), left)
    line = Window.partitionBy("fine").orderBy("finish", "key", "copy").rowsBetween(Window.unboundedPreceding, 0)
    edge = inner.where(F.col("fine") == second).withColumn("upto", F.sum("size").over(line)).where(F.col("upto") <= left)
    edge = edge.agg(F.max(F.struct("finish", "key", "copy")).alias("e")).first().e

    def taken(c: int) -> Column:
        at = finish(c)
        k, g = bins(at)
        within = F.lit(False)
        if edge:
            within = F.struct(at.alias("finish"), F.col("key"), F.lit(c).alias("copy")) <= F.struct(*(F.lit(x).alias(n) for n, x in edge.asDict().items()))
        return F.when((F.col("size") > 0) & ((k < first) | (k == first) & ((g < second) | (g == second) & within)), F.lit(1)).otherwise(F.lit(0))

    return queued.select("row", "doc_id", "source", "size", "source_size", "target", sum((taken(c) for c in range(1, epochs)), taken(0)).alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken; one row for each row of docs."""
    found = shares(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "source"), **how)
    return found.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents, each row as often as the mix takes it."""
    row, copies, copy = (fresh(docs, c) for c in ("_row", "_copies", "_copy"))
    rows = settle(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    counted = settle(shares(rows.select(F.col(row).alias("row"), "doc_id", "text", "source"), **how).where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(copies)), "counted")
    side = F.broadcast(counted) if counted.count() <= BROADCAST_ROWS else counted.hint("merge")
    return rows.join(side, row).withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)
