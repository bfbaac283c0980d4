"""Subtree files as they arrive: a stream of decoded loads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import tileid
from ..operators import tracker
from ..sources import subtrees
from ..storage import discard, settle

FILES = "path string, modificationTime timestamp, length long, content binary"
#: Names of files: level, x, y[, z], with anything but digits between them.
NAME = r"(\d+)\D+(\d+)\D+(\d+)(?:\D+(\d+))?\D*$"


def place(path: Column, n: int = 2) -> list[Column]:
    name = F.substring_index(path, "/", -1)
    return [F.nullif(F.regexp_extract(name, NAME, i + 1), F.lit("")).cast("bigint").alias(c) for i, c in enumerate(("level", *tileid.AXES[:n]))]


def stream(spark: SparkSession, folder: str, n: int = 2) -> DataFrame:
    """id (path), modified, level, x, y[, z], tile, child, content_layers, error_code, error_detail of each file that comes into a folder.

    Decoding is stateless; which loads a tracker accepts depends on those before them: follow() keeps these in a table.
    """
    files = spark.readStream.schema(FILES).format("binaryFile").load(folder)
    given = files.select(F.col("path").alias("id"), F.col("modificationTime").alias("modified"), *place(F.col("path"), n), "content")
    return subtrees.decode(given)


def accepted(spark: SparkSession, folder: str, schema: str | StructType, before: int | None = None) -> DataFrame:
    """The loads (of this schema) that follow() has accepted, and batch; those of batches before a number, if one is given."""
    whole = StructType.fromDDL(schema) if isinstance(schema, str) else StructType(list(schema.fields))
    found = spark.read.schema(whole.add("batch", "long")).parquet(folder)
    return found if before is None else found.where(F.col("batch") < before)


def follow(folder: str, depth: int, n: int = 2) -> Callable[[DataFrame, int], None]:
    """For foreachBatch of a stream of loads (forest, ordinal, level, x, y[, z], tile, child, content_layers): keeps what a tracker accepts in a folder of tables.

    A batch is judged against what earlier ones have accepted, by joins on places: no forest's subtrees meet in one task's
    state, however many one forest has. ordinal orders the loads of a batch (a struct of time and name will do); a later batch's are larger.
    A batch writes its own subfolder and reads those of smaller numbers only, so one that is run again after a failure gives the same table.
    """

    def run(batch: DataFrame, number: int) -> None:
        loads = settle(batch, "loads")  # read once a level
        held = accepted(batch.sparkSession, folder, batch.schema, number).drop("batch") if number else None
        levels = tracker.accepted_levels(loads, depth, n, held)
        out = levels[0].select(*loads.columns)
        for level in levels[1:]:
            out = out.union(level.select(*loads.columns))
        out.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={number}")
        discard(loads, *levels)

    return run
