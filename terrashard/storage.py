"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set, a temporary one, but only if driver and executors are one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="terrashard-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Folders of tables that settle() has written in this process and nothing has deleted yet.
live: list[str] = []


#: Whether Spark looks for members of VARIANT columns that could be columns of their own. Here, writing and reading these cost more than all the rest of a table.
SHRED = "spark.sql.variant.inferShreddingSchema"


#: How many folders a task writes to at a time; where there are more, it sorts its rows by them first.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def stored(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    conf = df.sparkSession.conf
    meant = {SHRED: "false", WRITERS: "4"}
    before = {k: conf.get(k, None) for k in meant}
    for k, v in meant.items():
        conf.set(k, v)
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    stored(df, path)
    live.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def stored_by(df: DataFrame, column: str, name: str) -> DataFrame:
    """settle(df), with a folder for each value of a column, so that a filter on it reads no others."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    stored(df, path, (column,))
    live.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


#: Rows that spread() gives to one task.
SHARE = 1 << 15


def spread(df: DataFrame, *by: str, share: int | None = None) -> DataFrame:
    """df's rows over tasks by their number (share of them to one; by: columns of which equal values meet): what a file holds in few bytes may be many rows, and all the work on them would fall to the task that reads it. Counts df, so for tables as they are read."""
    return df.repartition(max(-(-df.count() // (share or SHARE)), df.sparkSession.sparkContext.defaultParallelism), *by)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    if path in live:
        live.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more. What wasn't settled is left alone."""
    for df in tables:
        path = getattr(df, "settled_at", None)
        if path:
            remove(df.sparkSession, path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have: this one, or with underscores in front."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
