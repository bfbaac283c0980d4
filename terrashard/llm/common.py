"""Pieces that several corpus operators share: words, shared storage, size-checked joins."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, fresh, settle, shared_dir

__all__ = ["BROADCAST_ROWS", "SPACES", "SPACES_RE", "discard", "fresh", "keep_ids", "n_words", "settle", "shared_dir", "table", "words", "worker_cache"]

#: A word is a run of characters other than space, tab, \n, \v, \f and \r.
SPACES = " \t\n\x0b\x0c\r"
SPACES_RE = r"[ \t-\r]+"
#: Most rows of two longs (about 40 bytes each once hashed) that a join may broadcast.
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_cache(key, make):
    """make(), once for each key in a Python worker's life: tasks that follow in the same worker find it again."""
    kept = sys.modules.setdefault("terrashard_worker", types.ModuleType("terrashard_worker")).__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def words(text: Column) -> Column:
    """Array of words; empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES_RE))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def keep_ids(df: DataFrame, ids: DataFrame, key: str, *, anti: bool = False, n_ids: int | None = None) -> DataFrame:
    """Rows of df whose key is (or, with anti, isn't) in ids, a table of one column of that name. A null key is in no table.

    Broadcast only if a count shows that ids has at most BROADCAST_ROWS rows; otherwise a shuffled join.
    """
    n = ids.count() if n_ids is None else n_ids
    side = F.broadcast(ids) if n <= BROADCAST_ROWS else ids.hint("merge")
    return df.join(side, key, "left_anti" if anti else "left_semi")
