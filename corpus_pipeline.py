"""The corpus pipeline: five stages, each over all that its predecessor kept.

STAGES lists them; each takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as
the next one's docs. All but the last return the columns of documents. run() applies them to documents.

Quality rules and language ID judge texts: their verdicts join on a 128-bit hash of the text, and documents aren't copied. Near-dedup judges
rows, as it keeps one of several alike: it numbers and stores them once, and verdicts join on the number. What a stage has stored
on the way is deleted when the next stage begins, for by then its result is written; only tables that the next stage's docs
still read stay (as when stages are chained without writing).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashard import storage
from terrashard.llm import language_id, minhash, mixing, packing, quality_rules
from terrashard.llm.common import discard, fresh, keep_ids, settle, table
from terrashard.llm.queries import language_model, tokenizer_path

#: Tables that the last stage stored.
left: list[str] = []


def clear(spark: SparkSession, docs: DataFrame | None = None) -> None:
    """Deletes what the last stage stored, but for what docs reads."""
    reads = " ".join(docs.inputFiles()) if left and docs is not None else ""
    for path in left:
        if path.rsplit("/", 1)[-1] not in reads and path in storage.live:
            storage.remove(spark, path)
    left.clear()


def stage(work):
    """A stage that first clears up after the one before it."""

    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear(spark, docs)
        before = set(storage.live)
        out = work(spark, docs, sf_dir)
        left.extend(p for p in storage.live if p not in before)
        return out

    return run


def least_score(n_langs: int) -> float:
    """A document goes if no language reaches this probability: twice an even guess, but no more than half."""
    return min(0.5, 2 / n_langs)


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def by_text(docs: DataFrame) -> DataFrame:
    """What an operator gets that judges texts: doc_id is the text's hash, of 128 bits. Null is judged as the empty text is."""
    return docs.select(text_key().alias("doc_id"), F.col("text"))


def without_texts(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs but for the texts whose hashes are in rejected (doc_id)."""
    key = fresh(docs, "text_key")
    rejected = settle(rejected.select(F.col("doc_id").alias(key)).distinct(), "rejected")
    return keep_ids(docs.withColumn(key, text_key()), rejected, key, anti=True).select(*docs.columns)


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_texts(docs, quality_rules.decide(quality_rules.ledger(by_text(docs))).where("not kept"))


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that a language claims. Where no language could be learned, none can be refused: all rows with a letter stay."""
    model = language_model(docs)
    if not model.langs:
        return docs.where(F.rlike(F.col("text"), F.lit(r"\p{L}")))
    return without_texts(docs, language_id.identify(by_text(docs), model).where(f"lang_pred = 'und' or score < {least_score(len(model.langs))}"))


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: that of the smallest id (null last), and of the smallest number among those."""
    row = fresh(docs, "row")
    rows = settle(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    near = minhash.near_rows(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    found = settle(near.join(rows.select(row, "doc_id"), row), "near")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(row).alias("r"))
    first = found.groupBy("component_id").agg(F.min(order).alias("m")).select(F.col("m.r").alias(row))
    rejected = settle(found.select(row).join(first, row, "left_anti"), "rejected")
    return keep_ids(rows, rejected, row, anti=True).select(*docs.columns)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.crc32(packing.pack(docs, tokenizer_path()))


STAGES = [("quality rules", quality), ("language ID", language), ("MinHash near-dedup", near_dedup), ("mixing sources", mix_sources), ("packing", pack)]

#: Tokenisation and a trained model can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        done = settle(work(spark, docs, sf_dir), name.replace(" ", "_"))
        discard(docs)
        docs = done
    clear(spark)
    return docs
