"""The pipeline judges rows, not ids: null ids, repeated rows, and ids with two texts."""

from helpers import awkward, clashing, frame
from pyspark.sql import functions as F

import corpus_pipeline
from terrashard import storage
from terrashard.llm import language_id, minhash

STAGES = dict(corpus_pipeline.STAGES)
CLEAN = "Every clean sentence of this text has enough words that none of the rules could reject it today."
OTHER = "Quite another story with plenty of plain vocabulary was written down here by somebody else yesterday."


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_quality_rules_judge_rows(spark):
    docs = frame(spark, [(None, "# # #", "en", "s", 5), (None, CLEAN, "en", "s", 0), (1, "one", "en", "s", 3), (1, CLEAN, "en", "s", 0)])
    assert texts(STAGES["quality rules"](spark, docs, "")) == [(1, CLEAN), (None, CLEAN)]


def test_language_judges_rows(spark):
    docs = frame(spark, [(i, CLEAN, "en", "s", 0) for i in range(9)] + [(None, "12 34", "en", "s", 5), (3, "56 78", "en", "s", 5)])
    assert texts(STAGES["language ID"](spark, docs, "")) == [(i, CLEAN) for i in range(9)]


def test_near_dedup_keeps_one_row_of_a_class(spark):
    docs = frame(spark, [(None, CLEAN, "en", "s", 0), (7, CLEAN, "en", "s", 0), (7, CLEAN, "en", "s", 0), (9, OTHER, "en", "s", 0), (7, OTHER, "en", "s", 0), (None, OTHER, "en", "s", 0), (None, "x y z", "en", "s", 0), (None, None, "en", "s", 0)])
    assert texts(STAGES["MinHash near-dedup"](spark, docs.repartition(3), "")) == sorted([(7, CLEAN), (7, OTHER), (None, "x y z"), (None, None)], key=str)


def test_texts_of_one_id_are_compared_each(spark):
    words = OTHER.split()
    near = " ".join([*(f"w{i}" for i in range(60)), "a"]), " ".join([*(f"w{i}" for i in range(60)), "b"])
    docs = frame(spark, [(4, " ".join(words), "en", "s", 0), (4, near[0], "en", "s", 0), (5, near[1], "en", "s", 0), (6, " ".join(words), "en", "s", 0)])
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(4, len(words) - 4, 4, True), (4, 57, 4, True), (5, 57, 4, False), (6, len(words) - 4, 4, False)]


def test_every_stage_takes_empty_and_unlabelled_rows(spark):
    unlabelled = [(i, CLEAN, None, "s", 0) for i in range(3)] + [(None, OTHER, None, "s", 0), (5, "12 34", None, "s", 0), (6, None, None, "s", 0)]
    for data in ([], awkward(), unlabelled):
        docs = clashing(frame(spark, data))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            assert out.count() <= 400 and (name == "packing" or out.columns == docs.columns)
    assert texts(STAGES["language ID"](spark, docs, "")) == sorted([*((i, CLEAN) for i in range(3)), (None, OTHER)], key=str)
    got = language_id.identify(docs, language_id.fit(docs)).collect()
    assert len(got) == 6 and all((r.lang_pred, r.score) == ("und", 0) for r in got)


def test_columns_of_any_name_come_back(spark):
    """Names that stages use themselves are the documents' own."""
    docs = clashing(frame(spark, [(i, f"{CLEAN} {i} {OTHER}", "en", "s", 0) for i in range(5)])).withColumn("_row", F.lit("mine")).withColumn("_copy", F.lit("yours"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and {(r["_row"], r["_copy"], r["row"]) for r in out.collect()} == {("mine", "yours", "x")}, name


def test_a_stage_clears_up_after_the_one_before(spark):
    docs = frame(spark, [(i, f"{CLEAN} {i}", "en", "s", 0) for i in range(9)])
    first = STAGES["MinHash near-dedup"](spark, docs, "")
    of_first = list(corpus_pipeline.left)
    chained = STAGES["mixing sources"](spark, first, "")  # not written in between: what it reads stays
    assert chained.count() > 0 and any(p in storage.live for p in of_first) and not all(p in storage.live for p in of_first)
    of_second = list(corpus_pipeline.left)
    done = storage.settle(chained, "done")
    assert STAGES["quality rules"](spark, done, "").count() == done.count() and not any(p in storage.live for p in of_second)


def test_verdicts_join_on_whole_hashes(spark):
    key = frame(spark, [(1, "a", None, None, 0), (2, None, None, None, 0), (3, "", None, None, 0)]).select(corpus_pipeline.text_key().alias("k")).collect()
    assert all(len(r.k) == 16 for r in key) and key[1] == key[2] != key[0]
