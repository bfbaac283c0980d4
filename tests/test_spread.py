"""Subtrees are decoded by tasks that follow their number."""

import os

from pyspark.sql import functions as F

from terrashard import catalog, storage


def test_tasks_follow_rows(spark, monkeypatch):
    monkeypatch.setattr(storage, "SHARE", 1000)
    spread = storage.spread(spark.range(10_001).coalesce(1))
    sizes = [r[1] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 11 and sum(sizes) == 10_001 and max(sizes) < 2000
    assert storage.spread(spark.range(0)).count() == 0


def test_customers_of_one_file_are_decoded_by_many_tasks(spark, tmp_path):
    spark.range(3000).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    for name, table in (("external_buffers", "opened-"), ("subtree_errors", "payloads-")):
        before = set(storage.live)
        assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 3000
        stored = [p for p in storage.live if p not in before and table in p]
        assert [sum(f.endswith(".parquet") for f in os.listdir(p)) for p in stored] == [4]


def test_equal_values_meet(spark):
    met = storage.spread(spark.range(5000).select((F.col("id") % 700).alias("k")), "k", share=500)
    parts = met.withColumn("p", F.spark_partition_id()).groupBy("k").agg(F.countDistinct("p").alias("n"), F.max("p").alias("at")).collect()
    assert met.rdd.getNumPartitions() == 10 and {r.n for r in parts} == {1} and len({r.at for r in parts}) > 5


def test_lines_of_one_file_become_documents_in_many_tasks(spark, monkeypatch):
    from terrashard.plans import queries

    monkeypatch.setattr(queries, "spread", lambda df, *by, share: storage.spread(df, *by, share=100))
    made = queries.order_documents(spark, "/root/testdata/sf0.001")
    assert made.groupBy(F.spark_partition_id()).count().count() > 4
