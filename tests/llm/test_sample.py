"""Bounded samples by hash are those of an ordering of all rows."""

from pyspark.sql import functions as F

from trailrank.llm._sample import hash_share


def test_same_rows_as_ordering_all(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("y"))
    first = lambda df: [r[0] for r in df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(500).collect()]
    share = hash_share(rows, 500, "doc_id")
    assert 500 <= share.count() < 1500
    assert first(share) == first(rows)


def test_small_hot_and_empty_tables(spark):
    rows = spark.range(300).select(F.col("id").alias("doc_id"))
    assert hash_share(rows, 500, "doc_id").count() == 300
    assert hash_share(rows.limit(0), 500, "doc_id").count() == 0
    hot = rows.select(F.when(F.col("doc_id") % 3 == 0, 7).otherwise(F.col("doc_id")).alias("doc_id"))
    share = hash_share(hot, 50, "doc_id")
    assert share.where("doc_id = 7").count() in (0, hot.where("doc_id = 7").count())
    assert hash_share(rows.select(F.lit(None).cast("long").alias("doc_id")), 5, "doc_id").count() in (0, 300)
