"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from trailrank.plans.catalog import QUERIES
from trailrank.plans.oracle import ORACLE_SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def same(value):
    return round(float(value), 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", ["markov_mrr", "pop_trending", "pop_hybrid", "ii_scores", "uu_scores", "cbf_recency", "norm_rank", "ensemble_recs", "weight_grid_mrr", "text_clean", "tfidf", "submission", "submission_blend", "gnn_examples", "explode_sessions", "disjoint_union"])
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(tuple(map(same, r)) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_every_sql_has_its_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_streaming_session_aggregates(spark, tmp_path):
    from pyspark.sql import functions as F

    from trailrank.streaming import sessions

    rows = spark.createDataFrame([("u", "a", "apply", 0), ("u", "b", "view", 60), ("u", "a", "view", 7200), ("v", "a", "view", 90000)], "session_id string, job_id string, action string, s long")
    rows.withColumn("ts", F.timestamp_seconds("s")).drop("s").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, job_id string, action string, ts timestamp").parquet(str(tmp_path / "in"))
    for name, df in (("activity", sessions.activity(stream)), ("visits", sessions.visits(stream))):
        run = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        run.processAllAvailable()
        run.stop()
    assert spark.table("activity").where("job_id = 'a' AND n = 1 AND applies = 1").count() == 1
    assert {r["n"] for r in spark.table("visits").where("session_id = 'u'").collect()} == {1, 2}
