"""The common signature of the rankers."""

import math

import pytest
from pyspark.sql import functions as F

from trailrank.functions import schema
from trailrank.operators import factors, markov
from trailrank.plans import registry

ROWS = [("s1", "a", "view", 0, 1), ("s1", "b", "apply", 1, 1), ("s2", "a", "view", 0, 2), ("s2", "c", "view", 1, 2), ("s3", "b", "view", 0, 3), ("s3", "c", "view", 1, 3)]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(ROWS, "session_id string, job_id string, action string, pos long, session_ord long")


def test_every_model_scores_every_candidate(spark, log):
    asked, cands = log.select("session_id").distinct(), spark.createDataFrame([("a",), ("c",), ("new",)], "job_id string")
    listings = spark.createDataFrame([("a", "one two"), ("b", "two one"), ("c", "three one")], "job_id string, text string")
    for model in registry.MODELS:
        params = factors.Params(variant="MF_SVD", n_factors=1) if model == "mf" else None
        got = registry.scores(model, log, asked, cands, log, listings=listings, params=params).collect()
        assert len(got) == 9 and all(math.isfinite(r["score"]) for r in got), model
    with pytest.raises(ValueError):
        registry.scores("other", log, asked, cands, log)


def test_one_session(spark, log):
    trans = markov.transitions(log)
    popular = markov.popular_jobs(trans)
    assert registry.predict_session(spark, ["x", "a"], ["view", "apply"], trans, popular) == (["b", "c"], "apply")
    assert registry.predict_session(spark, [], [], trans, popular) == (["c", "b"], "view")


def test_ids_become_whole_numbers_where_they_can(spark):
    rows = spark.createDataFrame([("007",), ("x1",)], "v string").select(schema.as_int_if_possible(F.col("v")))
    assert [r[0] for r in rows.collect()] == ["7", "x1"]
