"""Search over weights and parameters, and the refit of the blend."""

import random
from dataclasses import fields

import pytest
from pyspark.sql import functions as F

from trailrank.functions import schema
from trailrank.operators import ensemble, popularity
from trailrank.plans import registry, search

ROWS = [("1", "a", "view", 0), ("1", "b", "apply", 1), ("1", "c", "view", 2), ("2", "a", "view", 0), ("2", "c", "view", 1), ("2", "d", "apply", 2), ("3", "b", "view", 0), ("3", "c", "view", 1), ("3", "a", "view", 2)]


@pytest.fixture(scope="module")
def log(spark):
    return schema.normalize(spark.createDataFrame(ROWS, "session_id string, job_id string, action string, pos long"))


def test_spaces_name_parameters_and_hold_what_they_say():
    for model, space in search.SPACES.items():
        assert set(space) <= {f.name for f in fields(search.PARAMS[model])}, model
    space = search.model_space(search.SPACES) | search.weight_space(search.SPACES)
    assert not any(k.startswith("session_gnn.") for k in space)
    past = []
    for n in range(40):
        params = search.suggest(space, past, random.Random(n))
        for name, s in space.items():
            assert params[name] in s if isinstance(s, list) else s[0] <= params[name] <= s[1]
            assert isinstance(params[name], int) or not isinstance(s[0], int)
        past.append((params, params["w_mf"]))
    assert search.params_of({"popularity.w_view": 1.0, "w_popularity": 0.5}) == {"popularity": popularity.Params(w_view=1.0)}
    assert search.weights_of({"w_a": 3.0, "w_b": 1.0, "mf.n_factors": 64}) == {"a": 0.75, "b": 0.25}


def test_guided_draws_approach_the_best():
    space, past = {"x": (0.0, 1.0), "k": [1, 2, 3]}, []
    goal = lambda p: -((p["x"] - 0.3) ** 2) - (p["k"] != 2)
    for n in range(80):
        params = search.suggest(space, past, random.Random(f"7-{n}"))
        past.append((params, goal(params)))
    late = [p for p, _ in past[60:]]
    assert sum(abs(p["x"] - 0.3) for p in late) / 20 < 0.15  # even draws: 0.29
    assert sum(p["k"] == 2 for p in late) > 12


def test_a_stopped_study_goes_on_as_if_it_had_not_been(spark, tmp_path):
    space, asked = {"x": (0.0, 1.0)}, []

    def goal(p):
        asked.append(p["x"])
        return -abs(p["x"] - 0.5)

    whole = search.study(spark, str(tmp_path / "whole"), space, goal, 14)
    ran = list(asked)
    asked.clear()
    search.study(spark, str(tmp_path / "parts"), space, goal, 5)
    assert search.study(spark, str(tmp_path / "parts"), space, goal, 14) == whole
    assert asked == ran and len(ran) == 14
    asked.clear()
    assert search.study(spark, str(tmp_path / "parts"), space, goal, 14) == whole and not asked
    with pytest.raises(ValueError):
        search.study(spark, str(tmp_path / "none"), space, goal, 0)


def test_weights_are_tried_on_a_stored_cube(spark, log, tmp_path):
    history, truth = schema.split_last(log)
    candidates = ensemble.candidate_order(history, log)
    calls = []

    def build():
        calls.append(1)
        return registry.available(["popularity", "item_item"], history, truth, candidates.select("job_id"), history)

    cube = search.score_cube(build, [history], str(tmp_path))
    again = search.score_cube(build, [history], str(tmp_path))
    assert len(calls) == 1 and cube.count() == again.count() == 2 * 3 * 4
    value = search.weights_objective(cube, history, truth, candidates)
    fitted = search.full_objective(["popularity", "item_item"], history, truth, candidates, history)
    for params in ({"w_popularity": 1.0, "w_item_item": 0.0}, {"w_popularity": 0.2, "w_item_item": 0.6}):
        assert value(params) == fitted(params) > 0
    assert search.full_objective(["cbf"], history, truth, candidates, history)({"w_cbf": 1.0}) == 0.0


def test_candidates_go_by_count_then_id_then_the_rest(spark, log):
    extra = spark.createDataFrame([("z",), ("a",), ("e",)], "job_id string")
    assert [r["job_id"] for r in ensemble.candidate_order(log, extra).orderBy("cand_rank").collect()] == ["a", "c", "b", "d", "e", "z"]


def test_refit_lists_unseen_jobs(spark, log):
    history, truth = schema.split_last(log)
    asked = F.col("session_id") == "1"
    known = log.where(~asked).unionByName(history.where(asked))
    got = search.refit_submission({"popularity": 0.5, "item_item": 0.5}, known, history.where(asked), truth.where(asked), log.select("job_id"), k=3).collect()
    assert [(r["session_id"], r["action"], sorted(r["job_id"].split(","))) for r in got] == [("1", "apply", ["c", "d"])]
