"""The six rankers behind one signature, and predictions for a single session."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailrank.operators import action, content, ensemble, factors, graph, itemitem, markov, popularity, sessions


def _popularity(histories, asked, candidates, interactions, targets, listings, p):
    return popularity.predict(popularity.fit(interactions, targets, p=p or popularity.Params()), asked, candidates)


def _item_item(histories, asked, candidates, interactions, targets, listings, p):
    p = p or itemitem.Params()
    x = itemitem.session_item_weights(interactions, targets, p)
    return itemitem.predict(histories, asked, candidates, x, itemitem.similarity(x, p), p)


def _session_session(histories, asked, candidates, interactions, targets, listings, p):
    return sessions.predict(histories, asked, candidates, interactions, targets, p or sessions.Params())


def _content(histories, asked, candidates, interactions, targets, listings, p):
    if listings is None:
        raise ValueError("the content ranker needs listings")
    return content.predict(histories, asked, candidates, interactions, targets, listings, p or content.Params())


def _factors(histories, asked, candidates, interactions, targets, listings, p):
    p = p or factors.Params()
    rated = factors.ratings(interactions, targets, p)
    build = {"MF_IMPLICIT_BPR": factors.bpr_factors, "MF_IMPLICIT_ALS": factors.als_factors, "MF_IMPLICIT_LMF": factors.lmf_factors, "MF_SVD": factors.svd_factors}
    return factors.predict(histories, asked, candidates, rated, build[p.variant](rated, p), p)


def _graph(histories, asked, candidates, interactions, targets, listings, p):
    p = p or graph.Params()
    return graph.predict(histories, asked, candidates, interactions, targets, p, graph.train(interactions, p))


MODELS = {"popularity": _popularity, "item_item": _item_item, "user_user": _session_session, "cbf": _content, "mf": _factors, "session_gnn": _graph}


def scores(model: str, histories: DataFrame, asked: DataFrame, candidates: DataFrame, interactions: DataFrame, targets: DataFrame | None = None, listings: DataFrame | None = None, params=None) -> DataFrame:
    """(session_id, job_id, score) of every candidate for every asked session, by the named model."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; there are {', '.join(MODELS)}")
    return MODELS[model](histories, asked, candidates, interactions, targets, listings, params)


def available(models, histories: DataFrame, asked: DataFrame, candidates: DataFrame, interactions: DataFrame, targets: DataFrame | None = None, listings: DataFrame | None = None, params: dict | None = None) -> dict[str, DataFrame]:
    """Score tables of those of ``models`` that can be built."""
    built = {}
    for model in models:
        try:
            built[model] = scores(model, histories, asked, candidates, interactions, targets, listings, (params or {}).get(model))
        except (ValueError, KeyError, TypeError) as reason:
            warnings.warn(f"model {model} is left out: {reason}", stacklevel=2)
    if not built:
        raise ValueError("no model can be built")
    return built


def recommend(weights: dict[str, float], histories: DataFrame, asked: DataFrame, candidates: DataFrame, interactions: DataFrame, targets: DataFrame | None = None, listings: DataFrame | None = None, mode: str = "minmax", k: int = 10, params: dict | None = None) -> DataFrame:
    """(session_id, rank, job_id) by the weighted blend; ``candidates`` is (job_id, cand_rank).

    Models that cannot work on what is given, such as the content ranker without
    listings, are left out with a warning; without any model left it fails.
    """
    built = available({m: w for m, w in weights.items() if w > 0}, histories, asked, candidates.select("job_id"), interactions, targets, listings, params)
    stacked = ensemble.stack(built).withColumn("score", F.round("score", 9))
    return ensemble.recommend(ensemble.blend(stacked, weights, mode), asked, histories, candidates, k=k)


def predict_session(spark: SparkSession, job_ids: list, actions: list[str], trans: DataFrame, popular: DataFrame, k: int = 10) -> tuple[list[str], str]:
    """The k next jobs and the next action of one session: last-job transitions, else the popular list; the last action."""
    rows = [("q", str(j), a, n) for n, (j, a) in enumerate(zip(job_ids, actions, strict=False))]
    history = spark.createDataFrame(rows, "session_id string, job_id string, action string, pos long")
    asked = spark.range(1).select(F.lit("q").alias("session_id"))
    ranked = markov.recommend_last(history, asked, trans, popular, k).orderBy("rank").collect()
    return [r["job_id"] for r in ranked], action.last_action(history, asked).first()["action"]
