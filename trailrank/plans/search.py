"""Seeded, resumable search over blend weights and model parameters, and the refit of what it finds.

A trial's values are even draws at first. Then each is guided by the trials so
far (tree-structured Parzen estimator): they are split into the best quarter and
the rest, and of some draws around the best the one is taken whose density among
the best is largest against its density among the rest.

The search itself is driver code over a bounded number of trials; what a trial
costs is one distributed evaluation. Trials are kept as lines of JSON in a
folder. A trial's draws depend on the seed, its number and the trials before, so
a search that was stopped goes on as if it had not been.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailrank.functions.scores import normalize, simplex
from trailrank.operators import action, content, ensemble, factors, graph, itemitem, popularity, sessions
from trailrank.plans import registry
from trailrank.sources import files

PARAMS = {"popularity": popularity.Params, "item_item": itemitem.Params, "user_user": sessions.Params, "cbf": content.Params, "mf": factors.Params, "session_gnn": graph.Params}

#: The range of each parameter. Two whole numbers bound whole numbers; a list holds choices.
SPACES = {
    "popularity": {"recency_decay": (0.51, 0.59), "smooth_alpha": (0.60, 3.0), "w_apply": (5.0, 7.0), "w_view": (0.9, 1.5)},
    "item_item": {"last_n": (9, 12), "query_recency_decay": (0.73, 0.76), "shrinkage": (16, 17), "train_recency_decay": (0.88, 0.90), "tversky_alpha": (0.21, 0.30), "tversky_beta": (0.02, 0.04), "w_apply": (1.50, 1.72), "w_view": (1.23, 1.29)},
    "user_user": {"iuf_exponent": (1.39, 1.42), "neighbor_item_recency_decay": (0.92, 0.95), "neighbor_position_boost": (1.30, 1.32), "neighbor_target_boost": (1.27, 1.31), "query_recency_decay": (0.78, 0.80), "sim_power_gamma": (0.86, 0.93), "top_sessions": (80, 85), "w_apply": (1.58, 1.67), "w_view": (1.49, 1.54)},
    "cbf": {"w_view": (1.6, 1.8), "w_apply": (2.5, 3.0), "recency_decay": (0.6, 0.65), "blend_alpha_lexical": (0.54, 0.58)},
    "mf": {"last_item_boost": (1.27, 1.35), "lr_all": (0.0132, 0.0140), "n_epochs": (74, 85), "n_factors": [64, 128, 256], "query_recency_decay": (0.86, 0.90), "rating_clip_max": (2.00, 2.48), "reg_all": (0.0141, 0.0215), "sim_power_gamma": (1.78, 1.91), "train_recency_decay": (0.78, 0.99), "w_apply": (1.48, 1.73), "w_view": (0.70, 0.96)},
    "session_gnn": {"apply_view_ratio": (1.16, 1.56), "dropout": (0.31, 0.43), "n_neg": (192, 256), "neg_random_ratio": (0.698, 0.843), "temperature": (0.096, 0.114), "weight_decay": (0.00003, 0.00018)},
}
#: Even draws before the guided ones, and draws that a guided one is chosen from.
STARTUP, DRAWS = 10, 24


def weight_space(models) -> dict:
    return {f"w_{m}": (0.0, 1.0) for m in models}


def model_space(models, fixed=("session_gnn",)) -> dict:
    """``model.parameter`` ranges of ``models``; those in ``fixed`` keep their defaults."""
    return {f"{m}.{name}": space for m in models if m not in fixed for name, space in SPACES[m].items()}


def weights_of(params: dict) -> dict[str, float]:
    return simplex({k.removeprefix("w_"): v for k, v in params.items() if k.startswith("w_")})


def params_of(params: dict) -> dict:
    """Each model's ``Params`` with the trial's values."""
    given: dict[str, dict] = {}
    for key, value in params.items():
        if "." in key:
            model, name = key.split(".", 1)
            given.setdefault(model, {})[name] = value
    return {m: replace(PARAMS[m](), **values) for m, values in given.items()}


def _draw(space, rng: random.Random):
    if isinstance(space, list):
        return rng.choice(space)
    low, high = space
    return rng.randint(low, high) if isinstance(low, int) else rng.uniform(low, high)


def _density(space, seen: list, value) -> float:
    """Of ``value`` among ``seen`` values and one even draw: kernels on a range, smoothed shares of choices."""
    if isinstance(space, list):
        return (seen.count(value) + 1 / len(space)) / (len(seen) + 1)
    low, high = space
    width = (high - low) or 1
    h = width / math.sqrt(len(seen) + 1) / 2
    return (sum(math.exp(-(((value - x) / h) ** 2) / 2) / h / math.sqrt(2 * math.pi) for x in seen) + 1 / width) / (len(seen) + 1)


def _near(space, value, n: int, rng: random.Random):
    if isinstance(space, list):
        return value if rng.random() < n / (n + 1) else rng.choice(space)
    low, high = space
    moved = min(high, max(low, rng.gauss(value, (high - low) / math.sqrt(n + 1) / 2)))
    return round(moved) if isinstance(low, int) else moved


def suggest(space: dict, past: list[tuple[dict, float]], rng: random.Random) -> dict:
    """Values for the next trial; ``past`` holds (values, result), larger results being better."""
    known = [(p, v) for p, v in past if set(p) == set(space) and math.isfinite(v)]
    if len(known) < STARTUP:
        return {name: _draw(s, rng) for name, s in space.items()}
    known.sort(key=lambda row: -row[1])
    cut = -(-len(known) // 4)
    out = {}
    for name, s in space.items():
        best, rest = [p[name] for p, _ in known[:cut]], [p[name] for p, _ in known[cut:]]
        draws = [_near(s, rng.choice(best), len(best), rng) for _ in range(DRAWS)] + [_draw(s, rng)]
        out[name] = max(draws, key=lambda x: _density(s, best, x) / _density(s, rest, x))  # noqa: B023
    return out


def trials(spark: SparkSession, folder: str) -> list[tuple[dict, float]]:
    """(values, result) of the trials in ``folder``, by number; none if there is no folder."""
    where, system = files._file_system(spark, folder)
    if not system.exists(where):
        return []
    rows = [json.loads(r["value"]) for r in spark.read.text(folder).toLocalIterator()]
    return [(r["params"], r["value"]) for r in sorted(rows, key=lambda r: r["number"])]


def study(spark: SparkSession, folder: str, space: dict, objective: Callable[[dict], float], n: int, seed: int = 42) -> tuple[dict, float]:
    """The best (values, result) of ``n`` trials, of which those in ``folder`` are not run again; the first of equals."""
    past = trials(spark, folder)
    for number in range(len(past), n):
        params = suggest(space, past, random.Random(f"{seed}-{number}"))
        value = float(objective(params))
        files.log_trial(spark, folder, number, params, value)
        past.append((params, value))
    if not past:
        raise ValueError("a search needs a trial")
    return max(past, key=lambda row: row[1])


def score_cube(built: Callable[[], dict[str, DataFrame]], inputs: list[DataFrame], folder: str, params: dict | None = None, mode: str = "minmax") -> DataFrame:
    """(session_id, job_id, model, score), normalised and stored, so a trial of weights scores no model again."""

    def build() -> DataFrame:
        return normalize(ensemble.stack(built()).withColumn("score", F.round("score", 9)), mode)

    return files.cached(build, "score_cube", {"mode": mode, "params": params or {}}, inputs, folder)


def weights_objective(cube: DataFrame, histories: DataFrame, truth: DataFrame, candidates: DataFrame, k: int = 10) -> Callable[[dict], float]:
    """MRR@k of a trial's weights over a stored cube."""
    return lambda params: ensemble.trial_mrr(cube, [weights_of(params)], histories, truth, candidates, k).first()["mrr"]


def full_objective(models, histories: DataFrame, truth: DataFrame, candidates: DataFrame, interactions: DataFrame, targets: DataFrame | None = None, listings: DataFrame | None = None, mode: str = "minmax", k: int = 10) -> Callable[[dict], float]:
    """MRR@k of a trial's weights over models fitted with the trial's parameters; 0 if no model can be built."""

    def value(params: dict) -> float:
        try:
            built = registry.available(models, histories, truth, candidates.select("job_id"), interactions, targets, listings, params_of(params))
        except ValueError:
            return 0.0
        weights = weights_of({f"w_{m}": params.get(f"w_{m}", 0.0) for m in built})
        scored = normalize(ensemble.stack(built).withColumn("score", F.round("score", 9)), mode)
        return ensemble.trial_mrr(scored, [weights], histories, truth, candidates, k).first()["mrr"]

    return value


def refit_submission(weights: dict[str, float], interactions: DataFrame, histories: DataFrame, asked: DataFrame, jobs: DataFrame, listings: DataFrame | None = None, params: dict | None = None, mode: str = "minmax", k: int = 10) -> DataFrame:
    """(session_id, action, job_id): the models refitted on all ``interactions``, the asked sessions' histories among them.

    Candidates are the jobs of ``interactions``, most frequent first, then those
    of ``jobs``. ``job_id`` lists the k best, joined by commas.
    """
    candidates = ensemble.candidate_order(interactions, jobs)
    ranked = registry.recommend(weights, histories, asked, candidates, interactions, None, listings, mode, k, params)
    lists = ranked.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "job_id"))), lambda r: r["job_id"]), ",").alias("job_id"))
    return action.last_action(histories, asked).join(lists, "session_id").select("session_id", "action", "job_id")
